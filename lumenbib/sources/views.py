"""The bibliographic entities as views over the tables of a data directory, in Spark and as CTEs of the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from .parquet import table

DIM = 64


def papers(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "papers", *columns)


def paper_topics(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, topic_id, score): one row per link, the best score of its repeats."""
    t = table(spark, d, "paper_topics").filter("paper_id is not null and topic_id is not null")
    return t.groupBy("paper_id", "topic_id").agg(F.max("score").alias("score"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topics", "id", "openalex_id", "name", "subfield_id", "subfield_name", "field_name", "domain_name")


def topic_hierarchy(topics: DataFrame, subfields: DataFrame, fields: DataFrame) -> DataFrame:
    """Topics (id, name, subfield_id) with the names above them: subfields (id, name, field), fields (name, domain); left joins, so an unknown level is null."""
    s = subfields.select(F.col("id").alias("subfield_id"), F.col("name").alias("subfield_name"), F.col("field").alias("field_name"))
    f = fields.select(F.col("name").alias("field_name"), F.col("domain").alias("domain_name"))
    return topics.select("id", "name", "subfield_id").join(s, "subfield_id", "left").join(f, "field_name", "left").select("id", "name", "subfield_name", "field_name", "domain_name")


def paper_keywords(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, keyword): distinct lower-case keywords; ids are unique, so they are made distinct within the row, without a shuffle."""
    words = F.array_distinct(F.transform("extracted_keywords", lambda w: F.lower(F.trim(w))))
    k = table(spark, d, "papers", "id", "extracted_keywords").select(F.col("id").alias("paper_id"), F.explode(words).alias("keyword"))
    return k.filter("keyword is not null and keyword <> ''")


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """(topic_id, period_start, works_count): works of each topic and month."""
    p = papers(spark, d, "id", "publication_date").filter("publication_date is not null")
    x = paper_topics(spark, d).join(p, F.col("paper_id") == F.col("id"))
    return x.groupBy("topic_id", F.trunc("publication_date", "MM").alias("period_start")).agg(F.count("*").alias("works_count"))


def paper_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, topic_id, publication_date, vector): usable vectors with the paper's primary topic."""
    v = table(spark, d, "paper_points", "id", "vector").filter(vectors.usable(F.col("vector"), DIM)).select("id", vectors.doubles(F.col("vector")).alias("vector"))
    p = papers(spark, d, "id", "primary_topic_id", "publication_date")
    return v.join(p, "id").select(F.col("id").alias("paper_id"), F.col("primary_topic_id").alias("topic_id"), "publication_date", "vector")


def _of_all(spark: SparkSession, d: str, name: str):
    """A column expression: the event's number as an id of the table, over the whole range of ids (a footer's worth of reading)."""
    top = table(spark, d, name, "id").agg(F.max("id")).first()[0] or 1
    return (F.col("event_id") % top + 1).cast("bigint")


def favourites(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, paper_id, created_at): papers that users bought, the first time each."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts").filter("event_type = 'purchase'")
    return e.groupBy("user_id", _of_all(spark, d, "papers").alias("paper_id")).agg(F.min("ts").alias("created_at"))


def tracked_topics(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, topic_id, created_at): topics that users signed up for."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts").filter("event_type = 'signup'")
    return e.groupBy("user_id", _of_all(spark, d, "topics").alias("topic_id")).agg(F.min("ts").alias("created_at"))


def tracked_levels(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, category, key): levels and keywords that users follow: of the topics they signed up for, subfield, field and
    domain, and as keywords the first word of each topic's name in lower case."""
    t = topics(spark, d).select(F.col("id").alias("topic_id"), F.col("subfield_id").cast("string").alias("subfield"), F.col("field_name").alias("field"), F.col("domain_name").alias("domain"), F.lower(F.substring_index("name", " ", 1)).alias("keyword"))
    x = tracked_topics(spark, d).join(t, "topic_id")
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("key")) for c in ("subfield", "field", "domain", "keyword")])
    return x.select("user_id", F.explode(each).alias("e")).select("user_id", "e.*").filter("key is not null").distinct()


def level_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(category, key, vector): mean vectors of subfields, fields, domains and keywords over the papers that have them."""
    v = paper_vectors(spark, d).filter("topic_id is not null").select("paper_id", "topic_id", "vector")
    t = topics(spark, d).select(F.col("id").alias("topic_id"), F.col("subfield_id").cast("string").alias("subfield"), F.col("field_name").alias("field"), F.col("domain_name").alias("domain"))
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("key")) for c in ("subfield", "field", "domain")])
    levels = v.join(t, "topic_id").select("vector", F.explode(each).alias("e")).select("e.*", "vector").filter("key is not null")
    words = paper_keywords(spark, d).join(v.select("paper_id", "vector"), "paper_id").select(F.lit("keyword").alias("category"), F.col("keyword").alias("key"), "vector")
    return vectors.mean_by(levels.unionByName(words), ["category", "key"], "vector").select("category", "key", F.col("centroid").alias("vector"))


CTE = """
v_pt AS (SELECT paper_id, topic_id, max(score) AS score FROM paper_topics WHERE paper_id IS NOT NULL AND topic_id IS NOT NULL GROUP BY 1, 2),
v_kw AS (SELECT DISTINCT paper_id, keyword FROM (SELECT id AS paper_id, lower(trim(unnest(extracted_keywords))) AS keyword FROM papers) WHERE keyword IS NOT NULL AND keyword <> ''),
v_monthly AS (SELECT t.topic_id, CAST(date_trunc('month', p.publication_date) AS DATE) AS period_start, count(*) AS works_count FROM v_pt t JOIN papers p ON p.id = t.paper_id WHERE p.publication_date IS NOT NULL GROUP BY 1, 2),
v_vec AS (SELECT v.id AS paper_id, p.primary_topic_id AS topic_id, p.publication_date, CAST(v.vector AS DOUBLE[]) AS vector FROM paper_points v JOIN papers p ON p.id = v.id WHERE len(v.vector) = 64 AND len(list_filter(v.vector, lambda x: x IS NULL)) = 0 AND len(list_filter(v.vector, lambda x: x <> 0)) > 0),
v_fav AS (SELECT user_id, event_id % (SELECT max(id) FROM papers) + 1 AS paper_id, min(ts) AS created_at FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
v_track AS (SELECT user_id, event_id % (SELECT max(id) FROM topics) + 1 AS topic_id, min(ts) AS created_at FROM events WHERE event_type = 'signup' GROUP BY 1, 2)"""


def sql(body: str) -> str:
    """The body (CTEs first, if it has some, after a + or, if they are recursive, +R) under the view CTEs."""
    body = body.lstrip()
    word = "WITH RECURSIVE" if body.startswith("+R") else "WITH"
    return f"{word} {CTE.strip()}{',' if body.startswith('+') else ''}\n{body.removeprefix('+R').removeprefix('+')}"
