"""Publication statistics of topics: rollups, totals, yearly rebuild, the January correction, growth of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.dates import period_start


def rollup_periods(monthly: DataFrame, topics: DataFrame, date_from: str, date_to: str, granularity: str) -> DataFrame:
    """Works per topic and month, quarter or year with the hierarchy's names; the join follows the aggregation."""
    m = monthly.filter(F.col("period_start").between(F.to_date(F.lit(date_from)), F.to_date(F.lit(date_to))))
    s = m.groupBy("topic_id", period_start(F.col("period_start"), granularity).alias("period")).agg(F.sum("works_count").cast("bigint").alias("works_count"))
    t = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"), "subfield_name", "field_name", "domain_name")
    return s.join(t, "topic_id").withColumn("cluster_key", F.concat(F.lit("topic:"), F.col("topic_id").cast("string")))


def totals(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("topic_id").agg(F.sum("works_count").cast("bigint").alias("total"), F.min("period_start").alias("first_period"), F.max("period_start").alias("last_period"))


def january_counts(papers: DataFrame, links: DataFrame) -> DataFrame:
    """(topic_id, stat_year, january, first_day, real_works, artificial): the January artefact of each topic and year."""
    p = papers.filter(F.month("publication_date") == 1).select(F.col("id").alias("paper_id"), F.year("publication_date").alias("stat_year"), (F.dayofmonth("publication_date") == 1).alias("first"))
    n = links.join(p, "paper_id").groupBy("topic_id", "stat_year").agg(F.count("*").alias("january"), F.count(F.when(F.col("first"), 1)).alias("first_day"))
    real, artificial = scoring.january_split(F.col("january"), F.col("first_day"))
    return n.withColumn("real_works", real).withColumn("artificial", artificial)


def rebuild_yearly(monthly: DataFrame, existing: DataFrame, include_artificial: bool = True) -> DataFrame:
    """(topic_id, stat_year, works_count, artificial): sums of months; estimates of existing rows stay, and count if so asked."""
    s = monthly.groupBy("topic_id", F.year("period_start").alias("stat_year")).agg(F.sum("works_count").cast("bigint").alias("works"))
    x = s.join(existing.select("topic_id", "stat_year", "artificial"), ["topic_id", "stat_year"], "left").withColumn("artificial", F.coalesce("artificial", F.lit(0)))
    return x.select("topic_id", "stat_year", (F.col("works") + (F.col("artificial") if include_artificial else 0)).alias("works_count"), "artificial")


def anomaly_summary(estimates: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics and artificial works by year, by year and field, by year and subfield, and in all: one grouping-sets pass."""
    x = estimates.filter("artificial > 0").join(topics.select(F.col("id").alias("topic_id"), "field_name", "subfield_name"), "topic_id", "left")
    sets = [["stat_year"], ["stat_year", "field_name"], ["stat_year", "subfield_name"], []]
    agg = x.groupingSets([[F.col(c) for c in s] for s in sets], "stat_year", "field_name", "subfield_name").agg(
        F.grouping_id().alias("level"), F.countDistinct("topic_id").alias("topics"), F.sum("artificial").cast("bigint").alias("artificial")
    )
    names = F.when(F.col("level") == 3, "year").when(F.col("level") == 1, "year_field").when(F.col("level") == 2, "year_subfield").otherwise("total")
    return agg.select(names.alias("grouping_name"), "stat_year", "field_name", "subfield_name", "topics", "artificial")


def january_rows(january: DataFrame, topics: DataFrame, year_from: int, year_to: int, min_estimate: int = 1, fields: list[str] = (), subfield_ids: list[int] = ()) -> DataFrame:
    """January artefacts of the years, of at least min_estimate, with the topic's names; of the fields and subfields named, or all."""
    t = topics.select(F.col("id").alias("topic_id"), "name", "subfield_id", "subfield_name", "field_name")
    x = january.filter(F.col("stat_year").between(year_from, year_to) & (F.col("artificial") >= min_estimate)).join(t, "topic_id", "left")
    if fields:
        x = x.filter(F.col("field_name").isin(list(fields)))
    if subfield_ids:
        x = x.filter(F.col("subfield_id").isin(list(subfield_ids)))
    return x.select("topic_id", "name", "subfield_name", "field_name", "stat_year", "january", "artificial").orderBy("stat_year", F.desc("artificial"), "topic_id")
