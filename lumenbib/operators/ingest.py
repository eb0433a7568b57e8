"""Planning of downloads and normalisation of nested work records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most records of one quota unit (fixed value).
UNIT_CAP = 10_000

WORK = """id string, doi string, title string, display_name string, publication_year int, publication_date date, type string, language string,
abstract_inverted_index map<string, array<int>>, open_access struct<is_oa: boolean>, cited_by_count int, referenced_works_count int,
authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, is_corresponding: boolean, institutions: array<struct<id: string, display_name: string, ror: string, country_code: string, type: string>>>>,
topics array<struct<id: string, display_name: string, score: double, domain: struct<display_name: string>, field: struct<display_name: string>, subfield: struct<display_name: string>>>,
keywords array<struct<display_name: string, score: double>>, locations array<struct<landing_page_url: string, pdf_url: string, license: string, version: string>>, primary_location struct<landing_page_url: string, pdf_url: string, license: string, version: string>"""


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with i: the place of each row from 0 by a unique key. Rows are range partitioned and counted by partition, then
    numbered within; no task sees all of them."""
    x = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, key).withColumn("_p", F.spark_partition_id())
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    n = x.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = n.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_b"))
    return x.join(F.broadcast(before), "_p").withColumn("i", F.col("_r") + F.coalesce("_b", F.lit(0))).drop("_p", "_r", "_b")


def plan_units(topics: DataFrame, periods: DataFrame, total: int, per_page: int, seed: int) -> DataFrame:
    """(topic_id, period_start, quota, pages, unit_seed): total records split evenly over topics and periods, what is left to the first ones.

    periods is a bounded calendar; topics of any number: units are numbered by topic id and period without a sort in one task.
    """
    t = topics.select(F.col("id").alias("topic_id"))
    n = t.count() * periods.count()
    if not n:
        return topics.sparkSession.createDataFrame([], "topic_id bigint, period_start date, quota bigint, pages bigint, unit_seed bigint")
    place = F.row_number().over(Window.orderBy("period_start"))
    months = periods.select("period_start").distinct().select("period_start", place.alias("k"))  # a bounded calendar
    per_topic = months.count()
    x = numbered(t, "topic_id").crossJoin(F.broadcast(months))
    at = F.col("i") * per_topic + F.col("k") - 1
    quota = F.least(F.floor(F.lit(total) / n).cast("bigint") + F.when(at < total % n, 1).otherwise(0), F.lit(UNIT_CAP))
    return x.select("topic_id", "period_start", quota.alias("quota"), F.ceil(quota / per_page).alias("pages"), (F.lit(seed) + at).cast("bigint").alias("unit_seed")).filter("quota > 0")


def plan_pages(units: DataFrame, per_page: int) -> DataFrame:
    """One row per page of every unit, with the records wanted of it."""
    x = units.withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pages"))))
    return x.select("topic_id", "period_start", "page", F.least(F.lit(per_page).cast("bigint"), F.col("quota") - (F.col("page") - 1) * per_page).alias("wanted"))


def indexing_status(now: DataFrame, stored: DataFrame, id_col: str) -> DataFrame:
    """now, stored (id, hash) -> (id, status): new without a stored hash row, unchanged if both hashes are equal (nulls are), else changed."""
    old = stored.select(id_col, F.col("hash").alias("_old"), F.lit(True).alias("_has"))
    x = now.select(id_col, "hash").join(old, id_col, "left")
    return x.select(id_col, F.when(F.col("_has").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("_old")), "unchanged").otherwise("changed").alias("status"))


def unit_report(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Loaded, missing and exhausted records of each unit; pages (topic_id, period_start, loaded, last) as downloaded."""
    g = pages.groupBy("topic_id", "period_start").agg(F.sum("loaded").alias("loaded"), F.max("last").alias("last"))
    x = units.join(g, ["topic_id", "period_start"], "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    missing = F.greatest(F.col("quota") - F.col("loaded"), F.lit(0))
    return x.select("topic_id", "period_start", "quota", "loaded", missing.alias("missing"), (F.coalesce("last", F.lit(False)) & (missing > 0)).alias("exhausted"))


def unit_outcomes(members: DataFrame, existing: DataFrame, key: str, skip_existing: bool = False) -> DataFrame:
    """(unit, created, updated, skipped) of members (unit, key): records by whether their key is there already; a record counts once a unit."""
    have = existing.select(key, F.lit(True).alias("_has")).distinct()
    x = members.select("unit", key).distinct().join(have, key, "left")
    n = lambda c: F.count(F.when(c, 1))
    old = F.col("_has").isNotNull()
    return x.groupBy("unit").agg(n(~old).alias("created"), n(old & ~F.lit(skip_existing)).alias("updated"), n(old & F.lit(skip_existing)).alias("skipped"))


def merge_pages(pages: DataFrame) -> DataFrame:
    """(record_id, units) of downloaded pages (unit, record_id): the units that each record belongs to, nulls left out; units are few."""
    return pages.filter("record_id is not null and unit is not null").groupBy("record_id").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def pending_pages(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned pages that no done one has the keys of: what a resumed download goes on with."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def backoff_seconds(attempt: int, retry_after: float | None = None, most: float = 30.0) -> float:
    """How long to wait before a further attempt: what the server says, else half a second doubled each time, up to `most`."""
    return float(retry_after) if retry_after is not None else min(most, 0.5 * 2**attempt)


def scope_filter(scope: str, field_ids: list = (), subfield_ids: list = ()):
    """The condition on topics that counts are grouped under: scope is all, field or subfield."""
    if scope not in ("all", "field", "subfield"):
        raise ValueError(f"scope must be all, field or subfield: {scope}")
    if scope == "field" and field_ids:
        return F.col("field_name").isin(list(field_ids))
    if scope == "subfield" and subfield_ids:
        return F.col("subfield_id").isin(list(subfield_ids))
    return F.lit(True)


def collect_counts(monthly: DataFrame, topics: DataFrame, date_from: str, date_to: str, scope: str = "all", field_ids: list = (), subfield_ids: list = ()) -> DataFrame:
    """(topic_id, period_start, works_count) of the months and topics in scope: what a statistics run stores; empty months have no row."""
    t = topics.filter(scope_filter(scope, field_ids, subfield_ids)).select(F.col("id").alias("topic_id"))
    m = monthly.filter(F.col("period_start").between(F.trunc(F.to_date(F.lit(date_from)), "MM"), F.to_date(F.lit(date_to))))
    return m.join(t, "topic_id", "left_semi").select("topic_id", "period_start", "works_count")


def entity_rows(topics: DataFrame, keywords: DataFrame, links: DataFrame, papers: DataFrame, as_of: str) -> DataFrame:
    """(point_id, entity_type, name, text, paper_count, recent_count) of domains, fields, subfields, topics and keywords.

    text is the name under those of the levels above it. Topics alone have counts: of papers, and of those of the last 365 days.
    """
    p = papers.select(F.col("id").alias("paper_id"), "publication_date")
    day = F.to_date(F.lit(as_of))
    n = links.join(p, "paper_id").groupBy("topic_id").agg(F.count("*").alias("paper_count"), F.count(F.when(F.col("publication_date").between(F.date_sub(day, 365), day), 1)).alias("recent_count"))
    none = F.lit(None).cast("bigint")

    def level(kind: str, point, name: str, above: list[str]) -> DataFrame:
        x = topics.select(point.alias("point_id"), F.col(name).alias("name"), F.concat_ws(" > ", *above, name).alias("text")).filter("name is not null").groupBy("point_id").agg(F.min("name").alias("name"), F.min("text").alias("text"))
        return x.select("point_id", F.lit(kind).alias("entity_type"), "name", "text", none.alias("paper_count"), none.alias("recent_count"))

    out = level("domain", F.concat(F.lit("domain:"), F.col("domain_name")), "domain_name", [])
    out = out.unionByName(level("field", F.concat(F.lit("field:"), F.col("field_name")), "field_name", ["domain_name"]))
    out = out.unionByName(level("subfield", F.concat(F.lit("subfield:"), F.col("subfield_id").cast("string")), "subfield_name", ["domain_name", "field_name"]))
    t = topics.join(n, topics["id"] == n["topic_id"], "left").select(F.concat(F.lit("topic:"), F.col("id").cast("string")).alias("point_id"), F.lit("topic").alias("entity_type"), "name", F.concat_ws(" > ", "domain_name", "field_name", "subfield_name", "name").alias("text"), F.coalesce("paper_count", F.lit(0)).alias("paper_count"), F.coalesce("recent_count", F.lit(0)).alias("recent_count"))
    k = keywords.select("keyword").distinct().select(F.concat(F.lit("keyword:"), F.col("keyword")).alias("point_id"), F.lit("keyword").alias("entity_type"), F.col("keyword").alias("name"), F.col("keyword").alias("text"), none.alias("paper_count"), none.alias("recent_count"))
    return out.unionByName(t).unionByName(k)


def entities_due(rows: DataFrame, stored: DataFrame, force: bool = False, entity_type: str | None = None) -> DataFrame:
    """Entities to index: those without a point (point_id) yet, or all if forced, of one type if it is given."""
    x = rows if entity_type is None else rows.filter(F.col("entity_type") == entity_type)
    return x if force else x.join(stored.select("point_id"), "point_id", "left_anti")


def request_status(ids: DataFrame, papers: DataFrame, done) -> DataFrame:
    """(id, status) of the ids asked for: missing without a row in papers, skipped where done (a condition on it) holds, else ready."""
    p = papers.select("id", F.coalesce(done, F.lit(False)).alias("_done"))
    x = ids.select("id").distinct().join(p, "id", "left")
    return x.select("id", F.when(F.col("_done").isNull(), "missing").when(F.col("_done"), "skipped").otherwise("ready").alias("status"))


def normalize_works(raw: DataFrame, column: str = "raw") -> dict[str, DataFrame]:
    """JSON work records as flat tables papers, authors, institutions, topics, keywords, landings and their links; text that can't be read is left out.

    The abstract is put together from its inverted index; of landings the best comes from the primary location; the first
    of an author's institutions with one id, ror or name counts.
    """
    from ..functions.text import inverted_index_text, last_segment, normalize_doi, whitespace

    w = raw.select(F.from_json(column, WORK).alias("w")).filter("w.id is not null").select("w.*")
    key = last_segment(F.col("id")).alias("paper_key")
    papers = w.select(key, normalize_doi(F.col("doi")).alias("doi"), whitespace(F.coalesce("title", "display_name")).alias("title"), F.coalesce("publication_year", F.year("publication_date")).alias("publication_year"), "publication_date", "language", inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"), F.col("open_access.is_oa").alias("is_open_access"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.coalesce("referenced_works_count", F.lit(0)).alias("references_count"))
    a = w.select(key, F.posexplode("authorships").alias("pos", "a")).filter("a is not null")
    who = F.coalesce(last_segment(F.col("a.author.id")), F.lower(F.trim("a.author.display_name")))
    authors = a.select("paper_key", who.alias("author_key"), F.trim("a.author.display_name").alias("display_name"), F.col("a.author.orcid").alias("orcid"), (F.col("pos") + 1).alias("author_order"), F.col("a.is_corresponding").alias("is_corresponding"))
    i = a.select("paper_key", who.alias("author_key"), F.posexplode("a.institutions").alias("ipos", "i")).filter("i is not null")
    ikey = F.coalesce(last_segment(F.col("i.id")), F.col("i.ror"), F.lower(F.trim("i.display_name")))
    institutions = i.select("paper_key", "author_key", ikey.alias("institution_key"), "ipos", "i.*").filter("institution_key is not null")
    institutions = institutions.groupBy("paper_key", "author_key", "institution_key").agg(F.min_by(F.struct("display_name", "ror", "country_code", "type"), F.col("ipos")).alias("x")).select("paper_key", "author_key", "institution_key", "x.*")
    topics = w.select(key, F.explode("topics").alias("t")).select("paper_key", last_segment(F.col("t.id")).alias("topic_key"), F.col("t.display_name").alias("name"), "t.score", F.col("t.subfield.display_name").alias("subfield"), F.col("t.field.display_name").alias("field"), F.col("t.domain.display_name").alias("domain"))
    keywords = w.select(key, F.explode("keywords").alias("k")).select("paper_key", F.lower(F.trim("k.display_name")).alias("keyword"), "k.score").filter("keyword <> ''")
    places = F.concat(F.array(F.struct(F.lit(True).alias("is_best"), F.col("primary_location").alias("l"))), F.coalesce(F.transform("locations", lambda x: F.struct(F.lit(False).alias("is_best"), x.alias("l"))), F.array().cast("array<struct<is_best:boolean,l:struct<landing_page_url:string,pdf_url:string,license:string,version:string>>>")))
    l = w.select(key, F.posexplode(places).alias("pos", "p")).select("paper_key", "pos", F.coalesce("p.l.landing_page_url", "p.l.pdf_url").alias("landing_url"), "p.is_best", "p.l.pdf_url", "p.l.license", "p.l.version").filter("landing_url is not null")  # noqa: E741
    landings = l.groupBy("paper_key", "landing_url").agg(F.min_by(F.struct("is_best", "pdf_url", "license", "version"), F.col("pos")).alias("x")).select("paper_key", "landing_url", "x.*")
    return {"papers": papers, "authors": authors, "institutions": institutions, "topics": topics, "keywords": keywords, "landings": landings}
