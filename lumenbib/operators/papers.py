"""Lookups, filters, counts and top-k over papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period_start

SMALL_LIST = 10_000


def _newest() -> list[Column]:
    return [F.col("publication_date").desc_nulls_last(), F.col("id").desc()]


def check_topic_match(value: str) -> str:
    if value not in ("soft", "strict"):
        raise ValueError(f"topic_match must be soft or strict: {value}")
    return value


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def one_by(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key; at most one, the smallest id, where the key isn't unique after all."""
    return df.filter(F.col(key) == value).orderBy("id").limit(1)


def list_ids(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the distinct values of key, in order."""
    return page(df.select(key).filter(F.col(key).isNotNull()).distinct(), [F.col(key)], limit, offset)


def topics_for_stats(topics: DataFrame, limit: int | None = None, offset: int = 0, fields: list[str] = (), subfield_ids: list[int] = ()) -> DataFrame:
    """Topics of the fields and subfields named, or all, in order of id, or a page of them."""
    x = topics
    if fields:
        x = x.filter(F.col("field_name").isin(list(fields)))
    if subfield_ids:
        x = x.filter(F.col("subfield_id").isin(list(subfield_ids)))
    return x if limit is None else page(x, [F.col("id")], limit, offset)


def count_topic_papers(df: DataFrame, links: DataFrame, date_from: str, date_to: str, topic_match: str = "soft") -> DataFrame:
    """(topic_id, n): distinct papers of each topic in the period."""
    x = in_period(topic_links(df, links, topic_match), date_from, date_to)
    return x.select("topic_id", "paper_id").distinct().groupBy("topic_id").agg(F.count("*").alias("n"))


def work_candidates(df: DataFrame, panel: str, date_from: str, date_to: str, topic_ids: list[int] | None = None) -> DataFrame:
    """Papers of the period (of primary topics named, or all) that a panel still has to do: indexing, or keyphrases."""
    todo = {"indexing": ~F.coalesce(F.col("is_indexed"), F.lit(False)), "keyphrases": F.coalesce(F.size("extracted_keywords") <= 0, F.lit(True))}
    if panel not in todo:
        raise ValueError(f"panel must be one of {sorted(todo)}: {panel}")
    x = in_period(df.filter(todo[panel]), date_from, date_to)
    return x if topic_ids is None else x.filter(F.col("primary_topic_id").isin(topic_ids))


def by_ids(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Rows with one of the ids, an IN list that reaches the scan; many ids are joined instead."""
    if len(ids) <= 100:
        return df.filter(F.col(key).isin(ids)) if ids else df.limit(0)
    wanted = df.sparkSession.createDataFrame([(i,) for i in set(ids)], f"{key} bigint")
    return df.join(F.broadcast(wanted) if len(ids) <= SMALL_LIST else wanted, key, "left_semi")


def in_order(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Rows with one of the ids in the caller's order, first occurrences only, with place from 0."""
    first = {v: i for i, v in reversed(list(enumerate(ids)))}
    wanted = df.sparkSession.createDataFrame(sorted(first.items(), key=lambda x: x[1]), f"{key} bigint, place int")
    return df.join(F.broadcast(wanted) if len(first) <= SMALL_LIST else wanted, key).orderBy("place")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.limit(0) if limit <= 0 else df.orderBy(*order).offset(offset).limit(limit)


def in_period(df: DataFrame, date_from: str | None, date_to: str | None, column: str = "publication_date") -> DataFrame:
    """Rows within the inclusive bounds that are given; a null date fails any bound."""
    if date_from:
        df = df.filter(F.col(column) >= F.to_date(F.lit(date_from)))
    if date_to:
        df = df.filter(F.col(column) <= F.to_date(F.lit(date_to)))
    return df


def of_topic(df: DataFrame, links: DataFrame, topic_id: int, topic_match: str) -> DataFrame:
    """soft: papers linked to the topic; strict: papers whose primary topic it is."""
    if check_topic_match(topic_match) == "strict":
        return df.filter(F.col("primary_topic_id") == topic_id)
    return df.join(links.filter(F.col("topic_id") == topic_id).select(F.col("paper_id").alias("id")), "id", "left_semi")


def of_taxonomy(links: DataFrame, topics: DataFrame, topic_ids: list[int] = (), subfield_ids: list[int] = (), fields: list[str] = (), domains: list[str] = ()) -> DataFrame | None:
    """Distinct paper ids linked to any topic, subfield, field or domain named; None without any."""
    tests = [c for c in (F.col("id").isin(list(topic_ids)) if topic_ids else None, F.col("subfield_id").isin(list(subfield_ids)) if subfield_ids else None, F.col("field_name").isin(list(fields)) if fields else None, F.col("domain_name").isin(list(domains)) if domains else None) if c is not None]
    if not tests:
        return None
    any_ = tests[0]
    for t in tests[1:]:
        any_ = any_ | t
    wanted = topics.filter(any_).select(F.col("id").alias("topic_id"))
    return links.join(wanted, "topic_id", "left_semi").select("paper_id").distinct()


def keyword_candidates(df: DataFrame, date_from: str | None, date_to: str | None, topic_papers: DataFrame | None = None, skip_processed: bool = True) -> DataFrame:
    """Papers to extract keywords from: in the period, without keywords yet if so asked, linked to the topics given."""
    x = in_period(df, date_from, date_to)
    if skip_processed:
        x = x.filter(F.col("extracted_keywords").isNull())
    return x if topic_papers is None else x.join(topic_papers.select(F.col("paper_id").alias("id")), "id", "left_semi")


def recent_indexed(df: DataFrame, date_from: str, limit: int, topic_papers: DataFrame | None = None) -> DataFrame:
    x = in_period(df.filter("is_indexed"), date_from, None)
    if topic_papers is not None:
        x = x.join(topic_papers.select(F.col("paper_id").alias("id")), "id", "left_semi")
    return page(x, _newest(), limit)


def list_by_period(df: DataFrame, date_from: str | None, date_to: str | None, limit: int, offset: int = 0, links: DataFrame | None = None, topic_id: int | None = None, topic_match: str = "soft") -> DataFrame:
    x = in_period(df, date_from, date_to)
    if topic_id is not None:
        x = of_topic(x, links, topic_id, topic_match)
    return page(x, _newest(), limit, offset)


def top_cited(df: DataFrame, links: DataFrame, topic_id: int, date_from: str, date_to: str, limit: int, topic_match: str = "soft") -> DataFrame:
    x = of_topic(in_period(df, date_from, date_to), links, topic_id, topic_match)
    return page(x, [F.col("cited_by_count").desc_nulls_last(), *_newest()], limit)


def topic_links(df: DataFrame, links: DataFrame, topic_match: str) -> DataFrame:
    """(topic_id, paper_id, publication_date) by either match."""
    if check_topic_match(topic_match) == "strict":
        return df.filter("primary_topic_id is not null").select(F.col("primary_topic_id").alias("topic_id"), F.col("id").alias("paper_id"), "publication_date")
    return links.select("topic_id", "paper_id").join(df.select(F.col("id").alias("paper_id"), "publication_date"), "paper_id").select("topic_id", "paper_id", "publication_date")


def period_counts(df: DataFrame, links: DataFrame, topic_ids: list[int], date_from: str, date_to: str, granularity: str, topic_match: str = "soft") -> DataFrame:
    """(topic_id, period_start, n): papers per topic and week or month, non-empty periods only."""
    x = in_period(topic_links(df, links.filter(F.col("topic_id").isin(topic_ids)), topic_match), date_from, date_to).filter(F.col("topic_id").isin(topic_ids))
    return x.groupBy("topic_id", period_start(F.col("publication_date"), granularity).alias("period_start")).agg(F.count("*").alias("n"))


def recent_growth(df: DataFrame, links: DataFrame, date_from: str, date_to: str, limit: int, topic_match: str = "soft") -> DataFrame:
    """Topics by growth of the window over the window of equal length before it, both counted in one pass.

    Topics without papers in the window are left out; without earlier papers growth is 0. Ties go by papers, then id.
    """
    a, b = F.to_date(F.lit(date_from)), F.to_date(F.lit(date_to))
    before = F.date_sub(a, F.datediff(b, a) + 1)
    x = topic_links(df, links, topic_match).filter((F.col("publication_date") >= before) & (F.col("publication_date") <= b))
    n = x.groupBy("topic_id").agg(F.count(F.when(F.col("publication_date") >= a, 1)).alias("current_count"), F.count(F.when(F.col("publication_date") < a, 1)).alias("previous_count"))
    g = n.filter("current_count > 0").withColumn("growth", F.coalesce(F.try_divide(F.col("current_count") - F.col("previous_count"), F.col("previous_count")), F.lit(0.0)))
    return g.orderBy(F.desc("growth"), F.desc("current_count"), "topic_id").limit(limit)
