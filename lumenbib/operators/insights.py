"""Topic insights: dense monthly shares, keyphrase novelty, semantic drift, related topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.dates import months

WINDOWS = (6, 12, 24)


def _date(s: str):
    return F.to_date(F.lit(s))


def monthly_series(monthly: DataFrame, topics: DataFrame, topic_ids: list[int] | None, start: str, end: str) -> DataFrame:
    """(topic_id, period_start, topic_count, subfield_count, share, is_observed) for every month of start..end.

    subfield_count takes in the topic itself; a month counts as observed if its subfield had any row. Months are
    compared with start and end as they stand, so a start within a month leaves out that month's row.
    """
    t = topics.select(F.col("id").alias("topic_id"), "subfield_id")
    m = monthly.filter(F.col("period_start").between(_date(start), _date(end))).join(t, "topic_id")
    m = m.groupBy("subfield_id", "topic_id", "period_start").agg(F.sum("works_count").alias("topic_count"))
    by_sub = m.groupBy("subfield_id", "period_start").agg(F.sum("topic_count").alias("subfield_count"))
    wanted = t if topic_ids is None else t.filter(F.col("topic_id").isin(topic_ids))
    grid = wanted.crossJoin(F.broadcast(months(monthly.sparkSession, start, end).select("period_start")))  # months: a bounded calendar
    x = grid.join(by_sub, ["subfield_id", "period_start"], "left").join(m.drop("subfield_id"), ["topic_id", "period_start"], "left")
    tc, sc = F.coalesce("topic_count", F.lit(0)).cast("bigint"), F.coalesce("subfield_count", F.lit(0)).cast("bigint")
    return x.select("topic_id", "period_start", tc.alias("topic_count"), sc.alias("subfield_count"), F.when(sc > 0, tc / sc).otherwise(0.0).alias("share"), F.col("subfield_count").isNotNull().alias("is_observed"))


def novelty(keywords: DataFrame, links: DataFrame, papers: DataFrame, end: str, window_months: int, topic_ids: list[int] | None = None) -> DataFrame:
    """(topic_id, current_n, new_n, novelty): share of the current window's keyphrases that the window before it lacks.

    current = [end - (w-1) months, end], previous = [end - (2w-1) months, end - w months]; days between the two are in
    neither. No current keyphrases: null.
    """
    if window_months not in WINDOWS:
        raise ValueError(f"window_months must be one of {WINDOWS}")
    e, w = _date(end), window_months
    cs, pe, ps = F.add_months(e, -(w - 1)), F.add_months(e, -w), F.add_months(e, -(2 * w - 1))
    flag = F.when(F.col("publication_date").between(cs, e), 1).when(F.col("publication_date").between(ps, pe), 2)
    p = papers.select(F.col("id").alias("paper_id"), flag.alias("win")).filter("win is not null")
    t = links if topic_ids is None else links.filter(F.col("topic_id").isin(topic_ids))
    x = t.select("topic_id", "paper_id").join(p, "paper_id").join(keywords, "paper_id")
    k = x.groupBy("topic_id", "keyword").agg(F.max(F.col("win") == 1).alias("cur"), F.max(F.col("win") == 2).alias("prev"))
    g = k.groupBy("topic_id").agg(F.count(F.when(F.col("cur"), 1)).alias("current_n"), F.count(F.when(F.col("cur") & ~F.col("prev"), 1)).alias("new_n"))
    return g.withColumn("novelty", F.try_divide("new_n", "current_n"))


def decomposition_level(x):
    """high, medium or low; null for null."""
    return F.when(x.isNull(), None).when(x >= 0.66, "high").when(x >= 0.33, "medium").otherwise("low")


def same_subfield(monthly: DataFrame, topics: DataFrame, topic_id: int, end: str, limit: int) -> DataFrame:
    """Sibling topics by works of the last twelve months."""
    sub = topics.filter(F.col("id") == topic_id).select("subfield_id")
    sib = topics.join(F.broadcast(sub), "subfield_id", "left_semi").filter(F.col("id") != topic_id).select(F.col("id").alias("topic_id"), "name")
    m = monthly.filter(F.col("period_start").between(F.add_months(_date(end), -11), _date(end))).groupBy("topic_id").agg(F.sum("works_count").cast("bigint").alias("works"))
    return sib.join(m, "topic_id", "left").select("topic_id", "name", F.coalesce("works", F.lit(0)).alias("works")).orderBy(F.desc("works"), "name", "topic_id").limit(limit)


def shared_keyphrases(keywords: DataFrame, links: DataFrame, papers: DataFrame, topics: DataFrame, topic_id: int, start: str, end: str, limit: int) -> DataFrame:
    """Other topics whose papers of the period share keyphrases with the topic's: distinct keyphrases and papers, citations of those papers, eight keyphrases."""
    p = papers.filter(F.col("publication_date").between(_date(start), _date(end))).select(F.col("id").alias("paper_id"), F.coalesce("cited_by_count", F.lit(0)).alias("cited"))
    x = links.select("topic_id", "paper_id").join(p, "paper_id")
    mine = x.filter(F.col("topic_id") == topic_id).select("paper_id").join(keywords, "paper_id").select("keyword").distinct()
    hits = keywords.join(mine, "keyword", "left_semi").join(x.filter(F.col("topic_id") != topic_id), "paper_id")
    papers_of = hits.select("topic_id", "paper_id", "cited").distinct().groupBy("topic_id").agg(F.count("*").alias("shared_papers"), F.sum("cited").cast("bigint").alias("citations"))
    words = hits.select("topic_id", "keyword").distinct()
    r = F.row_number().over(Window.partitionBy("topic_id").orderBy("keyword"))
    eight = words.withColumn("r", r).filter("r <= 8").groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), "|").alias("keyphrases"))
    n = words.groupBy("topic_id").agg(F.count("*").alias("shared_keyphrases"))
    y = papers_of.join(n, "topic_id").join(eight, "topic_id").join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id")
    y = y.select("topic_id", "name", "shared_keyphrases", "shared_papers", "citations", "keyphrases", F.least(F.lit(1.0), F.col("shared_keyphrases") / 10).alias("similarity"))
    return y.orderBy(F.desc("shared_keyphrases"), F.desc("shared_papers"), "name", "topic_id").limit(limit)


def embedding_related(centroids: DataFrame, topic_id: int, limit: int) -> DataFrame:
    """Topics by cosine to the topic's vector; none if it has no vector."""
    me = centroids.filter(F.col("topic_id") == topic_id).select(F.col("centroid").alias("me"))
    x = centroids.filter(F.col("topic_id") != topic_id).crossJoin(F.broadcast(me))  # me is at most one row
    return x.select("topic_id", F.round(vectors.cosine(F.col("centroid"), F.col("me")), 6).alias("similarity")).orderBy(F.desc("similarity"), "topic_id").limit(limit)


def merge_related(same: DataFrame, shared: DataFrame, embedded: DataFrame, limit: int) -> DataFrame:
    """One list: same-subfield topics first, replaced in place by shared-keyphrase ones, these by embedded ones only of greater similarity."""
    # each list holds at most its limit of rows
    def part(df: DataFrame, rank: int, order: list) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy(F.lit(rank)).orderBy(*order))
        sim = F.col("similarity") if "similarity" in df.columns else F.lit(None).cast("double")
        return df.select("topic_id", F.lit(rank).alias("source"), pos.alias("pos"), sim.alias("similarity"))

    a = part(same, 0, [F.desc("works"), "name", "topic_id"])
    b = part(shared, 1, [F.desc("shared_keyphrases"), F.desc("shared_papers"), "name", "topic_id"])
    c = part(embedded, 2, [F.desc("similarity"), "topic_id"])
    x = a.unionByName(b).unionByName(c)
    g = x.groupBy("topic_id").agg(
        F.min(F.struct("source", "pos")).alias("first"),
        F.max(F.when(F.col("source") < 2, F.struct("source", F.coalesce("similarity", F.lit(0.0)).alias("s")))).alias("base"),
        F.max(F.when(F.col("source") == 2, F.col("similarity"))).alias("emb"),
    )
    takes = F.col("emb").isNotNull() & (F.col("base").isNull() | (F.col("emb") > F.col("base.s")))
    names = F.when(takes, "embedding").when(F.col("base.source") == 1, "shared_keyphrase").otherwise("same_subfield")
    return g.select("topic_id", names.alias("source"), F.when(takes, F.col("emb")).otherwise(F.col("base.s")).alias("similarity"), "first").orderBy("first").limit(limit).drop("first")
