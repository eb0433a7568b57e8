"""Topic clusters: metrics, centroids, representatives, keywords, and their dynamics over periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, vectors
from ..functions.dates import windows


def metrics(papers: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """Windows of 30 and 90 days of each topic up to as_of, growth, acceleration, trend score and status, in one aggregation.

    Current windows are a day longer than the ones before them. Undated papers aren't counted.
    """
    t = F.to_date(F.lit(as_of))
    p = papers.filter("publication_date is not null").select(F.col("id").alias("paper_id"), "publication_date", F.coalesce("cited_by_count", F.lit(0)).alias("cited"))
    x = links.select("topic_id", "paper_id").join(p, "paper_id")
    n = lambda lo, hi: F.count(F.when(F.col("publication_date").between(F.date_sub(t, lo), F.date_sub(t, hi)), 1))
    g = x.groupBy("topic_id").agg(
        F.count("*").alias("paper_count"), n(30, 0).alias("n30"), n(60, 31).alias("p30"), n(90, 0).alias("n90"), n(180, 91).alias("p90"),
        F.min("publication_date").alias("first_date"), F.sum("cited").cast("bigint").alias("citations"),
    )
    g = g.withColumn("growth_30d", scoring.growth_rate(F.col("n30"), F.col("p30"))).withColumn("growth_90d", scoring.growth_rate(F.col("n90"), F.col("p90")))
    g = g.withColumn("acceleration", F.col("growth_30d") - F.col("growth_90d")).withColumn("trend_score", scoring.trend_score(F.col("growth_90d"), F.col("n90"), F.col("acceleration")))
    age = F.floor(F.datediff(t, F.col("first_date")) / 30) + 1
    return g.withColumn("status", scoring.trend_status(age, F.col("n90"), F.col("growth_90d"))).drop("first_date")


def representatives(vecs: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k vectors of each group nearest to its centroid: keys, paper_id, similarity, r."""
    c = vectors.mean_by(vecs, keys, "vector")
    x = vecs.join(c.select(*keys, "centroid"), keys).withColumn("similarity", F.round(vectors.cosine(F.col("vector"), F.col("centroid")), 6))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), "paper_id"))
    return x.withColumn("r", r).filter(F.col("r") <= k).select(*keys, "paper_id", "similarity", "r")


def top_keywords(keywords: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent keywords of each topic, ties in alphabetical order."""
    n = links.select("topic_id", "paper_id").join(keywords, "paper_id").groupBy("topic_id", "keyword").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("n"), "keyword"))
    return n.withColumn("r", r).filter(F.col("r") <= k)


def period_dynamics(papers: DataFrame, links: DataFrame, topic_ids: list[int] | None, start: str, end: str, granularity: str) -> DataFrame:
    """Counts, previous counts, growth and trend of each topic (of topic_ids, or all for None) and window of start..end.

    A window's own count is cut to start..end; the count of the window before the first one isn't cut.
    """
    spark = papers.sparkSession
    w = windows(spark, start, end, granularity)
    step = F.date_sub("window_start", 7) if granularity == "week" else F.add_months("window_start", -1)
    from ..functions.dates import period_start

    links = links.filter("topic_id is not null" if topic_ids is None else F.col("topic_id").isin(topic_ids))
    x = links.join(papers.select(F.col("id").alias("paper_id"), "publication_date").filter("publication_date is not null"), "paper_id")
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    n = x.groupBy("topic_id", period_start(F.col("publication_date"), granularity).alias("p")).agg(
        F.count(F.when(F.col("publication_date").between(a, b), 1)).alias("inside"), F.count(F.when(F.col("publication_date") <= b, 1)).alias("whole")
    )
    grid = n.select("topic_id").distinct().crossJoin(F.broadcast(w.withColumn("before", step)))  # a bounded calendar
    y = grid.join(n.select("topic_id", F.col("p").alias("window_start"), "inside"), ["topic_id", "window_start"], "left")
    y = y.join(n.select("topic_id", F.col("p").alias("before"), "whole"), ["topic_id", "before"], "left")
    cur, prev = F.coalesce("inside", F.lit(0)), F.coalesce("whole", F.lit(0))
    y = y.select("topic_id", F.col("effective_from").alias("period_start"), F.col("effective_to").alias("period_end"), cur.alias("paper_count"), prev.alias("previous_paper_count"))
    g = scoring.growth_rate(F.col("paper_count"), F.col("previous_paper_count"))
    return y.withColumn("growth_rate", g).withColumn("trend_score", scoring.trend_score(g, F.col("paper_count"), F.lit(0.0)))


def period_drift(vecs: DataFrame, start: str, end: str, granularity: str) -> DataFrame:
    """(topic_id, window_start, n_vectors, drift) of windows with vectors; drift is null after a window without any."""
    from ..functions.dates import period_start

    x = vecs.filter(F.col("publication_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).withColumn("window_start", period_start(F.col("publication_date"), granularity))
    c = vectors.mean_by(x, ["topic_id", "window_start"], "vector")
    w = Window.partitionBy("topic_id").orderBy("window_start")
    gap = F.date_add(F.lag("window_start").over(w), 7) if granularity == "week" else F.add_months(F.lag("window_start").over(w), 1)
    d = F.when(gap == F.col("window_start"), vectors.drift(F.col("centroid"), F.lag("centroid").over(w)))
    return c.select("topic_id", "window_start", F.col("n").alias("n_vectors"), d.alias("drift"))
