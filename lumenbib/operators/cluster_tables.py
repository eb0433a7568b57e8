"""Topic clusters put together, over all topics at once: the clusters themselves, their periods, and what is read from both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, vectors
from ..functions.dates import period_start, windows
from . import clusters as C

#: Fewest vectors that make a cluster (fixed value).
LEAST_VECTORS = 2


def topic_vectors(vecs: DataFrame, links: DataFrame) -> DataFrame:
    """(topic_id, paper_id, publication_date, vector): vectors of the papers linked to each topic, not of its primary ones only."""
    return links.select("topic_id", "paper_id").join(vecs.select("paper_id", "publication_date", "vector"), "paper_id").select("topic_id", "paper_id", "publication_date", "vector")


def _listed(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the values in the order of r; at most as many as the top k that df holds."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias(name))


def recompute_clusters(
    topics: DataFrame,
    papers: DataFrame,
    links: DataFrame,
    vecs: DataFrame,
    keywords: DataFrame,
    as_of: str,
    previous: DataFrame | None = None,
    force_summary: bool = False,
    summarize: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """A row per topic: cluster_key, name, outcome (ok, or skipped with fewer than two vectors), vectors, centroid, metrics, citations and their mean,
    top keywords, representative papers and a summary.

    The summary of previous (cluster_key, summary) is kept unless forced; a new one is made by summarize(name, titles,
    keywords), a column expression. Clusters that are skipped have no more than their counts.
    """
    v = topic_vectors(vecs, links)
    cent = vectors.mean_by(v, ["topic_id"], "vector").select("topic_id", "centroid", F.col("n").alias("n_vectors"))
    reps = C.representatives(v, ["topic_id"])
    titles = _listed(reps.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id"), ["topic_id"], "title", "titles")
    m = C.metrics(papers, links, as_of)
    x = topics.select(F.col("id").alias("topic_id"), "name").join(cent, "topic_id", "left").join(m, "topic_id", "left")
    x = x.join(_listed(C.top_keywords(keywords, links), ["topic_id"], "keyword", "top_keywords"), "topic_id", "left")
    x = x.join(_listed(reps, ["topic_id"], "paper_id", "representatives"), "topic_id", "left").join(titles, "topic_id", "left")
    ok = F.coalesce(F.col("n_vectors"), F.lit(0)) >= LEAST_VECTORS
    x = x.withColumn("cluster_key", F.concat(F.lit("topic:"), F.col("topic_id").cast("string"))).withColumn("outcome", F.when(ok, "ok").otherwise("skipped"))
    x = x.withColumn("avg_citations", F.try_divide("citations", "paper_count"))
    if summarize is None:
        from ..api import cluster_summary as summarize
    none = F.array().cast("array<string>")
    fresh = summarize(F.col("name"), F.coalesce("titles", none), F.coalesce("top_keywords", none))
    if previous is not None and not force_summary:
        x = x.join(previous.select("cluster_key", F.col("summary").alias("_old")), "cluster_key", "left")
        fresh = F.coalesce(F.nullif(F.trim("_old"), F.lit("")), fresh)
    keep = lambda c: F.when(ok, F.col(c)).alias(c)
    return x.select(
        "cluster_key", "topic_id", "name", "outcome", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.coalesce("paper_count", F.lit(0)).alias("paper_count"),
        *[keep(c) for c in ("centroid", "n30", "p30", "n90", "p90", "growth_30d", "growth_90d", "acceleration", "trend_score", "status", "citations", "avg_citations", "top_keywords", "representatives")],
        F.when(ok, fresh).alias("summary"),
    )


def outcomes(table: DataFrame) -> DataFrame:
    """(outcome, n): how many clusters were made and how many skipped."""
    return table.groupBy("outcome").agg(F.count("*").alias("n"))


def in_turn(topics: DataFrame, growth: DataFrame | None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(id, name) of the topics to recompute: by growth (topic_id, growth, current_count) if it is given, else by name."""
    if growth is not None:
        x = topics.select("id", "name").join(growth.select(F.col("topic_id").alias("id"), "growth", "current_count"), "id")
        order = [F.desc("growth"), F.desc("current_count"), F.col("id")]
    else:
        x, order = topics.select("id", "name"), [F.col("name"), F.col("id")]
    if limit is None:
        return x.select("id", "name")
    return x.orderBy(*order).offset(offset).limit(limit).select("id", "name")


def get_cluster(stored: DataFrame, cached: DataFrame, cluster_key: str) -> DataFrame:
    """The stored row of a cluster, or the cached one if there is none; both have the same columns."""
    both = stored.filter(F.col("cluster_key") == cluster_key).withColumn("_o", F.lit(0)).unionByName(cached.filter(F.col("cluster_key") == cluster_key).withColumn("_o", F.lit(1)))
    return both.orderBy("_o").limit(1).drop("_o")


def top_clusters(table: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    """The clusters of highest trend score (null counts as 0), of one status if it is given."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    x = table if status is None else table.filter(F.col("status") == status)
    return x.orderBy(F.coalesce("trend_score", F.lit(0.0)).desc(), "topic_id").limit(limit)


def period_keywords(links: DataFrame, papers: DataFrame, keywords: DataFrame, w: DataFrame, granularity: str, k: int = 10) -> DataFrame:
    """(topic_id, window_start, keyword, n, r): the k foremost keywords of each window, ties in alphabetical order. w is a bounded calendar."""
    p = papers.filter("publication_date is not null").select(F.col("id").alias("paper_id"), "publication_date", period_start(F.col("publication_date"), granularity).alias("window_start"))
    p = p.join(F.broadcast(w), "window_start").filter(F.col("publication_date").between(F.col("effective_from"), F.col("effective_to"))).select("paper_id", "window_start")
    n = links.select("topic_id", "paper_id").join(p, "paper_id").join(keywords, "paper_id").groupBy("topic_id", "window_start", "keyword").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("topic_id", "window_start").orderBy(F.desc("n"), "keyword"))
    return n.withColumn("r", r).filter(F.col("r") <= k)


def recompute_periods(papers: DataFrame, links: DataFrame, vecs: DataFrame, keywords: DataFrame, start: str, end: str, granularity: str, topic_ids: list[int] | None = None) -> DataFrame:
    """A row per topic and window with vectors: counts, growth, trend, vectors, drift, citations, foremost keywords and representatives.

    Windows without vectors are left out, and the drift after one is null. Keywords are those of the papers, in every
    window (not of the points' payloads, which would depend on the order in which windows are taken).
    """
    if topic_ids is not None:
        links = links.filter(F.col("topic_id").isin(topic_ids))
    w = windows(papers.sparkSession, start, end, granularity)
    d = C.period_dynamics(papers, links, None, start, end, granularity)
    v = topic_vectors(vecs, links).filter(F.col("publication_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    drift = C.period_drift(v, start, end, granularity)
    at = period_start(F.col("publication_date"), granularity).alias("window_start")
    v = v.select("topic_id", "paper_id", at, "vector")
    keys = ["topic_id", "window_start"]
    cited = papers.filter(F.col("publication_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).select(F.col("id").alias("paper_id"), at, F.coalesce("cited_by_count", F.lit(0)).alias("c"))
    cited = links.select("topic_id", "paper_id").join(cited, "paper_id").groupBy(*keys).agg(F.sum("c").cast("bigint").alias("citation_count_sum"))
    x = d.withColumn("window_start", period_start(F.col("period_start"), granularity)).join(drift, keys)
    x = x.join(cited, keys, "left").join(_listed(period_keywords(links, papers, keywords, w, granularity), keys, "keyword", "keywords"), keys, "left")
    x = x.join(_listed(C.representatives(v, keys), keys, "paper_id", "representatives"), keys, "left")
    none = F.array().cast("array<string>")
    return x.select(
        F.concat(F.lit("topic:"), F.col("topic_id").cast("string")).alias("cluster_key"), "topic_id", "period_start", "period_end", "paper_count", "previous_paper_count", "growth_rate", "trend_score",
        "n_vectors", F.col("drift").alias("semantic_drift"), F.coalesce("citation_count_sum", F.lit(0)).alias("citation_count_sum"), F.coalesce("keywords", none).alias("keywords"), "representatives",
    )


def periods_between(periods: DataFrame, date_from: str | None, date_to: str | None, cluster_key: str | None = None) -> DataFrame:
    """Periods that lie within the bounds as a whole, of one cluster if it is given, in order of their start."""
    x = periods if cluster_key is None else periods.filter(F.col("cluster_key") == cluster_key)
    if date_from:
        x = x.filter(F.col("period_start") >= F.to_date(F.lit(date_from)))
    if date_to:
        x = x.filter(F.col("period_end") <= F.to_date(F.lit(date_to)))
    return x.orderBy("cluster_key", "period_start")


def clusters_from_periods(periods: DataFrame) -> DataFrame:
    """(cluster_key, paper_count, previous_paper_count, growth_rate) summed over the periods given."""
    g = periods.groupBy("cluster_key").agg(F.sum(F.coalesce("paper_count", F.lit(0))).cast("bigint").alias("paper_count"), F.sum(F.coalesce("previous_paper_count", F.lit(0))).cast("bigint").alias("previous_paper_count"))
    return g.withColumn("growth_rate", scoring.growth_rate(F.col("paper_count"), F.col("previous_paper_count")))


def quarter_metrics(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, growth, trend (weighted by papers; the plain mean where all weights are 0), mean drift and citations per paper of the periods of each key."""
    n = F.greatest(F.coalesce("paper_count", F.lit(0)), F.lit(0))
    t = F.col("trend_score").isNotNull()
    g = periods.groupBy(*keys).agg(
        F.sum(F.coalesce("paper_count", F.lit(0))).cast("bigint").alias("paper_count"), F.sum(F.coalesce("previous_paper_count", F.lit(0))).cast("bigint").alias("previous_paper_count"),
        F.sum(F.when(t, n * F.col("trend_score"))).alias("_tw"), F.sum(F.when(t, n)).alias("_w"), F.avg("trend_score").alias("_plain"), F.avg("semantic_drift").alias("semantic_drift"),
        F.sum(F.coalesce("citation_count_sum", F.lit(0))).cast("bigint").alias("citation_count_sum"), F.count("*").alias("periods"),
    )
    trend = F.coalesce(F.try_divide("_tw", "_w"), F.col("_plain"))
    return g.select(*keys, "periods", "paper_count", "previous_paper_count", scoring.growth_rate(F.col("paper_count"), F.col("previous_paper_count")).alias("growth_rate"), trend.alias("trend_score"), "semantic_drift", "citation_count_sum", F.try_divide("citation_count_sum", "paper_count").alias("avg_cited_by_count"))


def sync(target: DataFrame, store: DataFrame, keys: list[str], policy: dict[str, str], prune: bool = False, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(target as it is to be, counters): rows of the store upserted, and those it lacks pruned if asked; a dry run changes nothing and counts all as skipped."""
    from .merge import merge, prune_missing

    if dry_run:
        return target, store.agg(F.count("*").alias("n")).select(F.lit("skipped").alias("change"), "n")
    x = merge(target, store, keys, policy)
    gone = x.filter("change = 'kept'").agg(F.count("*").alias("n")).select(F.lit("pruned").alias("change"), "n") if prune else None
    counts = x.groupBy("change").agg(F.count("*").alias("n"))
    if prune:
        counts = counts.filter("change <> 'kept'").unionByName(gone.filter("n > 0"))
        x = prune_missing(x, store, keys)
    return x.drop("change"), counts
