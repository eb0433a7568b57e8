"""Entry points: what a service or a command line calls, as functions over one data directory."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, vectors
from .operators import cluster_tables, clusters, forecasting, insights, papers, profiles, quality
from .operators.requests import PaperRequest, matching_papers
from .sources import views as V
from .streaming import queue


class RequestError(ValueError):
    """A request that breaks its own rules."""


class NotEnoughData(LookupError):
    """A user without any vector to make a profile of."""


def topic_insights(spark: SparkSession, d: str, topic_id: int, start: str, end: str, window_months: int = 12, horizon: int = 6, max_related: int = 10) -> dict[str, DataFrame | list[str]]:
    """Sections activity, forecast, decomposition and related of one topic; a section that fails is left out and named in errors.

    Sections are a topic's worth of rows, so each is run here and kept: a failure at execution is one of its section only.
    """
    if date.fromisoformat(start) > date.fromisoformat(end):
        raise RequestError("the start lies after the end")
    if window_months not in insights.WINDOWS or horizon not in (6, 12) or not 1 <= max_related <= 50:
        raise RequestError("window_months, horizon or max_related is out of range")
    out: dict[str, DataFrame | list[str]] = {}
    errors: list[str] = []

    def section(name: str, make: Callable[[], DataFrame]) -> None:
        try:
            out[name] = spark.createDataFrame(x.collect(), x.schema) if (x := make()) is not None else None
        except Exception as e:  # noqa: BLE001 - one failing section must not fail the request
            errors.append(f"{name}: {type(e).__name__}")

    series = lambda: insights.monthly_series(V.monthly(spark, d), V.topics(spark, d), [topic_id], start, end)

    def forecasts() -> DataFrame:
        s = series().filter("is_observed")
        parts = [forecasting.forecast(s, "topic_id", "period_start", c, horizon, k).withColumn("kind", F.lit(k)) for c, k in (("topic_count", "count"), ("share", "share"))]
        return parts[0].unionByName(parts[1])

    def decomposition() -> DataFrame:
        n = insights.novelty(V.paper_keywords(spark, d), V.paper_topics(spark, d), V.papers(spark, d, "id", "publication_date"), end, window_months, [topic_id])
        drift = clusters.period_drift(V.paper_vectors(spark, d).filter(F.col("topic_id") == topic_id), start, end, "month").groupBy("topic_id").agg(F.avg("drift").alias("drift"))
        x = n.select("topic_id", "novelty").join(drift, "topic_id", "full_outer")
        norm = F.when(F.col("drift").isNotNull(), F.least(F.col("drift") / 0.30, F.lit(1.0)))
        return x.select("topic_id", "novelty", insights.decomposition_level(F.col("novelty")).alias("novelty_level"), "drift", insights.decomposition_level(norm).alias("drift_level"))

    def related() -> DataFrame:
        same = insights.same_subfield(V.monthly(spark, d), V.topics(spark, d), topic_id, end, max_related)
        shared = insights.shared_keyphrases(V.paper_keywords(spark, d), V.paper_topics(spark, d), V.papers(spark, d, "id", "publication_date", "cited_by_count"), V.topics(spark, d), topic_id, start, end, max_related)
        cent = vectors.mean_by(V.paper_vectors(spark, d).filter("topic_id is not null"), ["topic_id"], "vector")
        return insights.merge_related(same, shared, insights.embedding_related(cent, topic_id, max_related), max_related)

    for name, make in (("activity", series), ("forecast", forecasts), ("decomposition", decomposition), ("related", related)):
        section(name, make)
    out["errors"] = errors
    return out


def profile_sources(spark: SparkSession, d: str, users: list[int] | None = None) -> DataFrame:
    """(user_id, category, vector) of all six categories, for the users given or all."""
    v = V.paper_vectors(spark, d)
    only = lambda df: df if users is None else df.filter(F.col("user_id").isin(users))
    cent = vectors.mean_by(v.filter("topic_id is not null"), ["topic_id"], "vector")
    f = only(V.favourites(spark, d)).join(v.select("paper_id", "vector"), "paper_id").select("user_id", F.lit("favourite").alias("category"), "vector")
    t = only(V.tracked_topics(spark, d)).join(cent, "topic_id").select("user_id", F.lit("topic").alias("category"), F.col("centroid").alias("vector"))
    x = only(V.tracked_levels(spark, d)).join(V.level_vectors(spark, d), ["category", "key"]).select("user_id", "category", "vector")
    return f.unionByName(t).unionByName(x)


def user_profiles(spark: SparkSession, d: str, users: list[int] | None = None) -> DataFrame:
    """(user_id, profile, n) of the users given, or of all; users without vectors have no row."""
    return profiles.profile_vectors(profile_sources(spark, d, users))


def recompute_profile(spark: SparkSession, d: str, user_id: int) -> DataFrame:
    """(user_id, profile, n) of one user."""
    p = user_profiles(spark, d, [user_id])
    if p.isEmpty():
        raise NotEnoughData(f"user {user_id} has no favourite paper, topic, level or keyword with a vector")
    return p


def profile_points(spark: SparkSession, d: str, users: list[int] | None = None) -> DataFrame:
    """Points of the profiles with counts of their sources, to be upserted into a collection."""
    s = profile_sources(spark, d, users)
    return profiles.profile_points(profiles.profile_vectors(s), profiles.source_counts(s))


def recommend_papers(spark: SparkSession, d: str, user_id: int, as_of: str, limit: int = 20, request: PaperRequest = PaperRequest(), tags: dict | None = None) -> DataFrame:
    """Papers for a user by profile, or the trending ones if there is no profile; strategy says which.

    request: conditions that papers must fit, applied before the nearest are taken; tags: levels (topics, subfields,
    fields, domains) whose match enters the score.
    """
    links = V.paper_topics(spark, d)
    shown = V.papers(spark, d, "id", "title", "publication_date", "cited_by_count", "is_indexed", "language", "is_open_access")
    fits = matching_papers(shown, links, V.paper_keywords(spark, d), request)
    trends = profiles.paper_trends(links, clusters.metrics(shown, links, as_of))
    p = user_profiles(spark, d, [user_id])
    if p.isEmpty():
        since = request.date_from or str(date.fromisoformat(as_of).replace(day=1, year=date.fromisoformat(as_of).year - 3))
        recent = papers.in_period(fits.filter("is_indexed"), since, as_of)
        cands, strategy = recent.select(F.col("id").alias("paper_id"), F.lit(0.0).alias("semantic")), "trending_fallback"
    else:
        fav = V.favourites(spark, d).filter(F.col("user_id") == user_id).select("paper_id")
        vecs = V.paper_vectors(spark, d).join(fav, "paper_id", "left_anti")
        if request != PaperRequest():
            vecs = vecs.join(fits.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
        cands, strategy = profiles.candidates(p, vecs, limit), "profile"
    tag = profiles.tag_scores(links, V.topics(spark, d), tags) if tags else None
    x = profiles.scored(cands, shown, trends, as_of, tag).orderBy(F.desc("score"), "paper_id").limit(limit)
    return x.select("paper_id", "title", "score", F.lit(strategy).alias("strategy"))


def recompute_clusters(spark: SparkSession, d: str, as_of: str, previous: DataFrame | None = None, force_summary: bool = False) -> DataFrame:
    """All topic clusters of a data directory, to be written as a version of their table."""
    p = V.papers(spark, d, "id", "title", "publication_date", "cited_by_count")
    return cluster_tables.recompute_clusters(V.topics(spark, d), p, V.paper_topics(spark, d), V.paper_vectors(spark, d), V.paper_keywords(spark, d), as_of, previous, force_summary)


def recompute_periods(spark: SparkSession, d: str, start: str, end: str, granularity: str, topic_ids: list[int] | None = None) -> DataFrame:
    """The periods of all topic clusters, or of some, to be written as a version of their table."""
    p = V.papers(spark, d, "id", "publication_date", "cited_by_count")
    return cluster_tables.recompute_periods(p, V.paper_topics(spark, d), V.paper_vectors(spark, d), V.paper_keywords(spark, d), start, end, granularity, topic_ids)


def analyze_coverage(spark: SparkSession, d: str, date_from: str, date_to: str, periods: DataFrame | None = None, reports: DataFrame | None = None) -> dict[str, DataFrame]:
    """Coverage of all topics by statistics, sample papers, cluster periods and quarter reports, and a summary of the four."""
    t = V.topics(spark, d).select(F.col("id").alias("topic_id"))
    months, quarters = dates.months(spark, date_from, date_to), dates.quarters(spark, date_from, date_to)
    p = V.papers(spark, d, "primary_topic_id", "publication_date").select(F.col("primary_topic_id").alias("topic_id"), F.trunc("publication_date", "MM").alias("period_start"))
    parts = {"publication_stats": quality.coverage(t, months, V.monthly(spark, d)), "sample_papers": quality.coverage(t, months, p)}
    if periods is not None:
        parts["cluster_dynamics"] = quality.period_coverage(t, months, periods)
    if reports is not None:
        parts["quarter_reports"] = quality.key_coverage(t, quarters, reports)
    return {**parts, "summary": quality.coverage_summary(parts)}


def worker(spark: SparkSession, inbox: str, checkpoint: str, handlers: dict, out: str, **options):
    """Works off the messages in inbox and ends; see `streaming.queue.run_queue`."""
    return queue.run_queue(spark, inbox, checkpoint, handlers, out, **options).awaitTermination()


def cluster_summary(name: Column, titles: Column, keywords: Column, limit: int = 1400) -> Column:
    """The summary used where no text model is given: the name, foremost keywords and titles, cut to limit."""
    part = lambda label, a, n: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(F.slice(a, 1, n), ", "), F.lit(".")))
    return F.substring(F.concat_ws(" ", F.concat(name, F.lit(".")), part("Keywords: ", keywords, 10), part("Papers: ", titles, 3)), 1, limit)
