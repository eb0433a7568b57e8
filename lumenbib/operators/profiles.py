"""User profiles and paper recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, vectors

#: Weights of what a profile is made of (fixed values).
SOURCES = {"favourite": 0.45, "topic": 0.25, "field": 0.10, "subfield": 0.15, "keyword": 0.10, "domain": 0.05}


def profile_vectors(sources: DataFrame) -> DataFrame:
    """sources (user_id, category, vector) -> (user_id, profile, n): weighted means, a category's weight shared among its vectors.

    Weights are taken anew over the categories a user has. Unknown categories are left out; a user without vectors has no row.
    """
    w = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in SOURCES.items()])
    s = sources.withColumn("w", w).filter("w is not null and vector is not null")
    n = s.groupBy("user_id", "category").agg(F.count("*").alias("c"))
    x = s.join(n, ["user_id", "category"]).withColumn("w", F.col("w") / F.col("c"))
    return vectors.mean_by(x, ["user_id"], "vector", F.col("w"), "profile")


def source_counts(sources: DataFrame) -> DataFrame:
    """(user_id, counts): a map of how many vectors each category gave, those of none left out."""
    n = sources.filter("vector is not null").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))


def profile_points(profiles: DataFrame, counts: DataFrame) -> DataFrame:
    """(point_id, vector, payload) of profiles, as a vector collection stores them: `user:<id>`, with the counts of what they are made of."""
    x = profiles.join(counts, "user_id", "left")
    payload = F.to_json(F.struct(F.col("user_id"), F.size("profile").alias("vector_size"), F.col("counts").alias("source_counts")), {"ignoreNullFields": "true"})
    return x.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("point_id"), F.col("profile").alias("vector"), payload.alias("payload"))


def candidates(profile: DataFrame, vecs: DataFrame, limit: int) -> DataFrame:
    """The min(max(3 limit, limit), 100) nearest papers of one user's profile."""
    one = profile.limit(1).select("profile")
    x = vecs.crossJoin(F.broadcast(one))  # one row
    x = x.select("paper_id", vectors.cosine(F.col("vector"), F.col("profile")).alias("semantic"))
    return x.orderBy(F.round("semantic", 9).desc(), "paper_id").limit(min(max(3 * limit, limit), 100))


def scored(cands: DataFrame, papers: DataFrame, paper_trends: DataFrame, as_of: str, tags: DataFrame | None = None) -> DataFrame:
    """Candidates (paper_id, semantic) with their score; trends (paper_id, trend) and tag scores (paper_id, tag) where they exist."""
    p = papers.select(F.col("id").alias("paper_id"), "title", "publication_date", "cited_by_count")
    x = cands.join(p, "paper_id").join(paper_trends, "paper_id", "left")
    tag = None
    if tags is not None:
        x, tag = x.join(tags, "paper_id", "left"), F.col("tag")
    day = F.to_date(F.lit(as_of))
    s = scoring.recommendation_score(F.col("semantic"), F.coalesce("trend", F.lit(0.0)), scoring.recency_score(F.col("publication_date"), day), scoring.citation_score(F.col("cited_by_count")), tag)
    return x.withColumn("score", F.round(s, 6))


def paper_trends(links: DataFrame, trends: DataFrame) -> DataFrame:
    """(paper_id, trend): the greatest trend score of a paper's topics."""
    return links.select("paper_id", "topic_id").join(trends.select("topic_id", "trend_score"), "topic_id").groupBy("paper_id").agg(F.max("trend_score").alias("trend"))


def tag_scores(links: DataFrame, topics: DataFrame, chosen: dict[str, list[int] | list[str]]) -> DataFrame:
    """(paper_id, tag): how close each paper's topics come to the levels chosen."""
    t = topics.select(F.col("id").alias("topic_id"), "subfield_id", "field_name", "domain_name")
    tests = {"topics": F.col("topic_id"), "subfields": F.col("subfield_id"), "fields": F.col("field_name"), "domains": F.col("domain_name")}
    best = F.greatest(F.lit(0.0), *[F.when(tests[k].isin(list(v)), F.lit(scoring.TAG_LEVELS[k])).otherwise(F.lit(0.0)) for k, v in chosen.items() if v])
    return links.select("paper_id", "topic_id").join(t, "topic_id").groupBy("paper_id").agg(F.max(best).alias("tag"))
