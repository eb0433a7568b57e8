"""Scores as column expressions: growth, trend, recency, citations, recommendation, status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights and bounds of the scores (fixed values).
TREND_WEIGHTS = {"growth": 0.60, "recent": 0.30, "acceleration": 0.10}
RECOMMEND_PLAIN = {"semantic": 0.55, "trend": 0.25, "recency": 0.15, "citation": 0.05}
RECOMMEND_TAGGED = {"semantic": 0.45, "tag": 0.25, "trend": 0.15, "recency": 0.10, "citation": 0.05}
TAG_LEVELS = {"topics": 1.0, "subfields": 0.70, "fields": 0.45, "domains": 0.25}
RECENCY_DAYS = 1825
CITATION_CAP = 1000


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def normalize(x: Column, lo: float, hi: float) -> Column:
    """Place of x between lo and hi, cut to [0, 1]; 0 for an empty range."""
    return clamp((x - lo) / (hi - lo)) if hi != lo else F.lit(0.0)


def growth_rate(current: Column, previous: Column) -> Column:
    """Smoothed growth (current + 1) / (previous + 1) - 1; null for a negative count."""
    return F.when((current >= 0) & (previous >= 0), (current + 1) / (previous + 1) - 1)


def ratio_growth(current: Column, previous: Column) -> Column:
    """Plain growth (current - previous) / previous; 0 without a previous count."""
    return F.coalesce((current - previous) / F.nullif(previous.cast("double"), F.lit(0.0)), F.lit(0.0))


def trend_score(growth: Column, recent: Column, acceleration: Column) -> Column:
    w = TREND_WEIGHTS
    return clamp(w["growth"] * normalize(growth, -1, 1) + w["recent"] * normalize(recent.cast("double"), 0, 100) + w["acceleration"] * normalize(acceleration, -1, 1))


def recency_score(published: Column, as_of: Column) -> Column:
    """1 up to the reference date, falling to 0 over five years; 0 for no date."""
    age = F.datediff(as_of, published)
    return F.when(published.isNull(), 0.0).when(age <= 0, 1.0).otherwise(clamp(1 - age / RECENCY_DAYS))


def citation_score(cited: Column) -> Column:
    return F.when(cited.isNull() | (cited <= 0), 0.0).otherwise(clamp(F.log1p(cited) / F.log1p(F.lit(float(CITATION_CAP)))))


def recommendation_score(semantic: Column, trend: Column, recency: Column, citation: Column, tag: Column | None = None) -> Column:
    """Weighted sum of clamped parts; with other weights where a tag score is given."""
    parts = {"semantic": semantic, "trend": trend, "recency": recency, "citation": citation}
    weighted = lambda w, p: clamp(sum((w[k] * clamp(p[k]) for k in w), F.lit(0.0)))
    plain = weighted(RECOMMEND_PLAIN, parts)
    return plain if tag is None else F.when(tag.isNull(), plain).otherwise(weighted(RECOMMEND_TAGGED, parts | {"tag": tag}))


def trend_status(age_periods: Column, recent: Column, growth: Column) -> Column:
    return (
        F.when(age_periods <= 2, "new")
        .when((growth > 0.5) & (recent >= 5), "emerging")
        .when(growth > 0.2, "growing")
        .when(growth < -0.2, "declining")
        .otherwise("stable")
    )


def tag_match(paper_topics: Column, sets: dict[str, Column | None]) -> Column:
    """Null if no level was chosen, 0 for a paper without topics, else the weight of the closest level that overlaps."""
    chosen = [(TAG_LEVELS[k], v) for k, v in sets.items() if v is not None]
    if not chosen:
        return F.lit(None).cast("double")
    hits = [F.when(F.arrays_overlap(paper_topics, v), w).otherwise(0.0) for w, v in chosen]
    return F.when(F.coalesce(F.size(paper_topics), F.lit(0)) <= 0, 0.0).otherwise(F.coalesce(F.greatest(*hits, F.lit(0.0)), F.lit(0.0)))


def january_split(january: Column, first_day: Column) -> tuple[Column, Column]:
    """(real, artificial) works of a January whose first day also holds works of unknown date."""
    rest = F.greatest(january - first_day, F.lit(0)).cast("decimal(38,10)")
    expected = F.least(F.greatest(F.round(rest + rest / 30, 0).cast("bigint"), F.lit(0)), january)
    return expected, january - expected


def quota(total: Column, parts: int, index: Column) -> Column:
    """The index-th (from 0) of equal parts of total; what is left goes to the first ones."""
    return F.floor(total / parts).cast("bigint") + F.when(index < total % parts, 1).otherwise(0)
