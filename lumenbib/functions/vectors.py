"""Vector arithmetic: scalar expressions on arrays, and means as aggregations."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine cut to [-1, 1]; 0 for a zero vector; null for vectors of unlike length or with nulls."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(n == 0, 0.0).otherwise(F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0)))


def drift(current: Column, previous: Column) -> Column:
    return 1 - cosine(current, previous)


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def usable(v: Column, d: int) -> Column:
    """Whether v has d values, none null, not all zero."""
    return F.coalesce((F.size(v) == d) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0), F.lit(False))


def mean_by(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, name: str = "centroid") -> DataFrame:
    """Keys with the (weighted) mean vector and the number of vectors n, by one aggregation with a vector as its partial state.

    Null and empty vectors take no part; vectors of unlike length within a group fail the job.
    """
    w = F.lit(1.0) if weight is None else weight
    x = df.filter(F.size(vector) > 0).select(*keys, w.alias("_w"), array_to_vector(doubles(F.col(vector))).alias("_x"))
    agg = x.groupBy(*keys).agg(Summarizer.mean(F.col("_x"), F.col("_w")).alias("_m"), F.count("*").alias("n"))
    return agg.select(*keys, vector_to_array("_m").alias(name), "n")
