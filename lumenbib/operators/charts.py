"""Series that charts are drawn from, as tables: (series, x, y, label) in the order they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def activity_line(periods: DataFrame) -> DataFrame:
    """(cluster_key, x, y): papers by period."""
    return periods.select("cluster_key", F.col("period_start").alias("x"), F.coalesce("paper_count", F.lit(0)).alias("y")).orderBy("cluster_key", "x")


def activity_heatmap(periods: DataFrame, names: DataFrame) -> DataFrame:
    """(x, y, value): a cell per cluster and period, the cluster by its name (cluster_key, name), or key where it has none."""
    x = periods.join(names.select("cluster_key", "name"), "cluster_key", "left")
    return x.select(F.col("period_start").alias("x"), F.coalesce("name", "cluster_key").alias("y"), F.coalesce("paper_count", F.lit(0)).alias("value"))


def growing_bars(clusters: DataFrame) -> DataFrame:
    """(x, y, status): all clusters by growth, the greatest first, null as 0."""
    return clusters.select(F.col("name").alias("x"), F.coalesce("growth_rate", F.lit(0.0)).alias("y"), "status").orderBy(F.desc("y"), "x")


def growth_scatter(clusters: DataFrame) -> DataFrame:
    """(x, y, label, status): growth against papers, null as 0."""
    return clusters.select(F.coalesce("growth_rate", F.lit(0.0)).alias("x"), F.coalesce("paper_count", F.lit(0)).alias("y"), F.col("name").alias("label"), "status")


def drift_line(periods: DataFrame) -> DataFrame:
    """(cluster_key, x, y): drift by period where there is one; clusters without any have no row."""
    return periods.filter("semantic_drift is not null").select("cluster_key", F.col("period_start").alias("x"), F.col("semantic_drift").alias("y")).orderBy("cluster_key", "x")


def list_weights(keywords: Column) -> Column:
    """Weights of keywords that come as a list: as many as follow them and one more."""
    return F.transform(keywords, lambda w, i: F.struct(w.alias("keyword"), F.greatest(F.size(keywords) - i, F.lit(1)).alias("weight")))
