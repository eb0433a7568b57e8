"""Parquet source: every table of a data directory is `<dir>/<name>.parquet`, a file or a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table, cut to the columns named (all if none are); zoneless timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return df.select(*[F.col(f"`{c}`").cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(f"`{c}`") for c, t in df.dtypes])
