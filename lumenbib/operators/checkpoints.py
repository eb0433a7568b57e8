"""Cutting lineage without losing it to a dead executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in `spark.checkpoint.dir`. Where it is unset, a temporary one is made on a local master only: on a
    cluster a folder of one machine can't be read by the others, so the setting is asked for."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lumenbib-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable, eager checkpoint of df: one written copy in the shared folder that every executor can read again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
