"""Spark session builder with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lumenbib", master: str | None = None, shuffle_partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings given from outside stay as they are.

    checkpoint_dir: a folder that all executors share, for tables that lineage is cut at.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, whatever their PYTHONPATH; done once a context."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_lumenbib_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lumenbib-"), "lumenbib.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("lumenbib", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._lumenbib_shipped = True
