"""Sinks: versioned tables, vector collections and JSON reports on a shared file system."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators.merge import merge


def write_version(df: DataFrame, path: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write a new version of a table beside the old ones and point CURRENT at it; readers of the old one aren't disturbed.

    The pointer is a table of one row, so that it lives on whatever file system the data does.
    """
    target = f"{path}/v={version}"
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(target)
    df.sparkSession.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/CURRENT")
    return target


def read_current(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/CURRENT").first()["version"]
    return spark.read.parquet(f"{path}/v={version}")


class WrongDimension(ValueError):
    """Points whose vectors don't have the collection's number of values."""


def check_points(points: DataFrame, dimension: int) -> DataFrame:
    """Points (point_id, vector, …) as they are; the job that reads them fails on a vector of another size, null ones included, or a null id."""
    ok = F.col("point_id").isNotNull() & (F.coalesce(F.size("vector"), F.lit(-1)) == dimension)
    said = F.concat(F.lit(f"a vector must have {dimension} values: point "), F.coalesce(F.col("point_id").cast("string"), F.lit("without id")))
    return points.withColumn("point_id", F.when(ok, F.col("point_id")).otherwise(F.raise_error(said).cast(points.schema["point_id"].dataType)))


def create_collection(spark: SparkSession, path: str, dimension: int, distance: str = "cosine", columns: str = "point_id string, vector array<double>, payload string") -> None:
    """An empty collection with its dimension and distance beside it; one that is there already must have the same."""
    if distance not in ("cosine", "dot", "euclid"):
        raise ValueError(f"unknown distance: {distance}")
    have = describe_collection(spark, path)
    if have is None:
        write_version(spark.createDataFrame([], columns), path, 0)
        spark.createDataFrame([(dimension, distance)], "dimension int, distance string").coalesce(1).write.mode("overwrite").parquet(f"{path}/SCHEMA")
    elif have != (dimension, distance):
        raise WrongDimension(f"the collection has {have}")


def describe_collection(spark: SparkSession, path: str) -> tuple[int, str] | None:
    from pyspark.errors import AnalysisException

    try:
        return tuple(spark.read.parquet(f"{path}/SCHEMA").first())
    except AnalysisException:
        return None


def upsert_points(collection: DataFrame, points: DataFrame, dimension: int, seq: str | None = None) -> DataFrame:
    """The collection with points overwritten by id, the last of one batch counting."""
    policy = {c: "overwrite" for c in collection.columns if c != "point_id"}
    return merge(collection, check_points(points, dimension), ["point_id"], policy, seq).drop("change")


def retrieve(collection: DataFrame, ids: DataFrame, with_vectors: bool = True) -> DataFrame:
    """Points with one of the ids (point_id); unknown ids are silently absent."""
    x = collection.join(ids.select("point_id").distinct(), "point_id", "left_semi")
    return x if with_vectors else x.drop("vector")


def scroll(collection: DataFrame, where: Column | None = None, with_vectors: bool = True) -> DataFrame:
    """All points, or those that a condition on payload columns holds for; without vectors these aren't read."""
    x = collection if where is None else collection.filter(where)
    return x if with_vectors else x.drop("vector")


def search(collection: DataFrame, vector: list[float], k: int, must: Column | None = None, distance: str = "cosine") -> DataFrame:
    """The k points nearest to a vector, by the collection's distance, among those that must holds for: the other columns and score.

    One request's vector is a literal in the plan; a scan keeps k rows a task. Ties go to the smaller id; points of
    another size or without a vector aren't found.
    """
    v = F.array(*[F.lit(float(x)) for x in vector])
    x = (collection if must is None else collection.filter(F.coalesce(must, F.lit(False)))).filter(F.size("vector") == len(vector))
    dot = F.aggregate(F.zip_with("vector", v, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
    gap = F.aggregate(F.zip_with("vector", v, lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
    score = {"cosine": vectors.cosine(F.col("vector"), v), "dot": dot, "euclid": -F.sqrt(gap)}[distance]
    x = x.withColumn("score", F.round(score, 9)).drop("vector").filter("score is not null")
    return x.orderBy(F.desc("score"), "point_id").limit(k)


def embed(df: DataFrame, text_col: str, embedder: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """df with vector: what embedder makes of batches of texts, in the executors; null for null and blank texts.

    The job fails if it gives another number of vectors than texts, or vectors of another size.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            at = [i for i, t in enumerate(s) if t is not None and t.strip()]
            got = embedder([s.iloc[i] for i in at]) if at else []
            if len(got) != len(at) or any(len(v) != dimension for v in got):
                raise ValueError(f"the embedder gave {len(got)} vectors for {len(at)} texts, or some not of {dimension} values")
            out: list = [None] * len(s)
            for i, v in zip(at, got):
                out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return df.withColumn("vector", run(text_col))


def hash_embedder(dimension: int) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors from the hashes of a text's words, the same on every machine: a stand-in where no model is there."""

    def embedder(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else np.full(dimension, dimension**-0.5)).tolist())
        return out

    return embedder


def complete(model: Callable[[list[dict]], str] | None, messages: list[dict], fallback: str = "", as_json: bool = False) -> str:
    """A text model's answer to messages, or the fallback without one; with as_json an answer that is no JSON object is an error."""
    text = model(messages) if model else fallback
    if as_json and not isinstance(json.loads(text), dict):
        raise ValueError("the answer is no JSON object")
    return text


def write_report(path: str, report: dict) -> None:
    """A small report as a JSON file on the driver."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, default=str, sort_keys=True)
