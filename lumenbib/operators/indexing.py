"""The indexing job: texts of papers, what has changed, vectors, points, and what is to be done next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import store
from .ingest import indexing_status
from .records import indexed_hashes


def stored_hashes(papers: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(id, hash): the table's hash of an indexed paper, else the one in its point's payload."""
    t = indexed_hashes(papers).withColumnRenamed("text_hash", "hash")
    if points is None:
        return t
    p = points.select(F.regexp_extract("point_id", r"(\d+)$", 1).cast("bigint").alias("id"), F.get_json_object("payload", "$.text_hash").alias("_h")).filter("_h is not null")
    return t.join(p, "id", "full_outer").select("id", F.coalesce("hash", "_h").alias("hash"))


def index_papers(papers: DataFrame, keywords: DataFrame, links: DataFrame, embedder: Callable, dimension: int, points: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """status (id, status), points (point_id, vector, payload), marks (id, text_hash) and topics (topic_id) to follow up.

    papers (id, title, abstract, publication_year, language, is_indexed, text_hash); keywords (paper_id, keywords: array).
    Only papers that are new or whose text has changed are embedded, all of them if forced. Papers without text, for
    whom there is nothing to embed, have the status empty.
    """
    base = papers.join(keywords.select(F.col("paper_id").alias("id"), "keywords"), "id", "left")
    t = text.embedding_text(F.col("title"), F.col("abstract"), F.lit(None).cast("array<string>"), F.col("keywords"))
    now = base.select("id", "publication_year", "language", "title", t.alias("t")).withColumn("hash", F.when(F.col("t") != "", text.text_hash(F.col("t"))))
    status = indexing_status(now, stored_hashes(papers, points), "id")
    status = status.join(now.select("id", "hash"), "id").select("id", F.when(F.col("hash").isNull(), "empty").otherwise(F.col("status")).alias("status"))
    due = F.col("status") != "empty" if force else F.col("status").isin("new", "changed")
    todo = now.join(status.filter(due).select("id"), "id", "left_semi")
    v = store.embed(todo, "t", embedder, dimension)
    payload = text.compact_json({c: F.col(c) for c in ("id", "title", "publication_year", "language")} | {"text_hash": F.col("hash")})
    new = v.select(F.concat(F.lit("paper:"), F.col("id").cast("string")).alias("point_id"), "vector", payload.alias("payload"))
    topics = links.join(todo.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").select("topic_id").distinct()
    return {"status": status, "points": new, "marks": todo.select("id", F.col("hash").alias("text_hash")), "topics": topics}
