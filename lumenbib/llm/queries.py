"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import cut
from ..sources.parquet import table
from . import encodings, languages, mixing, names, neighbours, survivors, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents", "doc_id", "text", "n_chars"), length_col="n_chars")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(mixing.source_tokens(table(spark, d, "documents", "source", "text")))
    return mixing.short_sources(mixing.water_fill(table(spark, d, "mix_targets"), sizes))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The plan of the mixes and the mixes drawn by it from all documents."""
    sized = mixing.document_tokens(table(spark, d, "documents", "doc_id", "source", "text"))
    plan = cut(mixing.water_fill(table(spark, d, "mix_targets"), mixing.source_sums(sized)))
    return plan, mixing.sample_mix(sized, plan, tokens_col="tokens")


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    x = mixing.drawn_shares(*_mix(spark, d))
    return x.select("mix_id", "source", "tokens", "clamped", "drawn", *[F.round(c, 6).alias(c) for c in ("epochs", "planned_share", "actual_share")])


@query
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


PAPER_IDS = ("id", "doi", "openalex_id", "cited_by_count", "updated_at")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "papers", *PAPER_IDS))


@query
def p4_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivors.discovered(table(spark, d, "papers", *PAPER_IDS)).withColumn("support", F.round("support", 6))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "paper_points", "id", "vector"))


def _languages(spark: SparkSession, d: str) -> languages.Model:
    return languages.train(table(spark, d, "lang_samples", "lang", "sample_text"), table(spark, d, "papers", "language", "abstract"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(table(spark, d, "papers", "id", "language", "abstract"), _languages(spark, d)).select("paper_id", "seg_no", "lang")


@query
def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    s = languages.segment_documents(table(spark, d, "papers", "id", "language", "abstract"), _languages(spark, d), "id", "abstract", "language")
    return s.select(F.col("id").alias("paper_id"), F.explode("segs").alias("s")).select("paper_id", "s.*").withColumn("confidence", F.round("confidence", 6))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    model = encodings.train(table(spark, d, "lang_samples", "sample_text"), table(spark, d, "documents", "text"))
    return encodings.found(table(spark, d, "documents", "doc_id", "text"), model)


@query
def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    authors = table(spark, d, "external_authors", "author_id", "display_name", "orcid", "institution_id")
    return names.entities(authors, table(spark, d, "external_institutions", "institution_id", "display_name", "ror", "country_code"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    authors = table(spark, d, "external_authors", "author_id", "display_name", "orcid", "institution_id")
    return names.found(authors, table(spark, d, "external_institutions", "institution_id", "display_name", "ror", "country_code"))


#: Groups by a recursive walk over shared identifiers; for small tables.
SQL["p4_found"] = """
WITH RECURSIVE c0 AS (SELECT id, updated_at, regexp_replace(replace(replace(lower(regexp_replace(doi, '\\s+', '', 'g')), '%2f', '/'), '%25', '%'), '[.,;/]+$', '') AS d,
  regexp_extract(upper(trim(openalex_id)), '(?:^|[/:\\s])W(\\d+)/*$', 1) AS w, CASE WHEN cited_by_count >= 0 THEN CAST(cited_by_count AS BIGINT) END AS n FROM papers),
c AS (SELECT id, updated_at, n, CASE WHEN regexp_matches(d, '10\\.\\d{4,9}/.+$') AND NOT regexp_matches(d, '10\\.0+/') THEN regexp_extract(d, '(10\\.\\d{4,9}/.+)$', 1) END AS doi, CASE WHEN w <> '' AND NOT regexp_matches(w, '^0+$') THEN 'W' || w END AS wid FROM c0),
k AS (SELECT id, 'd' || doi AS k FROM c WHERE doi IS NOT NULL UNION SELECT id, 'w' || wid FROM c WHERE wid IS NOT NULL),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.k = b.k),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
g AS (SELECT id, min(root) AS group_id FROM r GROUP BY 1),
m AS (SELECT group_id FROM g GROUP BY 1 HAVING count(*) > 1)
SELECT g.group_id, coalesce(arg_max(doi, updated_at) FILTER (WHERE doi IS NOT NULL), '') AS doi, coalesce(arg_max(wid, updated_at) FILTER (WHERE wid IS NOT NULL), '') AS openalex_id, coalesce(arg_max(n, updated_at) FILTER (WHERE n IS NOT NULL), -1) AS cited_by_count
FROM g JOIN m ON m.group_id = g.group_id JOIN c ON c.id = g.id GROUP BY 1"""
