"""Queries over nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..sources.parquet import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred_works(table(spark, d, "external_papers", "record_id", "authors", "topics"))


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each flat table by schema path."""
    nodes = p1_found(spark, d)
    return nodes.groupBy(nested.schema_path(F.col("child_path")).alias("schema_path")).agg(F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_records"))


def p1_author_affiliations(spark: SparkSession, d: str) -> DataFrame:
    """Two of the flat tables put together by their keys: each affiliation with its author's reference."""
    t = nested.split_by_schema(p1_found(spark, d), ["authors", "authors/affiliations"])
    a = t["authors"].select("record_id", F.col("child_path").alias("parent_path"), F.col("child_ref").alias("author"))
    return t["authors/affiliations"].join(a, ["record_id", "parent_path"]).select("record_id", "child_path", "author", F.col("child_ref").alias("affiliation"))


def p1_institutions(spark: SparkSession, d: str) -> DataFrame:
    """The table of the authors' institutions, with their own fields, by the generic shredder."""
    t = nested.shred(table(spark, d, "external_papers", "record_id", "authors"), "record_id", ["authors"])
    return t["authors/institutions"].select("record_id", "parent_path", "path", "place", "external_id", "display_name", "ror", "country_code")


QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p1_author_affiliations": p1_author_affiliations, "p1_institutions": p1_institutions}

_NODES = """
WITH a AS (SELECT record_id, unnest(authors) AS e, generate_subscripts(authors, 1) AS i FROM external_papers),
t AS (SELECT record_id, unnest(topics) AS e, generate_subscripts(topics, 1) AS i FROM external_papers),
av0 AS (SELECT record_id, 'authors/' || i AS p, CASE WHEN json_valid(e.raw) THEN CAST(e.raw AS JSON) END AS v FROM a WHERE e IS NOT NULL),
av AS (SELECT record_id, p, CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) END ELSE v END AS v FROM av0),
tv0 AS (SELECT record_id, 'topics/' || i AS p, CASE WHEN json_valid(e.raw) THEN CAST(e.raw AS JSON) END AS v FROM t WHERE e IS NOT NULL),
tv AS (SELECT record_id, p, CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) END ELSE v END AS v FROM tv0),
af0 AS (SELECT record_id, p, CASE WHEN json_array_length(v, '$.affiliations') > 0 OR json_type(v, '$.affiliations') = 'OBJECT' THEN v -> '$.affiliations' WHEN (v -> '$.raw_affiliation_strings') IS NOT NULL THEN v -> '$.raw_affiliation_strings' ELSE v -> '$.raw_affiliation_string' END AS f FROM av),
af1 AS (SELECT record_id, p, CASE WHEN json_type(f) = 'ARRAY' THEN CAST(f AS JSON[]) ELSE [f] END AS f FROM af0 WHERE f IS NOT NULL),
af AS (SELECT record_id, p, unnest(f) AS f, generate_subscripts(f, 1) AS k FROM af1),
aff AS (SELECT record_id, p, p || '/affiliations/' || k AS q, f, CASE WHEN json_type(f) = 'VARCHAR' THEN f ->> '$' ELSE f ->> '$.raw_affiliation_string' END AS ref FROM af WHERE f IS NOT NULL AND json_type(f) <> 'NULL'),
ids0 AS (SELECT record_id, q, CASE WHEN json_type(f, '$.institution_ids') = 'ARRAY' THEN CAST(f -> '$.institution_ids' AS JSON[]) ELSE [f -> '$.institution_ids'] END AS x FROM aff WHERE json_type(f, '$.institution_ids') IN ('ARRAY', 'VARCHAR')),
ids AS (SELECT record_id, q, unnest(x) AS x, generate_subscripts(x, 1) AS m FROM ids0),
inst AS (SELECT record_id, 'authors/' || i AS p, unnest(e.institutions) AS x, generate_subscripts(e.institutions, 1) AS j FROM a WHERE e IS NOT NULL),
lv AS (SELECT record_id, p, 'subfield' AS l, coalesce(v -> '$.subfield', v -> '$.hierarchy.subfield') AS x FROM tv
 UNION ALL SELECT record_id, p, 'field', coalesce(v -> '$.field', v -> '$.hierarchy.field', v -> '$.subfield.field') FROM tv
 UNION ALL SELECT record_id, p, 'domain', coalesce(v -> '$.domain', v -> '$.hierarchy.domain', v -> '$.field.domain', v -> '$.subfield.domain', v -> '$.subfield.field.domain') FROM tv),
lr AS (SELECT record_id, p, l, CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' ELSE coalesce(x ->> '$.display_name', x ->> '$.name') END AS ref FROM lv),
nodes AS (SELECT record_id, '' AS parent_path, 'authors/' || i AS child_path, coalesce(e.external_id, '') AS child_ref FROM a WHERE e IS NOT NULL
UNION ALL SELECT record_id, '', 'topics/' || i, coalesce(e.external_id, '') FROM t WHERE e IS NOT NULL
UNION ALL SELECT record_id, p, p || '/institutions/' || j, coalesce(x.external_id, '') FROM inst WHERE x IS NOT NULL
UNION ALL SELECT record_id, p, q, coalesce(ref, '') FROM aff
UNION ALL SELECT record_id, q, q || '/institution_ids/' || m, coalesce(x ->> '$', '') FROM ids WHERE json_type(x) <> 'NULL'
UNION ALL SELECT record_id, p, p || '/' || l, ref FROM lr WHERE ref IS NOT NULL)
"""
SQL = {
    "p1_found": _NODES + "SELECT record_id, parent_path, child_path, child_ref FROM nodes",
    "p1_tables": _NODES + "SELECT regexp_replace(child_path, '/\\d+', '', 'g') AS schema_path, count(*) AS n_rows, count(DISTINCT record_id) AS n_records FROM nodes GROUP BY 1",
    "p1_author_affiliations": _NODES + "SELECT f.record_id, f.child_path, n.child_ref AS author, f.child_ref AS affiliation FROM nodes f JOIN nodes n ON n.record_id = f.record_id AND n.child_path = f.parent_path WHERE regexp_replace(f.child_path, '/\\d+', '', 'g') = 'authors/affiliations'",
    "p1_institutions": _NODES + "SELECT record_id, p AS parent_path, p || '/institutions/' || j AS path, CAST(j AS INT) AS place, x.external_id, x.display_name, x.ror, x.country_code FROM inst WHERE x IS NOT NULL",
}
