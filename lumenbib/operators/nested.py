"""Deeply nested records into flat tables that keep their parent links.

Method: Dewey labelling. Every node of a record has a path of steps, a step being a field name and, for an element of an
array, its place from 1. The path is the node's key within its record, the parent's key is the path cut by its last step,
and nodes whose paths are the same without places (the schema path) are the rows of one table. `shred` derives the
labels of typed columns from their schema when the plan is built; JSON text is parsed once per value into VARIANT and
its layouts are read by path. A record is exploded once, in the task that reads it: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "struct<path:string,ref:string>"


def parent_path(path: Column) -> Column:
    """The path without its last step (a name, or a name and a place); '' for a path of one step."""
    return F.regexp_replace(path, r"(^|/)[^/]+(?<!/\d{1,9})(/\d+)?$", "")


def schema_path(path: Column) -> Column:
    """The path without places: the name of the table that the node belongs to."""
    return F.regexp_replace(path, r"/\d+(?=/|$)", "")


def _node(path: Column, ref: Column) -> Column:
    return F.struct(path.alias("path"), F.coalesce(ref.cast("string"), F.lit("")).alias("ref"))


def _none() -> Column:
    return F.array().cast(f"array<{NODE}>")


def elements(array: Column, name: str, prefix: Column | None, ref: Callable[[Column], Column], inner: Callable[[Column, Column], list[Column]] = lambda e, p: []) -> Column:
    """Nodes `prefix name/i` of an array and, by inner(element, its path), of what lies below each; null elements take a place and make no node."""
    lead = F.lit(name + "/") if prefix is None else F.concat(prefix, F.lit(f"/{name}/"))

    def one(e: Column, i: Column) -> Column:
        below = lambda p: F.concat(F.array(_node(p, ref(e))), *inner(e, p))
        return F.when(e.isNull(), _none()).otherwise(_let(F.concat(lead, (i + 1).cast("string")), below))

    return F.coalesce(F.flatten(F.transform(array, one)), _none())


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once: inside lambda functions Spark shares no common subexpressions."""
    return F.transform(F.array(x), f)[0]


def _parse(text: Column) -> Column:
    # read as the only element of an array, since the parser stops silently at the end of a first value
    return _let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def parse_json(text: Column, depth: int = 2) -> Column:
    """JSON text as VARIANT, also if it was encoded as a JSON string once more (depth - 1 times); null for text that isn't one complete JSON value."""
    v = _parse(text)
    for _ in range(depth - 1):
        v = _let(v, lambda x: F.when(F.schema_of_variant(x) == "STRING", _parse(F.try_variant_get(x, "$", "string"))).otherwise(x))
    return v


def _string(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a string (not an object or array)."""
    one = lambda p: _let(F.try_variant_get(v, p, "variant"), lambda x: F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(x, "$", "string")))
    return F.coalesce(*[one(p) for p in paths])


def _list(v: Column, path: str) -> Column:
    """The array at path; a lone value is an array of one; null if there is nothing."""

    def listed(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return F.when(kind.startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")).when(x.isNotNull() & (kind != "VOID"), F.array(x))

    return _let(F.try_variant_get(v, path, "variant"), listed)


def _present(x: Column) -> Column:
    """Elements that are JSON null become null, so that they take a place only."""
    return F.transform(x, lambda e: F.when(F.schema_of_variant(e) != "VOID", e))


def affiliation_nodes(raw: Column, prefix: Column) -> Column:
    """affiliations/k, and institution_ids/m below, of an author's raw text, whichever of its layouts it has.

    Layouts: `affiliations` (array or lone object, with institution_ids as array or lone value; or plain texts),
    `raw_affiliation_strings` and `raw_affiliation_string`; the first that holds anything counts.
    """
    options = [_list(raw, f"$.{k}") for k in ("affiliations", "raw_affiliation_strings", "raw_affiliation_string")]
    given = F.coalesce(*[_let(o, lambda x: F.when(F.size(x) > 0, x)) for o in options])

    def text(e: Column) -> Column:
        return F.coalesce(_string(e, "$"), _string(e, "$.raw_affiliation_string", "$.raw_affiliation_strings", "$.raw", "$.display_name", "$.name"))

    def ids(e: Column, p: Column) -> list[Column]:
        return [elements(_present(_list(e, "$.institution_ids")), "institution_ids", p, lambda x: _string(x, "$", "$.id"))]

    return elements(F.transform(_present(given), lambda e: F.when(text(e).isNotNull() | F.try_variant_get(e, "$.institution_ids", "variant").isNotNull(), e)), "affiliations", prefix, text, ids)


def level_nodes(raw: Column, prefix: Column) -> Column:
    """subfield, field and domain of a topic's raw text: flat, below `hierarchy`, or each inside the level below it; texts or objects."""
    homes = {
        "subfield": ["$.subfield", "$.hierarchy.subfield"],
        "field": ["$.field", "$.hierarchy.field", "$.subfield.field", "$.hierarchy.subfield.field"],
        "domain": ["$.domain", "$.hierarchy.domain", "$.field.domain", "$.subfield.domain", "$.subfield.field.domain", "$.hierarchy.field.domain", "$.hierarchy.subfield.domain", "$.hierarchy.subfield.field.domain"],
    }

    def node(level: str, paths: list[str]) -> Column:
        at = F.concat(prefix, F.lit("/" + level))
        named = [F.try_variant_get(raw, p + tail, "string") for p in paths for tail in (".display_name", ".name")]
        ref = F.coalesce(*named, _string(raw, *paths))
        return _let(ref, lambda r: F.when(r.isNotNull(), F.array(_node(at, r))).otherwise(_none()))

    return F.concat(*[node(level, paths) for level, paths in homes.items()])


def _with_raw(array: Column) -> Column:
    """Each element beside its raw text, parsed once."""
    return F.transform(array, lambda e: F.when(e.isNotNull(), F.struct(e.alias("e"), parse_json(e["raw"]).alias("v"))))


def shred_works(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(record_id, parent_path, child_path, child_ref): one row per nested element of a work record.

    authors/i, authors/i/institutions/j, topics/i from the typed arrays; affiliations, institution_ids and the topic
    levels from raw. child_ref is '' where a reference is missing. Null and empty arrays, and raw text that is null or
    isn't complete JSON, add no rows; equal records have equal rows each; other columns are ignored.
    """
    base = records.select(F.col(id_col), _with_raw(F.col("authors")).alias("a"), _with_raw(F.col("topics")).alias("t"))
    authors = elements(
        F.col("a"),
        "authors",
        None,
        lambda x: x["e"]["external_id"],
        lambda x, p: [elements(x["e"]["institutions"], "institutions", p, lambda i: i["external_id"]), affiliation_nodes(x["v"], p)],
    )
    topics = elements(F.col("t"), "topics", None, lambda x: x["e"]["external_id"], lambda x, p: [level_nodes(x["v"], p)])
    nodes = base.select(id_col, F.explode(F.concat(authors, topics)).alias("n"))
    return nodes.select(id_col, parent_path(F.col("n.path")).alias("parent_path"), F.col("n.path").alias("child_path"), F.col("n.ref").alias("child_ref"))


def shred(records: DataFrame, id_col: str, columns: list[str]) -> dict[str, DataFrame]:
    """Flat tables of the array-of-struct columns named, at any depth, keyed by schema path.

    Each table has (id, parent_path, path, place) and the scalar fields of its elements; a field that would clash with
    one of these is named field_<name>. Null elements take a place but make no row; an array of plain values has the
    column value.
    """
    tables: dict[str, DataFrame] = {}

    def walk(df: DataFrame, name: str, key: str, kind: T.ArrayType) -> None:
        e = kind.elementType
        at = df.select("_id", F.col("_path").alias("_parent"), F.posexplode(F.col(key)).alias("_pos", "_e")).filter("_e is not null")
        at = at.withColumn("_place", F.col("_pos") + 1)
        leaf = name.rpartition("/")[2]
        at = at.withColumn("_path", F.concat(F.when(F.col("_parent") == "", "").otherwise(F.concat("_parent", F.lit("/"))), F.lit(leaf + "/"), F.col("_place").cast("string")))
        head = [F.col("_id").alias(id_col), F.col("_parent").alias("parent_path"), F.col("_path").alias("path"), F.col("_place").alias("place")]
        taken = {id_col, "parent_path", "path", "place"}
        if not isinstance(e, T.StructType):
            tables[name] = at.select(*head, F.col("_e").alias("value"))
            return
        scalars = [f for f in e.fields if not isinstance(f.dataType, T.ArrayType)]
        tables[name] = at.select(*head, *[F.col("_e").getField(f.name).alias(f"field_{f.name}" if f.name in taken else f.name) for f in scalars])
        for f in e.fields:
            if isinstance(f.dataType, T.ArrayType):
                walk(at.select("_id", "_path", F.col("_e").getField(f.name).alias("_c")), f"{name}/{f.name}", "_c", f.dataType)

    for c in columns:
        walk(records.select(F.col(id_col).alias("_id"), F.lit("").alias("_path"), F.col(c).alias("_c")), c, "_c", records.schema[c].dataType)
    return tables


def split_by_schema(nodes: DataFrame, paths: list[str]) -> dict[str, DataFrame]:
    """The node list as one table per schema path; each is a filter of the same scan."""
    return {p: nodes.filter(schema_path(F.col("child_path")) == p) for p in paths}
