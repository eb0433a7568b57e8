"""One surviving record per group of duplicate records, put together field by field.

Groups: records that share an identifier, directly or through others, found as connected components of the record-identifier
graph; an identifier with a third of all records is one star in it, never a list in one task.

Fields: iterative truth discovery: source reliability and weighted value votes are estimated alternately until they
settle, and the value of the highest support is taken for each field. Where a result is defined by recency, the sources
are how a value is held: by the latest record that has a usable one, or by earlier ones. Each source has one vote for a
value, however many records hold it, and trust in the latest comes first as a prior, so at the start the latest value is
chosen. That source then never errs, while the other does wherever they differ: with e of its n claims wrong its weight
is log((n + 2) / (e + 1)), and as an object has one true value, of which the latest makes m in all, n - e is at most m:
the weight stays below log(m + 2), that of the latest, and the choice is a fixed point on every table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoints import cut
from ..operators.components import connected_components
from ..operators.parallel import broadcast_small

#: Suffixes and whole values that stand for a missing identifier (fixed values).
MISSING = ["", "-", "n/a", "na", "none", "null", "nan", "unknown", "undefined", "missing", "tbd", "test", "0", "xxx"]


def clean_doi(raw: Column) -> Column:
    """Lower-case `10.…` of a doi in any notation (resolver address, `doi:`, escapes, odd space, a final dot); null if it names no object."""
    x = F.lower(F.regexp_replace(raw, r"[\s ​]+", ""))
    for code, ch in (("%2f", "/"), ("%28", "("), ("%29", ")"), ("%3a", ":"), ("%3b", ";"), ("%3c", "<"), ("%3e", ">"), ("%23", "#"), ("%5b", "["), ("%5d", "]"), ("%25", "%")):
        x = F.replace(x, F.lit(code), F.lit(ch))
    x = F.regexp_extract(x, r"(10\.\d{4,9}(?:\.\d+)*/.+)$", 1)
    x = F.regexp_replace(x, r"[.,;/]+$", "")
    suffix = F.regexp_extract(x, r"^10\.[\d.]+/(.*)$", 1)
    ok = (suffix != "") & ~suffix.isin(MISSING) & ~suffix.rlike("^0+$") & ~x.rlike(r"^10\.0+/")
    return F.when(ok, x)


def clean_work_id(raw: Column) -> Column:
    """`W` and digits of a work id in any notation; null if there is none or its number is zero."""
    n = F.regexp_extract(F.upper(F.trim(raw)), r"(?:^|[/:\s])W(\d+)/*$", 1)
    return F.when((n != "") & ~n.rlike("^0+$"), F.concat(F.lit("W"), n))


def group_by_identifiers(records: DataFrame, id_col: str, identifiers: list[str]) -> DataFrame:
    """(id, group_id) of every record in a group of two or more: records that share a value of any identifier column.

    Values must be clean: null ties nothing together. Values of different columns never meet. group_id is the smallest id.
    """
    pairs = None
    for c in identifiers:
        part = records.select(F.col(id_col).alias("id"), F.concat(F.lit(c + ":"), F.col(c)).alias("key")).filter("key is not null")
        pairs = part if pairs is None else pairs.unionByName(part)
    first = pairs.groupBy("key").agg(F.min("id").alias("first"))
    edges = pairs.join(first, "key").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def recency_claims(records: DataFrame, fields: list[str], updated: str, id_col: str) -> DataFrame:
    """records (group_id, fields as strings, …) -> (object, field, value, source): by whom each value of a group's field is held.

    source is `latest` for the value of the group's latest record that has one for the field, and `earlier` for all values
    that other records hold. A record without a time comes before all that have one; ties go to the larger id. Values are
    put together by partial aggregation before anything is compared, so a group may be of any size.
    """
    order = F.struct(F.coalesce(F.col(updated).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("t"), F.col(id_col).alias("i"))
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    long = records.select(F.col("group_id").alias("object"), order.alias("at"), F.explode(each).alias("f")).select("object", "f.field", "f.value", "at").filter("value is not null")
    values = long.groupBy("object", "field", "value").agg(F.max("at").alias("at"), F.count("*").alias("n"))
    top = values.groupBy("object", "field").agg(F.max("at").alias("top"))
    x = values.join(top, ["object", "field"])
    held = F.array_compact(F.array(F.when(F.col("at") == F.col("top"), "latest"), F.when((F.col("at") < F.col("top")) | (F.col("n") > 1), "earlier")))
    return x.select("object", "field", "value", F.explode(held).alias("source"))


def truth_discovery(claims: DataFrame, rounds: int = 20, tolerance: float = 1e-4, prior: dict[str, float] | None = None) -> DataFrame:
    """claims (object, field, value, source) -> (object, field, value, support): the highest-supported value of each field.

    Support of a value is the sum of its sources' weights; the weight of a source is -log of its share of disagreement
    with the values chosen (add-one smoothed), taken anew until no weight moves by more than tolerance, or for `rounds`
    rounds. prior: weights to start from, 1 for sources not in it. Weights are a row a source, broadcast if these are
    counted to be few. Null values make no claim; a repeated claim counts once; ties go to the larger number, or to the
    larger text where values are no numbers. Claims with a null source count as one source.
    """
    c = claims.filter("object is not null and field is not null and value is not null")
    c = cut(c.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit(""))).select("object", "field", "value", "source").distinct())
    start = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in (prior or {}).items()], F.lit(1.0))
    weights = c.select("source").distinct().withColumn("w", start)
    best = None
    for _ in range(rounds):
        votes = c.join(broadcast_small(weights), "source").groupBy("object", "field", "value").agg(F.sum("w").alias("support"))
        best = votes.groupBy("object", "field").agg(F.max(F.struct("support", F.col("value").try_cast("double").alias("number"), "value")).alias("b")).select("object", "field", F.col("b.value").alias("value"), F.col("b.support").alias("support"))
        truth = best.select("object", "field", F.col("value").alias("truth"))
        errors = c.join(truth, ["object", "field"]).groupBy("source").agg((F.count(F.when(F.col("value") != F.col("truth"), 1)) + 1.0).alias("e"), (F.count("*") + 2.0).alias("n"))
        new = cut(errors.select("source", (-F.log(F.col("e") / F.col("n"))).alias("w")))
        moved = new.join(weights.withColumnRenamed("w", "old"), "source").agg(F.max(F.abs(F.col("w") - F.col("old")))).first()[0]
        weights = new
        if moved is None or moved <= tolerance:
            break
    return best


FIELDS = ["doi", "openalex_id", "cited_by_count"]
#: What the latest record's value is trusted at the start, those of earlier ones being 1.
PRIOR = {"latest": 2.0}


def discovered(papers: DataFrame) -> DataFrame:
    """papers (id, doi, openalex_id, cited_by_count, updated_at) -> (group_id, field, value, support) of the groups of two or more.

    By truth discovery over `recency_claims`; fields without a usable value have no row.
    """
    p = papers.filter("id is not null").select("id", clean_doi(F.col("doi")).alias("doi"), clean_work_id(F.col("openalex_id")).alias("openalex_id"), F.when(F.col("cited_by_count") >= 0, F.col("cited_by_count").cast("long")).alias("cited_by_count"), "updated_at")
    grouped = p.join(group_by_identifiers(p, "id", ["doi", "openalex_id"]), "id")
    best = truth_discovery(recency_claims(grouped, FIELDS, "updated_at", "id"), prior=PRIOR)
    return best.select(F.col("object").alias("group_id"), "field", "value", "support")


def survivors(papers: DataFrame) -> DataFrame:
    """papers (id, doi, openalex_id, cited_by_count, updated_at) -> p4_found's rows, one per group of two or more.

    Null in any column is a missing value; a record in no group gives no row; equal records are a group if they share an
    identifier; an empty table gives an empty result; other columns are ignored.
    """
    value = lambda c: F.max(F.when(F.col("field") == c, F.col("value")))
    out = discovered(papers).groupBy("group_id").agg(*[value(c).alias(c) for c in FIELDS])
    return out.select("group_id", F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("openalex_id", F.lit("")).alias("openalex_id"), F.coalesce(F.col("cited_by_count").cast("long"), F.lit(-1)).cast("long").alias("cited_by_count"))
