"""Upserts of entities that are known by one of several keys, their children, and imports that keep what fails apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import numbered
from .merge import dedupe, merge


def text_key(c: Column) -> Column:
    """A key as text, without blanks: null ties nothing."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def ensure_names(existing: DataFrame, names: DataFrame) -> DataFrame:
    """existing (id, name), names (name) -> all of them with created: names not yet there get ids after the greatest, in their order."""
    new = names.select(F.trim("name").alias("name")).filter("name <> ''").distinct().join(existing.select("name"), "name", "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = numbered(new, "name").crossJoin(F.broadcast(top)).select((F.col("_top") + 1 + F.col("i")).cast("bigint").alias("id"), "name")  # top is one row
    return existing.select("id", "name", F.lit(False).alias("created")).unionByName(fresh.withColumn("created", F.lit(True)))


def resolve(existing: DataFrame, items: DataFrame, stages: dict[str, tuple[Column, Column]], id_col: str) -> DataFrame:
    """items with id_col: of the existing row that has the item's value of the first key that knows one (smallest id), null if none does.

    stages: name -> (key of existing rows, key of items). Each stage is an aggregation of existing and a left join.
    """
    x, found = items, []
    for name, (theirs, ours) in stages.items():
        e = existing.select(theirs.alias(f"_k_{name}"), F.col(id_col).alias("_id")).filter(F.col(f"_k_{name}").isNotNull()).groupBy(f"_k_{name}").agg(F.min("_id").alias(f"_id_{name}"))
        x = x.withColumn(f"_k_{name}", ours).join(e, f"_k_{name}", "left")
        found.append(F.col(f"_id_{name}"))
    drop = [f"_{p}_{n}" for n in stages for p in ("k", "id")]
    return x.withColumn(id_col, F.coalesce(*found)).drop(*drop)


def upsert_by_keys(existing: DataFrame, items: DataFrame, stages: dict[str, tuple[Column, Column]], policy: dict[str, str], id_col: str, seq: str) -> DataFrame:
    """existing after an upsert of items, with change; items are matched by the first key that knows them and else inserted.

    Of items with one key (the first they have) or one match the last by seq counts; items without any key are left out.
    New rows get ids after the greatest, in the order of their keys. policy is as for `merge`.
    """
    key = F.coalesce(*[F.concat(F.lit(f"{n}:"), k.cast("string")) for n, (_, k) in stages.items()])
    one = dedupe(items.withColumn("_key", key).filter("_key is not null"), ["_key"], seq)
    x = resolve(existing, one, stages, id_col)
    known = dedupe(x.filter(F.col(id_col).isNotNull()), [id_col], seq)
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    new = numbered(x.filter(F.col(id_col).isNull()).drop(id_col), "_key").crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("_top") + 1 + F.col("i")).cast("bigint"))  # top is one row
    cols = [id_col, *policy]
    return merge(existing, known.select(*cols).unionByName(new.select(*cols)), [id_col], policy)


def upsert_authors(existing: DataFrame, items: DataFrame, seq: str) -> DataFrame:
    """Authors (author_id, external_id, display_name, orcid) by orcid, else by display name; missing values keep the old ones."""
    keys = {k: (text_key(F.col(k)), text_key(F.col(k))) for k in ("orcid", "display_name")}
    return upsert_by_keys(existing, items, keys, {"external_id": "coalesce", "display_name": "coalesce", "orcid": "coalesce"}, "author_id", seq)


def upsert_institutions(existing: DataFrame, items: DataFrame, seq: str) -> DataFrame:
    """Institutions (institution_id, display_name, ror, country_code, type) by ror, else by display name; country and type keep the old ones where missing."""
    keys = {k: (text_key(F.col(k)), text_key(F.col(k))) for k in ("ror", "display_name")}
    return upsert_by_keys(existing, items, keys, {"display_name": "coalesce", "ror": "coalesce", "country_code": "coalesce", "type": "coalesce"}, "institution_id", seq)


def upsert_topics(existing: DataFrame, items: DataFrame, seq: str) -> DataFrame:
    """Topics (id, openalex_id, name, subfield_id) by openalex_id, else by name; the name is overwritten, a missing subfield keeps the old one."""
    keys = {k: (text_key(F.col(k)), text_key(F.col(k))) for k in ("openalex_id", "name")}
    return upsert_by_keys(existing, items, keys, {"openalex_id": "coalesce", "name": "overwrite", "subfield_id": "coalesce"}, "id", seq)


def insert_keywords(existing: DataFrame, items: DataFrame) -> DataFrame:
    """existing (value) and those of items (value) it lacks: trimmed, lower case, blanks left out."""
    new = items.select(F.lower(F.trim("value")).alias("value")).filter("value <> ''").distinct()
    return existing.select("value").unionByName(new.join(existing.select("value"), "value", "left_anti"))


def replace_children(target: DataFrame, parents: DataFrame, children: DataFrame, key: list[str]) -> DataFrame:
    """Target without the children that parents (key) had, and with the new ones; children of other parents are left out."""
    p = parents.select(*key).distinct()
    return target.join(p, key, "left_anti").unionByName(children.join(p, key, "left_semi").select(*target.columns))


def existing_keys(target: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """The distinct keys of items that target has."""
    return items.select(*key).distinct().join(target.select(*key), key, "left_semi")


def update_known(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], strict: bool = False) -> DataFrame:
    """Target with columns set from source (one row a key), null included; unknown keys are ignored, or fail the job if strict."""
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns], F.lit(True).alias("_in"))
    x = target.withColumn("_has", F.lit(True)).join(s, keys, "full_outer" if strict else "left")
    if strict:
        said = F.concat(F.lit("no row to update: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
        x = x.filter(F.when(F.col("_has").isNull(), F.raise_error(said).cast("boolean")).otherwise(True))
    return x.select(*[F.when(F.col("_in"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target and source; the job fails on a source row whose key is there already."""
    have = target.select(*keys, F.lit(True).alias("_has")).distinct()
    said = F.concat(F.lit("exists already: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    x = source.join(have, keys, "left").filter(F.when(F.col("_has"), F.raise_error(said).cast("boolean")).otherwise(True))
    return target.unionByName(x.select(*target.columns))


def import_checked(records: DataFrame, existing: DataFrame, key: str, checks: dict[str, Column], skip_existing: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records to load, rejected records with reason, counters created, updated, skipped, failed).

    A record that a batch would fail on is found by its checks (reason -> condition of failure, the first that holds),
    row by row, so nothing is rolled back and halved until it is alone. With skip_existing known keys are left out.
    """
    why = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()], F.lit(None).cast("string"))
    have = existing.select(key, F.lit(True).alias("_has")).distinct()
    x = records.withColumn("reason", why).join(have, key, "left")
    good = F.col("reason").isNull()
    out = F.when(~good, "failed").when(F.col("_has") & F.lit(skip_existing), "skipped").when(F.col("_has"), "updated").otherwise("created")
    x = x.withColumn("_outcome", out)
    load = x.filter(F.col("_outcome").isin("created", "updated")).select(*records.columns)
    return load, x.filter(~good).select(*records.columns, "reason"), x.groupBy(F.col("_outcome").alias("outcome")).agg(F.count("*").alias("n"))
