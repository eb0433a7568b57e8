"""Merges: keyed upserts with a policy per column, deduplication, pruning, idempotent links.

Parquet has no MERGE, so a merge is a relation: the new state of the target. It is one full outer join on the keys; a
source is first cut to one row per key. Write the result to a new version of the table and switch over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("overwrite", "coalesce", "keep")


def dedupe(df: DataFrame, keys: list[str], seq: str, keep: str = "last") -> DataFrame:
    """One row per key: the one of the greatest (last) or least (first) seq; null seqs come first. A key of any number of rows is one aggregation group."""
    if keep not in ("last", "first"):
        raise ValueError(f"keep must be last or first: {keep}")
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    order = F.coalesce(F.col(seq).cast("bigint"), F.lit(-(1 << 62)))
    g = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r"))
    return g.select(*[F.col(k) if k in keys else F.col("_r").getField(k).alias(k) for k in df.columns])


def merge(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, str], seq: str | None = None) -> DataFrame:
    """The target after an upsert, with change in {kept, inserted, updated}.

    overwrite takes the source's value even if null, coalesce only if it isn't null, keep leaves an existing row's value.
    Of rows with one key the last by seq counts; rows with a null key are left out of the source.
    """
    bad = [v for v in policy.values() if v not in POLICIES]
    if bad:
        raise ValueError(f"unknown policies: {bad}")
    for k in keys:
        source = source.filter(F.col(k).isNotNull())
    if seq:
        source = dedupe(source, keys, seq)
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in policy], F.lit(True).alias("_in_s"))
    x = target.withColumn("_in_t", F.lit(True)).join(s, keys, "full_outer")
    old, new = F.col("_in_t").isNotNull(), F.col("_in_s").isNotNull()

    def value(c: str):
        if c not in policy:
            return F.col(c)
        v = F.col(f"_s_{c}")
        how = {"overwrite": v, "coalesce": F.coalesce(v, F.col(c)), "keep": F.when(old, F.col(c)).otherwise(v)}[policy[c]]
        return F.when(new, how).otherwise(F.col(c)).alias(c)

    change = F.when(old & new, "updated").when(new, "inserted").otherwise("kept")
    return x.select(*[F.col(c) if c in keys else value(c) for c in target.columns], change.alias("change"))


def add_links(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target and those links of source it lacks: adding is idempotent."""
    new = source.select(*keys).distinct().join(target.select(*keys), keys, "left_anti")
    return target.select(*keys).unionByName(new)


def remove_links(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys).distinct(), keys, "left_anti")


def prune_missing(target: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key is still present."""
    return target.join(present.select(*keys).distinct(), keys, "left_semi")


def primary_topics(links: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(paper_id, topic_id): the explicit topic if one is given, else the best-scored one (null last), ties to the smaller id."""
    best = links.groupBy("paper_id").agg(F.max_by("topic_id", F.struct(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))), -F.col("topic_id"))).alias("topic_id"))
    if explicit is None:
        return best
    e = explicit.filter("topic_id is not null").select("paper_id", F.col("topic_id").alias("given"))
    return best.join(e, "paper_id", "full_outer").select("paper_id", F.coalesce("given", "topic_id").alias("topic_id"))


def prepare_import(records: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(records to import, counters): records without title or abstract and repeats of a key, the first one aside, are skipped."""
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    why = F.when(blank(F.col("title")), "no_title").when(blank(F.col("abstract")), "no_abstract")
    x = records.withColumn("_why", why)
    ok = x.filter("_why is null").drop("_why")
    # the first record of each key by aggregation; records without a key are no repeats and are never grouped
    rest = [c for c in ok.columns if c != key]
    first = ok.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(seq)).alias("_r"), F.count("*").alias("_n"))
    loaded = first.select(*[F.col(key) if c == key else F.col("_r").getField(c).alias(c) for c in ok.columns]).unionByName(ok.filter(F.col(key).isNull()))
    parts = x.filter("_why is not null").groupBy("_why").agg(F.count("*").alias("n")).select(F.col("_why").alias("outcome"), "n")
    sums = first.agg(F.count("*").alias("l"), F.sum(F.col("_n") - 1).alias("d"))
    loose = ok.filter(F.col(key).isNull()).agg(F.count("*").alias("l"), F.lit(0).cast("bigint").alias("d"))
    both = sums.unionByName(loose).agg(F.sum("l").alias("loaded"), F.sum("d").alias("duplicate"))
    counted = both.select(F.explode(F.array(F.struct(F.lit("loaded").alias("outcome"), F.col("loaded").alias("n")), F.struct(F.lit("duplicate").alias("outcome"), F.col("duplicate").alias("n")))).alias("c")).select("c.*")
    return loaded, parts.unionByName(counted.filter("n > 0"))


def best_landing(target: DataFrame, source: DataFrame, strict: bool = False) -> DataFrame:
    """(paper_id, landing_url, is_best) after a bulk upsert: papers that get a best landing lose the old one; strict leaves one best per paper."""
    got = source.filter("is_best").select("paper_id").distinct().withColumn("_got", F.lit(True))
    cleared = target.join(got, "paper_id", "left").withColumn("is_best", F.when(F.col("_got"), F.lit(False)).otherwise(F.col("is_best"))).drop("_got")
    out = merge(cleared, source, ["paper_id", "landing_url"], {"is_best": "overwrite"}).drop("change")
    if strict:
        r = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("is_best").desc_nulls_last(), "landing_url"))
        out = out.withColumn("is_best", F.when(F.col("is_best") & (r > 1), F.lit(False)).otherwise(F.col("is_best")))
    return out


def listed_landings(landings: DataFrame) -> DataFrame:
    """Landings (paper_id, landing_url, is_best) with place from 1: the best first, null last, then by address."""
    r = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("is_best").desc_nulls_last(), "landing_url"))
    return landings.withColumn("place", r)
