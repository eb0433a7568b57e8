"""Data-quality checks, safe fixes and coverage of topic periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def checks(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(code, count) of the rows that fail each test, all counted in one scan."""
    one = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in tests.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("count")) for k in tests])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def sample(df: DataFrame, test: Column, id_col: str, n: int) -> DataFrame:
    """The n smallest ids that fail a test."""
    return df.filter(test).select(id_col).orderBy(id_col).limit(n)


def described(df: DataFrame, tests: dict[str, tuple[str, Column]], id_col: str, n: int = 5) -> DataFrame:
    """(code, description, count, sample) of each test (code -> (description, condition of failure)): the n smallest failing ids.

    One scan for all: a row goes to the tests it fails, each keeps n ids a task before anything is shuffled.
    """
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, (_, c) in tests.items()]))
    hits = df.select(F.col(id_col).alias("id"), F.explode(named).alias("code"))
    r = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = hits.withColumn("r", r).filter(F.col("r") <= n).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("sample"))
    text_of = F.create_map(*[F.lit(x) for k, (d, _) in tests.items() for x in (k, d)])
    x = checks(df, {k: c for k, (_, c) in tests.items()}).join(few, "code", "left")
    kind = df.schema[id_col].dataType.simpleString()
    return x.select("code", text_of[F.col("code")].alias("description"), "count", F.coalesce("sample", F.array().cast(f"array<{kind}>")).alias("sample"))


def report_totals(after: DataFrame, before: DataFrame | None = None, fixes: DataFrame | None = None) -> DataFrame:
    """One row: checks, checks that fail, issues, issues before and fixes made, of checks (code, count) and fixes (count)."""
    x = after.agg(F.count("*").alias("checks"), F.count(F.when(F.col("count") > 0, 1)).alias("failing"), F.coalesce(F.sum("count"), F.lit(0)).alias("issues"))
    zero = x.select(F.lit(None).cast("bigint").alias("n"))
    b = before.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("issues_before")) if before is not None else zero.withColumnRenamed("n", "issues_before")
    f = fixes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("fixes")) if fixes is not None else zero.withColumnRenamed("n", "fixes")
    return x.crossJoin(b).crossJoin(f)  # one row each


def trimmed(df: DataFrame, column: str, id_col: str) -> DataFrame:
    """(id, old, new) of texts with white space at their ends, blanks aside."""
    return df.select(F.col(id_col).alias("id"), F.col(column).alias("old"), F.trim(column).alias("new")).filter("old <> new and new <> ''")


def duplicate_keys(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(key, n, first_id) of normalised keys that more than one row has; null keys aren't equal."""
    g = df.select(key.alias("key"), id_col).filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
    return g.filter("n > 1")


def safe_fix(df: DataFrame, column: str, fixed: Column, id_col: str) -> DataFrame:
    """(id, old, new) of values that a rule changes, where the new value is no blank and no other row has it or would get it."""
    x = df.select(F.col(id_col).alias("id"), F.col(column).alias("old"), fixed.alias("new")).filter("new is not null")
    # a value of many rows is one partial aggregate, and only single ones go on
    one = x.groupBy("new").agg(F.count("*").alias("n"), F.min(F.struct("id", "old")).alias("r")).filter("n = 1").select("r.id", "r.old", "new")
    return one.filter(~F.col("old").eqNullSafe(F.col("new")) & ~text.is_blank(F.col("new")))


def coverage(expected_topics: DataFrame, periods: DataFrame, existing: DataFrame) -> DataFrame:
    """(topic_id, period_start, covered) for all topics and periods; periods is a bounded calendar, existing may repeat."""
    grid = expected_topics.select("topic_id").crossJoin(F.broadcast(periods.select("period_start")))
    have = existing.select("topic_id", "period_start").distinct().withColumn("_h", F.lit(True))
    return grid.join(have, ["topic_id", "period_start"], "left").select("topic_id", "period_start", F.col("_h").isNotNull().alias("covered"))


def coverage_by(cov: DataFrame, key: str) -> DataFrame:
    return cov.groupBy(key).agg(F.count("*").alias("expected"), F.count(F.when(F.col("covered"), 1)).alias("covered"), F.count(F.when(~F.col("covered"), 1)).alias("missing"))


def period_coverage(topics: DataFrame, periods: DataFrame, stored: DataFrame) -> DataFrame:
    """Coverage of topics (topic_id) and periods (period_start) by stored periods (cluster_key or topic_id, period_start)."""
    from ..functions.text import topic_of_cluster

    topic = F.coalesce(F.col("topic_id"), F.nullif(topic_of_cluster(F.col("cluster_key")), F.lit(-1))) if "topic_id" in stored.columns else F.nullif(topic_of_cluster(F.col("cluster_key")), F.lit(-1))
    return coverage(topics, periods, stored.select(topic.alias("topic_id"), "period_start"))


def key_coverage(topics: DataFrame, periods: DataFrame, stored: DataFrame) -> DataFrame:
    """Coverage of topics and periods (period_key, period_start) by stored reports (topic_id, period_key)."""
    p = F.broadcast(periods.select("period_key", "period_start"))  # a bounded calendar
    return coverage(topics, periods, stored.join(p, "period_key").select("topic_id", "period_start"))


def coverage_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """(code, expected, covered, missing, topics_without) of coverages by name."""
    out = None
    for code, c in parts.items():
        by = c.groupBy("topic_id").agg(F.count("*").alias("e"), F.count(F.when(F.col("covered"), 1)).alias("c"))
        x = by.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("expected"), F.coalesce(F.sum("c"), F.lit(0)).alias("covered"), F.count(F.when(F.col("c") == 0, 1)).alias("topics_without"))
        x = x.select(F.lit(code).alias("code"), "expected", "covered", (F.col("expected") - F.col("covered")).alias("missing"), "topics_without")
        out = x if out is None else out.unionByName(x)
    return out


def panel_tasks(missing: DataFrame, panel: str, size: int) -> DataFrame:
    """Messages (panel, period_start, chunk, ids) for the topics (topic_id, period_start) that a panel lacks, size ids each."""
    return chunks(missing.select("topic_id", "period_start").distinct(), ["period_start"], "topic_id", size).select(F.lit(panel).alias("panel"), "period_start", "chunk", "ids")


def not_active(tasks: DataFrame, active: DataFrame) -> DataFrame:
    """Tasks (panel, period_start, ids) of which no active one has the same panel, period and set of ids."""
    on = ["panel", "period_start", "_ids"]
    return tasks.withColumn("_ids", F.array_sort("ids")).join(active.withColumn("_ids", F.array_sort("ids")).select(*on), on, "left_anti").drop("_ids")


def chunks(df: DataFrame, keys: list[str], id_col: str, size: int) -> DataFrame:
    """Ids of each group in chunks of size: keys, chunk from 0, ids. A chunk is the largest thing gathered."""
    w = Window.partitionBy(*keys).orderBy(id_col)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size)).groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
