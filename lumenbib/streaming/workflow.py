"""Workflows of coverage panels: stages in order, what each still lacks, and the messages that fill it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from .queue import QUEUES, advance

#: Panels and the task that fills each (fixed values).
PANELS = {
    "monthly-stats": "collect_topic_stats",
    "sample-papers": "bootstrap_papers",
    "indexing": "paper_indexing",
    "keyphrases": "keyword_extraction",
    "cluster-dynamics": "cluster_dynamics_recompute",
    "quarter-reports": "topic_quarter_report",
}
#: Stages of the workflows that can be started (fixed values).
PRESETS = {
    "load-and-index": ["monthly-stats", "sample-papers", "indexing"],
    "analytics": ["cluster-dynamics", "keyphrases", "quarter-reports"],
    "full": ["monthly-stats", "sample-papers", "indexing", "cluster-dynamics", "keyphrases", "quarter-reports"],
}
STALE_HOURS = 24


def covered_topics(papers: DataFrame, monthly: DataFrame, periods: DataFrame, reports: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """(panel, topic_id): topics that each of the six panels has something for in the period.

    papers (primary_topic_id, publication_date, is_indexed, extracted_keywords), monthly (topic_id, period_start), periods
    and reports (topic_id, period_start, period_end), of which an overlap is enough. Papers are read once for three panels.
    """
    a, b = F.to_date(F.lit(date_from)), F.to_date(F.lit(date_to))
    p = papers.filter(F.col("publication_date").between(a, b) & F.col("primary_topic_id").isNotNull())
    named = F.array_compact(F.array(F.lit("sample-papers"), F.when(F.col("is_indexed"), "indexing"), F.when(F.size("extracted_keywords") > 0, "keyphrases")))
    out = p.select(F.explode(named).alias("panel"), F.col("primary_topic_id").alias("topic_id")).distinct()
    out = out.unionByName(monthly.filter(F.col("period_start") == a).select(F.lit("monthly-stats").alias("panel"), "topic_id").distinct())
    for panel, df in (("cluster-dynamics", periods), ("quarter-reports", reports)):
        out = out.unionByName(df.filter((F.col("period_start") <= b) & (F.col("period_end") >= a)).select(F.lit(panel).alias("panel"), "topic_id").distinct())
    return out


def missing_topics(topics: DataFrame, covered: DataFrame, exhausted: DataFrame | None = None) -> DataFrame:
    """(panel, topic_id) that a panel has nothing for; topics (topic_id) whose samples are exhausted count as covered there."""
    grid = topics.select("topic_id").crossJoin(F.broadcast(topics.sparkSession.createDataFrame([(p,) for p in PANELS], "panel string")))  # six panels
    have = covered.select("panel", "topic_id")
    if exhausted is not None:
        have = have.unionByName(exhausted.select(F.lit("sample-papers").alias("panel"), "topic_id"))
    return grid.join(have, ["panel", "topic_id"], "left_anti").select("panel", "topic_id")


def messages(missing: DataFrame, panel: str, date_from: str, date_to: str, size: int, active: DataFrame | None = None) -> DataFrame:
    """Messages (queue, task_type, ids, options) for what a panel lacks, unless one with the same panel, period and ids is active."""
    if panel not in PANELS:
        raise ValueError(f"unknown panel: {panel}")
    m = missing.filter(F.col("panel") == panel).select("topic_id", F.lit(date_from).alias("period_start"))
    t = quality.panel_tasks(m, panel, size)
    if active is not None:
        t = quality.not_active(t, active)
    options = F.to_json(F.struct(F.lit(panel).alias("panel"), F.lit(date_from).alias("date_from"), F.lit(date_to).alias("date_to")))
    return t.select(F.lit(QUEUES[PANELS[panel]]).alias("queue"), F.lit(PANELS[panel]).alias("task_type"), "ids", options.alias("options"))


def stage_states(tasks: DataFrame, now: str) -> dict[str, str]:
    """State of each stage by its tasks (panel, state, updated_at): failed before stale before running before done; a stage of an unknown state is running."""
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("updated_at")
    open_ = ~F.col("state").isin("done", "failed")
    g = tasks.groupBy("panel").agg(F.max(F.col("state") == "failed").alias("f"), F.max(open_ & (age > STALE_HOURS * 3600)).alias("s"), F.max(open_).alias("r"))
    return {r["panel"]: "failed" if r["f"] else "stale" if r["s"] else "running" if r["r"] else "done" for r in g.collect()}  # a row a panel


def step(preset: str, tasks: DataFrame, missing: DataFrame, now: str) -> tuple[str, str | None]:
    """(state, stage) that a workflow goes to; see `queue.advance`."""
    lacks = {r["panel"]: r["count"] for r in missing.groupBy("panel").count().collect()}  # a row a panel
    return advance(PRESETS[preset], stage_states(tasks, now), lacks)
