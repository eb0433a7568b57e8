"""Command line: `python -m lumenbib.cli <group> <command> …`; every command prints JSON or writes a table.

Groups: data (validate, coverage, stats, january), ml (clusters, periods, profiles, keyphrases, forecast, recommend,
insights), tasks (failed, restore), worker (run).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import clusters, forecasting, insights, keyphrases, papers, quality, stats
from .session import build_session, ship
from .sources import views as V
from .streaming import queue

#: Checks of the papers table: code -> (description, condition of failure).
CHECKS = {
    "missing_title": ("papers without a title", "title IS NULL OR length(trim(title)) = 0"),
    "missing_doi": ("papers without a DOI", "doi IS NULL OR length(trim(doi)) = 0"),
    "missing_abstract": ("papers without an abstract", "abstract IS NULL OR length(trim(abstract)) = 0"),
    "missing_language": ("papers without a language", "language IS NULL OR length(trim(language)) = 0"),
    "missing_date": ("papers without a date", "publication_date IS NULL"),
    "year_differs": ("years other than that of the date", "publication_date IS NOT NULL AND publication_year <> year(publication_date)"),
    "negative_citations": ("citations below zero", "cited_by_count < 0"),
    "missing_primary_topic": ("papers without a primary topic", "primary_topic_id IS NULL"),
    "no_keywords": ("papers without keywords", "extracted_keywords IS NULL"),
    "untrimmed_title": ("titles with white space at an end", "title <> trim(title)"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenbib")
    p.add_argument("--data", required=True, help="directory of <table>.parquet")
    p.add_argument("--out", help="directory to write the result to; without it at most --show rows are printed")
    p.add_argument("--show", type=int, default=20)
    g = p.add_subparsers(dest="group", required=True)

    def command(group: str, name: str, **options) -> None:
        if group not in groups:
            groups[group] = g.add_parser(group).add_subparsers(dest="command", required=True)
        c = groups[group].add_parser(name)
        for k, v in options.items():
            kind = {"type": type(v)} if v is not None else {}
            c.add_argument(f"--{k.replace('_', '-')}", default=v, required=v is None, **kind)

    groups: dict = {}
    span = {"date_from": None, "date_to": None}
    command("data", "validate", sample=5)
    command("data", "coverage", **span)
    command("data", "stats", **span, granularity="month")
    command("data", "january", min_estimate=1)
    command("ml", "clusters", as_of=None)
    command("ml", "periods", **span, granularity="month")
    command("ml", "profiles")
    command("ml", "keyphrases", top_k=10)
    command("ml", "forecast", **span, horizon=6, kind="count")
    command("ml", "recommend", user=0, as_of=None, limit=20)
    command("ml", "trending", **span, limit=20)
    command("ml", "insights", topic=0, **span)
    command("tasks", "failed", letters=None)
    command("tasks", "restore", letters=None, queue="", error="")
    command("worker", "run", inbox=None, checkpoint=None, results=None)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | dict | None:
    d, what = a.data, (a.group, a.command)
    if what == ("data", "validate"):
        return quality.described(V.papers(spark, d), {k: (t, F.expr(c)) for k, (t, c) in CHECKS.items()}, "id", a.sample)
    if what == ("data", "coverage"):
        return api.analyze_coverage(spark, d, a.date_from, a.date_to)["summary"]
    if what == ("data", "stats"):
        return stats.rollup_periods(V.monthly(spark, d), V.topics(spark, d), a.date_from, a.date_to, a.granularity)
    if what == ("data", "january"):
        x = stats.january_counts(V.papers(spark, d, "id", "publication_date"), V.paper_topics(spark, d))
        return x.filter(F.col("artificial") >= a.min_estimate).orderBy(F.desc("artificial"), "stat_year", "topic_id")
    if what == ("ml", "clusters"):
        return api.recompute_clusters(spark, d, a.as_of)
    if what == ("ml", "periods"):
        return api.recompute_periods(spark, d, a.date_from, a.date_to, a.granularity)
    if what == ("ml", "profiles"):
        return api.profile_points(spark, d)
    if what == ("ml", "keyphrases"):
        return keyphrases.extract_papers(V.papers(spark, d, "id", "title", "abstract", "language"), a.top_k)[0]
    if what == ("ml", "forecast"):
        s = insights.monthly_series(V.monthly(spark, d), V.topics(spark, d), None, a.date_from, a.date_to).filter("is_observed")
        return forecasting.forecast(s, "topic_id", "period_start", "topic_count" if a.kind == "count" else "share", a.horizon, a.kind)
    if what == ("ml", "recommend"):
        return api.recommend_papers(spark, d, a.user, a.as_of, a.limit)
    if what == ("ml", "trending"):
        return papers.recent_growth(V.papers(spark, d, "id", "publication_date"), V.paper_topics(spark, d), a.date_from, a.date_to, a.limit)
    if what == ("ml", "insights"):
        return api.topic_insights(spark, d, a.topic, a.date_from, a.date_to)
    if what == ("tasks", "failed"):
        return spark.read.parquet(a.letters).groupBy("source_queue", "error").agg(F.count("*").alias("n"))
    if what == ("tasks", "restore"):
        return queue.restore_failed(spark.read.parquet(a.letters), a.queue or None, a.error or None)
    handlers = {"recompute_topic_clusters": _recompute(spark, d)}
    api.worker(spark, a.inbox, a.checkpoint, handlers, a.results)
    return {"done": True}


def _recompute(spark: SparkSession, d: str):
    """A handler that recomputes the metrics of a message's topics; unknown topics are its error."""

    def handle(messages: DataFrame) -> DataFrame:
        p, links = V.papers(spark, d, "id", "publication_date", "cited_by_count"), V.paper_topics(spark, d)
        known = clusters.metrics(p, links, "2100-01-01").select(F.col("topic_id").alias("_id"), F.lit(True).alias("_ok"))
        each = messages.select("task_id", "part", F.explode("ids").alias("_id")).join(known, "_id", "left")
        bad = each.filter("_ok is null").groupBy("task_id", "part").agg(F.count("*").alias("_n"))
        return messages.join(bad, ["task_id", "part"], "left").withColumn("error", F.when(F.col("_n") > 0, F.concat(F.col("_n").cast("string"), F.lit(" unknown topics")))).drop("_n")

    return handle


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or build_session("lumenbib")
    ship(spark)
    got = run(spark, a)
    parts = {k: v for k, v in got.items() if isinstance(v, DataFrame)} if isinstance(got, dict) else {"": got}
    for name, df in parts.items():
        if a.out:
            df.write.mode("overwrite").parquet(f"{a.out}/{name}" if name else a.out)
        else:
            for row in df.limit(a.show).toJSON().collect():
                print(row)
    if isinstance(got, dict) and not parts:
        print(json.dumps(got))
    return 0


if __name__ == "__main__":
    sys.exit(main())
