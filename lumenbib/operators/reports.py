"""Quarter reports of topics: what a text model is given, what is taken from its answer, and the tables that are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import replace_children
from .merge import merge

#: Kinds of a report's items and stages they can be in (fixed values).
ITEM_TYPES = ["research_problem", "method", "approach", "future_direction"]
MATURITY = ["emerging", "growing", "stable", "declining", "mature"]
ROLES = ["representative", "highly_cited"]
ANSWER = "struct<summary:string, period_characterization:string, dynamics_summary:string, future_dynamics:string, items:array<struct<item_type:string, title:string, description:string, maturity:string, sort_order:int>>>"


def prompt_payload(metrics: DataFrame, keywords: DataFrame, papers: DataFrame) -> DataFrame:
    """(topic_id, period_key, payload): the JSON a text model is given: metrics, keyword dynamics and representative papers of the topic's quarter.

    Each table has keys topic_id and period_key, one row a report; the rest of its columns is its part of the payload.
    """
    keys = ["topic_id", "period_key"]
    part = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    x = part(metrics, "metrics").join(part(keywords, "keyword_dynamics"), keys, "left").join(part(papers, "representative_papers"), keys, "left")
    return x.select(*keys, F.to_json(F.struct("metrics", "keyword_dynamics", "representative_papers")).alias("payload"))


def due(payloads: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Payloads of reports that aren't stored yet, or of all if forced."""
    return payloads if force else payloads.join(stored.select("topic_id", "period_key"), ["topic_id", "period_key"], "left_anti")


def answer(payloads: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """payloads with answer: what generate makes of batches of payloads, in the executors; one answer for each, or the job fails."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = generate(list(s))
            if len(out) != len(s):
                raise ValueError(f"{len(out)} answers to {len(s)} prompts")
            yield pd.Series(out, dtype=object)

    return payloads.withColumn("answer", run.asNondeterministic()("payload"))


def parsed(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, items) of answers (topic_id, period_key, answer): answers that are no JSON, or lack a summary, give neither.

    Items need a known type, a title and, if they have one, a known maturity; others are left out. Without a sort_order an
    item has its place from 0.
    """
    a = answers.withColumn("a", F.from_json("answer", ANSWER)).filter(F.length(F.trim("a.summary")) > 0)
    reports = a.select("topic_id", "period_key", *[F.col(f"a.{c}").alias(c) for c in ("summary", "period_characterization", "dynamics_summary", "future_dynamics")])
    i = a.select("topic_id", "period_key", F.posexplode("a.items").alias("place", "i")).filter("i is not null")
    ok = F.col("i.item_type").isin(ITEM_TYPES) & (F.length(F.trim("i.title")) > 0) & (F.col("i.maturity").isNull() | F.col("i.maturity").isin(MATURITY))
    items = i.filter(F.coalesce(ok, F.lit(False))).select("topic_id", "period_key", "i.item_type", "i.title", "i.description", "i.maturity", F.coalesce("i.sort_order", "place").alias("sort_order"))
    return reports, items


def paper_links(papers: DataFrame) -> DataFrame:
    """(topic_id, period_key, paper_id, role, score) of papers (…, paper_id, roles, score); a role that reports don't know makes no link."""
    x = papers.select("topic_id", "period_key", "paper_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.explode("roles").alias("role"))
    return x.filter(F.col("role").isin(ROLES)).select("topic_id", "period_key", "paper_id", "role", "score")


def upsert_reports(stored: dict[str, DataFrame], reports: DataFrame, items: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Tables reports, items and links after an upsert: reports by (topic_id, period_key) with change, children of those replaced."""
    keys = ["topic_id", "period_key"]
    return {
        "reports": merge(stored["reports"], reports, keys, {c: "overwrite" for c in stored["reports"].columns if c not in keys}),
        "items": replace_children(stored["items"], reports, items, keys),
        "links": replace_children(stored["links"], reports, links, keys),
    }


def full_reports(tables: dict[str, DataFrame]) -> DataFrame:
    """Reports with their items, in order, and papers as nested arrays; a report has few of both."""
    keys = ["topic_id", "period_key"]
    item = F.struct("sort_order", "item_type", "title", "description", "maturity")
    i = tables["items"].groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    p = tables["links"].groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("role", "paper_id", "score"))).alias("papers"))
    return tables["reports"].join(i, keys, "left").join(p, keys, "left")
