"""Work records from a feed: landed JSON files, or pages fetched by a callable that the caller gives."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import backoff_seconds

PAGES = "unit string, page bigint, status string, attempts int, records array<string>, error string"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(raw): the lines of JSON files, one record each; what can't be read is dealt with where it is parsed."""
    return spark.read.text(path).select(F.col("value").alias("raw")).filter("raw is not null and trim(raw) <> ''")


class RateLimited(Exception):
    """The feed asks to wait; retry_after is in seconds."""

    def __init__(self, retry_after: float | None = None):
        super().__init__("rate limited")
        self.retry_after = retry_after


def fetch_pages(pages: DataFrame, fetch: Callable[[str, int], list[dict] | None], retries: int = 5, most_wait: float = 30.0, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """pages (unit, page) -> PAGES: what fetch(unit, page) gives for each, tried again after a pause when it fails.

    status is ok, missing (fetch gave None), exhausted (no records), deferred (asked to wait longer than most_wait, to be
    resumed) or failed (with the last error). A page that fails doesn't fail the job. Pages are fetched where they lie:
    their partitions are how many are fetched at a time.
    """

    def one(unit: str, page: int) -> tuple:
        error = ""
        for n in range(retries + 1):
            try:
                got = fetch(unit, page)
            except RateLimited as e:
                if e.retry_after is not None and e.retry_after > most_wait:
                    return unit, page, "deferred", n + 1, [], "rate limited"
                error = "rate limited"
                wait(backoff_seconds(n, e.retry_after, most_wait))
            except Exception as e:  # noqa: BLE001 - one page must not fail the job
                error = f"{type(e).__name__}: {e}"
                wait(backoff_seconds(n, None, most_wait))
            else:
                status = "missing" if got is None else "ok" if got else "exhausted"
                return unit, page, status, n + 1, [json.dumps(r, ensure_ascii=False) for r in got or []], None
        return unit, page, "failed", retries + 1, [], error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(u, int(p)) for u, p in zip(b["unit"], b["page"])], columns=["unit", "page", "status", "attempts", "records", "error"])

    return pages.select(F.col("unit").cast("string").alias("unit"), F.col("page").cast("bigint").alias("page")).mapInPandas(run, PAGES)


def fetched_records(fetched: DataFrame) -> DataFrame:
    """(unit, raw): the records of pages that came."""
    return fetched.filter("status = 'ok'").select("unit", F.explode("records").alias("raw"))
