"""Periods as column expressions and as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def period_start(d: Column, granularity: str) -> Column:
    """First day of the week (Monday), month, quarter or year."""
    if granularity not in ("week", "month", "quarter", "year"):
        raise ValueError(f"unknown granularity: {granularity}")
    return F.date_trunc(granularity, d).cast("date")


def quarter_key(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def _days(spark: SparkSession, start: str, end: str) -> DataFrame:
    if start > end:
        raise ValueError("the start lies after the end")
    return spark.range(1).select(F.to_date(F.lit(start)).alias("a"), F.to_date(F.lit(end)).alias("b"))


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(period_start, period_end) of every whole month that touches start..end."""
    s = _days(spark, start, end).select(F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("period_start"))
    return s.select("period_start", F.last_day("period_start").alias("period_end"))


def quarters(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(period_key, period_start, period_end) of every whole quarter that touches start..end."""
    s = _days(spark, start, end).select(F.explode(F.sequence(F.trunc("a", "QUARTER"), F.trunc("b", "QUARTER"), F.expr("interval 3 month"))).alias("period_start"))
    return s.select(quarter_key(F.col("period_start")).alias("period_key"), "period_start", F.date_sub(F.add_months("period_start", 3), 1).alias("period_end"))


def load_periods(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Months cut to start..end; January begins on its 2nd, as the 1st stands for dates that aren't known."""
    d = _days(spark, start, end)
    m = months(spark, start, end).crossJoin(F.broadcast(d))  # d is one row
    first = F.when(F.month("period_start") == 1, F.date_add("period_start", 1)).otherwise(F.col("period_start"))
    out = m.select(F.greatest(first, F.col("a")).alias("period_start"), F.least(F.col("period_end"), F.col("b")).alias("period_end"))
    return out.filter("period_start <= period_end")


def windows(spark: SparkSession, start: str, end: str, granularity: str) -> DataFrame:
    """(window_start, window_end, effective_from, effective_to): weeks or months that touch start..end, and their part in it."""
    step = {"week": "interval 7 days", "month": "interval 1 month"}.get(granularity)
    if step is None:
        raise ValueError(f"unknown granularity: {granularity}")
    d = _days(spark, start, end)
    s = d.select("a", "b", F.explode(F.sequence(period_start(F.col("a"), granularity), period_start(F.col("b"), granularity), F.expr(step))).alias("window_start"))
    last = F.date_add("window_start", 6) if granularity == "week" else F.last_day("window_start")
    s = s.withColumn("window_end", last)
    return s.select("window_start", "window_end", F.greatest("window_start", "a").alias("effective_from"), F.least("window_end", "b").alias("effective_to"))
