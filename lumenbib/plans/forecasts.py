"""Forecasts as queries: the simple models in SQL form for all topics, and the full selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecasting as T
from ..operators import insights as I
from ..sources import views as V

QUERIES, SQL = {}, {}
FROM, TO = "2017-01-01", "2020-12-31"


def query(body: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if body:
            SQL[f.__name__] = V.sql(body)
        return f

    return add


_S = f"""+ s AS (SELECT o.id AS topic_id, CAST(g AS DATE) AS m, coalesce(v.works_count, 0) AS n FROM topics o CROSS JOIN generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 MONTH) x(g) LEFT JOIN v_monthly v ON v.topic_id = o.id AND v.period_start = CAST(g AS DATE)) """


def _series(spark: SparkSession, d: str) -> DataFrame:
    return I.monthly_series(V.monthly(spark, d), V.topics(spark, d), None, FROM, TO)


@query(_S + "SELECT topic_id, CAST(m + INTERVAL 12 MONTH AS DATE) AS period_start, CAST(n AS DOUBLE) AS forecast FROM s WHERE m >= DATE '2020-01-01'")
def forecast_seasonal_naive(spark, d):
    return T.forecast_with(_series(spark, d), "topic_id", "period_start", "topic_count", 12, "count", "seasonal_naive")


@query(_S + "SELECT topic_id, round(avg(n), 6) AS forecast FROM s WHERE m >= DATE '2020-07-01' GROUP BY 1")
def forecast_rolling_mean(spark, d):
    x = T.forecast_with(_series(spark, d), "topic_id", "period_start", "topic_count", 1, "count", "rolling_mean")
    return x.select("topic_id", F.round("forecast", 6).alias("forecast"))


@query(_S + ", r AS (SELECT topic_id, regr_slope(ln(1 + n), i) AS b, regr_intercept(ln(1 + n), i) AS a FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY m) - 1 AS i FROM s WHERE m >= DATE '2020-01-01') GROUP BY 1) SELECT topic_id, CAST(DATE '2020-12-01' + CAST(h AS INT) * INTERVAL 1 MONTH AS DATE) AS period_start, round(greatest(0, exp(a + 0.45 * greatest(-0.08, least(0.08, b)) * (11 + h)) - 1), 5) AS forecast FROM r CROSS JOIN generate_series(1, 6) g(h)")
def forecast_linear_trend(spark, d):
    x = T.forecast_with(_series(spark, d), "topic_id", "period_start", "topic_count", 6, "count", "linear_trend")
    return x.withColumn("forecast", F.round("forecast", 5))


@query(_S + ", p AS (SELECT topic_id, m, n AS a, lag(n, 12) OVER (PARTITION BY topic_id ORDER BY m) AS g FROM s) SELECT topic_id, round(avg(abs(a - g)), 6) AS mae, round(avg(abs(a - g) / greatest(abs(a), 1)) * 100, 6) AS mape, round(avg(2 * abs(a - g) / greatest(abs(a) + abs(g), 1)) * 100, 6) AS smape FROM p WHERE m >= DATE '2020-01-01' GROUP BY 1")
def backtest_metrics_naive(spark, d):
    x = T.backtest_with(_series(spark, d), "topic_id", "period_start", "topic_count", 12, "count", "seasonal_naive")
    return x.select("topic_id", *[F.round(c, 6).alias(c) for c in ("mae", "mape", "smape")])


_SD = "CASE WHEN e.sd > 0 THEN e.sd ELSE greatest(1.0, e.mean) END"


@query(_S + f""", w AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY m) AS h, n - lag(n) OVER (PARTITION BY topic_id ORDER BY m) AS dn FROM s WHERE m >= DATE '2020-01-01'),
e AS (SELECT topic_id, stddev_pop(dn) AS sd, avg(n) AS mean FROM w GROUP BY 1)
SELECT w.topic_id, CAST(DATE '2020-12-01' + CAST(h AS INT) * INTERVAL 1 MONTH AS DATE) AS period_start, CAST(w.n AS DOUBLE) AS forecast, round(greatest(0, w.n - 1.96 * {_SD} * sqrt(1 + (h - 1) / 12.0)), 5) AS lower, round(w.n + 1.96 * {_SD} * sqrt(1 + (h - 1) / 12.0), 5) AS upper, 'seasonal_naive' AS model_name
FROM w JOIN e ON e.topic_id = w.topic_id WHERE h <= 6""")
def forecast_short_series(spark, d):
    """The whole choice over a year of months, too few for a backtest: last year's values with an interval of the monthly changes."""
    x = T.forecast(_series(spark, d).filter("period_start >= date'2020-01-01'"), "topic_id", "period_start", "topic_count", 6, "count")
    return x.select("topic_id", "period_start", F.round("forecast", 6).alias("forecast"), F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"), "model_name")


@query(None)
def forecast_quality(spark, d):
    """The scores of the three best model families of every topic, the chosen one among them."""
    x = forecast_counts(spark, d).groupBy("topic_id").agg(F.first("quality").alias("quality"))
    return x.select("topic_id", F.posexplode("quality").alias("place", "q")).select("topic_id", "place", "q.*")


@query(None)
def forecast_counts(spark, d):
    """Six months of every topic's counts by the model that backtests best."""
    return T.forecast(_series(spark, d).filter("is_observed"), "topic_id", "period_start", "topic_count", 6, "count")


@query(None)
def forecast_shares(spark, d):
    return T.forecast(_series(spark, d).filter("is_observed"), "topic_id", "period_start", "share", 6, "share")


@query(None)
def topic_forecast(spark, d):
    """Share and count forecasts side by side; the model's name joins both."""
    c = forecast_counts(spark, d).select("topic_id", "period_start", F.col("forecast").alias("count_forecast"), F.col("model_name").alias("cm"))
    s = forecast_shares(spark, d).select("topic_id", "period_start", F.col("forecast").alias("share_forecast"), F.col("model_name").alias("sm"))
    return s.join(c, ["topic_id", "period_start"]).select("topic_id", "period_start", F.round("share_forecast", 6).alias("share_forecast"), F.round("count_forecast", 6).alias("count_forecast"), F.concat("sm", F.lit(" x "), "cm").alias("model_name"))
