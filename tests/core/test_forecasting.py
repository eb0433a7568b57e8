import numpy as np
import pandas as pd

from lumenbib.operators import forecasting as T


def S(family, mae, mape, smape):
    return T.Score(T.Candidate(family), mae, mape, smape)


def names(x):
    return [q["family"] for q in x]


def test_quality_ranking():
    scores = [S("sarimax", 4, 8, 7), S("sarimax", 3, 6, 5), S("ets", 2, 5, 4), S("rolling_mean", 6, 10, 9), S("linear_trend", 5, 9, 8)]
    q = T.quality(scores, "count")
    assert names(q) == ["ETS", "SARIMAX", "linear_trend"] and q[1]["smape"] == 5
    assert names(T.quality([S("ets", 0.10, 4, 3), S("linear_trend", 0.02, 8, 7), S("rolling_mean", 0.05, 2, 1)], "share")) == ["linear_trend", "rolling_mean", "ETS"]
    plain = S("rolling_mean", None, None, None)
    q = T.quality([plain], "count", plain)
    assert len(q) == 1 and q[0]["selected"]
    chosen = S("rolling_mean", 6, 10, 9)
    q = T.quality([S("ets", 2, 5, 4), S("sarimax", 3, 6, 5), S("linear_trend", 5, 9, 8), chosen], "count", chosen)
    assert len(q) == 3 and q[-1]["family"] == "rolling_mean" and q[-1]["selected"]


def test_short_series():
    rows, _ = T.forecast_series(pd.Series(pd.date_range("2025-01-01", periods=3, freq="MS")), pd.Series([2, 3, 4]), 2, "count")
    assert rows["model_name"].tolist() == ["rolling_mean"] * 2
    assert rows["forecast"].tolist() == [3, 3] and rows["lower"].tolist() == [0, 0]
    # three months are too few for a difference of years: the floor of the spread is the mean
    assert np.allclose(rows["upper"], [8.88, 9.120098], atol=1e-6)
    assert T.forecast_series(pd.Series([], dtype="datetime64[ns]"), pd.Series([], dtype=float), 3, "count")[0].empty


def test_folds_and_grid():
    assert T.splits(36, 6) == [(18, 24), (24, 30), (30, 36)]
    assert sum(c.family == "sarimax" for c in T.grid(48, "count")) == 24 and not any(c.family == "sarimax" for c in T.grid(30, "count"))
    assert T.metrics(np.array([0.0, 10.0]), np.array([1.0, 8.0]), "count")[0] == 1.5


def test_seasonal_series_is_learnt():
    m = pd.Series(pd.date_range("2018-01-01", periods=60, freq="MS"))
    v = pd.Series(50 + 20 * np.sin(np.arange(60) * np.pi / 6))
    rows, q = T.forecast_series(m, v, 6, "count")
    want = 50 + 20 * np.sin(np.arange(60, 66) * np.pi / 6)
    assert np.abs(rows["forecast"] - want).max() < 6 and (rows["lower"] <= rows["forecast"]).all() and (rows["forecast"] <= rows["upper"]).all() and len(q) == 3


def test_grouped(spark):
    m = pd.DataFrame({"k": [1] * 3 + [2] * 3, "m": pd.date_range("2025-01-01", periods=3, freq="MS").tolist() * 2, "v": [2.0, 3, 4, None, 1, 1]})
    df = spark.createDataFrame(m).selectExpr("k", "cast(m as date) m", "v")
    got = T.forecast(df, "k", "m", "v", 2, "count").collect()
    assert len(got) == 4 and {r["k"] for r in got} == {1, 2} and all([q["family"] for q in r["quality"]] == ["rolling_mean"] for r in got)
    assert T.forecast(df.limit(0), "k", "m", "v", 2, "count").count() == 0


def test_names_are_the_contract():
    assert T.Candidate("ets", "log1p", True, True).name == "ETS+seasonal+damped+log1p" and T.Candidate("ets", damped=True).name == "ETS+damped"
    assert T.Candidate("sarimax", "log1p", order=(1, 1, 0), season_order=(0, 1, 1), exog=True).name == "SARIMAX(1, 1, 0)(0, 1, 1, 12)+log1p+exog(q2,q4)"
    assert T.Candidate("linear_trend", "logit").name == "linear_trend"
