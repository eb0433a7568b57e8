"""Forecasts of monthly series with rolling-origin backtests, one series per group.

A series is a few hundred months at most, so a group is small whatever the number of series; `forecast` maps groups in
Arrow batches. The models are written in numpy: ETS is additive exponential smoothing with its parameters found by
coordinate search, SARIMAX is a differenced autoregression with moving-average terms by two-stage least squares
(Hannan-Rissanen). Their numbers are those of these estimators; grid, backtest and choice follow the fixed rules below.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .parallel import spread_groups

#: Season, least points for a backtest and for SARIMAX, most SARIMAX candidates, near-tie factor, z of 95 %.
SEASON, MIN_BACKTEST, MIN_SARIMAX, MAX_SARIMAX, NEAR_TIE, Z95 = 12, 24, 36, 24, 1.05, 1.96
#: Preference of model families among near ties (fixed values).
PRIORITY = {
    "share": ["linear_trend", "ets", "sarimax", "seasonal_drift", "seasonal_naive", "rolling_mean"],
    "count": ["sarimax", "ets", "seasonal_drift", "seasonal_naive", "linear_trend", "rolling_mean"],
}
LABELS = {"sarimax": "SARIMAX", "ets": "ETS"}
SCHEMA = "period_start date, forecast double, lower double, upper double, model_name string, mae double, mape double, smape double"
QUALITY = "quality array<struct<family:string,mae:double,mape:double,smape:double,selected:boolean>>"


@dataclass(frozen=True)
class Candidate:
    family: str
    transform: str = "none"
    seasonal: bool = False
    damped: bool = False
    order: tuple[int, int, int] = (0, 0, 0)
    season_order: tuple[int, int, int] = (0, 0, 0)
    exog: bool = False

    @property
    def name(self) -> str:
        """The name as results show it (a fixed format)."""
        how = f"+{self.transform}" if self.transform != "none" else ""
        if self.family == "sarimax":
            return f"SARIMAX{self.order}{(*self.season_order, SEASON)}{how}{'+exog(q2,q4)' if self.exog else ''}"
        if self.family == "ets":
            return f"ETS{'+seasonal' if self.seasonal else ''}{'+damped' if self.damped else ''}{how}"
        return self.family


@dataclass
class Score:
    candidate: Candidate
    mae: float | None
    mape: float | None
    smape: float | None
    residual_std: float = 0.0
    extra: dict = field(default_factory=dict)


def prepare(months: pd.Series, values: pd.Series, kind: str) -> pd.Series:
    """Full months from the first to the last: counts are summed, 0 where missing and at least 0; shares are averaged, filled in between and cut to [0, 1]."""
    at = pd.to_datetime(months, errors="coerce")
    v = pd.to_numeric(values, errors="coerce").astype(float)
    ok = at.notna() & np.isfinite(v)
    if not ok.any():
        return pd.Series(dtype=float)
    s = pd.Series(v[ok].to_numpy(), index=at[ok].dt.to_period("M").dt.to_timestamp())
    s = s.groupby(level=0).sum() if kind == "count" else s.groupby(level=0).mean()
    s = s.reindex(pd.date_range(s.index.min(), s.index.max(), freq="MS"))
    return s.fillna(0.0).clip(lower=0) if kind == "count" else s.interpolate("time").ffill().bfill().clip(0, 1)


def forward(x: np.ndarray, how: str) -> np.ndarray:
    if how == "log1p":
        return np.log1p(np.maximum(x, 0))
    if how == "logit":
        p = np.clip(x, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))
    return x


def backward(y: np.ndarray, how: str) -> np.ndarray:
    y = np.clip(y, -50, 50) if how != "none" else y
    return np.expm1(y) if how == "log1p" else 1 / (1 + np.exp(-y)) if how == "logit" else y


def bounded(x: np.ndarray, kind: str) -> np.ndarray:
    return np.clip(x, 0, 1) if kind == "share" else np.maximum(x, 0)


def rolling_mean(x: np.ndarray, steps: int) -> np.ndarray:
    return np.full(steps, x[-6:].mean() if len(x) else 0.0)


def seasonal_naive(x: np.ndarray, steps: int) -> np.ndarray:
    return np.resize(x[-SEASON:], steps).astype(float) if len(x) >= SEASON else rolling_mean(x, steps)


def seasonal_drift(x: np.ndarray, steps: int, kind: str) -> np.ndarray:
    """Last year's values moved by 65 % of the change between the newest months and the same months a year before."""
    base = seasonal_naive(x, steps)
    w = min(6, SEASON, len(x) - SEASON)
    new, old = x[-w:], x[len(x) - w - SEASON : len(x) - SEASON]
    if kind == "share":
        return base + 0.65 * (new - old).mean()
    ratio = np.clip(new.mean() / max(old.mean(), 1.0), 0.65, 1.35)
    return base * (1 + 0.65 * (ratio - 1))


def linear_trend(x: np.ndarray, steps: int, kind: str) -> np.ndarray:
    """A least-squares line through the last year on the transformed scale, its slope bounded and damped."""
    if len(x) < 6:
        return rolling_mean(x, steps)
    how, limit, damp = ("log1p", 0.08, 0.45) if kind == "count" else ("logit", 0.20, 0.55)
    y = forward(x[-min(SEASON, len(x)) :], how)
    n = len(y)
    slope, intercept = np.polyfit(np.arange(n), y, 1)
    return backward(intercept + damp * np.clip(slope, -limit, limit) * np.arange(n, n + steps), how)


def _smooth(y: np.ndarray, trend: bool, season: int, a: float, b: float, g: float, phi: float, steps: int) -> tuple[float, np.ndarray]:
    """Squared one-step error, and the forecast, of additive smoothing with these parameters."""
    if season:
        first, second = y[:season].mean(), y[season : 2 * season].mean()
        level, slope, seas = first, (second - first) / season if trend else 0.0, list(y[:season] - first)
    else:
        level, slope, seas = y[0], (y[min(4, len(y) - 1)] - y[0]) / min(4, len(y) - 1) if trend else 0.0, [0.0]
    m, sse = max(season, 1), 0.0
    for t, v in enumerate(y):
        s = seas[t % m]
        ahead = level + phi * slope
        e = v - ahead - s
        sse += e * e
        level = ahead + a * e
        if trend:
            slope = phi * slope + a * b * e
        if season:
            seas[t % m] = s + g * (1 - a) * e
    damp = np.cumsum(phi ** np.arange(1, steps + 1)) if trend else np.zeros(steps)
    return sse, level + damp * slope + np.array([seas[(len(y) + h) % m] for h in range(steps)])


def ets(x: np.ndarray, steps: int, c: Candidate) -> np.ndarray:
    """Additive exponential smoothing, parameters by coordinate search over ever finer grids."""
    y = forward(x, c.transform)
    season = SEASON if c.seasonal and len(y) >= 2 * SEASON else 0
    trend = len(y) >= max(8, SEASON)
    p = {"a": 0.3, "b": 0.1, "g": 0.1, "phi": 0.95 if c.damped and trend else 1.0}
    free = ["a", *(["b"] if trend else []), *(["g"] if season else []), *(["phi"] if c.damped and trend else [])]
    best = _smooth(y, trend, season, **p, steps=0)[0]
    for step in (0.3, 0.1, 0.03):
        for _ in range(3):
            moved = False
            for k in free:
                lo, hi = (0.8, 0.98) if k == "phi" else (0.01, 0.99)
                for v in (p[k] - step, p[k] + step):
                    q = p | {k: float(np.clip(v, lo, hi))}
                    sse = _smooth(y, trend, season, **q, steps=0)[0]
                    if sse < best - 1e-12:
                        best, p, moved = sse, q, True
            if not moved:
                break
    return backward(_smooth(y, trend, season, **p, steps=steps)[1], c.transform)


def _quarters(index: pd.DatetimeIndex) -> np.ndarray:
    return np.column_stack([index.quarter == 2, index.quarter == 4]).astype(float)


def sarimax(s: pd.Series, steps: int, c: Candidate) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, lower, upper): differencing, then lags of the series and of the residuals of a long autoregression, by least squares."""
    y = forward(s.to_numpy(), c.transform)
    (p, d, q), (sp, sd, sq) = c.order, c.season_order
    diffs = [SEASON] * sd + [1] * d
    z, kept = y, []
    for lag in diffs:
        kept.append(z)
        z = z[lag:] - z[:-lag]
    ar = [*range(1, p + 1), *[SEASON * k for k in range(1, sp + 1)]]
    ma = [*range(1, q + 1), *[SEASON * k for k in range(1, sq + 1)]]
    future = pd.date_range(s.index[-1], periods=steps + 1, freq="MS")[1:]
    ex = _quarters(s.index.append(future)) if c.exog else np.zeros((len(s) + steps, 0))
    exz = ex
    for lag in diffs:
        exz = exz[lag:] - exz[:-lag]
    n = len(z)
    long = min(SEASON + 1, n // 3)
    e = np.zeros(n)
    if ma and n > 2 * long:
        a = np.column_stack([np.ones(n - long), *[z[long - i : n - i] for i in range(1, long + 1)]])
        e[long:] = z[long:] - a @ np.linalg.lstsq(a, z[long:], rcond=None)[0]
    start = max([0, *ar, *(m + long for m in ma)])
    if n - start < len(ar) + len(ma) + exz.shape[1] + 4:
        raise ValueError("too few points")
    a = np.column_stack([*([np.ones(n - start)] if not diffs else []), *[z[start - i : n - i] for i in ar], *[e[start - i : n - i] for i in ma], exz[start:n]]) if ar or ma or ex.shape[1] or not diffs else np.zeros((n - start, 0))
    ridge = 1e-3 * np.eye(a.shape[1])
    coef = np.linalg.solve(a.T @ a + ridge, a.T @ z[start:])
    sigma = float(np.std(z[start:] - a @ coef))
    zz, ee = list(z), list(e)
    for h in range(steps):
        row = [*([1.0] if not diffs else []), *[zz[-i] for i in ar], *[ee[-i] for i in ma], *exz[n + h]]
        zz.append(float(np.dot(row, coef)) if row else 0.0)
        ee.append(0.0)
    out = np.array(zz[n:])
    for lag, before in zip(reversed(diffs), reversed(kept)):
        full = list(before)
        for v in out:
            full.append(v + full[-lag])
        out = np.array(full[len(before) :])
    spread = Z95 * sigma * np.sqrt(1 + np.arange(steps) * (1 if d or sd else 0.25))
    return backward(out, c.transform), backward(out - spread, c.transform), backward(out + spread, c.transform)


def grid(n: int, kind: str) -> list[Candidate]:
    """Candidates in order: trend, drift, smoothing, naive, mean, and SARIMAX for long series."""
    how, long = ("logit" if kind == "share" else "log1p"), n >= 2 * SEASON
    out = [Candidate("linear_trend", how), *([Candidate("seasonal_drift")] if long else []), Candidate("ets", how), Candidate("ets", how, long, True)]
    out += [Candidate("ets", "none", long, True)] if kind == "count" else []
    out += [Candidate("seasonal_naive"), Candidate("rolling_mean")]
    if n >= MIN_SARIMAX:
        orders = [(0, 1, 1), (1, 1, 0), (1, 1, 1), (1, 0, 1)]
        seasons = [(0, 1, 1), (1, 1, 0), (0, 0, 1), (1, 0, 1)]
        out += [Candidate("sarimax", how, order=o, season_order=s, exog=x) for o in orders for s in seasons for x in (True, False)][:MAX_SARIMAX]
    return out


def can_fit(c: Candidate, n: int) -> bool:
    least = {"linear_trend": 6, "seasonal_drift": 2 * SEASON, "ets": 2 * SEASON if c.seasonal else 4, "sarimax": MIN_SARIMAX}
    return n >= least.get(c.family, 1)


def splits(n: int, horizon: int) -> list[tuple[int, int]]:
    """(end of training, end of validation) of up to four folds, the newest last."""
    v = int(np.clip(horizon, 3, 12))
    least = max(SEASON + v, MIN_BACKTEST - v)
    ends = [n - v * k for k in range(1, 5) if n - v * k >= least]
    return [(e, e + v) for e in reversed(ends)]


def metrics(actual: np.ndarray, predicted: np.ndarray, kind: str) -> tuple[float, float, float]:
    """(MAE, MAPE, SMAPE); denominators are at least 1 for counts and 0.01 for shares."""
    e, g = np.abs(actual - predicted), 1.0 if kind == "count" else 0.01
    a = np.abs(actual)
    return float(e.mean()), float((e / np.maximum(a, g)).mean() * 100), float((2 * e / np.maximum(a + np.abs(predicted), g)).mean() * 100)


def default_std(x: np.ndarray, kind: str) -> float:
    """Spread of yearly differences, of monthly ones for a short series, with a floor where there is none."""
    std = float(np.std(x[SEASON:] - x[:-SEASON])) if len(x) > SEASON else float(np.std(np.diff(x))) if len(x) > 1 else float(abs(x[0])) if len(x) else 0.0
    return std if np.isfinite(std) and std > 0 else 0.05 if kind == "share" else max(1.0, float(x.mean()) if len(x) else 1.0)


def predict(s: pd.Series, steps: int, c: Candidate, kind: str) -> np.ndarray:
    x = s.to_numpy()
    models: dict[str, Callable[[], np.ndarray]] = {
        "linear_trend": lambda: linear_trend(x, steps, kind),
        "seasonal_drift": lambda: seasonal_drift(x, steps, kind),
        "ets": lambda: ets(x, steps, c),
        "seasonal_naive": lambda: seasonal_naive(x, steps),
        "rolling_mean": lambda: rolling_mean(x, steps),
        "sarimax": lambda: sarimax(s, steps, c)[0],
    }
    return bounded(models[c.family](), kind)


def backtest(s: pd.Series, c: Candidate, folds: list[tuple[int, int]], kind: str) -> Score | None:
    """Mean errors over the folds; None if the candidate can't be fitted on one of them."""
    out, rest = [], []
    for end, stop in folds:
        if not can_fit(c, end):
            return None
        try:
            guess = predict(s.iloc[:end], stop - end, c, kind)
        except (ValueError, np.linalg.LinAlgError):
            return None
        if not np.isfinite(guess).all():
            return None
        out.append(metrics(s.to_numpy()[end:stop], guess, kind))
        rest.append(s.to_numpy()[end:stop] - guess)
    mae, mape, smape = np.mean(out, axis=0)
    std = float(np.std(np.concatenate(rest)))
    return Score(c, float(mae), float(mape), float(smape), std if std > 0 else default_std(s.to_numpy(), kind))


def primary_error(x: Score, kind: str) -> float:
    v = x.mae if kind == "share" else x.smape
    return float(v) if v is not None and np.isfinite(v) else float("inf")


def complexity(c: Candidate) -> int:
    if c.family == "sarimax":
        return 10 + sum(c.order) + sum(c.season_order) + 2 * c.exog
    return {"ets": 5 + c.seasonal + c.damped, "seasonal_naive": 2}.get(c.family, 1)


def select(s: pd.Series, kind: str, horizon: int) -> tuple[Score, list[Score]]:
    """(chosen, all scores): among near ties of the least error the preferred family, then the smaller error, then the simpler model."""
    folds = splits(len(s), horizon) if len(s) >= MIN_BACKTEST else []
    scores = [x for c in grid(len(s), kind) for x in [backtest(s, c, folds, kind)] if x] if folds else []
    finite = [x for x in scores if np.isfinite(primary_error(x, kind))]
    if not finite:
        c = Candidate("seasonal_naive" if len(s) >= SEASON else "rolling_mean")
        return Score(c, None, None, None, default_std(s.to_numpy(), kind)), scores
    limit = min(primary_error(x, kind) for x in finite) * NEAR_TIE
    near = [x for x in finite if primary_error(x, kind) <= limit]
    return min(near, key=lambda x: (PRIORITY[kind].index(x.candidate.family), primary_error(x, kind), complexity(x.candidate))), scores


def quality(scores: list[Score], kind: str, chosen: Score | None = None) -> list[dict]:
    """The best score of each family, the three best families; the chosen one takes the last place if it isn't among them."""
    best: dict[str, Score] = {}
    for x in scores:
        if None in (x.mae, x.mape, x.smape) or not np.isfinite([x.mae, x.mape, x.smape]).all():
            continue
        f = x.candidate.family
        if f not in best or primary_error(x, kind) < primary_error(best[f], kind):
            best[f] = x
    top = sorted(best.values(), key=lambda x: (primary_error(x, kind), PRIORITY[kind].index(x.candidate.family)))[:3]
    if chosen and chosen.candidate.family not in [x.candidate.family for x in top]:
        top = [*top[:2], best.get(chosen.candidate.family, chosen)]
    return [{"family": LABELS.get(x.candidate.family, x.candidate.family), "mae": x.mae, "mape": x.mape, "smape": x.smape, "selected": chosen is not None and x.candidate.family == chosen.candidate.family} for x in top]


def forecast_series(months: pd.Series, values: pd.Series, horizon: int, kind: str) -> tuple[pd.DataFrame, list[dict]]:
    """(rows of SCHEMA, quality) of one series; nothing for an empty series or a horizon of 0."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    s = prepare(months, values, kind)
    if horizon <= 0 or not len(s):
        return pd.DataFrame(columns=columns), []
    chosen, scores = select(s, kind, horizon)
    c = chosen.candidate
    if c.family == "sarimax":
        mean, low, high = (bounded(x, kind) for x in sarimax(s, horizon, c))
    else:
        mean = predict(s, horizon, c, kind)
        spread = Z95 * chosen.residual_std * np.sqrt(1 + np.arange(horizon) / SEASON)
        low, high = bounded(mean - spread, kind), bounded(mean + spread, kind)
    at = pd.date_range(s.index[-1], periods=horizon + 1, freq="MS")[1:]
    rows = pd.DataFrame({"period_start": at.date, "forecast": mean, "lower": low, "upper": high})
    return rows.assign(model_name=c.name, mae=chosen.mae, mape=chosen.mape, smape=chosen.smape)[columns], quality(scores, kind, chosen)


def _kind(kind: str) -> str:
    if kind not in PRIORITY:
        raise ValueError(f"kind must be count or share: {kind}")
    return kind


def forecast(df: DataFrame, key: str, month: str, value: str, horizon: int, kind: str) -> DataFrame:
    """Forecast rows of every series of df: key, SCHEMA and QUALITY, the scores of the three best model families and the chosen one.

    Rows with a null month or value are left out; a null key is a series.
    """
    _kind(kind)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        rows, scores = forecast_series(g[month], g[value], horizon, kind)
        rows.insert(0, key, g[key].iloc[0])
        return rows.astype({"mae": float, "mape": float, "smape": float}).assign(quality=pd.Series([scores] * len(rows), index=rows.index, dtype=object))

    return spread_groups(df.select(key, month, value), key).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, {SCHEMA}, {QUALITY}")


def forecast_with(df: DataFrame, key: str, month: str, value: str, horizon: int, kind: str, family: str) -> DataFrame:
    """(key, period_start, forecast) of every series by one model family, without a choice; families that can't be fitted on a series give it no rows."""
    c = Candidate(family, {"linear_trend": {"count": "log1p", "share": "logit"}[_kind(kind)]}.get(family, "none"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        s = prepare(g[month], g[value], kind)
        if horizon <= 0 or not can_fit(c, len(s)) or not len(s):
            return pd.DataFrame({key: [], "period_start": [], "forecast": []})
        at = pd.date_range(s.index[-1], periods=horizon + 1, freq="MS")[1:]
        return pd.DataFrame({key: g[key].iloc[0], "period_start": at.date, "forecast": predict(s, horizon, c, kind)})

    return spread_groups(df.select(key, month, value), key).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, period_start date, forecast double")


def backtest_with(df: DataFrame, key: str, month: str, value: str, last: int, kind: str, family: str) -> DataFrame:
    """(key, mae, mape, smape) of every series: the errors of one model family on its last months, fitted on those before."""
    c = Candidate(family)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        s = prepare(g[month], g[value], kind)
        score = backtest(s, c, [(len(s) - last, len(s))], kind) if len(s) > last else None
        return pd.DataFrame([(g[key].iloc[0], score.mae, score.mape, score.smape)] if score else [], columns=[key, "mae", "mape", "smape"])

    return spread_groups(df.select(key, month, value), key).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, mae double, mape double, smape double")
