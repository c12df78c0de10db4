"""Structural breaks and stationarity."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.mathx import norm_cdf, ols
from tickloom.keys import IDX, SYMBOL, ratio, series


def chow(bars: DataFrame, min_length: int, log: bool = True) -> DataFrame:
    """Dickey-Fuller test of Chow's type at each bar that leaves ``min_length`` on either side, from sums of what follows."""
    y = F.ln("close") if log else F.col("close")
    d = bars.withColumn("y", y).withColumns({"x": F.lag(y).over(series()), "n": F.count("*").over(Window.partitionBy(SYMBOL))}).where("x is not null").withColumn("dy", F.col("y") - F.col("x"))
    after = Window.partitionBy(SYMBOL).orderBy(IDX).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(SYMBOL)
    d = d.withColumns({"sxx": F.sum(F.col("x") * F.col("x")).over(after), "sxy": F.sum(F.col("x") * F.col("dy")).over(after), "syy": F.sum(F.col("dy") * F.col("dy")).over(whole), "rows": F.count("*").over(whole)})
    beta = F.col("sxy") / F.col("sxx")
    var = (F.col("syy") - beta * F.col("sxy")) / (F.col("rows") - 1) / F.col("sxx")
    return d.where((F.col(IDX) >= min_length) & (F.col(IDX) < F.col("n") - min_length)).select(SYMBOL, "ts", IDX, (beta / F.sqrt(var)).alias("dfc"))


def chu_stinchcombe_white(bars: DataFrame, one_sided: bool = True, log: bool = True, standardised: bool = False) -> DataFrame:
    """The largest scaled departure of each bar from any bar before, and its critical value.

    Departures are divided by the variance and the root of the distance; ``standardised``: by the root
    of both, as in the textbook. Each bar meets all before it, by definition; one symbol's series goes
    to one task, which keeps a row of departures at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        y = np.log(pdf["close"].to_numpy()) if log else pdf["close"].to_numpy(float)
        squares = np.cumsum(np.diff(y) ** 2)
        stat, crit = [None] * min(2, len(y)), [None] * min(2, len(y))
        for t in range(2, len(y)):
            variance = squares[t - 1] / (t - 1)
            gap = np.arange(t, 0, -1)
            diff = y[t] - y[:t]
            scale = np.sqrt(variance * gap) if standardised else variance * np.sqrt(gap)
            value = (diff if one_sided else np.abs(diff)) / scale if variance > 0 else np.zeros(t)
            k = int(value.argmax())
            stat.append(float(value[k]))
            crit.append(float(np.sqrt(4.6 + np.log(gap[k]))))
        return pdf[[SYMBOL, "ts", IDX]].assign(stat=stat, critical=crit)

    return bars.select(SYMBOL, "ts", IDX, "close").groupBy(SYMBOL).applyInPandas(run, f"{SYMBOL} string, ts timestamp, {IDX} long, stat double, critical double")


def _regressors(y: np.ndarray, model: str, lags: int, constant: bool) -> tuple[np.ndarray, np.ndarray]:
    dy = np.diff(y)
    rows = np.arange(lags, len(dy))
    t = rows + 1.0
    if model == "sm_power":
        y, t = np.log(np.maximum(y, 1e-300)), t
    if model.startswith("sm"):
        shape = {"sm_poly_1": [t, t * t], "sm_poly_2": [t, t * t], "sm_exp": [t], "sm_power": [np.log(t)]}[model]
        target = y[rows + 1] if model == "sm_poly_1" else np.log(np.maximum(y[rows + 1], 1e-300)) if model in ("sm_poly_2", "sm_exp") else y[rows + 1]
        x = np.stack([*reversed(shape), np.ones(len(rows))], axis=1)
        return x, target
    columns = [y[rows]] + [dy[rows - k] for k in range(1, lags + 1)]
    if constant:
        columns.append(np.ones(len(rows)))
    if model in ("linear", "quadratic"):
        columns.append(t)
    if model == "quadratic":
        columns.append(t * t)
    return np.stack(columns, axis=1), dy[rows]


def sadf(bars: DataFrame, model: str = "linear", lags: int = 1, min_length: int = 20, constant: bool = True, phi: float = 0.0, log: bool = True, chunks: int = 8) -> DataFrame:
    """Largest Dickey-Fuller statistic over all starts, at each end.

    Normal equations are running sums, so that each start costs a small solve, not a pass over the
    rows. The ends of a symbol are dealt to ``chunks`` tasks, each of which takes the series once.
    """

    def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients, and the first diagonal element of the inverse, of many systems."""
        right = np.zeros((*b.shape, 2))
        right[:, :, 0], right[:, 0, 1] = b, 1
        try:
            got = np.linalg.solve(a, right)
        except np.linalg.LinAlgError:
            got = np.linalg.pinv(a) @ right
        return got[:, :, 0], got[:, 0, 1]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        y = np.log(pdf["close"].to_numpy()) if log else pdf["close"].to_numpy(float)
        if len(y) < min_length + lags + 2:
            return pdf.iloc[:0][[SYMBOL, "ts", IDX]].assign(sadf=pd.Series(dtype=float))
        x, target = _regressors(y, model, lags, constant)
        if constant and not model.startswith("sm"):  # centred and scaled, which the first statistic does not depend on
            ones = (x == 1).all(axis=0)
            x = np.where(ones, x, (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1))
        xx = np.concatenate([np.zeros((1, x.shape[1], x.shape[1])), np.cumsum(x[:, :, None] * x[:, None, :], axis=0)])
        xy = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x * target[:, None], axis=0)])
        yy = np.concatenate([[0.0], np.cumsum(target**2)])
        at, out = [], []
        for end in range(min_length + (key[1] - min_length) % chunks, len(target) + 1, chunks):
            starts = np.arange(0, end - min_length + 1)
            a, b, c, n = xx[end] - xx[starts], xy[end] - xy[starts], yy[end] - yy[starts], end - starts
            beta, inverse = solved(a, b)
            var = inverse * np.maximum(c - np.einsum("ij,ij->i", beta, b), 0) / np.maximum(n - x.shape[1], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                stat = beta[:, 0] / np.sqrt(var)
            stat = np.abs(stat) / n**phi if model.startswith("sm") else stat
            stat = stat[np.isfinite(stat)]
            at.append(end + lags)
            out.append(float(stat.max()) if len(stat) else None)
        return pdf.iloc[at][[SYMBOL, "ts", IDX]].assign(sadf=out)

    dealt = bars.select(SYMBOL, "ts", IDX, "close", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    return dealt.groupBy(SYMBOL, "chunk").applyInPandas(run, f"{SYMBOL} string, ts timestamp, {IDX} long, sadf double")


# MacKinnon's response surfaces of the Dickey-Fuller statistic with a constant. Its p-value is
# the normal distribution of a polynomial of the statistic, one up to the first bound and one beyond; critical
# values are polynomials of 1 / n.
BOUNDS, LOWER, UPPER = (-18.83, -1.61, 2.74), (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
CRITICAL = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.04), 0.1: (-2.56677, -1.5384, -2.809)}


def adf(series_rows: DataFrame, alpha: float = 0.05, log: bool = True, value: str = "close") -> DataFrame:
    """``symbol, adf, p_value, critical, stationary``: the Dickey-Fuller test with a constant and one lag.

    Two regressors and a constant, from sums: one pass, added up on the map side.
    """
    y = F.ln(value) if log else F.col(value).cast("double")
    x = F.lag(y).over(series())
    d = series_rows.select(SYMBOL, IDX, y.alias("y"), x.alias("x")).withColumn("z", F.col("x") - F.lag("x").over(series())).withColumn("dy", F.col("y") - F.col("x")).where("z is not null")
    n = F.count("*")
    pop = {"xx": F.var_pop("x"), "zz": F.var_pop("z"), "yy": F.var_pop("dy"), "xz": F.covar_pop("x", "z"), "xy": F.covar_pop("x", "dy"), "zy": F.covar_pop("z", "dy")}
    g = d.groupBy(SYMBOL).agg(n.alias("n"), *((v * n).alias(k) for k, v in pop.items())).withColumn("det", F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"))
    g = g.withColumns({"b": ratio(F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy"), F.col("det")), "c": ratio(F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy"), F.col("det"))})
    variance = (F.col("yy") - F.col("b") * F.col("xy") - F.col("c") * F.col("zy")) / F.nullif(F.col("n") - 3, F.lit(0)) * ratio(F.col("zz"), F.col("det"))
    t = F.col("adf")
    polynomial = lambda c, v: sum((F.lit(a) * F.pow(v, k) for k, a in enumerate(c)), F.lit(0.0))
    p = F.when(t < BOUNDS[0], 0.0).when(t > BOUNDS[2], 1.0).otherwise(norm_cdf(F.when(t <= BOUNDS[1], polynomial(LOWER, t)).otherwise(polynomial(UPPER, t))))
    g = g.withColumn("adf", F.when(variance > 0, F.col("b") / F.sqrt(variance))).withColumns({"p_value": F.when(t.isNotNull(), p), "critical": polynomial(CRITICAL[alpha], 1 / F.col("n"))})
    return g.select(SYMBOL, "adf", "p_value", "critical", ((t < F.col("critical")) & (F.col("p_value") < alpha)).alias("stationary"))


def not_stationary(matrix: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """``symbol, name`` of the columns of ``matrix(symbol, bar_idx, ...)`` that the test does not find stationary."""
    long = matrix.select(SYMBOL, IDX, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(F.struct(F.col(SYMBOL), F.col("x.name")).alias("key"), IDX, F.col("x.v").alias("v"))
    tested = adf(long.withColumnRenamed("key", SYMBOL), alpha, False, "v")
    return tested.where("not coalesce(stationary, false)").select(F.col(f"{SYMBOL}.{SYMBOL}").alias(SYMBOL), F.col(f"{SYMBOL}.name").alias("name"))


def fracdiff_optimal(bars: DataFrame, alpha: float = 0.05, largest: float = 1.0, tolerance: float = 1e-3, threshold: float = 0.01, log: bool = True, least: int = 100) -> DataFrame:
    """``symbol, d, adf, p_value, corr``: the smallest order of fixed-width differences that the test finds stationary, by halving.

    Where no order does, ``d`` is ``largest`` and the rest null. Each symbol is searched in its own task.
    """
    from tickloom.operators.features import ffd_weights

    def p_of(t: float) -> float:
        if t < BOUNDS[0] or t > BOUNDS[2]:
            return 0.0 if t < BOUNDS[0] else 1.0
        return NormalDist().cdf(sum(a * t**k for k, a in enumerate(LOWER if t <= BOUNDS[1] else UPPER)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        y = np.log(pdf["close"].to_numpy()) if log else pdf["close"].to_numpy(float)
        low, high, found = 0.0, largest, (largest, None, None, None)
        for _ in range(20):
            middle = (low + high) / 2
            weights = np.array(ffd_weights(middle, threshold))
            diff = np.convolve(y, weights, "valid") if len(weights) <= len(y) else np.empty(0)
            if len(diff) < least:
                high = middle
                continue
            x, target = _regressors(diff, "none", 1, True)
            beta, var, _ = ols(x, target)
            stat = float(beta[0] / np.sqrt(var[0])) if var[0] > 0 else 0.0
            if p_of(stat) < alpha:
                found = (middle, stat, p_of(stat), float(np.corrcoef(y[len(y) - len(diff) :], diff)[0, 1]))
                high = middle
            else:
                low = middle
            if high - low < tolerance:
                break
        return pd.DataFrame([[pdf[SYMBOL].iloc[0], *found]], columns=[SYMBOL, "d", "adf", "p_value", "corr"])

    return bars.select(SYMBOL, IDX, "close").groupBy(SYMBOL).applyInPandas(run, f"{SYMBOL} string, d double, adf double, p_value double, corr double")
