"""Returns, volatility and exponentially weighted measures."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.keys import IDX, SYMBOL, folded, full, series, trailing


def period_returns(bars: DataFrame, interval: str = "1 day") -> DataFrame:
    """``ret`` to the last close strictly before an interval ago; null where there is none."""
    return bars.withColumn("prev", F.expr(f"last(close) over (partition by symbol order by ts range between unbounded preceding and interval {interval} 1 microsecond preceding)")).withColumn("ret", F.col("close") / F.col("prev") - 1).drop("prev")


def ewm(df: DataFrame, value: str, span: float, out: str, what: str = "mean", order: str = IDX) -> DataFrame:
    """Exponentially weighted mean or deviation (adjusted, unbiased) as pandas has it, one task a symbol, folded batch by batch."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` double"
    f = 1 - 2 / (span + 1)

    def step(pdf: pd.DataFrame, state):
        mean, cov, weight, squares = state or (math.nan, 0.0, 0.0, 0.0)
        got = []
        for x in pdf[value].astype(float).tolist():
            weight, squares = weight * f, squares * f * f
            if x == x:
                old = mean if mean == mean else x
                mean = (weight * old + x) / (weight + 1) if old != x else x
                cov = (weight * (cov + (old - mean) ** 2) + (x - mean) ** 2) / (weight + 1)
                weight, squares = weight + 1, squares + 1
            if what == "mean":
                got.append(mean if mean == mean else None)
            else:
                free = weight * weight - squares
                got.append(math.sqrt(weight * weight / free * cov) if free > 0 else None)
        return pdf.assign(**{out: pd.Series(got, index=pdf.index, dtype=object)}), (mean, cov, weight, squares)

    return folded(df, step, schema, order)


def period_volatility(bars: DataFrame, interval: str = "1 day", lookback: int = 100) -> DataFrame:
    """Deviation of :func:`period_returns`, exponentially weighted by ``lookback``; rows without a return are left out."""
    return ewm(period_returns(bars, interval).where("ret is not null"), "ret", lookback, "vol", "std")


def parkinson(bars: DataFrame, window: int) -> DataFrame:
    r = F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * math.log(2))
    return bars.withColumn("x", r).withColumn("vol", F.sqrt(full(F.col("x"), F.avg, window))).drop("x")


def garman_klass(bars: DataFrame, window: int) -> DataFrame:
    r = F.pow(F.ln(F.col("high") / F.col("low")), 2) / 2 - (2 * math.log(2) - 1) * F.pow(F.ln(F.col("close") / F.col("open")), 2)
    return bars.withColumn("x", r).withColumn("vol", F.sqrt(full(F.col("x"), F.avg, window))).drop("x")


def yang_zhang(bars: DataFrame, window: int) -> DataFrame:
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    prev_close, prev_open = F.lag("close").over(series()), F.lag("open").over(series())
    d = bars.withColumns({"so": F.pow(F.ln(o / prev_close), 2), "sc": F.pow(F.ln(c / prev_open), 2), "srs": F.ln(h / c) * F.ln(h / o) + F.ln(low / c) * F.ln(low / o)})
    part = lambda x: full(F.col(x), F.sum, window) / (window - 1)
    return d.withColumn("vol", F.sqrt(part("so") + k * part("sc") + (1 - k) * part("srs"))).drop("so", "sc", "srs")


def two_scale_volatility(ticks: DataFrame, slow: int, order: str = IDX) -> DataFrame:
    """Realised variance of every ``slow``-th tick, less what noise adds to that of all; its root, at least 0."""
    r = lambda c: F.pow(F.ln(F.col("close") / F.lag("close").over(c)), 2)
    fast = ticks.withColumn("x", r(series(order))).groupBy(SYMBOL).agg(F.sum("x").alias("fast"), F.count("x").alias("nf"))
    thin = ticks.where(F.col(order) % slow == 0).withColumn("x", r(series(order))).groupBy(SYMBOL).agg(F.sum("x").alias("slow"), F.count("x").alias("ns"))
    return fast.join(thin, SYMBOL).select(SYMBOL, F.sqrt(F.greatest(F.col("slow") - F.col("ns") / F.col("nf") * F.col("fast"), F.lit(0.0))).alias("vol"))


def rolling_autocorrelation(bars: DataFrame, window: int) -> DataFrame:
    """Correlation of returns with those before, ``window - 1`` pairs."""
    d = bars.withColumn("ret", F.col("close") / F.lag("close").over(series()) - 1).withColumn("before", F.lag("ret").over(series()))
    w = series().rowsBetween(-(window - 2), 0)
    return d.withColumn("autocorr", F.when(F.count("before").over(w) == window - 1, F.covar_pop("ret", "before").over(w) / F.nullif(F.stddev_pop("ret").over(w) * F.stddev_pop("before").over(w), F.lit(0.0)))).drop("before")


def lagged_returns(bars: DataFrame, lags: list[int], periods: int) -> DataFrame:
    """Returns over each lag, cut at the outermost of 10,000 parts of the symbol's own, a bar's worth each, with earlier values."""
    out = bars
    for k in lags:
        raw = F.col("close") / F.lag("close", k).over(series()) - 1
        out = out.withColumn(f"raw_{k}", raw)
    bounds = out.groupBy(SYMBOL).agg(*(F.percentile(f"raw_{k}", q).alias(f"{n}_{k}") for k in lags for n, q in (("lo", 1e-4), ("hi", 1 - 1e-4))))
    out = out.join(bounds, SYMBOL)
    for k in lags:
        cut = F.when(F.col(f"raw_{k}").isNotNull(), F.least(F.greatest(f"raw_{k}", f"lo_{k}"), F.col(f"hi_{k}")))
        out = out.withColumn(f"returns_{k}", F.pow(1 + cut, 1 / k) - 1)
    for k in lags:
        for t in range(1, periods + 1):
            out = out.withColumn(f"returns_{k}_lag_{t}", F.lag(f"returns_{k}", t * k).over(series()))
    return out.drop(*(f"{n}_{k}" for k in lags for n in ("raw", "lo", "hi")))


def return_moments(bars: DataFrame, window: int, least: int = 3) -> DataFrame:
    """Rolling z-score, skewness and excess kurtosis of log returns, corrected for the sample's size, from ``least`` values on."""
    d = bars.withColumn("r", F.ln(F.col("close") / F.lag("close").over(series())))
    w = trailing(window)
    n = F.count("r").over(w).cast("double")
    some = lambda value, k: F.when(n >= max(k, least), value)
    z = (F.col("r") - F.avg("r").over(w)) / F.nullif(F.stddev_samp("r").over(w), F.lit(0.0))
    skew = F.skewness("r").over(w) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("r").over(w) + 6)
    return d.withColumns({"z": some(z, 2), "skew": some(skew, 3), "kurt": some(kurt, 4)}).drop("r")


def garch_variance(bars: DataFrame, omega: float, alpha: float, beta: float) -> DataFrame:
    """The recursion ``omega + alpha r^2 + beta v`` from the variance of all returns; one task a symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        r = pdf["close"].pct_change().fillna(0.0).to_numpy()
        v = [float(r[1:].var()) if len(r) > 1 else 0.0]
        for x in r[:-1]:
            v.append(omega + alpha * x * x + beta * v[-1])
        return pdf[[SYMBOL, "ts", IDX]].assign(variance=v)

    return bars.select(SYMBOL, "ts", IDX, "close").groupBy(SYMBOL).applyInPandas(run, f"{SYMBOL} string, ts timestamp, {IDX} long, variance double")


def volatility(bars: DataFrame, method: str, window: int) -> DataFrame:
    """``bars`` with ``vol`` by a method: ``daily`` or ``hourly`` (returns over so many days or hours), ``parkinson``, ``garman_klass``, ``yang_zhang``, ``rolling`` or ``realised``."""
    if method in ("daily", "hourly"):
        return period_volatility(bars, f"{window} {'days' if method == 'daily' else 'hours'}")
    if method in ("rolling", "realised"):
        d = bars.withColumn("r", F.ln(F.col("close") / F.lag("close").over(series())))
        value = full(F.col("r"), F.stddev_samp, window) if method == "rolling" else F.sqrt(full(F.col("r") * F.col("r"), F.sum, window))
        return d.withColumn("vol", value).drop("r")
    ways = {"parkinson": parkinson, "garman_klass": garman_klass, "yang_zhang": yang_zhang}
    if method not in ways:
        raise ValueError(f"no volatility {method!r}")
    return ways[method](bars, window)


def volatility_choice(bars: DataFrame, methods: list[str], window: int) -> DataFrame:
    """``symbol, method, loss``: how far each method's forecast of the next squared return was off (QLIKE), least first the best."""
    out = None
    for m in methods:
        d = volatility(bars, m, window).withColumn("next", F.pow(F.ln(F.lead("close").over(series()) / F.col("close")), 2)).where("vol > 0 and next is not null")
        part = d.groupBy(SYMBOL).agg(F.avg(F.ln(F.col("vol") * F.col("vol")) + F.col("next") / (F.col("vol") * F.col("vol"))).alias("loss")).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out.select(SYMBOL, "method", "loss")
