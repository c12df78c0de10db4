"""Bet sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.mathx import norm_cdf
from tickloom.keys import SYMBOL
from tickloom.operators.validation import cumulative


def signal(prob: Column, classes: int, side: Column | None = None) -> Column:
    """``2 Phi(z) - 1`` of how far a probability is from chance, with the side's sign."""
    p = F.least(F.greatest(prob, F.lit(1e-6)), F.lit(1 - 1e-6))
    size = 2 * norm_cdf((p - 1 / classes) / F.sqrt(p * (1 - p))) - 1
    return size if side is None else side * size


def discrete(size: Column, step: float) -> Column:
    return F.least(F.greatest(F.rint(size / step) * step, F.lit(-1.0)), F.lit(1.0))


def _swept(spans: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Running sums of values that hold from ``t0`` until before ``t1``, at each time of either."""
    out = spans.select(SYMBOL, F.explode(F.array(*(F.struct(F.col(t).alias("ts"), *((s * v).alias(k) for k, v in values.items())) for t, s in (("t0", 1), ("t1", -1))))).alias("x"))
    at = out.groupBy(SYMBOL, "x.ts").agg(*(F.sum(f"x.{k}").alias(k) for k in values))
    w = Window.partitionBy(SYMBOL).orderBy("ts")
    return at.select(SYMBOL, "ts", *(F.sum(k).over(w).alias(k) for k in values))


def average_active(signals: DataFrame) -> DataFrame:
    """Mean signal of the bets open at each time at which one starts or ends; 0 where none is."""
    s = _swept(signals, {"total": F.col("signal"), "n": F.lit(1)})
    return s.select(SYMBOL, "ts", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("signal"))


def concurrent_sides(bets: DataFrame) -> DataFrame:
    """Bets of either side open at each start."""
    s = _swept(bets, {"long": (F.col("side") > 0).cast("int"), "short": (F.col("side") < 0).cast("int")})
    starts = bets.select(SYMBOL, F.col("t0").alias("ts")).distinct()
    return starts.join(s, [SYMBOL, "ts"])


def budget(bets: DataFrame) -> DataFrame:
    """Bet size by how full either side's most is."""
    c = concurrent_sides(bets)
    w = Window.partitionBy(SYMBOL)
    share = lambda k: F.coalesce(F.col(k) / F.nullif(F.max(k).over(w), F.lit(0)), F.lit(0.0))
    return c.withColumn("bet_size", share("long") - share("short"))


def size_sigmoid(w: Column, x: Column) -> Column:
    return x / F.sqrt(w + x * x)


def size_power(w: Column, x: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * F.pow(F.abs(x), w))


def target_sigmoid(w: Column, forecast: Column, price: Column, most: Column) -> Column:
    return (size_sigmoid(w, forecast - price) * most).cast("int")


def inverse_sigmoid(forecast: Column, w: Column, m: Column) -> Column:
    return forecast - m * F.sqrt(w / (1 - m * m))


def calibrate_sigmoid(x: Column, m: Column) -> Column:
    return x * x * (1 / (m * m) - 1)


def calibrate_power(x: Column, m: Column) -> Column:
    return F.greatest(F.lit(0.0), F.ln(m / F.signum(x)) / F.ln(F.abs(x)))


def limit_sigmoid(target: Column, pos: Column, forecast: Column, w: Column, most: Column) -> Column:
    """Mean price at which the steps from a position to a target break even; null where they are one.

    Steps are counted by size, so that on the short side only those that exist are summed.
    """
    sign = F.when(target >= pos, 1).otherwise(-1)
    first, last = F.abs(pos + sign), F.abs(target + 1) - 1
    steps = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.lit(0.0), lambda s, j: s + inverse_sigmoid(forecast, w, j / most))
    return F.when(target != pos, total / F.abs(target - pos))


def dynamic(rows: DataFrame, w: float) -> DataFrame:
    """``bet_size, target, limit_price`` of rows ``pos, most, price, forecast``."""
    lw = F.lit(float(w))
    d = rows.withColumn("target", target_sigmoid(lw, F.col("forecast"), F.col("price"), F.col("most")))
    return d.withColumns({"bet_size": size_sigmoid(lw, F.col("forecast") - F.col("price")), "limit_price": limit_sigmoid(F.col("target"), F.col("pos"), F.col("forecast"), lw, F.col("most"))})


def ecdf_size(scored: DataFrame, threshold: float) -> DataFrame:
    """Share of winning probabilities over the threshold that a probability reaches; 0 up to it."""
    wins = scored.where((F.col("y") == 1) & (F.col("p") > threshold)).groupBy("p").agg(F.count("*").alias("n"))
    every = scored.select("p").distinct().join(wins, "p", "left")
    total = wins.agg(F.sum("n").alias("all"))
    cum = cumulative(every, {"c": F.coalesce("n", F.lit(0))}).crossJoin(F.broadcast(total))  # one row
    return scored.join(cum.select("p", (F.col("c") / F.nullif(F.col("all"), F.lit(0))).alias("share")), "p").withColumn("bet_size", F.when(F.col("p") > threshold, F.coalesce("share", F.lit(0.0))).otherwise(0.0)).drop("share")


def raw_moments(df: DataFrame, value: str) -> DataFrame:
    return df.agg(*(F.avg(F.pow(F.col(value), k)).alias(f"m{k}") for k in range(1, 6)))


def centred_moments(row: DataFrame) -> DataFrame:
    """Second to fifth moments about the mean, from raw ones."""
    m = {0: F.lit(1.0)} | {k: F.col(f"m{k}") for k in range(1, 6)}
    comb = lambda n, j: float(np.prod([(n - i) / (i + 1) for i in range(j)]))
    return row.select(*(sum((comb(n, j) * (-1) ** (n - j) * m[j] * F.pow(m[1], n - j) for j in range(n + 1)), F.lit(0.0)).alias(f"c{n}") for n in range(2, 6)))


def _mixture_fit(m: np.ndarray, mu2: float, p: float, steps: int, tolerance: float) -> tuple[np.ndarray, float]:
    """One fixed-point search for two normals with given raw moments."""
    best, error = None, np.inf
    for _ in range(steps):
        mu1 = (m[0] - (1 - p) * mu2) / p
        # variances by the second and third moments, which are linear in them
        a = np.array([[p, 1 - p], [3 * mu1 * p, 3 * mu2 * (1 - p)]])
        b = np.array([m[1] - p * mu1**2 - (1 - p) * mu2**2, m[2] - p * mu1**3 - (1 - p) * mu2**3])
        if abs(np.linalg.det(a)) < 1e-12:
            break
        v1, v2 = np.linalg.solve(a, b)
        if v1 <= 0 or v2 <= 0:
            break
        moment4 = lambda mu, v: 3 * v * v + 6 * mu * mu * v + mu**4
        moment5 = lambda mu, v: 15 * mu * v * v + 10 * mu**3 * v + mu**5
        got = np.array([p * mu1 + (1 - p) * mu2, p * (v1 + mu1**2) + (1 - p) * (v2 + mu2**2), p * (3 * mu1 * v1 + mu1**3) + (1 - p) * (3 * mu2 * v2 + mu2**3), p * moment4(mu1, v1) + (1 - p) * moment4(mu2, v2), p * moment5(mu1, v1) + (1 - p) * moment5(mu2, v2)])
        now = float(((got - m) ** 2).sum())
        if now < error:
            best, error = np.array([mu1, mu2, v1**0.5, v2**0.5, p]), now
        gap = moment4(mu1, v1) - moment4(mu2, v2)
        new = (m[3] - moment4(mu2, v2)) / gap if abs(gap) > 1e-12 else p
        if not 0 < new < 1 or abs(new - p) < tolerance:
            break
        p = new
    return best, error


def mixture(spark, moments: list[float], runs: int = 100, seed: int = 1) -> DataFrame:
    """``mu_1, mu_2, sigma_1, sigma_2, p_1, error`` of each of many searches from random starts, dealt over tasks."""
    m = np.array(moments, float)
    dev = max(m[1] - m[0] ** 2, 0.0) ** 0.5

    def run(batches):
        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                r = np.random.default_rng([seed, i])
                fit, error = _mixture_fit(m, m[0] + dev * r.uniform(0, 5), r.uniform(0.05, 0.95), 1000, 1e-7)
                if fit is not None:
                    rows.append([i, *fit.tolist(), error])
            yield pd.DataFrame(rows, columns=["run", "mu_1", "mu_2", "sigma_1", "sigma_2", "p_1", "error"])

    return spark.range(runs).mapInPandas(run, "run long, mu_1 double, mu_2 double, sigma_1 double, sigma_2 double, p_1 double, error double")


def mixture_cdf(x: Column, mu1: float, mu2: float, s1: float, s2: float, p: float) -> Column:
    return p * norm_cdf((x - mu1) / s1) + (1 - p) * norm_cdf((x - mu2) / s2)


def reserve(c: Column, *parameters: float) -> Column:
    """Bet size of a number of concurrent bets under a fitted mixture."""
    at0 = mixture_cdf(F.lit(0.0), *parameters)
    f = mixture_cdf(c, *parameters)
    return F.when(c >= 0, (f - at0) / (1 - at0)).otherwise((f - at0) / at0)


def likely_mixture(fits: DataFrame) -> list[float]:
    """Parameters of the search that came nearest to the moments."""
    best = fits.agg(F.min(F.struct("error", "run", "mu_1", "mu_2", "sigma_1", "sigma_2", "p_1")).alias("b")).first().b
    return [best[k] for k in ("mu_1", "mu_2", "sigma_1", "sigma_2", "p_1")]


def reserve_sizes(bets: DataFrame, parameters: list[float] | None = None, runs: int = 100, seed: int = 1) -> DataFrame:
    """Bets open on either side at each start, their difference ``c_t``, and the size by a mixture of two normals, fitted to its moments unless given."""
    c = concurrent_sides(bets).withColumn("c_t", F.col("long") - F.col("short"))
    if parameters is None:
        m = raw_moments(c.withColumn("x", F.col("c_t").cast("double")), "x").first()
        parameters = likely_mixture(mixture(bets.sparkSession, [m[f"m{k}"] for k in range(1, 6)], runs, seed))
    return c.withColumn("bet_size", reserve(F.col("c_t").cast("double"), *parameters))


def power_sizes(rows: DataFrame, w: float) -> DataFrame:
    """``bet_size, target`` of rows ``most, price, forecast`` by the power family; the distance has to lie within 1."""
    x = F.col("forecast") - F.col("price")
    size = size_power(F.lit(float(w)), x)
    return rows.withColumns({"bet_size": size, "target": (size * F.col("most")).cast("int")})
