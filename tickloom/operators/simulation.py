"""Back-tests, process estimates and simulated barriers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.keys import IDX, SYMBOL, series
from tickloom.operators.touches import first_touches


def backtest(bars: DataFrame, cost: float = 0.0) -> DataFrame:
    """``pos`` of the bar before times the return, less cost of the change; and the equity it makes."""
    d = bars.withColumn("ret", F.col("close") / F.lag("close").over(series()) - 1).withColumn("held", F.coalesce(F.lag("pos").over(series()), F.lit(0.0)))
    d = d.withColumn("net", F.coalesce(F.col("held") * F.col("ret"), F.lit(0.0)) - cost * F.abs(F.col("held") - F.coalesce(F.lag("held").over(series()), F.lit(0.0))))
    return d.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(series()))).drop("held", "ret")


def labelled_backtest(labels: DataFrame, cost: float = 0.0) -> DataFrame:
    """Equity after each exit of labelled trades, two costs each."""
    w = Window.partitionBy(SYMBOL).orderBy("t1", "i0")
    return labels.withColumn("net", F.col("ret") - 2 * cost).withColumn("equity", F.exp(F.sum(F.log1p("net")).over(w)))


def ou_parameters(bars: DataFrame) -> DataFrame:
    """Reversion without intercept around the mean: ``phi`` (within 0.001 and 0.999), deviation of what is left, half-life."""
    mean = F.avg("close").over(Window.partitionBy(SYMBOL))
    d = bars.withColumn("x", F.col("close") - mean).withColumn("b", F.lag("x").over(series())).where("b is not null")
    g = d.groupBy(SYMBOL).agg(F.sum(F.col("x") * F.col("b")).alias("xb"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count("*").alias("n"))
    g = g.withColumn("phi", F.least(F.greatest(F.col("xb") / F.nullif(F.col("bb"), F.lit(0.0)), F.lit(0.001)), F.lit(0.999)))
    sse = F.col("xx") - 2 * F.col("phi") * F.col("xb") + F.col("phi") * F.col("phi") * F.col("bb")
    return g.select(SYMBOL, "phi", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("sigma"), (-math.log(2) / F.ln("phi")).alias("half_life"))


def process_estimates(bars: DataFrame, periods: float = 252) -> DataFrame:
    """Drift and deviation of a geometric walk, jumps beyond 2.5 deviations, and elasticity of variance."""
    d = bars.withColumn("r", F.ln(F.col("close") / F.lag("close").over(series()))).withColumn("lp", F.ln(F.lag("close").over(series()))).where("r is not null")
    part = Window.partitionBy(SYMBOL)
    d = d.withColumns({"mu": F.avg("r").over(part), "sd": F.stddev_samp("r").over(part)}).withColumn("jump", F.abs(F.col("r") - F.col("mu")) > 2.5 * F.col("sd"))
    d = d.withColumn("la", F.when(F.col("r") != 0, F.ln(F.abs("r"))))
    return d.groupBy(SYMBOL).agg((F.first("mu") * periods).alias("drift"), (F.first("sd") * math.sqrt(periods)).alias("volatility"), F.avg(F.col("jump").cast("double")).alias("jump_share"), F.avg(F.when(F.col("jump"), F.col("r"))).alias("jump_mean"), F.regr_slope("la", "lp").alias("elasticity"))


def simulate_barriers(spark, phi: float, sigma: float, forecast: float, start: float, pts: list[float], sls: list[float], paths: int = 1000, horizon: int = 100, seed: int = 1) -> DataFrame:
    """Mean, deviation and Sharpe ratio of exits of a reverting process at each pair of levels.

    Each task draws its paths from a seed of its own and scores all pairs against them; only sums of
    pairs come back, and are added up.
    """
    grid = [(a, b) for a in pts for b in sls]
    block = 256

    def run(batches):
        for pdf in batches:
            for k in pdf["id"].tolist():
                n = min(block, paths - k * block)
                e = np.random.default_rng([seed, k]).standard_normal((horizon, n))
                x = np.empty((horizon + 1, n))
                x[0] = start
                for t in range(horizon):
                    x[t + 1] = (1 - phi) * forecast + phi * x[t] + sigma * e[t]
                gain = x[1:] - start
                out = []
                for pt, sl in grid:
                    hit = (gain >= pt) | (gain <= -sl)
                    hit[-1] = True
                    got = gain[hit.argmax(axis=0), np.arange(n)]
                    out.append((pt, sl, n, float(got.sum()), float((got**2).sum()), int((got > 0).sum())))
                yield pd.DataFrame(out, columns=["pt", "sl", "n", "total", "squares", "wins"])

    parts = spark.range(-(-paths // block)).mapInPandas(run, "pt double, sl double, n long, total double, squares double, wins long")
    g = parts.groupBy("pt", "sl").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares", "wins")))
    g = g.withColumns({"mean": F.col("total") / F.col("n"), "hit_rate": F.col("wins") / F.col("n")}).withColumn("dev", F.sqrt(F.greatest(F.col("squares") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    return g.withColumn("sharpe", F.col("mean") / F.nullif(F.col("dev"), F.lit(0.0))).select("pt", "sl", "n", "mean", "dev", "sharpe", "hit_rate")


def best_barriers(grid: DataFrame) -> DataFrame:
    return grid.agg(F.max_by(F.struct("pt", "sl", "sharpe"), "sharpe").alias("b")).select("b.*")


def trading_rule_grid(entries: DataFrame, bars: DataFrame, rules: list[tuple[float, float]], max_hold: int) -> DataFrame:
    """Trades of each rule (profit and stop as shares, filled at the level) from each entry ``symbol, i0, side``.

    Each rule's search is :func:`first_touches`; a trade that reaches neither level ends with its last bar.
    """
    last = bars.groupBy(SYMBOL).agg(F.max(IDX).alias("last"))
    ends = bars.select(SYMBOL, F.col(IDX).alias("end"), F.col("close").alias("p1"))
    spans = entries.select(SYMBOL, "i0", "side").join(F.broadcast(last), SYMBOL).withColumn("end", F.least(F.col("i0") + max_hold, "last")).where("end > i0").drop("last").join(ends, [SYMBOL, "end"])  # a row a symbol
    of_rules = F.explode(F.array(*(F.struct(F.lit(float(pt)).alias("pt"), F.lit(float(sl)).alias("sl")) for pt, sl in rules)))
    trades = spans.withColumn("rule", of_rules).select(SYMBOL, "i0", "end", "side", "p1", "rule.*").withColumns({"up": F.col("pt"), "down": -F.col("sl")})
    ret = F.when(F.col("touch_idx").isNull(), (F.col("p1") / F.col("p0") - 1) * F.col("side")).when(F.col("falls"), -F.col("sl")).otherwise(F.col("pt"))
    return first_touches(trades, bars).where("p0 is not null").select(SYMBOL, "i0", "pt", "sl", ret.alias("ret"))


def rule_scores(rule_trades: DataFrame) -> DataFrame:
    return rule_trades.groupBy("pt", "sl").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), (F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0))).alias("sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def bootstrap_uniqueness(spans: DataFrame, draws: int, seeds: list[int]) -> DataFrame:
    """Mean uniqueness of plain and of sequential draws, for each symbol and seed."""
    from tickloom.operators.sampling import sequential_bootstrap

    def score(low: np.ndarray, high: np.ndarray, picks: np.ndarray) -> float:
        c = np.zeros(int(high.max()) + 2)
        np.add.at(c, low[picks], 1)
        np.add.at(c, high[picks] + 1, -1)
        c = np.cumsum(c)[:-1]
        s = np.concatenate([[0], np.cumsum(np.divide(1, c, out=np.zeros_like(c), where=c > 0))])
        return float(((s[high[picks] + 1] - s[low[picks]]) / (high[picks] - low[picks] + 1)).mean())

    def run(key, labels: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        labels = labels.sort_values(["i0", "i1"])
        low, high = labels["i0"].to_numpy(), labels["i1"].to_numpy()
        out = [(key[0], seed, score(low, high, np.random.RandomState(seed).randint(0, len(low), draws)), score(low, high, d.sort_values("nth")["pick"].to_numpy())) for seed, d in drawn.groupby("seed")]
        return pd.DataFrame(out, columns=["symbol", "seed", "plain", "sequential"])

    drawn = sequential_bootstrap(spans, draws, seeds).groupBy("symbol")
    return spans.select("symbol", "i0", "i1").groupBy("symbol").cogroup(drawn).applyInPandas(run, "symbol string, seed long, plain double, sequential double")
