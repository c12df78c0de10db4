"""Strategies: what gives each bar a side, and the run of one over a series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.keys import SYMBOL, full, series
from tickloom.operators import features as X
from tickloom.operators import sampling as L
from tickloom.operators import simulation as G


@dataclass(frozen=True)
class Strategy:
    """A name, what it is after, and a function from bars to bars with ``side`` (-1, 0, 1)."""

    name: str
    objective: str
    signals: Callable[[DataFrame], DataFrame]


def crossover(fast: int, slow: int) -> Strategy:
    return Strategy(f"crossover_{fast}_{slow}", "trend following", lambda bars: X.crossovers(bars, fast, slow))


def reversion(window: int = 20, width: float = 2.0) -> Strategy:
    return Strategy(f"reversion_{window}_{width:g}", "mean reversion", lambda bars: X.bollinger(bars, window, width))


def band_signals(bars: DataFrame, window: int = 20, width: float = 2.0, low: float = 0.2, high: float = 0.8, wide: int = 5) -> DataFrame:
    """Entries and exits where the place within the bands crosses ``low`` or ``high``; entries only while the bands are wider than of late."""
    d = X.bollinger(bars, window, width)
    before, widening = F.lag("pct_b").over(series()), F.col("bandwidth") > full(F.col("bandwidth"), F.avg, wide)
    up, down = (before < low) & (F.col("pct_b") >= low), (before > high) & (F.col("pct_b") <= high)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return d.withColumns({"long_entry": flag(up & widening), "long_exit": flag(down), "short_entry": flag(down & widening), "short_exit": flag(up)})


def sides(bars: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """``symbol, ts, strategy, side`` of several strategies."""
    parts = [s.signals(bars).select(SYMBOL, "ts", F.lit(s.name).alias("strategy"), F.col("side").cast("int").alias("side")) for s in strategies]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def experiment(bars: DataFrame, strategy: Strategy, target: float, pt: float, sl: float, n_bars: int, cost: float = 0.0) -> DataFrame:
    """A strategy's entries, barriers, labels and the equity of its trades, in one go."""
    sided = strategy.signals(bars)
    entries = X.entries(sided, F.col("side")).select(SYMBOL, F.col("bar_idx").alias("i0"), F.col("ts").alias("t0"), "side")
    touched = L.triple_barrier_events(L.vertical_barriers(entries, bars, n_bars=n_bars).withColumn("trgt", F.lit(float(target))), bars, pt, sl)
    return G.labelled_backtest(L.barrier_labels(touched, bars, meta=True), cost)
