"""Structured Streaming forms of bars, events and position counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tickloom.keys import SYMBOL
from tickloom.operators.bars import ORDER, resampling


def time_bars(ticks: DataFrame, timeframe: str, delay: str = "10 minutes") -> DataFrame:
    """Bars of event-time windows, each given once the watermark has passed it."""
    at = F.struct(*ORDER)
    w = F.window("ts", resampling(timeframe))
    bars = ticks.withWatermark("ts", delay).groupBy(SYMBOL, w.alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("tick_volume"), F.sum("volume").alias("volume"))
    return bars.withColumn("ts", F.col("w.end")).drop("w")


def cusum_events(ticks: DataFrame, threshold: float) -> DataFrame:
    """The filter's events as ticks come; state is the last price and the two sums of each symbol. Ticks of a batch are put in order of time."""

    def step(key, pdfs, state):
        last, up, down = state.get if state.exists else (None, 0.0, 0.0)
        rows = pd.concat(list(pdfs)).sort_values(list(ORDER))
        out = []
        for ts, price in zip(rows["ts"], rows["price"], strict=True):
            if last is not None:
                r = math.log(price / last)
                up, down = max(0.0, up + r), min(0.0, down + r)
                if down < -threshold:
                    down = 0.0
                    out.append((key[0], ts, -1))
                elif up > threshold:
                    up = 0.0
                    out.append((key[0], ts, 1))
            last = price
        state.update((last, up, down))
        yield pd.DataFrame(out, columns=[SYMBOL, "ts", "direction"])

    return ticks.groupBy(SYMBOL).applyInPandasWithState(step, f"{SYMBOL} string, ts timestamp, direction int", "last double, up double, down double", "append", GroupStateTimeout.NoTimeout)


def tick_bars(ticks: DataFrame, size: int) -> DataFrame:
    """Bars of ``size`` ticks as they fill; state is the open bar of each symbol."""

    def step(key, pdfs, state):
        bar = list(state.get) if state.exists else [0, 0.0, 0.0, 0.0, 0.0, 0.0]
        rows = pd.concat(list(pdfs)).sort_values(list(ORDER))
        out = []
        for ts, price, volume in zip(rows["ts"], rows["price"], rows["volume"], strict=True):
            n, o, h, low, _, v = bar
            bar = [1, price, price, price, price, volume] if n == 0 else [n + 1, o, max(h, price), min(low, price), price, v + volume]
            if bar[0] == size:
                out.append((key[0], ts + pd.Timedelta(microseconds=1), *bar[1:]))
                bar = [0, 0.0, 0.0, 0.0, 0.0, 0.0]
        state.update(tuple(bar))
        yield pd.DataFrame(out, columns=[SYMBOL, "ts", "open", "high", "low", "close", "volume"])

    return ticks.groupBy(SYMBOL).applyInPandasWithState(step, f"{SYMBOL} string, ts timestamp, open double, high double, low double, close double, volume double", "n long, open double, high double, low double, close double, volume double", "append", GroupStateTimeout.NoTimeout)


def position_counts(signals: DataFrame) -> DataFrame:
    """Open bets of either side and the most so far, from ``symbol, ts, side, step`` (1 opens, -1 closes)."""

    def step(key, pdfs, state):
        now = list(state.get) if state.exists else [0, 0, 0, 0]
        for side, change in pd.concat(list(pdfs)).sort_values("ts")[["side", "step"]].itertuples(index=False):
            k = 0 if side > 0 else 1
            now[k] += int(change)
            now[k + 2] = max(now[k + 2], now[k])
        state.update(tuple(now))
        yield pd.DataFrame([(key[0], *now)], columns=[SYMBOL, "long", "short", "max_long", "max_short"])

    return signals.groupBy(SYMBOL).applyInPandasWithState(step, f"{SYMBOL} string, long long, short long, max_long long, max_short long", "long long, short long, max_long long, max_short long", "update", GroupStateTimeout.NoTimeout)
