"""Moving averages, bands, fractals, calendar features, fractional differences and technical indicators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.keys import IDX, SYMBOL, full, ratio, series


def moving_average_differences(bars: DataFrame, windows: list[int]) -> DataFrame:
    out = bars.withColumns({f"sma_{n}": full(F.col("close"), F.avg, n) for n in windows})
    pairs = [(a, b) for i, a in enumerate(windows) for b in windows[i + 1 :]]
    return out.withColumns({f"diff_{a}_{b}": F.col(f"sma_{a}") - F.col(f"sma_{b}") for a, b in pairs}).drop(*(f"sma_{n}" for n in windows))


def crossovers(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """``side`` by which average is above, and ``cross``: 1 or -1 where that changes."""
    side = F.signum(full(F.col("close"), F.avg, fast) - full(F.col("close"), F.avg, slow)).cast("int")
    out = bars.withColumn("side", F.coalesce(side, F.lit(0)))
    before = F.lag("side").over(series())
    return out.withColumn("cross", F.when((F.col("side") != 0) & (before != 0) & (F.col("side") != before), F.col("side")).otherwise(0))


def bollinger(bars: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    """Bands (population deviation), %B, bandwidth, and the side of a return to the mean."""
    mid, dev = full(F.col("close"), F.avg, window), full(F.col("close"), F.stddev_pop, window)
    out = bars.withColumns({"mid": mid, "dev": dev}).withColumns({"upper": F.col("mid") + width * F.col("dev"), "lower": F.col("mid") - width * F.col("dev")}).drop("dev")
    side = F.when(F.col("close") >= F.col("upper"), -1).when(F.col("close") <= F.col("lower"), 1).otherwise(0)
    return out.withColumns({"pct_b": ratio(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower")), "bandwidth": ratio(F.col("upper") - F.col("lower"), F.col("mid")), "side": side})


def fractals(bars: DataFrame, n: int = 2) -> DataFrame:
    """Bars that are the extreme of ``n`` on either side (looking ahead by ``n``), and the levels they leave, known ``n`` bars later."""
    w = series().rowsBetween(-n, n)
    whole = F.count("*").over(w) == 2 * n + 1
    out = bars.withColumns({"up": F.when(whole & (F.col("high") == F.max("high").over(w)), 1).otherwise(0), "down": F.when(whole & (F.col("low") == F.min("low").over(w)), 1).otherwise(0)})
    out = out.withColumns({"u": F.when(F.lag("up", n).over(series()) == 1, F.lag("high", n).over(series())), "d": F.when(F.lag("down", n).over(series()) == 1, F.lag("low", n).over(series()))})
    out = out.withColumns({"resistance": F.last("u", ignorenulls=True).over(series()), "support": F.last("d", ignorenulls=True).over(series())}).drop("u", "d")
    return out.withColumn("breakout", F.when(F.col("close") > F.col("resistance"), 1).when(F.col("close") < F.col("support"), -1).otherwise(0))


# Trading sessions by their hours in UTC.
SESSIONS = {"sydney": (21, 6), "tokyo": (0, 9), "london": (7, 16), "new_york": (13, 22)}


def sessions(bars: DataFrame) -> DataFrame:
    h = F.hour("ts")
    inside = {k: (((h >= a) & (h < b)) if a < b else ((h >= a) | (h < b))).cast("int") for k, (a, b) in SESSIONS.items()}
    out = bars.withColumns({f"session_{k}": v for k, v in inside.items()})
    overlap = sum((F.col(f"session_{k}") for k in SESSIONS), F.lit(0)) > 1
    day = F.weekday("ts")
    return out.withColumns({"overlap": overlap.cast("int"), "friday_close": ((day == 4) & (h >= 20)).cast("int"), "sunday_open": ((day == 6) & (h >= 21)).cast("int"), "month_end": (F.dayofmonth("ts") >= 28).cast("int"), "quarter_end": ((F.month("ts") % 3 == 0) & (F.dayofmonth("ts") >= 28)).cast("int")})


def cyclical(bars: DataFrame, terms: int = 2) -> DataFrame:
    """Sines and cosines of hour, weekday (Monday first) and day of year."""
    parts = {"hour": (F.hour("ts"), 24), "dow": (F.weekday("ts"), 7), "doy": (F.dayofyear("ts"), 366)}
    return bars.withColumns({f"{f}_{k}_h{n}": g(2 * math.pi * n * x / period) for k, (x, period) in parts.items() for n in range(1, terms + 1) for f, g in (("sin", F.sin), ("cos", F.cos))})


def ffd_weights(d: float, threshold: float, limit: int = 10_000) -> list[float]:
    """Weights of the fractional difference, newest first, while they count."""
    out = [1.0]
    while len(out) < limit:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def frac_diff_ffd(bars: DataFrame, d: float, threshold: float = 1e-2, log: bool = True) -> DataFrame:
    """Fixed-width fractional difference: one array of weights against the last values, all in the JVM."""
    weights = ffd_weights(d, threshold)
    y = F.ln("close") if log else F.col("close")
    last = series().rowsBetween(-(len(weights) - 1), 0)
    values = F.collect_list("y").over(last)
    w = F.array(*(F.lit(x) for x in reversed(weights)))
    dot = F.aggregate(F.zip_with(F.col("values"), w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return bars.withColumn("y", y).withColumn("values", values).withColumn("ffd", F.when(F.size("values") == len(weights), dot)).drop("y", "values")


def frac_diff(bars: DataFrame, d: float, threshold: float = 0.01) -> DataFrame:
    """Expanding-window fractional difference; rows whose lost weight is over a share are null. One task a symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        y = np.log(pdf["close"].to_numpy())
        w = np.cumprod(np.concatenate([[1.0], [-(d - k + 1) / k for k in range(1, len(y))]]))
        lost = np.cumsum(np.abs(w[::-1]))
        skip = int((lost / lost[-1] > threshold).argmax()) if len(w) else 0
        out = [float(w[: i + 1][::-1] @ y[: i + 1]) if i >= skip else None for i in range(len(y))]
        return pdf[[SYMBOL, "ts", IDX]].assign(frac=out)

    return bars.select(SYMBOL, "ts", IDX, "close").groupBy(SYMBOL).applyInPandas(run, f"{SYMBOL} string, ts timestamp, {IDX} long, frac double")


def indicators(bars: DataFrame, rsi: int = 14, atr: int = 14, macd: tuple[int, int, int] = (12, 26, 9), adx: int = 14) -> DataFrame:
    """RSI, ATR, MACD and ADX (Wilder's smoothing), one task a symbol."""
    schema = f"{SYMBOL} string, ts timestamp, {IDX} long, rsi double, atr double, macd double, macd_signal double, adx double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        c, h, low = pdf["close"], pdf["high"], pdf["low"]
        wilder = lambda s, n: s.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
        move = c.diff()
        gain, loss = wilder(move.clip(lower=0), rsi), wilder(-move.clip(upper=0), rsi)
        tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
        up, down = h.diff(), -low.diff()
        plus, minus = wilder(up.where((up > down) & (up > 0), 0.0), adx), wilder(down.where((down > up) & (down > 0), 0.0), adx)
        true = wilder(tr, adx)
        pdi, mdi = 100 * plus / true, 100 * minus / true
        line = c.ewm(span=macd[0], adjust=False).mean() - c.ewm(span=macd[1], adjust=False).mean()
        out = {"rsi": 100 - 100 / (1 + gain / loss), "atr": wilder(tr, atr), "macd": line, "macd_signal": line.ewm(span=macd[2], adjust=False).mean(), "adx": wilder(100 * (pdi - mdi).abs() / (pdi + mdi), adx)}
        out = {k: v.replace([np.inf, -np.inf], np.nan).astype(object).where(v.notna(), None) for k, v in out.items()}
        return pdf[[SYMBOL, "ts", IDX]].assign(**out)

    return bars.select(SYMBOL, "ts", IDX, "high", "low", "close").groupBy(SYMBOL).applyInPandas(run, schema)


def drawdown_features(bars: DataFrame, window: int) -> DataFrame:
    """Distance from the running high, bars since it, rolling value at risk and the mean beyond it."""
    peak = F.max("close").over(series())
    out = bars.withColumn("ret", F.col("close") / F.lag("close").over(series()) - 1).withColumn("peak", peak)
    out = out.withColumn("at_peak", F.last(F.when(F.col("close") == F.col("peak"), F.col(IDX)), ignorenulls=True).over(series()))
    out = out.withColumns({"drawdown": F.col("close") / F.col("peak") - 1, "bars_since_high": F.col(IDX) - F.col("at_peak"), "var_5": full(F.col("ret"), lambda c: F.percentile(c, 0.05), window)})
    return out.drop("peak", "at_peak")


def candlesticks(bars: DataFrame) -> DataFrame:
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    po, pc = F.lag("open").over(series()), F.lag("close").over(series())
    engulf = F.when((F.col("close") > F.col("open")) & (pc < po) & (F.col("close") >= po) & (F.col("open") <= pc), 1).when((F.col("close") < F.col("open")) & (pc > po) & (F.col("close") <= po) & (F.col("open") >= pc), -1).otherwise(0)
    low_tail = F.least("open", "close") - F.col("low")
    return bars.withColumns({"doji": (body <= 0.1 * span).cast("int"), "hammer": ((low_tail >= 2 * body) & (F.col("high") - F.greatest("open", "close") <= body)).cast("int"), "engulfing": F.coalesce(engulf, F.lit(0))})


def whipsaws(bars: DataFrame, fast: int, slow: int, multiple: float = 1.0) -> DataFrame:
    """Trades between crossovers, and the share of those that last at most ``fast * multiple`` bars."""
    c = crossovers(bars, fast, slow).where("cross <> 0")
    d = c.withColumn("duration", F.lead(IDX).over(series()) - F.col(IDX)).where("duration is not null")
    return d.groupBy(SYMBOL).agg(F.count("*").alias("n_trades"), F.avg((F.col("duration") <= fast * multiple).cast("double")).alias("whipsaw_ratio"), F.avg("duration").alias("mean_duration"))


def regime_durations(df: DataFrame, regime: Column) -> DataFrame:
    """Run number, age, the length of the run before, and the mean length of runs so far."""
    d = df.withColumn("regime", regime)
    d = d.withColumn("new", F.when(F.lag("regime").over(series()).eqNullSafe(F.col("regime")), 0).otherwise(1))
    d = d.withColumn("regime_id", F.sum("new").over(series()))
    within = Window.partitionBy(SYMBOL, "regime_id").orderBy(IDX)
    d = d.withColumn("age", F.row_number().over(within))
    runs = d.groupBy(SYMBOL, "regime_id").agg(F.count("*").alias("length"))
    order = Window.partitionBy(SYMBOL).orderBy("regime_id")
    runs = runs.select(SYMBOL, "regime_id", F.lag("length").over(order).alias("length_before"), F.avg("length").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("expected_length"))
    return d.join(runs, [SYMBOL, "regime_id"]).drop("new")


def entries(bars: DataFrame, side: Column, events: DataFrame | None = None) -> DataFrame:
    """Bars with a side, either at given events or where the side changes."""
    d = bars.withColumn("side", side)
    if events is not None:
        return d.where("side <> 0").join(events.select(SYMBOL, IDX).distinct(), [SYMBOL, IDX], "left_semi")
    return d.withColumn("before", F.lag("side").over(series())).where("side <> 0 and not (side <=> before)").drop("before")
