"""Feature matrices: fractal signals, calendar, reversion to bands, currencies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.keys import IDX, SYMBOL, folded, full, ratio, series, trailing
from tickloom.operators import features as X
from tickloom.operators import volatility as R


def fractal_strengths(bars: DataFrame, n: int = 2, least: float = 0.001) -> DataFrame:
    """Fractals with their strength (how far the extreme lies from the mean of its window), which of them reach ``least``, and the breakouts ``n`` bars later."""
    around = series().rowsBetween(-n, n)
    d = X.fractals(bars, n).drop("resistance", "support", "breakout")
    d = d.withColumns({"up_strength": F.when(F.col("up") == 1, F.col("high") / F.avg("high").over(around) - 1).otherwise(0.0), "down_strength": F.when(F.col("down") == 1, 1 - F.col("low") / F.avg("low").over(around)).otherwise(0.0)})
    then = lambda c: F.lag(c, n).over(series())
    return d.withColumns({
        "valid_up": ((F.col("up") == 1) & (F.col("up_strength") > least)).cast("int"), "valid_down": ((F.col("down") == 1) & (F.col("down_strength") > least)).cast("int"),
        "break_up": F.coalesce(((F.col("close") > then("high")) & (then("down") == 1)).cast("int"), F.lit(0)), "break_down": F.coalesce(((F.col("close") < then("low")) & (then("up") == 1)).cast("int"), F.lit(0)),
    })


def fractal_levels(strengths: DataFrame, lookback: int = 20) -> DataFrame:
    """The highest of the last ``lookback`` valid upper fractals, the lowest of the lower ones, carried on, and how far the bar's middle is from them."""
    def level(flag: str, price: str, agg) -> DataFrame:
        last = Window.partitionBy(SYMBOL).orderBy(IDX).rowsBetween(-(lookback - 1), 0)
        return strengths.where(F.col(flag) == 1).select(SYMBOL, IDX, agg(price).over(last).alias(f"level_{flag}"))

    d = strengths.join(level("valid_up", "high", F.max), [SYMBOL, IDX], "left").join(level("valid_down", "low", F.min), [SYMBOL, IDX], "left")
    d = d.withColumns({k: F.last(f"level_{v}", ignorenulls=True).over(series()) for k, v in (("resistance", "valid_up"), ("support", "valid_down"))}).drop("level_valid_up", "level_valid_down")
    middle = (F.col("high") + F.col("low")) / 2
    return d.withColumns({"to_resistance": (F.col("resistance") - middle) / middle, "to_support": (middle - F.col("support")) / middle})


def fractal_trend(strengths: DataFrame, window: int = 20) -> DataFrame:
    """Density and balance of breakouts over ``window`` bars, and the close against its mean."""
    return strengths.withColumns({
        "density": full(F.col("break_up") + F.col("break_down"), F.sum, window) / window, "direction": F.signum(full(F.col("break_up") - F.col("break_down"), F.sum, window)),
        "ma_ratio": F.col("close") / full(F.col("close"), F.avg, window) - 1,
    })


def fractal_signals(trend: DataFrame, volatility: Column, back: int = 2) -> DataFrame:
    """Breakouts that the balance does not oppose, and their strength in units of volatility, from 0 to 1."""
    d = trend.withColumns({"buy": F.coalesce(((F.col("break_up") == 1) & (F.col("direction") >= 0)).cast("int"), F.lit(0)), "sell": F.coalesce(((F.col("break_down") == 1) & (F.col("direction") <= 0)).cast("int"), F.lit(0))})
    of = lambda c: F.lag(c, back).over(series()) / (volatility + 1e-8)
    raw = F.when(F.col("sell") == 1, of("up_strength")).when(F.col("buy") == 1, of("down_strength")).otherwise(0.0)
    return d.withColumn("strength", F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))))


def fractal_matrix(bars: DataFrame, n: int = 2, least: float = 0.001, lookback: int = 20, window: int = 20) -> DataFrame:
    """All of the above in one go; volatility is Parkinson's."""
    d = R.parkinson(fractal_trend(fractal_levels(fractal_strengths(bars, n, least), lookback), window), window)
    return fractal_signals(d, F.col("vol"))


def time_matrix(bars: DataFrame, terms: int = 3, durations: bool = False, forex: bool = True, window: int = 20) -> DataFrame:
    """Cycles of the calendar; with ``durations`` the seconds since the bar before and their change; with ``forex`` session flags and, for each, the deviation of the last ``window`` returns inside it."""
    cycles = [c for c in X.cyclical(bars, terms).columns if c not in bars.columns]
    flags = [c for c in X.sessions(bars).columns if c not in bars.columns] if forex else []
    spans = ["bar_duration", "bar_duration_change"] if durations else []
    vols = [f"{c}_vol" for c in flags]
    d = X.sessions(bars) if forex else bars
    if spans or flags:
        d = _in_order(d, flags, spans, vols, window)
    return X.cyclical(d, terms).select(*bars.columns, *cycles, *spans, *flags, *vols)


def _in_order(bars: DataFrame, flags: list[str], spans: list[str], vols: list[str], window: int) -> DataFrame:
    """What :func:`time_matrix` takes from bars before, in one pass over each symbol, batch by batch: a symbol is only sorted, in narrow rows."""
    d = bars.withColumns({"_s": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "_l": F.ln("close") if flags else F.lit(0.0)})

    def change(x: np.ndarray, before: float) -> np.ndarray:
        return np.diff(x, prepend=before)

    def deviations(x: np.ndarray) -> np.ndarray:
        """Of each window of ``x``, over its values that are there; none from under two."""
        w = np.lib.stride_tricks.sliding_window_view(x, window)
        there = ~np.isnan(w)
        n = there.sum(axis=1)
        mean = np.where(there, w, 0.0).sum(axis=1) / np.maximum(n, 1)
        squares = np.where(there, (w - mean[:, None]) ** 2, 0.0).sum(axis=1)
        return np.where(n > 1, np.sqrt(squares / np.maximum(n - 1, 1)), np.nan)

    def step(pdf: pd.DataFrame, state):
        s0, t0, l0, own = state or (np.nan, np.nan, np.nan, {c: (np.full(window - 1, np.nan), np.nan) for c in flags})
        s, log = pdf["_s"].to_numpy(float), pdf["_l"].to_numpy(float)
        t = change(s, s0)
        made = dict(zip(spans, (t, change(t, t0)), strict=False))
        r, own = change(log, l0), dict(own)
        for c, name in zip(flags, vols, strict=True):
            past, carried = own[c]
            inside = pdf[c].to_numpy(float) == 1
            past = np.concatenate([past, r[inside]])
            v = np.concatenate([[carried], deviations(past) if inside.any() else []])
            made[name] = v[np.cumsum(inside)]
            own[c] = (past[len(past) - (window - 1) :], v[-1])
        return pdf.drop(columns=["_s", "_l"]).assign(**made), (s[-1], t[-1], log[-1], own)

    schema = ", ".join([*(f"`{n}` {t}" for n, t in bars.dtypes), *(f"`{n}` double" for n in [*spans, *vols])])
    return folded(d, step, schema)


def band_matrix(bars: DataFrame, window: int = 20, width: float = 2.0, averages: tuple[int, ...] = (10, 20, 50, 100, 200), lags: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Features of a reversion to bands, known a bar before: volatility, lagged returns in its units, shape and autocorrelation of returns, bands, indicators, averages in units of range, crossovers and the band's side. Rows with a gap are left out."""
    d = R.garman_klass(bars, window)
    d = R.lagged_returns(d, list(lags), 3)
    returns = [c for c in d.columns if c.startswith("returns_")]
    d = d.withColumns({c.replace("returns", "ret"): ratio(F.col(c), F.col("vol")) for c in returns}).drop(*returns)
    d = R.rolling_autocorrelation(d, window).drop("ret")
    d = R.return_moments(d, window, least=window).drop("z").withColumnsRenamed({"skew": "ret_skew", "kurt": "ret_kurt"})
    d = d.withColumns({f"autocorr_{t}": F.lag("autocorr", t).over(series()) for t in range(1, 6)})
    d = X.bollinger(d, window, width).drop("mid", "upper", "lower")
    before = F.lag("close").over(series())
    d = d.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    d = d.join(X.indicators(bars).drop("ts"), [SYMBOL, IDX])
    low, high = full(F.col("rsi"), F.min, 14), full(F.col("rsi"), F.max, 14)
    d = d.withColumn("stoch_rsi", 100 * ratio(F.col("rsi") - low, high - low))
    plain = X.moving_average_differences(d, list(averages))
    gaps = [c for c in plain.columns if c.startswith("diff_")]
    d = plain.withColumns({c: ratio(F.col(c), F.col("atr")) for c in gaps}).withColumns({c.replace("diff", "cross"): F.when(F.col(c).isNotNull() & F.lag(c).over(series()).isNotNull(), F.when(F.signum(c) != F.signum(F.lag(c).over(series())), F.signum(c).cast("int")).otherwise(0)) for c in gaps})
    made = [c for c in d.columns if c not in set(bars.columns) | {SYMBOL, "ts", IDX}]
    return d.select(SYMBOL, "ts", IDX, *(F.lag(c).over(series()).alias(c) for c in made)).dropna()


def currency_matrix(bars: DataFrame, window: int = 20, long: int = 50) -> DataFrame:
    """Rate of change, efficiency, slope of a line, counts of higher highs and lower lows, volatility and its regime, value at risk with the mean beyond, stress, strength against the other symbols and correlation with them; all known a bar before, gaps filled with the last value, then 0."""
    w = trailing(window)
    d = bars.withColumn("ret", F.ln("close") - F.lag(F.ln("close")).over(series()))
    others = d.where("ret is not null").groupBy("ts").agg(F.sum("ret").alias("all_ret"), F.count("ret").alias("n_ret"))
    d = d.join(others, "ts", "left").withColumn("others", F.when(F.col("n_ret") > 1, (F.col("all_ret") - F.col("ret")) / (F.col("n_ret") - 1))).withColumn("others", F.last("others", ignorenulls=True).over(series())).drop("all_ret", "n_ret")
    d = d.withColumns({"step": F.abs(F.col("close") - F.lag("close").over(series())), "hh": (F.col("high") > F.lag("high").over(series())).cast("int"), "ll": (F.col("low") < F.lag("low").over(series())).cast("int"), "vol": full(F.col("ret"), F.stddev_samp, window), "var_5": full(F.col("ret"), lambda c: F.percentile(c, 0.05), long)})
    tail = F.filter(F.collect_list("ret").over(trailing(long)), lambda x: x <= F.col("var_5"))
    d = d.withColumns({
        "roc": F.col("close") / F.lag("close", window).over(series()) - 1, "efficiency": ratio(F.abs(F.col("close") - F.lag("close", window).over(series())), full(F.col("step"), F.sum, window)),
        "slope": F.when(F.count("close").over(w) == window, F.regr_slope("close", IDX).over(w)), "higher_highs": full(F.col("hh"), F.sum, window), "lower_lows": full(F.col("ll"), F.sum, window),
        "vol_regime": ratio(F.col("vol"), full(F.col("vol"), F.avg, long)), "tail": tail, "stress": (F.col("ret") < F.col("var_5")).cast("int"),
        "strength": full(F.col("ret") - F.col("others"), F.sum, window), "with_others": F.when(F.count(F.col("ret") + F.col("others")).over(w) == window, F.covar_pop("ret", "others").over(w) / F.nullif(F.stddev_pop("ret").over(w) * F.stddev_pop("others").over(w), F.lit(0.0))),
    }).withColumn("cvar_5", F.when(F.col("var_5").isNotNull(), F.aggregate("tail", F.lit(0.0), lambda s, x: s + x) / F.size("tail")))
    made = ["roc", "efficiency", "slope", "higher_highs", "lower_lows", "vol", "vol_regime", "var_5", "cvar_5", "stress", "strength", "with_others"]
    known = {c: F.coalesce(F.last(c, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1)).cast("double"), F.lit(0.0)) for c in made}
    return d.select(SYMBOL, "ts", IDX, *(v.alias(c) for c, v in known.items()))
