"""Event filters, barriers, labels, and what overlapping labels are worth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.keys import IDX, SYMBOL, folded, full, ratio, series
from tickloom.operators.touches import first_touches


def cusum_filter(bars: DataFrame, threshold: float | str) -> DataFrame:
    """``symbol, ts, bar_idx, direction`` where the sum of log returns since the last event leaves a band.

    The sums restart at each event, so that a symbol is folded in order in one task, batch by batch;
    symbols run in parallel. ``threshold`` is a number or a column. Prices and thresholds have to be positive.
    """
    column = F.lit(float(threshold)) if not isinstance(threshold, str) else F.col(threshold).cast("double")
    rows = bars.select(SYMBOL, "ts", IDX, F.col("close").cast("double").alias("close"), column.alias("h"))

    def fold(pdf: pd.DataFrame, state):
        price, h = pdf["close"].to_numpy(), pdf["h"].to_numpy()
        if not (price > 0).all() or not (h > 0).all():
            raise ValueError("prices and thresholds must be positive")
        log = np.log(price)
        before, up, down = state or (log[0], 0.0, 0.0)
        hits, side = [], []
        for i, r in enumerate(np.diff(log, prepend=before).tolist()):
            up, down = max(0.0, up + r), min(0.0, down + r)
            if down < -h[i]:
                down = 0.0
                hits.append(i)
                side.append(-1)
            elif up > h[i]:
                up = 0.0
                hits.append(i)
                side.append(1)
        return pdf.iloc[hits][[SYMBOL, "ts", IDX]].assign(direction=np.array(side, np.int32)), (log[-1], up, down)

    return folded(rows, fold, f"{SYMBOL} string, ts timestamp, {IDX} long, direction int")


def z_score_filter(bars: DataFrame, mean_window: int, std_window: int, z: float = 3.0) -> DataFrame:
    """Bars whose close is at or over the rolling mean by ``z`` rolling deviations."""
    return bars.withColumn("limit", full(F.col("close"), F.avg, mean_window) + z * full(F.col("close"), F.stddev_samp, std_window)).where(F.col("close") >= F.col("limit")).drop("limit")


def vertical_barriers(events: DataFrame, bars: DataFrame, n_bars: int | None = None, interval: str | None = None) -> DataFrame:
    """``events`` with ``i1, t1``: ``n_bars`` on, or the first bar an interval later or after; null beyond the end."""
    if (n_bars is None) == (interval is None):
        raise ValueError("either a number of bars or an interval")
    if n_bars is not None:
        ends = bars.select(SYMBOL, F.col(IDX).alias("i1"), F.col("ts").alias("t1"))
        return events.withColumn("i1", F.col("i0") + n_bars).join(ends, [SYMBOL, "i1"], "left").withColumn("i1", F.when(F.col("t1").isNotNull(), F.col("i1")))
    rest = [c for c in events.columns if c not in (SYMBOL, "i0")]
    marks = events.select(SYMBOL, (F.col("t0") + F.expr(f"interval {interval}")).alias("ts"), F.struct("i0", *rest).alias("event"))
    return neighbours(marks, bars).select(SYMBOL, "event.*", F.col("after.bar_idx").alias("i1"), F.col("after.bar_ts").alias("t1"))


def triple_barrier_events(events: DataFrame, bars: DataFrame, pt: float, sl: float, min_ret: float = 0.0) -> DataFrame:
    """First touch of the profit, loss and vertical barriers.

    ``events(symbol, i0, t0, i1, trgt[, side])``, a null ``i1`` meaning the end of the series for the
    search, which is :func:`first_touches`. Levels are multiples of ``trgt``; 0 switches a barrier off.
    Returns the events with ``hit_idx, t1, barrier``.
    """
    ev = events.where(F.col("trgt") > min_ret)
    ev = ev if "side" in ev.columns else ev.withColumn("side", F.lit(1))
    level = lambda x, sign: sign * F.lit(float(x)) * F.col("trgt") if x > 0 else F.lit(None).cast("double")
    side = ev.select(SYMBOL, "side").schema["side"].dataType
    out = first_touches(ev.withColumns({"end": F.col("i1"), "up": level(pt, 1), "down": level(sl, -1)}), bars).withColumn("side", F.col("side").cast(side))
    out = out.withColumn("hit_idx", F.coalesce("touch_idx", "i1")).where("hit_idx is not null")
    kind = F.when(F.col("touch_idx").isNull(), "vertical").when(F.col("falls"), "sl").otherwise("pt")
    ends = bars.select(SYMBOL, F.col(IDX).alias("hit_idx"), F.col("ts").alias("hit_ts"))
    return out.withColumn("barrier", kind).drop("t1").join(ends, [SYMBOL, "hit_idx"]).withColumnRenamed("hit_ts", "t1").drop("touch_idx", "falls", "p0", "i1")


def barrier_labels(touched: DataFrame, bars: DataFrame, meta: bool = False, levels: tuple[float, float] | None = None) -> DataFrame:
    """``ret`` over each event and its ``bin``: the sign (0 counts as -1), or with ``levels`` (multiples of ``trgt`` for profit and loss) 0 unless the return lies beyond one; with ``meta`` events that did not earn have 0."""
    p = bars.select(SYMBOL, IDX, F.col("close"))
    out = touched.join(p.select(SYMBOL, F.col(IDX).alias("i0"), F.col("close").alias("p0")), [SYMBOL, "i0"]).join(p.select(SYMBOL, F.col(IDX).alias("hit_idx"), F.col("close").alias("p1")), [SYMBOL, "hit_idx"])
    out = out.withColumn("ret", (F.col("p1") / F.col("p0") - 1) * F.col("side")).drop("p0", "p1")
    label = F.when(F.col("ret") > 0, 1).otherwise(-1)
    if levels:
        r = F.col("ret")
        label = F.when((r > 0) & (r > levels[0] * F.col("trgt")), 1).when((r < 0) & (r < -levels[1] * F.col("trgt")), -1).otherwise(0)
    if meta:
        label = F.when(F.col("ret") <= 0, 0).otherwise(label)
    return out.withColumn("bin", label.cast("int"))


def common_classes(counts: DataFrame, min_share: float = 0.05) -> DataFrame:
    """``counts(bin, n, ...)``, a row a class, without the rarest classes, one after another, while one is under ``min_share`` and more than two are left."""
    rising = Window.orderBy("n", "bin")
    goes = (F.col("n") / F.col("_rest") < min_share) & (F.col("_left") > 2)
    d = counts.withColumns({"_rest": F.sum("n").over(Window.orderBy(F.desc("n"), F.desc("bin"))), "_left": F.row_number().over(Window.orderBy(F.desc("n"), F.desc("bin")))})
    return d.withColumn("_goes", F.min(goes).over(rising)).where(~F.col("_goes")).drop("_rest", "_left", "_goes")


def drop_labels(labels: DataFrame, min_share: float = 0.05) -> DataFrame:
    """The rows of :func:`common_classes`."""
    kept = common_classes(labels.groupBy("bin").agg(F.count("*").alias("n")), min_share)
    return labels.join(F.broadcast(kept.select("bin")), "bin").select(*labels.columns)  # one row a class


def fixed_horizon_labels(bars: DataFrame, threshold: float, window: int | None = None, lag: bool = True) -> DataFrame:
    """``-1, 0, 1`` of the next (or last) return against a threshold, standardised over ``window`` if given."""
    ret = F.col("close") / F.lag("close").over(series()) - 1
    out = bars.withColumn("ret", ret)
    if lag:
        out = out.withColumn("ret", F.lead("ret").over(series()))
    if window:
        out = out.withColumn("ret", (F.col("ret") - full(F.col("ret"), F.avg, window)) / F.nullif(full(F.col("ret"), F.stddev_samp, window), F.lit(0.0)))
    return out.withColumn("label", F.when(F.col("ret") < -threshold, -1).when(F.col("ret") > threshold, 1).when(F.col("ret").isNotNull(), 0))


def trend_scanning_labels(bars: DataFrame, spans: tuple[int, int], log: bool = True, ahead: bool = True) -> DataFrame:
    """For each bar the horizon with the strongest trend: ``t_value, slope, r_squared, window, t1, ret, bin``.

    Windows begin at the bar, or end at it unless ``ahead``, and time then runs backwards in the slope.
    Slopes of all horizons of ``range(*spans)`` come from running sums of the series and of its product
    with the position, so that a horizon costs a subtraction. Bars without room for the longest have no label.
    """
    y = F.ln("close") if log else F.col("close")
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    whole, longest = Window.partitionBy(SYMBOL), max(range(*spans))
    d = bars.withColumn("y", y - F.avg(y).over(whole))
    d = d.withColumns({"sy": F.sum("y").over(w), "syy": F.sum(F.col("y") * F.col("y")).over(w), "sty": F.sum(F.col("y") * F.col(IDX)).over(w), "n": F.count("*").over(whole)})
    stats = []
    for length in range(*spans):
        first = F.lag if not ahead else lambda c, k: F.col(c)
        last = F.lead if ahead else lambda c, k: F.col(c)
        at = lambda c, f, k=length: f(c, k - 1).over(series()) if f in (F.lag, F.lead) else f(c, k - 1)
        over = lambda total, own, f=first, g=last: at(total, g) - at(total, f) + own
        y0, i0 = at("y", first), at(IDX, first)
        sy, syy, sty = over("sy", y0), over("syy", y0 * y0), over("sty", y0 * i0)
        tbar, stt = (length - 1) / 2, length * (length * length - 1) / 12
        sxy = sty - i0 * sy - tbar * sy
        slope = sxy / stt
        total = syy - sy * sy / length
        sse = F.greatest(total - slope * sxy, F.lit(0.0))
        t = slope / (F.sqrt(sse / (length - 2) / stt) + 1e-9)
        sign = 1 if ahead else -1
        stats.append(F.struct(F.abs(t).alias("size"), F.lit(-length).alias("nwindow"), (sign * t).alias("t"), (sign * slope).alias("slope"), (1 - ratio(sse, total)).alias("r_squared"), (at("close", last) / at("close", first) - 1).alias("ret"), at("ts", last if ahead else first).alias("t1")))
    room = F.col(IDX) < F.col("n") - longest if ahead else F.col(IDX) >= longest - 1
    d = d.withColumn("best", F.array_max(F.array(*stats))).where(room)
    return d.select(SYMBOL, "ts", IDX, (-F.col("best.nwindow")).alias("window"), F.col("best.slope").alias("slope"), F.col("best.t").alias("t_value"), F.col("best.r_squared").alias("r_squared"), F.col("best.t1").alias("t1"), F.col("best.ret").alias("ret"), F.when(F.abs("best.t") <= 1e-6, 0).otherwise(F.signum("best.t")).cast("int").alias("bin"))


def indicator_uniqueness(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``symbol, uniqueness``: the mean of 1 / concurrency over all cells of the indicator matrix, without making it.

    Each bar with labels adds as many cells as labels, of one in all.
    """
    c = concurrency(events, bars).where("n_concurrent > 0")
    return c.groupBy(SYMBOL).agg((F.count("*") / F.sum("n_concurrent")).alias("uniqueness"))


def neighbours(marks: DataFrame, bars: DataFrame) -> DataFrame:
    """``marks(symbol, ts, ...)`` with the last bar at or ``before`` and the first at or ``after`` its time, as ``bar_ts, bar_idx``; of bars at one time the last and the first.

    Both run along the rows of an hour, one task each, ``after`` from the hour's end; what other hours
    hold comes from one row an hour. Frames never reach ahead, since Spark goes over such a one anew for each row.
    """
    names = [c for c in marks.columns if c not in (SYMBOL, "ts")]
    kind = "struct<bar_ts:timestamp,bar_idx:bigint>"
    both = marks.select(SYMBOL, "ts", F.struct(*names).alias("mark") if names else F.lit(1).alias("mark"), F.lit(1).alias("is_mark"), F.lit(None).cast(kind).alias("bar"))
    points = bars.select(SYMBOL, "ts", F.lit(None).cast(both.schema["mark"].dataType).alias("mark"), F.lit(0).alias("is_mark"), F.struct(F.col("ts").alias("bar_ts"), F.col(IDX).alias("bar_idx")).cast(kind).alias("bar"))
    d = both.unionByName(points).withColumn("_hour", F.date_trunc("hour", "ts"))
    own, of_hours = Window.partitionBy(SYMBOL, "_hour"), Window.partitionBy(SYMBOL)
    last = lambda c, w, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    ends = [f(f"bar.{c}").alias(c) for f in (F.max, F.min) for c in ("bar_ts", "bar_idx")]
    hours = d.groupBy(SYMBOL, "_hour").agg(F.when(F.count("bar.bar_idx") > 0, F.struct(*ends[:2])).alias("hi"), F.when(F.count("bar.bar_idx") > 0, F.struct(*ends[2:])).alias("lo"))
    hours = hours.select(SYMBOL, "_hour", last("hi", of_hours.orderBy("_hour"), -1).alias("_hi"), last("lo", of_hours.orderBy(F.desc("_hour")), -1).alias("_lo"))
    d = d.withColumns({"before": last("bar", own.orderBy("ts", "is_mark", "bar.bar_idx"), 0), "after": last("bar", own.orderBy(F.desc("ts"), "is_mark", F.desc("bar.bar_idx")), 0)}).where("is_mark = 1")
    return d.join(hours, [SYMBOL, "_hour"], "left").select(SYMBOL, "ts", *([F.col(f"mark.{c}") for c in names]), F.coalesce("before", "_hi").alias("before"), F.coalesce("after", "_lo").alias("after"))


def nearest(marks: DataFrame, bars: DataFrame) -> DataFrame:
    """``marks(symbol, ts, ...)`` with the bar nearest in time: ``bar_idx, bar_ts``; of two as near, the later."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    late = F.col("after").isNotNull() & (F.col("before").isNull() | (micros("after.bar_ts") - micros("ts") <= micros("ts") - micros("before.bar_ts")))
    d = neighbours(marks, bars).withColumn("near", F.when(late, F.col("after")).otherwise(F.col("before")))
    return d.drop("before", "after").select("*", "near.*").drop("near")


def concurrency(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``n_concurrent`` labels at each bar, both ends included: +1 where one starts, -1 after its end, summed up."""
    last = bars.groupBy(SYMBOL).agg(F.max(IDX).alias("last"))
    ev = events.join(last, SYMBOL).select(SYMBOL, "i0", F.coalesce("i1", "last").alias("i1"))
    steps = ev.select(SYMBOL, F.col("i0").alias(IDX), F.lit(1).alias("step")).unionByName(ev.select(SYMBOL, (F.col("i1") + 1).alias(IDX), F.lit(-1).alias("step"))).groupBy(SYMBOL, IDX).agg(F.sum("step").alias("step"))
    return bars.join(steps, [SYMBOL, IDX], "left").withColumn("n_concurrent", F.sum(F.coalesce("step", F.lit(0))).over(series())).drop("step")


def label_weights(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``events`` with ``tw`` (mean of 1 / concurrency over the label's bars) and ``w`` (return attributed to it, scaled to a mean of 1).

    Both are differences of running sums at the label's ends: two joins on the position, whatever its length.
    """
    c = concurrency(events, bars).withColumn("r", F.ln("close") - F.lag(F.ln("close")).over(series()))
    run = series().rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("n_concurrent") > 0, 1 / F.col("n_concurrent"))
    sums = c.select(SYMBOL, IDX, F.sum(F.coalesce(share, F.lit(0.0))).over(run).alias("su"), F.sum(F.coalesce(F.col("r") * share, F.lit(0.0))).over(run).alias("sr"))
    last = bars.groupBy(SYMBOL).agg(F.max(IDX).alias("last"))
    ev = events.join(last, SYMBOL).withColumn("e1", F.coalesce("i1", "last")).withColumn("b0", F.col("i0") - 1)
    end = sums.select(SYMBOL, F.col(IDX).alias("e1"), F.col("su").alias("su1"), F.col("sr").alias("sr1"))
    start = sums.select(SYMBOL, F.col(IDX).alias("b0"), F.col("su").alias("su0"), F.col("sr").alias("sr0"))
    j = ev.join(end, [SYMBOL, "e1"]).join(start, [SYMBOL, "b0"], "left").fillna(0.0, ["su0", "sr0"])
    j = j.withColumn("tw", (F.col("su1") - F.col("su0")) / (F.col("e1") - F.col("i0") + 1)).withColumn("w", F.abs(F.col("sr1") - F.col("sr0")))
    part = Window.partitionBy(SYMBOL)
    return j.withColumn("w", F.col("w") * F.count("*").over(part) / F.nullif(F.sum("w").over(part), F.lit(0.0))).drop("su0", "su1", "sr0", "sr1", "e1", "b0", "last")


def time_decay(weights: DataFrame, last: float = 1.0, linear: bool = True) -> DataFrame:
    """``decay`` over the summed uniqueness: linear down to ``last`` for the oldest (0 where it would be negative), or ``last`` to the power of age."""
    w = Window.partitionBy(SYMBOL).orderBy("i0").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("tw").over(Window.partitionBy(SYMBOL))
    x = F.sum("tw").over(w)
    if not linear:
        return weights.withColumn("decay", F.lit(1.0) if last in (0, 1) else F.pow(F.lit(abs(float(last))), (total - x) / total))
    slope = (1 - last) / total if last >= 0 else 1 / ((last + 1) * total)
    return weights.withColumn("decay", F.greatest(1 - slope * total + slope * x, F.lit(0.0)))


def indicator(events: DataFrame) -> DataFrame:
    """The label indicator matrix as rows ``symbol, i0, bar_idx``."""
    return events.select(SYMBOL, "i0", F.explode(F.sequence("i0", "i1")).alias(IDX))


def sequential_bootstrap(spans: DataFrame, draws: int, seeds: list[int]) -> DataFrame:
    """``symbol, seed, nth, pick``: labels drawn one after another, by their mean uniqueness given those drawn before.

    ``pick`` numbers a symbol's labels by ``i0, i1``. The draws of one symbol and seed depend on each
    other and are made in one task; symbols and seeds are drawn in parallel.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, seed = key
        pdf = pdf.sort_values(["i0", "i1"])
        low, high = pdf["i0"].to_numpy(), pdf["i1"].to_numpy()
        u = np.random.RandomState(seed).random_sample(draws)
        base = int(low.min())
        c = np.zeros(int(high.max()) - base + 1)
        picks = []
        for x in u:
            s = np.concatenate([[0], np.cumsum(1 / (c + 1))])
            score = (s[high - base + 1] - s[low - base]) / (high - low + 1)
            k = min(int(np.searchsorted(np.cumsum(score) / score.sum(), x)), len(low) - 1)
            c[low[k] - base : high[k] - base + 1] += 1
            picks.append(k)
        return pd.DataFrame({"symbol": symbol, "seed": seed, "nth": np.arange(draws), "pick": picks})

    seeded = spans.select("symbol", "i0", "i1", F.explode(F.array(*(F.lit(x).cast("long") for x in seeds))).alias("seed"))
    return seeded.groupBy("symbol", "seed").applyInPandas(run, "symbol string, seed long, nth long, pick long")


def meta_label_filter(events: DataFrame, probability: Column, threshold: float) -> DataFrame:
    """Events whose probability is over a threshold; none counts as one half."""
    return events.where(F.coalesce(probability, F.lit(0.5)) > threshold)
