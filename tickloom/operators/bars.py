"""Time and activity bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.keys import SYMBOL, running_sum, series

ORDER = ("ts", "seq")


def resampling(timeframe: str) -> str:
    """``M5``, ``H1``, ``S30``, ``D1`` or ``W1`` as an interval."""
    unit = {"S": "second", "M": "minute", "H": "hour", "D": "day", "W": "week"}.get(timeframe[:1].upper())
    count = timeframe[1:] or "1"
    if unit is None or not count.isdigit() or int(count) < 1:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return f"{int(count)} {unit}{'s' if int(count) > 1 else ''}"


def _ohlc(price: str, prefix: str = "") -> list[Column]:
    at = F.struct(*ORDER)
    return [F.min_by(price, at).alias(f"{prefix}open"), F.max(price).alias(f"{prefix}high"), F.min(price).alias(f"{prefix}low"), F.max_by(price, at).alias(f"{prefix}close")]


def _aggregates(ticks: DataFrame) -> list[Column]:
    out = _ohlc("price") + [F.count("*").alias("tick_volume")]
    if "spread" in ticks.columns:
        out.append(F.avg("spread").alias("spread"))
    if "volume" in ticks.columns:
        out.append(F.sum("volume").alias("volume"))
    return out


def mid_prices(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("price", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.col("ask") - F.col("bid"))


def time_bars(ticks: DataFrame, timeframe: str, fill: bool = False) -> DataFrame:
    """Bars of a timeframe, closed on the left and named by their end; empty ones are left out, or repeat the last close."""
    w = F.window("ts", resampling(timeframe))
    bars = ticks.groupBy(SYMBOL, w.alias("w")).agg(*_aggregates(ticks)).withColumn("ts", F.col("w.end")).drop("w")
    if not fill:
        return bars
    step = F.expr(f"interval {resampling(timeframe)}")
    span = bars.groupBy(SYMBOL).agg(F.explode(F.sequence(F.min("ts"), F.max("ts"), step)).alias("ts"))
    full = span.join(bars, [SYMBOL, "ts"], "left")
    last = F.last("close", ignorenulls=True).over(series("ts"))
    return full.withColumn("close", last).withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")}).withColumn("tick_volume", F.coalesce("tick_volume", F.lit(0)))


def _activity(ticks: DataFrame, bar_id: Column, keep_whole: bool) -> DataFrame:
    bars = ticks.withColumn("bar_id", bar_id.cast("long")).groupBy(SYMBOL, "bar_id").agg(*_aggregates(ticks), (F.max("ts") + F.expr("interval 1 microsecond")).alias("ts"))
    if keep_whole:
        return bars
    return bars.withColumn("last", F.max("bar_id").over(Window.partitionBy(SYMBOL))).where("bar_id < last").drop("last")


def tick_bars(ticks: DataFrame, size: int) -> DataFrame:
    """Bars of ``size`` ticks; an incomplete last one is dropped. Named a microsecond after their last tick."""
    counted = running_sum(ticks, F.lit(1), "at", ORDER)
    return _activity(counted, F.floor((F.col("at") - 1) / size), True).where(F.col("tick_volume") == size)


def volume_bars(ticks: DataFrame, size: float) -> DataFrame:
    """A bar for each ``size`` of volume; the tick that crosses starts the next; the last bar is dropped."""
    return _activity(running_sum(ticks, F.col("volume"), "at", ORDER), F.floor(F.col("at") / size), False)


def dollar_bars(ticks: DataFrame, size: float) -> DataFrame:
    """The same by value traded."""
    return _activity(running_sum(ticks, F.col("volume") * F.col("price"), "at", ORDER), F.floor(F.col("at") / size), False)


def calendar_end(timeframe: str) -> Column:
    """The end of the business day (weekends belong to the Friday before), of the week that Friday starts, or of the month, that a time lies in."""
    day = F.to_date("ts")
    kind = timeframe.upper()
    if kind.startswith("MN"):
        end = F.add_months(F.trunc(day, "month"), 1)
    elif kind.startswith("W"):
        end = F.next_day(day, "FRI")
    elif kind.startswith("D"):
        end = F.date_add(day, F.when(F.weekday(day) >= 4, 7 - F.weekday(day)).otherwise(1))
    else:
        raise ValueError(f"no calendar unit in {timeframe!r}")
    return end.cast("timestamp")


def calendar_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Bars of business days (``D1``), weeks from Friday to Friday (``W1``) or months (``MN1``), named by their end; empty ones are left out."""
    return ticks.withColumn("end", calendar_end(timeframe)).groupBy(SYMBOL, "end").agg(*_aggregates(ticks)).withColumnRenamed("end", "ts")


def bid_ask_bars(quotes: DataFrame, timeframe: str) -> DataFrame:
    """Time bars of bid and of ask, and their mean."""
    w = F.window("ts", resampling(timeframe))
    bars = quotes.groupBy(SYMBOL, w.alias("w")).agg(*_ohlc("bid", "bid_"), *_ohlc("ask", "ask_"), F.count("*").alias("tick_volume")).withColumn("ts", F.col("w.end")).drop("w")
    return bars.withColumns({c: (F.col(f"bid_{c}") + F.col(f"ask_{c}")) / 2 for c in ("open", "high", "low", "close")})


def ticks_per_period(ticks: DataFrame, timeframe: str, method: str = "mean") -> DataFrame:
    """Usual ticks in a timeframe, empty ones counted, to one significant digit and at least 10."""
    freq = resampling(timeframe)
    counts = ticks.groupBy(SYMBOL, F.window("ts", freq).alias("w")).agg(F.count("*").alias("n")).select(SYMBOL, F.col("w.start").alias("start"), "n")
    span = counts.groupBy(SYMBOL).agg(F.explode(F.sequence(F.min("start"), F.max("start"), F.expr(f"interval {freq}"))).alias("start"))
    middle = F.avg("n") if method == "mean" else F.percentile("n", 0.5)
    raw = span.join(counts, [SYMBOL, "start"], "left").fillna(0, ["n"]).groupBy(SYMBOL).agg(F.rint(middle).alias("x"))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest("x", F.lit(1.0)))))
    return raw.select(SYMBOL, F.greatest(F.rint(F.col("x") / unit) * unit, F.lit(10.0)).cast("long").alias("ticks"))
