"""Readers, cleaning and the market views of the driver's tables."""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.keys import with_index


def parsed_times(start, end, zone: str = "UTC") -> tuple[datetime, datetime]:
    """Two times, given as text, seconds since 1970, dates or times, in UTC; the first has to be the sooner."""

    def one(x) -> datetime:
        if isinstance(x, (int, float)):
            return datetime.fromtimestamp(x, UTC)
        t = datetime.fromisoformat(x) if isinstance(x, str) else x if isinstance(x, datetime) else datetime(x.year, x.month, x.day)
        return t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)

    a, b = one(start), one(end)
    if a >= b:
        raise ValueError(f"{start} is not before {end}")
    return a, b


def read_ticks(spark: SparkSession, path: str, columns: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Stored ticks between two times, both included, in order; columns that have a gap are left out. Projection and range reach the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    df = df.select(*columns) if columns else df.drop("year", "month")
    gap = lambda c, t: F.max(F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False)))
    gaps = df.agg(*(gap(c, t).alias(c) for c, t in df.dtypes)).first()
    return df.drop(*(c for c in df.columns if gaps[c])).orderBy("symbol", "ts", *(["seq"] if "seq" in df.columns else []))


def write_ticks(df: DataFrame, path: str) -> None:
    """By symbol, year and month, zstd; what is stored already stays, and only later ticks of a symbol are added."""
    spark = df.sparkSession
    parts = df.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    stored = spark._jvm.org.apache.hadoop.fs.Path(path)
    if stored.getFileSystem(spark._jsc.hadoopConfiguration()).exists(stored):
        last = spark.read.parquet(path).groupBy("symbol").agg(F.max("ts").alias("last_ts"))
        parts = parts.join(F.broadcast(last), "symbol", "left").where("last_ts is null or ts > last_ts").drop("last_ts")  # a row a symbol
    parts.repartition("symbol", "year", "month").write.mode("append").partitionBy("symbol", "year", "month").option("compression", "zstd").parquet(path)


def load_bars(spark: SparkSession, path: str, timeframe: str, start=None, end=None, purpose: str = "research", log: str | None = None) -> DataFrame:
    """Stored ticks to bars of a timeframe, in one call; what was read, and what for, goes to an access log if one is named."""
    from tickloom.operators.bars import time_bars

    if log:
        entry = [(path, timeframe, None if start is None else str(start), None if end is None else str(end), purpose)]
        spark.createDataFrame(entry, "dataset string, timeframe string, first string, last string, purpose string").withColumn("at", F.current_timestamp()).write.mode("append").json(log)
    return time_bars(read_ticks(spark, path, start=start, end=end), timeframe)


def write_records(df: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as CSV with a header, as JSON lines, or as Parquet."""
    writer = df.write.mode("append")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def model_logs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Logs of experiments, JSON lines, as a table; lines that are no JSON are left out."""
    raw = spark.read.text(path).select("value")
    schema = schema or spark.read.json(path).drop("_corrupt_record").schema.simpleString()
    return raw.select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*").dropna("all")


def read_csv_ticks(spark: SparkSession, path: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss.SSS", symbol: str = "X") -> DataFrame:
    """Trades of a CSV with time, price and volume; a header row is expected."""
    raw = spark.read.schema("ts timestamp, price double, volume double").option("header", True).option("timestampFormat", timestamp_format).csv(path)
    return raw.select(F.lit(symbol).alias("symbol"), "*")


def stage(df: DataFrame, path: str) -> DataFrame:
    """``df`` as it lies at a path: written there once, read on every later call."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_ticks(quotes: DataFrame, min_spread: float = 1e-5) -> DataFrame:
    """Valid quotes (positive, ask above bid by ``min_spread``), the last of each time."""
    valid = quotes.dropna().where((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") > F.col("bid")) & (F.col("ask") - F.col("bid") >= min_spread))
    last = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc("seq")))
    return valid.withColumn("nth", last).where("nth = 1").drop("nth")


def access_report(log: DataFrame) -> DataFrame:
    """How often each dataset was used for each purpose, and what that makes a later test worth."""
    n = lambda purpose: F.sum(F.when(F.col("purpose") == purpose, 1).otherwise(0))
    level = F.when(F.col("n_test") == 0, "CLEAN").when(F.col("n_test") <= 2, "ACCEPTABLE").when(F.col("n_test") <= 10, "WARNING").otherwise("CONTAMINATED")
    return log.groupBy("dataset").agg(F.count("*").alias("n_access"), *(n(p).alias(f"n_{p}") for p in ("train", "validate", "optimize", "research", "test"))).withColumn("level", level)


def events_ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """Trades of the event stream; those without a positive price are no trades."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    return e.select(F.col(symbol).cast("string").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("int") + 1).cast("double").alias("volume"))


def events_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = 0.005 * (1 + F.col("seq") % 5)
    return events_ticks(spark, sf_dir).withColumn("bid", F.col("price") - half).withColumn("ask", F.col("price") + half)


def events_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_index(events_ticks(spark, sf_dir).withColumnRenamed("price", "close"), ("ts", "seq"), "day").select("symbol", "ts", "bar_idx", "close")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a day for each return flag."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    t = li.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("q"))
    bars = t.groupBy("symbol", "ts").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count("*").alias("tick_volume"), F.sum("q").alias("volume"), F.sum(F.col("p") * F.col("q")).alias("dollar_volume"))
    return with_index(bars)


#: The same views in SQL, as common table expressions.
CTE = {
    "ticks": "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(CAST(json_extract_string(props, '$.k') AS INT) + 1 AS DOUBLE) AS volume FROM events WHERE value > 0)",
    "quotes": "quotes AS (SELECT *, price - 0.005 * (1 + seq % 5) AS bid, price + 0.005 * (1 + seq % 5) AS ask FROM ticks)",
    "closes": "closes AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS bar_idx, price AS close FROM ticks)",
    "bars": """trades AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k, l_extendedprice / l_quantity AS p, l_quantity AS q FROM lineitem),
      bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM (SELECT symbol, ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, count(*) AS tick_volume, sum(q) AS volume, sum(p * q) AS dollar_volume FROM trades GROUP BY symbol, ts))""",
}


def views(*names: str) -> str:
    return ",\n".join(CTE[n] for n in names)
