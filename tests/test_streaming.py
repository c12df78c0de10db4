"""A finished stream gives what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, sampling
from tickloom.sources import market
from tickloom.streaming import live


@pytest.fixture(scope="module")
def source(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ticks") / "t")
    ticks = market.events_ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ticks.repartition(1).write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(ticks.schema).parquet(path)


def finished(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_time_bars(spark, source):
    batch, stream = source
    want = {tuple(r) for r in bars.time_bars(batch, "D1").select("symbol", "ts", "open", "high", "low", "close", "tick_volume").collect()}
    got = {tuple(r) for r in finished(spark, live.time_bars(stream, "D1"), "bars").select("symbol", "ts", "open", "high", "low", "close", "tick_volume").collect()}
    assert got <= want and len(want) - len(got) <= 10  # those the watermark hasn't passed


def test_cusum_and_tick_bars(spark, source):
    batch, stream = source
    indexed = market.with_index(batch.withColumnRenamed("price", "close"), ("ts", "seq"))
    want = sorted(map(tuple, sampling.cusum_filter(indexed, 2.0).select("symbol", "ts", "direction").collect()))
    assert sorted(map(tuple, finished(spark, live.cusum_events(stream, 2.0), "events_out").collect())) == want
    columns = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    want = sorted(map(tuple, bars.tick_bars(batch, 50).select(*columns).collect()))
    assert sorted(map(tuple, finished(spark, live.tick_bars(stream, 50), "tick_bars_out").select(*columns).collect())) == want


def test_position_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 1, 1), ("a", 3, -1, 1), ("a", 4, 1, -1)], "symbol string, t long, side int, step int").withColumn("ts", F.timestamp_seconds("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    got = finished(spark, live.position_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))), "counts", "update").collect()
    assert [tuple(r) for r in got] == [("a", 1, 1, 2, 1)]
