"""Steps whose cost grows no faster than their rows; results where blocks meet."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from tickloom.operators import learning, matrices, microstructure, sampling, simulation, validation, volatility


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def ticks(spark, hours: list[float], symbol: str = "P"):
    """Bars at these hours, numbered in order."""
    rows = [(symbol, k, h, 100.0 + k) for k, h in enumerate(hours)]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, h double, close double").select("symbol", "bar_idx", F.timestamp_micros((F.col("h") * 3_600_000_000).cast("long")).alias("ts"), "close")


HOURS = [0.5, 0.5, 0.75, 5.0, 5.0, 9.25]


def test_nearest_across_hours(spark):
    marks = ticks(spark, [-3.0, 0.5, 0.7, 2.0, 3.5, 5.0, 8.0, 30.0]).select("symbol", "ts", F.col("bar_idx").alias("i0"))
    got = sampling.nearest(marks, ticks(spark, HOURS))
    assert "unboundedfollowing" not in plan(got)
    assert [r.bar_idx for r in got.orderBy("i0").collect()] == [0, 0, 2, 2, 3, 3, 5, 5]


def test_barriers_in_time_across_hours(spark):
    bars = ticks(spark, HOURS)
    events = bars.select("symbol", F.col("bar_idx").alias("i0"), F.col("ts").alias("t0"))
    got = sampling.vertical_barriers(events, bars, interval="4 hours")
    assert "unboundedfollowing" not in plan(got)
    assert [r.i1 for r in got.orderBy("i0").collect()] == [3, 3, 3, 5, 5, None]
    assert got.columns == ["symbol", "i0", "t0", "i1", "t1"]


def test_word_entropy_needs_no_message(spark):
    prices = [100 + (7 * k * k + k) % 11 for k in range(400)]
    rows = spark.createDataFrame([(s, k, float(p)) for s, n in (("P", 400), ("Q", 3), ("R", 4)) for k, p in enumerate(prices[:n])], "symbol string, bar_idx long, price double")
    letters = microstructure.tick_letters(rows)
    got = microstructure.word_entropy(letters, 3)
    assert "collect_list" not in plan(got)
    of_messages = microstructure.plug_in_entropy(microstructure.encode_tick_rule(rows), 3)
    assert "substring" not in plan(of_messages)
    a, b = ({r.symbol: round(r.plug_in, 9) for r in x.collect()} for x in (got, of_messages))
    assert a == b and set(a) == {"P", "R"} and a["R"] == 0


def _walk(spark, n: int):
    close = np.exp(np.cumsum(np.random.default_rng(5).normal(0, 0.01, n)))
    return close, spark.createDataFrame(pd.DataFrame({"symbol": "P", "bar_idx": np.arange(n), "close": close})).withColumn("ts", F.timestamp_seconds("bar_idx"))


def test_touches_over_blocks(spark):
    n = 70_000  # three blocks
    close, bars = _walk(spark, n)
    rows = [(i0, [i0 + 20, i0 + 30_000, None][k % 3], [0.05, 0.5, 3.0][k // 3 % 3], 1 - 2 * (k % 2)) for k, i0 in enumerate(range(3, n, 997))]
    rows = [(a, b if b is None or b < n else None, t, s) for a, b, t, s in rows]
    events = spark.createDataFrame([("P", *r) for r in rows], "symbol string, i0 long, i1 long, trgt double, side int").withColumn("t0", F.timestamp_seconds("i0"))
    out = sampling.triple_barrier_events(events, bars, 1.0, 0.5)
    assert "sequence(" not in plan(out)
    want = {}
    for a, b, t, s in rows:
        r = (close[a + 1 : (n - 1 if b is None else b) + 1] / close[a] - 1) * s
        hit = np.flatnonzero((r >= t) | (r <= -0.5 * t))
        if len(hit):
            want[a] = (a + 1 + int(hit[0]), "sl" if r[hit[0]] <= -0.5 * t else "pt")
        elif b is not None:
            want[a] = (b, "vertical")
    got = {r.i0: (r.hit_idx, r.barrier) for r in out.collect()}
    assert got == want and {b for _, b in want.values()} == {"sl", "pt", "vertical"} and any(a // 32_768 < h // 32_768 for a, (h, _) in want.items())


def test_rules_without_paths(spark):
    close, bars = _walk(spark, 300)
    entries = bars.select("symbol", F.col("bar_idx").alias("i0"), F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1).alias("side"))
    out = simulation.trading_rule_grid(entries, bars, [(0.02, 0.01), (0.5, 0.03)], 20)
    assert "sequence(" not in plan(out)
    got = {(r.i0, r.pt): r.ret for r in out.collect()}
    want = {}
    for a in range(299):
        r = (close[a + 1 : a + 21] / close[a] - 1) * (1 if a % 2 == 0 else -1)
        for pt, sl in ((0.02, 0.01), (0.5, 0.03)):
            hit = np.flatnonzero((r >= pt) | (r <= -sl))
            want[a, pt] = float(r[-1]) if not len(hit) else pt if r[hit[0]] >= pt else -sl
    assert got == want


def test_rare_classes(spark):
    labels = spark.createDataFrame([(b,) for b, n in ((0, 2), (1, 3), (2, 60), (-1, 40)) for _ in range(n)], "bin int")
    kept = sampling.drop_labels(labels)
    assert {r.bin: r["count"] for r in kept.groupBy("bin").count().collect()} == {2: 60, -1: 40}
    assert sampling.drop_labels(labels, 0.025).groupBy("bin").count().count() == 3


def test_fits_read_their_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(x):
        reads.add(1)
        return x

    n = 60
    data = spark.range(n).select(F.lit("P").alias("symbol"), F.timestamp_seconds("id").alias("t0"), F.timestamp_seconds(F.col("id") + 1).alias("t1"), (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("weight"), F.udf(seen, "double")((F.col("id") * 7 % 11).cast("double")).alias("x"))
    folds = validation.purged_folds(data.select("symbol", "t0", "t1"), 3)
    assert validation.cross_validate(data, folds, ["x"]).count() == 3
    assert reads.value == n
    trees = {str(k): DecisionTreeClassifier(maxDepth=k, weightCol="weight", seed=1) for k in (1, 2)}
    assert learning.hyper_fit(data, folds, ["x"], trees)[0].count() == 6
    assert reads.value == 2 * n


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cusum_over_batches(spark, small_batches):
    close, bars = _walk(spark, 500)
    got = sampling.cusum_filter(bars.unionByName(bars.withColumn("symbol", F.lit("Q"))), 0.02)
    assert "flatmapgroupsinpandas" not in plan(got)
    want, up, down = [], 0.0, 0.0
    for i, r in enumerate(np.diff(np.log(close)), 1):
        up, down = max(0.0, up + r), min(0.0, down + r)
        if down < -0.02:
            down, want = 0.0, [*want, (i, -1)]
        elif up > 0.02:
            up, want = 0.0, [*want, (i, 1)]
    for symbol in "PQ":
        assert [(r.bar_idx, r.direction) for r in got.where(F.col("symbol") == symbol).orderBy("bar_idx").collect()] == want


def test_ewm_over_batches_and_beyond_weights(spark, small_batches):
    x = pd.Series(np.random.default_rng(2).normal(0, 1, 300))
    x[[0, 5, 6]] = None
    rows = spark.createDataFrame([("P", k, None if v != v else float(v)) for k, v in enumerate(x)], "symbol string, bar_idx long, x double")
    for what in ("mean", "std"):
        out = volatility.ewm(rows, "x", 10, "out", what)
        assert "flatmapgroupsinpandas" not in plan(out)
        got = [r.out for r in out.orderBy("bar_idx").collect()]
        want = getattr(x.ewm(span=10), what)()
        assert [None if v != v else round(v, 9) for v in want] == [None if v is None else round(v, 9) for v in got]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    long = spark.range(40_000).select(F.lit("P").alias("symbol"), F.col("id").alias("bar_idx"), (F.col("id") % 2).cast("double").alias("x"))
    last = volatility.ewm(long, "x", 100, "out", "std").where("bar_idx = 39999").first().out
    assert last == pytest.approx(pd.Series(np.arange(4000) % 2.0).ewm(span=100).std().iloc[-1], abs=1e-9)


def test_time_matrix_in_one_pass(spark, small_batches):
    _, bars = _walk(spark, 400)
    bars = bars.withColumn("ts", F.timestamp_seconds(F.col("bar_idx") * 2700 + F.col("bar_idx") * F.col("bar_idx") % 60))
    out = matrices.time_matrix(bars, 1, durations=True, window=20)
    assert "window [" not in plan(out)
    d = out.toPandas().sort_values("bar_idx", ignore_index=True)
    r, t = np.log(d["close"]).diff(), d["ts"].astype("datetime64[us]").astype("int64").diff() / 1e6
    pd.testing.assert_series_equal(d["bar_duration_change"], t.diff(), check_names=False)
    for c in [c[:-4] for c in d.columns if c.endswith("_vol")]:
        want = r[d[c] == 1].rolling(20, min_periods=2).std().reindex(d.index).ffill()
        pd.testing.assert_series_equal(d[f"{c}_vol"].astype(float), want, check_names=False)
