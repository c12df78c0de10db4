"""Small cases with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.mathx import norm_cdf
from tickloom.operators import bets, breaks, features, microstructure, sampling, simulation, statistics, validation, volatility

PRICES = [100, 101, 102.5, 101.5, 99, 98, 100.5, 103, 102, 104]


@pytest.fixture(scope="module")
def path(spark):
    rows = [("P", i, float(p)) for i, p in enumerate(PRICES)]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, close double").withColumn("ts", F.timestamp_seconds(F.col("bar_idx") * 86400))


def test_cusum(path):
    got = [(r.bar_idx, r.direction) for r in sampling.cusum_filter(path, 0.02).orderBy("bar_idx").collect()]
    assert got == [(2, 1), (4, -1), (6, 1), (7, 1)]
    with pytest.raises(Exception, match="positive"):
        sampling.cusum_filter(path.withColumn("close", F.lit(-1.0)), 0.02).collect()


def test_triple_barrier(spark, path):
    ev = spark.createDataFrame([("P", i, min(i + 3, 9), 0.02) for i in (2, 4, 6, 7)], "symbol string, i0 long, i1 long, trgt double").withColumn("t0", F.timestamp_seconds(F.col("i0") * 86400))
    got = sampling.barrier_labels(sampling.triple_barrier_events(ev, path, 1, 1), path).orderBy("i0").collect()
    assert [(r.i0, r.hit_idx, r.barrier, round(r.ret, 6)) for r in got] == [(2, 4, "sl", -0.034146), (4, 7, "pt", 0.040404), (6, 7, "pt", 0.024876), (7, 9, "vertical", 0.009709)]


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame([("P", 1, 3), ("P", 2, 5), ("P", 4, 6)], "symbol string, i0 long, i1 long")


def test_concurrency_and_weights(path, spans):
    assert [r.n_concurrent for r in sampling.concurrency(spans, path).orderBy("bar_idx").collect()] == [0, 1, 2, 2, 2, 2, 1, 0, 0, 0]
    got = sampling.label_weights(spans, path).orderBy("i0").collect()
    assert [round(r.tw, 6) for r in got] == [0.666667, 0.5, 0.666667]
    assert [round(r.w, 6) for r in got] == [1.060268, 1.287103, 0.652629]


def test_ffd_weights():
    assert features.ffd_weights(0.5, 1e-9, 6) == [1, -0.5, -0.125, -0.0625, -0.0390625, -0.02734375]


def test_bet_size(spark):
    got = spark.createDataFrame([(0.55,), (0.7,), (0.9,)], "p double").select(bets.signal(F.col("p"), 2).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([0.080056, 0.337479, 0.817578], abs=1e-5)


def test_entropies(spark):
    m = spark.createDataFrame([("m", "aababbca")], "symbol string, message string")
    assert microstructure.shannon_entropy(m).first().shannon == pytest.approx(1.405639, abs=1e-6)
    assert microstructure.lempel_ziv("aababbca") == 0.5
    assert microstructure.lempel_ziv("") == 0 and microstructure.kontoyiannis("abababab") > 0


def test_drawdowns(spark):
    eq = spark.createDataFrame([("E", i, float(x)) for i, x in enumerate([100, 110, 105, 99, 112, 108, 120])], "symbol string, i long, equity double").withColumn("ts", F.timestamp_seconds(F.col("i") * 86400))
    assert [round(r.drawdown, 6) for r in statistics.drawdowns(eq).orderBy("ts").collect()] == [0.1, 0.035714]


def test_concentration_and_sharpe(spark):
    r = spark.createDataFrame([(0.01,), (0.02,), (0.03,)], "ret double")
    assert r.select(statistics.concentration(F.col("ret")).alias("h")).first().h == pytest.approx(0.083333, abs=1e-6)
    one = spark.range(1).select(statistics.probabilistic_sharpe(F.lit(0.1), F.lit(0.0), F.lit(100), F.lit(0.0), F.lit(3.0)).alias("p"))
    assert one.first().p == pytest.approx(0.839525, abs=1e-5)


def test_scores_and_folds(spark):
    s = spark.createDataFrame(list(zip([1, 0, 1, 1, 0, 1], [0.9, 0.2, 0.6, 0.4, 0.55, 0.8], [1.0] * 6, strict=True)), "y int, p double, weight double")
    got = validation.weighted_scores(s).first()
    assert (round(got.pwa, 6), round(got.brier, 6)) == (0.88, 0.152083)
    lab = spark.createDataFrame([("P", i, i + 1) for i in range(11)], "symbol string, t0 long, t1 long")
    assert sorted(r["count"] for r in validation.fold_ids(lab, 3).groupBy("fold").count().collect()) == [3, 4, 4]


def test_normal_distribution(spark):
    z = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(norm_cdf(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z], abs=2e-7)


def test_ewm_and_uniqueness(spark, path, spans):
    import pandas as pd

    got = [r.m for r in volatility.ewm(path, "close", 3, "m").orderBy("bar_idx").collect()]
    assert got == pytest.approx(pd.Series(PRICES).ewm(span=3).mean().tolist())
    u = simulation.bootstrap_uniqueness(spans, 3, list(range(12))).collect()
    assert len(u) == 12 and np.mean([r.sequential for r in u]) >= np.mean([r.plain for r in u]) - 0.05


def test_sadf_against_plain_regressions(spark):
    y = np.cumsum(np.random.default_rng(1).standard_normal(40)) + 100
    df = spark.createDataFrame([("S", i, float(v)) for i, v in enumerate(y)], "symbol string, bar_idx long, close double").withColumn("ts", F.timestamp_seconds("bar_idx"))
    got = {r.bar_idx: r.sadf for r in breaks.sadf(df, "linear", 1, 20, log=False).collect()}
    x, t = breaks._regressors(y, "linear", 1, True)
    for end in (20, 30, len(t)):
        best = -np.inf
        for s in range(0, end - 19):
            beta, sse, *_ = np.linalg.lstsq(x[s:end], t[s:end], rcond=None)
            e = t[s:end] - x[s:end] @ beta
            best = max(best, beta[0] / np.sqrt(np.linalg.inv(x[s:end].T @ x[s:end])[0, 0] * (e @ e) / (end - s - 4)))
        assert got[end + 1] == pytest.approx(best, rel=1e-4)


def test_bootstraps_cover_every_symbol_and_label(spark, sf_dir):
    from tickloom.plans import queries
    from tickloom.sources import market

    bars = {r.symbol: r.n for r in market.daily_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    spans = queries._spans(spark, sf_dir).collect()
    assert {s: sum(r.symbol == s for r in spans) for s in bars} == bars and len(bars) == 3
    assert all(r.i1 == min(r.i0 + 20, bars[r.symbol] - 1) for r in spans)
    drawn = queries.QUERIES["sequential_bootstrap"](spark, sf_dir).collect()
    assert {(r.symbol, r.seed) for r in drawn} == {(s, k) for s in bars for k in (1, 2, 3)} and len(drawn) == 9 * 50
    assert all(0 <= r.pick < bars[r.symbol] for r in drawn)
    assert len(queries.QUERIES["bootstrap_uniqueness"](spark, sf_dir).collect()) == 12
    # symbols do not mix: one alone gives the same draws
    alone = queries.L.sequential_bootstrap(queries._spans(spark, sf_dir).where("symbol = 'R'"), 50, [1]).collect()
    assert sorted((r.nth, r.pick) for r in alone) == sorted((r.nth, r.pick) for r in drawn if r.symbol == "R" and r.seed == 1)
