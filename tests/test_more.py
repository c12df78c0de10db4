"""Operators without SQL, against plain Python and numpy; surfaces and sources."""

import math
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.mathx import norm_sf
from tickloom.keys import running_sum
from tickloom.operators import bars, breaks, learning, microstructure, sampling, statistics, strategies, volatility
from tickloom.sources import market


def walk(spark, n=160, symbols="PQ"):
    rows = []
    for k, s in enumerate(symbols):
        y = 100 * np.exp(np.cumsum(np.random.default_rng(k).normal(0, 0.02, n)))
        rows += [(s, i, float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, close double").withColumn("ts", F.timestamp_seconds(F.col("bar_idx") * 3600))


def test_sadf_against_least_squares(spark):
    path = walk(spark, 60, "P")
    y = np.log([r.close for r in path.orderBy("bar_idx").collect()])
    dy = np.diff(y)
    want = {}
    for end in range(20, 59):
        best = -np.inf
        for start in range(0, end - 19):
            rows = np.arange(start, end) + 1
            x = np.stack([y[rows], dy[rows - 1], np.ones(len(rows)), rows + 1.0], axis=1)
            beta, *_ = np.linalg.lstsq(x, dy[rows], rcond=None)
            e = dy[rows] - x @ beta
            best = max(best, beta[0] / math.sqrt(e @ e / (len(rows) - 4) * np.linalg.inv(x.T @ x)[0, 0]))
        want[end + 1] = best
    got = {r.bar_idx: r.sadf for r in breaks.sadf(path, chunks=3).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_tree_splits_where_entropy_falls_most():
    x, y = np.array([[1, 5], [2, 4], [3, 9], [4, 1], [5, 2], [6, 3.0]]), np.array([0, 0, 0, 1, 1, 1])
    tree = learning.Tree(depth=2, least=1).fit(x, y, np.ones(6))
    assert tree.nodes[0][:2] == (0, 3.5) and tree.predict(x).tolist() == y.tolist()
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    y = (x[:, 1] > 0.2).astype(int)
    assert (learning.Tree(depth=2).fit(x, y, np.ones(200)).predict(x) > 0.5).astype(int).tolist() == y.tolist()


def test_bagging_against_loops(spark):
    r = np.random.default_rng(5)
    rows = [("P", i, i + 4, int(v[0] > 0), 1.0, *map(float, v)) for i, v in enumerate(r.normal(size=(60, 3)))]
    data = spark.createDataFrame(rows, "symbol string, i0 long, i1 long, y int, weight double, a double, b double, c double")
    models, drawn = learning.fit_bagging(data, ["a", "b", "c"], 5, 30, depth=2)
    picks = {s: {x.pick: x.times for x in drawn.where(F.col("seed") == s).collect()} for s in range(5)}
    x, y = np.array([v[5:] for v in rows]), np.array([v[3] for v in rows])
    trees = {s: learning.Tree(2, 5, 1, s).fit(x[sorted(p)], y[sorted(p)], np.array([p[k] for k in sorted(p)])) for s, p in picks.items()}
    out = {}
    for k in range(60):
        unseen = [s for s in trees if k not in picks[s]]
        if unseen:
            out[k] = (np.mean([trees[s].predict(x[k : k + 1])[0] for s in unseen]), len(unseen))
    got = {v.i0: (v.p, v.trees) for v in learning.bagging_predict(data, models, ["a", "b", "c"], drawn).collect()}
    assert got.keys() == out.keys() and all(got[k][0] == pytest.approx(out[k][0]) and got[k][1] == out[k][1] for k in out)
    scores = learning.oob_scores(data, models, drawn, ["a", "b", "c"]).first()
    assert scores.coverage == pytest.approx(len(out) / 60) and scores.accuracy == pytest.approx(np.mean([(p >= 0.5) == y[k] for k, (p, _) in out.items()]))
    assert learning.fit_bagging(data, ["a", "b", "c"], 2, 10, sequential=False)[1].agg(F.sum("times")).first()[0] == 20


def test_sequential_bootstrap_picks_unlike_labels(spark):
    spans = spark.createDataFrame([("P", 0, 9)] * 5 + [("P", 20, 21)], "symbol string, i0 long, i1 long")
    picks = [x.pick for x in sampling.sequential_bootstrap(spans, 200, [1]).collect()]
    assert picks.count(5) > 200 / 6  # overlaps with nothing but itself


def test_search_for_an_order(spark):
    got = {r.symbol: r for r in breaks.fracdiff_optimal(walk(spark, 400)).collect()}
    assert all(0 < r.d < 1 and r.p_value < 0.05 and r.corr > 0.3 for r in got.values())
    assert {r.name for r in breaks.not_stationary(walk(spark, 300).withColumn("r", F.col("close") % 7), ["close"]).collect()} == {"close"}


def test_tails(spark):
    got = spark.createDataFrame([(z,) for z in (0.0, 1.0, 2.9, 3.1, 6.0, 20.0)], "z double").select(norm_sf(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(z / math.sqrt(2)) / 2 for z in (0.0, 1.0, 2.9, 3.1, 6.0, 20.0)], rel=1e-9)


def test_running_sums_in_two_levels(spark):
    path = walk(spark, 100)
    got = running_sum(path, F.lit(1), "n", ("ts",)).orderBy("symbol", "ts").collect()
    assert [r.n for r in got] == [*range(1, 101)] * 2


def test_times_are_read_in_utc():
    want = datetime(2024, 1, 2, 5, tzinfo=UTC), datetime(2024, 1, 3, tzinfo=UTC)
    assert market.parsed_times("2024-01-02", 1704240000, "America/New_York") == want
    with pytest.raises(ValueError, match="not before"):
        market.parsed_times("2024-01-02", "2024-01-01")


def test_years_of_bars():
    assert [statistics.timeframe_periods(x) for x in ("W1", "D1", "H4", "M15")] == [52, 252, 409.5, 6552]
    with pytest.raises(ValueError, match="timeframe"):
        statistics.timeframe_periods("X1")


def test_volatility_by_name(spark):
    path = walk(spark, 60).withColumns({"open": F.col("close") * 0.99, "high": F.col("close") * 1.01, "low": F.col("close") * 0.98})
    for method in ("parkinson", "garman_klass", "yang_zhang", "rolling", "realised", "hourly"):
        assert volatility.volatility(path, method, 5).where("vol > 0").count() > 0
    with pytest.raises(ValueError, match="no volatility"):
        volatility.volatility(path, "other", 5)


def test_parse_of_messages():
    for message in ("", "a", "aaaa", "abab" * 9, "abcabcabd"):
        seen, phrase = set(), ""
        for c in message:
            phrase += c
            if phrase not in seen:
                seen.add(phrase)
                phrase = ""
        assert microstructure.lempel_ziv(message) == (len(seen) / len(message) if message else 0)


def test_stages_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    first = market.stage(walk(spark, 5), path).count()
    assert market.stage(walk(spark, 50), path).count() == first == 10


def test_calendar_units():
    with pytest.raises(ValueError, match="calendar"):
        bars.calendar_end("H1")


def test_records_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, score double")
    for kind in ("json", "csv", "parquet"):
        market.write_records(df, f"file://{tmp_path}/{kind}", kind)
    (tmp_path / "json" / "broken.json").write_text("{not json\n")
    assert sorted(r.name for r in market.model_logs(spark, f"file://{tmp_path}/json").collect()) == ["a", "b"]
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2
    (tmp_path / "t.csv").write_text("ts,price,volume\n2024-01-02 03:04:05.678,1.5,2\n")
    assert market.read_csv_ticks(spark, f"file://{tmp_path}/t.csv").first().price == 1.5


def test_strategies_share_a_surface(spark):
    path = walk(spark, 120)
    both = [strategies.crossover(5, 20), strategies.reversion(10, 1.5)]
    got = strategies.sides(path, both)
    assert got.count() == 480 and {s.objective for s in both} == {"trend following", "mean reversion"}
    assert strategies.experiment(path, both[0], 0.02, 1, 1, 10).where("bin in (0, 1)").count() > 0
