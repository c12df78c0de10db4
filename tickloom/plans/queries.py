"""Queries of the operators over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.mathx import norm_cdf_sql, norm_ppf, norm_sf_sql
from tickloom.keys import series
from tickloom.operators import bars as B
from tickloom.operators import bets as S
from tickloom.operators import breaks as K
from tickloom.operators import features as X
from tickloom.operators import microstructure as M
from tickloom.operators import sampling as L
from tickloom.operators import simulation as G
from tickloom.operators import statistics as T
from tickloom.operators import validation as V
from tickloom.operators import volatility as R
from tickloom.sources import market as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: T.rounded(f(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sql(views: str, body: str, plain: str, doubles: str = "", recursive: bool = False) -> str:
    """``body`` over views, its doubles rounded as the queries' are."""
    columns = plain.split() + [f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split()]
    return f"WITH {'RECURSIVE ' * recursive}{views}, answer AS ({body}) SELECT {', '.join(columns)} FROM answer"


OHLC = "arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close, count(*) AS tick_volume, sum(volume) AS volume"
TICKS, QUOTES, CLOSES, BARS = D.views("ticks"), D.views("ticks", "quotes"), D.views("ticks", "closes"), D.views("bars")


def roll(expr: str, n: int, agg: str = "avg") -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({expr}) {w} = {n} THEN {agg}({expr}) {w} END"


W = "OVER (PARTITION BY symbol ORDER BY bar_idx)"


# sources and bars


@query(sql(QUOTES, "SELECT symbol, ts, seq, bid, ask FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS n FROM quotes WHERE bid > 0 AND ask > 0 AND ask - bid >= 0.015) WHERE n = 1", "symbol ts seq", "bid ask"))
def clean_ticks(spark, d):
    return D.clean_ticks(D.events_quotes(spark, d), 0.015).select("symbol", "ts", "seq", "bid", "ask")


@query(sql(TICKS, f"SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts, {OHLC} FROM ticks GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts)", "symbol ts tick_volume", "open high low close volume"))
def time_bars_1h(spark, d):
    return B.time_bars(D.events_ticks(spark, d), "H1")


@query(sql(TICKS, f"SELECT symbol, bar_id, max(ts) + INTERVAL 1 MICROSECOND AS ts, {OHLC} FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 50 AS bar_id FROM ticks) GROUP BY symbol, bar_id HAVING count(*) = 50", "symbol bar_id ts tick_volume", "open high low close volume"))
def tick_bars_50(spark, d):
    return B.tick_bars(D.events_ticks(spark, d), 50)


def _activity(value: str, size: int) -> str:
    return sql(TICKS, f"SELECT symbol, bar_id, max(ts) + INTERVAL 1 MICROSECOND AS ts, {OHLC} FROM (SELECT *, max(bar_id) OVER (PARTITION BY symbol) AS last FROM (SELECT *, CAST(floor(sum({value}) OVER (PARTITION BY symbol ORDER BY ts, seq) / {size}) AS BIGINT) AS bar_id FROM ticks)) WHERE bar_id < last GROUP BY symbol, bar_id", "symbol bar_id ts tick_volume", "open high low close volume")


@query(_activity("volume", 3000))
def volume_bars(spark, d):
    return B.volume_bars(D.events_ticks(spark, d), 3000)


@query(_activity("volume * price", 100_000))
def dollar_bars(spark, d):
    return B.dollar_bars(D.events_ticks(spark, d), 100_000)


@query(sql(QUOTES, "SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts, (arg_min(bid, row(ts, seq)) + arg_min(ask, row(ts, seq))) / 2 AS open, (max(bid) + max(ask)) / 2 AS high, (min(bid) + min(ask)) / 2 AS low, (arg_max(bid, row(ts, seq)) + arg_max(ask, row(ts, seq))) / 2 AS close, count(*) AS tick_volume FROM quotes GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts)", "symbol ts tick_volume", "open high low close"))
def bid_ask_bars(spark, d):
    return B.bid_ask_bars(D.events_quotes(spark, d), "H1").select("symbol", "ts", "tick_volume", "open", "high", "low", "close")


@query(sql(TICKS, "SELECT symbol, CAST(greatest(round_even(x / 10 ** floor(log10(greatest(x, 1))), 0) * 10 ** floor(log10(greatest(x, 1))), 10) AS BIGINT) AS ticks FROM (SELECT symbol, round_even(count(*) / (1 + date_diff('day', min(date_trunc('day', ts)), max(date_trunc('day', ts)))), 0) AS x FROM ticks GROUP BY symbol)", "symbol ticks"))
def ticks_per_period(spark, d):
    return B.ticks_per_period(D.events_ticks(spark, d), "D1")


# event sampling and labels

CUSUM = f"""{CLOSES}, ret AS (SELECT *, ln(close) - lag(ln(close)) {W} AS r FROM closes),
fold AS (SELECT symbol, bar_idx, ts, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS direction FROM ret WHERE bar_idx = 0
  UNION ALL SELECT symbol, bar_idx, ts, CASE WHEN d >= -2 AND u > 2 THEN 0 ELSE u END, CASE WHEN d < -2 THEN 0 ELSE d END, CASE WHEN d < -2 THEN -1 WHEN u > 2 THEN 1 ELSE 0 END
  FROM (SELECT r.symbol, r.bar_idx, r.ts, greatest(0, f.up + r.r) AS u, least(0, f.down + r.r) AS d FROM fold f JOIN ret r ON r.symbol = f.symbol AND r.bar_idx = f.bar_idx + 1))"""


@query(sql(CUSUM, "SELECT symbol, ts, bar_idx, direction FROM fold WHERE direction <> 0", "symbol ts bar_idx direction", recursive=True))
def cusum_filter(spark, d):
    return L.cusum_filter(D.events_close(spark, d), 2.0)


@query(sql(CLOSES, f"SELECT * FROM (SELECT symbol, ts, bar_idx, close, {roll('close', 50)} + 1.5 * ({roll('close', 50, 'stddev_samp')}) AS lim FROM closes) WHERE close >= lim", "symbol ts bar_idx", "close"))
def z_score_filter(spark, d):
    return L.z_score_filter(D.events_close(spark, d), 50, 50, 1.5)


def _events(bars: DataFrame, span: int = 20) -> DataFrame:
    """An event at every bar that lasts ``span`` bars, or to the end."""
    last = F.max("bar_idx").over(Window.partitionBy("symbol"))
    e = bars.withColumn("last", last)
    return e.select("symbol", F.col("bar_idx").alias("i0"), F.col("ts").alias("t0"), F.when(F.col("bar_idx") + span <= F.col("last"), F.col("bar_idx") + span).alias("i1"))


def ev(views: str, table: str, span: int = 20) -> str:
    return f"""{views}, px AS (SELECT *, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM {table}),
ev AS (SELECT symbol, bar_idx AS i0, ts AS t0, close AS p0, last, CASE WHEN bar_idx + {span} <= last THEN bar_idx + {span} END AS i1 FROM px)"""


TOUCH = """, touch AS (SELECT e.symbol, e.i0, e.t0, e.p0, e.i1, min(CASE WHEN p.close / e.p0 - 1 <= -0.5 THEN p.bar_idx END) AS sl, min(CASE WHEN p.close / e.p0 - 1 >= 1.0 THEN p.bar_idx END) AS pt
  FROM {ev} e LEFT JOIN px p ON p.symbol = e.symbol AND p.bar_idx > e.i0 AND p.bar_idx <= coalesce(e.i1, e.last) GROUP BY ALL),
hit AS (SELECT *, least(i1, sl, pt) AS hit_idx, CASE WHEN least(i1, sl, pt) = sl THEN 'sl' WHEN least(i1, sl, pt) = pt THEN 'pt' ELSE 'vertical' END AS barrier FROM touch),
lab AS (SELECT h.symbol, h.i0, h.t0, h.hit_idx, p.ts AS t1, h.barrier, p.close / h.p0 - 1 AS ret, CASE WHEN p.close / h.p0 - 1 > 0 THEN 1 ELSE -1 END AS bin FROM hit h JOIN px p ON p.symbol = h.symbol AND p.bar_idx = h.hit_idx)"""


@query(sql(ev(CLOSES, "closes"), "SELECT e.symbol, e.i0, e.t0, e.i1, p.ts AS t1 FROM ev e LEFT JOIN px p ON p.symbol = e.symbol AND p.bar_idx = e.i1", "symbol i0 t0 i1 t1"))
def vertical_barriers(spark, d):
    bars = D.events_close(spark, d)
    return L.vertical_barriers(_events(bars).drop("i1"), bars, n_bars=20).select("symbol", "i0", "t0", "i1", "t1")


@query(sql(ev(CLOSES, "closes"), "SELECT e.symbol, e.i0, e.t0, p.ts AS t1 FROM ev e ASOF LEFT JOIN px p ON p.symbol = e.symbol AND p.ts >= e.t0 + INTERVAL 6 HOUR", "symbol i0 t0 t1"))
def vertical_barriers_time(spark, d):
    bars = D.events_close(spark, d)
    return L.vertical_barriers(_events(bars).drop("i1"), bars, interval="6 hours").select("symbol", "i0", "t0", "t1")


def _touched(spark, d):
    bars = D.events_close(spark, d)
    return L.triple_barrier_events(_events(bars).withColumn("trgt", F.lit(0.5)), bars, 2.0, 1.0), bars


@query(sql(ev(CLOSES, "closes") + TOUCH.format(ev="ev"), "SELECT * FROM lab", "symbol i0 t0 hit_idx t1 barrier"))
def triple_barrier_events(spark, d):
    return _touched(spark, d)[0].select("symbol", "i0", "t0", "hit_idx", "t1", "barrier")


@query(sql(CUSUM + ", px AS (SELECT *, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM closes), ev AS (SELECT f.symbol, f.bar_idx AS i0, f.ts AS t0, p.close AS p0, p.last, CASE WHEN f.bar_idx + 20 <= p.last THEN f.bar_idx + 20 END AS i1 FROM fold f JOIN px p ON p.symbol = f.symbol AND p.bar_idx = f.bar_idx WHERE f.direction <> 0)" + TOUCH.format(ev="ev"), "SELECT * FROM lab", "symbol i0 t0 hit_idx t1 barrier bin", "ret", recursive=True))
def triple_barrier_labels(spark, d):
    """Closes, CUSUM events, vertical barriers, first touches, labels."""
    bars = D.events_close(spark, d)
    events = L.cusum_filter(bars, 2.0).select("symbol", F.col("bar_idx").alias("i0"), F.col("ts").alias("t0"))
    touched = L.triple_barrier_events(L.vertical_barriers(events, bars, n_bars=20).withColumn("trgt", F.lit(0.5)), bars, 2.0, 1.0)
    return L.barrier_labels(touched, bars).select("symbol", "i0", "t0", "hit_idx", "t1", "barrier", "bin", "ret")


@query(sql(ev(CLOSES, "closes") + TOUCH.format(ev="ev"), "SELECT bin, count(*) AS n, avg(ret) AS mean_ret FROM lab GROUP BY bin", "bin n", "mean_ret"))
def label_distribution(spark, d):
    touched, bars = _touched(spark, d)
    return L.common_classes(L.barrier_labels(touched, bars).groupBy("bin").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret")))


@query(sql(BARS, f"SELECT symbol, ts, ret, CASE WHEN ret < -0.5 THEN -1 WHEN ret > 0.5 THEN 1 WHEN ret IS NOT NULL THEN 0 END AS label FROM (SELECT symbol, ts, (r - ({roll('r', 20)})) / nullif({roll('r', 20, 'stddev_samp')}, 0) AS ret FROM (SELECT *, lead(close) {W} / close - 1 AS r FROM bars))", "symbol ts label", "ret"))
def fixed_horizon_labels(spark, d):
    return L.fixed_horizon_labels(D.daily_bars(spark, d), 0.5, 20).select("symbol", "ts", "label", "ret")


@query(sql(BARS, """SELECT symbol, ts, bar_idx, window_ AS "window", slope, t_value, r_squared, t1, ret, CASE WHEN abs(t_value) <= 1e-6 THEN 0 ELSE CAST(sign(t_value) AS INT) END AS bin FROM (
  SELECT symbol, ts, bar_idx, l AS window_, slope, t_value, r_squared, t1, ret, row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY abs(t_value) DESC, l) AS n FROM (
    SELECT a.symbol, a.ts, a.bar_idx, h.l, any_value(a.close) AS c0, regr_slope(ln(b.close), b.bar_idx) AS slope, regr_r2(ln(b.close), b.bar_idx) AS r_squared, arg_max(b.ts, b.bar_idx) AS t1, arg_max(b.close, b.bar_idx) / any_value(a.close) - 1 AS ret,
      regr_slope(ln(b.close), b.bar_idx) / (sqrt(greatest(regr_syy(ln(b.close), b.bar_idx) - regr_sxy(ln(b.close), b.bar_idx) ** 2 / regr_sxx(ln(b.close), b.bar_idx), 0) / (h.l - 2) / regr_sxx(ln(b.close), b.bar_idx)) + 1e-9) AS t_value
    FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) a CROSS JOIN (SELECT unnest([5, 6, 7, 8, 9]) AS l) h JOIN bars b ON b.symbol = a.symbol AND b.bar_idx BETWEEN a.bar_idx AND a.bar_idx + h.l - 1
    WHERE a.bar_idx < a.n - 9 GROUP BY a.symbol, a.ts, a.bar_idx, h.l)) WHERE n = 1""", 'symbol ts bar_idx "window" t1 bin', "slope t_value r_squared ret"))
def trend_scanning(spark, d):
    return L.trend_scanning_labels(D.daily_bars(spark, d), (5, 10))


CONC = ", conc AS (SELECT p.symbol, p.ts, p.bar_idx, p.close, (SELECT count(*) FROM ev e WHERE e.symbol = p.symbol AND p.bar_idx BETWEEN e.i0 AND coalesce(e.i1, e.last)) AS n_concurrent FROM px p)"


@query(sql(ev(BARS, "bars") + CONC, "SELECT * FROM conc", "symbol ts bar_idx n_concurrent"))
def num_concurrent_events(spark, d):
    bars = D.daily_bars(spark, d)
    return L.concurrency(_events(bars), bars).select("symbol", "ts", "bar_idx", "n_concurrent")


WEIGHTS = ev(BARS, "bars") + CONC + f""", rr AS (SELECT *, ln(close) - lag(ln(close)) {W} AS r FROM conc),
wt AS (SELECT e.symbol, e.i0, avg(1 / r.n_concurrent) AS tw, abs(sum(r.r / r.n_concurrent)) AS w0 FROM ev e JOIN rr r ON r.symbol = e.symbol AND r.bar_idx BETWEEN e.i0 AND coalesce(e.i1, e.last) GROUP BY e.symbol, e.i0),
ww AS (SELECT symbol, i0, tw, w0 * count(*) OVER (PARTITION BY symbol) / sum(w0) OVER (PARTITION BY symbol) AS w FROM wt)"""


def _weights(spark, d):
    bars = D.daily_bars(spark, d)
    return L.label_weights(_events(bars), bars)


@query(sql(WEIGHTS, "SELECT * FROM ww", "symbol i0", "tw w"))
def label_weights(spark, d):
    return _weights(spark, d).select("symbol", "i0", "tw", "w")


@query(sql(WEIGHTS, "SELECT symbol, i0, 1 - 0.5 / t * t + 0.5 / t * x AS linear, 0.5 ** ((t - x) / t) AS exponential FROM (SELECT *, sum(tw) OVER (PARTITION BY symbol) AS t, sum(tw) OVER (PARTITION BY symbol ORDER BY i0) AS x FROM ww)", "symbol i0", "linear exponential"))
def time_decay(spark, d):
    w = L.time_decay(_weights(spark, d), 0.5).withColumnRenamed("decay", "linear")
    return L.time_decay(w, 0.5, linear=False).select("symbol", "i0", "linear", F.col("decay").alias("exponential"))


@query(sql(ev(BARS, "bars"), "SELECT symbol, i0, unnest(range(i0, i1 + 1)) AS bar_idx FROM ev WHERE i1 IS NOT NULL", "symbol i0 bar_idx"))
def indicator_matrix(spark, d):
    return L.indicator(_events(D.daily_bars(spark, d)).where("i1 is not null"))


def _spans(spark, d):
    """A label at every bar; those that the end of the series cuts end with its last bar."""
    bars = D.daily_bars(spark, d)
    last = F.max("i0").over(Window.partitionBy("symbol"))
    return _events(bars).withColumn("i1", F.coalesce("i1", last))


@query()
def sequential_bootstrap(spark, d):
    return L.sequential_bootstrap(_spans(spark, d), 50, [1, 2, 3])


@query()
def bootstrap_uniqueness(spark, d):
    return G.bootstrap_uniqueness(_spans(spark, d), 50, [1, 2, 3, 4])


# returns and volatility


@query(sql(CLOSES, "SELECT c.symbol, c.bar_idx, c.ts, c.close / p.close - 1 AS ret FROM closes c ASOF LEFT JOIN closes p ON p.symbol = c.symbol AND p.ts < c.ts - INTERVAL 1 DAY", "symbol bar_idx ts", "ret"))
def period_returns(spark, d):
    return R.period_returns(D.events_close(spark, d)).select("symbol", "bar_idx", "ts", "ret")


@query(sql(CLOSES, f"""SELECT symbol, bar_idx, ts, sqrt(greatest(w2 / w0 - (w1 / w0) ** 2, 0) * w0 * w0 / nullif(w0 * w0 - q, 0)) AS vol FROM (
  SELECT symbol, bar_idx, ts, sum(u) {W} AS w0, sum(u * ret) {W} AS w1, sum(u * ret * ret) {W} AS w2, sum(u * u) {W} AS q FROM (
    SELECT *, (99 / 101.0) ** -row_number() {W} AS u FROM (SELECT c.symbol, c.bar_idx, c.ts, c.close / p.close - 1 AS ret FROM closes c ASOF JOIN closes p ON p.symbol = c.symbol AND p.ts < c.ts - INTERVAL 1 DAY)))""", "symbol bar_idx ts", "vol"))
def daily_volatility(spark, d):
    return R.period_volatility(D.events_close(spark, d)).select("symbol", "bar_idx", "ts", "vol")


def _bars_query(expr: str, name: str) -> str:
    return sql(BARS, f"SELECT symbol, ts, {expr} AS {name} FROM x", "symbol ts", name)


@query(sql(BARS, f"SELECT symbol, ts, sqrt({roll('x', 20)}) AS vol FROM (SELECT *, ln(high / low) ** 2 / (4 * ln(2)) AS x FROM bars)", "symbol ts", "vol"))
def parkinson_volatility(spark, d):
    return R.parkinson(D.daily_bars(spark, d), 20).select("symbol", "ts", "vol")


@query(sql(BARS, f"SELECT symbol, ts, sqrt({roll('x', 20)}) AS vol FROM (SELECT *, ln(high / low) ** 2 / 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS x FROM bars)", "symbol ts", "vol"))
def garman_klass_volatility(spark, d):
    return R.garman_klass(D.daily_bars(spark, d), 20).select("symbol", "ts", "vol")


YZ = 0.34 / (1.34 + 21 / 19)


@query(sql(BARS, f"SELECT symbol, ts, sqrt(({roll('so', 20, 'sum')} + {YZ} * {roll('sc', 20, 'sum')} + (1 - {YZ}) * {roll('srs', 20, 'sum')}) / 19) AS vol FROM (SELECT *, ln(open / lag(close) {W}) ** 2 AS so, ln(close / lag(open) {W}) ** 2 AS sc, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS srs FROM bars)".replace(f"({roll('so', 20, 'sum')} + {YZ} * {roll('sc', 20, 'sum')} + (1 - {YZ}) * {roll('srs', 20, 'sum')})", f"(({roll('so', 20, 'sum')}) + {YZ} * ({roll('sc', 20, 'sum')}) + (1 - {YZ}) * ({roll('srs', 20, 'sum')}))"), "symbol ts", "vol"))
def yang_zhang_volatility(spark, d):
    return R.yang_zhang(D.daily_bars(spark, d), 20).select("symbol", "ts", "vol")


@query(sql(CLOSES, "SELECT f.symbol, sqrt(greatest(s.v - s.n / f.n * f.v, 0)) AS vol FROM (SELECT symbol, sum(x) AS v, count(x) AS n FROM (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx)) ** 2 AS x FROM closes) GROUP BY symbol) f JOIN (SELECT symbol, sum(x) AS v, count(x) AS n FROM (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx)) ** 2 AS x FROM closes WHERE bar_idx % 5 = 0) GROUP BY symbol) s USING (symbol)", "symbol", "vol"))
def two_scale_volatility(spark, d):
    return R.two_scale_volatility(D.events_close(spark, d), 5)


@query(sql(BARS, f"SELECT symbol, ts, CASE WHEN count(b) OVER w = 19 THEN corr(ret, b) OVER w END AS autocorr FROM (SELECT *, lag(ret) {W} AS b FROM (SELECT *, close / lag(close) {W} - 1 AS ret FROM bars)) WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)", "symbol ts", "autocorr"))
def rolling_autocorrelation(spark, d):
    return R.rolling_autocorrelation(D.daily_bars(spark, d), 20).select("symbol", "ts", "autocorr")


@query(sql(BARS, f"SELECT symbol, ts, returns_1, returns_5, lag(returns_1, 1) {W} AS returns_1_lag_1, lag(returns_5, 5) {W} AS returns_5_lag_1 FROM (SELECT symbol, ts, bar_idx, least(greatest(r1, quantile_cont(r1, 0.0001) OVER p), quantile_cont(r1, 0.9999) OVER p) + 0 * r1 AS returns_1, (1 + least(greatest(r5, quantile_cont(r5, 0.0001) OVER p), quantile_cont(r5, 0.9999) OVER p) + 0 * r5) ** 0.2 - 1 AS returns_5 FROM (SELECT *, close / lag(close, 1) {W} - 1 AS r1, close / lag(close, 5) {W} - 1 AS r5 FROM bars) WINDOW p AS (PARTITION BY symbol))", "symbol ts", "returns_1 returns_5 returns_1_lag_1 returns_5_lag_1"))
def lagged_returns(spark, d):
    return R.lagged_returns(D.daily_bars(spark, d), [1, 5], 1).select("symbol", "ts", "returns_1", "returns_5", "returns_1_lag_1", "returns_5_lag_1")


@query(sql(BARS, f"SELECT symbol, ts, CASE WHEN count(r) OVER w >= 3 THEN skewness(r) OVER w END AS skew, CASE WHEN count(r) OVER w >= 4 THEN kurtosis(r) OVER w END AS kurt, CASE WHEN count(r) OVER w >= 3 THEN (r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0) END AS z FROM (SELECT *, ln(close / lag(close) {W}) AS r FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", "symbol ts", "z skew kurt"))
def return_moments(spark, d):
    return R.return_moments(D.daily_bars(spark, d), 30).select("symbol", "ts", "z", "skew", "kurt")


GARCH = f"""{BARS}, ch AS (SELECT *, close / lag(close) {W} - 1 AS r FROM bars), fold AS (SELECT symbol, ts, bar_idx, coalesce((SELECT var_pop(r) FROM ch x WHERE x.symbol = ch.symbol), 0) AS variance FROM ch WHERE bar_idx = 0
  UNION ALL SELECT n.symbol, n.ts, n.bar_idx, 0.01 + 0.1 * coalesce(b.r, 0) ** 2 + 0.85 * f.variance FROM fold f JOIN ch b ON b.symbol = f.symbol AND b.bar_idx = f.bar_idx JOIN ch n ON n.symbol = f.symbol AND n.bar_idx = f.bar_idx + 1)"""


@query(sql(GARCH, "SELECT * FROM fold", "symbol ts bar_idx", "variance", recursive=True))
def garch_variance(spark, d):
    return R.garch_variance(D.daily_bars(spark, d), 0.01, 0.1, 0.85)


# features


@query(sql(BARS, f"SELECT symbol, ts, a - b AS diff_5_10, a - c AS diff_5_20, b - c AS diff_10_20 FROM (SELECT symbol, ts, {roll('close', 5)} AS a, {roll('close', 10)} AS b, {roll('close', 20)} AS c FROM bars)", "symbol ts", "diff_5_10 diff_5_20 diff_10_20"))
def ma_differences(spark, d):
    return X.moving_average_differences(D.daily_bars(spark, d), [5, 10, 20]).select("symbol", "ts", "diff_5_10", "diff_5_20", "diff_10_20")


SIDE = f"(SELECT *, coalesce(CAST(sign(({roll('close', 5)}) - ({roll('close', 20)})) AS INT), 0) AS side FROM bars)"


@query(sql(BARS, f"SELECT symbol, ts, side, CASE WHEN side <> 0 AND lag(side) {W} <> 0 AND side <> lag(side) {W} THEN side ELSE 0 END AS x FROM {SIDE}", "symbol ts side x"))
def ma_crossovers(spark, d):
    return X.crossovers(D.daily_bars(spark, d), 5, 20).select("symbol", "ts", "side", F.col("cross").alias("x"))


@query(sql(BARS, f"SELECT symbol, ts, mid, mid + 2 * dev AS upper, mid - 2 * dev AS lower, (close - (mid - 2 * dev)) / nullif(4 * dev, 0) AS pct_b, CASE WHEN close >= mid + 2 * dev THEN -1 WHEN close <= mid - 2 * dev THEN 1 ELSE 0 END AS side FROM (SELECT *, {roll('close', 20)} AS mid, {roll('close', 20, 'stddev_pop')} AS dev FROM bars)", "symbol ts side", "mid upper lower pct_b"))
def bollinger_signals(spark, d):
    return X.bollinger(D.daily_bars(spark, d)).select("symbol", "ts", "side", "mid", "upper", "lower", "pct_b")


@query(sql(BARS, f"SELECT symbol, ts, up, down, r AS resistance, s AS support, CASE WHEN close > r THEN 1 WHEN close < s THEN -1 ELSE 0 END AS breakout FROM (SELECT *, last_value(u IGNORE NULLS) {W} AS r, last_value(v IGNORE NULLS) {W} AS s FROM (SELECT *, CASE WHEN lag(up, 2) {W} = 1 THEN lag(high, 2) {W} END AS u, CASE WHEN lag(down, 2) {W} = 1 THEN lag(low, 2) {W} END AS v FROM (SELECT *, CASE WHEN count(*) OVER c = 5 AND high = max(high) OVER c THEN 1 ELSE 0 END AS up, CASE WHEN count(*) OVER c = 5 AND low = min(low) OVER c THEN 1 ELSE 0 END AS down FROM bars WINDOW c AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))))", "symbol ts up down breakout", "resistance support"))
def fractals(spark, d):
    return X.fractals(D.daily_bars(spark, d)).select("symbol", "ts", "up", "down", "breakout", "resistance", "support")


@query(sql(TICKS, "SELECT symbol, ts, seq, CAST(h >= 21 OR h < 6 AS INT) AS session_sydney, CAST(h < 9 AS INT) AS session_tokyo, CAST(h >= 7 AND h < 16 AS INT) AS session_london, CAST(h >= 13 AND h < 22 AS INT) AS session_new_york, CAST(isodow(ts) = 5 AND h >= 20 AS INT) AS friday_close, CAST(day(ts) >= 28 AS INT) AS month_end FROM (SELECT *, hour(ts) AS h FROM ticks)", "symbol ts seq session_sydney session_tokyo session_london session_new_york friday_close month_end"))
def session_features(spark, d):
    return X.sessions(D.events_ticks(spark, d)).select("symbol", "ts", "seq", "session_sydney", "session_tokyo", "session_london", "session_new_york", "friday_close", "month_end")


@query(sql(TICKS, "SELECT symbol, ts, seq, sin(2 * pi() * hour(ts) / 24) AS sin_hour_h1, cos(2 * pi() * (isodow(ts) - 1) / 7) AS cos_dow_h1, sin(4 * pi() * dayofyear(ts) / 366) AS sin_doy_h2 FROM ticks", "symbol ts seq", "sin_hour_h1 cos_dow_h1 sin_doy_h2"))
def cyclical_features(spark, d):
    return X.cyclical(D.events_ticks(spark, d)).select("symbol", "ts", "seq", "sin_hour_h1", "cos_dow_h1", "sin_doy_h2")


FFD = X.ffd_weights(0.5, 0.02)


@query(sql(BARS, "SELECT symbol, ts, CASE WHEN bar_idx >= " + str(len(FFD) - 1) + " THEN " + " + ".join(f"({w!r}) * lag(ln(close), {k}) {W}" for k, w in enumerate(FFD)) + " END AS ffd FROM bars", "symbol ts", "ffd"))
def frac_diff_ffd(spark, d):
    return X.frac_diff_ffd(D.daily_bars(spark, d), 0.5, 0.02).select("symbol", "ts", "ffd")


FRAC = f"""{BARS}, wt AS (SELECT 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM wt WHERE k < 6000), sizes AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol),
cut AS (SELECT symbol, n, k, sum(abs(w)) OVER (PARTITION BY symbol ORDER BY k DESC) / sum(abs(w)) OVER (PARTITION BY symbol) AS lost FROM sizes JOIN wt ON k < n)"""


@query(sql(FRAC, "SELECT b.symbol, b.ts, b.bar_idx, CASE WHEN c.lost > 0.01 THEN list_dot_product(ws[1:b.bar_idx + 1], ys[l.n - b.bar_idx:l.n]) END AS frac FROM bars b JOIN (SELECT symbol, count(*) AS n, list(ln(close) ORDER BY bar_idx DESC) AS ys FROM bars GROUP BY symbol) l USING (symbol) CROSS JOIN (SELECT list(w ORDER BY k) AS ws FROM wt) JOIN cut c ON c.symbol = b.symbol AND c.k = c.n - 1 - b.bar_idx", "symbol ts bar_idx", "frac", recursive=True))
def frac_diff(spark, d):
    return X.frac_diff(D.daily_bars(spark, d), 0.4)


def _smooth(before: str, x: str, alpha: str) -> str:
    """An exponential average that starts with its first value."""
    return f"CASE WHEN {before} IS NULL THEN {x} WHEN {x} IS NULL THEN {before} ELSE {before} + {alpha} * ({x} - {before}) END"


def _smoothed(f: str) -> str:
    """Wilder's and exponential averages of one bar ``n`` after the state ``f``."""
    return f"""SELECT n.symbol, n.ts, n.bar_idx, {_smooth(f + 'gain', 'greatest(n.move, 0)', '1 / 14.0')} AS gain, {_smooth(f + 'loss', 'greatest(-n.move, 0)', '1 / 14.0')} AS loss, {_smooth(f + 'tr', 'n.tr', '1 / 14.0')} AS tr,
    {_smooth(f + 'plus', 'n.plus', '1 / 14.0')} AS plus, {_smooth(f + 'minus', 'n.minus', '1 / 14.0')} AS minus, {_smooth(f + 'fast', 'n.close', '2 / 13.0')} AS fast, {_smooth(f + 'slow', 'n.close', '2 / 27.0')} AS slow"""


RAW = f"""raw AS (SELECT symbol, ts, bar_idx, close, move, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus
  FROM (SELECT *, close - lag(close) {W} AS move, high - lag(high) {W} AS up, lag(low) {W} - low AS down, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM bars))"""
STATE = f"""{BARS}, {RAW}, st AS (SELECT symbol, ts, bar_idx, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss, tr::DOUBLE AS tr, plus::DOUBLE AS plus, minus::DOUBLE AS minus, close::DOUBLE AS fast, close::DOUBLE AS slow FROM raw WHERE bar_idx = 0
  UNION ALL {_smoothed('f.')} FROM st f JOIN raw n ON n.symbol = f.symbol AND n.bar_idx = f.bar_idx + 1),
dx AS (SELECT *, fast - slow AS line, CASE WHEN bar_idx >= 13 THEN 100 * abs(plus - minus) / nullif(plus + minus, 0) END AS dx FROM st),
sg AS (SELECT symbol, bar_idx, line AS signal, dx AS adx, CASE WHEN dx IS NULL THEN 0 ELSE 1 END AS n FROM dx WHERE bar_idx = 0
  UNION ALL SELECT n.symbol, n.bar_idx, f.signal + 0.2 * (n.line - f.signal), {_smooth('f.adx', 'n.dx', '1 / 14.0')}, f.n + CASE WHEN n.dx IS NULL THEN 0 ELSE 1 END FROM sg f JOIN dx n ON n.symbol = f.symbol AND n.bar_idx = f.bar_idx + 1)"""


@query(sql(STATE, "SELECT d.symbol, d.ts, d.bar_idx, CASE WHEN d.bar_idx >= 14 AND loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi, CASE WHEN d.bar_idx >= 13 THEN tr / 1000 END AS atr, line / 1000 AS macd, signal / 1000 AS macd_signal, CASE WHEN n >= 14 THEN adx END AS adx FROM dx d JOIN sg USING (symbol, bar_idx)", "symbol ts bar_idx", "rsi atr macd macd_signal adx", recursive=True))
def technical_indicators(spark, d):
    return X.indicators(D.daily_bars(spark, d)).withColumns({c: F.col(c) / 1000 for c in ("atr", "macd", "macd_signal")})


@query(sql(BARS, f"SELECT symbol, ts, close / peak - 1 AS drawdown, bar_idx - last_value(CASE WHEN close = peak THEN bar_idx END IGNORE NULLS) {W} AS bars_since_high, CASE WHEN count(ret) OVER q = 50 THEN quantile_cont(ret, 0.05) OVER q END AS var_5 FROM (SELECT *, max(close) {W} AS peak, close / lag(close) {W} - 1 AS ret FROM bars) WINDOW q AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", "symbol ts bars_since_high", "drawdown var_5"))
def drawdown_features(spark, d):
    return X.drawdown_features(D.daily_bars(spark, d), 50).select("symbol", "ts", "bars_since_high", "drawdown", "var_5")


@query(sql(BARS, f"SELECT symbol, ts, CAST(abs(close - open) <= 0.1 * (high - low) AS INT) AS doji, CAST(least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= abs(close - open) AS INT) AS hammer, CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1 WHEN close < open AND pc > po AND close <= po AND open >= pc THEN -1 ELSE 0 END AS engulfing FROM (SELECT *, lag(open) {W} AS po, lag(close) {W} AS pc FROM bars)", "symbol ts doji hammer engulfing"))
def candlesticks(spark, d):
    return X.candlesticks(D.daily_bars(spark, d)).select("symbol", "ts", "doji", "hammer", "engulfing")


@query(sql(BARS, f"SELECT symbol, count(*) AS n_trades, avg(CASE WHEN dur <= 5 THEN 1.0 ELSE 0.0 END) AS whipsaw_ratio, avg(dur) AS mean_duration FROM (SELECT symbol, lead(bar_idx) {W} - bar_idx AS dur FROM (SELECT * FROM (SELECT *, lag(side) {W} AS b FROM {SIDE}) WHERE side <> 0 AND b <> 0 AND side <> b)) WHERE dur IS NOT NULL GROUP BY symbol", "symbol n_trades", "whipsaw_ratio mean_duration"))
def whipsaw_ratio(spark, d):
    return X.whipsaws(D.daily_bars(spark, d), 5, 20)


@query(sql(BARS, f"SELECT symbol, ts, side, CAST(rid AS BIGINT) AS regime_id, row_number() OVER (PARTITION BY symbol, rid ORDER BY bar_idx) AS age FROM (SELECT *, sum(n) {W} AS rid FROM (SELECT *, CASE WHEN lag(side) {W} IS NOT DISTINCT FROM side THEN 0 ELSE 1 END AS n FROM {SIDE}))", "symbol ts side regime_id age"))
def regime_durations(spark, d):
    c = X.crossovers(D.daily_bars(spark, d), 5, 20)
    return X.regime_durations(c, F.col("side")).select("symbol", "ts", "side", "regime_id", "age")


@query(sql(BARS, f"SELECT symbol, ts, side FROM (SELECT *, lag(side) {W} AS b FROM {SIDE}) WHERE side <> 0 AND side IS DISTINCT FROM b", "symbol ts side"))
def strategy_entries(spark, d):
    c = X.crossovers(D.daily_bars(spark, d), 5, 20)
    return X.entries(c, F.col("side")).select("symbol", "ts", "side")


# microstructure


@query(sql(BARS, f"SELECT symbol, ts, 2 * sqrt(abs(CASE WHEN count(b) OVER q = 20 THEN covar_samp(d, b) OVER q END)) AS roll FROM (SELECT *, lag(d) {W} AS b FROM (SELECT *, close - lag(close) {W} AS d FROM bars)) WINDOW q AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "symbol ts", "roll"))
def roll_measure(spark, d):
    return M.roll_measure(D.daily_bars(spark, d), 20).select("symbol", "ts", "roll")


DEN, K2 = 3 - 2 * math.sqrt(2), math.sqrt(8 / math.pi)


@query(sql(BARS, f"SELECT symbol, ts, 2 * (exp(al) - 1) / (1 + exp(al)) AS spread_cs, greatest({2**-0.5 - 1} * sqrt(beta) / {K2 * DEN} + sqrt(gamma / {K2 * K2 * DEN}), 0) + 0 * beta * gamma AS sigma_bp FROM (SELECT *, greatest({math.sqrt(2) - 1} * sqrt(beta) / {DEN} - sqrt(gamma / {DEN}), 0) + 0 * beta * gamma AS al FROM (SELECT *, {roll('two', 20)} AS beta FROM (SELECT *, hl + lag(hl) {W} AS two, CASE WHEN bar_idx > 0 THEN ln(greatest(high, lag(high) {W}) / least(low, lag(low) {W})) ** 2 END AS gamma FROM (SELECT *, ln(high / low) ** 2 AS hl FROM bars))))", "symbol ts", "spread_cs sigma_bp"))
def corwin_schultz(spark, d):
    return M.corwin_schultz(D.daily_bars(spark, d), 20).select("symbol", "ts", "spread_cs", "sigma_bp")


@query(sql(BARS, f"SELECT symbol, ts, ({roll('k', 20)}) * 1000 AS kyle, ({roll('a', 20)}) * 1e6 AS amihud, ({roll('h', 20)}) * 1000 AS hasbrouck FROM (SELECT *, d / nullif(volume * b, 0) AS k, abs(r) / nullif(dollar_volume, 0) AS a, r / nullif(b * sqrt(dollar_volume), 0) AS h FROM (SELECT *, last_value(nullif(sign(d), 0) IGNORE NULLS) {W} AS b FROM (SELECT *, close - lag(close) {W} AS d, ln(close) - lag(ln(close)) {W} AS r FROM bars)))", "symbol ts", "kyle amihud hasbrouck"))
def bar_lambdas(spark, d):
    return M.bar_lambdas(D.daily_bars(spark, d), 20).select("symbol", "ts", (F.col("kyle_lambda") * 1000).alias("kyle"), (F.col("amihud_lambda") * 1e6).alias("amihud"), (F.col("hasbrouck_lambda") * 1000).alias("hasbrouck"))


def _indexed_ticks(spark, d):
    t = D.with_index(D.events_ticks(spark, d), ("ts", "seq"), "day")
    return t.withColumn("bar_id", F.floor(F.col("bar_idx") / 50))


RULE = f"{TICKS}, idx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS bar_idx FROM ticks), tr AS (SELECT *, CAST(coalesce(last_value(nullif(sign(dp), 0) IGNORE NULLS) {W}, 0) AS INT) AS tick_rule, bar_idx // 50 AS bar_id FROM (SELECT *, price - lag(price) {W} AS dp, ln(price) - lag(ln(price)) {W} AS r FROM idx))"


@query(sql(RULE, "SELECT * FROM tr", "symbol ts seq tick_rule"))
def tick_rule(spark, d):
    return M.tick_rule(_indexed_ticks(spark, d)).select("symbol", "ts", "seq", "tick_rule")


@query(sql(RULE, "SELECT symbol, bar_id, sum(price * volume) / sum(volume) AS vwap, avg(volume) AS avg_size, CAST(sum(tick_rule) AS BIGINT) AS tick_rule_sum, sum(tick_rule * volume * dp) / sum(tick_rule * volume * tick_rule * volume) AS kyle_lambda, 1000 * sum(price * volume * abs(r)) / sum((price * volume) ** 2) AS amihud, 1000 * sum(tick_rule * sqrt(price * volume) * abs(r)) / nullif(sum(tick_rule * tick_rule * price * volume), 0) AS hasbrouck, sum(tick_rule * volume * dp) / nullif(sum(tick_rule * volume * tick_rule * volume), 0) / sqrt((sum(dp * dp) - sum(tick_rule * volume * dp) ** 2 / nullif(sum((tick_rule * volume) ** 2), 0)) / nullif(count(*) - 1, 0) / nullif(sum((tick_rule * volume) ** 2), 0)) AS kyle_t FROM tr WHERE dp IS NOT NULL GROUP BY symbol, bar_id", "symbol bar_id tick_rule_sum", "vwap avg_size kyle_lambda amihud hasbrouck kyle_t"))
def trade_lambdas(spark, d):
    return M.trade_lambdas(_indexed_ticks(spark, d)).select("symbol", "bar_id", "tick_rule_sum", "vwap", "avg_size", "kyle_lambda", (1000 * F.col("amihud_lambda")).alias("amihud"), (1000 * F.col("hasbrouck_lambda")).alias("hasbrouck"), F.col("kyle_t_stat").alias("kyle_t"))


@query(sql(RULE, f"SELECT symbol, bar_idx, ({roll('g', 10)}) / nullif(volume, 0) AS vpin FROM (SELECT symbol, bar_id AS bar_idx, sum(volume) AS volume, abs(2 * sum(CASE WHEN tick_rule > 0 THEN volume ELSE 0 END) - sum(volume)) AS g FROM tr GROUP BY symbol, bar_id)", "symbol bar_idx", "vpin"))
def vpin(spark, d):
    t = M.tick_rule(_indexed_ticks(spark, d)).groupBy("symbol", F.col("bar_id").alias("bar_idx")).agg(F.sum("volume").alias("volume"), F.sum(F.when(F.col("tick_rule") > 0, F.col("volume")).otherwise(0.0)).alias("buy_volume"))
    return M.vpin(t, 10).select("symbol", "bar_idx", "vpin")


@query(sql(RULE, "SELECT symbol, -sum(n / t * log2(n / t)) AS shannon FROM (SELECT symbol, n, sum(n) OVER (PARTITION BY symbol) AS t FROM (SELECT symbol, tick_rule, count(*) AS n FROM tr GROUP BY ALL)) GROUP BY symbol", "symbol", "shannon"))
def shannon_entropy(spark, d):
    return M.code_entropy(M.tick_letters(_indexed_ticks(spark, d)).withColumnRenamed("c", "code"), ["symbol"], "shannon")


@query(sql(RULE + ", msg AS (SELECT symbol, string_agg(CASE tick_rule WHEN 1 THEN 'b' WHEN -1 THEN 's' ELSE 'n' END, '' ORDER BY bar_idx) AS m FROM tr GROUP BY symbol)", "SELECT symbol, -sum(n / t * log2(n / t)) / 3 AS plug_in FROM (SELECT symbol, n, sum(n) OVER (PARTITION BY symbol) AS t FROM (SELECT symbol, substr(m, i, 3) AS w, count(*) AS n FROM (SELECT symbol, m, unnest(range(1, length(m) - 2)) AS i FROM msg) GROUP BY ALL)) GROUP BY symbol", "symbol", "plug_in"))
def plug_in_entropy(spark, d):
    return M.word_entropy(M.tick_letters(_indexed_ticks(spark, d)), 3)


MESSAGES = RULE + """, msg AS (SELECT symbol || '-' || CAST(bar_idx // 200 AS BIGINT) AS symbol, string_agg(CASE c WHEN 1 THEN 'b' WHEN -1 THEN 's' ELSE 'n' END, '' ORDER BY bar_idx) AS m FROM (SELECT *, coalesce(last_value(nullif(sign(d), 0) IGNORE NULLS) OVER (PARTITION BY symbol, bar_idx // 200 ORDER BY bar_idx), 0) AS c FROM (SELECT *, price - lag(price) OVER (PARTITION BY symbol, bar_idx // 200 ORDER BY bar_idx) AS d FROM idx)) GROUP BY ALL),
ko AS (SELECT symbol, avg(log2(i + 1) / (longest + 1)) AS konto FROM (SELECT symbol, i, coalesce(min(CASE WHEN NOT found THEN l END), max(l) + 1) AS longest FROM (SELECT symbol, i, l, contains(substr(m, 1, i + l), substr(m, i + 1, l + 1)) AND i + l < length(m) AND l < i AS found FROM (SELECT *, unnest(range(0, i + 1)) AS l FROM (SELECT *, unnest(range(1, length(m) // 2 + 1)) AS i FROM msg))) GROUP BY symbol, i) GROUP BY symbol),
lz AS (SELECT symbol, m, 0::BIGINT AS nth, '' AS phrase, []::VARCHAR[] AS seen FROM msg
  UNION ALL SELECT symbol, m, nth + 1, CASE WHEN list_contains(seen, phrase || substr(m, nth + 1, 1)) THEN phrase || substr(m, nth + 1, 1) ELSE '' END, CASE WHEN list_contains(seen, phrase || substr(m, nth + 1, 1)) THEN seen ELSE list_append(seen, phrase || substr(m, nth + 1, 1)) END FROM lz WHERE nth < length(m))"""


@query(sql(MESSAGES, "SELECT l.symbol, len(seen) / length(m) AS lempel_ziv, coalesce(konto, 0) AS konto FROM lz l LEFT JOIN ko USING (symbol) WHERE nth = length(m)", "symbol", "lempel_ziv konto", recursive=True))
def message_entropies(spark, d):
    cut = M.encode_tick_rule(_indexed_ticks(spark, d).withColumn("symbol", F.concat_ws("-", "symbol", F.floor(F.col("bar_idx") / 200))))
    return M.message_entropies(cut)


@query(sql(TICKS, "SELECT symbol, seq, CAST((SELECT count(*) FROM (SELECT unnest(q) AS c) WHERE c < price) AS INT) AS code FROM (SELECT *, (SELECT list(quantile_cont) FROM (SELECT 1) LIMIT 0) AS z FROM ticks) JOIN (SELECT symbol, quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM ticks GROUP BY symbol) USING (symbol)".replace("(SELECT *, (SELECT list(quantile_cont) FROM (SELECT 1) LIMIT 0) AS z FROM ticks)", "ticks"), "symbol seq code"))
def quantile_encoding(spark, d):
    return M.quantile_codes(D.events_ticks(spark, d), "price", 4).select("symbol", "seq", "code")


# structural breaks


@query(sql(BARS, """SELECT symbol, ts, bar_idx, b / sqrt((syy - b * sxy) / (m - 1) / sxx) AS dfc FROM (SELECT *, sxy / sxx AS b FROM (SELECT symbol, ts, bar_idx, n, sum(x * x) OVER a AS sxx, sum(x * dy) OVER a AS sxy, sum(dy * dy) OVER p AS syy, count(*) OVER p AS m FROM (SELECT *, y - x AS dy FROM (SELECT *, ln(close) AS y, lag(ln(close)) OVER (PARTITION BY symbol ORDER BY bar_idx) AS x, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE x IS NOT NULL) WINDOW a AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), p AS (PARTITION BY symbol))) WHERE bar_idx >= 20 AND bar_idx < n - 20""", "symbol ts bar_idx", "dfc"))
def chow_breaks(spark, d):
    return K.chow(D.daily_bars(spark, d), 20)


def _csw(value: str) -> str:
    return sql(BARS, f"SELECT t.symbol, t.bar_idx, max({value}) AS stat, sqrt(4.6 + ln(arg_max(t.bar_idx - n.bar_idx, {value}))) AS critical FROM (SELECT *, sum(d * d) {W} / nullif(bar_idx - 1, 0) AS s2 FROM (SELECT *, ln(close) - lag(ln(close)) {W} AS d FROM bars)) t JOIN bars n ON n.symbol = t.symbol AND n.bar_idx < t.bar_idx WHERE t.bar_idx >= 2 GROUP BY t.symbol, t.bar_idx", "symbol bar_idx", "stat critical")


@query(_csw("1 / (s2 * sqrt(t.bar_idx - n.bar_idx)) * (ln(t.close) - ln(n.close))"))
def chu_stinchcombe_white(spark, d):
    return K.chu_stinchcombe_white(D.daily_bars(spark, d)).where("stat is not null").select("symbol", "bar_idx", "stat", "critical")


@query(_csw("abs(ln(t.close) - ln(n.close)) / sqrt(s2 * (t.bar_idx - n.bar_idx))"))
def chu_stinchcombe_white_two_sided(spark, d):
    return K.chu_stinchcombe_white(D.daily_bars(spark, d), one_sided=False, standardised=True).where("stat is not null").select("symbol", "bar_idx", "stat", "critical")


@query()
def sadf(spark, d):
    return K.sadf(D.daily_bars(spark, d))


ADF = f"""{BARS}, reg AS (SELECT symbol, y - x AS dy, x, x - lag(x) {W} AS z FROM (SELECT symbol, bar_idx, ln(close) AS y, lag(ln(close)) {W} AS x FROM bars)),
su AS (SELECT symbol, count(*) AS n, regr_sxx(x, x) AS xx, regr_sxx(z, z) AS zz, regr_syy(dy, dy) AS yy, regr_sxy(x, z) AS xz, regr_sxy(dy, x) AS xy, regr_sxy(dy, z) AS zy FROM reg WHERE z IS NOT NULL GROUP BY symbol)"""


LOWER_P, UPPER_P = "2.1659 + 1.4412 * t + 0.038269 * t * t", "1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t"


@query(sql(ADF + ", ts AS (SELECT symbol, n, b / sqrt((yy - b * xy - c * zy) / (n - 3) * zz / det) AS t FROM (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS c FROM su))", f"SELECT symbol, t AS adf, p_value, critical, t < critical AND p_value < 0.05 AS stationary FROM (SELECT symbol, t, CASE WHEN t < -18.83 THEN 0 WHEN t > 2.74 THEN 1 WHEN t <= -1.61 THEN {norm_cdf_sql('(' + LOWER_P + ')')} ELSE {norm_cdf_sql('(' + UPPER_P + ')')} END AS p_value, -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3 AS critical FROM ts)", "symbol stationary", "adf p_value critical"))
def adf_stationarity(spark, d):
    return K.adf(D.daily_bars(spark, d))


# back-test statistics

POS = f"{BARS}, rets AS (SELECT symbol, ts, bar_idx, close, coalesce((close - lag(close) {W}) / (close + lag(close) {W}), 0) * 0.05 AS ret FROM bars), pos AS (SELECT b.symbol, b.ts, b.bar_idx, b.side::DOUBLE AS pos, r.ret FROM {SIDE} b JOIN rets r USING (symbol, ts))"


def _returns(spark, d):
    before = F.lag("close").over(series())
    r = F.coalesce((F.col("close") - before) / (F.col("close") + before), F.lit(0.0)) * 0.05
    return D.daily_bars(spark, d).withColumn("ret", r).select("symbol", "ts", "bar_idx", "close", "ret")


def _positions(spark, d):
    c = X.crossovers(D.daily_bars(spark, d), 5, 20).select("symbol", "ts", F.col("side").cast("double").alias("pos"))
    return c.join(_returns(spark, d), ["symbol", "ts"])


@query(sql(POS, f"SELECT symbol, ts, pos FROM (SELECT *, lag(pos) {W} AS b, max(ts) OVER (PARTITION BY symbol) AS last FROM pos) WHERE (pos = 0 AND (b <> 0 OR b IS NULL)) OR pos * b < 0 OR ts = last", "symbol ts", "pos"))
def flattening_and_flips(spark, d):
    return T.flips(_positions(spark, d)).select("symbol", "ts", "pos")


HELD = f"""{POS}, fold AS (SELECT symbol, bar_idx, pos, 0.0::DOUBLE AS since, 0.0::DOUBLE AS held, 0.0::DOUBLE AS closed FROM pos WHERE bar_idx = 0
  UNION ALL SELECT n.symbol, n.bar_idx, n.pos,
    CASE WHEN n.pos * f.pos < 0 THEN n.days WHEN abs(n.pos) > abs(f.pos) THEN (f.since * abs(f.pos) + n.days * (abs(n.pos) - abs(f.pos))) / abs(n.pos) ELSE f.since END,
    CASE WHEN n.pos * f.pos < 0 THEN (n.days - f.since) * abs(f.pos) WHEN abs(n.pos) < abs(f.pos) THEN (n.days - f.since) * (abs(f.pos) - abs(n.pos)) ELSE 0 END,
    CASE WHEN n.pos * f.pos < 0 THEN abs(f.pos) WHEN abs(n.pos) < abs(f.pos) THEN abs(f.pos) - abs(n.pos) ELSE 0 END
  FROM fold f JOIN (SELECT *, date_diff('microsecond', min(ts) OVER (PARTITION BY symbol), ts) / 86400000000 AS days FROM pos) n ON n.symbol = f.symbol AND n.bar_idx = f.bar_idx + 1)"""


@query(sql(HELD, "SELECT symbol, sum(held) / nullif(sum(closed), 0) AS days FROM fold GROUP BY symbol", "symbol", "days", recursive=True))
def average_holding_period(spark, d):
    return T.holding_period(_positions(spark, d))


HHI = "CASE WHEN count({0}) > 2 THEN (sum({0} * {0}) / nullif(sum({0}) * sum({0}), 0) - 1.0 / count({0})) / (1 - 1.0 / count({0})) END"
MONTHS = "(SELECT s.symbol, coalesce(m.n, 0)::DOUBLE AS n FROM (SELECT symbol, unnest(generate_series(min(date_trunc('month', ts))::TIMESTAMP, max(date_trunc('month', ts))::TIMESTAMP, INTERVAL 1 MONTH)) AS mo FROM rets GROUP BY symbol) s LEFT JOIN (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS mo, count(*) AS n FROM rets GROUP BY ALL) m ON m.symbol = s.symbol AND m.mo = s.mo)"


@query(sql(POS, f"SELECT a.symbol, a.positive, a.negative, b.monthly FROM (SELECT symbol, {HHI.format('CASE WHEN ret >= 0 THEN ret END')} AS positive, {HHI.format('CASE WHEN ret < 0 THEN ret END')} AS negative FROM rets GROUP BY symbol) a JOIN (SELECT symbol, {HHI.format('n')} AS monthly FROM {MONTHS} GROUP BY symbol) b USING (symbol)", "symbol", "positive negative monthly"))
def bets_concentration(spark, d):
    return T.bets_concentration(_returns(spark, d))


EQUITY = POS + f", eq AS (SELECT symbol, ts, bar_idx, exp(sum(ln(1 + ret)) {W}) AS equity FROM rets)"


@query(sql(BARS, f"SELECT symbol, start AS ts, 1 - low / hwm AS drawdown, date_diff('microsecond', start, coalesce(lead(start) OVER (PARTITION BY symbol ORDER BY start), last)) / 86400000000 AS days_under_water FROM (SELECT symbol, hwm, min(close) AS low, min(ts) AS start, any_value(last) AS last FROM (SELECT *, max(close) {W} AS hwm, max(ts) OVER (PARTITION BY symbol) AS last FROM bars) GROUP BY symbol, hwm) WHERE hwm > low", "symbol ts", "drawdown days_under_water"))
def drawdown_and_time_under_water(spark, d):
    return T.drawdowns(D.daily_bars(spark, d).withColumnRenamed("close", "equity"))


@query(sql(POS, "SELECT symbol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, count(*) AS n FROM rets GROUP BY symbol", "symbol n", "sharpe"))
def sharpe_ratio(spark, d):
    return T.sharpe(_returns(spark, d)).select("symbol", "n", "sharpe")


def _sharpe_tests(spark, d):
    return T.sharpe(_returns(spark, d), periods=1)


G1 = "(avg(x ** 3) / avg(x ** 2) ** 1.5)"
MOMENTS = POS + f", mo AS (SELECT symbol, count(*) AS n, any_value(sr) AS sr, {G1} AS skew, avg(x ** 4) / avg(x ** 2) ** 2 AS kurt FROM (SELECT symbol, ret - avg(ret) OVER p AS x, avg(ret) OVER p / stddev_samp(ret) OVER p AS sr FROM rets WINDOW p AS (PARTITION BY symbol)) GROUP BY symbol)"


@query(sql(MOMENTS, f"SELECT symbol, {norm_cdf_sql('((sr - 0.01) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))')} AS psr FROM mo", "symbol", "psr"))
def probabilistic_sharpe(spark, d):
    s = _sharpe_tests(spark, d)
    return s.select("symbol", T.probabilistic_sharpe(F.col("sharpe"), F.lit(0.01), F.col("n"), F.col("skew"), F.col("kurt")).alias("psr"))


@query(sql(MOMENTS, "SELECT symbol, 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (1.6448536269514722 / nullif(sr - 0.0, 0)) ** 2 AS n_min FROM mo", "symbol", "n_min"))
def minimum_track_record(spark, d):
    s = _sharpe_tests(spark, d)
    return s.select("symbol", T.minimum_track_record(F.col("sharpe"), F.lit(0.0), F.col("skew"), F.col("kurt")).alias("n_min"))


BEST_OF_3 = (1 - T.EULER) * norm_ppf(1 - 1 / 3) + T.EULER * norm_ppf(1 - 1 / 3 * math.exp(-1))


@query(sql(MOMENTS, f"SELECT stddev_pop(sr) * {BEST_OF_3!r} AS benchmark FROM mo", "", "benchmark"))
def deflated_sharpe_benchmark(spark, d):
    return T.deflated_benchmark(_sharpe_tests(spark, d))


TRADES = POS + f""", held AS (SELECT *, coalesce(lag(pos) {W}, 0) AS h FROM pos), runs AS (SELECT *, sum(n) {W} AS trade_id FROM (SELECT *, CASE WHEN lag(sign(h)) {W} IS NOT DISTINCT FROM sign(h) THEN 0 ELSE 1 END AS n FROM held)),
tl AS (SELECT symbol, CAST(trade_id AS BIGINT) AS trade_id, min(ts) AS "start", max(ts) AS "end", max(sign(h)) AS side, exp(sum(ln(1 + h * ret))) - 1 AS ret, count(*) AS bars FROM runs WHERE h <> 0 GROUP BY symbol, trade_id)"""


@query(sql(TRADES, "SELECT * FROM tl", 'symbol trade_id "start" "end" bars', "side ret"))
def trade_list(spark, d):
    return T.trades(_positions(spark, d))


@query(sql(TRADES, "SELECT symbol, count(*) AS n_trades, avg((ret > 0)::INT) AS win_rate, avg(CASE WHEN ret > 0 THEN ret END) AS avg_win, avg(CASE WHEN ret <= 0 THEN ret END) AS avg_loss, avg((ret > 0)::INT) - (1 - avg((ret > 0)::INT)) / (avg(CASE WHEN ret > 0 THEN ret END) / -avg(CASE WHEN ret <= 0 THEN ret END)) AS kelly, sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret <= 0 THEN ret END) AS profit_factor, avg(ret) AS expectancy, max(ret) AS best, min(ret) AS worst, any_value(max_wins) AS max_wins, any_value(max_losses) AS max_losses FROM tl JOIN (SELECT symbol, coalesce(max(k) FILTER (win), 0) AS max_wins, coalesce(max(k) FILTER (NOT win), 0) AS max_losses FROM (SELECT symbol, win, run, count(*) AS k FROM (SELECT symbol, ret > 0 AS win, row_number() OVER (PARTITION BY symbol ORDER BY start) - row_number() OVER (PARTITION BY symbol, ret > 0 ORDER BY start) AS run FROM tl) GROUP BY ALL) GROUP BY symbol) USING (symbol) GROUP BY symbol", "symbol n_trades max_wins max_losses", "win_rate avg_win avg_loss kelly profit_factor expectancy best worst"))
def trade_statistics(spark, d):
    return T.trade_statistics(T.trades(_positions(spark, d))).select("symbol", "n_trades", "max_wins", "max_losses", "win_rate", "avg_win", "avg_loss", "kelly", "profit_factor", "expectancy", "best", "worst")


@query(sql(EQUITY, f"SELECT r.symbol, exp(sum(ln(1 + ret))) - 1 AS total_return, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS annual_return, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(252) AS sortino, max(dd) AS max_drawdown, avg(dd) AS avg_drawdown, skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS skew, kurtosis_pop(ret) AS kurt, avg((ret > 0)::INT) AS positive_share, count(*) AS n, (exp(sum(ln(1 + ret)) * 252 / count(*)) - 1) / nullif(max(dd), 0) AS calmar, sqrt(avg(dd * dd)) AS ulcer, any_value(v) AS var_5, avg(CASE WHEN ret <= v THEN ret END) AS cvar_5 FROM (SELECT r.*, 1 - e.equity / greatest(max(e.equity) OVER (PARTITION BY r.symbol ORDER BY r.bar_idx), 1) AS dd, quantile_cont(r.ret, 0.05) OVER (PARTITION BY r.symbol) AS v FROM rets r JOIN eq e USING (symbol, ts)) r GROUP BY r.symbol", "symbol n", "total_return annual_return volatility sharpe sortino max_drawdown avg_drawdown skew kurt positive_share calmar ulcer var_5 cvar_5"))
def performance_metrics(spark, d):
    return T.performance(_returns(spark, d))


@query(sql(BARS, f"SELECT symbol, 365.25 * 86400 / quantile_cont(s, 0.5) AS periods FROM (SELECT symbol, date_diff('microsecond', lag(ts) {W}, ts) / 1e6 AS s FROM bars) GROUP BY symbol", "symbol", "periods"))
def annualisation_factor(spark, d):
    return T.annualisation(D.daily_bars(spark, d))


PVALUES = MOMENTS + f", pv AS (SELECT symbol, sr AS sharpe, 2 * {norm_sf_sql('abs(sr) * sqrt(1000)')} AS p FROM mo), rk AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, sharpe) AS k FROM pv)"


@query(sql(PVALUES, "SELECT symbol, sharpe, p, least(p * m, 1) AS bonferroni, least(max((m - k + 1) * p) OVER (ORDER BY k), 1) AS holm, least(min(m * (SELECT sum(1.0 / i) FROM (SELECT unnest(range(1, x.m + 1)) AS i)) / k * p) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS bhy FROM rk x", "symbol", "sharpe p bonferroni holm bhy"))
def haircut_sharpe(spark, d):
    return T.haircuts(_sharpe_tests(spark, d).select("symbol", "sharpe"), 1000)


ENTRY = f"(SELECT *, lag(side) {W} AS b, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM {SIDE})"


@query(sql(BARS + f", en AS (SELECT symbol, bar_idx, side, CASE WHEN bar_idx + 10 <= last THEN bar_idx + 10 END AS i1 FROM {ENTRY} WHERE side <> 0 AND side IS DISTINCT FROM b)", f"SELECT symbol, ts, coalesce(last_value(x IGNORE NULLS) {W}, 0)::DOUBLE AS pos FROM (SELECT p.symbol, p.ts, p.bar_idx, coalesce(s.side, CASE WHEN f.i1 IS NOT NULL THEN 0 END) AS x FROM bars p LEFT JOIN en s ON s.symbol = p.symbol AND s.bar_idx = p.bar_idx LEFT JOIN (SELECT DISTINCT symbol, i1 FROM en) f ON f.symbol = p.symbol AND f.i1 = p.bar_idx)", "symbol ts", "pos"))
def positions_from_events(spark, d):
    bars = D.daily_bars(spark, d)
    c = X.crossovers(bars, 5, 20)
    starts = X.entries(c, F.col("side")).select("symbol", F.col("bar_idx").alias("i0"), F.col("ts").alias("t0"), "side")
    e = L.vertical_barriers(starts, bars, n_bars=10).withColumn("t1", F.coalesce("t1", F.lit("2999-01-01").cast("timestamp")))
    return T.positions_from_events(bars, e).select("symbol", "ts", "pos")


# bet sizes

BETS = ev(BARS, "bars") + ", bet AS (SELECT e.symbol, e.t0, p.ts AS t1, CASE WHEN e.i0 % 3 = 0 THEN -1 ELSE 1 END AS side, 0.3 + (e.i0 % 61) / 100.0 AS prob FROM ev e JOIN px p ON p.symbol = e.symbol AND p.bar_idx = e.i1)"


def _bets(spark, d):
    bars = D.daily_bars(spark, d)
    e = L.vertical_barriers(_events(bars).drop("i1"), bars, n_bars=20).where("t1 is not null")
    return e.select("symbol", "t0", "t1", F.when(F.col("i0") % 3 == 0, -1).otherwise(1).alias("side"), (0.3 + (F.col("i0") % 61) / 100).alias("prob"))


SIGNAL = f"(2 * {norm_cdf_sql('((prob - 0.5) / sqrt(prob * (1 - prob)))')} - 1)"


@query(sql(BETS, f"SELECT symbol, t0, s AS signal, least(greatest(round_even(s / 0.05, 0) * 0.05, -1), 1) AS size FROM (SELECT *, side * {SIGNAL} AS s FROM bet)", "symbol t0", "signal size"))
def bet_size_probability(spark, d):
    b = _bets(spark, d).withColumn("signal", S.signal(F.col("prob"), 2, F.col("side")))
    return b.select("symbol", "t0", "signal", S.discrete(F.col("signal"), 0.05).alias("size"))


@query(sql(BETS + f", sg AS (SELECT *, side * {SIGNAL} AS signal FROM bet)", "SELECT t.symbol, t.ts, coalesce((SELECT avg(signal) FROM sg WHERE sg.symbol = t.symbol AND sg.t0 <= t.ts AND t.ts < sg.t1), 0) AS signal FROM (SELECT symbol, t0 AS ts FROM sg UNION SELECT symbol, t1 FROM sg) t", "symbol ts", "signal"))
def average_active_signals(spark, d):
    return S.average_active(_bets(spark, d).withColumn("signal", S.signal(F.col("prob"), 2, F.col("side"))))


@query(sql(BETS, "SELECT symbol, ts, long, short, long / nullif(max(long) OVER p, 0) - short / nullif(max(short) OVER p, 0) AS bet_size FROM (SELECT t.symbol, t.ts, (SELECT count(*) FROM bet b WHERE b.symbol = t.symbol AND side > 0 AND b.t0 <= t.ts AND t.ts < b.t1) AS long, (SELECT count(*) FROM bet b WHERE b.symbol = t.symbol AND side < 0 AND b.t0 <= t.ts AND t.ts < b.t1) AS short FROM (SELECT DISTINCT symbol, t0 AS ts FROM bet) t) WINDOW p AS (PARTITION BY symbol)", "symbol ts long short", "bet_size"))
def bet_size_budget(spark, d):
    return S.budget(_bets(spark, d))


@query(sql(BARS, "SELECT symbol, ts, target, x / sqrt(100 + x * x) AS bet_size FROM (SELECT symbol, ts, high - close AS x, CAST(trunc((high - close) / sqrt(100 + (high - close) ** 2) * 50) AS INT) AS target FROM bars)", "symbol ts target", "bet_size"))
def bet_size_dynamic(spark, d):
    rows = D.daily_bars(spark, d).select("symbol", "ts", F.lit(0).alias("pos"), F.lit(50).alias("most"), F.col("close").alias("price"), F.col("high").alias("forecast"))
    return S.dynamic(rows, 100.0).select("symbol", "ts", "target", "bet_size")


SCORED = "scored AS (SELECT (l_returnflag = 'R')::INT AS y, least(greatest(l_discount * 8 + l_tax, 0.01), 0.99) AS p, l_quantity AS weight FROM lineitem)"


def _scored(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(*V.labelled(F.col("l_returnflag") == "R", F.least(F.greatest(F.col("l_discount") * 8 + F.col("l_tax"), F.lit(0.01)), F.lit(0.99)), F.col("l_quantity")))


@query(sql(SCORED, "SELECT m1, m2, m2 - m1 ** 2 AS c2, m3 - 3 * m1 * m2 + 2 * m1 ** 3 AS c3 FROM (SELECT avg(weight) / 10 AS m1, avg((weight / 10) ** 2) AS m2, avg((weight / 10) ** 3) AS m3 FROM scored)", "", "m1 m2 c2 c3"))
def moments(spark, d):
    m = S.raw_moments(_scored(spark, d).withColumn("x", F.col("weight") / 10), "x")
    return S.centred_moments(m).crossJoin(m).select("m1", "m2", "c2", "c3")


@query()
def mixture_fit(spark, d):
    m = S.raw_moments(_scored(spark, d).withColumn("x", F.col("weight") / 10), "x").first()
    return S.mixture(spark, [m[f"m{k}"] for k in range(1, 6)], runs=500)


@query(sql(SCORED, "SELECT p, CASE WHEN p > 0.3 THEN c / t ELSE 0 END AS bet_size FROM (SELECT p, sum(w) OVER (ORDER BY p) AS c, sum(w) OVER () AS t FROM (SELECT p, count(*) FILTER (y = 1 AND p > 0.3) AS w FROM scored GROUP BY p))", "", "p bet_size"))
def ecdf_bet_size(spark, d):
    return S.ecdf_size(_scored(spark, d), 0.3).select("p", "bet_size").distinct()


# validation

LABELS = ev(BARS, "bars") + ", lb AS (SELECT e.symbol, e.t0, p.ts AS t1, ntile(5) OVER (PARTITION BY e.symbol ORDER BY e.t0) - 1 AS fold, row_number() OVER (PARTITION BY e.symbol ORDER BY e.t0) - 1 AS row, count(*) OVER (PARTITION BY e.symbol) AS n FROM ev e JOIN px p ON p.symbol = e.symbol AND p.bar_idx = e.i1)"


def _labels(spark, d):
    return _bets(spark, d).select("symbol", "t0", "t1")


@query(sql(LABELS + ", fd AS (SELECT symbol, fold AS f, min(t0) AS lo, max(t1) AS hi FROM lb GROUP BY ALL)", "SELECT symbol, t0, f AS fold, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM (SELECT l.*, f.f, f.lo, f.hi, min(CASE WHEN l.t0 > f.hi THEN l.row END) OVER (PARTITION BY l.symbol, f.f) AS fa FROM lb l JOIN fd f ON f.symbol = l.symbol) WHERE fold = f OR t1 < lo OR (t0 > hi AND row >= fa + floor(n * 0.02::DOUBLE))", "symbol t0 fold role"))
def purged_k_fold(spark, d):
    return V.purged_folds(_labels(spark, d), 5, 0.02).select("symbol", "t0", "fold", "role")


@query(sql(LABELS, "SELECT symbol, t0, CASE WHEN row >= floor(n * 0.7::DOUBLE) + 1 THEN 'test' ELSE 'train' END AS role FROM (SELECT *, min(CASE WHEN row >= floor(n * 0.7::DOUBLE) + 1 THEN t0 END) OVER (PARTITION BY symbol) AS lo FROM lb) WHERE row >= floor(n * 0.7::DOUBLE) + 1 OR t1 < lo", "symbol t0 role"))
def purged_split(spark, d):
    return V.purged_split(_labels(spark, d), 0.3).select("symbol", "t0", "role")


@query(sql(LABELS + ", fd AS (SELECT symbol, fold AS g, min(t0) AS lo, max(t1) AS hi FROM lb GROUP BY ALL), ch AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS split, a, b FROM (SELECT unnest(range(5)) AS a) x, (SELECT unnest(range(5)) AS b) y WHERE a < b)", "SELECT symbol, t0, split, CASE WHEN fold IN (a, b) THEN 'test' ELSE 'train' END AS role FROM lb l CROSS JOIN ch WHERE fold IN (a, b) OR NOT EXISTS (SELECT 1 FROM fd WHERE fd.symbol = l.symbol AND fd.g IN (ch.a, ch.b) AND l.t0 <= fd.hi AND fd.lo <= l.t1)", "symbol t0 split role"))
def combinatorial_purged_k_fold(spark, d):
    return V.combinatorial_folds(_labels(spark, d), 5, 2).select("symbol", "t0", "split", "role")


@query(sql(SCORED, "SELECT sum(CASE WHEN (p >= 0.5)::INT = y THEN weight ELSE 0 END) / sum(weight) AS accuracy, -sum(weight * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(weight) AS log_loss, sum(weight * (p - y) ** 2) / sum(weight) AS brier, sum(CASE WHEN (p >= 0.5)::INT = y THEN weight * (greatest(p, 1 - p) - 0.5) ELSE 0 END) / sum(weight * (greatest(p, 1 - p) - 0.5)) AS pwa FROM scored", "", "accuracy log_loss brier pwa"))
def weighted_scores(spark, d):
    return V.weighted_scores(_scored(spark, d)).select("accuracy", "log_loss", "brier", "pwa")


@query(sql(SCORED, "SELECT y, (p >= 0.5)::INT AS pred, count(*) AS n FROM scored GROUP BY ALL", "y pred n"))
def confusion_matrix(spark, d):
    return V.confusion(_scored(spark, d))


REL = "SELECT CAST(least(greatest(ceil(p * 10) - 1, 0), 9) AS INT) AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM scored GROUP BY ALL"


@query(sql(SCORED, REL, "bin n", "confidence accuracy"))
def reliability_curve(spark, d):
    return V.reliability(_scored(spark, d))


@query(sql(SCORED, f"SELECT sum(abs(accuracy - confidence) * n) / sum(n) AS ece, max(abs(accuracy - confidence)) AS mce FROM ({REL})", "", "ece mce"))
def calibration_errors(spark, d):
    return V.calibration_errors(_scored(spark, d))


@query(sql(SCORED, "SELECT p, tp, called, tp / called AS precision, tp / pos AS recall, (called - tp) / (n - pos) AS fpr FROM (SELECT p, CAST(sum(y) OVER w AS BIGINT) AS tp, CAST(sum(k) OVER w AS BIGINT) AS called, sum(y) OVER () AS pos, sum(k) OVER () AS n FROM (SELECT p, sum(y) AS y, count(*) AS k FROM scored GROUP BY p) WINDOW w AS (ORDER BY p DESC))", "tp called", "p precision recall fpr"))
def roc_pr_curves(spark, d):
    return V.thresholds(_scored(spark, d)).select("p", "tp", "called", "precision", "recall", "fpr")


@query(sql(SCORED, "SELECT sum(pos * (below + (k - pos) / 2)) / (any_value(pp) * any_value(nn)) AS auc, any_value(pp) / (any_value(pp) + any_value(nn)) AS base_rate FROM (SELECT p, y AS pos, k, coalesce(sum(k - y) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(y) OVER () AS pp, sum(k - y) OVER () AS nn FROM (SELECT p, sum(y) AS y, count(*) AS k FROM scored GROUP BY p))", "", "auc base_rate"))
def ranking_scores(spark, d):
    return V.ranking_scores(_scored(spark, d)).select("auc", "base_rate")


@query(sql(SCORED, "SELECT arg_max(p, row(f1, p)) AS p, max(f1) AS f1 FROM (SELECT p, coalesce(2 * tp / nullif(called + pos, 0), 0) AS f1 FROM (SELECT p, sum(y) OVER (ORDER BY p DESC) AS tp, sum(k) OVER (ORDER BY p DESC) AS called, sum(y) OVER () AS pos FROM (SELECT p, sum(y) AS y, count(*) AS k FROM scored GROUP BY p)))", "", "p f1"))
def best_threshold(spark, d):
    return V.best_threshold(_scored(spark, d))


@query()
def isotonic_calibration(spark, d):
    return V.isotonic(_scored(spark, d)).groupBy("p").agg(F.first("calibrated").alias("calibrated"))


@query()
def platt_calibration(spark, d):
    return V.platt(_scored(spark, d)).groupBy("p").agg(F.first("calibrated").alias("calibrated"))


@query()
def bootstrap_reliability(spark, d):
    return V.bootstrap_reliability(_scored(spark, d))


@query()
def purged_cross_validation(spark, d):
    bars = D.daily_bars(spark, d)
    x = R.rolling_autocorrelation(R.parkinson(bars, 20), 20).select("symbol", F.col("ts").alias("t0"), F.coalesce("vol", F.lit(0.0)).alias("vol"), F.coalesce("autocorr", F.lit(0.0)).alias("autocorr"))
    y = _labels(spark, d).join(bars.select("symbol", F.col("ts").alias("t0"), F.col("close").alias("p0")), ["symbol", "t0"]).join(bars.select("symbol", F.col("ts").alias("t1"), F.col("close").alias("p1")), ["symbol", "t1"])
    data = y.select("symbol", "t0", (F.col("p1") > F.col("p0")).cast("int").alias("y"), F.lit(1.0).alias("weight")).join(x, ["symbol", "t0"])
    return V.cross_validate(data, V.purged_folds(_labels(spark, d), 3), ["vol", "autocorr"])


# back-tests and simulation


@query(sql(BARS, f"SELECT symbol, ts, net, exp(sum(ln(1 + net)) {W}) AS equity FROM (SELECT *, coalesce(h * r, 0) - 0.0001 * abs(h - coalesce(lag(h) {W}, 0)) AS net FROM (SELECT *, coalesce(lag(pos) {W}, 0) AS h, close / lag(close) {W} - 1 AS r FROM (SELECT *, side * 0.0001 AS pos FROM {SIDE})))", "symbol ts", "net equity"))
def backtest_model(spark, d):
    c = X.crossovers(D.daily_bars(spark, d), 5, 20).withColumn("pos", F.col("side") * 0.0001)
    return G.backtest(c, 0.0001).select("symbol", "ts", "net", "equity")


@query(sql(ev(BARS, "bars") + TOUCH.format(ev="ev").replace("-0.5", "-0.1").replace("1.0 THEN", "0.2 THEN"), "SELECT symbol, i0, ret / 10000 - 0.000002 AS net, exp(sum(ln(1 + ret / 10000 - 0.000002)) OVER (PARTITION BY symbol ORDER BY t1, i0)) AS equity FROM lab", "symbol i0", "net equity"))
def backtest_with_labels(spark, d):
    bars = D.daily_bars(spark, d)
    touched = L.triple_barrier_events(_events(bars).withColumn("trgt", F.lit(0.1)), bars, 2.0, 1.0)
    lab = L.barrier_labels(touched, bars).withColumn("ret", F.col("ret") / 10000)
    return G.labelled_backtest(lab, 0.000001).select("symbol", "i0", "net", "equity")


@query(sql(BARS, f"SELECT symbol, phi, sqrt(greatest(xx - 2 * phi * xb + phi * phi * bb, 0) / n) AS sigma, -ln(2) / ln(phi) AS half_life FROM (SELECT symbol, least(greatest(sum(x * b) / sum(b * b), 0.001), 0.999) AS phi, sum(x * b) AS xb, sum(b * b) AS bb, sum(x * x) AS xx, count(*) AS n FROM (SELECT *, lag(x) {W} AS b FROM (SELECT *, close - avg(close) OVER (PARTITION BY symbol) AS x FROM bars)) WHERE b IS NOT NULL GROUP BY symbol)", "symbol", "phi sigma half_life"))
def ou_parameters(spark, d):
    return G.ou_parameters(D.daily_bars(spark, d))


@query(sql(BARS, f"SELECT symbol, avg(r) * 252 AS drift, stddev_samp(r) * sqrt(252) AS volatility, avg(j::INT) AS jump_share, avg(CASE WHEN j THEN r END) AS jump_mean, regr_slope(CASE WHEN r <> 0 THEN ln(abs(r)) END, lp) AS elasticity FROM (SELECT *, abs(r - avg(r) OVER p) > 2.5 * stddev_samp(r) OVER p AS j FROM (SELECT symbol, ln(close / lag(close) {W}) AS r, ln(lag(close) {W}) AS lp FROM bars) WHERE r IS NOT NULL WINDOW p AS (PARTITION BY symbol)) GROUP BY symbol", "symbol", "drift volatility jump_share jump_mean elasticity"))
def process_estimates(spark, d):
    return G.process_estimates(D.daily_bars(spark, d))


@query()
def barrier_simulation(spark, d):
    ou = G.ou_parameters(D.daily_bars(spark, d)).agg(F.avg("phi").alias("phi"), F.avg("sigma").alias("sigma")).first()
    return G.simulate_barriers(spark, ou.phi, 1.0, 0.0, 0.0, [1.0, 2.0], [1.0, 2.0], paths=512)


RULES = [(0.5, 0.3), (1.0, 0.5)]


@query(sql(ev(CLOSES, "closes") + ", ru AS (SELECT * FROM (VALUES (0.5::DOUBLE, 0.3::DOUBLE), (1.0, 0.5)) t(pt, sl))", "SELECT symbol, i0, pt, sl, CASE WHEN u IS NOT NULL AND (dn IS NULL OR u < dn) THEN pt WHEN dn IS NOT NULL THEN -sl ELSE last_r END AS ret FROM (SELECT e.symbol, e.i0, r.pt, r.sl, min(CASE WHEN p.close / e.p0 - 1 >= r.pt THEN p.bar_idx END) AS u, min(CASE WHEN p.close / e.p0 - 1 <= -r.sl THEN p.bar_idx END) AS dn, arg_max(p.close / e.p0 - 1, p.bar_idx) AS last_r FROM ev e CROSS JOIN ru r JOIN px p ON p.symbol = e.symbol AND p.bar_idx BETWEEN e.i0 + 1 AND e.i0 + 20 GROUP BY ALL)", "symbol i0", "pt sl ret"))
def trading_rule_grid(spark, d):
    bars = D.events_close(spark, d)
    return G.trading_rule_grid(_events(bars).withColumn("side", F.lit(1)), bars, RULES, 20)
