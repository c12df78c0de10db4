"""Further queries: feature matrices, learning, comparisons, simple surfaces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions.mathx import norm_cdf_sql
from tickloom.operators import bars as B
from tickloom.operators import bets as S
from tickloom.operators import breaks as K
from tickloom.operators import features as X
from tickloom.operators import learning as N
from tickloom.operators import matrices as A
from tickloom.operators import microstructure as M
from tickloom.operators import sampling as L
from tickloom.operators import statistics as T
from tickloom.operators import strategies as Y
from tickloom.operators import validation as V
from tickloom.operators import volatility as R
from tickloom.plans.queries import BARS, BEST_OF_3, BETS, CLOSES, LOWER_P, MOMENTS, OHLC, POS, RULE, SIDE, SIGNAL, STATE, TICKS, TOUCH, TRADES, UPPER_P, W, _bets, _events, _indexed_ticks, _labels, _positions, _sharpe_tests, ev, query, roll, sql
from tickloom.sources import market as D

# sources


def _store(spark, d) -> str:
    """Ticks in the shared folder, stored in two goes of which the second overlaps the first."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/ticks-{uuid.uuid4().hex}"
    ticks = D.events_ticks(spark, d)
    D.write_ticks(ticks.where(F.col("ts") < HALF).withColumn("gap", F.lit(None).cast("double")), path)
    D.write_ticks(ticks.withColumn("gap", F.lit(1.0)), path)
    return path


HALF, FIRST, LAST = "2024-01-15 00:00:00", "2024-01-05 00:00:00", "2024-01-25 00:00:00"


@query(sql(TICKS, f"SELECT symbol, ts, seq, price, volume FROM ticks WHERE ts BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}'", "symbol ts seq", "price volume"))
def stored_ticks(spark, d):
    return D.read_ticks(spark, _store(spark, d), start=FIRST, end=LAST)


@query(sql(TICKS, f"SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ts, {OHLC} FROM ticks WHERE ts BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}' GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts)", "symbol ts tick_volume", "open high low close volume"))
def bars_from_store(spark, d):
    return D.load_bars(spark, _store(spark, d), "H1", FIRST, LAST)


@query("SELECT 'ticks' AS dataset, CAST(4 AS BIGINT) AS n_access, CAST(1 AS BIGINT) AS n_train, CAST(0 AS BIGINT) AS n_validate, CAST(0 AS BIGINT) AS n_optimize, CAST(0 AS BIGINT) AS n_research, CAST(3 AS BIGINT) AS n_test, 'WARNING' AS level")
def access_report(spark, d):
    path = _store(spark, d)
    for purpose in ("test", "train", "test", "test"):
        D.load_bars(spark, path, "D1", purpose=purpose, log=f"{path}-log")
    return D.access_report(spark.read.json(f"{path}-log").withColumn("dataset", F.lit("ticks")))


@query(sql(TRADES, "SELECT symbol, count(*) AS n, avg(ret) AS mean FROM tl GROUP BY symbol", "symbol n", "mean"))
def model_logs(spark, d):
    path = f"{_store(spark, d)}-models"
    D.write_records(T.trades(_positions(spark, d)).select("symbol", "trade_id", "ret"), path)
    return D.model_logs(spark, path, "symbol string, trade_id long, ret double").groupBy("symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


def _calendar(end: str) -> str:
    return sql(TICKS, f"SELECT symbol, CAST({end} AS TIMESTAMP) AS ts, {OHLC} FROM ticks GROUP BY symbol, CAST({end} AS TIMESTAMP)", "symbol ts tick_volume", "open high low close volume")


@query(_calendar("CAST(ts AS DATE) + CAST(CASE WHEN isodow(ts) >= 5 THEN 8 - isodow(ts) ELSE 1 END AS INT)"))
def business_day_bars(spark, d):
    return B.calendar_bars(D.events_ticks(spark, d), "D1")


@query(_calendar("CAST(ts AS DATE) + CAST((4 - isodow(ts) + 7) % 7 + 1 AS INT)"))
def friday_week_bars(spark, d):
    return B.calendar_bars(D.events_ticks(spark, d), "W1")


@query(_calendar("date_trunc('month', ts) + INTERVAL 1 MONTH"))
def month_bars(spark, d):
    return B.calendar_bars(D.events_ticks(spark, d), "MN1")


# feature matrices

C5 = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
FRACTALS = f"""{BARS}, f0 AS (SELECT *, CASE WHEN count(*) {C5} = 5 AND high = max(high) {C5} THEN 1 ELSE 0 END AS up, CASE WHEN count(*) {C5} = 5 AND low = min(low) {C5} THEN 1 ELSE 0 END AS down, avg(high) {C5} AS mh, avg(low) {C5} AS ml FROM bars),
f1 AS (SELECT *, CASE WHEN up = 1 THEN high / mh - 1 ELSE 0 END AS up_strength, CASE WHEN down = 1 THEN 1 - low / ml ELSE 0 END AS down_strength, CASE WHEN close > lag(high, 2) {W} AND lag(down, 2) {W} = 1 THEN 1 ELSE 0 END AS break_up, CASE WHEN close < lag(low, 2) {W} AND lag(up, 2) {W} = 1 THEN 1 ELSE 0 END AS break_down FROM f0),
f2 AS (SELECT *, (up = 1 AND up_strength > 0.001)::INT AS valid_up, (down = 1 AND down_strength > 0.001)::INT AS valid_down FROM f1),
hi AS (SELECT symbol, bar_idx, max(high) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS level FROM f2 WHERE valid_up = 1), lo AS (SELECT symbol, bar_idx, min(low) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS level FROM f2 WHERE valid_down = 1),
f3 AS (SELECT f2.*, hi.level AS resistance, lo.level AS support FROM f2 ASOF LEFT JOIN hi ON hi.symbol = f2.symbol AND hi.bar_idx <= f2.bar_idx ASOF LEFT JOIN lo ON lo.symbol = f2.symbol AND lo.bar_idx <= f2.bar_idx),
f4 AS (SELECT *, ({roll('break_up + break_down', 20, 'sum')}) / 20 AS density, sign({roll('break_up - break_down', 20, 'sum')})::DOUBLE AS direction, close / ({roll('close', 20)}) - 1 AS ma_ratio, sqrt({roll('ln(high / low) ** 2 / (4 * ln(2))', 20)}) AS vol FROM f3),
f5 AS (SELECT *, coalesce(break_up = 1 AND direction >= 0, FALSE)::INT AS buy, coalesce(break_down = 1 AND direction <= 0, FALSE)::INT AS sell FROM f4)"""


@query(sql(FRACTALS, f"SELECT *, (resistance - (high + low) / 2) / ((high + low) / 2) AS to_resistance, ((high + low) / 2 - support) / ((high + low) / 2) AS to_support, least(greatest(CASE WHEN sell = 1 THEN lag(up_strength, 2) {W} / (vol + 1e-8) WHEN buy = 1 THEN lag(down_strength, 2) {W} / (vol + 1e-8) ELSE 0 END, 0), 1) AS strength FROM f5", "symbol ts up down valid_up valid_down break_up break_down buy sell", "up_strength down_strength resistance support to_resistance to_support density direction ma_ratio strength"))
def fractal_matrix(spark, d):
    return A.fractal_matrix(D.daily_bars(spark, d)).select("symbol", "ts", "up", "down", "valid_up", "valid_down", "break_up", "break_down", "buy", "sell", "up_strength", "down_strength", "resistance", "support", "to_resistance", "to_support", "density", "direction", "ma_ratio", "strength")


FLAGS = {
    "session_sydney": "(h >= 21 OR h < 6)", "session_tokyo": "(h < 9)", "session_london": "(h >= 7 AND h < 16)", "session_new_york": "(h >= 13 AND h < 22)",
    "friday_close": "(isodow(ts) = 5 AND h >= 20)", "sunday_open": "(isodow(ts) = 7 AND h >= 21)", "month_end": "(day(ts) >= 28)", "quarter_end": "(month(ts) % 3 = 0 AND day(ts) >= 28)",
}
OVERLAP = " + ".join(f"{v}::INT" for k, v in FLAGS.items() if k.startswith("session_"))
CYCLES = {f"{f}_{k}_h{n}": f"{f}(2 * pi() * {n} * {x})" for k, x in (("hour", "hour(ts) / 24"), ("dow", "(isodow(ts) - 1) / 7"), ("doy", "dayofyear(ts) / 366")) for n in (1, 2, 3) for f in ("sin", "cos")}


def _now(flag: str) -> str:
    return f"CASE WHEN {flag} = 1 THEN {{'v': stddev_samp(r) OVER (PARTITION BY symbol, {flag} ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)}} END AS {flag}_now"


TIMES = f"""{CLOSES}, t0 AS (SELECT *, hour(ts) AS h, ln(close) - lag(ln(close)) {W} AS r, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) {W} AS bar_duration FROM closes),
t1 AS (SELECT *, bar_duration - lag(bar_duration) {W} AS bar_duration_change, {', '.join(f'{v}::INT AS {k}' for k, v in FLAGS.items())}, (({OVERLAP}) > 1)::INT AS overlap, {', '.join(f'{v} AS {k}' for k, v in CYCLES.items())} FROM t0),
t2 AS (SELECT *, {', '.join(_now(k) for k in [*FLAGS, 'overlap'])} FROM t1)"""


@query(sql(TIMES, f"SELECT *, {', '.join(f'(last_value({k}_now IGNORE NULLS) {W}).v AS {k}_vol' for k in [*FLAGS, 'overlap'])} FROM t2", " ".join(["symbol", "ts", "bar_idx", *FLAGS, "overlap"]), " ".join(["bar_duration", "bar_duration_change", *CYCLES, *(f"{k}_vol" for k in [*FLAGS, "overlap"])])))
def time_matrix(spark, d):
    return A.time_matrix(D.events_close(spark, d), 3, durations=True).drop("close")


BAND_COLUMNS = "vol ret_1 ret_5_lag_2 ret_10_lag_3 ret_skew ret_kurt autocorr autocorr_1 autocorr_5 pct_b bandwidth true_range rsi atr macd adx stoch_rsi diff_10_20 diff_20_50"
BANDS = f"""{STATE}, ti AS (SELECT d.symbol, d.bar_idx, CASE WHEN d.bar_idx >= 14 AND loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi, CASE WHEN d.bar_idx >= 13 THEN tr END AS atr, line AS macd, CASE WHEN n >= 14 THEN adx END AS adx FROM dx d JOIN sg USING (symbol, bar_idx)),
b0 AS (SELECT *, close / lag(close) {W} - 1 AS r, ln(close / lag(close) {W}) AS lr, ln(high / low) ** 2 / 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS gk, close / lag(close, 5) {W} - 1 AS r5, close / lag(close, 10) {W} - 1 AS r10 FROM bars),
b1 AS (SELECT *, sqrt({roll('gk', 20)}) AS vol, lag(r) {W} AS rb, least(greatest(r, quantile_cont(r, 0.0001) OVER p), quantile_cont(r, 0.9999) OVER p) + 0 * r AS c1, (1 + least(greatest(r5, quantile_cont(r5, 0.0001) OVER p), quantile_cont(r5, 0.9999) OVER p) + 0 * r5) ** 0.2 - 1 AS c5, (1 + least(greatest(r10, quantile_cont(r10, 0.0001) OVER p), quantile_cont(r10, 0.9999) OVER p) + 0 * r10) ** 0.1 - 1 AS c10, {roll('close', 20)} AS mid, {roll('close', 20, 'stddev_pop')} AS dev, {roll('close', 10)} AS m10, {roll('close', 50)} AS m50, {roll('lr', 20, 'skewness')} AS ret_skew, {roll('lr', 20, 'kurtosis')} AS ret_kurt FROM b0 WINDOW p AS (PARTITION BY symbol)),
b2 AS (SELECT b1.*, ti.rsi, ti.atr, ti.macd, ti.adx, CASE WHEN count(rb) OVER w = 19 THEN corr(r, rb) OVER w END AS autocorr FROM b1 JOIN ti USING (symbol, bar_idx) WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)),
b3 AS (SELECT symbol, ts, bar_idx, vol, c1 / nullif(vol, 0) AS ret_1, lag(c5, 10) {W} / nullif(vol, 0) AS ret_5_lag_2, lag(c10, 30) {W} / nullif(vol, 0) AS ret_10_lag_3, ret_skew, ret_kurt, autocorr, lag(autocorr, 1) {W} AS autocorr_1, lag(autocorr, 5) {W} AS autocorr_5, (close - (mid - 2 * dev)) / nullif(4 * dev, 0) AS pct_b, 4 * dev / nullif(mid, 0) AS bandwidth, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS true_range, rsi, atr, macd, adx, 100 * (rsi - ({roll('rsi', 14, 'min')})) / nullif(({roll('rsi', 14, 'max')}) - ({roll('rsi', 14, 'min')}), 0) AS stoch_rsi, (m10 - mid) / nullif(atr, 0) AS diff_10_20, (mid - m50) / nullif(atr, 0) AS diff_20_50, CASE WHEN close >= mid + 2 * dev THEN -1 WHEN close <= mid - 2 * dev THEN 1 ELSE 0 END AS side, lag(m10 - m50) {W} AS before FROM b2),
b4 AS (SELECT symbol, ts, bar_idx, {', '.join(f'lag({c}) {W} AS {c}' for c in [*BAND_COLUMNS.split(), 'side', 'before'])} FROM b3)"""


@query(sql(BANDS, "SELECT * REPLACE (sqrt(true_range) AS true_range) FROM b4 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in [*BAND_COLUMNS.split(), "before"]), "symbol ts bar_idx side", BAND_COLUMNS, recursive=True))
def band_matrix(spark, d):
    return A.band_matrix(D.daily_bars(spark, d), averages=(10, 20, 50)).withColumn("true_range", F.sqrt("true_range")).select("symbol", "ts", "bar_idx", "side", *BAND_COLUMNS.split())


CURRENCY = "roc efficiency slope higher_highs lower_lows vol vol_regime var_5 cvar_5 stress strength with_others"
C50 = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
C20 = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
CURRENCIES = f"""{BARS}, u0 AS (SELECT *, ln(close) - lag(ln(close)) {W} AS ret FROM bars), u1 AS (SELECT *, sum(ret) OVER (PARTITION BY ts) AS all_ret, count(ret) OVER (PARTITION BY ts) AS n_ret FROM u0),
u2 AS (SELECT *, last_value(CASE WHEN n_ret > 1 THEN (all_ret - ret) / (n_ret - 1) END IGNORE NULLS) {W} AS others, {roll('ret', 20, 'stddev_samp')} AS vol, CASE WHEN count(ret) {C50} = 50 THEN quantile_cont(ret, 0.05) {C50} END AS var_5, CASE WHEN count(ret) {C50} = 50 THEN list(ret) {C50} END AS last50, abs(close - lag(close) {W}) AS step, (high > lag(high) {W})::INT AS hh, (low < lag(low) {W})::INT AS ll FROM u1),
u3 AS (SELECT symbol, ts, bar_idx, close / lag(close, 20) {W} - 1 AS roc, abs(close - lag(close, 20) {W}) / nullif({roll('step', 20, 'sum')}, 0) AS efficiency, CASE WHEN count(*) {C20} = 20 THEN regr_slope(close, bar_idx) {C20} END AS slope, {roll('hh', 20, 'sum')} AS higher_highs, {roll('ll', 20, 'sum')} AS lower_lows, vol, vol / nullif({roll('vol', 50)}, 0) AS vol_regime, var_5, list_avg(list_filter(last50, lambda x: x <= var_5)) AS cvar_5, (ret < var_5)::INT AS stress, {roll('ret - others', 20, 'sum')} AS strength, CASE WHEN count(ret + others) {C20} = 20 THEN covar_pop(ret, others) {C20} / nullif((stddev_pop(ret) {C20}) * (stddev_pop(others) {C20}), 0) END AS with_others FROM u2)"""


@query(sql(CURRENCIES, "SELECT symbol, ts, bar_idx, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS {c}" for c in CURRENCY.split()) + " FROM u3", "symbol ts bar_idx", CURRENCY))
def currency_matrix(spark, d):
    return A.currency_matrix(D.daily_bars(spark, d))


# labels and alignment


@query(sql(BARS, """SELECT symbol, ts, bar_idx, window_ AS "window", slope, t_value, r_squared, t1, ret, CASE WHEN abs(t_value) <= 1e-6 THEN 0 ELSE CAST(sign(t_value) AS INT) END AS bin FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY abs(t_value) DESC, window_) AS n FROM (
    SELECT a.symbol, a.ts, a.bar_idx, h.l AS window_, regr_slope(ln(b.close), -b.bar_idx) AS slope, regr_r2(ln(b.close), b.bar_idx) AS r_squared, arg_min(b.ts, b.bar_idx) AS t1, arg_max(b.close, b.bar_idx) / arg_min(b.close, b.bar_idx) - 1 AS ret,
      regr_slope(ln(b.close), -b.bar_idx) / (sqrt(greatest(regr_syy(ln(b.close), b.bar_idx) - regr_sxy(ln(b.close), b.bar_idx) ** 2 / regr_sxx(ln(b.close), b.bar_idx), 0) / (h.l - 2) / regr_sxx(ln(b.close), b.bar_idx)) + 1e-9) AS t_value
    FROM bars a CROSS JOIN (SELECT unnest([5, 6, 7, 8, 9]) AS l) h JOIN bars b ON b.symbol = a.symbol AND b.bar_idx BETWEEN a.bar_idx - h.l + 1 AND a.bar_idx
    WHERE a.bar_idx >= 8 GROUP BY a.symbol, a.ts, a.bar_idx, h.l)) WHERE n = 1""", 'symbol ts bar_idx "window" t1 bin', "slope t_value r_squared ret"))
def trend_scanning_back(spark, d):
    return L.trend_scanning_labels(D.daily_bars(spark, d), (5, 10), ahead=False)


@query(sql(ev(BARS, "bars") + ", cells AS (SELECT symbol, i0, unnest(range(i0, coalesce(i1, last) + 1)) AS bar_idx FROM ev)", "SELECT symbol, avg(1 / c) AS uniqueness FROM (SELECT symbol, count(*) OVER (PARTITION BY symbol, bar_idx) AS c FROM cells) GROUP BY symbol", "symbol", "uniqueness"))
def indicator_uniqueness(spark, d):
    bars = D.daily_bars(spark, d)
    return L.indicator_uniqueness(_events(bars), bars)


@query(sql(CLOSES + ", mk AS (SELECT symbol, ts + INTERVAL 6 HOUR AS ts, bar_idx AS i0 FROM closes), one AS (SELECT symbol, ts, max(bar_idx) AS hi, min(bar_idx) AS lo FROM closes GROUP BY ALL), nb AS (SELECT m.symbol, m.ts, m.i0, a.ts AS a_ts, a.hi, b.ts AS b_ts, b.lo FROM mk m ASOF LEFT JOIN one a ON a.symbol = m.symbol AND a.ts <= m.ts ASOF LEFT JOIN one b ON b.symbol = m.symbol AND b.ts >= m.ts)", "SELECT symbol, ts, i0, CASE WHEN late THEN lo ELSE hi END AS bar_idx, CASE WHEN late THEN b_ts ELSE a_ts END AS bar_ts FROM (SELECT *, coalesce(b_ts - ts <= ts - a_ts, a_ts IS NULL) AS late FROM nb)", "symbol ts i0 bar_idx bar_ts"))
def nearest_bars(spark, d):
    bars = D.events_close(spark, d)
    marks = bars.select("symbol", (F.col("ts") + F.expr("interval 6 hours")).alias("ts"), F.col("bar_idx").alias("i0"))
    return L.nearest(marks, bars)


SIDED = TOUCH.format(ev="ev").replace("p.close / e.p0 - 1 <= -0.5", "(p.close / e.p0 - 1) * (CASE WHEN e.i0 % 3 = 0 THEN -1 ELSE 1 END) <= -0.3").replace("p.close / e.p0 - 1 >= 1.0", "(p.close / e.p0 - 1) * (CASE WHEN e.i0 % 3 = 0 THEN -1 ELSE 1 END) >= 0.6").replace("p.close / h.p0 - 1", "(p.close / h.p0 - 1) * (CASE WHEN h.i0 % 3 = 0 THEN -1 ELSE 1 END)")


def _sided(spark, d):
    bars = D.daily_bars(spark, d)
    events = _events(bars).withColumns({"trgt": F.lit(0.3), "side": F.when(F.col("i0") % 3 == 0, -1).otherwise(1)})
    return L.triple_barrier_events(events, bars, 2.0, 1.0), bars


@query(sql(ev(BARS, "bars") + SIDED, "SELECT symbol, i0, hit_idx, barrier, ret, (ret > 0)::INT AS bin FROM lab", "symbol i0 hit_idx barrier bin", "ret"))
def meta_labels(spark, d):
    touched, bars = _sided(spark, d)
    return L.barrier_labels(touched, bars, meta=True).select("symbol", "i0", "hit_idx", "barrier", "ret", "bin")


@query(sql(ev(BARS, "bars") + SIDED, "SELECT symbol, i0, CASE WHEN ret > 0 AND ret > 2.0 * 0.3::DOUBLE THEN 1 WHEN ret < 0 AND ret < -1.0 * 0.3::DOUBLE THEN -1 ELSE 0 END AS bin FROM lab", "symbol i0 bin"))
def three_way_labels(spark, d):
    touched, bars = _sided(spark, d)
    return L.barrier_labels(touched, bars, levels=(2.0, 1.0)).select("symbol", "i0", "bin")


@query(sql(BETS, "SELECT symbol, i0, prob FROM (SELECT *, 0.3 + (i0 % 61) / 100.0 AS prob FROM ev) WHERE prob > 0.55", "symbol i0", "prob"))
def confident_events(spark, d):
    events = _events(D.daily_bars(spark, d)).withColumn("prob", 0.3 + (F.col("i0") % 61) / 100)
    return L.meta_label_filter(events, F.col("prob"), 0.55).select("symbol", "i0", "prob")


# volatility, microstructure, strategies, bets


QL = " UNION ALL ".join(f"SELECT symbol, '{m}' AS method, avg(ln(vol * vol) + nx / (vol * vol)) AS loss FROM (SELECT symbol, vol, ln(lead(close) {W} / close) ** 2 AS nx FROM (SELECT *, {v} AS vol FROM vb)) WHERE vol > 0 AND nx IS NOT NULL GROUP BY symbol" for m, v in (("parkinson", f"sqrt({roll('ln(high / low) ** 2 / (4 * ln(2))', 20)})"), ("rolling", roll("r", 20, "stddev_samp")), ("realised", f"sqrt({roll('r * r', 20, 'sum')})")))


@query(sql(f"{BARS}, vb AS (SELECT *, ln(close / lag(close) {W}) AS r FROM bars)", QL, "symbol method", "loss"))
def volatility_choice(spark, d):
    return R.volatility_choice(D.daily_bars(spark, d), ["parkinson", "rolling", "realised"], 20)


def _bits(codes: str, name: str) -> str:
    return f"(SELECT symbol, bar_id, -sum(n / t * log2(n / t)) AS {name} FROM (SELECT symbol, bar_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY symbol, bar_id) AS t FROM ({codes}) GROUP BY symbol, bar_id, code) GROUP BY symbol, bar_id)"


CODES = RULE + ", qv AS (SELECT symbol, quantile_cont(volume, [0.25, 0.5, 0.75]) AS q FROM tr GROUP BY symbol), rr AS (SELECT symbol, bar_id, floor((x - min(x) OVER (PARTITION BY symbol)) / 0.5) AS code FROM (SELECT symbol, bar_id, price / (price - dp) - 1 AS x FROM tr) WHERE x IS NOT NULL)"


@query(sql(CODES, f"SELECT * FROM {_bits('SELECT symbol, bar_id, tick_rule AS code FROM tr', 'sign_entropy')} JOIN {_bits('SELECT symbol, bar_id, len(list_filter(q, lambda c: c < volume)) AS code FROM tr JOIN qv USING (symbol)', 'size_entropy')} USING (symbol, bar_id) LEFT JOIN {_bits('SELECT * FROM rr', 'return_entropy')} USING (symbol, bar_id)", "symbol bar_id", "sign_entropy size_entropy return_entropy"))
def microstructure_matrix(spark, d):
    return M.microstructure_matrix(_indexed_ticks(spark, d), 4, 0.5).select("symbol", "bar_id", "sign_entropy", "size_entropy", "return_entropy")


@query(sql(TICKS, "SELECT symbol, seq, arg_min(k, row(abs(price - x), k))::INT AS code FROM ticks, (SELECT unnest([1.0, 10.0, 50.0, 200.0]) AS x, unnest([0, 1, 2, 3]) AS k) GROUP BY symbol, seq, price", "symbol seq code"))
def nearest_encoding(spark, d):
    return D.events_ticks(spark, d).select("symbol", "seq", M.nearest_codes(F.col("price"), [1.0, 10.0, 50.0, 200.0]).alias("code"))


@query(sql(BARS, f"SELECT symbol, ts, 'crossover_5_20' AS strategy, side FROM {SIDE} UNION ALL SELECT symbol, ts, 'reversion_20_2', CASE WHEN close >= mid + 2 * dev THEN -1 WHEN close <= mid - 2 * dev THEN 1 ELSE 0 END FROM (SELECT *, {roll('close', 20)} AS mid, {roll('close', 20, 'stddev_pop')} AS dev FROM bars)", "symbol ts strategy side"))
def strategy_sides(spark, d):
    return Y.sides(D.daily_bars(spark, d), [Y.crossover(5, 20), Y.reversion()])


PLACE = f"pb AS (SELECT *, lag(p) {W} AS b, {roll('w', 5)} AS late FROM (SELECT *, (close - (mid - 2 * dev)) / nullif(4 * dev, 0) AS p, 4 * dev / nullif(mid, 0) AS w FROM (SELECT *, {roll('close', 20)} AS mid, {roll('close', 20, 'stddev_pop')} AS dev FROM bars)))"


@query(sql(f"{BARS}, {PLACE}", "SELECT symbol, ts, coalesce(b < 0.2 AND p >= 0.2 AND w > late, FALSE)::INT AS long_entry, coalesce(b > 0.8 AND p <= 0.8, FALSE)::INT AS long_exit, coalesce(b > 0.8 AND p <= 0.8 AND w > late, FALSE)::INT AS short_entry, coalesce(b < 0.2 AND p >= 0.2, FALSE)::INT AS short_exit FROM pb", "symbol ts long_entry long_exit short_entry short_exit"))
def band_signals(spark, d):
    return Y.band_signals(D.daily_bars(spark, d)).select("symbol", "ts", "long_entry", "long_exit", "short_entry", "short_exit")


@query()
def strategy_experiment(spark, d):
    return Y.experiment(D.daily_bars(spark, d), Y.crossover(5, 20), 0.3, 1.0, 1.0, 20).select("symbol", "i0", "barrier", "bin", "net", "equity")


MIX = [-2.0, 3.0, 1.5, 2.5, 0.4]
CDF = f"(0.4 * {norm_cdf_sql('((x + 2.0) / 1.5)')} + 0.6 * {norm_cdf_sql('((x - 3.0) / 2.5)')})"
SWEPT = BETS + ", cs AS (SELECT symbol, ts, n_long - n_short AS c_t FROM (SELECT t.symbol, t.ts, (SELECT count(*) FROM bet b WHERE b.symbol = t.symbol AND side > 0 AND b.t0 <= t.ts AND t.ts < b.t1) AS n_long, (SELECT count(*) FROM bet b WHERE b.symbol = t.symbol AND side < 0 AND b.t0 <= t.ts AND t.ts < b.t1) AS n_short FROM (SELECT DISTINCT symbol, t0 AS ts FROM bet) t))"


@query(sql(SWEPT, f"SELECT symbol, ts, c_t, CASE WHEN c_t >= 0 THEN (f - f0) / (1 - f0) ELSE (f - f0) / f0 END AS bet_size FROM (SELECT *, {CDF.replace('(x ', '(c_t ')} AS f, {CDF.replace('(x ', '(0.0 ')} AS f0 FROM cs)", "symbol ts c_t", "bet_size"))
def reserve_sizes(spark, d):
    return S.reserve_sizes(_bets(spark, d), MIX).select("symbol", "ts", "c_t", "bet_size")


@query()
def bet_size_reserve(spark, d):
    return S.reserve_sizes(_bets(spark, d)).select("symbol", "ts", "c_t", "bet_size")


@query(sql(BARS, "SELECT symbol, ts, sign(x) * abs(x) ** 1.5 AS bet_size, CAST(trunc(sign(x) * abs(x) ** 1.5 * 50) AS INT) AS target FROM (SELECT symbol, ts, (open - close) / high AS x FROM bars)", "symbol ts target", "bet_size"))
def bet_size_power(spark, d):
    rows = D.daily_bars(spark, d).select("symbol", "ts", F.lit(50).alias("most"), (F.col("close") / F.col("high")).alias("price"), (F.col("open") / F.col("high")).alias("forecast"))
    return S.power_sizes(rows.withColumns({"forecast": (F.col("forecast") - F.col("price")), "price": F.lit(0.0)}), 1.5).select("symbol", "ts", "target", "bet_size")


AVERAGED = f", sg AS (SELECT *, side * {SIGNAL} AS signal FROM bet), av AS (SELECT t.symbol, t.ts, coalesce((SELECT avg(signal) FROM sg WHERE sg.symbol = t.symbol AND sg.t0 <= t.ts AND t.ts < sg.t1), 0) AS signal FROM (SELECT symbol, t0 AS ts FROM sg UNION SELECT symbol, t1 FROM sg) t)"


@query(sql(BETS + AVERAGED, "SELECT symbol, ts, least(greatest(round_even(round(signal, 9) / 0.05, 0) * 0.05, -1), 1) AS size FROM av", "symbol ts", "size"))
def bet_size_averaged(spark, d):
    """The whole chain: signal, average over open bets, steps."""
    a = S.average_active(_bets(spark, d).withColumn("signal", S.signal(F.col("prob"), 2, F.col("side"))))
    return a.select("symbol", "ts", S.discrete(F.round("signal", 9), 0.05).alias("size"))


LONG = BARS + ", vals AS (" + " UNION ALL ".join(f"SELECT symbol, bar_idx, '{k}' AS name, {v} AS v FROM bars" for k, v in (("close", "close"), ("trend", "bar_idx + close / 1e6"), ("volume", "volume"))) + """),
reg AS (SELECT symbol, name, v - x AS dy, x, x - lag(x) OVER (PARTITION BY symbol, name ORDER BY bar_idx) AS z FROM (SELECT *, lag(v) OVER (PARTITION BY symbol, name ORDER BY bar_idx) AS x FROM vals)),
su AS (SELECT symbol, name, count(*) AS n, regr_sxx(x, x) AS xx, regr_sxx(z, z) AS zz, regr_syy(dy, dy) AS yy, regr_sxy(x, z) AS xz, regr_sxy(dy, x) AS xy, regr_sxy(dy, z) AS zy FROM reg WHERE z IS NOT NULL GROUP BY symbol, name),
tt AS (SELECT symbol, name, n, b / sqrt((yy - b * xy - c * zy) / (n - 3) * zz / det) AS t FROM (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS c FROM su))"""


@query(sql(LONG, f"SELECT symbol, name FROM (SELECT *, CASE WHEN t < -18.83 THEN 0 WHEN t > 2.74 THEN 1 WHEN t <= -1.61 THEN {norm_cdf_sql('(' + LOWER_P + ')')} ELSE {norm_cdf_sql('(' + UPPER_P + ')')} END AS p, -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3 AS critical FROM tt) WHERE NOT coalesce(t < critical AND p < 0.05, FALSE)", "symbol name"))
def not_stationary(spark, d):
    bars = D.daily_bars(spark, d)
    return K.not_stationary(bars.withColumn("trend", F.col("bar_idx") + F.col("close") / 1e6), ["close", "trend", "volume"])


@query()
def fracdiff_optimal(spark, d):
    return K.fracdiff_optimal(D.daily_bars(spark, d))


# statistics


@query(sql(BARS, f"SELECT symbol, CAST(round(252 * 86400000000.0 / step) AS BIGINT) AS periods, sqrt(252 * 86400000000.0 / step) AS factor FROM (SELECT a.symbol, CASE WHEN m.n > floor(a.n * 0.7) THEN m.s ELSE a.med END AS step FROM (SELECT symbol, count(*) AS n, quantile_cont(s, 0.5) AS med FROM (SELECT symbol, date_diff('microsecond', lag(ts) {W}, ts) AS s FROM bars) GROUP BY symbol) a JOIN (SELECT symbol, s, n FROM (SELECT symbol, s, count(*) AS n, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, s) AS k FROM (SELECT symbol, date_diff('microsecond', lag(ts) {W}, ts) AS s FROM bars) WHERE s IS NOT NULL GROUP BY symbol, s) WHERE k = 1) m USING (symbol))", "symbol periods", "factor"))
def periods_per_year(spark, d):
    return T.periods_per_year(D.daily_bars(spark, d))


@query(sql(POS + f", nb AS (SELECT *, lag(pos) {W} AS b, max(ts) OVER (PARTITION BY symbol) AS last, avg(ret) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS r0, avg(ret) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS r1 FROM pos)", "SELECT symbol, count(*) AS points, count(*) FILTER (pos <> 0) AS flips, count(*) FILTER (pos = 0) AS flattenings, 1000 * avg(r0) AS mean_before, 1000 * avg(r1) AS mean_after FROM nb WHERE (pos = 0 AND (b <> 0 OR b IS NULL)) OR pos * b < 0 OR ts = last GROUP BY symbol", "symbol points flips flattenings", "mean_before mean_after"))
def trading_behaviour(spark, d):
    b = T.behaviour(_positions(spark, d))
    return b.withColumns({c: 1000 * F.col(c) for c in ("mean_before", "mean_after")})


META = BETS + ", tr AS (SELECT b.symbol, b.side * (q.close / p.close - 1) / 10000 AS ret, b.prob FROM bet b JOIN px p ON p.symbol = b.symbol AND p.ts = b.t0 JOIN px q ON q.symbol = b.symbol AND q.ts = b.t1)"


@query(sql(META, "SELECT symbol, count(*) AS n_primary, count(*) FILTER (prob > 0.6) AS n_meta, 1 - count(*) FILTER (prob > 0.6) / count(*) AS filter_rate, avg((ret > 0)::INT) AS win_primary, avg((ret > 0)::INT) FILTER (prob > 0.6) AS win_meta, 1000 * avg(ret) AS mean_primary, 1000 * avg(ret) FILTER (prob > 0.6) AS mean_meta, exp(sum(ln(1 + ret))) - 1 AS total_primary, exp(sum(ln(1 + ret)) FILTER (prob > 0.6)) - 1 AS total_meta, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe_primary, avg(ret) FILTER (prob > 0.6) / stddev_samp(ret) FILTER (prob > 0.6) * sqrt(252) AS sharpe_meta FROM tr GROUP BY symbol", "symbol n_primary n_meta", "filter_rate win_primary win_meta mean_primary mean_meta total_primary total_meta sharpe_primary sharpe_meta"))
def meta_labels_compared(spark, d):
    bars = D.daily_bars(spark, d)
    at = lambda t, p: bars.select("symbol", F.col("ts").alias(t), F.col("close").alias(p))
    trades = _bets(spark, d).join(at("t0", "p0"), ["symbol", "t0"]).join(at("t1", "p1"), ["symbol", "t1"])
    return T.meta_labels_compared(trades.select("symbol", (F.col("side") * (F.col("p1") / F.col("p0") - 1) / 10000).alias("ret"), "prob"), 0.6).withColumns({c: 1000 * F.col(c) for c in ("mean_primary", "mean_meta")})


@query(sql(MOMENTS, f"SELECT symbol, sr AS sharpe, {norm_cdf_sql(f'((sr - bench) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))')} AS dsr FROM (SELECT *, stddev_pop(sr) OVER () * {BEST_OF_3!r} AS bench FROM mo)", "symbol", "sharpe dsr"))
def deflated_sharpe(spark, d):
    return T.deflated_sharpe(_sharpe_tests(spark, d)).select("symbol", "sharpe", "dsr")


@query(sql("one AS (SELECT 1)", "SELECT event_type AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type", "value n", "share"))
def value_shares(spark, d):
    return T.value_shares(spark.read.parquet(f"{d}/events.parquet").withColumn("event_type", F.col("event_type").cast("string")), "event_type")


@query(sql(TRADES, 'SELECT symbol, trade_id, ret, max(ret) OVER () - ret AS behind FROM tl ORDER BY ret DESC LIMIT 10', "symbol trade_id", "ret behind"))
def runs_compared(spark, d):
    return T.runs_compared(T.trades(_positions(spark, d)).select("symbol", "trade_id", "ret"), "ret", 10)


@query(sql(TICKS, "SELECT symbol, ts FROM (SELECT symbol, ts FROM ticks WHERE volume > 2 INTERSECT SELECT symbol, ts FROM ticks WHERE price > 20) EXCEPT SELECT symbol, ts FROM ticks WHERE seq % 2 = 0", "symbol ts"))
def set_operations(spark, d):
    t = D.events_ticks(spark, d)
    key = lambda c: t.where(c).select("symbol", "ts")
    return key("volume > 2").intersect(key("price > 20")).subtract(key("seq % 2 = 0"))


# learning


def _data(spark, d):
    """Volatility and autocorrelation at each label's start, and whether the price rose by its end."""
    bars = D.daily_bars(spark, d)
    x = X.bollinger(R.rolling_autocorrelation(R.parkinson(bars, 20), 20))
    x = x.select("symbol", F.col("bar_idx").alias("i0"), F.col("ts").alias("t0"), F.col("close").alias("p0"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES))
    ends = bars.select("symbol", F.col("bar_idx").alias("i1"), F.col("close").alias("p1"))
    return _events(bars).drop("t0").where("i1 is not null").join(x, ["symbol", "i0"]).join(ends, ["symbol", "i1"]).select("symbol", "i0", "i1", "t0", (F.col("p1") > F.col("p0")).cast("int").alias("y"), F.lit(1.0).alias("weight"), *FEATURES)


FEATURES = ["vol", "autocorr", "pct_b", "bandwidth"]


@query()
def hyper_fit(spark, d):
    from pyspark.ml.classification import DecisionTreeClassifier

    trees = {f"depth {k}": DecisionTreeClassifier(maxDepth=k, weightCol="weight", seed=1) for k in (2, 4)}
    return N.hyper_fit(_data(spark, d), V.purged_folds(_labels(spark, d), 3), FEATURES, trees)[0]


@query()
def sequential_bagging(spark, d):
    data = _data(spark, d)
    models, drawn = N.fit_bagging(data, FEATURES, 6, 60)
    return N.oob_scores(data, models, drawn, FEATURES)


@query()
def bagging_probabilities(spark, d):
    data = _data(spark, d)
    models, drawn = N.fit_bagging(data, FEATURES, 4, 200, sequential=False)
    return N.bagging_predict(data, models, FEATURES, drawn)
