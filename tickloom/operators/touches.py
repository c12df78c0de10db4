"""The first bar of a span whose return reaches a level, searched block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tickloom.keys import IDX, SYMBOL

BLOCK, CHUNK = 32_768, 128


def _column(table: pa.Table, name: str, kind=np.float64) -> np.ndarray:
    return table.column(name).to_numpy().astype(kind)


class _Events:
    """Returns of events, from ``p0``, against their levels."""

    def __init__(self, table: pa.Table, p0: np.ndarray):
        self.p0, self.side, self.up, self.down = p0, _column(table, "side"), _column(table, "up"), _column(table, "down")

    def reached(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether one of the prices from ``low`` to ``high`` reaches the upper or the lower level; a return is monotone in the price, rounded or not."""
        with np.errstate(all="ignore"):
            a, b = ((x / self.p0[rows] - 1) * self.side[rows] for x in (low, high))
            return np.fmax(a, b) >= self.up[rows], np.fmin(a, b) <= self.down[rows]

    def scan(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each of ``rows`` the first position from ``at`` to ``stop`` that reaches a level, or -1."""
        out = np.full(len(rows), -1)
        live = np.flatnonzero(at <= stop)
        k = at[live]
        while len(live):
            up, down = self.reached(rows[live], low[k], high[k])
            hit = up | down
            out[live[hit]] = k[hit]
            keep = ~hit & (k < stop[live])
            live, k = live[keep], k[keep] + 1
        return out

    def search(self, price: np.ndarray, rows: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The same in a block of prices: to the end of a chunk, over later chunks by their extremes, then inside one."""
        chunks = price.reshape(-1, CHUNK)
        low, high = np.fmin.reduce(chunks, axis=1), np.fmax.reduce(chunks, axis=1)
        out = self.scan(price, price, rows, at, np.minimum(stop, at // CHUNK * CHUNK + CHUNK - 1))
        more = np.flatnonzero((out < 0) & (at <= stop))
        c = self.scan(low, high, rows[more], at[more] // CHUNK + 1, stop[more] // CHUNK)
        more, c = more[c >= 0], c[c >= 0]
        out[more] = self.scan(price, price, rows[more], c * CHUNK, np.minimum(stop[more], c * CHUNK + CHUNK - 1))
        return out


def _prices(table: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prices of a block by position, and lowest and highest price of the blocks after it."""
    later = _column(table, "later", bool)
    at, low, high = _column(table, "at", np.int64), _column(table, "low"), _column(table, "high")
    price = np.full(BLOCK, np.nan)
    price[at[~later] - first] = low[~later]
    order = np.flatnonzero(later)[np.argsort(at[later], kind="stable")]
    return price, at[order], low[order], high[order]


def _with(table: pa.Table, touch: np.ndarray, falls: np.ndarray, p0: np.ndarray, block: np.ndarray, todo: np.ndarray) -> pa.Table:
    names = ("touch_idx", "falls", "p0", "_block", "_todo")
    values = (pa.array(touch, pa.int64(), mask=touch < 0), pa.array(falls, pa.bool_()), pa.array(p0, pa.float64(), mask=np.isnan(p0)), pa.array(block, pa.int64()), pa.array(todo, pa.bool_()))
    out = table.drop_columns([n for n in names if n in table.column_names])
    for n, v in zip(names, values, strict=True):
        out = out.append_column(n, v)
    return out


def _own_block(key, events: pa.Table, bars: pa.Table) -> pa.Table:
    """Touches in the block that an event starts in; otherwise the first later block that has one."""
    block = key[1].as_py()
    first = block * BLOCK
    price, blocks, low, high = _prices(bars, first)
    i0, end = _column(events, "i0", np.int64) - first, _column(events, "end", np.int64) - first
    p0 = price[i0]
    e, rows = _Events(events, p0), np.arange(len(i0))
    touch = e.search(price, rows, i0 + 1, np.minimum(end, BLOCK - 1))
    falls = np.zeros(len(i0), bool)
    hit = np.flatnonzero(touch >= 0)
    falls[hit] = e.reached(hit, price[touch[hit]], price[touch[hit]])[1]
    last = np.searchsorted(blocks, (end + first) // BLOCK, side="right") - 1
    more = np.flatnonzero((touch < 0) & (last >= 0))
    k = e.scan(low, high, more, np.zeros(len(more), np.int64), last[more])
    more, k = more[k >= 0], k[k >= 0]
    at, todo = np.full(len(i0), block), np.zeros(len(i0), bool)
    at[more], todo[more] = blocks[k], True
    return _with(events, np.where(touch >= 0, touch + first, -1), falls, p0, at, todo)


def _later_block(key, events: pa.Table, bars: pa.Table) -> pa.Table:
    block = key[1].as_py()
    first = block * BLOCK
    price = _prices(bars, first)[0]
    p0, todo = _column(events, "p0"), _column(events, "_todo", bool)
    touch, falls = events.column("touch_idx").fill_null(-1).to_numpy().copy(), _column(events, "falls", bool)
    e, rows = _Events(events, p0), np.flatnonzero(todo)
    found = e.search(price, rows, np.zeros(len(rows), np.int64), np.minimum(_column(events, "end", np.int64)[rows] - first, BLOCK - 1))
    rows, found = rows[found >= 0], found[found >= 0]
    touch[rows], falls[rows] = found + first, e.reached(rows, price[found], price[found])[1]
    return _with(events, touch, falls, p0, np.full(len(touch), block), np.zeros(len(touch), bool))


def first_touches(events: DataFrame, bars: DataFrame) -> DataFrame:
    """``events(symbol, i0, end, side, up, down, ...)`` with the first bar after ``i0``, up to ``end``, whose sided return is ``up`` or more or ``down`` or less.

    A null ``end`` is the end of the series, a null level is off. Adds ``touch_idx`` (null if there is
    none), ``falls`` (it reached ``down``) and ``p0``. Events and bars meet in blocks of positions, once
    where an event starts and once where its touch lies; which block that is comes from lowest and
    highest prices, a row for each pair of blocks of a symbol. So spans may have any length.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    p = bars.select(F.col(SYMBOL).alias(SYMBOL), block(IDX).alias("_block"), F.col(IDX).cast("long").alias("at"), F.col("close").cast("double").alias("low"), F.col("close").cast("double").alias("high"), F.lit(False).alias("later"))
    of = p.groupBy(SYMBOL, "_block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = of.select(SYMBOL, "_block").join(of.withColumnRenamed("_block", "at"), SYMBOL).where("at > _block").select(SYMBOL, "_block", "at", "low", "high", F.lit(True).alias("later"))
    points = p.unionByName(pairs).groupBy(SYMBOL, "_block")
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    d = events.withColumns({"i0": F.col("i0").cast("long"), "end": F.coalesce(F.col("end").cast("long"), F.lit(1 << 60)), "side": double("side"), "up": double("up"), "down": double("down"), "_block": block("i0")})
    kept = [f for f in d.schema.fields if f.name != "_block"]
    schema = StructType([*kept, StructField("touch_idx", LongType()), StructField("falls", BooleanType()), StructField("p0", DoubleType()), StructField("_block", LongType()), StructField("_todo", BooleanType())])
    found = d.groupBy(SYMBOL, "_block").cogroup(points).applyInArrow(_own_block, schema)
    return found.groupBy(SYMBOL, "_block").cogroup(points).applyInArrow(_later_block, schema).drop("_block", "_todo", "end", "up", "down")
