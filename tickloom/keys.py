"""Names, windows and helpers shared by all operators.

Every series is rows of ``(symbol, ts)``, with ``bar_idx`` its dense position where an operator needs
one. Windows are partitioned by symbol, so that one shuffle on the symbol serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SYMBOL, TS, IDX = "symbol", "ts", "bar_idx"


def series(order: str = IDX) -> WindowSpec:
    return Window.partitionBy(SYMBOL).orderBy(order)


def trailing(n: int, order: str = IDX) -> WindowSpec:
    """The last ``n`` rows, the current one included."""
    return series(order).rowsBetween(-(n - 1), 0)


def full(value: Column, agg, n: int, order: str = IDX) -> Column:
    """``agg`` over the last ``n`` rows; null until ``n`` values are there."""
    w = trailing(n, order)
    return F.when(F.count(value).over(w) == n, agg(value).over(w))


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return a / F.nullif(b, F.lit(0.0))


def carried_sign(value: Column, order: str = IDX) -> Column:
    """The sign of a value; zero and null take the last sign before."""
    return F.last(F.nullif(F.signum(value), F.lit(0.0)), ignorenulls=True).over(series(order))


def running_sum(df: DataFrame, value: Column, out: str, order: Iterable[str] = (TS,), grain: str = "day") -> DataFrame:
    """``df`` with the sum of ``value`` over its symbol's rows up to each, in two levels.

    Rows are summed up within a symbol's day (or hour), one task each; what the days before add comes
    from one row a day. So no symbol's whole series has to be in one task.
    """
    d = df.withColumn("_block", F.date_trunc(grain, TS)).withColumn("_value", value)
    totals = d.groupBy(SYMBOL, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(SYMBOL).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(SYMBOL, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    local = F.sum("_value").over(Window.partitionBy(SYMBOL, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, local).join(totals, [SYMBOL, "_block"]).withColumn(out, F.col(out) + F.col("_before")).drop("_block", "_value", "_before")


def with_index(df: DataFrame, order: Iterable[str] = (TS,), grain: str | None = None) -> DataFrame:
    """``bar_idx``: each row's position in its symbol; with a ``grain`` (for ticks) in two levels."""
    if grain:
        d = running_sum(df, F.lit(1), IDX, order, grain)
        return d.withColumn(IDX, (F.col(IDX) - 1).cast("long"))
    return df.withColumn(IDX, (F.row_number().over(Window.partitionBy(SYMBOL).orderBy(*order)) - 1).cast("long"))


def folded(df: DataFrame, step: Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]], schema: str, order: str = IDX) -> DataFrame:
    """Each symbol's rows in order through ``step(rows, state)``, which returns rows and the next state; it begins with None.

    Rows come in batches that Spark has sorted, so that Python never holds a symbol.
    """

    def run(batches):
        at, state = object(), None
        for pdf in batches:
            cuts = [0, *(i for i in (pdf[SYMBOL] != pdf[SYMBOL].shift()).to_numpy().nonzero()[0] if i), len(pdf)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = pdf.iloc[a:b]
                if part[SYMBOL].iloc[0] != at:
                    at, state = part[SYMBOL].iloc[0], None
                out, state = step(part, state)
                yield out

    return df.repartition(SYMBOL).sortWithinPartitions(SYMBOL, order).mapInPandas(run, schema)
