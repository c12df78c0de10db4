"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, materialise

#: Links that a round writes to one file. Each file costs a local file system a process of its own, so
#: a round writes as few as its links fill, however many partitions a shuffle has.
FILE_LINKS = 1 << 18


def filled(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` small rows at most, in no more partitions than they fill; only the last step's tasks become fewer."""
    return df.coalesce(max(1, -(-rows // FILE_LINKS)))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (larger ones: ``large``; else smaller ones and itself) to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: the smallest node it is linked with, over any number of links.

    Alternates large and small stars until nothing changes: rounds grow with the logarithm of the
    longest chain, and rows never exceed the links. Each round is written to the shared folder.
    ``links`` are counted first, so they had better be stored.
    """
    rows, state = links.count(), None
    edges = materialise(filled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows), "edges")
    while True:
        before, edges = edges, materialise(filled(_star(_star(edges, True), False), rows), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        rows, state = now[0], now
    roots = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), "v").distinct())
    return filled(roots.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), 2 * now[0])
