"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, read

_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def scaled(column: pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * component) of each vector as whole doubles; shorter vectors end in zeros."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(sizes.max()) if width is None and len(sizes) else width or 0
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    within = at < width  # what the queries don't have adds nothing
    out[row[within], at[within]] = flat[within]
    return out


def inner(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Whole inner products; beyond what doubles hold exactly, in whole numbers, kept within a long."""
    if not rows.size or not queries.size:
        return np.zeros((len(rows), len(queries)))
    if float(np.abs(rows).max()) * float(np.abs(queries).max()) * rows.shape[1] < _EXACT:
        return rows @ queries.T
    exact = np.array([[int(x) for x in r] for r in rows], object) @ np.array([[int(x) for x in q] for q in queries], object).T
    return np.clip(exact, -_LONG, _LONG)


def _lists(width: int, lists: int) -> list[slice]:
    cuts = np.linspace(0, width, min(lists, max(1, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 8 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = np.flatnonzero(scores >= cut)
        return held[np.lexsort((ids[held], -scores[held]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _chunks(batches, scale: int, width: int, rows: int = 1024):
    for b in batches:
        for first in range(0, b.num_rows, rows):
            part = b.slice(first, rows)
            yield part.column("vec_id").to_numpy(), scaled(part.column("vec"), scale, width)


def _whole(rows: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whole scores of a few rows of each query: those numbered ``at[:, j]`` for query ``j``."""
    if float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1] < _EXACT:
        return np.einsum("nqd,qd->nq", rows[at], queries)
    return np.stack([inner(rows[at[:, j]], queries[j : j + 1])[:, 0].astype(np.float64) for j in range(at.shape[1])], axis=1)


def _gather(query_ids, queries, k: int, lists: int, scale: int, block: int = 256):
    """Phase 1: the vectors that lead one of this task's lists are scored whole, the others not; the best of each query."""

    def run(batches):
        best = np.full((k, len(query_ids)), -np.inf)
        for ids, rows in _chunks(batches, scale, queries.shape[1]):
            n = min(k + 1, len(rows))  # one more: the query's own vector may lead
            for first in range(0, len(query_ids), block):
                own = slice(first, first + block)
                partial = (inner(rows[:, s], queries[own, s]) for s in _lists(queries.shape[1], lists))
                at = np.sort(np.concatenate([np.argpartition(-p.astype(np.float64), n - 1, axis=0)[:n] for p in partial]), axis=0)
                scores = _whole(rows, queries[own], at)
                scores[ids[at] == query_ids[own]] = -np.inf
                scores[1:][at[1:] == at[:-1]] = -np.inf  # leads several lists
                held = np.concatenate([best[:, own], scores])
                best[:, own] = np.partition(held, len(held) - k, axis=0)[-k:]
        yield pa.record_batch([pa.array(query_ids), pa.array([x[np.isfinite(x)].tolist() for x in best.T], pa.list_(pa.float64()))], ["query_id", "scores"])

    return run


def _collect(query_ids, queries, cutoffs, k: int, lists: int, scale: int):
    """Phases 2 and 3: every vector with a share of the cutoff in some list is scored whole."""

    def run(batches):
        held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
        slices = _lists(queries.shape[1], lists)
        for ids, rows in _chunks(batches, scale, queries.shape[1]):
            enough = np.zeros((len(rows), len(query_ids)), bool)
            for s in slices:
                enough |= inner(rows[:, s], queries[:, s]).astype(np.float64) * len(slices) >= cutoffs
            enough &= ids[:, None] != query_ids[None, :]
            for j in np.flatnonzero(enough.any(axis=0)):
                at = np.flatnonzero(enough[:, j])
                scores = inner(rows[at], queries[j : j + 1])[:, 0]
                own = np.concatenate([held[j][0], ids[at]]), np.concatenate([held[j][1], scores.astype(np.int64)])
                top = _best(own[1], own[0], k)
                held[j] = own[0][top], own[1][top]
        n = [len(i) for i, _ in held]
        if sum(n):
            yield pa.record_batch([pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate([i for i, _ in held])), pa.array(np.concatenate([s for _, s in held]))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, lists: int = 4, block: int = 2048, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query``, the ``k`` other rows of highest score.

    Scores are inner products of ``floor(scale * component)``. The components are split into
    ``lists`` ranges, each a list of partial scores. Phase 1 gathers each task's leaders in each list
    by partial score and scores only those whole; the ``k``-th best of them is a cutoff that no better result can lie under.
    Phase 2 takes, in each task, the rows whose partial score reaches ``cutoff / lists`` in some list:
    a row that reaches it in none has a sum under the cutoff. Phase 3 scores those whole.

    Queries go in blocks of ``block`` (that many vectors are what is broadcast), each against all rows.
    Ties go to the smaller id; null ids, null vectors and those with a null or non-finite component
    take no part; a row is no candidate of a query with its own id; shorter vectors count as ending
    in zeros; fewer candidates than ``k`` give all; an empty table gives no rows; scores beyond a
    long are kept at its ends. Rows with one id are candidates each; as a query an id counts once, with
    the smallest of its vectors. Other columns are ignored.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"), is_query.alias("is_query"))
    clean = clean.where("vec_id is not null and vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = clean.select("vec_id", "vec")
    queries = clean.where("is_query").select("vec_id", "vec")
    n = queries.count()
    blocks = -(-n // block)
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).groupBy("vec_id").agg(F.min("vec").alias("vec")).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, matrix = own.column("vec_id").to_numpy(), scaled(pa.concat_arrays(own.column("vec").chunks), scale)
        gathered = rows.mapInArrow(_gather(ids, matrix, k, lists, scale), "query_id long, scores array<double>")
        cut = gathered.select("query_id", F.explode("scores").alias("score")).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("nth") == k).select("query_id", "score")
        cutoff = {r.query_id: r.score for r in cut.collect()}
        least = np.array([cutoff.get(q, -np.inf) for q in ids.tolist()])
        least = np.where(np.abs(least) < _EXACT, least, np.where(np.isinf(least), least, least - 1e-14 * np.nan_to_num(np.abs(least))))  # doubles round there
        part = rows.mapInArrow(_collect(ids, matrix, least, k, lists, scale), "query_id long, vec_id long, score long")
        found = found.unionByName(part if blocks == 1 else materialise(part, "top-k"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
