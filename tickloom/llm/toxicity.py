"""Toxicity scores by a convolutional text classifier, trained in numpy on all labelled rows.

A word's embedding is the sum of rows of one hashed table: those of the word, of its first four and
five bytes and of its last four. Filters of several widths run over the embeddings, the largest
response of each over the text is kept, and a linear layer makes the score. The table starts from
each bucket's log-odds among the training texts, so that few passes are needed.

Labelled rows are dealt into shards by a digest of their ids. In each pass every shard goes on from
the common parameters over all of its rows, text by text as they are read, and the changes of all
shards are then averaged, those of a bucket over the shards that changed it. Shards do not depend on
how rows are partitioned, and sums go in their order: equal tables give equal models.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, give_back, pieces, read, text_column
from tickloom.llm.encoding import forget
from tickloom.llm.words import NO_LETTER, Words, family, mix

# Frequent function words of the languages that thresholds are told apart for.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by have from they",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans au sur pas par plus",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}

BUCKET_BITS, PARTS = 17, 4
GROUPS = [*FUNCTION_WORDS, "other"]
#: Labelled rows that a shard has about; labels beyond the second figure go to the texts by a shuffle.
SHARD_ROWS, LABELS_AT_ONCE = 1 << 14, 8_000_000
#: Parts in which the changes of the shards are summed.
SLICES = 32


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(family(0, True).hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of function words, and the languages that have each (one column each)."""
    found: dict[int, list[int]] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            found.setdefault(_word_hash(w), [0] * len(FUNCTION_WORDS))[k] = 1
    keys = np.array(sorted(found), np.uint64)
    return keys, np.array([found[int(k)] for k in keys], np.int64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word's parts, row bounds, and each row's language as its function words tell."""
    w = Words(column, lower=True, between=NO_LETTER)
    whole = w.hashes()
    first4, last4 = w.affixes(4, 1)
    first5, _ = w.affixes(5, 2)
    buckets = np.stack([whole, first4 ^ np.uint64(1 << 63), first5, last4], axis=1) >> np.uint64(64 - BUCKET_BITS)
    keys, languages = _language_table()
    at = np.minimum(np.searchsorted(keys, whole), len(keys) - 1)
    hits = np.where((keys[at] == whole)[:, None], languages[at], 0)
    sums = np.concatenate([np.zeros((1, hits.shape[1]), np.int64), np.cumsum(hits, axis=0)])
    counts = sums[w.rows[1:]] - sums[w.rows[:-1]]
    group = np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1) if len(counts) else 0, len(FUNCTION_WORDS))
    return buckets.astype(np.int32), w.rows, group


class Model:
    """Parameters, forward pass and training."""

    def __init__(self, dims: int = 8, filters: int = 8, widths: tuple[int, ...] = (1, 2, 3), seed: int = 11):
        r = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.table = (0.01 * r.standard_normal((1 << BUCKET_BITS, dims))).astype(np.float32)
        self.kernels = [(0.1 * r.standard_normal((w, dims, filters))).astype(np.float32) for w in widths]
        for k in self.kernels:
            k[:, 0, 0], k[:, 0, 1] = 1 / len(k), -1 / len(k)
        self.bias = np.zeros(len(widths) * filters, np.float32)
        self.out = np.zeros(len(widths) * filters, np.float32)
        self.out[0] = 1
        self.offset = np.float32(0)
        self.thresholds = np.zeros(len(GROUPS), np.float32)

    def start(self, seen: np.ndarray, totals: np.ndarray) -> None:
        """Log-odds of buckets by the number of texts of each class that have them; rare buckets count less."""
        totals = np.maximum(1, totals)
        odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
        both = seen.sum(axis=0)
        self.table[:, 0] += np.where(both > 0, odds * both / (both + 8), 0)
        self.offset = np.float32(-3)

    def _embed(self, x: np.ndarray) -> np.ndarray:
        return self.table[x].sum(axis=1)

    def _responses(self, emb: np.ndarray, k: int) -> np.ndarray:
        """Responses of the filters of one width; row ``i`` is the window that starts at word ``i``."""
        w = self.widths[k]
        n = max(0, len(emb) - w + 1)
        out = emb[:n] @ self.kernels[k][0]
        for j in range(1, w):
            out += emb[j : j + n] @ self.kernels[k][j]
        return out

    def logits(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For many texts at once; a text with fewer words than a width has no response there."""
        n = len(rows) - 1
        pooled = np.zeros((n, len(self.bias)), np.float32)
        emb = self._embed(x)
        sizes = np.diff(rows)
        for k, w in enumerate(self.widths):
            own = slice(k * self.filters, (k + 1) * self.filters)
            has = np.flatnonzero(sizes >= w)
            if len(has):
                z = self._responses(emb, k)
                # between texts: windows that cross an end belong to neither
                cuts = np.stack([rows[has], rows[has + 1] - w + 1], axis=1).reshape(-1)
                best = np.maximum.reduceat(np.concatenate([z, np.full((1, z.shape[1]), -np.inf, np.float32)]), np.minimum(cuts, len(z)))[::2]
                pooled[has, own] = np.maximum(0, best + self.bias[own])
        return pooled @ self.out + self.offset

    def calibrate(self, logits: np.ndarray, groups: np.ndarray, labels: np.ndarray, least: int = 10) -> None:
        """The threshold of each language that is right most often, classes weighing the same; too few rows of a class: that of all."""
        overall = _threshold(logits, labels) if 0 < labels.sum() < len(labels) else 0.0
        for k in range(len(GROUPS)):
            own = groups == k
            enough = min(int(labels[own].sum()), int((labels[own] == 0).sum())) >= least
            self.thresholds[k] = _threshold(logits[own], labels[own]) if enough else overall

    def scores(self, column: pa.Array) -> np.ndarray:
        x, rows, groups = features(column)
        z = self.logits(x, rows) - self.thresholds[groups]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))


class Fitting:
    """A model in training: its parameters in one vector with the sums of squares that steps are divided by."""

    def __init__(self, model: Model, weight: float, rate: float = 0.02, batch: int = 64):
        self.model, self.weight, self.rate, self.batch = model, weight, rate, batch
        self.squares = [np.full_like(p, 1e-3) for p in self._dense()]
        self.table_squares = np.full(len(model.table), 1e-1, np.float32)

    def _dense(self) -> list[np.ndarray]:
        return [*self.model.kernels, self.model.bias, self.model.out]

    def learn(self, docs: list[np.ndarray], labels: list[int], order: np.ndarray) -> None:
        """Steps by the gradients of batches of texts, in ``order``; toxic texts count ``weight`` times."""
        m, dense = self.model, self._dense()
        for first in range(0, len(order), self.batch):
            grads = [np.zeros_like(p) for p in dense]
            rows, steps, shift = [], [], np.float32(0)
            for i in order[first : first + self.batch]:
                emb = m._embed(docs[i])
                pooled, at = np.zeros(len(m.bias), np.float32), np.zeros(len(m.bias), np.int64)
                for k, w in enumerate(m.widths):
                    if len(emb) >= w:
                        own = slice(k * m.filters, (k + 1) * m.filters)
                        z = m._responses(emb, k)
                        at[own] = z.argmax(axis=0)
                        pooled[own] = np.maximum(0, z.max(axis=0) + m.bias[own])
                p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + m.offset, -30, 30)))
                g = np.float32((p - labels[i]) * (self.weight if labels[i] == 1 else 1.0) / self.batch)
                grads[-1] += g * pooled
                back = g * m.out * (pooled > 0)
                grads[-2] += back
                shift += g
                for k, w in enumerate(m.widths):
                    if len(emb) >= w:
                        own = slice(k * m.filters, (k + 1) * m.filters)
                        for j in range(w):
                            words = at[own] + j
                            grads[k][j] += emb[words].T * back[own]
                            rows.append(docs[i][words])
                            steps.append(m.kernels[k][j].T * back[own][:, None])
            for p, g, q in zip(dense, grads, self.squares, strict=True):
                q += g * g
                p -= self.rate * g / np.sqrt(q)
            m.offset = np.float32(m.offset - self.rate * shift)
            if rows:
                where = np.concatenate(rows).reshape(-1)
                what = np.repeat(np.concatenate(steps), PARTS, axis=0)
                np.add.at(self.table_squares, where, (what**2).mean(axis=1))
                np.add.at(m.table, where, -self.rate * what / np.sqrt(self.table_squares[where])[:, None])

    def _state(self) -> list[np.ndarray]:
        return [self.model.table, self.table_squares, *self._dense(), *self.squares, np.array([self.model.offset], np.float32)]

    def vector(self) -> np.ndarray:
        """The table, its sums of squares, and all other values one after the other."""
        return np.concatenate([p.reshape(-1) for p in self._state()])

    def advance(self, changes: np.ndarray, touched: np.ndarray, shards: float) -> None:
        """Adds sums of the changes of shards, divided by the shards that changed a bucket or, for other values, by all."""
        first = 0
        each = np.maximum(1, touched)
        for k, p in enumerate(state := self._state()):
            by = each[:, None] if k == 0 else each if k == 1 else max(1, shards)
            p += (changes[first : first + p.size].reshape(p.shape) / by).astype(np.float32)
            first += p.size
        self.model.offset = state[-1][0]


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    order = np.lexsort((labels, logits))
    z, y = logits[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    false = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    cut = np.flatnonzero((missed + false) == (missed + false).min())
    middle = int(cut[len(cut) // 2])
    low = z[middle - 1] if middle else z[0] - 1
    high = z[middle] if middle < len(z) else z[-1] + 1
    return float((low + high) / 2)


def held_out(doc_id):
    """Whether the id's checksum has remainder 0 by 5; not so for null ids, which no label names."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _chunks(batches: Iterable[pa.RecordBatch], rows: int = 2048, words: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """The texts of each shard in their order, some at a time, as buckets, label, language and whether they are for thresholds."""
    shard, held, n = None, [], 0
    for part in cut(batches, "text", 1 << 20):
        buckets, bounds, group = features(part.column("text"))
        aside = mix(part.column("doc_id").to_numpy().astype(np.uint64), 21) % np.uint64(5) == 0
        for i, (s, toxic) in enumerate(zip(part.column("shard").to_pylist(), part.column("toxic").to_pylist(), strict=True)):
            if held and (s != shard or len(held) >= rows or n >= words):
                yield shard, held
                held, n = [], 0
            shard = s
            held.append((buckets[bounds[i] : bounds[i + 1]].copy(), toxic, int(group[i]), int(aside[i])))
            n += int(bounds[i + 1] - bounds[i])
    if held:
        yield shard, held


def _over_shards(data: DataFrame, work: Callable[[int, Iterator[list]], np.ndarray]) -> np.ndarray:
    """The sum, in the order of the shards, of the vectors that ``work`` makes of the chunks of each; empty without rows."""

    def run(batches):
        forget()
        for shard, chunks in groupby(_chunks(batches), key=lambda c: c[0]):
            for k, part in enumerate(np.array_split(work(shard, (held for _, held in chunks)), SLICES)):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([shard], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["slice", "shard", "part"])
        give_back()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("slice").to_pylist(), b.column("part").to_pylist(), strict=True):
                values = np.frombuffer(part, np.float32)
                if k in sums:
                    sums[k] += values
                else:
                    sums[k] = values.astype(np.float64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "part"])

    parts = data.mapInArrow(run, "slice int, shard int, part binary")
    sums = parts.repartition(SLICES, "slice").sortWithinPartitions("slice", "shard").mapInArrow(add, "slice int, part binary").collect()
    return np.concatenate([np.empty(0), *(np.frombuffer(r.part, np.float64) for r in sorted(sums, key=lambda r: r.slice))])


def _counts(_: int, chunks: Iterator[list]) -> np.ndarray:
    """Texts that have each bucket, and all texts: for training and thresholds, and by label."""
    seen = np.zeros((2, 2, (1 << BUCKET_BITS) + 1), np.float32)
    for held in chunks:
        for x, toxic, _, aside in held:
            seen[aside, toxic, np.append(np.unique(x), -1)] += 1
    return seen.reshape(-1)


def _pass(fitting: Fitting, number: int, keep_aside: bool) -> Callable[[int, Iterator[list]], np.ndarray]:
    def work(shard: int, chunks: Iterator[list]) -> np.ndarray:
        own = copy.deepcopy(fitting)
        before = own.vector()
        for k, held in enumerate(chunks):
            used = [(x, toxic) for x, toxic, _, aside in held if not (keep_aside and aside)]
            if used:
                own.learn(*zip(*used, strict=True), np.random.default_rng([5, number, shard, k]).permutation(len(used)))
        changed = own.vector() - before
        touched = own.table_squares != fitting.table_squares
        return np.concatenate([changed, touched, [changed.any()]])

    return work


def _fitted(data: DataFrame, passes: int = 4) -> Model:
    """A model of all rows of ``shard, doc_id, toxic, text``, which lie together by shard and in order."""
    model = Model()
    model.offset = np.float32(-3)
    found = _over_shards(data, _counts)
    if not len(found):
        return model
    seen, totals = np.split(found.reshape(2, 2, -1), [-1], axis=2)
    if (totals.sum(axis=0) == 0).any():
        return model
    keep_aside = bool((totals > 0).all())
    if not keep_aside:
        seen, totals = seen.sum(axis=0, keepdims=True), totals.sum(axis=0, keepdims=True)
    totals = totals[0, :, 0]
    model.start(seen[0], totals)
    fitting = Fitting(model, float((totals.sum() / (2 * totals[1])) ** 0.5))
    buckets = len(model.table)
    for number in range(passes):
        sums = _over_shards(data, _pass(fitting, number, keep_aside))
        fitting.advance(sums[: -buckets - 1], sums[-buckets - 1 : -1], float(sums[-1]))

    def logits(batches):
        for _, held in _chunks(batches):
            of = [(model.logits(x, np.array([0, len(x)]))[0], group, toxic) for x, toxic, group, aside in held if aside or not keep_aside]
            z, group, toxic = zip(*of, strict=True) if of else ((), (), ())
            yield pa.record_batch([pa.array(z, pa.float32()), pa.array(group, pa.int32()), pa.array(toxic, pa.int32())], ["logit", "language", "toxic"])

    def thresholds(batches):
        z, group, toxic = (np.concatenate(v) for v in zip(*([c.to_numpy() for c in b.columns] for b in batches), strict=True))
        model.calibrate(z, group, toxic)
        yield pa.record_batch([pa.array([model.thresholds.tolist()], pa.list_(pa.float32()))], ["thresholds"])

    scored = data.mapInArrow(logits, "logit float, language int, toxic int")
    model.thresholds = np.array(scored.repartition(1).mapInArrow(thresholds, "thresholds array<float>").first().thresholds, np.float32)
    return model


def _labelled(texts: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """``texts`` that have a label, with it; up to a bound the labels go to the texts, which are not shuffled."""
    if n > LABELS_AT_ONCE:
        return texts.join(own.hint("merge"), "doc_id").select("doc_id", "text", "toxic")
    table = own.toArrow().sort_by("doc_id")
    ids, toxic = table.column("doc_id").to_numpy(), table.column("toxic").to_numpy().astype(np.int8)

    def run(batches):
        forget()
        for b in batches:
            wanted = b.column("doc_id").to_numpy()
            at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            hit = np.flatnonzero(ids[at] == wanted)
            if len(hit):
                kept = b.take(pa.array(hit))
                yield pa.record_batch([*kept.columns, pa.array(toxic[at[hit]].astype(np.int32))], ["doc_id", "text", "toxic"])

    return texts.mapInArrow(run, "doc_id long, text string, toxic int")


def _within(max_words: int):
    """Leaves out, in the order of each shard, texts that would go beyond ``max_words`` there."""

    def run(batches):
        shard, left = None, max_words
        for part in cut(batches, "text"):
            sizes = np.diff(Words(part.column("text"), between=NO_LETTER).rows)
            keep = []
            for s, n in zip(part.column("shard").to_pylist(), sizes.tolist(), strict=True):
                if s != shard:
                    shard, left = s, max_words
                keep.append(n <= left)
                left -= n if n <= left else 0
            yield part.filter(pa.array(keep))

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int | None = None, max_words: int | None = None) -> Model:
    """A model of all labelled rows that are not held out.

    A fifth of them only sets the thresholds; all others are fitted to. Their texts are dealt by shard
    once and lie on disk meanwhile; a task holds the model and some texts. Who wants a quick model may
    name ``max_rows`` (the first by a digest of their ids) and ``max_words`` (in equal parts by shard;
    in that order, a text that would go beyond is left out). Of a repeated id the first text in order
    is taken, and the label that is toxic if any is; null ids and texts of no label take no part.
    Equal tables give equal models. Without a labelled row of each class the model scores every text
    under 0.5.
    """
    own = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if max_rows is not None:
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    n = own.count()
    if not n:
        model = Model()
        model.offset = np.float32(-3)
        return model
    shards = -(-n // SHARD_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    dealt = _labelled(texts, own, n).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    drawn = dealt.groupBy("shard", "doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    data = drawn.sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id")
    if max_words is not None:
        data = data.mapInArrow(_within(max_words // shards), data.schema)
    data = data.persist(StorageLevel.DISK_ONLY)
    try:
        return _fitted(data)
    finally:
        data.unpersist()


def _scoring(model: Model, names: list[str], column: str):
    def run(batches):
        forget()
        for b in batches:
            for part in pieces(b, "text", 1 << 20):
                yield pa.record_batch([*part.columns, pa.array(model.scores(part.column("text")))], [*names, column])
        give_back()

    return run


def toxicity(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score of each whole text from 0 to 1; from 0.5 on it counts as toxic.

    Only the text is looked at; its language is told from its function words. Null and empty texts
    are scored as having no words; very long texts are scored whole; repeated rows score alike; an
    empty table stays empty; a column of the score's name is replaced.
    """
    kept = docs.drop(column)
    names = kept.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{column}` double"
    return kept.mapInArrow(_scoring(model, names, column), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
