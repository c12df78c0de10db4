"""Removal of repeated passages: a count-min prefilter, then exact grouping.

Texts are dealt once into buckets by document; every later step reads that one exchange again.

1. Each bucket sketches its windows: the cells that they fall into, for each row of one count-min
   sketch of the corpus, with a mark where a cell gets more than one. Sketches travel as sorted
   gaps, by segments of the sketch, and are added up segment by segment. A bucket gets back one bit
   for each of its cells: whether the merged count is two or more. Counts only overestimate, so
   that no repeated window is lost.
2. Each bucket sends 96-bit digests (from two independent hashes of the words) of the windows whose cells are repeated in every row, with the
   smallest document that holds each; digests are grouped exactly, and a bucket gets back one bit
   for each: whether another bucket holds the window in a smaller document.
3. Each bucket drops the words under windows that start in a smaller document.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import pieces, read, shuffle_partitions, text_column
from tickloom.llm.words import Words, distinct, mix, pack_marked, unpack_marked, windows

_U = np.uint64
BLOBS = "bucket int, kind int, segment long, blob binary"
NO_ID = -(1 << 63)


class Plan:
    """Sizes of the sketch, from the bytes of all texts (a bound of the windows, at five bytes each)."""

    def __init__(self, text_bytes: int, size: int, bucket_bytes: int, rows: int, room: int, segment_windows: int, least: int):
        n = max(1, text_bytes // 5)
        self.size, self.rows = size, rows
        self.buckets = max(1, -(-text_bytes // bucket_bytes), min(least, text_bytes >> 20))
        self.cell_bits = max(16, (n * room - 1).bit_length())
        self.segment_bits = min(self.cell_bits - 8, max(0, (n // segment_windows).bit_length()))


class Bucket:
    """The windows of the documents of one bucket, in the order of its rows."""

    def __init__(self, table: pa.Table, plan: Plan):
        self.plan, self.parts, size = plan, [], plan.size
        high, low, doc = [], [], []
        for b in table.to_batches():
            for part in pieces(b, "text"):
                w = Words(part.column("text"))
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                n = np.diff(w.rows)
                row = np.repeat(np.arange(len(n)), np.maximum(0, n - size + 1))
                start = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(0, n - size + 1)) - np.maximum(0, n - size + 1), np.maximum(0, n - size + 1)) + w.rows[row]
                h = w.hashes()
                high.append(windows(h, size)[start])
                low.append((windows(w.hashes(1), size, 1)[start] >> _U(32)).astype(np.uint32))
                doc.append(ids[row])
                self.parts.append((part, w, start))
        self.high = np.concatenate(high) if high else np.empty(0, _U)
        self.low = np.concatenate(low) if low else np.empty(0, np.uint32)
        self.doc = np.concatenate(doc) if doc else np.empty(0, np.int64)

    def cells(self, row: int) -> np.ndarray:
        return mix(self.high, 50 + row) >> _U(64 - self.plan.cell_bits)

    def segments(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segments that hold any of the sorted cells, and where each one's begin."""
        return _runs(cells >> _U(self.plan.cell_bits - self.plan.segment_bits))

    def key_segments(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for digests, which are segmented by their first bits."""
        return _runs(high >> _U(63) >> _U(1) if not self.plan.segment_bits else high >> _U(64 - self.plan.segment_bits))

    def repeated(self, bits: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Positions of the windows whose cells are repeated in each row."""
        kept = np.ones(len(self.high), bool)
        for row in range(self.plan.rows):
            cells = self.cells(row)
            own = distinct(cells)[0]
            found, at = self.segments(own)
            hot = np.concatenate([own[a:b][_bits(bits.get((row, int(s))), b - a)] for s, a, b in zip(found, at, at[1:], strict=False)] or [own[:0]])
            if not len(hot):
                return np.empty(0, np.int64)
            kept &= hot[np.minimum(np.searchsorted(hot, cells), len(hot) - 1)] == cells
        return np.flatnonzero(kept)

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digests of the windows at positions (high and low parts, sorted), the smallest document of each, and which digest each position has."""
        high, low, doc = self.high[at], self.low[at], self.doc[at]
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc[order], first) if len(first) else doc
        return high[first], low[first], least, which


def _runs(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(segments)), bool), segments[1:] != segments[:-1]]))
    return segments[first], np.append(first, len(segments))


def _bits(blob: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n, bool) if blob is None else np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _blobs(bucket: list[int], kind: list[int], segment: list[int], blob: list[bytes]) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(segment, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "kind", "segment", "blob"])


def _given(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return dict(zip(zip(table.column("kind").to_pylist(), table.column("segment").to_pylist(), strict=True), table.column("blob").to_pylist(), strict=True))


def _sketch(plan: Plan):
    def run(key, table):
        bucket = Bucket(table, plan)
        kinds, segments, blobs = [], [], []
        for row in range(plan.rows):
            cells, counts = distinct(bucket.cells(row))
            found, at = bucket.segments(cells)
            for s, a, b in zip(found.tolist(), at, at[1:], strict=False):
                kinds.append(row)
                segments.append(s)
                blobs.append(pack_marked(cells[a:b] - (_U(s) << _U(plan.cell_bits - plan.segment_bits)), counts[a:b] > 1))
        return _blobs([key[0].as_py()] * len(kinds), kinds, segments, blobs)

    return run


def _merge_sketches(key, table):
    parts = [unpack_marked(x) for x in table.column("blob").to_pylist()]
    joined, marks = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(joined, kind="stable")
    values = joined[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    size = np.diff(np.append(first, len(values)))
    flags = np.empty(len(values), bool)
    flags[order] = np.repeat((size > 1) | marks[order][first], size)
    ends = np.cumsum([len(c) for c, _ in parts])
    bits = [np.packbits(flags[e - len(c) : e]).tobytes() for (c, _), e in zip(parts, ends, strict=True)]
    return _blobs(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("segment").to_pylist(), bits)


_KEYS = 100
_ENTRY = np.dtype([("high", "<u8"), ("low", "<u4"), ("doc", "<i8")])
_NARROW = np.dtype([("high", "<u8"), ("low", "<u4"), ("doc", "<u4")])


def _candidates(plan: Plan):
    def run(key, docs, bits):
        bucket = Bucket(docs, plan)
        high, low, least, _ = bucket.keys(bucket.repeated(_given(bits)))
        found, at = bucket.key_segments(high)
        narrow = not len(least) or bool(least.min() >= 0 and least.max() < 1 << 32)
        entries = np.empty(len(high), _NARROW if narrow else _ENTRY)
        entries["high"], entries["low"], entries["doc"] = high, low, least
        blobs = [bytes([narrow]) + entries[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        own = _blobs([key[0].as_py()] * len(blobs), [_KEYS] * len(blobs), found.astype(np.int64).tolist(), blobs)
        return pa.concat_tables([own, bits.select(own.column_names).cast(own.schema)])

    return run


def _group_candidates(key, table):
    """Judges digests; the sketch's bits, which the last step needs too, pass."""
    if key[0].as_py() != _KEYS:
        return table.select([f.split()[0] for f in BLOBS.split(", ")])
    parts = [np.frombuffer(x, _NARROW if x[0] else _ENTRY, offset=1) for x in table.column("blob").to_pylist()]
    high, low, doc = (np.concatenate([p[f] for p in parts]) for f in ("high", "low", "doc"))
    doc = doc.astype(np.int64)
    order = np.lexsort((low, high))
    a, b = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    flags = np.empty(len(order), bool)
    flags[order] = least < doc[order]
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(flags[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]
    return _blobs(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("segment").to_pylist(), bits)


OUT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(plan: Plan):
    def run(key, docs, bits):
        bucket, given = Bucket(docs, plan), _given(bits)
        at = bucket.repeated(given)
        high, _, least, which = bucket.keys(at)
        found, starts = bucket.key_segments(high)
        elsewhere = np.concatenate([_bits(given.get((_KEYS, int(s))), b - a) for s, a, b in zip(found, starts, starts[1:], strict=False)] or [np.empty(0, bool)])
        gone = np.zeros(len(bucket.high), bool)
        gone[at] = elsewhere[which] | (least[which] < bucket.doc[at])
        ids, words, removed, kept, first = [], [], [], [], 0
        for part, w, start in bucket.parts:
            cover = np.zeros(len(w) + 1, np.int64)
            begins = start[gone[first : first + len(start)]]
            first += len(start)
            np.add.at(cover, begins, 1)
            np.add.at(cover, begins + plan.size, -1)
            stays = np.cumsum(cover)[:-1] == 0
            n = np.diff(w.rows)
            left = np.diff(np.concatenate([[0], np.cumsum(stays)])[w.rows])
            for i in range(len(n)):
                split = w.data[w.bounds[i] : w.bounds[i + 1]].tobytes().split()
                kept.append(b" ".join(split if left[i] == n[i] else compress(split, stays[w.rows[i] : w.rows[i + 1]])))
            ids.append(part.column("doc_id"))
            words.append(n)
            removed.append(n - left)
        return pa.table(
            [pa.chunked_array(ids, pa.int64()), pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(np.concatenate(removed) if removed else [], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    return run


def remove_repeats(docs: DataFrame, size: int = 13, bucket_bytes: int = 8 << 20, rows: int = 2, room: int = 4, segment_windows: int = 2 << 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row: the text without words under repeated windows.

    A window is ``size`` consecutive words; it goes where its words also start in a row with a
    smaller ``doc_id``. Windows are judged on the input. ``kept`` joins the words left by one space.
    ``rows`` and ``room`` (cells for each window and row) set how few single windows pass the sketch,
    never whether repeated ones do.

    Null and empty texts have no words; texts shorter than a window stay whole; rows with one id
    don't remove from each other; a null id counts as smaller than any; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_column(docs)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    plan = Plan(total, size, bucket_bytes, rows, room, segment_windows, shuffle_partitions(spark))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(plan.buckets)).cast("int")).repartition(plan.buckets, "bucket")
    sketched = dealt.groupBy("bucket").applyInArrow(_sketch(plan), BLOBS)
    repeated = sketched.groupBy("kind", "segment").applyInArrow(_merge_sketches, BLOBS)
    found = dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(_candidates(plan), BLOBS)
    judged = found.groupBy("kind", "segment").applyInArrow(_group_candidates, BLOBS)
    return dealt.groupBy("bucket").cogroup(judged.groupBy("bucket")).applyInArrow(_remove(plan), OUT)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
