"""Packing of documents into sequences: first-fit decreasing with a tournament tree."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, give_back, materialise, read, text_column
from tickloom.llm.encoding import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free room of bins in a complete binary tree whose inner nodes hold the larger child's."""

    def __init__(self, bins: int, capacity: int):
        self.half = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.half)

    def place(self, size: int) -> int:
        """Puts ``size`` into the first bin with room for it; there is one while bins last."""
        room, node = self.room, 1
        while node < self.half:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.half
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and its offset there; equal sizes keep their order."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        k = tree.place(int(sizes[i]))
        bins[i], offsets[i] = k, filled[k]
        filled[k] += sizes[i]
    return bins, offsets


def _encoding(tokenizer: str, end_id: int, capacity: int):
    def run(batches):
        e = encoder(tokenizer, True)
        for b in cut(batches, "text"):
            sizes, sums = [], []
            for ids in e.ids(b.column("text").to_pylist()):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                sizes.append(len(raw))
                sums.append(np.array([zlib.crc32(raw[k : k + capacity].tobytes()) for k in range(0, len(raw), capacity)], "<u4").tobytes())
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.binary())], ["doc_id", "n", "sums"])
        give_back()

    return run


def _packing(capacity: int):
    def run(key, table):
        group = key[0].as_py()
        n = table.column("n").to_numpy()
        bins, offsets = first_fit_decreasing(n % capacity, capacity)
        used = int(bins.max()) + 1
        whole = n // capacity
        count = whole + (n % capacity > 0)
        row = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        full = nth < whole[row]
        own = used + np.cumsum(full) - 1
        sums = np.frombuffer(b"".join(table.column("sums").to_pylist()), "<u4").astype(np.int64)
        yield_columns = [
            table.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(nth * capacity), pa.array(np.where(full, capacity, (n % capacity)[row])), pa.array(sums),
            pa.array(n[row]), pa.array((group << 32) + np.where(full, own, bins[row])), pa.array(np.where(full, 0, offsets[row])),
        ]
        return pa.table(yield_columns, [f.split()[0] for f in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, group_docs: int = 8192, seed: int = 7) -> DataFrame:
    """One row for each piece of each document, with the sequence and the offset it lies at.

    A document's ids (and the end id) are cut at multiples of ``capacity``; whole pieces are
    sequences of their own. The rests are packed by first-fit decreasing within groups of about
    ``group_docs`` documents that are drawn at random, so that groups have like mixtures of
    lengths whatever the order of the input, and one group's size doesn't grow with the corpus.
    Ids are never moved between tasks, only lengths and checksums. Sequence ids are unique, not
    gapless: the group in the high half, the bin in the low half.

    Null texts are empty and take the end id's one place; repeated rows and null ids are packed
    like others; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    sized = materialise(rows.mapInArrow(_encoding(tokenizer, end_id, capacity), "doc_id long, n long, sums binary"), "packing")
    groups = max(1, -(-sized.count() // group_docs))
    dealt = sized.withColumn("group", F.floor(F.rand(seed) * groups).cast("long"))
    return dealt.groupBy("group").applyInArrow(_packing(capacity), PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
