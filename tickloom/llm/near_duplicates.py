"""Similarity join of word-shingle sets by parity sketches.

The shingles of a set are hashed to bits of a sketch, each the parity of what falls on it: the
sketches of two sets differ in no more bits than the sets differ in shingles. Sizes are banded;
within a band, a sketch of ``d + spare`` blocks (``d``: the most shingles by which linked sets of
the band can differ) has at least ``spare`` blocks in which linked sets agree whole. Sets that agree
on a block's bits meet under that block's key. Blocks without any shingle are no key, since sets
with fewer than ``spare`` of them can't be linked by them alone; sets with more meet under one key.

Where a key joins many sets, they are not paired with each other: all are compared to a central
one, by their whole sketches. Only what remains in several components after that is compared across
components, within the run. So all linked sets lie in one component of pairs that sketches leave
possible. The texts of each such component then meet whole, large components cut into parts, any two
of which are compared in one task; links are verified and counted there, and only counts leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import discard, materialise, pieces, read, text_column
from tickloom.llm.components import components, filled
from tickloom.llm.words import Words, mix, windows

_U = np.uint64


class Bands:
    """Bands of set sizes for a threshold in hundredths; a pair belongs to its smaller set's band."""

    def __init__(self, percent: int, ratio: float = 1.5, largest: int = 1 << 40):
        self.percent = percent
        edges = [1]
        while edges[-1] < largest:
            edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        self.reach = top * 100 // percent  # of the larger set
        self.differ = top * (100 - percent) // percent
        self.spare = 2 + -(-self.differ * 8 // 100)
        self.blocks = np.where(self.differ > 0, self.differ + self.spare, 1)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and bands: each set in its own band and in the lower ones whose sets it may be linked with."""
        own = np.searchsorted(self.edges, sizes, side="right") - 1
        rows, bands = [np.arange(len(sizes))], [own]
        below = own - 1
        while True:
            in_reach = (below >= 0) & (self.reach[np.maximum(below, 0)] >= sizes)
            if not in_reach.any():
                break
            rows.append(np.flatnonzero(in_reach))
            bands.append(below[in_reach])
            below = np.where(in_reach, below - 1, -1)
        return np.concatenate(rows), np.concatenate(bands)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted, one row after the other; and the sets' sizes.

    A row with fewer words than ``width`` has its whole sequence as one shingle; without words, none.
    """
    w = Words(column, lower=True)
    h, n = w.hashes(), np.diff(w.rows)
    count = np.maximum(0, n - width + 1)
    row = np.repeat(np.arange(len(n)), count)
    start = w.rows[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hashes = windows(h, width)[start] if len(row) else np.empty(0, _U)
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            hashes = np.concatenate([hashes, windows(h, k, 200 + k)[w.rows[short]]])
            row = np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(n))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def block_keys(hashes: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets, and the row of each."""
    rows, band = bands.of(sizes)
    useful = sizes[rows] > 0
    rows, band = rows[useful], band[useful]
    starts = np.cumsum(sizes) - sizes
    at = _ragged(starts[rows], sizes[rows])
    member = np.repeat(np.arange(len(rows)), sizes[rows])
    h = mix(hashes[at], 3)
    k = bands.blocks[band]
    block = ((h >> _U(32)) * k[member].astype(_U)) >> _U(32)
    place = (np.cumsum(k) - k)[member] + block.astype(np.int64)
    order = np.argsort(place, kind="stable")
    ordered = place[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    bits = np.bitwise_xor.reduceat(mix(hashes[at][order], 4), first) if len(first) else np.empty(0, _U)
    owner = member[order][first]
    own_block = block[order][first]
    keys = mix(bits ^ mix((band[owner].astype(_U) << _U(48)) | own_block, 5), 6)
    sparse = np.flatnonzero(k - np.bincount(owner, minlength=len(rows)) >= bands.spare[band])
    keys = np.concatenate([keys, mix(band[sparse].astype(_U), 8)])
    return keys, rows[np.concatenate([owner, sparse])]


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Powers of two from the set's size to twice as many, 64 at least, as logarithms."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def folded(hashes: np.ndarray, log_bits: int) -> np.ndarray:
    """A parity sketch of ``2 ** log_bits`` bits."""
    at = mix(hashes, 9) >> _U(64 - log_bits)
    parity = np.bincount(at.astype(np.int64), minlength=1 << log_bits) & 1
    return np.packbits(parity.astype(bool), bitorder="little")


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> bytes:
    """The sketches of several sets, one after the other."""
    starts = np.cumsum(sizes) - sizes
    return b"".join(folded(hashes[at : at + n], k).tobytes() for at, n, k in zip(starts.tolist(), sizes.tolist(), sketch_bits(sizes).tolist(), strict=True))


def halved(sketch: np.ndarray, log_bits: int) -> np.ndarray:
    """A longer sketch as it would have been with ``2 ** log_bits`` bits: neighbours' parities add up."""
    while 8 * sketch.shape[-1] > 1 << log_bits:
        bits = np.unpackbits(sketch, axis=-1, bitorder="little")
        sketch = np.packbits(bits[..., ::2] ^ bits[..., 1::2], axis=-1, bitorder="little")
    return sketch


_ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("row", "<u4")])
RUNS = "members array<long>, uid long, n long, sketch binary"
#: Sets of which the link texts are found by a broadcast; more are joined by a shuffle of the texts.
BROADCAST_SETS = 1_000_000
#: Rows of larger groups that a broadcast takes out; beyond, a shuffle does.
BROADCAST_ROWS = 500_000


def _keyed(width: int, bands: Bands, segment_bits: int, flush: int):
    """Blobs of keys by segment; a key's first bits name the segment, the next 40 are kept."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        keys, uids, held = [], [], 0

        def out():
            key, uid = np.concatenate(keys), np.concatenate(uids)
            for writer in np.unique(uid >> 33):  # ids of one writing task differ in their last 33 bits only
                own = uid >> 33 == writer
                yield blobs(key[own], uid[own])

        def blobs(key, uid):
            order = np.argsort(key)
            key, uid = key[order], uid[order]
            base = int(uid.min())
            segment = (key >> _U(64 - segment_bits)).astype(np.int64) if segment_bits else np.zeros(len(key), np.int64)
            rest = (key << _U(segment_bits)) >> _U(24)
            entries = np.empty(len(key), _ENTRY)
            entries["low"], entries["high"], entries["row"] = rest & _U(0xFFFFFFFF), rest >> _U(32), uid - base
            at = np.searchsorted(segment, np.arange((1 << segment_bits) + 1))
            found = np.flatnonzero(np.diff(at))
            return pa.record_batch([pa.array(found, pa.int64()), pa.array([base] * len(found), pa.int64()), pa.array([entries[at[s] : at[s + 1]].tobytes() for s in found], pa.binary())], ["segment", "base", "blob"])

        for b in batches:
            for part in pieces(b, "text"):
                uid = part.column("uid").to_numpy()
                hashes, sizes = shingle_sets(part.column("text"), width)
                key, row = block_keys(hashes, sizes, bands)
                # sizes and sketches go the same way, under segments below zero
                sized = len(uid).to_bytes(8, "little") + uid.astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + sketches(hashes, sizes)
                at = -1 - int(mix(np.array([uid[0]], _U))[0]) % (64 << segment_bits)
                yield pa.record_batch([pa.array([at], pa.int64()), pa.array([0], pa.int64()), pa.array([sized], pa.binary())], ["segment", "base", "blob"])
                if held > flush:
                    yield from out()
                    keys, uids, held = [], [], 0
                if len(key):
                    keys.append(key)
                    uids.append(uid[row])
                    held += len(key)
        if held:
            yield from out()

    return run


def _runs(longest: int):
    """Sets under each key that has several; long runs are cut into parts, any two of which make a run."""

    def run(key, table):
        if key[0].as_py() < 0:
            uids, sizes, cut = [], [], []
            for x in table.column("blob").to_pylist():
                rows = int.from_bytes(x[:8], "little")
                uids.append(np.frombuffer(x, "<i8", rows, 8))
                sizes.append(np.frombuffer(x, "<i8", rows, 8 + 8 * rows))
                ends = 8 + 16 * rows + np.cumsum(1 << sketch_bits(sizes[-1]) - 3)
                cut += [x[a:b] for a, b in zip([8 + 16 * rows, *ends.tolist()], ends.tolist(), strict=False)]
            return pa.table([pa.nulls(len(cut), pa.list_(pa.int64())), pa.array(np.concatenate(uids)), pa.array(np.concatenate(sizes)), pa.array(cut, pa.binary())], ["members", "uid", "n", "sketch"])
        parts = [np.frombuffer(x, _ENTRY) for x in table.column("blob").to_pylist()]
        uid = np.concatenate([p["row"].astype(np.int64) + b for p, b in zip(parts, table.column("base").to_pylist(), strict=True)])
        rest = np.concatenate([p["low"].astype(_U) | (p["high"].astype(_U) << _U(32)) for p in parts])
        order = np.lexsort((uid, rest))
        rest, uid = rest[order], uid[order]
        same = np.concatenate([[False], (rest[1:] == rest[:-1]) & (uid[1:] == uid[:-1])])
        rest, uid = rest[~same], uid[~same]
        first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        size = np.diff(np.append(first, len(rest)))
        found = dict.fromkeys(uid[a : a + n].tobytes() for a, n in zip(first[size > 1], size[size > 1], strict=True))
        members = []
        for x in found:
            m = np.frombuffer(x, np.int64)
            cut = [m] if len(m) <= longest else np.array_split(m, -(-2 * len(m) // longest))
            members += cut if len(cut) == 1 else [np.concatenate([a, b]) for i, a in enumerate(cut) for b in cut[:i]]
        return pa.table([pa.array([m.tolist() for m in members], pa.list_(pa.int64())), pa.nulls(len(members), pa.int64()), pa.nulls(len(members), pa.int64()), pa.nulls(len(members), pa.binary())], ["members", "uid", "n", "sketch"])

    return run


def _near(percent: int):
    """Keeps pairs whose sketches differ in no more bits than linked sets may differ in shingles."""

    def run(batches):
        for b in batches:
            n = b.column("an").to_numpy() + b.column("bn").to_numpy()
            most = n * (100 - percent) // (100 + percent)
            differ = np.empty(len(n), np.int64)
            for i, (x, y) in enumerate(zip(b.column("asketch").to_pylist(), b.column("bsketch").to_pylist(), strict=True)):
                log_bits = min(len(x), len(y)).bit_length() + 2
                x, y = (halved(np.frombuffer(v, np.uint8), log_bits) for v in (x, y))
                differ[i] = np.bitwise_count(x ^ y).sum(dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(differ <= most))

    return run


def _within(percent: int, most_bytes: int = 16 << 20):
    """Pairs of a run's sets that lie in different components and whose sketches are near."""

    def run(table):
        uid, root, n = (table.column(c).to_numpy() for c in ("uid", "root", "n"))
        raw = table.column("sketch").to_pylist()
        log_bits = min(map(len, raw)).bit_length() + 2
        sketch = np.stack([halved(np.frombuffer(x, np.uint8), log_bits) for x in raw]).view(np.uint64)
        block = max(1, min(256, int((most_bytes / (8 * sketch.shape[1])) ** 0.5)))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(uid), block):
            for start in range(lo, len(uid), block):
                x, y = slice(lo, lo + block), slice(start, start + block)
                most = (n[x, None] + n[None, y]) * (100 - percent) // (100 + percent)
                differ = np.bitwise_count(sketch[x, None, :] ^ sketch[None, y, :]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero((differ <= most) & (root[x, None] != root[None, y]))
                later = i + lo < j + start
                a.append(uid[lo + i[later]])
                b.append(uid[start + j[later]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def counted(hashes: np.ndarray, sizes: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of links of each of some sets to the others (between two sides, only to those of the other side), and the first set each hangs together with."""
    order = np.argsort(sizes, kind="stable")
    at = _ragged((np.cumsum(sizes) - sizes)[order], sizes[order])
    _, ids = np.unique(hashes[at], return_inverse=True)
    n, side = sizes[order], side[order]
    starts = np.cumsum(n) - n
    last = np.searchsorted(n * percent, n * 100, side="right")  # sets up to this one are not too large
    two = bool((side != side[:1]).any())
    links, group = np.zeros(len(n), np.int64), np.arange(len(n))
    mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int8)
    for a in range(len(n)):
        lo, hi = a + 1, int(last[a])
        if lo >= hi or not n[a]:
            continue
        own = ids[starts[a] : starts[a] + n[a]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[starts[lo] : starts[hi - 1] + n[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mark[own] = 0
        near = 100 * both >= percent * (n[a] + n[lo:hi] - both)
        if two:
            near &= side[lo:hi] != side[a]
        links[a] += near.sum()
        links[lo:hi] += near
        for other in set(group[lo:hi][near].tolist()) - {int(group[a])}:
            group[group == other] = group[a]
    out, firsts = np.empty_like(links), np.empty_like(links)
    out[order], firsts[order] = links, order[group]
    return out, firsts


def _counting(width: int, percent: int):
    """Whole sets of one cell against each other: ``uid, n_links, head`` (a set that it hangs together with)."""

    def run(key, table):
        table = table.combine_chunks()
        found = [shingle_sets(part.column("text"), width) for b in table.to_batches() for part in pieces(b, "text")]
        hashes, sizes = (np.concatenate([f[k] for f in found]) for k in range(2))
        links, firsts = counted(hashes, sizes, table.column("part").to_numpy(), percent)
        uid = table.column("uid").to_numpy()
        return pa.table([pa.array(uid), pa.array(links), pa.array(uid[firsts])], ["uid", "n_links", "head"])

    return run


def _digested(batches, names: list[str]):
    """The columns, with ``_content``: SHA-256 of a text's words in lower-case A-Z, joined by one space."""
    for b in batches:
        texts = b.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
        digests = [hashlib.sha256(b" ".join((t or b"").lower().split())).digest() for t in texts]
        yield pa.record_batch([*(b.column(c) for c in names), pa.array(digests, pa.binary())], [*names, "_content"])


def digested(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_content``, which texts of the same words (A-Z in lower case) share; null and empty texts do too."""
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda batches: _digested(batches, names), f"{schema}, _content binary")


class Join:
    """Links and components of the distinct contents of a table with ``doc_id, text``."""

    def __init__(self, docs: DataFrame, width: int, percent: int, longest: int = 4096, segment_keys: int = 1 << 19, flush: int = 2 << 20, cell: int = 2048, cell_bytes: int = 32 << 20):
        self.spark = spark = docs.sparkSession
        self.width, self.percent, self.bands = width, percent, Bands(percent)
        own = digested(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")))
        kinds = own.groupBy("_content").agg(F.min("doc_id").alias("least"), F.first("text").alias("text")).withColumn("bytes", F.octet_length("text").cast("long"))
        self.contents = materialise(kinds.withColumn("uid", F.monotonically_increasing_id()), "contents", "zstd")
        total = self.contents.agg(F.sum("bytes")).first()[0] or 0
        segment_bits = max(0, total // 18 // segment_keys).bit_length()
        blobs = self.contents.select("uid", "text").mapInArrow(_keyed(width, self.bands, segment_bits, flush), "segment long, base long, blob binary")
        runs = materialise(blobs.groupBy("segment").applyInArrow(_runs(longest), RUNS), "runs")
        sketched = runs.where("uid is not null").select("uid", "n", "sketch")
        self.sizes = sketched.select("uid", "n")
        near, roots = self._candidates(runs.where("members is not null").select("members"), sketched)
        self.roots, self.degrees = self._linked(roots, cell, cell_bytes)
        discard(near, roots)

    def _candidates(self, all_runs: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs that sketches leave possible, as many as it takes to bring all linked sets together, and the components they make."""
        held = all_runs.agg(F.sum(F.size("members"))).first()[0] or 0
        runs = materialise(filled(all_runs.distinct(), held).withColumn("run", F.monotonically_increasing_id()), "member-runs")
        members = runs.select("run", F.explode("members").alias("uid"), (F.size("members") - 1).alias("others"))
        central = members.groupBy("uid").agg(F.sum("others").alias("central"))
        # all to the most central of each run
        hubs = members.join(central, "uid").groupBy("run").agg(F.max(F.struct("central", (-F.col("uid")).alias("nuid"))).alias("top")).select("run", (-F.col("top.nuid")).alias("hub"))
        pairs = materialise(filled(members.join(hubs, "run").where("uid <> hub").select(F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b")).distinct(), held), "pairs")
        a, b = (sketched.select(F.col("uid").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}sketch")) for x in "ab")
        near = materialise(pairs.join(a, "a").join(b, "b").select("a", "b", "an", "bn", "asketch", "bsketch").mapInArrow(_near(self.percent), "a long, b long"), "near")
        roots = materialise(components(near), "roots")
        # what still lies in several components, across them
        m = members.select("run", "uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        several = m.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("run")
        left = m.join(several, "run").join(sketched, "uid").select("run", "uid", "root", "n", "sketch")
        more = materialise(left.groupBy("run").applyInArrow(_within(self.percent), "a long, b long").distinct(), "near")
        if not more.isEmpty():
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            whole = materialise(components(known.unionByName(more)), "roots")
            discard(roots)
            roots = whole
        discard(runs, pairs, more)
        return near, roots

    def _linked(self, candidates: DataFrame, cell: int, cell_bytes: int) -> tuple[DataFrame, DataFrame]:
        """``node, root`` and ``uid, n_links`` of contents that have links, from whole sets.

        The texts of a candidate component go to one cell; those of a large one are cut into parts,
        any two of which make a cell, and so does each part alone.
        """
        sized = materialise(candidates.withColumnRenamed("node", "uid").join(self.contents.select("uid", "bytes"), "uid"), "sized")
        of = sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
        parts = F.when((F.col("size") <= cell) & (F.col("bytes") <= cell_bytes), 1).otherwise(F.greatest(F.ceil(2 * F.col("size") / cell), F.ceil(2 * F.col("bytes") / cell_bytes)))
        rows = sized.select("uid", "root").join(of.select("root", parts.cast("int").alias("parts")), "root").withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int"))
        rows = materialise(rows, "parts")
        small = rows.count() <= BROADCAST_SETS
        cells = self.contents.select("uid", "text").join(F.broadcast(rows) if small else rows, "uid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = cells.select("uid", "part", "text", "root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
        counts = materialise(cells.groupBy("root", "x", "y").applyInArrow(_counting(self.width, self.percent), "uid long, n_links long, head long"), "counts")
        degrees = counts.groupBy("uid").agg(F.sum("n_links").alias("n_links")).where("n_links > 0")
        roots = materialise(components(counts.select(F.col("uid").alias("a"), F.col("head").alias("b"))), "roots")
        discard(sized, rows)
        return roots, degrees

    def groups(self) -> DataFrame:
        """``_content, n_shingles, root`` of each distinct content; contents of one component have one root."""
        kinds = self.contents.select("uid", "_content").join(self.sizes.withColumnRenamed("n", "n_shingles"), "uid")
        kinds = kinds.join(self.roots.withColumnRenamed("node", "uid"), "uid", "left")
        return materialise(kinds.select("_content", "n_shingles", F.coalesce("root", "uid").alias("root")), "groups")

    def classes(self) -> DataFrame:
        """``_content, n_shingles, component_id, n_links`` of each distinct content."""
        kinds = self.contents.select("uid", "_content", "least").join(self.sizes, "uid")
        kinds = kinds.join(self.roots.withColumnRenamed("node", "uid"), "uid", "left").join(self.degrees, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        least = kinds.groupBy("root").agg(F.min("least").alias("component_id"))
        return materialise(kinds.join(least, "root").select("_content", F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for each row of ``docs``.

    Two rows link when ``100 * both >= percent * either`` over their sets of ``width``-word
    shingles (A-Z in lower case). ``component_id`` is the smallest id over any number of links.
    ``n_links`` counts the other contents that a row's is linked with.

    Null texts and texts without words have an empty set, are linked with nothing and are their own
    component; shorter texts than ``width`` have one shingle; very long texts are taken whole. Equal
    contents are one class whatever their number; null ids count in a component only where it has no
    other. An empty table gives no rows; other columns are ignored.
    """
    join = Join(docs, width, percent, **options)
    keys = digested(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))).drop("text")
    found = keys.join(join.classes(), "_content")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "n_links")


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row of ``docs`` of each component: that with the smallest id (nulls last), then by digest of its words, then of the row.

    Rows are told apart by what they hold, never by their ids alone. Rows without words are all
    kept, null texts among them; of rows that are alike in every column one stays; very long texts
    are taken whole; an empty table stays empty; other columns are kept.
    """
    join = Join(docs, width, percent, **options)
    has_words = F.coalesce(docs["text"].rlike(r"[^ \t\n\r\x0B\f]"), F.lit(False))
    keyed = digested(docs.where(has_words)).withColumn("_id", F.col("doc_id").cast("long"))
    rows = digested(docs.where(has_words).select(F.col("doc_id").cast("long").alias("_id"), "text")).groupBy("_content", "_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_content", "n"))
    grouped = rows.join(join.groups().select("_content", "root"), "_content")
    chosen = materialise(grouped.groupBy("root").agg(first.alias("first"), F.sum("n").alias("rows")).select("root", "first", "rows"), "chosen")
    # what goes, and of which several rows are left to choose from; all other rows stay as they are
    odd = grouped.join(chosen.where("rows > 1"), "root").select("_content", "_id", ((F.col("first._content") == F.col("_content")) & F.col("first._id").eqNullSafe(F.col("_id"))).alias("is_first"), "n")
    odd = materialise(odd.where("n > 1 or not is_first").select(F.col("_content").alias("odd_content"), F.col("_id").alias("odd_id"), "is_first"), "odd")
    same = (F.col("_content") == F.col("odd_content")) & F.col("_id").eqNullSafe(F.col("odd_id"))
    firsts = odd.where("is_first")
    if odd.count() <= BROADCAST_ROWS:
        odd = F.broadcast(odd)
    kept = keyed.join(odd, same, "left_anti").select(*docs.columns)
    row = F.struct(*docs.columns)
    one = keyed.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, same, "left_semi").groupBy("_content", "_id").agg(F.min_by(row, F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)).alias("row")).select("row.*")
    return kept.unionByName(one).unionByName(docs.where(~has_words))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=85)
