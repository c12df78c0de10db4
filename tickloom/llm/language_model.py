"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Words are 48-bit hashes. Each task counts its word pairs and sends them by segments of the first
word's hash; a segment's pairs are added up and written as one file: sorted pair hashes with counts,
sorted first words with their totals and how many words follow them once, twice or more often.
What the segments know of second words (occurrences, distinct words before) is added up the same
way and written as files of sorted word hashes. Workers map the files into memory to score texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import pieces, read, scratch, text_column
from tickloom.llm.words import Words, mix

_U = np.uint64
BITS = 48
BEGIN, END = _U((1 << BITS) - 1), _U((1 << BITS) - 2)  # no word's hash: those are made smaller
OUT = "kind int, segment long, blob binary"
PAIRS, WORDS, SUMS = 0, 1, 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and the row bounds."""
    w = Words(column, lower=True)
    n = np.diff(w.rows)
    bounds = w.rows + np.arange(len(w.rows))
    out = np.full(int(bounds[-1]), END, _U)
    out[np.arange(len(w)) + np.repeat(np.arange(len(n)), n)] = w.hashes() >> _U(64 - BITS)
    inner = out >= END
    inner[bounds[1:] - 1] = False
    out[inner] = _U(1)
    return out, bounds


def _before(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[bounds[:-1]] = BEGIN
    return before


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _ints(values: np.ndarray) -> bytes:
    """Counts: one byte each; from 255 on, eight bytes aside."""
    wide = values[values >= 255]
    return np.minimum(values, 255).astype("u1").tobytes() + wide.astype("<u8").tobytes()


def _get_ints(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, "u1", n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], "<u8").astype(np.int64)
    return out


def _six(values: np.ndarray) -> bytes:
    return (values & _U(0xFFFFFFFF)).astype("<u4").tobytes() + (values >> _U(32)).astype("<u2").tobytes()


def _get_six(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4", n).astype(_U) | (np.frombuffer(raw, "<u2", n, 4 * n).astype(_U) << _U(32))


def _frame(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


def _unframe(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes = np.frombuffer(raw, "<u8", n, 8).astype(np.int64)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _batch(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["kind", "segment", "blob"])


def _count(segment_bits: int, flush: int):
    def run(batches):
        held, n = [], 0

        def out():
            first, second = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            at = _runs(first, second)
            count = np.diff(np.append(at, len(first)))
            first, second = first[at], second[at]
            segment = (first >> _U(BITS - segment_bits)).astype(np.int64)
            cuts = np.append(_runs(segment), len(segment))
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                heads = a + _runs(first[a:b])
                rows.append((int(segment[a]), _frame(_six(first[heads]), np.diff(np.append(heads, b)).astype("<u4").tobytes(), _six(second[a:b]), _ints(count[a:b]))))
            return _batch(PAIRS, rows)

        for b in batches:
            for part in pieces(b, "text"):
                words, bounds = tokens(part.column("text"))
                held.append((_before(words, bounds), words))
                n += len(words)
                if n > flush:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return run


def pair_hash(first: np.ndarray, second: np.ndarray, segment_bits: int) -> np.ndarray:
    """Sorts by segment; within one, mixed from both words."""
    mixed = mix(mix(first, 31) ^ second, 32)
    if not segment_bits:
        return mixed
    return ((first >> _U(BITS - segment_bits)) << _U(64 - segment_bits)) | (mixed >> _U(segment_bits))


def _write(uri: str, *arrays: np.ndarray) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    part = f"{path}.attempt-{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as f:
        f.write(np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], "<u8").tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(bytes(-a.nbytes % 8))
    fs.move(part, path)


def _read(uri: str) -> list[np.ndarray]:
    """The arrays of a file, mapped where the folder is a local or mounted one."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    raw = np.memmap(path, np.uint8, "r") if isinstance(fs, pyarrow.fs.LocalFileSystem) else np.frombuffer(fs.open_input_file(path).read(), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    shape = raw[8 : 8 + 16 * n].view("<u8").astype(np.int64).reshape(-1, 2)
    out, at = [], 8 + 16 * n
    for item, size in shape.tolist():
        out.append(raw[at : at + item * size].view({1: "<u1", 4: "<u4", 8: "<u8"}[item]))
        at += -(-item * size // 8) * 8
    return out


def _of_counts(values: np.ndarray) -> np.ndarray:
    """How many values are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5]


def _sums(*values) -> pa.Table:
    return pa.Table.from_batches([_batch(SUMS, [(0, np.array(values, "<i8").tobytes())])])


def _add_pairs(folder: str, segment_bits: int, word_bits: int):
    def run(key, table):
        segment = key[1].as_py()
        firsts, seconds, counts = [], [], []
        for raw in table.column("blob").to_pylist():
            heads, lengths, second, count = _unframe(raw)
            lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
            n = int(lengths.sum())
            firsts.append(np.repeat(_get_six(heads, len(lengths)), lengths))
            seconds.append(_get_six(second, n))
            counts.append(_get_ints(count, n))
        first, second, count = (np.concatenate(x) for x in (firsts, seconds, counts))
        order = np.lexsort((second, first))
        first, second, count = first[order], second[order], count[order]
        at = _runs(first, second)
        first, second, count = first[at], second[at], np.add.reduceat(count, at)
        heads = _runs(first)
        total = np.add.reduceat(count, heads)
        follow = [np.add.reduceat(x.astype(np.int64), heads) for x in (count == 1, count == 2, count > 2)]
        hashes = pair_hash(first, second, segment_bits)
        order = np.argsort(hashes)
        _write(f"{folder}/pairs-{segment:06d}", hashes[order], count[order].astype("<u4" if int(count.max(initial=0)) < 1 << 32 else "<u8"), first[heads], total.astype("<u8"), *(x.astype("<u4") for x in follow))
        of_counts = _of_counts(count)
        order = np.argsort(second, kind="stable")
        second, count = second[order], count[order]
        at = _runs(second)
        word, before, times = second[at], np.diff(np.append(at, len(second))), np.add.reduceat(count, at)
        of = (word >> _U(BITS - word_bits)).astype(np.int64)
        cuts = np.append(_runs(of), len(of))
        rows = [(int(of[a]), _frame(_six(word[a:b]), _ints(before[a:b]), _ints(times[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.concat_tables([pa.Table.from_batches([_batch(WORDS, rows)]), _sums(PAIRS, segment, 0, 0, 0, *of_counts)])

    return run


def _add_words(folder: str):
    def run(key, table):
        if key[0].as_py() == SUMS:
            return table.select([f.split()[0] for f in OUT.split(", ")])
        segment = key[1].as_py()
        words, befores, counts = [], [], []
        for raw in table.column("blob").to_pylist():
            word, before, count = _unframe(raw)
            words.append(_get_six(word, len(word) // 6))
            befores.append(_get_ints(before, len(words[-1])))
            counts.append(_get_ints(count, len(words[-1])))
        word, before, count = (np.concatenate(x) for x in (words, befores, counts))
        order = np.argsort(word, kind="stable")
        word, before, count = word[order], before[order], count[order]
        at = _runs(word)
        word, before, count = word[at], np.add.reduceat(before, at), np.add.reduceat(count, at)
        _write(f"{folder}/words-{segment:06d}", word, before.astype("<u8"), count.astype("<u8"))
        return _sums(WORDS, segment, len(word), int(count.sum()), int(before.sum()), *_of_counts(before))

    return run


def _discounts(n: np.ndarray) -> np.ndarray:
    """Of counts of 0, 1, 2 and more; a corpus too small to tell gets those of common use."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.05), 0.95 * k) for k, x in enumerate(d, 1))])


class Model:
    """What a worker needs to score texts: the folder, and the corpus's sums."""

    def __init__(self, folder: str, segment_bits: int, word_bits: int, sums: np.ndarray):
        self.folder, self.segment_bits, self.word_bits = folder, segment_bits, word_bits
        pairs, words = sums[sums[:, 0] == PAIRS], sums[sums[:, 0] == WORDS]
        self.pair_files, self.word_files = set(pairs[:, 1].tolist()), set(words[:, 1].tolist())
        self.vocabulary, self.tokens, self.distinct_pairs = (int(words[:, k].sum()) for k in (2, 3, 4))
        self.pair_discounts, self.word_discounts = _discounts(pairs[:, 5:].sum(axis=0)), _discounts(words[:, 5:].sum(axis=0))
        ones, twos = (int(words[:, k].sum()) for k in (5, 6))
        d = self.word_discounts
        self.spare = d[1] * ones + d[2] * twos + d[3] * (self.vocabulary - ones - twos)
        self.files: dict[str, list[np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"files": {}}

    def _file(self, name: str) -> list[np.ndarray]:
        if name not in self.files:
            self.files[name] = _read(f"{self.folder}/{name}")
        return self.files[name]

    def _find(self, kind: str, have: set[int], segments: np.ndarray, keys: np.ndarray, key: int, values: tuple[int, ...]) -> np.ndarray:
        """Values of sorted keys in the files of their segments; 0 where there are none."""
        out = np.zeros((len(values), len(keys)), np.int64)
        cuts = np.append(_runs(segments), len(segments)) if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            segment = int(segments[a])
            if segment not in have:
                continue
            arrays = self._file(f"{kind}-{segment:06d}")
            at = np.minimum(np.searchsorted(arrays[key], keys[a:b]), len(arrays[key]) - 1)
            found = arrays[key][at] == keys[a:b]
            for k, v in enumerate(values):
                out[k, a:b] = np.where(found, arrays[v][at], 0)
        return out

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        """Distinct words before, and occurrences, of sorted words."""
        return self._find("words", self.word_files, (words >> _U(BITS - self.word_bits)).astype(np.int64), words, 0, (1, 2))

    def lower(self, before: np.ndarray) -> np.ndarray:
        """Probability of words by how many distinct words come before them."""
        every = max(1, self.distinct_pairs)
        spare = self.spare if self.vocabulary else 1.0
        return (before - self.word_discounts[np.minimum(before, 3)]) / every * (before > 0) + spare / every / (self.vocabulary + 1) if self.vocabulary else np.ones(len(before))

    def logs(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: log10 of its probability and of the base's, and whether training had it."""
        before = _before(words, bounds)
        own, which = np.unique(words, return_inverse=True)
        n_before, times = self.word_counts(own)
        base = np.log10((times + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))[which]
        lower = self.lower(n_before)[which]
        first, place = np.unique(before, return_inverse=True)
        total, ones, twos, more = self._find("pairs", self.pair_files, (first >> _U(BITS - self.segment_bits)).astype(np.int64), first, 2, (3, 4, 5, 6))
        hashes = pair_hash(before, words, self.segment_bits)
        order = np.argsort(hashes)
        (found,) = self._find("pairs", self.pair_files, (hashes[order] >> _U(63) >> _U(1) if not self.segment_bits else hashes[order] >> _U(64 - self.segment_bits)).astype(np.int64), hashes[order], 0, (1,))
        count = np.empty(len(words), np.int64)
        count[order] = found
        d = self.pair_discounts
        spare = (d[1] * ones + d[2] * twos + d[3] * more)[place]
        of = total[place]
        p = np.where(of > 0, (count - d[np.minimum(count, 3)] + spare * lower) / np.maximum(of, 1), lower)
        return np.log10(p), base, (times > 0)[which]


def train(docs: DataFrame, folder: str, segment_tokens: int = 1 << 20, flush: int = 4 << 20) -> Model:
    """Counts the texts of ``docs`` into files below ``folder``, a URI that all workers reach.

    Every text is counted whole. What comes to the driver is two rows of sums a segment.
    """
    spark = docs.sparkSession
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    text = text_column(docs)
    total = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    segment_bits = max(1, (total // 8 // segment_tokens).bit_length())
    word_bits = max(1, segment_bits - 1)
    counted = docs.select(text.alias("text")).mapInArrow(_count(segment_bits, flush), OUT)
    added = counted.groupBy("kind", "segment").applyInArrow(_add_pairs(folder, segment_bits, word_bits), OUT)
    sums = added.groupBy("kind", "segment").applyInArrow(_add_words(folder), OUT).select("blob").collect()
    # tasks that are run again write the same files and give the same sums
    return Model(folder, segment_bits, word_bits, np.array([np.frombuffer(r.blob, "<i8") for r in sums], np.int64).reshape(-1, 9))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (log10) for each row of ``docs``.

    Null and empty texts have one token, the end. Repeated rows and null ids keep their rows; an
    empty table gives none; a model of no text gives every token the same chance.
    """

    def run(batches):
        for b in batches:
            for part in pieces(b, "text", 2 << 20):
                words, bounds = tokens(part.column("text"))
                own, base, known = model.logs(words, bounds)
                starts = bounds[:-1]
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array([model.tokens] * len(starts), pa.int64()), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts))]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))), scratch(spark, "language-model"))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
