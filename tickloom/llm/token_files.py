"""Token ids in Arrow files of equal-length sequences with masks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, give_back, materialise, read, scratch, shuffle_partitions, text_column
from tickloom.llm.encoding import encoder

#: Text that a file holds about.
FILE_BYTES = 256 << 20
INDEX = "file string, doc_id long, first long, n_tokens long"


def _open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes a stream of ids as rows of ``length`` ids, ``rows`` rows to a record batch.

    Every batch but the last has the same shape, so that id ``i`` lies in batch
    ``i // (rows * length)`` at a known place; the last row is filled up with zeros that the mask
    marks as none. Ids take 16 bits where ``largest`` allows it. The file appears under its name
    only once it is whole: a task that is run again replaces it by the same content.
    """

    def __init__(self, uri: str, length: int, rows: int, largest: int, attempt: int):
        self.fs, self.path = _open_fs(uri)
        self.part = f"{self.path}.attempt-{attempt}"
        self.length, self.rows = length, rows
        self.kind = np.uint16 if largest < 1 << 16 else np.uint32
        self.schema = pa.schema([("tokens", pa.list_(pa.field("item", pa.from_numpy_dtype(self.kind), False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.sink = self.fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        step = self.length * self.rows
        if self.n_held >= step:
            joined = np.concatenate(self.held)
            whole = len(joined) // step * step
            for k in range(0, whole, step):
                self._batch(joined[k : k + step], step)
            self.held, self.n_held = [joined[whole:]], len(joined) - whole

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field("tokens").type)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < valid), type=self.schema.field("mask").type)
        self.writer.write_batch(pa.record_batch([tokens, mask], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            rest = np.concatenate(self.held)
            self._batch(np.concatenate([rest, np.zeros(-len(rest) % self.length, self.kind)]), len(rest))
        self.writer.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


class SequenceReader:
    """Random access to a file of :class:`SequenceWriter`; on a local or mounted disk, without copying."""

    def __init__(self, uri: str):
        fs, path = _open_fs(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("tokens").type.list_size
        first = self.file.get_batch(0) if self.file.num_record_batches else None
        self.step = first.num_rows * self.length if first is not None else 1
        self.at, self.now = -1, None

    def _tokens(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.now = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.now

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids ``first:first + n``, one for each record batch they lie in."""
        while n > 0:
            k, at = divmod(first, self.step)
            view = self._tokens(k)[at : at + n]
            yield view
            first, n = first + len(view), n - len(view)

    def mask_bits(self, i: int) -> tuple[np.ndarray, int]:
        """The mask of row ``i`` as it lies in the file: a view of its bytes, and the bit of the first that it begins at."""
        k, at = divmod(i * self.length, self.step)
        bits = self.file.get_batch(k).column(1).values
        first = bits.offset + at
        return np.frombuffer(bits.buffers()[1], np.uint8)[first // 8 : -(-(first + self.length) // 8)], first % 8

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of row ``i``, a view, and its mask, of which only the row's own bits are unpacked."""
        k, at = divmod(i * self.length, self.step)
        bits, first = self.mask_bits(i)
        return self._tokens(k)[at : at + self.length], np.unpackbits(bits, bitorder="little")[first : first + self.length].astype(bool)


def _writing(folder: str, tokenizer: str, end_id: int, length: int, rows: int):
    def run(batches):
        context = TaskContext.get()
        uri = f"{folder}/part-{context.partitionId():06d}.arrow"
        e = encoder(tokenizer, True)
        largest = max(e.library.get_vocab_size(with_added_tokens=True) - 1, end_id)
        writer, first = None, 0
        for b in cut(batches, "text"):
            if writer is None:
                writer = SequenceWriter(uri, length, rows, largest, context.taskAttemptId())
            sizes = []
            for ids in e.ids(b.column("text").to_pylist()):
                writer.add(np.append(ids, np.uint32(end_id)))
                sizes.append(len(ids) + 1)
            ends = first + np.cumsum(sizes, dtype=np.int64)
            yield pa.record_batch([pa.array([uri] * len(sizes), pa.string()), b.column("doc_id"), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())], ["file", "doc_id", "first", "n_tokens"])
            first = int(ends[-1]) if len(sizes) else first
        if writer is not None:
            writer.close()
        give_back()

    return run


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, length: int = 1024, rows: int = 256) -> DataFrame:
    """Encodes ``docs`` in ascending ``doc_id`` into Arrow files below ``folder``, a URI all workers reach.

    Returns the index, one row a document: ``file, doc_id, first`` (ids before it in the file) and
    ``n_tokens`` (with the end id that follows each document). Files are in the order of their
    names: name by name, their ids are the corpus. Null texts are empty (one end id); null ids come
    first; rows with one id are in the order of a digest of their texts; an empty table makes no
    file; other columns are ignored.
    """
    fs, path = _open_fs(folder)
    fs.create_dir(path, recursive=True)
    text = text_column(docs)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    files = max(shuffle_partitions(docs.sparkSession), -(-total // FILE_BYTES))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialise(ordered.mapInArrow(_writing(folder, tokenizer, end_id, length, rows), INDEX), "token-index")


def file_starts(index: DataFrame) -> dict[str, int]:
    """Ids before each file; one entry a file, and files are as many as partitions."""
    totals = sorted((r["file"], r["n"]) for r in index.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    return dict(zip([f for f, _ in totals], np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))


def read_sequences(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of an index."""
    starts = file_starts(index)

    def run(batches):
        reader, name = None, None
        for b in batches:
            files, firsts, sizes = b.column("file").to_pylist(), b.column("first").to_pylist(), b.column("n_tokens").to_pylist()
            out_start, out_crc = [], []
            for f, first, n in zip(files, firsts, sizes, strict=True):
                if f != name:
                    reader, name = SequenceReader(f), f
                crc = 0
                for view in reader.ids(first, n):
                    crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                out_start.append(starts[f] + first)
                out_crc.append(crc)
            yield pa.record_batch([b.column("doc_id"), pa.array(out_start, pa.int64()), b.column("n_tokens"), pa.array(out_crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    by_file = index.repartition(max(shuffle_partitions(index.sparkSession), len(starts)), "file").sortWithinPartitions("file", "first")
    return by_file.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    index = write_sequences(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-files"))
    return read_sequences(index)
