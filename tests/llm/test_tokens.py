import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, frame, passage
from tickloom.llm import packing
from tickloom.llm.common import read, scratch
from tickloom.llm.encoding import Encoder, encoder
from tickloom.llm.packing import Tournament, first_fit_decreasing, op5_packing, pack
from tickloom.llm.token_counts import op1_token_counts, token_counts
from tickloom.llm.token_files import SequenceReader, op3_token_files, read_sequences, write_sequences

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


ODD = st.lists(st.sampled_from([*"aB1é東.'<|>\n\t  \xa0\u2009\x0b\x1c\u200b\u0301\x85", "<|endoftext|>", "don't", "  "]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_encoder_equals_the_library(texts):
    assert [x.tolist() for x in encoder(BYTE, True).ids(texts)] == [ids(BYTE, t) for t in texts]
    assert list(encoder(WORD, False).counts(texts)) == [len(ids(WORD, t)) for t in texts]


@pytest.mark.parametrize("path, spaces_matter", [(BYTE, True), (WORD, False)])
def test_known_pieces_are_looked_up_once(path, spaces_matter):
    e, asked = Encoder(path, spaces_matter), []

    class Counting(type(e.index)):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    e.index = Counting()
    known = passage(200, 3)
    list(e.ids([known]))
    asked.clear()
    texts = [f"{known} unheard{k}of {known} zyx" for k in range(3)]
    assert [x.tolist() for x in e.ids(texts)] == [ids(path, t) for t in texts]
    pieces = sum(len(t.split()) for t in texts)
    assert len(asked) < pieces + 20


@pytest.mark.parametrize("path, spaces_matter", [(BYTE, True), (WORD, False)])
def test_equal_pieces_of_a_group_are_looked_up_once(path, spaces_matter):
    e, asked = Encoder(path, spaces_matter), []

    class Counting(type(e.index)):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    e.index = Counting()
    texts = [passage(200, 3)] * 50
    assert [x.tolist() for x in e.ids(texts)] == [ids(path, t) for t in texts]
    assert len(asked) <= 2 * len(set(texts[0].split())) + 2


def test_letters_and_signs_are_cut_as_the_library_does():
    texts = [t for c in map(chr, range(0x21, 0x370)) for t in (f"a{c} {c}a {c} a{c}. a.{c} {c}{c}a", f"x{c}'s ab{c}!? {c}...", f" {c}1 a\n{c} É{c},")]
    assert [x.tolist() for x in Encoder(BYTE, True).ids(texts)] == [ids(BYTE, t) for t in texts]


def test_a_small_cache_starts_anew():
    texts = [passage(300, k) + f" only{k} here{k}." for k in range(40)]
    e = Encoder(BYTE, True, cache_pieces=50, cache_chars=200)
    assert [x.tolist() for t in texts for x in e.ids([t])] == [ids(BYTE, t) for t in texts]
    assert len(e.index) < 700


def _table(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_counts_and_cache(spark):
    cache = scratch(spark, "cache")
    want = _table((i, len((t or "").encode()), n := len(ids(WORD, t)), n > 2048) for i, t in ROWS)
    assert _table(token_counts(frame(spark), WORD, cache).collect()) == want
    stored = spark.read.parquet(cache).count()
    assert _table(token_counts(frame(spark), WORD, cache).collect()) == want  # nothing is missing now
    assert spark.read.parquet(cache).count() == stored
    assert token_counts(frame(spark, ROWS[:0]), WORD, cache).count() == 0
    more = [(100 + k, f"some {k} more") for k in range(3)]  # a few are missing, most are not
    new = _table((i, len((t or "").encode()), n := len(ids(WORD, t)), n > 2048) for i, t in ROWS + more)
    assert _table(token_counts(frame(spark, ROWS + more), WORD, cache).collect()) == new
    assert spark.read.parquet(cache).count() == stored + 3


def test_counts_query(spark, sf_dir):
    want = _table((r.doc_id, len((r.text or "").encode()), n := len(ids(WORD, r.text)), n > 2048) for r in read(spark, sf_dir, "documents").collect())
    assert _table(op1_token_counts(spark, sf_dir).collect()) == want


def _crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_files_query(spark, sf_dir):
    want, start = [], 0
    for r in sorted(read(spark, sf_dir, "documents").collect(), key=lambda r: r.doc_id):
        x = [*ids(BYTE, r.text), 0]
        want.append((r.doc_id, start, len(x), _crc(x)))
        start += len(x)
    assert _table(op3_token_files(spark, sf_dir).collect()) == _table(want)


def test_files_with_odd_rows(spark):
    folder = scratch(spark, "files")
    index = write_sequences(frame(spark), BYTE, folder, length=16, rows=4)
    got = read_sequences(index).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), _crc(x)) for x in ([*ids(BYTE, t), 0] for _, t in ROWS))
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    one = index.where("first = 0").first()
    tokens, mask = SequenceReader(one.file).sequence(0)
    assert len(tokens) == len(mask) == 16 and tokens.dtype == np.uint16
    assert write_sequences(frame(spark, ROWS[:0]), BYTE, scratch(spark, "files")).count() == 0


def test_sequence_views_do_not_copy(spark):
    folder = scratch(spark, "files")
    index = write_sequences(frame(spark, [(1, passage(3000))]), BYTE, folder, length=64, rows=8)
    before = pa.total_allocated_bytes()
    reader = SequenceReader(index.first().file)
    views = list(reader.ids(0, index.first().n_tokens))
    assert not views[0].flags.owndata and pa.total_allocated_bytes() - before < 4096
    n = index.first().n_tokens
    for i in range(-(-n // 64)):
        tokens, mask = reader.sequence(i)
        bits, first = reader.mask_bits(i)
        assert mask.sum() == min(64, n - 64 * i) and mask[: mask.sum()].all() and not tokens.flags.owndata and not bits.flags.owndata and first < 8


def check_packing(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in rows)
    want = sorted((i is not None, i or 0, k, len(x[k : k + capacity]), _crc(x[k : k + capacity])) for i, t in docs for x in [[*ids(BYTE, t), 0]] for k in range(0, len(x), capacity))
    assert pieces == want
    return sum(r.length for r in rows) / (capacity * len(by_sequence))


def test_packing_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    assert check_packing(op5_packing(spark, sf_dir).collect(), docs, 1024) > 0.97


def test_packing_with_odd_rows(spark):
    check_packing(pack(frame(spark), BYTE, capacity=32, group_docs=5).collect(), ROWS, 32)
    assert pack(frame(spark, ROWS[:0]), BYTE).count() == 0


def test_packing_looks_equal_pieces_up_once(monkeypatch):
    e, asked = Encoder(BYTE, True), []

    class Counting(type(e.index)):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    e.index = Counting()
    monkeypatch.setattr(packing, "encoder", lambda *_: e)
    text = " ".join(f"{w}{s}" for w in ("rain", "fell", "over") for s in ("", ".", ",", "!?")) + " rain" * 2000
    batch = pa.record_batch([pa.array(range(30), pa.int64()), pa.array([text] * 30)], ["doc_id", "text"])
    (got,) = packing._encoding(BYTE, 0, 1024)([batch])
    x = [*ids(BYTE, text), 0]
    want = np.array([_crc(x[k : k + 1024]) for k in range(0, len(x), 1024)], "<u4").tobytes()
    assert got.column("n").to_pylist() == [len(x)] * 30 and got.column("sums").to_pylist() == [want] * 30
    assert len(asked) <= 2 * len(set(text.split())) + 2
    assert "rain" in e.index and "rain." not in e.index  # made of its word and its sign


@pytest.mark.parametrize("seed", range(5))
def test_tournament_is_first_fit(seed):
    sizes = np.random.default_rng(seed).integers(0, 100, 200)
    bins, offsets = first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(100)
        assert bins[i] == k and offsets[i] == 100 - room[k]
        room[k] -= sizes[i]
    assert Tournament(1, 5).place(5) == 0
