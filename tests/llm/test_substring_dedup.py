from collections import defaultdict

import pytest

from tests.llm.cases import ROWS, frame, passage
from tickloom.llm.common import read
from tickloom.llm.substring_dedup import op6_substring_dedup, remove_repeats
from tickloom.llm.words import Words, pack_marked, unpack_marked


def brute(rows, size):
    """Every window against every other, row by row; a null id is smaller than any."""
    split = [(i if i is not None else -(1 << 63), (t or "").encode().split()) for i, t in rows]
    first = defaultdict(lambda: 1 << 63)
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first[key], i)
    out = []
    for (i, w), (real, _) in zip(split, rows, strict=True):
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out.append((real, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[3]))


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 4096, "segment_windows": 64}, {"rows": 1, "room": 1, "bucket_bytes": 2048}])
def test_odd_rows(spark, options):
    assert order(remove_repeats(frame(spark), 13, **options).collect()) == order(brute(ROWS, 13))


def test_short_windows_and_within_documents(spark):
    rows = [(i, passage(25, i % 3) + " " + passage(25, i % 3)) for i in range(12)] + [(-4, passage(50, 1))]
    assert order(remove_repeats(frame(spark, rows), 3, bucket_bytes=500).collect()) == order(brute(rows, 3))
    assert remove_repeats(frame(spark, []), 3).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    want = sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 13))
    assert sorted(map(tuple, op6_substring_dedup(spark, sf_dir).collect())) == want


def test_marked_values_round_trip():
    import numpy as np

    values = np.unique(np.concatenate([np.random.default_rng(1).integers(0, 1 << 40, 500), np.arange(300), [1 << 62]])).astype(np.uint64)
    marks = values % 3 == 0
    got, seen = unpack_marked(pack_marked(values, marks))
    assert (got == values).all() and (seen == marks).all()


def test_words_are_split_like_bytes():
    import pyarrow as pa

    texts = [None, "", " a b", "ç\x0bd\x1ce \xa0f", "x" * 600_000 + " y"]
    w = Words(pa.array(texts).slice(1))
    got = [[w.text(k) for k in range(a, b)] for a, b in zip(w.rows, w.rows[1:])]
    assert got == [t.encode().split() for t in texts[1:]]
    assert len(set(w.hashes().tolist())) == len({w.text(k) for k in range(len(w))})
