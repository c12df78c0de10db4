import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import ROWS, frame, passage
from tickloom.llm.common import read, scratch
from tickloom.llm.language_model import op4_language_model, score, train

LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def discounts(counts):
    n = Counter(counts)
    if not all(n[k] for k in (1, 2, 3)):
        return [0, 0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), 0.95 * k) for k in (1, 2, 3))]


def brute(training, texts):
    """The model's formulas over dictionaries."""
    pairs, times = Counter(), Counter()
    for t in training:
        w = split(t)
        times.update(w)
        pairs.update(zip(["<"] + w, w, strict=False))
    follow, before = defaultdict(list), Counter()
    for (a, b), c in pairs.items():
        follow[a].append(c)
        before[b] += 1
    d, e = discounts(pairs.values()), discounts(before.values())
    n, v = sum(times.values()), len(times)
    spare = sum(e[min(c, 3)] for c in before.values())
    out = []
    for t in texts:
        w, base, own = split(t), 0, 0
        for a, b in zip(["<"] + w, w, strict=False):
            base += math.log10((times[b] + 0.5) / (n + 0.5 * (v + 1)))
            low = ((before[b] - e[min(before[b], 3)]) + spare / (v + 1)) / len(pairs)
            if a in follow:
                c = pairs[a, b]
                low = (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in follow[a]) * low) / sum(follow[a])
            own += math.log10(low)
        out.append((len(w), sum(b in times for b in w), n, base, own))
    return out


def close(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("options", [{}, {"segment_tokens": 50, "flush": 100}])
def test_equals_dictionaries(spark, options):
    rows = ROWS + [(100 + k, passage(30 + k, k % 4)) for k in range(30)]
    model = train(frame(spark, rows[:30]), scratch(spark, "lm"), **options)
    got = sorted((tuple(r)[1:] for r in score(frame(spark, rows), model).collect()), key=lambda r: (r[0], r[4]))
    close(got, sorted(brute([t for _, t in rows[:30]], [t for _, t in rows]), key=lambda r: (r[0], r[4])))


def test_probabilities_sum_to_one(spark):
    texts = [passage(25, k) for k in range(12)]
    model = train(frame(spark, list(enumerate(texts))), scratch(spark, "lm"))
    words = sorted({w for t in texts for w in split(t) if w}) + ["never-seen"]
    first = split(texts[0])[0]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame([(k, f"{first} {w}") for k, w in enumerate(words)] + [(-1, first)], "doc_id long, text string"), model).collect()}
    assert model.vocabulary == len(words)  # with the end, without the unseen
    assert 0 < sum(10**x for x in got.values()) < 1.0001


def test_empty_tables(spark):
    model = train(frame(spark, []), scratch(spark, "lm"))
    assert score(frame(spark, []), model).count() == 0
    assert all(math.isfinite(r.score) for r in score(frame(spark), model).collect())


def test_query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").orderBy("doc_id").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in docs]
    got = op4_language_model(spark, sf_dir).orderBy("doc_id").collect()
    assert [r.held_out for r in got] == held
    close([(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], brute([r.text for r, h in zip(docs, held, strict=True) if not h], [r.text for r in docs]))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
