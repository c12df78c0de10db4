import math
import random
import re

from tests.llm.cases import ROWS, WORDS, frame, passage
from tickloom.llm.common import read
from tickloom.llm.decontamination import MASKS, decontaminate, op8_decontamination, overlaps

LOWER = {i: i + 32 for i in range(65, 91)}


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def brute(docs, items, least=13, share=0.6, seeded=True):
    """Every diagonal of every document and item (``seeded``: only those that some mask hits)."""
    out = set()
    for d, t in docs:
        w = split(t)
        for i, u in items:
            v, best = split(u), None
            if 0 < len(v) < 4:
                if v == w:
                    out.add((d, i, 0, len(v), len(v)))
                continue
            masks = MASKS if len(v) >= min(map(len, MASKS)) else ["1" * len(v)]
            for shift in range(-len(v) + 1, len(w)):
                if seeded and not any(all(0 <= p + j < len(v) and 0 <= p + j + shift < len(w) and v[p + j] == w[p + j + shift] for j, c in enumerate(m) if c == "1") and p + len(m) <= len(v) and p + shift + len(m) <= len(w) for m in masks for p in range(len(v))):
                    continue
                score = n = eq = 0
                top = (0, 0, 0, 0)
                first = max(0, shift)
                for k in range(first, min(len(w), len(v) + shift)):
                    s = v[k - shift] == w[k]
                    step = score + (1 if s else -1)
                    if step > top[0]:
                        top = (step, k + 1 - (n + 1), n + 1, eq + s)
                    score, n, eq = (step, n + 1, eq + s) if step > 0 else (0, 0, 0)
                enough = len(v) if len(v) < 7 else min(least, math.ceil(share * len(v)))
                if v and top[3] >= enough and top[3] >= share * top[2]:
                    key = (top[3], -top[2], -top[1])
                    best = key if best is None or key > best else best
            if best:
                out.add((d, i, -best[2], -best[1], best[0]))
    return out


def test_equals_brute_force(spark):
    r = random.Random(4)
    items = [(k, " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range((2, 4, 5, 6, 7, 9, 13, 14, 20, 40, 40, 60)[k]))) for k in range(12)] + [(50, None), (51, ""), (52, "  ")]
    docs = [(i, t) for i, t in ROWS if len(t or "") < 1000]
    for k, (_, t) in enumerate(items[:12]):
        w = t.split()
        for j in range(0, len(w), 3 + k % 4):
            w[j] = "other"
        docs += [(100 + k, passage(30, k) + " " + t.upper() + " " + passage(9)), (200 + k, " ".join(w)), (300 + k, " ".join(w[4:]) + " end"), (400 + k, t.title()), (500 + k, passage(20, k) + " " + t)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in overlaps(frame(spark, docs), bench).drop("text_hash").collect()}
    assert got == brute(docs, items)
    kept = sorted(x.doc_id for x in decontaminate(frame(spark, docs), bench).select("doc_id").collect() if x.doc_id is not None)
    bad = {d for d, *_ in got}
    assert kept == sorted(d for d, _ in docs if d is not None and d not in bad) and len(bad) > 5


def changed(words, r, rate):
    """Each word replaced with a chance; at ``rate`` 3, every third one."""
    return " ".join(f"other{r.randrange(99)}" if (rate == 3 and k % 3 == 2) or (rate < 1 and r.random() < rate) else w for k, w in enumerate(words))


def test_recall_against_all_diagonals(spark):
    """What masks miss: at least 0.9 of the overlaps that a search without masks finds."""
    r = random.Random(9)
    items = [(k, " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(r.choice([8, 12, 20, 40, 60])))) for k in range(25)]
    docs = [(100 * n + k, passage(15, k) + " " + changed(t.split(), r, rate) + " " + passage(9, k + 1)) for n, rate in enumerate((0, 0.1, 0.2, 0.3, 3)) for k, t in items]
    want = {x[:2] for x in brute(docs, items, seeded=False)}
    got = {(x.doc_id, x.item_id) for x in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    for n in (0, 4):  # whole copies, and those with every third word replaced: all
        assert {x for x in want if x[0] // 100 == n} <= got and len({d for d, _ in got if d // 100 == n}) == 25
    assert all(d % 100 == i for d, i in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert overlaps(frame(spark), none).count() == 0 and decontaminate(frame(spark), none).count() == len(ROWS)
    assert overlaps(frame(spark, []), none).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    got = {tuple(x) for x in op8_decontamination(spark, sf_dir).collect()}
    sure = {(d, i) for d, t in docs for i, u in items if " ".join(split(u)) in " ".join(split(t))}
    assert sure <= {(d, i) for d, i, *_ in got} and all(s >= 0.6 * n for *_, n, s in got)
