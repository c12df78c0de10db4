import random
import re

import pytest

from tests.llm.cases import ROWS, WORDS, frame, passage
from tickloom.llm.common import materialise, read
from tickloom.llm.components import components
from tickloom.llm.near_duplicates import near_duplicates, op2_near_duplicates

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    """Every pair of rows."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(r[0], len(s), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def order(rows):
    return sorted((tuple(r)[:3] for r in rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


FAMILY = [(1000 + k, edited(passage(200), k % 9, k)) for k in range(40)] + [(2000 + k, edited(passage(200, 1), 6, 100 + k)) for k in range(60)] + [(3000 + k, " ".join(random.Random(k).choices(WORDS, k=k % 25))) for k in range(80)]


@pytest.mark.parametrize(("rows", "width", "percent", "options"), [(ROWS, 4, 85, {}), (ROWS + FAMILY, 4, 85, {"longest": 8, "segment_keys": 64}), (FAMILY, 5, 80, {"longest": 3}), (FAMILY, 2, 60, {})])
def test_equals_brute_force(spark, rows, width, percent, options):
    assert order(near_duplicates(frame(spark, rows), width, percent, **options).collect()) == order(brute(rows, width, percent))


#: Different word sequences with one shingle set: short cycles, repeated or begun elsewhere.
CYCLES = [(k, "ha " * n) for k, n in enumerate((4, 5, 6, 9))] + [(10, "a b a b a b a"), (11, "b a b a b a b a"), (12, "A b a b a b a b a b"), (13, "a b a c a b")] + [(20 + 10 * w + n, " ".join(f"line{w}{k}" for k in range(w)) + (" " + " ".join(f"line{w}{k}" for k in range(w))) * n) for w in range(1, 7) for n in (4, 9, 10)] + [(90, "ha"), (91, "ha ha"), (92, None)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_small_sets_of_cycles(spark, width, percent):
    got = order(near_duplicates(frame(spark, CYCLES), width, percent).collect())
    assert got == order(brute(CYCLES, width, percent))
    assert dict((r[0], r[2]) for r in got)[12] == 10


@pytest.mark.parametrize(("rows", "width", "percent", "options"), [(ROWS + FAMILY + CYCLES, 4, 85, {"cell": 7}), (FAMILY, 5, 80, {})])
def test_links_are_all_counted(spark, rows, width, percent, options):
    sets = {" ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))): shingles(t, width) for _, t in rows}
    linked = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    degree = {c: sum(bool(linked(x, y)) for d, y in sets.items() if d != c) for c, x in sets.items()}
    want = sorted((i is not None, i or 0, len(shingles(t, width)), degree[" ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)))]) for i, t in rows)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.n_links) for r in near_duplicates(frame(spark, rows), width, percent, **options).collect())
    assert got == want and max(x[3] for x in want) > 10


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    assert order(op2_near_duplicates(spark, sf_dir).collect()) == order(brute(rows, 4, 85))


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 50)] + [(100, 70), (70, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 70, 70: 70, 200: 70}


@pytest.mark.parametrize("file_links", [1 << 18, 8])
def test_rounds_write_few_files(spark, monkeypatch, file_links):
    written = []

    def counted(df, what, *args):
        stored = materialise(df, what, *args)
        written.append((what, len(stored.inputFiles())))
        return stored

    for module in ("components", "near_duplicates"):
        monkeypatch.setattr(f"tickloom.llm.{module}.materialise", counted)
    monkeypatch.setattr("tickloom.llm.components.FILE_LINKS", file_links)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = near_duplicates(frame(spark, FAMILY), 4, 85, longest=8).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert order(got) == order(brute(FAMILY, 4, 85))
    most = max(n for what, n in written if what in ("edges", "roots", "pairs", "member-runs"))
    assert most == 1 if file_links > 8 else most > 1
