from tests.llm.cases import frame, passage
from tests.llm.test_decontamination import split
from tests.llm.test_near_duplicates import shingles
from tickloom.llm.common import materialise, read

import corpus_pipeline


def test_stages_on_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = {r.doc_id: r.text for r in kept["near_duplicates"].collect()}
    sets = {i: s for i, t in texts.items() if (s := shingles(t, 5))}
    ids = sorted(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :])
    items = [" ".join(split(r.text)) for r in read(spark, sf_dir, "benchmark").collect()]
    assert not any(u in " ".join(split(r.text)) for r in kept["decontamination"].collect() for u in items)
    assert kept["decontamination"].count() == kept["personal_data"].count() == kept["packing"].select("doc_id").distinct().count()
    assert 0 < kept["personal_data"].count() < read(spark, sf_dir, "documents").count()


def test_odd_rows(spark, sf_dir):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    assert docs.count() > 0


def test_ids_that_are_null_or_repeated(spark, sf_dir):
    """One row a component, whatever the ids."""
    near = lambda n, k: passage(n, k) + " and an end"
    rows = [(None, passage(80, 1)), (None, passage(80, 4)), (None, passage(80, 7)), (None, near(80, 7)), (None, None), (None, ""), (None, " ")]
    rows += [(1, passage(90, 10)), (2, near(90, 10)), (2, passage(90, 13)), (3, near(90, 13)), (4, passage(90, 16)), (4, passage(90, 16)), (4, passage(90, 19))]
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), sf_dir).collect())
    ids = [i for i, t in got if t.strip()]
    assert len(got) - len(ids) == 3 and ids == [0, 0, 0, 1, 2, 4, 4]
    texts = {t for _, t in got}
    assert {passage(80, 1), passage(80, 4), passage(90, 10), passage(90, 13), passage(90, 16), passage(90, 19)} <= texts and len({passage(80, 7), near(80, 7)} & texts) == 1
