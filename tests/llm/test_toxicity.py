import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import frame, passage
from tickloom.llm import encoding
from tickloom.llm import toxicity as module
from tickloom.llm.common import read
from tickloom.llm.toxicity import Model, features, held_out, op10_toxicity, toxicity, train


@pytest.fixture(scope="module")
def fitted(spark):
    docs = [(k, passage(40 + k % 50, k) + (" you utter nitwit!" if k % 4 == 0 else "")) for k in range(900)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(900)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df, train(df, labels, max_rows=500), docs


def test_held_out_accuracy(spark, fitted):
    df, model, _ = fitted
    rows = toxicity(df, model).where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100 and np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in rows]) > 0.97


def test_only_the_text_matters_and_odd_rows_pass(spark, fitted):
    _, model, _ = fitted
    got = toxicity(frame(spark), model).collect()
    again = {r.text: r.score for r in toxicity(frame(spark).select("text"), model).collect()}
    assert len(got) == 17 and all(0 <= r.score <= 1 and again[r.text] == r.score for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert toxicity(frame(spark, []), model).count() == 0


def test_batches_do_not_change_scores(fitted):
    _, model, docs = fitted
    texts = [t for _, t in docs[:60]] + ["", None, "one", "two words"]
    whole = model.scores(pa.array(texts))
    assert np.allclose(whole, [model.scores(pa.array([t], pa.string()))[0] for t in texts], atol=1e-5)


def test_responses_against_loops(fitted):
    _, model, docs = fitted
    x, rows, _ = features(pa.array([docs[0][1], "a b", "a"]))
    got = model.logits(x, rows)
    for i in range(3):
        emb = model.table[x[rows[i] : rows[i + 1]]].sum(axis=1)
        pooled = []
        for k, w in enumerate(model.widths):
            z = [sum(emb[p + j] @ model.kernels[k][j] for j in range(w)) for p in range(len(emb) - w + 1)]
            pooled += list(np.maximum(0, np.max(z, axis=0) + model.bias[k * 8 : k * 8 + 8])) if z else [0] * 8
        assert got[i] == pytest.approx(np.dot(pooled, model.out) + model.offset, abs=1e-4)


def test_without_labels_nothing_is_toxic(spark):
    model = train(frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.score < 0.5 for r in toxicity(frame(spark), model).collect())
    assert isinstance(model, Model)


def test_training_is_repeatable_and_bounded(spark, fitted):
    df, model, docs = fitted
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(900)] + [(None, 1, 1), (3, 0, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    again = train(df.repartition(5).unionByName(df.limit(30)), labels, max_rows=500)
    texts = pa.array([t for _, t in docs[:50]])
    assert np.array_equal(again.scores(texts), model.scores(texts))
    few = train(df, labels, max_rows=500, max_words=6000)  # some texts only
    assert np.mean([(s >= 0.5) == (k % 4 == 0) for k, s in enumerate(few.scores(texts))]) > 0.9


def test_every_labelled_row_is_fitted_to(spark):
    """All toxic texts lie beyond the first 8,000 labelled rows by digest."""
    ids = spark.range(12000).withColumnRenamed("id", "doc_id").where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas().doc_id.tolist()
    toxic = set(ids[8000:])
    assert len(toxic) > 1000
    df = spark.createDataFrame([(k, f"row{k % 50} of words" + (" dreadful nitwit" if k in toxic else "")) for k in ids], "doc_id long, text string")
    model = train(df, spark.createDataFrame([(k, 1, int(k in toxic)) for k in ids], "doc_id long, quality int, toxic int"))
    assert (model.scores(pa.array(["row3 of words", "row3 of words dreadful nitwit"])) >= 0.5).tolist() == [False, True]


def test_shards_learn_together(spark, fitted, monkeypatch):
    df, _, docs = fitted
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(900)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(module, "SHARD_ROWS", 100)
    model = train(df, labels)
    texts = pa.array([t for _, t in docs])
    scores = model.scores(texts)
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scores[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.97
    monkeypatch.setattr(module, "LABELS_AT_ONCE", 0)  # labels by a shuffle
    assert np.array_equal(train(df.repartition(5), labels).scores(texts), scores)


def test_query(spark, sf_dir):
    rows = op10_toxicity(spark, sf_dir).collect()
    assert len(rows) == read(spark, sf_dir, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)


def test_scoring_leaves_no_encoder_in_its_worker(fitted):
    """Caches of a packing stage would stay beside the memory that scoring takes."""
    _, model, docs = fitted
    list(encoding.encoder(public_tokenizers.path("byte_bpe_50k.json"), True).ids([docs[0][1]]))
    batch = pa.record_batch([pa.array([t for _, t in docs[:5]])], ["text"])
    got = list(module._scoring(model, ["text"], "score")([batch]))
    assert got[0].column("score").to_pylist() == model.scores(batch.column("text")).tolist() and not encoding._ENCODERS
