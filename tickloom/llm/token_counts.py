"""Token counts by a digest cache."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, discard, materialise, read, scratch, text_column
from tickloom.llm.encoding import encoder, tokenizer_digest

CACHE = "content binary, n_tokens long, tokenizer string"
#: Missing digests that are broadcast to pick out their texts; beyond, a shuffle by digest does.
BROADCAST_MISSES = 500_000


def _normal(text: bytes) -> bytes:
    """Runs of white space become one space and go at the ends: the tokenizer drops them anyway.

    A text with a special token's opening stays as it is.
    """
    return text if b"<|" in text else b" ".join(text.split())


def _normals(batches):
    for b in cut(batches, "text"):
        yield b, [_normal(t) for t in b.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def _digests(batches):
    for b, normal in _normals(batches):
        yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array([hashlib.sha256(t).digest() for t in normal], pa.binary())], ["doc_id", "n_bytes", "content"])


def _texts(batches):
    for _, normal in _normals(batches):
        yield pa.record_batch([pa.array([hashlib.sha256(t).digest() for t in normal], pa.binary()), pa.array(normal, pa.binary()).cast(pa.string())], ["content", "normal"])


def _count(path: str):
    def run(batches):
        e = encoder(path, False)
        for b in cut(batches, "normal"):
            yield pa.record_batch([b.column("content"), pa.array(list(e.counts(b.column("normal").to_pylist())), pa.int64())], ["content", "n_tokens"])

    return run


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """What the cache at a path holds for a tokenizer version; a digest appended twice counts once."""
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except Exception as e:  # a new cache
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], CACHE)
    return found.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    Digests of normalised content are joined to the counts that the cache (Parquet at ``cache``,
    one folder a tokenizer version) holds; each distinct missing content is encoded once and its
    count appended. Only texts of missing contents are shuffled, copies combined on the map side; if
    the cache holds all, none is.

    A null text counts as empty (0 tokens); very long texts are taken whole; repeated rows and
    repeated or null ids each keep their own row; an empty table gives an empty result; other columns
    are ignored. The tokenizer must drop white space between words.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = text_column(docs)
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    keys = materialise(rows.mapInArrow(_digests, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, content binary"), "digests")
    missing = materialise(keys.select("content").distinct().join(_stored(spark, cache, version), "content", "left_anti"), "missing")
    n = missing.count()
    if n:
        texts = rows.select("text").mapInArrow(_texts, "content binary, normal string")
        few = n <= BROADCAST_MISSES and 2 * n <= keys.count()
        distinct = (texts.join(F.broadcast(missing), "content", "left_semi") if few else texts).groupBy("content").agg(F.first("normal").alias("normal"))
        wanted = distinct if few else distinct.join(missing, "content", "left_semi")
        wanted.mapInArrow(_count(tokenizer_path), "content binary, n_tokens long").withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    discard(missing)
    return keys.join(_stored(spark, cache, version), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "token-cache"))
