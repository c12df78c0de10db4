"""A corpus in five stages: toxic texts go, near copies go, benchmark texts go, personal data is replaced, what is left is packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, near_duplicates, packing, personal_data, toxicity
from tickloom.llm.common import materialise, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts scored under 0.5 by a classifier fitted to the labelled rows of ``docs``."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model, "toxicity").where("toxicity < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest id, of each group linked by similarity 0.8 on five-word shingles, and all rows without words."""
    return near_duplicates.representatives(docs, width=5, percent=80).select(*COLUMNS)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that overlap no benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data; ``n_chars`` follows the text."""
    done = personal_data.replace_personal_data(docs, key="surrogates of this corpus", counts=False)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_texts),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: None of the stages but decontamination can be said in SQL; tests hold all against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
