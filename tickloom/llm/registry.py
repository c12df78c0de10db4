"""Queries of the training-data operators and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tickloom.llm.decontamination import op8_decontamination
from tickloom.llm.language_model import op4_language_model
from tickloom.llm.near_duplicates import op2_near_duplicates
from tickloom.llm.packing import op5_packing
from tickloom.llm.personal_data import op7_personal_data
from tickloom.llm.substring_dedup import op6_substring_dedup
from tickloom.llm.token_counts import op1_token_counts
from tickloom.llm.token_files import op3_token_files
from tickloom.llm.top_k import OP9_SQL, op9_top_k
from tickloom.llm.toxicity import op10_toxicity

ORACLE: dict[str, str] = {"op9_top_k": OP9_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_token_counts, op2_near_duplicates, op3_token_files, op4_language_model, op5_packing, op6_substring_dedup, op7_personal_data, op8_decontamination, op9_top_k, op10_toxicity)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
