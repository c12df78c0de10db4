import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm.common import read
from tickloom.llm.top_k import OP9_SQL, op9_top_k, top_k


def brute(rows, k, every=3):
    clean = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in clean:
        if q % every == 0:
            got = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(got)]
    return sorted(out)


def made(seed, n, width, big=1.0):
    r = np.random.default_rng(seed)
    return [(k, (big * r.integers(-3, 4, width) / 4 + r.choice([0, 1e-3], width)).tolist()) for k in range(n)]


@pytest.mark.parametrize(("rows", "k", "options"), [(made(1, 80, 6), 5, {}), (made(2, 80, 3), 10, {"block": 7, "lists": 2}), (made(3, 6, 8), 10, {}), (made(4, 30, 4, 1e5), 4, {}), (made(5, 40, 1), 3, {"lists": 4})])
def test_equals_brute_force(spark, rows, k, options):
    odd = [(1001, None), (1002, [1.0, None]), (1003, [float("nan")] * 6), (1005, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3).withColumn("score", F.lit(1)).withColumn("query_id", F.lit(2))
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 3 == 0, k, **options).collect())) == brute(rows, k)


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 3 == 0).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(OP9_SQL).fetchall()
    assert sorted(map(tuple, op9_top_k(spark, sf_dir).collect())) == sorted(want)
    assert len(read(spark, sf_dir, "embeddings").columns) == 3
