"""Purged folds, scores, calibration and threshold choice."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.keys import SYMBOL


def fold_ids(labels: DataFrame, k: int) -> DataFrame:
    """``row, fold``: contiguous folds in order of ``t0``; the first ``n % k`` have one row more."""
    w = Window.partitionBy(SYMBOL).orderBy("t0", "t1")
    return labels.withColumns({"row": F.row_number().over(w) - 1, "fold": F.ntile(k).over(w) - 1})


def purged_folds(labels: DataFrame, k: int, embargo: float = 0.0) -> DataFrame:
    """``symbol, t0, fold, role``: each fold's test rows, and training rows that neither overlap them nor come in the embargo after.

    For contiguous tests, overlap is a comparison with the fold's first start and last end: one row a
    fold is joined to the labels, not labels to labels.
    """
    d = fold_ids(labels, k)
    part = Window.partitionBy(SYMBOL)
    d = d.withColumn("n", F.count("*").over(part))
    tests = d.groupBy(SYMBOL, F.col("fold").alias("test_fold")).agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    j = d.join(tests, SYMBOL)  # k rows a symbol
    inside = F.col("fold") == F.col("test_fold")
    left = F.col("t1") < F.col("lo")
    after = F.col("t0") > F.col("hi")
    first = F.min(F.when(after, F.col("row"))).over(Window.partitionBy(SYMBOL, "test_fold"))
    j = j.withColumn("first_after", first)
    right = after & (F.col("row") >= F.col("first_after") + F.floor(F.col("n") * embargo))
    role = F.when(inside, "test").when(left | right, "train")
    return j.withColumn("role", role).where("role is not null").select(SYMBOL, "t0", "t1", F.col("test_fold").alias("fold"), "role")


def purged_split(labels: DataFrame, test_share: float, embargo: float = 0.0) -> DataFrame:
    """One split in time: test rows from position ``int(n (1 - share)) + 1``, training rows that end before them."""
    w = Window.partitionBy(SYMBOL).orderBy("t0", "t1")
    d = labels.withColumns({"row": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(SYMBOL))})
    start = F.floor(F.col("n") * (1 - test_share)) + 1
    d = d.withColumn("lo", F.min(F.when(F.col("row") >= start, F.col("t0"))).over(Window.partitionBy(SYMBOL)))
    return d.withColumn("role", F.when(F.col("row") >= start, "test").when(F.col("t1") < F.col("lo"), "train")).where("role is not null").select(SYMBOL, "t0", "t1", "role")


def combinatorial_folds(labels: DataFrame, groups: int, tests: int) -> DataFrame:
    """``symbol, t0, split, role`` of every choice of ``tests`` of the contiguous groups, purged against each test group."""
    d = fold_ids(labels, groups)
    spark = labels.sparkSession
    choice = spark.createDataFrame([(i, list(c)) for i, c in enumerate(combinations(range(groups), tests))], "split int, chosen array<int>")
    bounds = d.groupBy(SYMBOL, F.col("fold").alias("g")).agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    spans = bounds.groupBy(SYMBOL).agg(F.collect_list(F.struct("g", "lo", "hi")).alias("spans"))
    j = d.join(spans, SYMBOL).crossJoin(F.broadcast(choice))  # one row a split
    hit = F.exists("spans", lambda s: F.array_contains("chosen", s["g"]) & (F.col("t0") <= s["hi"]) & (s["lo"] <= F.col("t1")))
    role = F.when(F.array_contains("chosen", F.col("fold")), "test").when(~hit, "train")
    return j.withColumn("role", role).where("role is not null").select(SYMBOL, "t0", "t1", "split", "role")


def weighted_scores(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Weighted accuracy, precision, recall, F1, log loss, Brier score and probability-weighted accuracy."""
    w, y, p = F.col("weight"), F.col("y"), F.col("p")
    pred = (p >= threshold).cast("int")
    when = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    sure = F.greatest(p, 1 - p) - 0.5
    g = scored.agg(
        (when(pred == y) / F.sum(w)).alias("accuracy"), (when((pred == 1) & (y == 1)) / F.nullif(when(pred == 1), F.lit(0.0))).alias("precision"), (when((pred == 1) & (y == 1)) / F.nullif(when(y == 1), F.lit(0.0))).alias("recall"),
        (-F.sum(w * (y * F.ln(q) + (1 - y) * F.ln(1 - q))) / F.sum(w)).alias("log_loss"), (F.sum(w * F.pow(p - y, 2)) / F.sum(w)).alias("brier"),
        F.coalesce(F.sum(F.when(pred == y, w * sure).otherwise(0.0)) / F.nullif(F.sum(w * sure), F.lit(0.0)), F.lit(0.5)).alias("pwa"),
    )
    return g.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.groupBy("y", (F.col("p") >= threshold).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, mean probability and observed share of right-closed bins of equal width."""
    b = F.least(F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)), F.lit(bins - 1))
    return scored.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))


def calibration_errors(scored: DataFrame, bins: int = 10) -> DataFrame:
    r = reliability(scored, bins).withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))
    return r.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def quantile_reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    edges = scored.agg(F.percentile("p", [k / bins for k in range(1, bins)]).alias("edges"))
    d = scored.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("p"))))  # one row
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))


def cumulative(g: DataFrame, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Rows with distinct ``p`` and, of each value, the sum over them in order of ``p``.

    Rows are summed within 4,096 bands of the probability; what the bands before add comes from one
    row a band, so that no task has all probabilities.
    """
    d = g.withColumn("_band", F.least(F.greatest(F.floor(F.col("p") * 4096), F.lit(0)), F.lit(4096))).withColumns({f"_{k}": v for k, v in sums.items()})
    order = lambda c: F.desc(c) if descending else F.asc(c)
    before = Window.orderBy(order("_band")).rowsBetween(Window.unboundedPreceding, -1)  # a row a band
    bands = d.groupBy("_band").agg(*(F.sum(f"_{k}").alias(f"_t_{k}") for k in sums))
    bands = bands.select("_band", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    own = Window.partitionBy("_band").orderBy(order("p")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({k: F.sum(f"_{k}").over(own) for k in sums}).join(F.broadcast(bands), "_band")
    return d.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop("_band", *(f"_{k}" for k in sums), *(f"_b_{k}" for k in sums))


def thresholds(scored: DataFrame) -> DataFrame:
    """For each distinct probability as a threshold: precision, recall, F1, true and false positive rates."""
    g = scored.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    every = scored.agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    c = cumulative(g, {"tp": F.col("pos"), "called": F.col("n")}, descending=True).select("p", "tp", "called").crossJoin(F.broadcast(every))  # one row
    c = c.withColumns({"precision": F.col("tp") / F.col("called"), "recall": F.col("tp") / F.nullif(F.col("pos"), F.lit(0)), "fpr": (F.col("called") - F.col("tp")) / F.nullif(F.col("n") - F.col("pos"), F.lit(0))})
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).select("p", "tp", "called", "precision", "recall", "fpr", "f1")


def best_threshold(scored: DataFrame) -> DataFrame:
    return thresholds(scored).agg(F.max(F.struct(F.coalesce("f1", F.lit(0.0)).alias("f1"), "p")).alias("b")).select("b.p", "b.f1")


def ranking_scores(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums (ties shared), average precision, and the share of positives."""
    g = scored.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    every = scored.agg(F.sum("y").alias("all_pos"), F.sum(1 - F.col("y")).alias("all_neg"))
    d = cumulative(g, {"up_to": F.col("n") - F.col("pos"), "tp_up": F.col("pos"), "n_up": F.col("n")}).crossJoin(F.broadcast(every))  # one row
    d = d.withColumns({"below": F.col("up_to") - (F.col("n") - F.col("pos")), "tp": F.col("all_pos") - F.col("tp_up") + F.col("pos"), "called": F.col("all_pos") + F.col("all_neg") - F.col("n_up") + F.col("n")})
    auc = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)) / F.nullif(F.first("all_pos") * F.first("all_neg"), F.lit(0))
    ap = F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / F.col("called"))
    return d.agg(auc.alias("auc"), ap.alias("average_precision"), (F.first("all_pos") / (F.first("all_pos") + F.first("all_neg"))).alias("base_rate"))


def isotonic(scored: DataFrame) -> DataFrame:
    """``scored`` with ``calibrated`` by isotonic regression (Spark ML)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    d = VectorAssembler(inputCols=["p"], outputCol="features").transform(scored.withColumn("label", F.col("y").cast("double")))
    return IsotonicRegression(predictionCol="calibrated").fit(d).transform(d).drop("features", "label")


def platt(scored: DataFrame, regularisation: float = 0.0) -> DataFrame:
    """``scored`` with ``calibrated`` by logistic regression on the probability (Spark ML)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=["p"], outputCol="features").transform(scored.withColumn("label", F.col("y").cast("double")))
    out = LogisticRegression(regParam=regularisation).fit(d).transform(d)
    return out.withColumn("calibrated", vector_to_array("probability")[1]).drop("features", "label", "rawPrediction", "probability", "prediction")


def cross_validate(data: DataFrame, folds: DataFrame, features: list[str], estimator=None) -> DataFrame:
    """Scores of a Spark ML classifier on each purged fold; ``data(symbol, t0, y, weight, features...)``.

    Rows and folds are made once and kept for all fits, whose scores, a row a fold, come to the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    estimator = estimator or LogisticRegression(weightCol="weight")
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(data.withColumn("label", F.col("y").cast("double")))
    folds = folds.select(SYMBOL, "t0", "fold", "role").persist()
    rows = rows.join(folds, [SYMBOL, "t0"]).persist()
    try:
        found = []
        for r in folds.select("fold").distinct().orderBy("fold").collect():  # one row a fold
            own = rows.where(F.col("fold") == r["fold"]).drop("fold")
            scored = estimator.fit(own.where("role = 'train'")).transform(own.where("role = 'test'")).withColumn("p", vector_to_array("probability")[1])
            part = weighted_scores(scored).withColumn("fold", F.lit(r["fold"]))
            found.append(part.first())
    finally:
        rows.unpersist()
        folds.unpersist()
    return data.sparkSession.createDataFrame(found, part.schema) if found else None


def bootstrap_reliability(scored: DataFrame, rounds: int = 200, bins: int = 10, seed: int = 3) -> DataFrame:
    """Bounds of 95 % of each bin's observed share, by resampling the bins' counts (binomial, exact for rows drawn with replacement)."""
    r = reliability(scored, bins)

    def run(batches):
        for pdf in batches:
            lo, hi = [], []
            for b, n, a in zip(pdf["bin"], pdf["n"], pdf["accuracy"], strict=True):
                draws = np.random.default_rng([seed, int(b)]).binomial(int(n), float(a), rounds) / int(n)
                lo.append(float(np.quantile(draws, 0.025)))
                hi.append(float(np.quantile(draws, 0.975)))
            yield pd.DataFrame({"bin": pdf["bin"], "lower": lo, "upper": hi})

    return r.mapInPandas(run, "bin int, lower double, upper double").join(r, "bin")


def labelled(y: Column, p: Column, weight: Column) -> list[Column]:
    return [y.cast("int").alias("y"), p.cast("double").alias("p"), weight.cast("double").alias("weight")]
