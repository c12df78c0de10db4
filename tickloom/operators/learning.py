"""Search over purged folds, and bagging of sequentially bootstrapped trees with out-of-bag scores."""

from __future__ import annotations

import pickle
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.keys import SYMBOL
from tickloom.operators.sampling import sequential_bootstrap
from tickloom.operators.validation import cross_validate, ranking_scores, weighted_scores


class Tree:
    """A binary classification tree by entropy; ties go to the first feature and the lowest cut."""

    def __init__(self, depth: int = 3, least: int = 5, features: int | None = None, seed: int = 0):
        self.depth, self.least, self.features, self.seed = depth, least, features, seed
        self.nodes: list[tuple] = []  # (share of ones,) or (feature, cut, left, right)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Tree:
        self.random = np.random.RandomState(self.seed)
        self.nodes = []
        self._grow(x, y.astype(float), w.astype(float), 0)
        return self

    @staticmethod
    def _entropy(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
        p = np.clip(np.divide(ones, total, out=np.full_like(total, 0.5), where=total > 0), 1e-12, 1 - 1e-12)
        return -total * (p * np.log2(p) + (1 - p) * np.log2(1 - p))

    def _grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, level: int) -> int:
        at = len(self.nodes)
        ones, total = float((w * y).sum()), float(w.sum())
        self.nodes.append((ones / total if total else 0.5,))
        if level == self.depth or len(y) < 2 * self.least or ones in (0.0, total):
            return at
        own = np.arange(x.shape[1]) if self.features is None else np.sort(self.random.permutation(x.shape[1])[: self.features])
        best = (float(self._entropy(np.array([ones]), np.array([total]))[0]) - 1e-9, -1, 0.0)
        for f in own.tolist():
            order = np.argsort(x[:, f], kind="stable")
            v, a, b = x[order, f], np.cumsum((w * y)[order]), np.cumsum(w[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            cuts = cuts[(cuts + 1 >= self.least) & (len(v) - cuts - 1 >= self.least)]
            if len(cuts):
                cost = self._entropy(a[cuts], b[cuts]) + self._entropy(ones - a[cuts], total - b[cuts])
                k = int(cost.argmin())
                if cost[k] < best[0]:
                    best = (float(cost[k]), f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
        if best[1] < 0:
            return at
        low = x[:, best[1]] <= best[2]
        left = self._grow(x[low], y[low], w[low], level + 1)
        right = self._grow(x[~low], y[~low], w[~low], level + 1)
        self.nodes[at] = (best[1], best[2], left, right)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))

        def walk(at: int, rows: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
                return
            low = x[rows, node[0]] <= node[1]
            walk(node[2], rows[low])
            walk(node[3], rows[~low])

        walk(0, np.arange(len(x)))
        return out


def hyper_fit(data: DataFrame, folds: DataFrame, features: list[str], candidates: Mapping[str, object], scoring: str = "f1") -> tuple[DataFrame, object]:
    """``candidate, fold, score`` of each Spark ML estimator on each purged fold, and the best by mean score fitted to all of ``data``.

    ``scoring`` is a column of :func:`weighted_scores` (a log loss counts negative); a fold without a
    score counts as the worst. Fits run one after another, each distributed over the cluster.
    """
    from pyspark.ml.feature import VectorAssembler

    data, folds = data.persist(), folds.persist()  # read once for all fits
    try:
        found = None
        for name, estimator in candidates.items():
            score = -F.col("log_loss") if scoring == "log_loss" else F.col(scoring)
            part = cross_validate(data, folds, features, estimator).select(F.lit(name).alias("candidate"), "fold", F.coalesce(score, F.lit(float("-inf") if scoring == "log_loss" else 0.0)).alias("score"))
            found = part if found is None else found.unionByName(part)
        rows = found.toPandas()  # candidates times folds
        best = rows.groupby("candidate", sort=False)["score"].mean().idxmax()
        whole = VectorAssembler(inputCols=features, outputCol="features").transform(data.withColumn("label", F.col("y").cast("double")))
        return data.sparkSession.createDataFrame(rows, "candidate string, fold int, score double"), candidates[best].fit(whole)
    finally:
        data.unpersist()
        folds.unpersist()


def numbered(data: DataFrame) -> DataFrame:
    """``data(symbol, i0, i1, ...)`` with ``pick``, the number that the sequential bootstrap gives a label."""
    from pyspark.sql import Window

    return data.withColumn("pick", (F.row_number().over(Window.partitionBy(SYMBOL).orderBy("i0", "i1")) - 1).cast("long"))


def fit_bagging(data: DataFrame, features: list[str], estimators: int, draws: int, depth: int = 3, least: int = 5, seed: int = 0, sequential: bool = True) -> tuple[DataFrame, DataFrame]:
    """Trees ``symbol, seed, model`` and their draws ``symbol, seed, pick, times`` from ``data(symbol, i0, i1, y, weight, features...)``.

    Each tree of a symbol is fitted in its own task to ``draws`` of its labels, drawn one after another
    by uniqueness (or plainly, with replacement), with the root of the number of features at each split.
    """
    rows = numbered(data)
    seeds = list(range(seed, seed + estimators))
    if sequential:
        drawn = sequential_bootstrap(data, draws, seeds).groupBy(SYMBOL, "seed", "pick").agg(F.count("*").alias("times"))
    else:
        counts = rows.groupBy(SYMBOL).agg(F.count("*").alias("n")).withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))

        def plain(pdfs):
            for pdf in pdfs:
                for symbol, n, s in zip(pdf[SYMBOL], pdf["n"], pdf["seed"], strict=True):
                    pick, times = np.unique(np.random.RandomState(s).randint(0, n, draws), return_counts=True)
                    yield pd.DataFrame({SYMBOL: symbol, "seed": s, "pick": pick, "times": times})

        drawn = counts.mapInPandas(plain, f"{SYMBOL} string, seed long, pick long, times long")
    some = max(1, int(len(features) ** 0.5))

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pick")
        tree = Tree(depth, least, some, int(key[1])).fit(pdf[features].to_numpy(float), pdf["y"].to_numpy(), (pdf["times"] * pdf["weight"]).to_numpy(float))
        return pd.DataFrame({SYMBOL: [key[0]], "seed": [key[1]], "model": [pickle.dumps(tree.nodes)]})

    models = drawn.join(rows, [SYMBOL, "pick"]).select(SYMBOL, "seed", "pick", "times", "y", "weight", *features).groupBy(SYMBOL, "seed").applyInPandas(fit, f"{SYMBOL} string, seed long, model binary")
    return models, drawn


def bagging_predict(data: DataFrame, models: DataFrame, features: list[str], without: DataFrame | None = None) -> DataFrame:
    """``symbol, i0, y, weight, p, trees``: mean probability over a symbol's trees; ``without`` leaves out, for each label, the trees whose draws hold it."""
    rows = numbered(data).select(SYMBOL, "i0", "pick", "y", "weight", *features)
    each = rows.join(F.broadcast(models), SYMBOL)  # as many as trees
    if without is not None:
        each = each.join(without.select(SYMBOL, "seed", "pick"), [SYMBOL, "seed", "pick"], "left_anti")

    def score(pdfs):
        for pdf in pdfs:
            p = np.empty(len(pdf))
            x = pdf[features].to_numpy(float)
            for raw, at in pdf.groupby("model").indices.items():
                tree = Tree()
                tree.nodes = pickle.loads(raw)
                p[at] = tree.predict(x[at])
            yield pdf[[SYMBOL, "i0", "y", "weight"]].assign(p=p)

    scored = each.select(SYMBOL, "i0", "y", "weight", "model", *features).mapInPandas(score, f"{SYMBOL} string, i0 long, y int, weight double, p double")
    return scored.groupBy(SYMBOL, "i0", "y", "weight").agg(F.avg("p").alias("p"), F.count("*").alias("trees"))


def oob_scores(data: DataFrame, models: DataFrame, drawn: DataFrame, features: list[str]) -> DataFrame:
    """Weighted scores, area under the curve and coverage over the labels that some tree did not see."""
    scored = bagging_predict(data, models, features, drawn)
    return weighted_scores(scored).crossJoin(ranking_scores(scored).select("auc")).crossJoin(scored.agg(F.count("*").alias("n"))).crossJoin(data.agg(F.count("*").alias("all"))).withColumn("coverage", F.col("n") / F.col("all")).drop("n", "all")  # one row each
