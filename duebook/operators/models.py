"""Late-payment models: boosted trees, scores, tiers, importance and Shapley values, and the baseline."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept
from . import boosting, quantiles
from .features import assert_no_leakage

#: Bounds of the risk tiers, the shape of the trees, and how many without less loss end them.
TIERS = {"LOW": 0.30, "MEDIUM": 0.65}
TREES, DEPTH, STEP, SAMPLE, PATIENCE = 500, 6, 0.05, 0.8, 50


def tier(risk: Column) -> Column:
    return F.when(risk < TIERS["LOW"], "LOW").when(risk < TIERS["MEDIUM"], "MEDIUM").otherwise("HIGH")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def _stop(losses: list[float], patience: int) -> tuple[int, bool]:
    """How many trees have the least loss, and whether ``patience`` trees after them brought no less; later ones don't count."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        if k - best >= patience:
            return best + 1, True
    return best + 1, False


def _fit(estimator: GBTClassifier | GBTRegressor, rows: DataFrame, columns: list[str], label: Column, trees: int, *loss: str) -> GBTClassificationModel | GBTRegressionModel:
    """The model of the trees of least validation loss among ``trees``; once PATIENCE trees bring no less, no more are tried.

    Spark's own early stopping ends at the first tree that gains little. The first trees don't depend on how many follow,
    so more and more are fitted until their losses stop, and then those that count.
    """
    rows = _vectors(rows.filter("split IN ('train', 'validation')").withColumn("label", label).filter("label IS NOT NULL"), columns).select("features", "label", "split")
    data = kept(rows, "vectors")  # every fit sees the same rows in the same order
    train, held = (data.filter(F.col("split") == k).select("features", "label") for k in ("train", "validation"))
    fit = lambda n: estimator.copy({estimator.maxIter: n}).fit(train)
    if held.isEmpty():
        return fit(trees)
    n, stopped = 0, False
    while not stopped and n < trees:
        n = min(trees, max(2 * n, 2 * PATIENCE))
        model = fit(n)
        wanted, stopped = _stop(model.evaluateEachIteration(held, *loss), PATIENCE)
    return model if wanted == n else fit(wanted)


def train_classifier(rows: DataFrame, columns: list[str], trees: int = TREES, seed: int = 42) -> GBTClassificationModel:
    """Boosted trees for ``is_late`` of rows (columns..., is_late, split): fitted on train, stopped early by validation."""
    assert_no_leakage(columns)
    shape = GBTClassifier(maxDepth=DEPTH, stepSize=STEP, subsamplingRate=SAMPLE, seed=seed)
    return _fit(shape, rows, columns, F.col("is_late").cast("double"), trees)


def train_timing(rows: DataFrame, columns: list[str], trees: int = TREES, seed: int = 42) -> GBTRegressionModel:
    """Boosted trees of absolute error for log1p of ``days_until_payment``, never below 0."""
    assert_no_leakage(columns)
    days = F.col("days_until_payment").cast("double")
    shape = GBTRegressor(lossType="absolute", maxDepth=DEPTH, stepSize=STEP, subsamplingRate=SAMPLE, seed=seed)
    return _fit(shape, rows, columns, F.when(days.isNotNull(), F.log1p(F.greatest(days, F.lit(0.0)))), trees, "absolute")


def score(rows: DataFrame, columns: list[str], classifier: GBTClassificationModel, timing: GBTRegressionModel) -> DataFrame:
    """(invoice_id, risk_score, predicted_late, risk_tier, predicted_days): scores to 6 places within 0 and 1, days to 2 and never below 0; the tier goes by the unrounded score."""
    scored = classifier.transform(_vectors(rows, columns)).withColumn("risk", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")
    scored = timing.transform(scored)
    risk = F.least(F.greatest("risk", F.lit(0.0)), F.lit(1.0))
    days = F.greatest(F.expm1("prediction"), F.lit(0.0))
    return scored.select("invoice_id", F.round(risk, 6).alias("risk_score"), (risk >= 0.5).cast("long").alias("predicted_late"), tier(risk).alias("risk_tier"), F.round(days, 2).alias("predicted_days"))


def score_summary(scores: DataFrame) -> DataFrame:
    """One row: mean, median and spread of the risk, rows and percent of each tier, and mean, median and 95th percentile of the days."""
    x, y, n = F.col("risk_score"), F.col("predicted_days"), F.count("*")
    tiers = [c for k in ("LOW", "MEDIUM", "HIGH") for c in (F.count_if(F.col("risk_tier") == k).alias(f"{k.lower()}_n"), F.round(100.0 * F.count_if(F.col("risk_tier") == k) / n, 1).alias(f"{k.lower()}_percent"))]
    facts = scores.agg(n.alias("n"), F.round(F.avg(x), 4).alias("mean_risk"), F.round(F.stddev_samp(x), 4).alias("std_risk"), *tiers, F.round(F.avg(y), 2).alias("mean_days"))
    found = quantiles.exact(scores, {"median_risk": (x, 0.5), "median_days": (y, 0.5), "p95_days": (y, 0.95)})
    return quantiles.beside(facts, found.select(F.round("median_risk", 4).alias("median_risk"), F.round("median_days", 2).alias("median_days"), F.round("p95_days", 2).alias("p95_days")))


def target_spread(rows: DataFrame, column: str) -> DataFrame:
    """One row: least, median, mean, 95th percentile and most of a target, to 2 places."""
    x = F.col(column).cast("double")
    found = quantiles.exact(rows, {"min": (x, 0.0), "median": (x, 0.5), "p95": (x, 0.95), "max": (x, 1.0)})
    return quantiles.beside(rows.agg(F.avg(x).alias("mean")), found).select(*(F.round(k, 2).alias(k) for k in ("min", "median", "mean", "p95", "max")))


def baseline_late(history: DataFrame) -> DataFrame:
    """``history`` with ``predicted``: late if half of the known customer's settled invoices were."""
    return history.withColumn("predicted", ((F.coalesce("late_rate", F.lit(0.0)) >= 0.5) & (F.col("is_new_customer") == 0)).cast("long"))


def importance(model: GBTClassificationModel | GBTRegressionModel, columns: list[str], spark) -> DataFrame:
    """(feature, importance, place): shares of the gain that add up to 1, the largest first."""
    rows = sorted(zip(columns, (float(x) for x in model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(f, round(x, 6), k) for k, (f, x) in enumerate(rows, 1)], "feature string, importance double, place long")


def _trees(model: GBTClassificationModel | GBTRegressionModel) -> list[tuple[np.ndarray, ...]]:
    """Each tree as arrays (feature, threshold, left, right, value, cover) by node; a leaf has feature -1. Their size is the model's.

    A node's cover is the number of training rows that reached it when its tree was grown.
    """
    found = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[list[float]] = []

        def walk(node, weight=weight, nodes=nodes) -> int:
            k = len(nodes)
            nodes.append([-1, 0.0, -1, -1, weight * node.prediction(), node.impurityStats().count()])
            if "InternalNode" in node.getClass().getSimpleName():
                split = node.split()
                nodes[k][0], nodes[k][1] = split.featureIndex(), split.threshold()
                nodes[k][2], nodes[k][3] = walk(node.leftChild()), walk(node.rightChild())
            return k

        walk(tree._call_java("rootNode"))
        table = np.array(nodes)
        found.append((table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], table[:, 5]))
    return found


def _leaves(tree: tuple[np.ndarray, ...]) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Every leaf as its value and, for each feature on its path, (feature, above, upto, kept): the interval above < x <= upto that
    leads here and the share of the cover that goes on along the path at that feature's splits."""
    feature, threshold, left, right, value, cover = tree
    found, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        f = int(feature[node])
        if f < 0:
            found.append((float(value[node]), [(k, *v) for k, v in path.items()]))
            continue
        above, upto, kept = path.get(f, (-np.inf, np.inf, 1.0))
        for child, interval in ((int(left[node]), (above, min(upto, threshold[node]))), (int(right[node]), (max(above, threshold[node]), upto))):
            todo.append((child, path | {f: (*interval, kept * cover[child] / cover[node])}))
    return found


def _shares(follows: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """What each of m features adds to a leaf of value 1, for rows (follows: row x feature, 0 or 1).

    A coalition of features contributes the product of ``follows`` over its members and of ``kept`` over the others.
    The polynomial of all features but one holds the sums of these products by size of coalition; each size has the
    same weight among all orders of joining, so m polynomials of degree m - 1 stand for 2^m coalitions.
    """
    m = len(kept)
    weight = np.ones(m)
    for k in range(1, m):  # k! (m - 1 - k)! / m!
        weight[k] = weight[k - 1] * k / (m - k)
    weight /= m
    out = np.zeros(follows.shape)
    for i in range(m):
        poly = np.zeros((len(follows), m))
        poly[:, 0] = 1
        for j in range(m):
            if j != i:
                grown = poly * kept[j]
                grown[:, 1:] += poly[:, :-1] * follows[:, j, None]
                poly = grown
        out[:, i] = (follows[:, i] - kept[i]) * (poly @ weight)
    return out


def contributions(rows: DataFrame, columns: list[str], model: GBTClassificationModel | GBTRegressionModel | boosting.Boosted) -> DataFrame:
    """(invoice_id, bias, parts): the Shapley value of each feature for the raw score, exact for every tree, in polynomial time.

    The game's worth of a set of features is the tree's mean where the others follow each split by the training rows'
    cover. The bias is the worth of no feature, so bias and parts add up to the raw score. Rows that agree on which
    splits of a leaf's path they follow are worked out once.
    """
    own = isinstance(model, boosting.Boosted)
    leaves = [leaf for tree in (model.trees if own else _trees(model)) for leaf in _leaves(tree)]
    bias = (model.base if own else 0.0) + float(sum(value * np.prod([p[3] for p in path]) for value, path in leaves))

    @F.pandas_udf("array<double>")
    def parts(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_list()) if len(features) else np.zeros((0, len(columns)))
        out = np.zeros(x.shape)
        for value, path in leaves:
            if not path:
                continue  # a tree of one leaf tells nothing
            at, above, upto, kept = (np.array(v) for v in zip(*path))
            v = x[:, at]  # NaN is above every threshold, as the trees take it
            follows = (~(v <= above) | np.isneginf(above)) & ((v <= upto) | np.isposinf(upto))
            code, kind = np.unique(follows @ (1 << np.arange(len(at))), return_inverse=True)  # a bit for each feature of the path
            kinds = code[:, None] >> np.arange(len(at)) & 1
            out[:, at] += value * _shares(kinds.astype(float), kept)[kind]
        return pd.Series(list(out))

    return _vectors(rows, columns).select("invoice_id", F.lit(bias).alias("bias"), parts(vector_to_array("features")).alias("parts"))


def factors(explained: DataFrame, columns: list[str], groups: dict[str, str], steep: float = 2.0) -> DataFrame:
    """(invoice_id, factor, contribution, share, place, score): contributions by named group, the largest first, and the score that they make.

    ``steep`` is 2 for Spark's trees, whose raw score is half the log odds, and 1 for ``boosting``.
    """
    at: dict[str, list[int]] = {}
    for k, c in enumerate(columns):
        at.setdefault(groups.get(c, "other"), []).append(k)
    # all of an invoice is in its row, so its factors are added up and ranked there
    sums = [reduce(Column.__add__, (F.col("parts")[k] for k in ks)) for ks in at.values()]
    found = F.array(*(F.struct((-F.abs(x)).alias("less"), F.lit(f).alias("factor"), x.alias("contribution")) for f, x in zip(at, sums, strict=True)))
    rows = explained.select("invoice_id", sigmoid(steep * (F.col("bias") + F.aggregate("parts", F.lit(0.0), lambda a, x: a + x))).alias("score"), F.array_sort(found).alias("found"))
    rows = rows.select("invoice_id", "score", F.aggregate("found", F.lit(0.0), lambda a, x: a - x["less"]).alias("whole"), F.posexplode("found").alias("k", "p"))
    share = F.coalesce(F.try_divide(-F.col("p.less"), F.col("whole")), F.lit(0.0))
    return rows.select("invoice_id", "p.factor", F.round("p.contribution", 6).alias("contribution"), F.round(share, 4).alias("share"), (F.col("k") + 1).cast("long").alias("place"), F.round("score", 6).alias("score"))


def upsert_scores(stored: DataFrame, fresh: DataFrame, version: str = "scored_at") -> DataFrame:
    """One score for each tenant and invoice: the newest of both tables; of equal versions the fresh one."""
    rows = stored.withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)))
    order = Window.partitionBy("business_id", "invoice_id").orderBy(F.desc(version), F.desc("__fresh"))
    return rows.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k", "__fresh")


def still_valid(stored: DataFrame, bills: DataFrame) -> DataFrame:
    """Stored scores (business_id, invoice_id, customer_id, ...) whose invoice still has the customer they were made for."""
    return stored.join(bills.select("business_id", "invoice_id", F.col("customer_id").alias("__now")), ["business_id", "invoice_id"]).filter(F.col("customer_id").eqNullSafe(F.col("__now"))).drop("__now")
