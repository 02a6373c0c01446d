"""Metrics of late-payment and payment-day estimates, by counting and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles

#: Scores are dealt into so many ranges of equal width between 0 and 1.
RANGES = 4096


def _ranked(rows: DataFrame) -> DataFrame:
    """(score, pos, neg, under, above): counts per distinct score, the negatives below it and the positives and all at or above it.

    Scores are counted by range first; a window over the ranges, whose number is fixed, gives each range its
    base, and windows within the ranges do the rest, so no task holds all scores.
    """
    per = rows.groupBy("score").agg(F.sum("label").cast("long").alias("pos"), F.count("*").alias("n"))
    per = per.withColumn("neg", F.col("n") - F.col("pos")).withColumn("range", F.floor(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)) * RANGES))
    ranges = per.groupBy("range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    low = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    high = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    bases = ranges.select("range", zero(F.sum("rn").over(low)).alias("base"), zero(F.sum("rp").over(high)).alias("pos_over"), zero(F.sum(F.col("rp") + F.col("rn")).over(high)).alias("all_over"))
    below = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.join(F.broadcast(bases), "range")  # at most RANGES + 1 rows
    return per.select("score", "pos", "neg", (zero(F.sum("neg").over(below)) + F.col("base")).alias("under"), (F.sum("pos").over(over) + F.col("pos_over")).alias("pos_above"), (F.sum(F.col("pos") + F.col("neg")).over(over) + F.col("all_over")).alias("all_above"))


def classification(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, F1, ROC AUC and average precision of (label 0/1, score).

    The area comes from average ranks over counts per score, so ties count half; a ratio without a
    denominator is 0.
    """
    hit, p, q = F.col("score") >= threshold, F.col("pos"), F.col("neg")
    facts = _ranked(rows).agg(
        F.sum(F.when(hit, p).otherwise(0)).alias("tp"), F.sum(F.when(hit, q).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(q)).alias("tn"), F.sum(F.when(hit, 0).otherwise(p)).alias("fn"),
        F.sum(p * (F.col("under") + q / 2.0)).alias("won"), F.sum(p).alias("p"), F.sum(q).alias("q"), F.sum(p * F.col("pos_above") / F.col("all_above")).alias("gained"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return facts.select(
        *(F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("won").cast("double"), (F.col("p") * F.col("q")).cast("double")).alias("roc_auc"), ratio(F.col("gained").cast("double"), F.col("p").cast("double")).alias("average_precision"),
    )


def regression(rows: DataFrame) -> DataFrame:
    """One row: MAE, RMSE and median absolute error of (actual, predicted)."""
    e = F.abs(F.col("actual").cast("double") - F.col("predicted").cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.round(F.avg(e), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))
    return quantiles.beside(facts, quantiles.exact(rows, {"median_ae": (e, 0.5)})).withColumn("median_ae", F.round("median_ae", 4))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, observed) in bins closed below, the last closed on both sides."""
    k = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("observed"))
