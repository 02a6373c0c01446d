"""Registered queries: baselines, boosted trees and their scores. What the trees give has no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import dealt
from ..operators import boosting, cleaning, evaluation, features, history, models
from ..sources.files import kept
from . import views
from .queries import _SPLIT, _query

COLUMNS = ["log_amount", "month", "weekday", "term_days", "settled", "late_rate", "avg_delay", "median_delay", "std_delay", "days_since_payment", "prior_invoices", "last3_mean_delay", "last3_late_rate", "is_new_customer"]
IMPUTED = ["term_days", "late_rate", "avg_delay", "median_delay", "std_delay", "days_since_payment", "last3_mean_delay", "last3_late_rate"]
#: The factor that a feature counts to.
FACTORS = {"log_amount": "amount", "month": "calendar", "weekday": "calendar", "term_days": "terms", "settled": "history", "prior_invoices": "history", "is_new_customer": "history", "late_rate": "lateness", "last3_late_rate": "lateness", "avg_delay": "delay", "median_delay": "delay", "std_delay": "delay", "last3_mean_delay": "delay", "days_since_payment": "recency"}


def _matrix(s: SparkSession, d: str) -> DataFrame:
    """Feature rows with targets and split, imputed by medians of the training split; the rows are a table of this run."""
    bills, n = views.kept_bills(s, d), views.size(s, d, "orders")
    rows = dealt(features.calendar_features(bills), n, "invoice_id").join(history.history_as_of(bills, count=n).drop("estimates_ready"), "invoice_id").join(features.targets(bills).select("invoice_id", "is_late", "days_until_payment", "status"), "invoice_id")
    closed = bills.select("invoice_id", "invoice_date", F.when(F.col("settled_on").isNull(), "OPEN").otherwise("PAID").alias("status"))
    rows = rows.join(features.temporal_split(closed), "invoice_id")
    rows = rows.select("business_id", "invoice_id", "split", "is_late", "days_until_payment", *(F.col(c).cast("double").alias(c) for c in COLUMNS))
    rows = kept(rows, "matrix")
    medians = features.train_medians(rows.filter("split = 'train'"), IMPUTED)
    return cleaning.impute(rows, s.createDataFrame(medians.collect(), medians.schema))  # one row, which each pass would find again


@_query()
def model_scores(s: SparkSession, d: str) -> DataFrame:
    rows = _matrix(s, d)
    late, days = models.train_classifier(rows, COLUMNS), models.train_timing(rows, COLUMNS)
    return models.score(rows.filter("split IN ('test', 'open_inference')"), COLUMNS, late, days)


@_query()
def model_score_summary(s: SparkSession, d: str) -> DataFrame:
    return models.score_summary(kept(model_scores(s, d), "scores"))


@_query()
def model_importance(s: SparkSession, d: str) -> DataFrame:
    return models.importance(models.train_classifier(_matrix(s, d), COLUMNS), COLUMNS, s)


@_query()
def model_factors(s: SparkSession, d: str) -> DataFrame:
    rows = _matrix(s, d)
    return models.factors(models.contributions(rows.filter("split = 'test'"), COLUMNS, models.train_classifier(rows, COLUMNS)), COLUMNS, FACTORS)


_GAIN_CUTS = {"month": range(1, 12), "day": range(1, 31), "weekday": range(6), "term_days": range(5, 121, 5)}
_GAIN_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, y FROM told" for c in _GAIN_CUTS)
_GAIN_POINTS = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(unnest({list(r)}) AS DOUBLE) AS cut" for c, r in _GAIN_CUTS.items())
_WORTH = "power(greatest(abs({g}) - 0.1::DOUBLE, 0), 2) / ({h} + 1)"


@_query(f"""SELECT * FROM (WITH told AS (SELECT month(inv.invoice_date) AS month, day(inv.invoice_date) AS day, isodow(inv.invoice_date) - 1 AS weekday, date_diff('day', inv.invoice_date, due_date) AS term_days, CASE WHEN date_diff('day', due_date, settled_on) > 0 THEN 1 ELSE 0 END AS y FROM inv JOIN stl ON stl.invoice_id = inv.invoice_id JOIN {_SPLIT} sp ON sp.invoice_id = inv.invoice_id WHERE split = 'train' AND due_date IS NOT NULL AND settled_on IS NOT NULL),
whole AS (SELECT feature, count(*) AS n, sum(0.5::DOUBLE - y) AS g FROM ({_GAIN_LONG}) GROUP BY feature),
sides AS (SELECT p.feature, cut, count(*) AS nl, sum(0.5::DOUBLE - y) AS gl FROM ({_GAIN_POINTS}) p JOIN ({_GAIN_LONG}) l ON l.feature = p.feature AND v <= cut GROUP BY p.feature, cut)
SELECT s.feature, cut, nl AS left_rows, round({_WORTH.format(g="gl", h="0.25::DOUBLE * nl")} + {_WORTH.format(g="(g - gl)", h="0.25::DOUBLE * (n - nl)")} - {_WORTH.format(g="g", h="0.25::DOUBLE * n")}, 4) AS gain FROM sides s JOIN whole w ON w.feature = s.feature WHERE nl < n AND 0.25::DOUBLE * nl >= 5 AND 0.25::DOUBLE * (n - nl) >= 5)""")
def boosted_first_gains(s: SparkSession, d: str) -> DataFrame:
    """What each cut gains at the root of the first boosted tree, from even odds and all training rows."""
    bills = views.bills(s, d)
    rows = features.calendar_features(bills).select("invoice_id", *_GAIN_CUTS).join(features.targets(bills).select("invoice_id", "is_late"), "invoice_id")
    closed = bills.select("invoice_id", "invoice_date", F.when(F.col("settled_on").isNull(), "OPEN").otherwise("PAID").alias("status"))
    rows = rows.join(features.temporal_split(closed), "invoice_id")
    settings = boosting.Settings(rows=1.0, columns=1.0, start=0.0)
    return boosting.first_gains(rows, list(_GAIN_CUTS), _GAIN_CUTS, settings=settings).withColumn("gain", F.round("gain", 4))


_GUESS = f"SELECT CASE WHEN coalesce(round(late / nullif(CAST(settled AS DOUBLE), 0), 6), 0) >= 0.5 AND prior_invoices >= 3 THEN 1 ELSE 0 END AS predicted, CASE WHEN date_diff('day', due_date, settled_on) > 0 THEN 1 ELSE 0 END AS label FROM hist JOIN prior ON prior.invoice_id = hist.invoice_id JOIN inv ON inv.invoice_id = hist.invoice_id JOIN stl ON stl.invoice_id = hist.invoice_id JOIN {_SPLIT} sp ON sp.invoice_id = hist.invoice_id WHERE split = 'test' AND due_date IS NOT NULL"


@_query(f"""SELECT tn, fp, fn, tp, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS "precision", round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM
(SELECT count(CASE WHEN label = 0 AND predicted = 0 THEN 1 END) AS tn, count(CASE WHEN label = 0 AND predicted = 1 THEN 1 END) AS fp, count(CASE WHEN label = 1 AND predicted = 0 THEN 1 END) AS fn, count(CASE WHEN label = 1 AND predicted = 1 THEN 1 END) AS tp FROM ({_GUESS}))""")
def classification_baseline(s: SparkSession, d: str) -> DataFrame:
    bills = views.bills(s, d)
    closed = bills.select("invoice_id", "invoice_date", F.when(F.col("settled_on").isNull(), "OPEN").otherwise("PAID").alias("status"))
    guessed = models.baseline_late(history.history_as_of(bills)).join(features.temporal_split(closed).filter("split = 'test'"), "invoice_id")
    rows = guessed.join(features.targets(bills).filter("is_late IS NOT NULL").select("invoice_id", F.col("is_late").alias("label")), "invoice_id")
    return evaluation.classification(rows.select("label", F.col("predicted").cast("double").alias("score"))).drop("roc_auc", "average_precision")


@_query("SELECT round(min(x), 2) AS min, round(median(x), 2) AS median, round(avg(x), 2) AS mean, round(quantile_cont(x, 0.95), 2) AS p95, round(max(x), 2) AS max FROM (SELECT CAST(date_diff('day', invoice_date, settled_on) AS DOUBLE) AS x FROM inv JOIN stl ON stl.invoice_id = inv.invoice_id)")
def timing_target(s: SparkSession, d: str) -> DataFrame:
    return models.target_spread(features.targets(views.bills(s, d)).filter("days_until_payment IS NOT NULL"), "days_until_payment")


@_query("SELECT business_id, invoice_id, customer_id, CASE WHEN invoice_id % 3 = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS risk FROM inv WHERE invoice_id % 9 <> 1 OR invoice_id % 3 = 0")
def current_scores(s: SparkSession, d: str) -> DataFrame:
    bills, n = views.invoices(s, d), F.col("invoice_id")
    stored = bills.select("business_id", "invoice_id", F.when(n % 9 == 1, F.coalesce("customer_id", F.lit(0)) + 1).otherwise(F.col("customer_id")).alias("customer_id"), F.col("invoice_date").alias("scored_at"), F.lit(0.25).alias("risk"))
    fresh = bills.filter(n % 3 == 0).select("business_id", "invoice_id", "customer_id", F.col("invoice_date").alias("scored_at"), F.lit(0.75).alias("risk"))
    return models.upsert_scores(models.still_valid(stored, bills), fresh).select("business_id", "invoice_id", "customer_id", "risk")
