"""Registered queries: the ERP export, its cleaning, audit, features and splits, with their SQL.

The export is written as CSV from the orders, with repeats, flawed days and foreign document types in it, and
read back; the SQL says the same of the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import dealt
from ..operators import cleaning, features, history
from ..sources import files
from . import views
from .queries import _query


def _rendered(s: SparkSession, d: str) -> DataFrame:
    n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = views.table(s, d, "orders").join(views.table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    terms = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in views.TERMS.items()))
    cleared = F.when(n % 5 != 0, F.date_add(day, (n % 60).cast("int")))
    compact = lambda c: F.concat(F.date_format(c, "yyyyMMdd"), F.lit(".0"))
    rows = rows.select(
        F.concat(F.lit(" U"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).alias("business_code"), F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit(" ")).alias("cust_number"), F.col("c_name").alias("name_customer"),
        F.when(n % 113 == 0, "n/a").otherwise(F.concat(F.date_format(cleared, "M/d/yyyy"), F.lit(" 0:00"))).alias("clear_date"), F.year(day).cast("string").alias("buisness_year"), n.cast("string").alias("doc_id"),
        F.date_format(day, "MM/dd/yyyy").alias("posting_date"), F.date_format(day, "yyyyMMdd").alias("document_create_date"), F.date_format(day, "yyyyMMdd").alias("document_create_date.1"), compact(F.date_add(day, terms)).alias("due_in_date"),
        F.when(n % 7 == 0, "CAD ").otherwise("USD").alias("invoice_currency"), F.when(n % 41 == 0, "X2").when(n % 43 != 0, "RV").alias("document type"), F.lit("1").alias("posting_id"), F.lit(None).cast("string").alias("area_business"),
        F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("total_open_amount"), F.when(n % 70 == 0, "soon").otherwise(compact(F.date_add(day, (n % 4).cast("int")))).alias("baseline_create_date"),
        F.concat(F.lit("NA"), F.substring("o_orderpriority", 1, 1)).alias("cust_payment_terms"), n.cast("string").alias("invoice_id"), F.when(n % 5 == 0, "1").otherwise("0").alias("isOpen"),
    )
    return rows.unionByName(rows.filter(F.col("doc_id").cast("long") % 29 == 0))


def export(s: SparkSession, d: str) -> DataFrame:
    return files.read_erp(s, files.write_csv(_rendered(s, d), files.shared_path(s, "erp")))


_ERP = """WITH o AS (
  SELECT o_orderkey AS n, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 15 WHEN '3-MEDIUM' THEN 30 WHEN '4-NOT SPECIFIED' THEN 45 WHEN '5-LOW' THEN 60 END AS due,
    CASE WHEN o_orderkey % 113 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) END AS clear, CASE WHEN o_orderkey % 70 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) END AS base,
    o_orderkey % 113 <> 0 AND o_orderkey % 5 = 0 AS uncleared, CASE WHEN o_orderkey % 7 = 0 THEN 'CAD' ELSE 'USD' END AS currency, CASE WHEN o_orderkey % 41 = 0 THEN 'X2' WHEN o_orderkey % 43 <> 0 THEN 'RV' END AS kind,
    CAST(o_totalprice AS DECIMAL(14,2)) AS amount, o_custkey, c_nationkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
raw AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE n % 29 = 0),
can AS (
  SELECT CAST(n AS VARCHAR) AS invoice_id, 'U' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS business_code, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS customer_id, c_name AS customer_name, day AS invoice_date, due AS due_date, base AS baseline_date,
    clear AS clear_date, CAST(amount AS DOUBLE) AS amount, currency, 'NA' || o_orderpriority[1] AS payment_terms, coalesce(date_diff('day', base, due), date_diff('day', day, due)) AS term_days, date_diff('day', day, due) AS days_until_due,
    CASE WHEN clear IS NULL THEN 'OPEN' ELSE 'PAID' END AS status, date_diff('day', due, clear) AS delay_days, CAST(date_diff('day', due, clear) > 0 AS BIGINT) AS is_late, date_diff('day', day, clear) AS days_until_payment
  FROM o WHERE kind IS NULL OR kind <> 'X2'),
cuts AS (SELECT min(CASE WHEN k = CAST(floor(t * 0.7::DOUBLE) AS BIGINT) THEN invoice_date END) AS c1, min(CASE WHEN k = CAST(floor(t * 0.85::DOUBLE) AS BIGINT) THEN invoice_date END) AS c2 FROM (SELECT invoice_date, row_number() OVER (ORDER BY invoice_date, invoice_id) - 1 AS k, count(*) OVER () AS t FROM can WHERE status = 'PAID')),
spl AS (SELECT can.*, CASE WHEN status = 'OPEN' THEN 'open_inference' WHEN invoice_date < c1 THEN 'train' WHEN invoice_date < c2 THEN 'validation' ELSE 'test' END AS split FROM can, cuts),
past AS (
  SELECT p.invoice_id, count(q.delay_days) AS settled, coalesce(sum(CASE WHEN q.delay_days > 0 THEN 1 ELSE 0 END), 0) AS late, avg(q.delay_days) AS avg_delay, median(q.delay_days) AS median_delay, min(q.delay_days) AS min_delay, max(q.delay_days) AS max_delay, stddev_samp(q.delay_days) AS std_delay,
    date_diff('day', max(q.clear_date), p.invoice_date) AS days_since_payment, (list(q.delay_days ORDER BY q.clear_date DESC, q.invoice_id DESC) FILTER (q.delay_days IS NOT NULL))[1:3] AS last3
  FROM can p LEFT JOIN can q ON p.customer_id = q.customer_id AND q.clear_date < p.invoice_date GROUP BY p.invoice_id, p.invoice_date),
before AS (SELECT p.invoice_id, count(q.invoice_id) AS prior_invoices, date_diff('day', max(q.invoice_date), p.invoice_date) AS days_since_invoice FROM can p LEFT JOIN can q ON p.customer_id = q.customer_id AND q.invoice_date < p.invoice_date GROUP BY p.invoice_id, p.invoice_date),
feat AS (
  SELECT past.invoice_id, split, settled, CAST(late AS BIGINT) AS late, round(late / nullif(CAST(settled AS DOUBLE), 0), 6) AS late_rate, round(avg_delay, 6) AS avg_delay, CAST(median_delay AS DOUBLE) AS median_delay, CAST(min_delay AS DOUBLE) AS min_delay, CAST(max_delay AS DOUBLE) AS max_delay,
    round(CASE WHEN settled = 1 THEN 0.0::DOUBLE ELSE std_delay END, 6) AS std_delay, CAST(days_since_payment AS DOUBLE) AS days_since_payment, prior_invoices, CAST(days_since_invoice AS DOUBLE) AS days_since_invoice, CAST(prior_invoices < 3 AS BIGINT) AS is_new_customer,
    round(list_avg(last3), 6) AS last3_mean_delay, round(len([x for x in last3 if x > 0]) / nullif(CAST(len(last3) AS DOUBLE), 0), 6) AS last3_late_rate
  FROM past JOIN before ON before.invoice_id = past.invoice_id JOIN spl ON spl.invoice_id = past.invoice_id)
"""


@_query(_ERP + "SELECT * FROM can", False)
def erp_canonical(s: SparkSession, d: str) -> DataFrame:
    return cleaning.chronological(cleaning.canonical(export(s, d)))


@_query(_ERP + """SELECT raw_rows, raw_rows - kept AS duplicates_removed, x2_removed, canonical_rows, paid_rows, open_rows, customers, first_day, last_day FROM (SELECT count(*) AS kept, count(CASE WHEN kind = 'X2' THEN 1 END) AS x2_removed FROM o), (SELECT count(*) AS raw_rows FROM raw),
(SELECT count(*) AS canonical_rows, count(CASE WHEN status = 'PAID' THEN 1 END) AS paid_rows, count(CASE WHEN status = 'OPEN' THEN 1 END) AS open_rows, count(DISTINCT customer_id) AS customers, min(invoice_date) AS first_day, max(invoice_date) AS last_day FROM can)""", False)
def erp_statistics(s: SparkSession, d: str) -> DataFrame:
    raw = export(s, d)
    return cleaning.cleaning_statistics(raw, cleaning.canonical(raw))


@_query(_ERP + "SELECT CASE WHEN n % 5 = 0 THEN '1' ELSE '0' END AS is_open, uncleared, count(*) AS n, (n % 5 = 0) = uncleared AS agrees FROM raw GROUP BY ALL", False)
def erp_status_crosstab(s: SparkSession, d: str) -> DataFrame:
    return cleaning.status_crosstab(export(s, d))


@_query(_ERP + " UNION ALL ".join(f"SELECT '{name}' AS name, {value} AS value, count(*) AS n FROM raw WHERE {value} IS NOT NULL GROUP BY 2" for name, value in {"invoice_currency": "CASE WHEN n % 7 = 0 THEN 'CAD ' ELSE 'USD' END", "business_code": "' U' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0')", "document type": "kind", "cust_payment_terms": "'NA' || o_orderpriority[1]"}.items()), False)
def erp_categories(s: SparkSession, d: str) -> DataFrame:
    return cleaning.category_counts(export(s, d), ["invoice_currency", "business_code", "document type", "cust_payment_terms"])


@_query(_ERP + ", a AS (SELECT count(CASE WHEN due < day THEN 1 END) AS due_before_posting FROM raw) " + " UNION ALL ".join(f"SELECT due_before_posting, '{name}' AS name, min({c}) AS first_day, max({c}) AS last_day, CAST(count(CASE WHEN {bad} THEN 1 END) AS BIGINT) AS failed FROM raw, a GROUP BY 1" for name, c, bad in (("posting_date", "day", "false"), ("due_in_date", "due", "false"), ("clear_date", "clear", "n % 113 = 0"), ("baseline_create_date", "base", "n % 70 = 0"))), False)
def erp_date_audit(s: SparkSession, d: str) -> DataFrame:
    return cleaning.date_audit(export(s, d))


@_query(_ERP + " UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS type, count(*) - count({c}) AS nulls, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_percent, count(DISTINCT {c}) AS distinct_values FROM can" for c, t in (("invoice_id", "string"), ("customer_id", "string"), ("invoice_date", "date"), ("baseline_date", "date"), ("clear_date", "date"), ("currency", "string"), ("delay_days", "bigint"))), False)
def erp_column_report(s: SparkSession, d: str) -> DataFrame:
    rows = cleaning.canonical(export(s, d))
    return cleaning.column_report(rows.select("invoice_id", "customer_id", "invoice_date", "baseline_date", "clear_date", "currency", "delay_days"))


def _split(rows: DataFrame) -> DataFrame:
    return rows.join(features.temporal_split(rows.select("invoice_id", "invoice_date", "status")), "invoice_id")


@_query(_ERP + "SELECT split, count(*) AS n, min(invoice_date) AS first_day, max(invoice_date) AS last_day, true AS as_listed FROM spl GROUP BY 1", False)
def erp_splits(s: SparkSession, d: str) -> DataFrame:
    path = files.write_splits(_split(cleaning.canonical(export(s, d))), files.shared_path(s, "splits"))
    rows, manifest = files.read_splits(s, path)
    found = rows.groupBy("split").agg(F.count("*").alias("n"), F.min("invoice_date").alias("first_day"), F.max("invoice_date").alias("last_day"))
    listed = manifest.select("split", F.col("n").alias("listed"))
    return found.join(listed, "split").select("split", "n", "first_day", "last_day", (F.col("n") == F.col("listed")).alias("as_listed"))


IMPUTED = ["late_rate", "avg_delay", "median_delay", "min_delay", "max_delay", "std_delay", "days_since_payment", "days_since_invoice", "last3_mean_delay", "last3_late_rate"]


def training_features(rows: DataFrame, count: int | None = None) -> DataFrame:
    """History features of canonical rows (``count`` at most, if known) by the training rule: an outcome counts from its clearing day, whoever the tenant is."""
    ledger = rows.select(F.lit(0).alias("business_id"), "invoice_id", F.col("customer_id").cast("long").alias("customer_id"), "invoice_date", "due_date", F.col("clear_date").alias("settled_on"))
    past = history.history_as_of(ledger, cleared=True, count=count)
    number = [F.col(c).cast("double").alias(c) for c in IMPUTED]
    return past.select("invoice_id", "settled", "late", "prior_invoices", "is_new_customer", *number)


@_query(_ERP + "SELECT * FROM feat", False)
def training_history(s: SparkSession, d: str) -> DataFrame:
    n = views.size(s, d, "orders")
    # cleaned once; equal rows of the export have one number, so they meet in one task
    rows = cleaning.canonical(dealt(export(s, d), n, "doc_id")).select("invoice_id", "customer_id", "invoice_date", "due_date", "clear_date", "status")
    rows = files.kept(rows, "canonical")
    return training_features(rows, n).join(dealt(_split(rows).select("invoice_id", "split"), n, "invoice_id"), "invoice_id")


@_query(_ERP + ", med AS (SELECT " + ", ".join(f"coalesce(round(median({c}), 6), 0) AS {c}" for c in IMPUTED) + " FROM feat WHERE split = 'train') SELECT invoice_id, split, " + ", ".join(f"coalesce(feat.{c}, med.{c}) AS {c}" for c in IMPUTED) + " FROM feat, med", False)
def imputed_features(s: SparkSession, d: str) -> DataFrame:
    rows = files.kept(training_history(s, d), "features")
    medians = features.train_medians(rows.filter("split = 'train'"), IMPUTED)
    return cleaning.impute(rows, medians).select("invoice_id", "split", *IMPUTED)
