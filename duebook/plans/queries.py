"""The registered receivables queries and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, features, history, identity, ingest, receivables
from ..streaming import run, tasks
from . import views
from .views import TODAY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_VIEWS = f"""
WITH inv AS (
  SELECT CAST(c.c_nationkey AS INT) AS business_id, o_orderkey AS invoice_id, CASE WHEN o_orderkey % 40 <> 0 THEN o_custkey END AS customer_id,
    CAST(o_totalprice AS DECIMAL(14,2)) AS amount, CAST(o_orderdate AS DATE) AS invoice_date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 15 WHEN '3-MEDIUM' THEN 30 WHEN '4-NOT SPECIFIED' THEN 45 WHEN '5-LOW' THEN 60 END AS terms,
    CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 15 WHEN '3-MEDIUM' THEN 30 WHEN '4-NOT SPECIFIED' THEN 45 WHEN '5-LOW' THEN 60 END END AS due_date,
    CASE WHEN CAST(o_orderdate AS DATE) < DATE '2001-01-01' THEN 'HISTORICAL' ELSE 'CURRENT' END AS origin
  FROM orders JOIN customer c ON o_custkey = c_custkey),
pay AS (
  SELECT l_orderkey AS invoice_id, CAST(l_shipdate AS DATE) AS paid_on, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(14,2)) AS amount
  FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{TODAY}' GROUP BY 1, 2),
tot AS (SELECT invoice_id, CAST(sum(amount) AS DECIMAL(14,2)) AS paid FROM pay GROUP BY 1),
bill AS (
  SELECT inv.*, coalesce(paid, 0) AS paid, CASE WHEN coalesce(paid, 0) <= 0 THEN 'OPEN' WHEN paid >= amount THEN 'PAID' ELSE 'PARTIAL' END AS status,
    CAST(greatest(amount - coalesce(paid, 0), 0) AS DECIMAL(14,2)) AS outstanding,
    CASE WHEN inv.invoice_id % 97 = 0 THEN 'NEEDS_REVIEW' WHEN inv.invoice_id % 89 = 0 THEN 'PENDING' ELSE 'PROCESSED' END AS processing
  FROM inv LEFT JOIN tot ON inv.invoice_id = tot.invoice_id),
owed AS (
  SELECT *, date_diff('day', due_date, DATE '{TODAY}') AS past_due FROM bill WHERE origin = 'CURRENT' AND processing = 'PROCESSED' AND outstanding > 0 AND status IN ('OPEN', 'PARTIAL')),
run AS (SELECT invoice_id, paid_on, sum(amount) OVER (PARTITION BY invoice_id ORDER BY paid_on) AS running FROM pay),
stl AS (SELECT run.invoice_id, min(paid_on) AS settled_on FROM run JOIN inv ON run.invoice_id = inv.invoice_id WHERE running >= amount GROUP BY 1),
outc AS (
  SELECT inv.*, settled_on, date_diff('day', due_date, settled_on) AS delay, greatest(settled_on, invoice_date) AS seen
  FROM inv JOIN stl ON inv.invoice_id = stl.invoice_id WHERE customer_id IS NOT NULL AND due_date IS NOT NULL),
hist AS (
  SELECT p.business_id, p.customer_id, p.invoice_id, count(o.delay) AS settled, coalesce(sum(CASE WHEN o.delay > 0 THEN 1 ELSE 0 END), 0) AS late, avg(o.delay) AS avg_delay, median(o.delay) AS median_delay,
    min(o.delay) AS min_delay, max(o.delay) AS max_delay, stddev_samp(o.delay) AS std_delay, date_diff('day', max(o.settled_on), p.invoice_date) AS days_since_payment, (list(o.delay ORDER BY o.settled_on DESC, o.invoice_id DESC) FILTER (o.delay IS NOT NULL))[1:3] AS last3
  FROM inv p LEFT JOIN outc o ON p.business_id = o.business_id AND p.customer_id = o.customer_id AND o.seen < p.invoice_date
  WHERE p.customer_id IS NOT NULL GROUP BY p.business_id, p.customer_id, p.invoice_id, p.invoice_date),
prior AS (
  SELECT p.invoice_id, count(q.invoice_id) AS prior_invoices, date_diff('day', max(q.invoice_date), p.invoice_date) AS days_since_invoice
  FROM inv p LEFT JOIN inv q ON p.business_id = q.business_id AND p.customer_id = q.customer_id AND q.invoice_date < p.invoice_date
  WHERE p.customer_id IS NOT NULL GROUP BY p.invoice_id, p.invoice_date),
est AS (
  SELECT hist.business_id, hist.invoice_id, (late + 1) / CAST(settled + 2 AS DOUBLE) AS raw, round((late + 1) / CAST(settled + 2 AS DOUBLE), 4) AS risk,
    CASE WHEN (late + 1) / CAST(settled + 2 AS DOUBLE) < 0.30 THEN 'LOW' WHEN (late + 1) / CAST(settled + 2 AS DOUBLE) < 0.65 THEN 'MEDIUM' ELSE 'HIGH' END AS tier,
    invoice_date + CAST(round_even(greatest(0.0, terms + CASE WHEN prior_invoices < 3 THEN 0.0 ELSE median_delay END), 0) AS INT) AS expected
  FROM hist JOIN prior ON hist.invoice_id = prior.invoice_id JOIN inv ON hist.invoice_id = inv.invoice_id WHERE settled >= 3),
oe AS (SELECT owed.*, risk, tier, expected FROM owed LEFT JOIN est ON owed.invoice_id = est.invoice_id),
dated AS (
  SELECT *, CASE WHEN basis = 'model' THEN expected WHEN basis = 'due_date' THEN due_date END AS onday FROM (
    SELECT *, CASE WHEN expected >= DATE '{TODAY}' THEN 'model' WHEN expected IS NOT NULL THEN 'past_predicted' WHEN due_date IS NULL THEN 'undated' WHEN due_date >= DATE '{TODAY}' THEN 'due_date' ELSE 'overdue_unestimated' END AS basis FROM oe)),
wk AS (SELECT *, CASE WHEN date_diff('day', DATE '{TODAY}', onday) // 7 < 8 THEN date_diff('day', DATE '{TODAY}', onday) // 7 END AS week FROM dated)
"""


def _query(sql: str | None = None, views_first: bool = True):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (_VIEWS if views_first else "") + sql
        return f

    return register


def _outstanding(s: SparkSession, d: str) -> DataFrame:
    return views.outstanding(views.bills(s, d))


def _estimates(s: SparkSession, d: str) -> DataFrame:
    bills = views.kept_bills(s, d)
    return history.predictions(bills, history.history_as_of(bills, count=views.size(s, d, "orders")))


def _open_and_estimates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The open invoices, and estimates of them alone; both from one ledger."""
    bills = views.bills(s, d)
    owed = views.outstanding(bills)
    return owed, history.predictions(owed, history.history_as_of(bills, owed))


@_query("""SELECT b.business_id, b.bucket, CAST(coalesce(sum(outstanding), 0) AS DECIMAL(18,2)) AS amount, count(outstanding) AS n
FROM (SELECT DISTINCT business_id, bucket FROM owed, (VALUES ('current'), ('1-30'), ('31-60'), ('61-90'), ('90+')) t(bucket)) b
LEFT JOIN owed ON owed.business_id = b.business_id AND b.bucket = CASE WHEN past_due <= 0 THEN 'current' WHEN past_due <= 30 THEN '1-30' WHEN past_due <= 60 THEN '31-60' WHEN past_due <= 90 THEN '61-90' WHEN past_due > 90 THEN '90+' END GROUP BY 1, 2""")
def aging_summary(s: SparkSession, d: str) -> DataFrame:
    return receivables.aging_summary(_outstanding(s, d))


@_query("SELECT business_id, status, origin, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, CAST(sum(paid) AS DECIMAL(18,2)) AS paid FROM bill GROUP BY 1, 2, 3")
def payment_status(s: SparkSession, d: str) -> DataFrame:
    money = [F.sum(c).cast("decimal(18,2)").alias(c) for c in ("amount", "paid")]
    return views.bills(s, d).groupBy("business_id", "status", "origin").agg(F.count("*").alias("n"), *money)


_SEGMENTS = {"overdue": "past_due > 0", "due_soon": "past_due BETWEEN -7 AND 0", "high_risk": "tier = 'HIGH'", "expected": f"expected BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 30", "undated": "due_date IS NULL"}


@_query("SELECT business_id, CAST(sum(outstanding) AS DECIMAL(18,2)) AS outstanding_amount, count(*) AS outstanding_n, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN {v} THEN outstanding END), 0) AS DECIMAL(18,2)) AS {k}_amount, count(CASE WHEN {v} THEN 1 END) AS {k}_n" for k, v in _SEGMENTS.items()) + " FROM oe GROUP BY 1")
def dashboard_segments(s: SparkSession, d: str) -> DataFrame:
    return receivables.dashboard(*_open_and_estimates(s, d), TODAY)


@_query("""SELECT business_id, place, invoice_id, score, reasons FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY score DESC, due_date ASC NULLS LAST, invoice_id) AS place FROM (
SELECT *, round(CAST(outstanding AS DOUBLE) * (CASE WHEN past_due IS NULL THEN 0.25::DOUBLE WHEN past_due > 0 THEN 1::DOUBLE + least(past_due, 90) / 30::DOUBLE WHEN past_due >= -7 THEN 0.5::DOUBLE + (7 + past_due) / 14::DOUBLE ELSE 0.25::DOUBLE END * CASE WHEN risk IS NOT NULL THEN 0.5::DOUBLE + risk ELSE 1::DOUBLE END), 4) AS score,
concat_ws('; ', CASE WHEN past_due > 0 THEN past_due || CASE WHEN past_due = 1 THEN ' day' ELSE ' days' END || ' overdue' WHEN past_due = 0 THEN 'Due today' WHEN past_due >= -7 THEN 'Due in ' || (-past_due) || CASE WHEN past_due = -1 THEN ' day' ELSE ' days' END END,
CASE WHEN tier = 'HIGH' THEN 'High late-payment risk (' || CAST(round(risk * 100, 0) AS INT) || '%)' END, CASE WHEN status = 'PARTIAL' THEN 'Partially paid' END) AS reasons FROM oe)) WHERE place <= 5""")
def priority_ranking(s: SparkSession, d: str) -> DataFrame:
    return receivables.priority(*_open_and_estimates(s, d))


@_query("SELECT invoice_id, settled_on FROM stl")
def first_settlement(s: SparkSession, d: str) -> DataFrame:
    return history.settlements(views.bills(s, d))


@_query("""SELECT hist.business_id, hist.customer_id, hist.invoice_id, settled, CAST(late AS BIGINT) AS late, CASE WHEN settled > 0 THEN round(late / CAST(settled AS DOUBLE), 6) END AS late_rate, round(avg_delay, 6) AS avg_delay, CAST(median_delay AS DOUBLE) AS median_delay,
min_delay, max_delay, round(CASE WHEN settled = 1 THEN 0.0::DOUBLE ELSE std_delay END, 6) AS std_delay, days_since_payment, prior_invoices, days_since_invoice, CAST(CASE WHEN prior_invoices < 3 THEN 1 ELSE 0 END AS BIGINT) AS is_new_customer, settled >= 3 AS estimates_ready, round(list_avg(last3), 6) AS last3_mean_delay, round(len([x for x in last3 if x > 0]) / nullif(CAST(len(last3) AS DOUBLE), 0), 6) AS last3_late_rate FROM hist JOIN prior ON hist.invoice_id = prior.invoice_id""")
def history_as_of(s: SparkSession, d: str) -> DataFrame:
    return history.history_as_of(views.bills(s, d))


@_query("""SELECT business_id, customer_id, count(*) AS n, round(avg(delay), 6) AS mean_delay, round(avg(CASE WHEN delay > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS late_rate FROM (
SELECT *, row_number() OVER (PARTITION BY business_id, customer_id ORDER BY settled_on DESC, invoice_id DESC) AS k FROM outc) WHERE k <= 3 GROUP BY 1, 2""")
def recent_outcomes(s: SparkSession, d: str) -> DataFrame:
    return history.recent_outcomes(views.bills(s, d))


@_query("SELECT business_id, invoice_id, risk, tier, expected FROM est")
def baseline_estimates(s: SparkSession, d: str) -> DataFrame:
    return _estimates(s, d)


@_query("""SELECT b.business_id, CAST(b.week AS BIGINT) AS week, CAST(coalesce(sum(outstanding), 0) AS DECIMAL(18,2)) AS total, CAST(coalesce(sum(CASE WHEN basis = 'model' THEN outstanding END), 0) AS DECIMAL(18,2)) AS predicted,
CAST(coalesce(sum(CASE WHEN basis = 'due_date' THEN outstanding END), 0) AS DECIMAL(18,2)) AS due_dated, CAST(coalesce(sum(CASE WHEN tier = 'HIGH' THEN outstanding END), 0) AS DECIMAL(18,2)) AS high_risk, count(outstanding) AS n
FROM (SELECT DISTINCT business_id, week FROM owed, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) t(week)) b LEFT JOIN wk ON wk.business_id = b.business_id AND wk.week = b.week GROUP BY 1, 2""")
def cash_flow_weeks(s: SparkSession, d: str) -> DataFrame:
    return receivables.cash_flow_weeks(*_open_and_estimates(s, d), TODAY)


@_query("SELECT business_id, CASE WHEN onday IS NULL THEN basis ELSE 'beyond_horizon' END AS bucket, CAST(sum(outstanding) AS DECIMAL(18,2)) AS amount, count(*) AS n FROM wk WHERE onday IS NULL OR week IS NULL GROUP BY 1, 2")
def cash_flow_unscheduled(s: SparkSession, d: str) -> DataFrame:
    return receivables.cash_flow_unscheduled(*_open_and_estimates(s, d), TODAY)


@_query("""SELECT business_id, CAST(sum(outstanding) AS DECIMAL(18,2)) AS outstanding, CAST(coalesce(sum(CASE WHEN week IS NOT NULL THEN outstanding END), 0) AS DECIMAL(18,2)) AS scheduled, CAST(coalesce(sum(CASE WHEN basis = 'model' THEN outstanding END), 0) AS DECIMAL(18,2)) AS model_dated,
CAST(coalesce(sum(CASE WHEN basis = 'due_date' THEN outstanding END), 0) AS DECIMAL(18,2)) AS due_date_dated, round(CAST(sum(CASE WHEN tier IS NOT NULL THEN outstanding ELSE 0 END) AS DOUBLE) / CAST(sum(outstanding) AS DOUBLE), 4) AS model_coverage FROM wk GROUP BY 1""")
def cash_flow_totals(s: SparkSession, d: str) -> DataFrame:
    return receivables.cash_flow_totals(*_open_and_estimates(s, d), TODAY)


@_query(f"SELECT business_id, expected, CAST(sum(outstanding) AS DECIMAL(18,2)) AS amount, count(*) AS n, string_agg(CAST(invoice_id AS VARCHAR), ',' ORDER BY invoice_id) AS invoices FROM oe WHERE expected BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 30 GROUP BY 1, 2")
def expected_schedule(s: SparkSession, d: str) -> DataFrame:
    return receivables.expected_schedule(*_open_and_estimates(s, d), TODAY)


_BALANCES = f"""SELECT *, round(CAST(outstanding AS DOUBLE) / CAST(sum(outstanding) OVER (PARTITION BY business_id) AS DOUBLE), 4) AS share FROM (
SELECT business_id, coalesce('customer:' || customer_id, 'unmatched') AS party, CAST(sum(outstanding) AS DECIMAL(18,2)) AS outstanding, CAST(coalesce(sum(CASE WHEN past_due > 0 THEN outstanding END), 0) AS DECIMAL(18,2)) AS overdue, count(*) AS open_n, count(CASE WHEN past_due > 0 THEN 1 END) AS overdue_n,
max(CASE WHEN past_due > 0 THEN past_due END) AS oldest, min(CASE WHEN due_date >= DATE '{TODAY}' THEN due_date END) AS next_due, min(CASE WHEN expected >= DATE '{TODAY}' THEN expected END) AS next_expected, CAST(max(CASE tier WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 END) AS BIGINT) AS risk_rank FROM oe GROUP BY 1, 2)"""


@_query(_BALANCES)
def customer_balances(s: SparkSession, d: str) -> DataFrame:
    return receivables.customer_balances(*_open_and_estimates(s, d), TODAY)


@_query(f"SELECT business_id, max(CASE WHEN k = 1 THEN share END) AS top_share, round(sum(share), 4) AS top_five_share FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY outstanding DESC, party) AS k FROM ({_BALANCES}) WHERE outstanding > 0) WHERE k <= 5 GROUP BY 1")
def concentration(s: SparkSession, d: str) -> DataFrame:
    return receivables.concentration(customer_balances(s, d))


@_query("SELECT business_id, customer_id, count(*) AS settled, round(avg(CASE WHEN delay <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS on_time_rate, round(avg(delay), 1) AS average_days_late, count(*) >= 3 AS estimates_ready FROM outc GROUP BY 1, 2")
def payment_record(s: SparkSession, d: str) -> DataFrame:
    return receivables.payment_record(views.bills(s, d))


@_query("""SELECT b.business_id, b.customer_id, n, billed, last_invoice, coalesce(p.paid, 0)::DECIMAL(18,2) AS paid, last_payment, greatest(billed - coalesce(p.paid, 0), 0)::DECIMAL(18,2) AS "open" FROM (SELECT business_id, customer_id, count(*) AS n, sum(amount)::DECIMAL(18,2) AS billed, max(invoice_date) AS last_invoice FROM inv WHERE origin = 'HISTORICAL' AND customer_id IS NOT NULL GROUP BY 1, 2) b
LEFT JOIN (SELECT business_id, customer_id, sum(pay.amount)::DECIMAL(18,2) AS paid, max(paid_on) AS last_payment FROM inv JOIN pay ON inv.invoice_id = pay.invoice_id WHERE customer_id IS NOT NULL GROUP BY 1, 2) p ON b.business_id = p.business_id AND b.customer_id = p.customer_id""")
def historical_companies(s: SparkSession, d: str) -> DataFrame:
    return receivables.historical_companies(views.invoices(s, d), views.payments(s, d))


@_query(f"SELECT invoice_id, business_id, amount, due_date, status FROM bill WHERE status IN ('OPEN', 'PARTIAL') AND due_date < DATE '{TODAY}' ORDER BY due_date DESC NULLS LAST, invoice_date DESC, invoice_id LIMIT 50 OFFSET 100")
def invoice_list_page(s: SparkSession, d: str) -> DataFrame:
    return receivables.invoice_page(views.bills(s, d), TODAY, "overdue", descending=True, offset=100).select("invoice_id", "business_id", "amount", "due_date", "status")


@_query("""SELECT invoice_id, round(ln(1 + greatest(CAST(amount AS DOUBLE), 0)), 6) AS log_amount, month(invoice_date) AS month, day(invoice_date) AS day, isodow(invoice_date) - 1 AS weekday, quarter(invoice_date) AS quarter, CAST(CASE WHEN isodow(invoice_date) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS weekend,
month(due_date) AS due_month, isodow(due_date) - 1 AS due_weekday, CAST(CASE WHEN isodow(due_date) >= 6 THEN 1 WHEN due_date IS NOT NULL THEN 0 END AS BIGINT) AS due_weekend, date_diff('day', invoice_date, due_date) AS term_days FROM inv""")
def calendar_features(s: SparkSession, d: str) -> DataFrame:
    rows = features.calendar_features(views.invoices(s, d))
    features.assert_no_leakage(rows.columns)
    return rows


_TARGETS = "SELECT inv.invoice_id, CASE WHEN settled_on IS NULL THEN 'OPEN' ELSE 'PAID' END AS status, date_diff('day', due_date, settled_on) AS delay_days, CAST(date_diff('day', due_date, settled_on) > 0 AS BIGINT) AS is_late, date_diff('day', invoice_date, settled_on) AS days_until_payment FROM inv LEFT JOIN stl ON inv.invoice_id = stl.invoice_id"


@_query(_TARGETS)
def targets(s: SparkSession, d: str) -> DataFrame:
    return features.targets(views.bills(s, d))


@_query(f"SELECT count(delay_days) AS n, count(CASE WHEN delay_days <= 0 THEN 1 END) AS on_time, count(CASE WHEN delay_days > 0 THEN 1 END) AS late, count(CASE WHEN delay_days < 0 THEN 1 END) AS early, count(CASE WHEN delay_days = 0 THEN 1 END) AS exact, round(100.0::DOUBLE * count(CASE WHEN delay_days > 0 THEN 1 END) / count(delay_days), 4) AS late_percent, round(100.0::DOUBLE * count(CASE WHEN delay_days <= 0 THEN 1 END) / count(delay_days), 4) AS on_time_percent FROM ({_TARGETS})")
def target_summary(s: SparkSession, d: str) -> DataFrame:
    return features.target_summary(targets(s, d))


def _closed(s: SparkSession, d: str) -> DataFrame:
    return targets(s, d).select("invoice_id", "status").join(views.invoices(s, d).select("invoice_id", "invoice_date"), "invoice_id")


@_query("""SELECT invoice_id, CASE WHEN settled_on IS NULL THEN 'open_inference' WHEN invoice_date < c1 THEN 'train' WHEN invoice_date < c2 THEN 'validation' ELSE 'test' END AS split FROM (SELECT inv.invoice_id, invoice_date, settled_on FROM inv LEFT JOIN stl ON inv.invoice_id = stl.invoice_id),
(SELECT min(CASE WHEN k = CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN invoice_date END) AS c1, min(CASE WHEN k = CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN invoice_date END) AS c2 FROM (SELECT invoice_date, row_number() OVER (ORDER BY invoice_date, inv.invoice_id) - 1 AS k, count(*) OVER () AS n FROM inv JOIN stl ON inv.invoice_id = stl.invoice_id))""")
def temporal_split(s: SparkSession, d: str) -> DataFrame:
    return features.temporal_split(_closed(s, d))


@_query("SELECT count(amount) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, round(skewness(x), 4) AS skew, " + ", ".join(f"round(quantile_cont(x, {q}), 4) AS {k}" for k, q in {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}.items()) + " FROM (SELECT amount, CAST(amount AS DOUBLE) AS x FROM inv)")
def amount_distribution(s: SparkSession, d: str) -> DataFrame:
    return features.distribution(views.invoices(s, d), "amount")


@_query("SELECT count(*) AS rows, count(*) - count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS exact_duplicates, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS key_duplicates FROM lineitem", False)
def duplicate_report(s: SparkSession, d: str) -> DataFrame:
    return features.duplicate_report(views.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM inv" for c in ("business_id", "invoice_id", "customer_id", "amount", "invoice_date", "terms", "due_date", "origin")).join(["SELECT * FROM (", ")"]))
def column_profile(s: SparkSession, d: str) -> DataFrame:
    return features.column_profile(views.invoices(s, d))


@_query("SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS band, count(*) AS customers, CAST(sum(n) AS BIGINT) AS invoices FROM (SELECT customer_id, count(*) AS n FROM inv WHERE customer_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def customer_histogram(s: SparkSession, d: str) -> DataFrame:
    return features.customer_histogram(views.invoices(s, d))


@_query("SELECT row_number() OVER (ORDER BY invoices DESC, customer_id) AS place, customer_id, invoices, round(invoices / CAST(total AS DOUBLE), 6) AS share FROM (SELECT customer_id, count(*) AS invoices, sum(count(*)) OVER () AS total FROM inv GROUP BY 1) WHERE customer_id IS NOT NULL QUALIFY place <= 5")
def top_customers(s: SparkSession, d: str) -> DataFrame:
    return features.top_customers(views.invoices(s, d))


_SPLIT = """(SELECT invoice_id, CASE WHEN settled_on IS NULL THEN 'open_inference' WHEN invoice_date < c1 THEN 'train' WHEN invoice_date < c2 THEN 'validation' ELSE 'test' END AS split FROM (SELECT inv.invoice_id, invoice_date, settled_on FROM inv LEFT JOIN stl ON inv.invoice_id = stl.invoice_id),
(SELECT min(CASE WHEN k = CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN invoice_date END) AS c1, min(CASE WHEN k = CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN invoice_date END) AS c2 FROM (SELECT invoice_date, row_number() OVER (ORDER BY invoice_date, inv.invoice_id) - 1 AS k, count(*) OVER () AS n FROM inv JOIN stl ON inv.invoice_id = stl.invoice_id)))"""


@_query(f"SELECT inv.invoice_id, terms, coalesce(code, -1.0)::DOUBLE AS code FROM inv LEFT JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS code FROM (SELECT DISTINCT CAST(terms AS VARCHAR) AS t FROM inv JOIN {_SPLIT} s ON s.invoice_id = inv.invoice_id WHERE split = 'train')) ON t = CAST(terms AS VARCHAR)")
def ordinal_encoder(s: SparkSession, d: str) -> DataFrame:
    rows = views.invoices(s, d).select("invoice_id", "terms", F.col("terms").cast("string").alias("category"))
    train = rows.join(temporal_split(s, d).filter("split = 'train'"), "invoice_id")
    return features.ordinal_codes(train, rows, "category").select("invoice_id", "terms", "code")


@_query(f"SELECT coalesce(round(median(avg_delay), 6), 0) AS avg_delay, coalesce(round(median(CAST(median_delay AS DOUBLE)), 6), 0) AS median_delay, coalesce(round(median(CAST(days_since_payment AS DOUBLE)), 6), 0) AS days_since_payment FROM (SELECT invoice_id, round(avg_delay, 6) AS avg_delay, median_delay, days_since_payment FROM hist) h JOIN {_SPLIT} s ON s.invoice_id = h.invoice_id WHERE split = 'train'")
def train_medians(s: SparkSession, d: str) -> DataFrame:
    rows = history_as_of(s, d).join(temporal_split(s, d).filter("split = 'train'"), "invoice_id")
    return features.train_medians(rows, ["avg_delay", "median_delay", "days_since_payment"])


_LABELLED = "SELECT est.invoice_id, raw AS score, CASE WHEN delay > 0 THEN 1 ELSE 0 END AS label FROM est JOIN outc ON est.invoice_id = outc.invoice_id"


def _labelled(s: SparkSession, d: str) -> DataFrame:
    bills = views.kept_bills(s, d)
    scores = history.history_as_of(bills, count=views.size(s, d, "orders")).filter("estimates_ready").select("invoice_id", ((F.col("late") + 1) / (F.col("settled") + 2)).alias("score"))
    return scores.join(features.targets(bills).filter("is_late IS NOT NULL").select("invoice_id", F.col("is_late").alias("label"), "days_until_payment"), "invoice_id")


@_query(f"""SELECT tn, fp, fn, tp, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS "precision", round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1, roc_auc, average_precision FROM
(SELECT count(CASE WHEN label = 0 AND score < 0.5 THEN 1 END) AS tn, count(CASE WHEN label = 0 AND score >= 0.5 THEN 1 END) AS fp, count(CASE WHEN label = 1 AND score < 0.5 THEN 1 END) AS fn, count(CASE WHEN label = 1 AND score >= 0.5 THEN 1 END) AS tp FROM ({_LABELLED})),
(SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * CAST(sum(1 - label) AS DOUBLE)), 6) AS roc_auc FROM (SELECT label, (min(k) OVER (PARTITION BY score) + max(k) OVER (PARTITION BY score)) / 2.0::DOUBLE AS r FROM (SELECT *, row_number() OVER (ORDER BY score) AS k FROM ({_LABELLED})))),
(SELECT round(sum(pos * CAST(sp AS DOUBLE) / sn) / sum(pos), 6) AS average_precision FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS sp, sum(n) OVER (ORDER BY score DESC) AS sn FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM ({_LABELLED}) GROUP BY 1)))""")
def classification_metrics(s: SparkSession, d: str) -> DataFrame:
    return evaluation.classification(_labelled(s, d))


@_query("SELECT count(*) AS n, round(avg(e), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(median(e), 4) AS median_ae FROM (SELECT abs(CAST(date_diff('day', outc.invoice_date, settled_on) AS DOUBLE) - date_diff('day', outc.invoice_date, expected)) AS e FROM est JOIN outc ON est.invoice_id = outc.invoice_id)")
def timing_metrics(s: SparkSession, d: str) -> DataFrame:
    bills = views.invoices(s, d).select("invoice_id", "invoice_date")
    rows = _estimates(s, d).join(bills, "invoice_id").select("invoice_id", F.datediff("expected", "invoice_date").alias("predicted"))
    return evaluation.regression(rows.join(_labelled(s, d).select("invoice_id", F.col("days_until_payment").alias("actual")), "invoice_id"))


@_query(f"SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed FROM ({_LABELLED}) GROUP BY 1")
def calibration_bins(s: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration(_labelled(s, d))


@_query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS hits, CAST(greatest(count(*) - 3, 0) AS BIGINT) AS refused FROM events GROUP BY 1, 2", False)
def rate_limit_windows(s: SparkSession, d: str) -> DataFrame:
    return ingest.rate_limited(views.table(s, d, "events"))


@_query("SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) > 1 AS duplicate FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity FROM lineitem)", False)
def in_file_duplicates(s: SparkSession, d: str) -> DataFrame:
    names = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    rows = views.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *names)
    return ingest.natural_key_duplicates(rows, ["l_orderkey", "l_linenumber"], names)


@_query("""SELECT c_nationkey AS nation, c_mktsegment AS segment, CAST(base + CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY round(x - base, 9) DESC, c_mktsegment) <= 100 - sum(base) OVER (PARTITION BY c_nationkey) THEN 1 ELSE 0 END AS BIGINT) AS percent FROM (SELECT *, floor(x) AS base FROM (SELECT c_nationkey, c_mktsegment, 100 * n / CAST(sum(n) OVER (PARTITION BY c_nationkey) AS DOUBLE) AS x FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)))""", False)
def whole_percentages(s: SparkSession, d: str) -> DataFrame:
    rows = views.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return ingest.whole_percentages(rows, "nation", "segment", "n")


@_query("SELECT count(DISTINCT customer_id) FILTER (o > 0 AND p > 0) AS both_sets, count(DISTINCT customer_id) FILTER (o > 0 AND p = 0) AS open_only, count(DISTINCT customer_id) FILTER (o = 0) AS closed_only FROM (SELECT customer_id, count(CASE WHEN status <> 'PAID' THEN 1 END) AS o, count(CASE WHEN status = 'PAID' THEN 1 END) AS p FROM bill WHERE customer_id IS NOT NULL GROUP BY 1)")
def customer_sets(s: SparkSession, d: str) -> DataFrame:
    rows = views.bills(s, d).filter("customer_id IS NOT NULL").groupBy("customer_id").agg(F.count_if(F.expr("status <> 'PAID'")).alias("o"), F.count_if(F.expr("status = 'PAID'")).alias("p"))
    return rows.agg(F.count_if(F.expr("o > 0 AND p > 0")).alias("both_sets"), F.count_if(F.expr("o > 0 AND p = 0")).alias("open_only"), F.count_if(F.expr("o = 0")).alias("closed_only"))


@_query(SQL["rate_limit_windows"], False)
def rate_limit_stream(s: SparkSession, d: str) -> DataFrame:
    return run.finished(tasks.window_counts(run.file_stream(s, d, "events")), "hits", "update", keys=["user_id", "window_start"])


@_query("""WITH c AS (SELECT c_nationkey AS business_id, c_custkey AS customer_id, lower(trim(c_name)) AS ref, lower(c_mktsegment) || ' ' || c_custkey % 9 || ' private limited' AS name FROM customer),
o AS (SELECT o_orderkey AS invoice_id, business_id, CASE WHEN o_orderkey % 3 = 0 THEN customer_id END AS customer_id, CASE WHEN o_orderkey % 3 = 1 THEN ref END AS ref, name FROM orders JOIN c ON o_custkey = customer_id),
u AS (SELECT business_id, name, min(customer_id) AS only_id FROM c GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT business_id, ref, min(customer_id) AS ref_id FROM c GROUP BY 1, 2 HAVING count(*) = 1)
SELECT o.invoice_id, coalesce(o.customer_id, ref_id, only_id) AS resolved_id, CASE WHEN o.customer_id IS NOT NULL THEN 'id' WHEN ref_id IS NOT NULL THEN 'reference' WHEN only_id IS NOT NULL THEN 'name' END AS resolved_by
FROM o LEFT JOIN u ON o.business_id = u.business_id AND o.name = u.name LEFT JOIN r ON o.business_id = r.business_id AND o.ref = r.ref""", False)
def identity_cascade(s: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 9).cast("string"), F.lit("Pvt. Ltd."))
    customers = views.table(s, d, "customer").select(F.col("c_nationkey").alias("business_id"), F.col("c_custkey").alias("customer_id"), F.lit(None).cast("string").alias("gstin"), F.col("c_name").alias("reference"), name.alias("name"))
    orders = views.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id")).join(customers, "customer_id").withColumn("part", F.col("o_orderkey") % 3)
    rows = orders.select(
        F.col("o_orderkey").alias("invoice_id"), "business_id", F.when(F.col("part") == 0, F.col("customer_id")).alias("customer_id"), "gstin",
        F.when(F.col("part") == 1, F.concat(F.lit(" "), F.upper("reference"))).alias("reference"), "name",
    )
    return identity.resolve(rows, customers).select("invoice_id", "resolved_id", "resolved_by")
