"""Registered queries: lists, search, pages, company reports and diagnostics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import dealt
from ..operators import diagnostics, history, listing, receivables
from ..sources.files import kept
from . import views
from .queries import _estimates, _open_and_estimates, _query
from .views import TODAY

_NAME = "lower(trim(regexp_replace(regexp_replace({0}, '[.,;:()\\[\\]{{}}]+', ' ', 'g'), '\\s+', ' ', 'g')))"
_MORE = f""",
cust AS (SELECT CAST(c_nationkey AS INT) AS business_id, c_custkey AS customer_id, c_name AS display_name,
  lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || translate(lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHIJ') || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'K1Z' AS stem FROM customer),
lst AS (SELECT bill.*, 'INV-' || invoice_id AS number, invoice_date AS created_at,
  CASE WHEN business_id % 3 = 0 THEN CASE WHEN invoice_id % 11 = 0 THEN 'usd' WHEN invoice_id % 13 <> 0 THEN 'INR' END WHEN business_id % 3 = 1 THEN 'eur' END AS currency,
  CASE WHEN customer_id IS NULL THEN 'Acme. ' || invoice_id % 7 || ' Pvt. Ltd.' END AS unresolved_name FROM bill),
doc AS (SELECT business_id, invoice_id, invoice_date + CAST(invoice_id % 5 AS INT) AS stored_at FROM inv WHERE invoice_id % 3 = 0),
named AS (SELECT lst.*, display_name, coalesce(stored_at, created_at) AS uploaded FROM lst LEFT JOIN cust ON cust.business_id = lst.business_id AND cust.customer_id = lst.customer_id LEFT JOIN doc ON doc.invoice_id = lst.invoice_id),
spay AS (SELECT CAST(c_nationkey AS INT) AS business_id, l_orderkey AS invoice_id, CAST(l_shipdate AS DATE) AS paid_on, CASE l_returnflag WHEN 'N' THEN 'import' WHEN 'A' THEN 'manual' WHEN 'R' THEN 'proof_verified' END AS provenance,
  CASE WHEN l_orderkey % 30 = 0 THEN 'customer:' || (o_custkey + 1) WHEN l_orderkey % 40 <> 0 THEN 'customer:' || o_custkey END AS customer_key, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(14,2)) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE CAST(l_shipdate AS DATE) <= DATE '{TODAY}' GROUP BY 1, 2, 3, 4, 5),
owe AS (SELECT lst.*, date_diff('day', due_date, DATE '{TODAY}') AS past_due FROM lst WHERE origin = 'CURRENT' AND processing = 'PROCESSED' AND outstanding > 0 AND status IN ('OPEN', 'PARTIAL'))
"""


def _owed(s: SparkSession, d: str) -> DataFrame:
    return views.outstanding(views.listed(s, d))


def _named(s: SparkSession, d: str) -> DataFrame:
    return listing.with_parties(views.listed(s, d), views.customers(s, d), views.documents(s, d))


_PAGE = ["business_id", "place", "total", "invoice_id"]


@_query(_MORE + f"""SELECT business_id, aging, count(*) AS n, CAST(sum(outstanding) AS DECIMAL(18,2)) AS amount FROM (SELECT *, unnest([x for x in [
CASE WHEN due_date >= DATE '{TODAY}' THEN 'current' END, CASE WHEN due_date BETWEEN DATE '{TODAY}' - 30 AND DATE '{TODAY}' - 1 THEN '1-30' END, CASE WHEN due_date BETWEEN DATE '{TODAY}' - 60 AND DATE '{TODAY}' - 31 THEN '31-60' END, CASE WHEN due_date BETWEEN DATE '{TODAY}' - 90 AND DATE '{TODAY}' - 61 THEN '61-90' END,
CASE WHEN due_date < DATE '{TODAY}' - 90 THEN '90+' END, CASE WHEN due_date < DATE '{TODAY}' THEN 'overdue' END, CASE WHEN due_date BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7 THEN 'due-soon' END] if x IS NOT NULL]) AS aging FROM bill WHERE status IN ('OPEN', 'PARTIAL')) GROUP BY 1, 2""")
def aging_windows(s: SparkSession, d: str) -> DataFrame:
    return listing.aging_window_totals(views.bills(s, d), TODAY)


@_query(_MORE + """SELECT business_id, place, total, invoice_id, coalesce(display_name, unresolved_name) AS party FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY uploaded ASC NULLS LAST, created_at DESC, invoice_id) AS place, count(*) OVER (PARTITION BY business_id) AS total FROM named
WHERE status IN ('OPEN', 'PARTIAL') AND origin = 'HISTORICAL' AND (lower(number) LIKE '%acme. 3%' OR coalesce(lower(unresolved_name) LIKE '%acme. 3%', false) OR coalesce(lower(display_name) LIKE '%acme. 3%', false))) WHERE place <= 50""")
def invoice_search(s: SparkSession, d: str) -> DataFrame:
    page = listing.list_invoices(_named(s, d), TODAY, status="outstanding", origin="historical", needle=" Acme. 3", sort="uploaded", direction="asc")
    return page.select(*_PAGE, "party")


@_query(_MORE + """SELECT business_id, place, total, invoice_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY amount DESC NULLS LAST, created_at DESC, invoice_id) AS place, count(*) OVER (PARTITION BY business_id) AS total FROM named
WHERE (business_id, invoice_id) IN (SELECT (business_id, invoice_id) FROM est WHERE tier = 'HIGH')) WHERE place BETWEEN 6 AND 15""")
def high_risk_page(s: SparkSession, d: str) -> DataFrame:
    return listing.list_invoices(_named(s, d), TODAY, risk="high", estimates=_estimates(s, d), sort="amount", offset=5, limit=10).select(*_PAGE, "amount")


@_query(_MORE + "SELECT bill.business_id, coalesce(tier, 'UNAVAILABLE') AS risk, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM bill LEFT JOIN est ON est.business_id = bill.business_id AND est.invoice_id = bill.invoice_id GROUP BY 1, 2")
def invoices_by_risk(s: SparkSession, d: str) -> DataFrame:
    bills, n = views.kept_bills(s, d), views.size(s, d, "orders")
    estimates = history.predictions(bills, history.history_as_of(bills, count=n))
    rows = listing.with_risk(dealt(bills.select("business_id", "invoice_id", "amount"), n, "business_id", "invoice_id"), estimates)
    return rows.groupBy("business_id", "risk").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount"))


@_query(_MORE + """SELECT business_id, place, total, invoice_id, tier FROM (SELECT est.*, row_number() OVER (PARTITION BY est.business_id ORDER BY invoice_date DESC, est.invoice_id) AS place, count(*) OVER (PARTITION BY est.business_id) AS total
FROM est JOIN inv ON inv.invoice_id = est.invoice_id AND inv.business_id = est.business_id WHERE tier <> 'LOW') WHERE place BETWEEN 11 AND 20""")
def prediction_page(s: SparkSession, d: str) -> DataFrame:
    bills = views.kept_bills(s, d)
    past = kept(history.history_as_of(bills, count=views.size(s, d, "orders")).select("business_id", "invoice_id", "settled", "late", "median_delay", "is_new_customer", "estimates_ready"), "past")
    stored = history.predictions(bills, past).filter("tier <> 'LOW'").join(bills.select("business_id", "invoice_id", F.col("invoice_date").alias("created_at")), ["business_id", "invoice_id"])
    stored = kept(stored, "stored")  # ranked and counted apart
    return listing.gated_page(stored, past, offset=10, limit=10).select(*_PAGE, "tier")


@_query(_MORE + "SELECT business_id, currency, mixed FROM (SELECT business_id, CASE WHEN count(DISTINCT coalesce(upper(currency), 'INR')) = 1 THEN min(coalesce(upper(currency), 'INR')) ELSE 'INR' END AS currency, count(DISTINCT coalesce(upper(currency), 'INR')) > 1 AS mixed FROM owe GROUP BY 1)")
def currency_summary(s: SparkSession, d: str) -> DataFrame:
    return listing.currency_summary(_owed(s, d))


@_query(_MORE + "SELECT business_id, provenance, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM spay WHERE amount > 0 GROUP BY 1, 2")
def eligible_payments(s: SparkSession, d: str) -> DataFrame:
    return listing.eligible_payments(views.sourced_payments(s, d)).groupBy("business_id", "provenance").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount"))


@_query(_MORE + "SELECT business_id, invoice_id, reason IS NULL AS ready, reason FROM (SELECT *, CASE WHEN processing <> 'PROCESSED' THEN 'processing' WHEN amount IS NULL OR amount <= 0 THEN 'amount' WHEN invoice_date IS NULL OR due_date IS NULL THEN 'dates' END AS reason FROM lst)")
def scoring_readiness(s: SparkSession, d: str) -> DataFrame:
    return listing.scoring_readiness(views.listed(s, d))


@_query(_MORE + """SELECT business_id, customer_id, display_name FROM cust WHERE (lower(display_name) LIKE '%1_5%' OR lower(stem) LIKE '%1_5%') AND ((business_id, customer_id) IN (SELECT (business_id, customer_id) FROM inv WHERE origin = 'HISTORICAL' AND customer_id IS NOT NULL)
OR (business_id, 'customer:' || customer_id) IN (SELECT (business_id, customer_key) FROM spay WHERE provenance = 'import' AND customer_key IS NOT NULL))""")
def company_search(s: SparkSession, d: str) -> DataFrame:
    # the check digit is no part of what is sought here
    customers = views.customers(s, d).withColumn("gstin", F.expr("substring(gstin, 1, 14)"))
    return listing.companies(customers, views.invoices(s, d), views.sourced_payments(s, d), " 1_5").select("business_id", "customer_id", "display_name")


@_query(_MORE + """SELECT business_id, invoice_id, place, payload, parsed_at FROM (SELECT lst.business_id, lst.invoice_id, row_number() OVER (PARTITION BY lst.business_id ORDER BY created_at DESC, lst.invoice_id) AS place, payload, parsed_at FROM lst
LEFT JOIN (SELECT l_orderkey AS invoice_id, 'seller ' || l_suppkey AS payload, CAST(l_shipdate AS DATE) AS parsed_at, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_partkey * 1000 + l_linenumber DESC, 'seller ' || l_suppkey DESC) AS k FROM lineitem) t ON t.invoice_id = lst.invoice_id AND k = 1
WHERE origin = 'HISTORICAL' AND processing = 'NEEDS_REVIEW')""")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    return listing.review_queue(views.listed(s, d), views.parse_tasks(s, d)).select("business_id", "invoice_id", "place", "payload", "parsed_at")


_NOW = "2001-06-01 00:05:00"


@_query(f"""SELECT o_orderkey AS task_id, 'stale' AS kind FROM orders WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 600) < TIMESTAMP '{_NOW}' - INTERVAL 300 SECONDS
UNION ALL (SELECT o_orderkey, 'pending' FROM orders WHERE o_orderstatus = 'O' ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 100)""", False)
def due_tasks(s: SparkSession, d: str) -> DataFrame:
    return listing.due_tasks(views.work(s, d), _NOW).select("task_id", "kind")


_LINE = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


@_query(f"SELECT l_orderkey, l_linenumber, {', '.join(_LINE)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in _LINE)}) AS k FROM lineitem) WHERE k = 1", False)
def latest_lines(s: SparkSession, d: str) -> DataFrame:
    rows = views.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *_LINE)
    return listing.keep_latest(rows, ["l_orderkey", "l_linenumber"], [F.desc(c) for c in _LINE])


@_query(_MORE + "SELECT spay.business_id, spay.invoice_id, paid_on, provenance, coalesce(customer_key, 'customer:' || customer_id) AS customer_key, spay.amount FROM spay LEFT JOIN inv ON inv.invoice_id = spay.invoice_id")
def backfilled_keys(s: SparkSession, d: str) -> DataFrame:
    return listing.backfilled_keys(views.payments_by_invoice(s, d), views.invoices(s, d))


@_query(_MORE + "SELECT owe.business_id, owe.customer_id, CAST(sum(outstanding) AS DECIMAL(18,2)) AS outstanding, row_number() OVER (PARTITION BY owe.business_id ORDER BY sum(outstanding) DESC, lower(min(display_name)), owe.customer_id) AS place FROM owe JOIN cust ON cust.customer_id = owe.customer_id AND cust.business_id = owe.business_id GROUP BY 1, 2")
def customer_ranking(s: SparkSession, d: str) -> DataFrame:
    balances = _owed(s, d).filter("customer_id IS NOT NULL").groupBy("business_id", "customer_id").agg(F.sum("outstanding").cast("decimal(18,2)").alias("outstanding"))
    return listing.ranked_customers(balances, views.customers(s, d))


@_query(_MORE + "SELECT business_id, 'unmatched:acme ' || invoice_id % 7 || ' private limited' AS party, CAST(sum(outstanding) AS DECIMAL(18,2)) AS outstanding, count(*) AS n FROM owe WHERE customer_id IS NULL GROUP BY 1, 2")
def unmatched_balances(s: SparkSession, d: str) -> DataFrame:
    return listing.unmatched_balances(_owed(s, d))


@_query(_MORE + """SELECT business_id, invoice_id, CASE WHEN coalesce(upper(currency), 'INR') = 'INR' THEN '₹' ELSE upper(currency) || ' ' END || format('{:,.2f}', CAST(outstanding AS DOUBLE)) AS money,
CASE WHEN past_due IS NULL THEN 'No due date' WHEN past_due > 0 THEN past_due || CASE WHEN past_due = 1 THEN ' day' ELSE ' days' END || ' overdue' WHEN past_due = 0 THEN 'Due today' ELSE 'Due in ' || (-past_due) || CASE WHEN past_due = -1 THEN ' day' ELSE ' days' END END AS due,
CASE WHEN past_due = 0 THEN 'on the due date' WHEN past_due > 0 THEN past_due || CASE WHEN past_due = 1 THEN ' day' ELSE ' days' END || ' after the due date' WHEN past_due < 0 THEN (-past_due) || CASE WHEN past_due = -1 THEN ' day' ELSE ' days' END || ' before the due date' END AS relative FROM """
    + f"(SELECT *, date_diff('day', due_date, DATE '{TODAY}') AS past_due FROM lst WHERE origin = 'CURRENT' AND outstanding > 0 AND status IN ('OPEN', 'PARTIAL'))")
def invoice_labels(s: SparkSession, d: str) -> DataFrame:
    late = F.col("past_due")
    return views.unpaid(views.listed(s, d)).select("business_id", "invoice_id", listing.money_text(F.col("outstanding"), F.col("currency")).alias("money"), listing.due_label(late).alias("due"), listing.relative_to_due(late).alias("relative"))


@_query("SELECT CAST(ts + INTERVAL 330 MINUTES AS DATE) AS day, count(*) AS n FROM events GROUP BY 1", False)
def business_days(s: SparkSession, d: str) -> DataFrame:
    return views.table(s, d, "events").groupBy(listing.business_date(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


@_query("""SELECT business_id, coalesce('week ' || week, CASE WHEN onday IS NULL THEN basis ELSE 'beyond_horizon' END) AS bucket, string_agg(CAST(invoice_id AS VARCHAR), ',' ORDER BY CASE WHEN week IS NOT NULL THEN onday END, -outstanding, invoice_id) AS items FROM wk GROUP BY 1, 2""")
def week_items(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.week_items(receivables._dated(*_open_and_estimates(s, d), TODAY, 8))


_MISMATCH = "SELECT DISTINCT inv.business_id, inv.invoice_id FROM inv JOIN spay ON spay.invoice_id = inv.invoice_id WHERE customer_id IS NOT NULL AND customer_key IS NOT NULL AND customer_key <> 'customer:' || customer_id"
_SELLER = "SELECT inv.business_id, inv.invoice_id FROM inv JOIN (SELECT c_nationkey AS b, min(c_custkey) AS k FROM customer GROUP BY 1) ON b = inv.business_id AND k = inv.customer_id"


@_query(_MORE + _MISMATCH)
def payment_mismatches(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.payment_mismatches(views.invoices(s, d), views.payments_by_invoice(s, d))


@_query(_MORE + _SELLER)
def seller_as_customer(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.seller_as_customer(views.invoices(s, d), views.customers(s, d), views.tenants(s, d))


@_query(_MORE + f"SELECT business_id, invoice_id, 'seller stored as customer' AS reason FROM ({_SELLER}) UNION ALL SELECT business_id, invoice_id, 'payment names another customer' FROM ({_MISMATCH}) m WHERE invoice_id NOT IN (SELECT invoice_id FROM ({_SELLER}))")
def identity_report(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.identity_report(views.invoices(s, d), views.payments_by_invoice(s, d), views.customers(s, d), views.tenants(s, d))


@_query(_MORE + """SELECT b AS business_id, stored.invoice_id, CASE WHEN reason IS NOT NULL THEN 'ambiguous' WHEN settled >= 3 THEN 'eligible' ELSE 'ineligible' END AS outcome, reason FROM (
SELECT st.b, st.i AS invoice_id, settled, CASE WHEN inv.invoice_id IS NULL THEN 'invoice is missing' WHEN inv.business_id <> st.b THEN 'tenants differ' END AS reason FROM
(SELECT CASE WHEN invoice_id % 37 = 0 THEN business_id + 1 ELSE business_id END AS b, CASE WHEN invoice_id % 53 = 0 THEN -invoice_id - 1 ELSE invoice_id END AS i FROM inv WHERE invoice_date IS NOT NULL) st
LEFT JOIN inv ON inv.invoice_id = st.i LEFT JOIN hist ON hist.invoice_id = st.i AND hist.business_id = st.b) stored""")
def estimate_audit(s: SparkSession, d: str) -> DataFrame:
    bills, n = views.bills(s, d), F.col("invoice_id")
    stored = bills.select(F.when(n % 37 == 0, F.col("business_id") + 1).otherwise(F.col("business_id")).alias("business_id"), F.when(n % 53 == 0, -n - 1).otherwise(n).alias("invoice_id"))
    return diagnostics.audit_estimates(stored, bills, views.customers(s, d), history.history_as_of(bills))


@_query(_MORE + "SELECT business_id, 'invoices' AS name, count(*) AS n FROM inv GROUP BY 1 UNION ALL SELECT business_id, 'payments', count(*) FROM spay GROUP BY 1 UNION ALL SELECT business_id, 'customers', count(*) FROM cust GROUP BY 1")
def row_counts(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.row_counts(invoices=views.invoices(s, d), payments=views.sourced_payments(s, d), customers=views.customers(s, d))


@_query()
def similar_names(s: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    return diagnostics.similar_names(views.table(s, d, "part").select(F.col("p_type").alias("group"), name.alias("name")).distinct())
