"""Registered queries: invoices and payment proofs as texts, read back, with SQL over the tables they were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, proofs
from . import views
from .queries import _query
from .views import TODAY


def _invoice_texts(s: SparkSession, d: str) -> DataFrame:
    n = F.col("invoice_id")
    rows = views.invoices(s, d)
    due = F.when(n % 3 == 0, F.concat(F.lit("Due Date : "), F.date_format(F.date_add("invoice_date", F.col("terms")), "dd/MM/yyyy"))).otherwise(F.concat(F.lit("Payment terms: Net "), F.col("terms").cast("string")))
    money = F.concat(F.when(n % 2 == 0, "Grand Total: ₹ ").otherwise("Total amount (INR) - "), F.format_number("amount", 2))
    return rows.select("business_id", "invoice_id", F.concat_ws("\n", F.lit("TAX   INVOICE"), F.concat(F.lit("Invoice No: INV–"), n.cast("string")), F.concat(F.lit("Invoice\tDate: "), F.date_format("invoice_date", "d MMM yyyy")), due, F.lit("Sub items 3"), F.when(n % 50 != 0, money), F.concat(F.lit("Bill to: Acme "), (n % 9).cast("string"))).alias("text"))


@_query("""SELECT invoice_id, 'INV-' || invoice_id AS number, invoice_date, invoice_date + terms AS due_date, CASE WHEN invoice_id % 50 <> 0 THEN amount END AS total, CASE WHEN invoice_id % 50 <> 0 THEN 'INR' END AS currency, 'Acme ' || invoice_id % 9 AS buyer, CASE WHEN invoice_id % 50 = 0 THEN 'total' ELSE '' END AS missing FROM inv""")
def invoice_fields(s: SparkSession, d: str) -> DataFrame:
    return documents.invoice_fields(_invoice_texts(s, d)).select("invoice_id", "number", "invoice_date", "due_date", F.col("total").cast(views.MONEY).alias("total"), "currency", "buyer", "missing")


def _layout_texts(s: SparkSession, d: str) -> DataFrame:
    """Invoices in eight layouts; in most of them the first label that fits is the wrong one."""
    n = F.col("invoice_id")
    day = lambda c, pattern: F.date_format(F.col(c) if isinstance(c, str) else c, pattern)
    later = lambda days: F.date_add("invoice_date", days)
    said = lambda label, value: F.concat(F.lit(label), value)
    rows = views.invoices(s, d).withColumn("due", F.date_add("invoice_date", F.col("terms")))
    id_, plain, grouped, terms = n.cast("string"), F.col("amount").cast("string"), F.format_number("amount", 2), F.col("terms").cast("string")
    buyer, seller = F.concat(F.lit("Acme "), (n % 9).cast("string"), F.lit(" Traders")), F.concat(F.lit("House "), F.col("business_id").cast("string"), F.lit(" Ltd"))
    layouts = [
        [F.lit("TAX INVOICE"), said("Seller: ", seller), said("Bill To: ", buyer), said("Invoice No: INV-", id_), said("Date: ", day(later(9), "d/M/yyyy")), said("Invoice Date: ", day("invoice_date", "d MMM yyyy")), said("Due Date: ", day("due", "dd-MM-yyyy")), F.lit("Total: 5"), said("Grand Total: ₹ ", grouped)],
        [F.lit("Invoice No"), said("BILL-", id_), F.lit("Invoice Date"), day("invoice_date", "yyyy-MM-dd"), said("Terms: Net ", terms), F.lit("Buyer"), buyer, F.lit("Total"), said("INR ", plain)],
        [said("Invoice: A/", id_), said("Bill Date: ", day(later(1), "dd.MM.yyyy")), said("Issue Date: ", day(later(3), "MMMM d, yyyy")), said("Payment due: ", day(later(70), "yyyy/MM/dd")), said("Pay by: ", day(later(80), "yyyy/MM/dd")), said("Sold to: ", buyer), said("Balance due $", plain)],
        [said("Bill no. B", id_), said("Due Date: ", day(later(-4), "d-M-yyyy")), said("Inv Date: ", day(later(2), "d-M-yyyy")), said("Date of issue: ", day("invoice_date", "d-M-yyyy")), said("Due by: ", day("due", "d-M-yyyy")), F.lit("Customer details"), F.lit("GSTIN: none"), buyer, said("Net total EUR ", plain)],
        [said("From: ", seller), said("Bill to: ", seller), buyer, F.concat(F.lit("About SI-"), id_, F.lit("-2001 as agreed")), said("Document date: ", day("invoice_date", "dd/MM/yyyy")), F.lit("Cash on delivery"), said("Amount due: Rs. ", grouped), F.lit("Invoice total: Rs. 12")],
        [said("Invoice No: S", id_), said("Date: ", F.regexp_replace(day("invoice_date", "dd/MM/yyyy"), "(?<=[1-9])0(?=[1-9])", "O")), F.lit("within 10 days"), F.lit("Credit terms: within 10 days"), said("M/s. ", buyer), said("Total payable GBP ", F.regexp_replace(plain, "(?<=[02-9])1(?=[02-9])", "l"))],
        [said("Invoice No: INV-", id_), said("Invoice Date: ", day("invoice_date", "d MMMM yyyy")), said("Due on: ", day("due", "d MMMM yyyy")), said("CGST @ 9%: ", F.lit("90.00")), F.lit("Sub total 1,000"), said("Order no. PO", id_), said("Total amount (USD) - ", plain)],
        [F.lit("Ref: 12/05/2001"), said("Invoice Date: ", day("invoice_date", "M-d-yyyy")), F.lit("Credit period 400 days"), said("Client: ", buyer), said("Final amount ", plain)],
    ]
    text = F.coalesce(*(F.when(n % 8 == k, F.concat_ws("\n", *lines)) for k, lines in enumerate(layouts)))
    return rows.select("business_id", "invoice_id", text.alias("text"))


#: Candidates of each layout with their scores; the best is taken by score, as in the operator.
_LAYOUTS = r""",
k AS (SELECT *, invoice_id % 8 AS k, invoice_date + terms AS due, strftime(invoice_date, '%d/%m/%Y') AS dmy, CAST(amount AS VARCHAR) AS plain FROM inv),
c AS (SELECT *,
  CASE k WHEN 0 THEN [{'s': 0.98 - 5 * 0.015, 'v': invoice_date + 9}, {'s': 0.98, 'v': invoice_date}] WHEN 1 THEN [{'s': 0.98, 'v': invoice_date}] WHEN 2 THEN [{'s': 0.98 - 4 * 0.015, 'v': invoice_date + 1}, {'s': 0.98 - 2 * 0.015, 'v': invoice_date + 3}]
    WHEN 3 THEN [{'s': 0.98 - 5 * 0.015, 'v': invoice_date + 2}, {'s': 0.98 - 3 * 0.015, 'v': invoice_date}] WHEN 4 THEN [{'s': 0.98 - 5 * 0.015, 'v': invoice_date}] WHEN 5 THEN [{'s': 0.98 - 5 * 0.015, 'v': invoice_date}] WHEN 6 THEN [{'s': 0.98, 'v': invoice_date}]
    WHEN 7 THEN [{'s': 0.98, 'v': CASE WHEN day(invoice_date) <= 12 THEN make_date(year(invoice_date), day(invoice_date), month(invoice_date)) ELSE invoice_date END}] END AS issued,
  CASE k WHEN 0 THEN [{'s': 0.98, 'v': due}] WHEN 2 THEN [{'s': 0.98 - 2 * 0.015, 'v': invoice_date + 70}, {'s': 0.98 - 4 * 0.015, 'v': invoice_date + 80}] WHEN 3 THEN [{'s': 0.98, 'v': invoice_date - 4}, {'s': 0.98 - 5 * 0.015, 'v': due}] WHEN 6 THEN [{'s': 0.98 - 3 * 0.015, 'v': due}] END AS dues,
  CASE k WHEN 1 THEN terms WHEN 4 THEN 0 WHEN 5 THEN 10 END AS term,
  CASE k WHEN 0 THEN [{'s': 0.823, 'v': 5.00}, {'s': 1.0, 'v': amount}] WHEN 4 THEN [{'s': least(1.0, 0.97 + least(0.03, length(CAST(floor(amount) AS BIGINT)::VARCHAR) * 0.003)), 'v': amount}, {'s': 0.98 + 0.006, 'v': 12.00}]
    ELSE [{'s': least(1.0, CASE k WHEN 1 THEN 0.82 WHEN 2 THEN 0.96 WHEN 3 THEN 0.95 WHEN 5 THEN 0.98 WHEN 6 THEN 0.98 WHEN 7 THEN 0.97 END + least(0.03, length(CAST(floor(amount) AS BIGINT)::VARCHAR) * 0.003)), 'v': amount}] END AS totals
  FROM k),
b AS (SELECT *, (SELECT arg_max(u.v, u.s) FROM (SELECT unnest(issued) AS u)) AS on_day, (SELECT max(u.s) FROM (SELECT unnest(issued) AS u)) AS on_score, (SELECT arg_max(u.v, u.s) FROM (SELECT unnest(totals) AS u)) AS total, (SELECT max(u.s) FROM (SELECT unnest(totals) AS u)) AS total_score FROM c),
e AS (SELECT *, (SELECT arg_max(v, s) FROM (SELECT u.v AS v, u.s - CASE WHEN u.v < on_day THEN 0.55 ELSE 0.0 END AS s FROM (SELECT unnest(dues) AS u)) WHERE s >= 0.6) AS said_due, (SELECT max(s) FROM (SELECT u.s - CASE WHEN u.v < on_day THEN 0.55 ELSE 0.0 END AS s FROM (SELECT unnest(dues) AS u)) WHERE s >= 0.6) AS said_score FROM b),
f AS (SELECT invoice_id, business_id, k, CASE k WHEN 0 THEN 'INV-' || invoice_id WHEN 1 THEN 'BILL-' || invoice_id WHEN 2 THEN 'A/' || invoice_id WHEN 3 THEN 'B' || invoice_id WHEN 4 THEN 'SI-' || invoice_id || '-2001' WHEN 5 THEN 'S' || invoice_id WHEN 6 THEN 'INV-' || invoice_id END AS said_number,
  CASE k WHEN 4 THEN 0.90 ELSE 0.98 END AS number_score, on_day AS invoice_date, on_score, coalesce(said_due, on_day + term) AS due_date, coalesce(said_score, CASE WHEN term IS NOT NULL THEN 0.82 END) AS due_score, CAST(total AS DECIMAL(14,2)) AS total, total_score,
  CASE k WHEN 0 THEN 'INR' WHEN 1 THEN 'INR' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 4 THEN 'INR' WHEN 5 THEN 'GBP' WHEN 6 THEN 'USD' END AS currency, CASE k WHEN 2 THEN 0.99 - 0.03 WHEN 6 THEN 0.9 - 0.03 ELSE 0.99 END AS currency_score,
  CASE WHEN k <> 6 THEN 'Acme ' || invoice_id % 9 || ' Traders' END AS buyer, CASE k WHEN 1 THEN 0.86 WHEN 3 THEN 0.86 WHEN 4 THEN 0.86 ELSE 0.95 END AS buyer_score,
  CASE WHEN k IN (0, 4) THEN 'House ' || business_id || ' Ltd' END AS seller, CASE WHEN k = 6 THEN 'PO' || invoice_id END AS order_number, CASE WHEN k = 6 THEN 90.00 END AS cgst, CASE WHEN k = 6 THEN 1000.00 END AS subtotal FROM e),
g AS (SELECT *, CASE WHEN length(regexp_replace(said_number, '\W', '', 'g')) >= 3 THEN said_number END AS number FROM f)
"""


@_query(_LAYOUTS + """SELECT invoice_id, number, invoice_date, due_date, total, currency, buyer, seller, order_number, CAST(cgst AS DECIMAL(14,2)) AS cgst, CAST(subtotal AS DECIMAL(14,2)) AS subtotal,
  concat_ws(',', CASE WHEN number IS NULL THEN 'number' END, CASE WHEN buyer IS NULL THEN 'buyer' END, CASE WHEN due_date IS NULL THEN 'due_date' END) AS missing,
  floor(1000 * (CASE WHEN k = 5 THEN 0.85 ELSE 1.0 END * (total_score + coalesce(CASE WHEN number IS NOT NULL THEN number_score END, 0) + on_score + coalesce(due_score, 0) + CASE WHEN buyer IS NOT NULL THEN buyer_score ELSE 0 END + CASE WHEN currency IS NOT NULL THEN currency_score ELSE 0 END)
    / (2 + CASE WHEN number IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN due_score IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN buyer IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN currency IS NOT NULL THEN 1 ELSE 0 END)) + 0.5) / 1000 AS confidence FROM g""")
def invoice_layouts(s: SparkSession, d: str) -> DataFrame:
    rows = _layout_texts(s, d)
    found = documents.invoice_fields(rows, scanned=F.col("invoice_id") % 8 == 5)
    seller = F.when(F.col("seller_score") > 0.9, F.col("seller")).alias("seller")
    money = [F.col(c).cast(views.MONEY).alias(c) for c in ("total", "cgst", "subtotal")]
    return found.select("invoice_id", "number", "invoice_date", "due_date", "currency", "buyer", seller, "order_number", *money, "missing", "confidence")


def _readings(s: SparkSession, d: str) -> DataFrame:
    """Up to three readings of each invoice: layers with better and worse labels, scans, fragments."""
    n = F.col("invoice_id")
    head = F.concat(F.lit("Invoice No: INV-"), n.cast("string"), F.lit("\nBuyer: Acme Traders\nTerms: Net 30\n"))
    issued, money = F.date_format("invoice_date", "dd MMM yyyy"), F.concat(F.lit("\nGrand total INR "), F.col("amount").cast("string"))
    exact, vague = F.concat(head, F.lit("Invoice Date: "), issued, money), F.concat(head, F.lit("Bill Date: "), issued, money)
    part = F.concat(F.lit("Buyer: Acme Traders, who buys things\nInvoice Date: "), issued)
    texts = [
        [vague, exact, exact], [part, vague, exact], [part, F.lit("Terms: Net 30\nBuyer: Acme Traders here"), exact], [part, F.concat(part, money), F.lit(None).cast("string")], [F.lit("Total 5"), F.lit(None).cast("string"), F.lit("x")], [exact, exact, exact],
    ]
    which = (n % 6).cast("int")
    each = [F.struct(F.lit(r).alias("reading"), F.coalesce(*(F.when(which == k, row[j]) for k, row in enumerate(texts))).alias("text")) for j, r in enumerate(documents.READINGS)]
    return views.invoices(s, d).select("business_id", "invoice_id", F.explode(F.array(*each)).alias("r")).select("business_id", "invoice_id", "r.*")


@_query("""SELECT invoice_id, CASE invoice_id % 6 WHEN 0 THEN 'layout_text' WHEN 1 THEN 'layout_text' WHEN 2 THEN 'ocr' WHEN 5 THEN 'text' END AS reading, CASE WHEN invoice_id % 6 NOT IN (3, 4) THEN 'INV-' || invoice_id END AS number,
  CASE WHEN invoice_id % 6 NOT IN (3, 4) THEN invoice_date END AS invoice_date, CASE WHEN invoice_id % 6 NOT IN (3, 4) THEN amount END AS total, CASE WHEN invoice_id % 6 = 2 THEN 'OCR' WHEN invoice_id % 6 NOT IN (3, 4) THEN 'LAYER' END AS worth,
  CASE invoice_id % 6 WHEN 3 THEN 'number,due_date,total,buyer,invoice_date' WHEN 4 THEN 'number,buyer,invoice_date,due_date,total' ELSE '' END AS missing, CASE invoice_id % 6 WHEN 3 THEN 'REQUIRED_FIELDS_MISSING' WHEN 4 THEN 'UNREADABLE' END AS problem FROM inv""")
def invoice_readings(s: SparkSession, d: str) -> DataFrame:
    out = documents.best_readings(_readings(s, d), ["business_id", "invoice_id"])
    worth = F.when(F.col("confidence") < 0.85, "OCR").when(F.col("confidence") <= 1, "LAYER").alias("worth")
    return out.select("invoice_id", "reading", "number", "invoice_date", F.col("total").cast(views.MONEY).alias("total"), worth, "missing", "problem")


def _proofs(s: SparkSession, d: str) -> DataFrame:
    n, line = F.col("l_orderkey"), F.col("l_linenumber")
    owners = views.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(views.customers(s, d).select(F.col("customer_id").alias("o_custkey"), "business_id"), "o_custkey")
    rows = views.table(s, d, "lineitem").join(owners, "l_orderkey")
    reference = F.when(n % 11 == 0, F.lit("Invoice No: INV-999999")).when(n % 7 != 0, F.concat(F.lit("Invoice No: inv-"), n.cast("string")))
    money = F.when(n % 13 != 0, F.concat(F.lit("Amount paid: Rs. "), F.format_number(F.col("l_extendedprice").cast(views.MONEY), 2)))
    day = F.when(n % 17 != 0, F.concat(F.lit("Paid on: "), F.date_format("l_shipdate", "dd-MM-yyyy")))
    return rows.select(
        "business_id", n.alias("invoice_id"), line.alias("line"), F.col("l_partkey").alias("part"), F.concat_ws("\n", F.lit("RECEIPT"), reference, money, day, F.concat(F.lit("UTR: ABC"), (n + 1000000).cast("string"))).alias("text"),
        F.when(n % 19 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("resolved_id"), F.when(n % 23 == 0, 2).otherwise(1).alias("shown"),
    )


_PROOF = f""",
x AS (SELECT c_nationkey AS b, l_orderkey AS n, l_linenumber AS line, l_partkey AS part, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(14,2)) AS price, outstanding, customer_id AS owner, CASE WHEN l_orderkey % 19 = 0 THEN o_custkey + 1 ELSE o_custkey END AS resolved
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN bill ON bill.invoice_id = l_orderkey),
e AS (SELECT DISTINCT n, day, price FROM x WHERE line = 7 AND owner IS NOT NULL),
w AS (SELECT *, CASE WHEN n % 13 <> 0 THEN price WHEN n % 11 = 0 THEN 999999 WHEN n % 7 <> 0 THEN n WHEN n % 17 <> 0 THEN day(day) END AS amt FROM x), -- without a label, the first number behind a sign
y AS (SELECT w.*, owner IS NOT NULL AND e.n IS NOT NULL AND w.n % 17 <> 0 AS there FROM w LEFT JOIN e ON e.n = w.n AND e.day = w.day AND e.price = w.amt),
z AS (SELECT *, CASE WHEN amt IS NULL THEN 'no amount' WHEN n % 17 = 0 THEN 'no date' WHEN day > DATE '{TODAY}' THEN 'date in the future' WHEN n % 11 = 0 AND n <> 999999 THEN 'other invoice' WHEN resolved <> owner THEN 'other customer' WHEN n % 23 = 0 THEN 'several payments'
  WHEN 5 + CASE WHEN n % 11 = 0 OR n % 7 <> 0 THEN 2 ELSE 0 END + 3 < 8.5 THEN 'low confidence' WHEN NOT there AND amt > greatest(outstanding, 0) THEN 'more than outstanding' END AS why FROM y)
"""


@_query(_PROOF + "SELECT b AS business_id, n AS invoice_id, line, part, CASE WHEN why IN ('no amount', 'no date') THEN 'FAILED' WHEN why IS NOT NULL THEN 'NEEDS_REVIEW' ELSE 'VERIFIED' END AS verdict, why FROM z")
def proof_verdicts(s: SparkSession, d: str) -> DataFrame:
    bills = views.bills(s, d).select("business_id", "invoice_id", F.concat(F.lit("INV-"), F.col("invoice_id").cast("string")).alias("number"), "customer_id", "outstanding")
    lines = views.table(s, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("invoice_id"), F.to_date("l_shipdate").alias("paid_on"), F.col("l_extendedprice").cast(views.MONEY).alias("amount"))
    existing = lines.join(bills, "invoice_id").select("business_id", F.concat(F.lit("customer:"), F.col("customer_id").cast("string")).alias("customer_key"), F.col("number").alias("reference"), "paid_on", "amount")
    found = proofs.proof_fields(_proofs(s, d)).withColumn("candidates", F.col("shown"))
    return proofs.proof_verdicts(found, bills, existing, TODAY).select("business_id", "invoice_id", "line", "part", "verdict", "why")


@_query("""SELECT c_nationkey AS business_id, o_orderkey % 500 AS file, 'INV-' || first(l_orderkey ORDER BY l_orderkey, l_linenumber, price, day) AS reference, first(price ORDER BY l_orderkey, l_linenumber, price, day) AS amount,
  first(day ORDER BY l_orderkey, l_linenumber, price, day) AS paid_on, count(*) AS candidates, CAST(0.9 AS DOUBLE) AS confidence
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS price, CAST(l_shipdate AS DATE) AS day FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""", views_first=False)
def proof_tables(s: SparkSession, d: str) -> DataFrame:
    """Receipts as tables: each file of a tenant holds the rows of some orders."""
    owners = views.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(views.customers(s, d).select(F.col("customer_id").alias("o_custkey"), "business_id"), "o_custkey")
    rows = views.table(s, d, "lineitem").join(owners, "l_orderkey").select(
        "business_id", (F.col("l_orderkey") % 500).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"), F.concat(F.lit(" INV-"), F.col("l_orderkey").cast("string")).alias("invoice"),
        F.date_format("l_shipdate", "d.M.yyyy").alias("date"), F.concat(F.lit("Rs. "), F.format_number(F.col("l_extendedprice").cast(views.MONEY), 2)).alias("amount"), F.lit(None).cast("string").alias("customer_name"), F.lit("").alias("gstin"), F.lit("U1").alias("payment_reference"),
    )
    return proofs.table_proofs(rows, ["business_id", "file"]).select("business_id", "file", "reference", "amount", "paid_on", "candidates", "confidence")
