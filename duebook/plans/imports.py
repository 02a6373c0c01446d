"""Registered queries: an uploaded payment table, from file to counters, with SQL.

The upload is written from the line items as delimited text in many spellings, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imports, ingest
from ..sources import files
from . import views
from .queries import _query


def _upload(s: SparkSession, d: str) -> DataFrame:
    n, key, line = F.col("l_orderkey"), F.col("o_custkey"), F.col("l_linenumber")
    orders = views.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    owners = views.customers(s, d).select(F.col("customer_id").alias("o_custkey"), "business_id", "display_name", "gstin")
    # orders meet their customers first, so that the lines are shuffled once
    rows = views.table(s, d, "lineitem").join(orders.join(owners, "o_custkey"), "l_orderkey").withColumn("day", F.to_date("l_shipdate")).withColumn("price", F.col("l_extendedprice").cast(views.MONEY))
    number = F.when(n % 17 == 0, "").when(n % 19 == 0, F.concat(F.lit("INV-X"), n.cast("string"))).when(n % 2 == 0, F.concat(F.lit(" inv- "), n.cast("string"))).otherwise(F.concat(F.lit("INV-"), n.cast("string")))
    formats = ("dd/MM/yyyy", "d-M-yyyy", "yyyy-MM-dd", "d MMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "dd.MM.yyyy")
    day = F.when(n % 23 == 0, "soon").otherwise(F.coalesce(*(F.when(line % 7 == k, F.date_format("day", f)) for k, f in enumerate(formats))))
    plain, grouped = F.col("price").cast("string"), F.format_number("price", 2)
    amount = F.when(n % 31 == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(line % 3 == 0, F.concat(F.lit("Rs. "), grouped)).when(line % 3 == 1, F.concat(F.lit("₹"), plain)).otherwise(F.concat(plain, F.lit(" inr")))
    rows = rows.select(
        F.col("business_id").cast("string").alias("Tenant"), F.when(n % 13 == 0, F.concat(F.lit("New  Party, "), (n % 1000).cast("string"), F.lit(" Pvt. Ltd"))).otherwise(F.upper("display_name")).alias("Company Name"), number.alias("InvoiceNo"),
        day.alias("Date Received"), amount.alias("AMOUNT PAID"), F.when(n % 5 == 0, F.lower("gstin")).alias("GSTIN/UIN"), F.when(n % 37 == 0, F.concat(F.lit("ref-"), (key + 1).cast("string"))).when(n % 3 == 0, F.concat(F.lit("REF-"), key.cast("string"))).alias("Customer No."), F.lit("x").alias("UTR"),
    )
    return files.read_upload(s, files.write_csv(rows, files.shared_path(s, "upload"), ";"), keep=("Tenant",)).withColumn("business_id", F.col("Tenant").cast("int"))


def _existing(s: SparkSession, d: str) -> DataFrame:
    """The seventh lines are payments that are there already."""
    orders = views.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id"))
    rows = views.table(s, d, "lineitem").filter("l_linenumber = 7").join(orders.join(views.customers(s, d).select("customer_id", "business_id"), "customer_id"), "l_orderkey")
    return rows.select("business_id", F.concat(F.lit("customer:"), F.col("customer_id").cast("string")).alias("customer_key"), F.concat(F.lit(" Inv-"), F.col("l_orderkey").cast("string")).alias("reference"), F.to_date("l_shipdate").alias("paid_on"), F.col("l_extendedprice").cast(views.MONEY).alias("amount"))


#: A tax number or a name that several customers of a tenant have settles nothing: numbers hold the key's last five digits.
_IMPORT = """WITH cu AS (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 100000) = 1 AS taxed, count(*) OVER (PARTITION BY c_nationkey, lower(c_name)) = 1 AS named FROM customer),
l AS (
  SELECT c.c_nationkey AS b, o_custkey AS c, l_orderkey AS n, l_linenumber AS line, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(14,2)) AS price,
    l_orderkey % 17 <> 0 AND l_orderkey % 19 <> 0 AS matched, CASE WHEN l_orderkey % 17 = 0 THEN '' WHEN l_orderkey % 19 = 0 THEN 'inv-x' || l_orderkey ELSE 'inv-' || l_orderkey END AS ref,
    CASE WHEN l_orderkey % 40 <> 0 THEN o_custkey END AS owner,
    CASE WHEN l_orderkey % 5 = 0 AND taxed THEN o_custkey WHEN l_orderkey % 37 = 0 AND l_orderkey % 5 <> 0 AND nx.c_custkey IS NOT NULL THEN o_custkey + 1 WHEN l_orderkey % 37 <> 0 AND l_orderkey % 3 = 0 THEN o_custkey WHEN l_orderkey % 13 <> 0 AND named THEN o_custkey END AS resolved,
    l_orderkey % 37 = 0 AND nx.c_custkey IS NOT NULL AS next_ref,
    'new:new party ' || l_orderkey % 1000 || ' private limited' AS fresh
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cu c ON o_custkey = c.c_custkey LEFT JOIN customer nx ON nx.c_custkey = o_custkey + 1 AND nx.c_nationkey = c.c_nationkey),
r AS (SELECT *, CASE WHEN n % 23 = 0 THEN 'date' WHEN n % 31 = 0 THEN 'amount' WHEN matched AND owner IS NOT NULL AND (resolved IS NULL OR resolved <> owner) THEN 'customer conflicts with the invoice' WHEN resolved IS NULL AND next_ref THEN 'ambiguous reference' WHEN resolved IS NULL AND n % 13 <> 0 THEN 'ambiguous customer' END AS rejected, coalesce('customer:' || resolved, fresh) AS k FROM l),
e AS (SELECT DISTINCT b, 'customer:' || c AS k, 'inv-' || n AS ref, day, price FROM l WHERE line = 7),
z AS (SELECT r.*, row_number() OVER (PARTITION BY r.b, r.k, r.ref, r.day, r.price, rejected IS NULL ORDER BY line) AS place, e.k IS NOT NULL AS there FROM r LEFT JOIN e ON e.b = r.b AND e.k = r.k AND e.ref = r.ref AND e.day = r.day AND e.price = r.price),
s AS (SELECT *, CASE WHEN rejected IS NOT NULL THEN 'rejected' WHEN place > 1 OR there THEN 'duplicate' ELSE 'imported' END AS status, CASE WHEN rejected IS NOT NULL THEN rejected WHEN place > 1 THEN 'repeats a row of the file' WHEN there THEN 'exists' WHEN NOT matched THEN 'no such invoice' ELSE 'matched' END AS reason FROM z)
"""


def _classified(s: SparkSession, d: str) -> DataFrame:
    bills = views.invoices(s, d).select("business_id", "invoice_id", "customer_id", F.concat(F.lit("INV-"), F.col("invoice_id").cast("string")).alias("number"))
    return imports.classify(_upload(s, d), bills, views.customers(s, d), _existing(s, d))


@_query(_IMPORT + """SELECT b AS business_id, count(*) AS total, count(CASE WHEN status <> 'rejected' THEN 1 END) AS valid, count(CASE WHEN status = 'imported' THEN 1 END) AS imported, count(CASE WHEN reason = 'matched' THEN 1 END) AS matched, count(CASE WHEN reason = 'no such invoice' THEN 1 END) AS unmatched,
count(CASE WHEN reason = 'repeats a row of the file' THEN 1 END) AS duplicates_in_file, count(CASE WHEN reason = 'exists' THEN 1 END) AS duplicates_existing, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected FROM s GROUP BY 1""", False)
def payment_import(s: SparkSession, d: str) -> DataFrame:
    return imports.counters(_classified(s, d))


@_query(_IMPORT + "SELECT b AS business_id, status, reason, count(*) AS n, CAST(sum(CASE WHEN status = 'imported' THEN price END) AS DECIMAL(18,2)) AS amount FROM s GROUP BY 1, 2, 3", False)
def import_reasons(s: SparkSession, d: str) -> DataFrame:
    rows = _classified(s, d)
    return rows.groupBy("business_id", "status", "reason").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "imported", F.col("amount"))).cast("decimal(18,2)").alias("amount"))


@_query(_IMPORT + "SELECT DISTINCT b AS business_id, k AS customer_key FROM s WHERE status = 'imported' AND resolved IS NULL", False)
def imported_customers(s: SparkSession, d: str) -> DataFrame:
    return imports.new_customers(_classified(s, d)).select("business_id", "customer_key")


@_query("SELECT p_partkey AS id, lower(p_name) || ' private limited' AS party, 'ref-' || p_partkey AS reference FROM part", False)
def normal_names(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("  ("), F.upper("p_name"), F.lit(");  Pvt. Ltd. "))
    reference = F.concat(F.lit("ＲＥＦ － ").substr(1, 3), F.lit(" - "), F.col("p_partkey").cast("string"))
    return views.table(s, d, "part").select(F.col("p_partkey").alias("id"), ingest.company_name(name).alias("party"), ingest.reference_key(reference).alias("reference"))
