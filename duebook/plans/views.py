"""The receivables domain over the driver's star schema: one shared layer of views.

A tenant is a customer's nation, an invoice an order, a payment the line items of an order that
ship on one day. Tenant ids are part of every key. Money is decimal(14,2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import dealt
from ..operators.history import settled
from ..operators.identity import check_digit
from ..sources.files import kept

TODAY = "2001-08-02"
#: Payment terms in days by order priority, and where a payment comes from by return flag.
TERMS = {"1-URGENT": 7, "2-HIGH": 15, "3-MEDIUM": 30, "4-NOT SPECIFIED": 45, "5-LOW": 60}
PROVENANCE = {"N": "import", "A": "manual", "R": "proof_verified"}
MONEY = "decimal(14,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The rows of a table, from the metadata of its files."""
    return table(spark, sf_dir, name).count()


def _tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("business_id"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, invoice_id, customer_id, amount, invoice_date, terms, due_date, origin)."""
    orders = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    terms = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in TERMS.items()))
    rows = orders.join(_tenants(spark, sf_dir), "o_custkey")
    return rows.select(
        "business_id", F.col("o_orderkey").alias("invoice_id"),
        F.when(F.col("o_orderkey") % 40 != 0, F.col("o_custkey")).alias("customer_id"), F.col("o_totalprice").cast(MONEY).alias("amount"),
        day.alias("invoice_date"), terms.alias("terms"), F.when(F.col("o_orderkey") % 50 != 0, F.date_add(day, terms)).alias("due_date"),
        F.when(day < F.lit("2001-01-01").cast("date"), "HISTORICAL").otherwise("CURRENT").alias("origin"),
    )


def payments(spark: SparkSession, sf_dir: str, today: str = TODAY) -> DataFrame:
    """(business_id, invoice_id, paid_on, amount): shipped line items up to ``today``, one payment for each day."""
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_tenants(spark, sf_dir), "o_custkey").select(F.col("o_orderkey").alias("invoice_id"), "business_id")
    return _shipped(spark, sf_dir, today).join(owners, "invoice_id").select("business_id", "invoice_id", "paid_on", "amount")


def _shipped(spark: SparkSession, sf_dir: str, today: str) -> DataFrame:
    """(invoice_id, paid_on, amount): line items summed by order and day before any join; dealt by order once, so that the sums and what joins them share that."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.to_date("l_shipdate").alias("paid_on"), F.col("l_extendedprice").cast(MONEY).alias("amount"))
    lines = dealt(lines.filter(F.col("paid_on") <= F.lit(today).cast("date")), size(spark, sf_dir, "lineitem"), "invoice_id")
    return lines.groupBy("invoice_id", "paid_on").agg(F.sum("amount").cast(MONEY).alias("amount"))


def bills(spark: SparkSession, sf_dir: str, today: str = TODAY) -> DataFrame:
    """The invoices with paid, outstanding, status, settled_on and processing: orders and customers are read once, a payment has the tenant of its order."""
    rows = settled(invoices(spark, sf_dir).join(_shipped(spark, sf_dir, today).withColumnRenamed("amount", "part"), "invoice_id", "left"))
    n = F.col("invoice_id")
    return rows.withColumn("processing", F.when(n % 97 == 0, "NEEDS_REVIEW").when(n % 89 == 0, "PENDING").otherwise("PROCESSED"))


def kept_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bills as a table of this run, for what reads them more than once."""
    return kept(bills(spark, sf_dir), "bills")


def unpaid(rows: DataFrame, today: str = TODAY) -> DataFrame:
    """Current invoices with something left to pay, processed or not, and the days that they are past due (null without a due date)."""
    rows = rows.filter("origin = 'CURRENT' AND outstanding > 0 AND status IN ('OPEN', 'PARTIAL')")
    return rows.withColumn("past_due", F.datediff(F.lit(today).cast("date"), "due_date"))


def outstanding(rows: DataFrame, today: str = TODAY) -> DataFrame:
    """The unpaid invoices whose processing is finished."""
    return unpaid(rows, today).filter("processing = 'PROCESSED'")


def customers(spark: SparkSession, sf_dir: str, whole_keys: bool = False) -> DataFrame:
    """(business_id, customer_id, display_name, gstin, reference): each with a valid tax number made of its ids.

    The number holds the last five digits of the key, with ``whole_keys`` its last nine, so that no customers share one.
    """
    key = F.col("c_custkey")
    letters = F.translate(F.lpad((key % 100000).cast("string"), 5, "0"), "0123456789", "ABCDEFGHIJ")
    digits = F.expr("c_custkey DIV 100000 % 10000") if whole_keys else key % 10000
    stem = F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), letters, F.lpad(digits.cast("string"), 4, "0"), F.lit("K1Z"))
    rows = table(spark, sf_dir, "customer").withColumn("stem", stem)
    return rows.select(F.col("c_nationkey").cast("int").alias("business_id"), key.alias("customer_id"), F.col("c_name").alias("display_name"), F.concat("stem", check_digit(F.col("stem"))).alias("gstin"), F.concat(F.lit("REF-"), key.cast("string")).alias("reference"))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, name): a tenant has the name of its least customer."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("int").alias("business_id"))
    return rows.agg(F.min("c_name").alias("name"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bills with number, created_at, processing, currency and the name on those without a customer."""
    n = F.col("invoice_id")
    currency = F.when(F.col("business_id") % 3 == 0, F.when(n % 11 == 0, "usd").when(n % 13 != 0, "INR")).when(F.col("business_id") % 3 == 1, "eur")
    name = F.when(F.col("customer_id").isNull(), F.concat(F.lit("Acme. "), (n % 7).cast("string"), F.lit(" Pvt. Ltd.")))
    return bills(spark, sf_dir).select("*", F.concat(F.lit("INV-"), n.cast("string")).alias("number"), F.col("invoice_date").alias("created_at"), currency.alias("currency"), name.alias("unresolved_name"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, invoice_id, created_at): files of every third invoice, stored some days later."""
    rows = invoices(spark, sf_dir).filter(F.col("invoice_id") % 3 == 0)
    return rows.select("business_id", "invoice_id", F.date_add("invoice_date", (F.col("invoice_id") % 5).cast("int")).alias("created_at"))


def sourced_payments(spark: SparkSession, sf_dir: str, today: str = TODAY) -> DataFrame:
    """(business_id, invoice_id, paid_on, provenance, amount, customer_key): payments by source, some with another customer's key or none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("paid_on"), F.col("l_extendedprice").cast(MONEY).alias("amount"), F.coalesce(*(F.when(F.col("l_returnflag") == k, v) for k, v in PROVENANCE.items())).alias("provenance"))
    # dealt by order before the join; the sums share that partitioning
    lines = dealt(lines.filter(F.col("paid_on") <= F.lit(today).cast("date")), size(spark, sf_dir, "lineitem"), "o_orderkey")
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_tenants(spark, sf_dir), "o_custkey")
    n, key = F.col("o_orderkey"), F.col("o_custkey")
    named = F.when(n % 30 == 0, key + 1).when(n % 40 != 0, key)
    rows = lines.join(owners, "o_orderkey").withColumn("customer_key", F.concat(F.lit("customer:"), named.cast("string")))
    return rows.groupBy("business_id", n.alias("invoice_id"), "paid_on", "provenance", "customer_key").agg(F.sum("amount").cast(MONEY).alias("amount"))


def payments_by_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sourced payments dealt by tenant and invoice, for joins by both."""
    return dealt(sourced_payments(spark, sf_dir), size(spark, sf_dir, "lineitem"), "business_id", "invoice_id")


def parse_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, invoice_id, task_no, created_at, payload): a parse task for each line item."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("task_no"), F.to_date("l_shipdate").alias("created_at"), F.concat(F.lit("seller "), F.col("l_suppkey").cast("string")).alias("payload"))
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_tenants(spark, sf_dir), "o_custkey")
    return lines.join(owners, "o_orderkey").select("business_id", F.col("o_orderkey").alias("invoice_id"), "task_no", "created_at", "payload")


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, status, created_at, started_at): the orders as tasks."""
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("COMPLETED")
    started = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 600).cast("decimal(18,6)"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.to_date("o_orderdate").alias("created_at"), started.alias("started_at"))
