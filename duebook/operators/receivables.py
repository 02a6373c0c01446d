"""Open receivables: aging, dashboard, collection priority, cash flow and customer balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
KEY = ["business_id", "invoice_id"]
#: The aging buckets, the reasons' wording, the weights of urgency and the bounds of segments below.
BUCKETS = ("current", "1-30", "31-60", "61-90", "90+")


def _sum(condition: Column | None = None, value: str = "outstanding") -> Column:
    x = F.col(value) if condition is None else F.when(condition, F.col(value))
    return F.coalesce(F.sum(x), F.lit(0)).cast(MONEY)


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def aging_bucket(past_due: Column) -> Column:
    return F.when(past_due <= 0, "current").when(past_due <= 30, "1-30").when(past_due <= 60, "31-60").when(past_due <= 90, "61-90").when(past_due > 90, "90+")


def aging_summary(open_bills: DataFrame) -> DataFrame:
    """(business_id, bucket, amount, n): all five buckets for every tenant; undated invoices are in none."""
    found = open_bills.withColumn("bucket", aging_bucket(F.col("past_due"))).groupBy("business_id", "bucket").agg(_sum().alias("amount"), F.count("*").alias("n"))
    every = open_bills.select("business_id").distinct().withColumn("bucket", F.explode(F.array(*map(F.lit, BUCKETS))))
    rows = every.join(found, ["business_id", "bucket"], "left")
    return rows.select("business_id", "bucket", F.coalesce("amount", F.lit(0)).cast(MONEY).alias("amount"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dashboard(open_bills: DataFrame, estimates: DataFrame, today: str) -> DataFrame:
    """One row per tenant: amount and number of each segment, in one aggregation."""
    rows = open_bills.join(estimates, KEY, "left")
    expected = F.col("expected").between(F.lit(today).cast("date"), F.date_add(F.lit(today).cast("date"), 30))
    parts = {"overdue": F.col("past_due") > 0, "due_soon": F.col("past_due").between(-7, 0), "high_risk": F.col("tier") == "HIGH", "expected": expected, "undated": F.col("due_date").isNull()}
    columns = [c for k, v in parts.items() for c in (_sum(v).alias(f"{k}_amount"), _count(v).alias(f"{k}_n"))]
    return rows.groupBy("business_id").agg(_sum().alias("outstanding_amount"), F.count("*").alias("outstanding_n"), *columns)


def priority(open_bills: DataFrame, estimates: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` invoices of each tenant by weight, with the reasons as text."""
    rows = open_bills.join(estimates, KEY, "left")
    late = F.col("past_due")
    urgency = F.when(late.isNull(), 0.25).when(late > 0, 1 + F.least(late, F.lit(90)) / 30).when(late >= -7, 0.5 + (7 + late) / 14).otherwise(0.25)
    weight = urgency * F.when(F.col("risk").isNotNull(), 0.5 + F.col("risk")).otherwise(1.0)
    rows = rows.withColumn("score", F.round(F.col("outstanding").cast("double") * weight, 4))
    order = Window.partitionBy("business_id").orderBy(F.desc("score"), F.asc_nulls_last("due_date"), "invoice_id")
    plural = lambda n: F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days"))
    when = F.when(late > 0, F.concat(plural(late), F.lit(" overdue"))).when(late == 0, "Due today").when(late >= -7, F.concat(F.lit("Due in "), plural(-late)))
    risky = F.when(F.col("tier") == "HIGH", F.concat(F.lit("High late-payment risk ("), F.round(F.col("risk") * 100, 0).cast("int").cast("string"), F.lit("%)")))
    reasons = F.concat_ws("; ", when, risky, F.when(F.col("status") == "PARTIAL", "Partially paid"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("business_id", F.col("place").cast("long").alias("place"), "invoice_id", "score", reasons.alias("reasons"))


def _dated(open_bills: DataFrame, estimates: DataFrame, today: str, weeks: int) -> DataFrame:
    """Each open invoice with the day its money is expected, the basis, and its week or unscheduled bucket."""
    now = F.lit(today).cast("date")
    rows = open_bills.join(estimates, KEY, "left")
    basis = F.when(F.col("expected") >= now, "model").when(F.col("expected").isNotNull(), "past_predicted")
    basis = basis.when(F.col("due_date").isNull(), "undated").when(F.col("due_date") >= now, "due_date").otherwise("overdue_unestimated")
    rows = rows.withColumn("basis", basis).withColumn("on", F.when(F.col("basis") == "model", F.col("expected")).when(F.col("basis") == "due_date", F.col("due_date")))
    week = F.floor(F.datediff("on", now) / 7).cast("int")
    rows = rows.withColumn("week", F.when(week < weeks, week))
    return rows.withColumn("bucket", F.when(F.col("on").isNull(), F.col("basis")).when(F.col("week").isNull(), "beyond_horizon"))


def cash_flow_weeks(open_bills: DataFrame, estimates: DataFrame, today: str, weeks: int = 8) -> DataFrame:
    """(business_id, week, total, predicted, due_dated, high_risk, n): every week for every tenant."""
    rows = _dated(open_bills, estimates, today, weeks)
    found = rows.filter("week IS NOT NULL").groupBy("business_id", "week").agg(_sum().alias("total"), _sum(F.col("basis") == "model").alias("predicted"), _sum(F.col("basis") == "due_date").alias("due_dated"), _sum(F.col("tier") == "HIGH").alias("high_risk"), F.count("*").alias("n"))
    every = open_bills.select("business_id").distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    out = every.join(found, ["business_id", "week"], "left")
    money = [F.coalesce(c, F.lit(0)).cast(MONEY).alias(c) for c in ("total", "predicted", "due_dated", "high_risk")]
    return out.select("business_id", F.col("week").cast("long").alias("week"), *money, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cash_flow_unscheduled(open_bills: DataFrame, estimates: DataFrame, today: str, weeks: int = 8) -> DataFrame:
    rows = _dated(open_bills, estimates, today, weeks).filter("bucket IS NOT NULL")
    return rows.groupBy("business_id", "bucket").agg(_sum().alias("amount"), F.count("*").alias("n"))


def cash_flow_totals(open_bills: DataFrame, estimates: DataFrame, today: str, weeks: int = 8) -> DataFrame:
    rows = _dated(open_bills, estimates, today, weeks)
    modelled = F.sum(F.when(F.col("tier").isNotNull(), F.col("outstanding")).otherwise(0))
    return rows.groupBy("business_id").agg(
        _sum().alias("outstanding"), _sum(F.col("week").isNotNull()).alias("scheduled"), _sum(F.col("basis") == "model").alias("model_dated"), _sum(F.col("basis") == "due_date").alias("due_date_dated"),
        F.round(modelled.cast("double") / F.sum("outstanding").cast("double"), 4).alias("model_coverage"),
    )


def expected_schedule(open_bills: DataFrame, estimates: DataFrame, today: str, days: int = 30) -> DataFrame:
    """(business_id, expected, amount, n, invoices): invoices by expected day within the window, ids in order."""
    now = F.lit(today).cast("date")
    rows = open_bills.join(estimates, KEY).filter(F.col("expected").between(now, F.date_add(now, days)))
    return rows.groupBy("business_id", "expected").agg(_sum().alias("amount"), F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("invoice_id")).cast("array<string>")).alias("invoices"))


def customer_balances(open_bills: DataFrame, estimates: DataFrame, today: str) -> DataFrame:
    """One row per tenant and customer (unresolved ones by themselves) with the share of the tenant's total."""
    now = F.lit(today).cast("date")
    rows = open_bills.join(estimates, KEY, "left").withColumn("party", F.coalesce(F.concat(F.lit("customer:"), F.col("customer_id").cast("string")), F.lit("unmatched")))
    rank = F.when(F.col("tier") == "LOW", 1).when(F.col("tier") == "MEDIUM", 2).when(F.col("tier") == "HIGH", 3)
    out = rows.groupBy("business_id", "party").agg(
        _sum().alias("outstanding"), _sum(F.col("past_due") > 0).alias("overdue"), F.count("*").alias("open_n"), _count(F.col("past_due") > 0).alias("overdue_n"),
        F.max(F.when(F.col("past_due") > 0, F.col("past_due"))).cast("long").alias("oldest"), F.min(F.when(F.col("due_date") >= now, F.col("due_date"))).alias("next_due"),
        F.min(F.when(F.col("expected") >= now, F.col("expected"))).alias("next_expected"), F.max(rank).cast("long").alias("risk_rank"),
    )
    total = F.sum("outstanding").over(Window.partitionBy("business_id"))
    return out.withColumn("share", F.round(F.col("outstanding").cast("double") / total.cast("double"), 4))


def concentration(balances: DataFrame) -> DataFrame:
    """(business_id, top_share, top_five_share) of the customers that owe most."""
    order = Window.partitionBy("business_id").orderBy(F.desc("outstanding"), "party")
    rows = balances.filter("outstanding > 0").withColumn("k", F.row_number().over(order)).filter("k <= 5")
    return rows.groupBy("business_id").agg(F.max(F.when(F.col("k") == 1, F.col("share"))).alias("top_share"), F.round(F.sum("share"), 4).alias("top_five_share"))


def payment_record(rows: DataFrame) -> DataFrame:
    """(business_id, customer_id, settled, on_time_rate, average_days_late, estimates_ready) of a ledger."""
    rows = rows.filter("customer_id IS NOT NULL").withColumn("delay", F.datediff("settled_on", "due_date")).filter("delay IS NOT NULL")
    on_time = F.avg(F.when(F.col("delay") <= 0, 1.0).otherwise(0.0))
    return rows.groupBy("business_id", "customer_id").agg(F.count("*").alias("settled"), F.round(on_time, 4).alias("on_time_rate"), F.round(F.avg("delay"), 1).alias("average_days_late"), (F.count("*") >= 3).alias("estimates_ready"))


def historical_companies(billed: DataFrame, paid: DataFrame) -> DataFrame:
    """(business_id, customer_id, n, billed, paid, open, last_invoice, last_payment) of customers with historical invoices; payments on all their invoices count."""
    owned = billed.filter("customer_id IS NOT NULL")
    bills = owned.filter("origin = 'HISTORICAL'").groupBy("business_id", "customer_id").agg(F.count("*").alias("n"), _sum(value="amount").alias("billed"), F.max("invoice_date").alias("last_invoice"))
    money = owned.select(*KEY, "customer_id").join(paid, KEY).groupBy("business_id", "customer_id").agg(_sum(value="amount").alias("paid"), F.max("paid_on").alias("last_payment"))
    rows = bills.join(money, ["business_id", "customer_id"], "left").withColumn("paid", F.coalesce("paid", F.lit(0)).cast(MONEY))
    return rows.withColumn("open", F.greatest(F.col("billed") - F.col("paid"), F.lit(0)).cast(MONEY))


def invoice_page(bills: DataFrame, today: str, aging: str | None = None, statuses: tuple[str, ...] = ("OPEN", "PARTIAL"), needle: str = "", sort: str = "due_date", descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of invoices: nulls last in both directions, then newest first, then by id; the needle is plain text."""
    now = F.lit(today).cast("date")
    due = F.col("due_date")
    windows = {"current": due >= now, "overdue": due < now, "due-soon": due.between(now, F.date_add(now, 7)), "1-30": due.between(F.date_sub(now, 30), F.date_sub(now, 1)), "31-60": due.between(F.date_sub(now, 60), F.date_sub(now, 31)), "61-90": due.between(F.date_sub(now, 90), F.date_sub(now, 61)), "90+": due < F.date_sub(now, 90)}
    if aging is not None and aging not in windows:
        raise ValueError(f"unknown aging window {aging!r}")
    if sort not in ("due_date", "amount", "invoice_date"):
        raise ValueError(f"unknown sort {sort!r}")
    rows = bills.filter(F.col("status").isin(*(s.upper() for s in statuses)))
    if aging is not None:
        rows = rows.filter(windows[aging])
    if needle:
        rows = rows.filter(F.lower(F.col("invoice_id").cast("string")).contains(needle.lower()))
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(key, F.desc("invoice_date"), "invoice_id").offset(offset).limit(limit)
