"""Model features, targets, chronological split and audit statistics of invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles

PROHIBITED = ("settled_on", "delay", "is_late", "days_until_payment")


def assert_no_leakage(columns: list[str]) -> None:
    leaked = sorted(set(columns) & set(PROHIBITED))
    if leaked:
        raise ValueError(f"features that tell the outcome: {leaked}")


def calendar_features(bills: DataFrame) -> DataFrame:
    """Calendar and amount features; weekdays count from Monday as 0."""
    day, due = F.col("invoice_date"), F.col("due_date")
    long = lambda x: x.cast("long")
    return bills.select(
        "invoice_id", F.round(F.log1p(F.greatest(F.col("amount").cast("double"), F.lit(0.0))), 6).alias("log_amount"), long(F.month(day)).alias("month"), long(F.dayofmonth(day)).alias("day"),
        long(F.weekday(day)).alias("weekday"), long(F.quarter(day)).alias("quarter"), long(F.when(F.weekday(day) >= 5, 1).otherwise(0)).alias("weekend"), long(F.month(due)).alias("due_month"),
        long(F.weekday(due)).alias("due_weekday"), long(F.when(F.weekday(due) >= 5, 1).otherwise(F.when(due.isNotNull(), 0))).alias("due_weekend"), long(F.datediff(due, day)).alias("term_days"),
    )


def targets(ledger: DataFrame) -> DataFrame:
    """Outcome columns; null for invoices that are not settled."""
    rows = ledger.withColumn("delay", F.datediff("settled_on", "due_date"))
    return rows.select("invoice_id", F.when(F.col("settled_on").isNull(), "OPEN").otherwise("PAID").alias("status"), F.col("delay").cast("long").alias("delay_days"), F.when(F.col("delay").isNotNull(), (F.col("delay") > 0).cast("long")).alias("is_late"), F.datediff("settled_on", "invoice_date").cast("long").alias("days_until_payment"))


def target_summary(rows: DataFrame) -> DataFrame:
    n = F.count("delay_days")
    share = lambda c: F.round(100.0 * F.count_if(c) / n, 4)
    d = F.col("delay_days")
    return rows.agg(n.alias("n"), F.count_if(d <= 0).alias("on_time"), F.count_if(d > 0).alias("late"), F.count_if(d < 0).alias("early"), F.count_if(d == 0).alias("exact"), share(d > 0).alias("late_percent"), share(d <= 0).alias("on_time_percent"))


def temporal_split(rows: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """(invoice_id, split): closed invoices by day; the days at 70 % and 85 % of them begin validation and test.

    The cut days come from counts per day, a table that grows with the calendar and not with the rows.
    """
    closed = rows.filter("status = 'PAID'")
    days = closed.groupBy("invoice_date").agg(F.count("*").alias("n"))
    days = days.select("invoice_date", F.sum("n").over(Window.orderBy("invoice_date")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    first = F.expr(f"CAST(floor(total * {train}D) AS BIGINT)")
    second = F.expr(f"CAST(floor(total * {train + validation}D) AS BIGINT)")
    cuts = days.agg(F.min(F.when(F.col("upto") > first, F.col("invoice_date"))).alias("cut1"), F.min(F.when(F.col("upto") > second, F.col("invoice_date"))).alias("cut2"))
    # one row: the two cut days
    joined = rows.join(F.broadcast(cuts))
    split = F.when(F.col("status") == "OPEN", "open_inference").when(F.col("invoice_date") < F.col("cut1"), "train").when(F.col("invoice_date") < F.col("cut2"), "validation").otherwise("test")
    return joined.select("invoice_id", split.alias("split"))


def distribution(rows: DataFrame, column: str, places: int = 4) -> DataFrame:
    """Count, mean, spread, nine percentiles and bias-corrected skewness of a column."""
    x = F.col(column).cast("double")
    n = F.count(x)
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    marks = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    facts = rows.agg(n.alias("n"), F.round(F.avg(x), places).alias("mean"), F.round(F.stddev_samp(x), places).alias("std"), F.round(F.min(x), places).alias("min"), F.round(F.max(x), places).alias("max"), F.round(skew, places).alias("skew"))
    found = quantiles.exact(rows, {k: (x, q) for k, q in marks.items()})
    return quantiles.beside(facts, found).select(*facts.columns, *(F.round(k, places).alias(k) for k in marks))


def duplicate_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, exact_duplicates, key_duplicates): counts beyond the first, from grouped counts."""
    whole = rows.groupBy(*rows.columns).agg(F.count("*").alias("n_rows"))
    by_key = whole.groupBy(*keys).agg(F.sum("n_rows").alias("n_key"), F.sum(F.col("n_rows") - 1).alias("extra"))
    return by_key.agg(F.sum("n_key").cast("long").alias("rows"), F.sum("extra").cast("long").alias("exact_duplicates"), F.sum(F.col("n_key") - 1).cast("long").alias("key_duplicates"))


def column_profile(rows: DataFrame) -> DataFrame:
    """(name, nulls, distinct_values) of every column: one pass over a long form, pre-aggregated by value."""
    columns = rows.columns
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = rows.selectExpr(f"stack({len(columns)}, {pairs}) AS (name, value)").groupBy("name", "value").agg(F.count("*").alias("n"))
    return long.groupBy("name").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("nulls"), F.count("value").alias("distinct_values"))


def customer_histogram(bills: DataFrame) -> DataFrame:
    """(band, customers, invoices) by the number of invoices of a customer."""
    per = bills.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(F.count("*").alias("n"))
    band = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 20, "6-20").otherwise(">20")
    return per.groupBy(band.alias("band")).agg(F.count("*").alias("customers"), F.sum("n").cast("long").alias("invoices"))


def top_customers(bills: DataFrame, most: int = 5) -> DataFrame:
    """(place, customer_id, invoices, share): the customers with most invoices, ties by id, and their share of all rows."""
    per = bills.groupBy("customer_id").agg(F.count("*").alias("invoices"))
    best = per.filter("customer_id IS NOT NULL").orderBy(F.desc("invoices"), "customer_id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("invoices"), "customer_id"))  # over at most ``most`` rows
    total = per.agg(F.sum("invoices").alias("total")).withColumn("all", F.lit(1))
    return best.withColumn("all", F.lit(1)).join(total, "all").select(place.cast("long").alias("place"), "customer_id", "invoices", F.round(F.col("invoices") / F.col("total"), 6).alias("share"))


def ordinal_codes(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the place of ``column`` among the sorted training categories, -1 for unseen ones."""
    known = train.select(column).filter(F.col(column).isNotNull()).distinct()
    known = known.select(column, (F.row_number().over(Window.orderBy(column)) - 1).cast("double").alias("code"))
    return rows.join(known, column, "left").withColumn("code", F.coalesce("code", F.lit(-1.0)))


def train_medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row of exact medians of the training rows, to 6 places; 0 where all are null."""
    found = quantiles.exact(rows, {c: (F.col(c), 0.5) for c in columns})
    return found.select(*(F.coalesce(F.round(c, 6), F.lit(0.0)).alias(c) for c in columns))
