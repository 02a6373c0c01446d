"""Cleaning of the ERP export into canonical invoices, and the audit of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posting_day(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("M/d/yyyy")))


def compact_day(text: Column) -> Column:
    """Days written as yyyyMMdd, also with a decimal part behind them."""
    return F.try_to_date(F.split_part(text.cast("string"), F.lit("."), F.lit(1)), "yyyyMMdd")


def clearing_day(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm")))


def trade_rows(raw: DataFrame) -> DataFrame:
    """Rows of the export without exact repeats and without documents of type X2; a null type stays."""
    return raw.dropDuplicates().filter(~F.col("`document type`").eqNullSafe("X2"))


def canonical(raw: DataFrame) -> DataFrame:
    """Canonical invoices of an export: parsed days, terms, status and outcomes.

    A posting or due day that can't be parsed is an error, raised when the rows are read. A baseline or
    clearing day that can't be is null; without a baseline the term counts from the invoice day. An invoice
    without a clearing day is OPEN and has no outcome.
    """
    def must(day: Column, name: str) -> Column:
        return F.when(day.isNull(), F.raise_error(F.lit(f"{name} can't be parsed")).cast("date")).otherwise(day)

    text = lambda c: F.trim(F.col(c))
    rows = trade_rows(raw)
    rows = rows.select(
        F.col("doc_id").alias("invoice_id"), text("business_code").alias("business_code"), text("cust_number").alias("customer_id"), text("name_customer").alias("customer_name"),
        must(posting_day(F.col("posting_date")), "posting_date").alias("invoice_date"), must(compact_day(F.col("due_in_date")), "due_in_date").alias("due_date"), compact_day(F.col("baseline_create_date")).alias("baseline_date"),
        clearing_day(F.col("clear_date")).alias("clear_date"), F.col("total_open_amount").cast("double").alias("amount"), text("invoice_currency").alias("currency"), text("cust_payment_terms").alias("payment_terms"),
    )
    day = lambda a, b: F.datediff(a, b).cast("long")
    delay = day("clear_date", "due_date")
    return rows.select(
        "*", F.coalesce(day("due_date", "baseline_date"), day("due_date", "invoice_date")).alias("term_days"), day("due_date", "invoice_date").alias("days_until_due"),
        F.when(F.col("clear_date").isNull(), "OPEN").otherwise("PAID").alias("status"), delay.alias("delay_days"), F.when(delay.isNotNull(), (delay > 0).cast("long")).alias("is_late"), day("clear_date", "invoice_date").alias("days_until_payment"),
    )


def chronological(rows: DataFrame) -> DataFrame:
    """In order of the invoice day, then of the id as text."""
    return rows.orderBy("invoice_date", F.col("invoice_id").cast("string"))


def cleaning_statistics(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: what the export held, what left it, and what the canonical rows cover."""
    whole = raw.groupBy(*(f"`{c}`" for c in raw.columns)).agg(F.count("*").alias("copies"))
    x2 = F.col("`document type`").eqNullSafe("X2")
    before = whole.agg(F.sum("copies").alias("raw_rows"), F.sum(F.col("copies") - 1).alias("duplicates_removed"), F.count_if(x2).alias("x2_removed"))
    after = clean.agg(
        F.count("*").alias("canonical_rows"), F.count_if(F.col("status") == "PAID").alias("paid_rows"), F.count_if(F.col("status") == "OPEN").alias("open_rows"), F.count_distinct("customer_id").alias("customers"),
        F.min("invoice_date").alias("first_day"), F.max("invoice_date").alias("last_day"),
    )
    return before.join(F.broadcast(after))  # one row beside one row


def status_crosstab(raw: DataFrame) -> DataFrame:
    """(is_open, uncleared, n, agrees): flags against missing clearing days."""
    rows = raw.groupBy(F.col("isOpen").alias("is_open"), F.col("clear_date").isNull().alias("uncleared")).agg(F.count("*").alias("n"))
    return rows.withColumn("agrees", F.coalesce((F.col("is_open") == "1") == F.col("uncleared"), F.lit(False)))


def category_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n) of each column's values; nulls are not counted."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    return rows.selectExpr(f"stack({len(columns)}, {pairs}) AS (name, value)").filter("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))


def date_audit(raw: DataFrame) -> DataFrame:
    """(name, first_day, last_day, failed) of the four day columns, and the number of rows due before they were posted."""
    days = {"posting_date": posting_day, "due_in_date": compact_day, "clear_date": clearing_day, "baseline_create_date": compact_day}
    rows = raw.select(*(F.col(c) for c in days), *(parse(F.col(c)).alias(f"{c}_day") for c, parse in days.items()))
    early = F.count_if(F.col("due_in_date_day") < F.col("posting_date_day"))
    facts = rows.agg(early.alias("due_before_posting"), *(f(c) for c in days for f in (lambda c: F.min(f"{c}_day").alias(f"{c}_a"), lambda c: F.max(f"{c}_day").alias(f"{c}_b"), lambda c: (F.count(c) - F.count(f"{c}_day")).alias(f"{c}_f"))))
    return facts.selectExpr("due_before_posting", f"stack({len(days)}, " + ", ".join(f"'{c}', {c}_a, {c}_b, {c}_f" for c in days) + ") AS (name, first_day, last_day, failed)")


def column_report(rows: DataFrame) -> DataFrame:
    """(name, type, nulls, null_percent, distinct_values) of every column: each is counted by value before rows meet."""
    types = dict(rows.dtypes)
    parts = [rows.select(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in rows.columns]
    long = reduce(DataFrame.unionByName, parts).groupBy("name", "value").agg(F.count("*").alias("n"))
    kind = F.coalesce(*(F.when(F.col("name") == c, t) for c, t in types.items()))
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long")
    out = long.groupBy("name").agg(nulls.alias("nulls"), F.count("value").alias("distinct_values"), F.sum("n").alias("rows"))
    return out.select("name", kind.alias("type"), "nulls", F.round(100.0 * F.col("nulls") / F.col("rows"), 2).alias("null_percent"), "distinct_values")


def impute(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Nulls of the columns of ``medians`` (one row) take its values."""
    frozen = medians.select(*(F.col(c).alias(f"__{c}") for c in medians.columns))
    joined = rows.join(F.broadcast(frozen))  # one row
    return joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in medians.columns else F.col(c) for c in rows.columns))


def assert_no_nulls(rows: DataFrame, columns: list[str]) -> None:
    """One pass over the rows; an error names the columns that hold nulls."""
    found = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first().asDict()
    if bad := [c for c, n in found.items() if n]:
        raise ValueError(f"nulls after imputation: {', '.join(sorted(bad))}")
