"""Import of payments from an uploaded table: parse, match, resolve, tell duplicates, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .identity import match_references, resolve
from .ingest import company_name, parse_amount, parse_date


def classify(rows: DataFrame, bills: DataFrame, customers: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows`` with ``status`` (imported, duplicate, rejected), ``reason``, ``matched_invoice`` and the parsed payment.

    ``rows``: business_id, row_number and the fields of an upload as text; ``bills``: business_id, invoice_id,
    number, customer_id; ``customers``: business_id, customer_id, display_name, gstin, reference; ``existing``:
    business_id, customer_key, reference, paid_on, amount. The checks go in order, the first that fails rejects
    a row. A row that resolves to no customer names a new one, one for each normal name. Of rows with one
    natural key the first is imported, or a duplicate of an existing payment; the others repeat it. A null
    customer key never equals another.
    """
    parsed = rows.withColumns({"paid_on": parse_date(F.col("date")), "value": parse_amount(F.col("amount"))})
    parsed = parsed.withColumns({"given_id": F.col("customer_id").try_cast("long"), "reference": F.nullif("invoice", F.lit(""))})
    # what names a customer recurs over the rows, so it is resolved once for each tenant; nulls are equal in a struct
    evidence = [F.col("given_id").alias("customer_id"), F.col("gstin").alias("gstin"), F.nullif("customer_ref", F.lit("")).alias("reference"), F.col("customer_name").alias("name")]
    parsed = parsed.withColumn("who", F.struct("business_id", *evidence))
    known = customers.withColumnRenamed("display_name", "name")
    named = resolve(parsed.select("who").distinct().select("who", "who.*"), known)
    named = named.withColumns({"k_ref": F.nullif(F.lower(F.trim("reference")), F.lit("")), "k_name": company_name(F.col("name"))})
    # a reference or a name that several customers have, or one with another tax number, can't make a new customer
    taken = lambda c, name: customers.select("business_id", c.alias(name)).filter(F.col(name).isNotNull()).distinct().withColumn(f"{name}_taken", F.lit(True))
    named = named.join(taken(F.lower(F.trim("reference")), "k_ref"), ["business_id", "k_ref"], "left").join(taken(company_name(F.col("display_name")), "k_name"), ["business_id", "k_name"], "left")
    has = F.col("customer_id").isNotNull() | F.col("k_ref").isNotNull() | F.col("k_name").isNotNull()
    named = named.select("who", "resolved_id", has.alias("has"), F.when(F.col("resolved_id").isNull(), F.col("k_name")).alias("k_name"), "k_ref_taken", "k_name_taken")
    no_id = F.col("customer_id").isNotNull() & (F.col("customer_id") != "") & F.col("given_id").isNull()
    needed = parsed.select("business_id", "row_number", "who", "paid_on", "value", "reference", no_id.alias("no_id"), "payment_reference").join(named, "who").drop("who")
    found = match_references(needed, bills.withColumn("owner", F.col("customer_id")), "number", "owner").withColumnRenamed("matched_invoice", "invoice_id")

    conflict = F.col("owner").isNotNull() & F.when(F.col("resolved_id").isNull(), F.col("has")).otherwise(F.col("resolved_id") != F.col("owner"))
    unresolved = F.col("resolved_id").isNull()
    reason = F.when(F.col("paid_on").isNull(), "date").when(F.col("value").isNull(), "amount").when(F.col("no_id"), "customer id")
    reason = reason.when(conflict, "customer conflicts with the invoice").when(unresolved & F.col("k_name").isNull(), "no customer").when(unresolved & F.col("k_ref_taken"), "ambiguous reference").when(unresolved & F.col("k_name_taken"), "ambiguous customer")
    found = found.withColumn("rejected", reason)
    key = F.when(unresolved, F.concat(F.lit("new:"), F.col("k_name"))).otherwise(F.concat(F.lit("customer:"), F.col("resolved_id").cast("string")))
    found = found.withColumns({"customer_key": key, "natural_ref": F.lower(F.trim(F.coalesce("number", "reference", F.lit(""))))})
    natural = ["business_id", "customer_key", "natural_ref", "paid_on", "value"]
    good = F.col("rejected").isNull()
    order = Window.partitionBy(*natural, good).orderBy("row_number")
    before = existing.filter("customer_key IS NOT NULL").select("business_id", "customer_key", F.lower(F.trim(F.coalesce("reference", F.lit("")))).alias("natural_ref"), "paid_on", F.col("amount").alias("value")).distinct().withColumn("there", F.lit(True))
    # joined first: the window then takes the join's partitions over
    found = found.join(before, natural, "left").withColumn("k", F.row_number().over(order))
    why = F.when(~good, F.col("rejected")).when(F.col("k") > 1, "repeats a row of the file").when(F.col("there"), "exists").when(F.col("invoice_id").isNull(), "no such invoice").otherwise("matched")
    status = F.when(~good, "rejected").when((F.col("k") > 1) | F.coalesce("there", F.lit(False)), "duplicate").otherwise("imported")
    return found.select("business_id", "row_number", "customer_key", F.coalesce("number", "reference").alias("reference"), "paid_on", F.col("value").alias("amount"), "payment_reference", F.col("invoice_id").alias("matched_invoice"), status.alias("status"), why.alias("reason"))


def counters(rows: DataFrame) -> DataFrame:
    """One row of counts for each tenant, from classified rows."""
    of = lambda status, *reasons: F.count_if((F.col("status") == status) & (F.col("reason").isin(*reasons) if reasons else F.lit(True)))
    return rows.groupBy("business_id").agg(
        F.count("*").alias("total"), (F.count("*") - of("rejected")).alias("valid"), of("imported").alias("imported"), of("imported", "matched").alias("matched"), of("imported", "no such invoice").alias("unmatched"),
        of("duplicate", "repeats a row of the file").alias("duplicates_in_file"), of("duplicate", "exists").alias("duplicates_existing"), of("rejected").alias("rejected"),
    )


def first_errors(rows: DataFrame, most: int = 50) -> DataFrame:
    """The first rejected rows of each tenant, in order."""
    order = Window.partitionBy("business_id").orderBy("row_number")
    return rows.filter("status = 'rejected'").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("business_id", "row_number", "reason")


def new_customers(rows: DataFrame) -> DataFrame:
    """(business_id, customer_key, first_row): customers that imported rows make, one for each normal name; the first row's spelling is theirs."""
    return rows.filter("status = 'imported' AND customer_key LIKE 'new:%'").groupBy("business_id", "customer_key").agg(F.min("row_number").alias("first_row"))
