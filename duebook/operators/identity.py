"""Customer identity inside a tenant: tax numbers and the cascade of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import company_name, reference_key

#: The shape of a tax number and the alphabet of its check digit.
TAX_NUMBER = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_digit(stem: Column) -> Column:
    """The check character of the first 14 characters: digits base 36, weighted 1 and 2 in turn, quotient and remainder added."""
    weighted = lambda k: (F.instr(F.lit(ALPHABET), F.substring(stem, k, F.lit(1))) - 1) * (2 - k % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda a, k: a + (weighted(k) / 36).cast("int") + weighted(k) % 36)
    return F.substring(F.lit(ALPHABET), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))


def tax_number(text: Column) -> Column:
    """Upper case without white space; null unless shape and check digit are right."""
    flat = F.upper(F.regexp_replace(text, r"\s+", ""))
    # bound once, however often the checks name it
    return F.get(F.transform(F.array(flat), lambda f: F.when(f.rlike(TAX_NUMBER), F.when(check_digit(f) == F.substring(f, 15, 1), f))), F.lit(0))


def _only(customers: DataFrame, key: str, name: str) -> DataFrame:
    """(business_id, key, name): the customer of each key that just one customer of its tenant has."""
    rows = customers.filter(F.col(key).isNotNull()).groupBy("business_id", key).agg(F.min("customer_id").alias(name), F.count_distinct("customer_id").alias("n"))
    return rows.filter("n = 1").drop("n")


def resolve(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """``rows`` with ``resolved_id`` and ``resolved_by``: the customer by the first evidence that settles it.

    ``rows``: business_id, customer_id, gstin, reference, name; ``customers``: business_id, customer_id, gstin,
    reference, name. In order: the id, a valid tax number, a reference, a name. Each must name one customer of the
    tenant; reference and name give way where both sides have valid tax numbers that differ. Never across tenants.
    """
    known = customers.select("business_id", "customer_id", tax_number("gstin").alias("k_gstin"), F.nullif(F.lower(F.trim("reference")), F.lit("")).alias("k_ref"), company_name(F.col("name")).alias("k_name"))
    mine = rows.withColumns({"k_gstin": tax_number(F.col("gstin")), "k_ref": F.nullif(F.lower(F.trim("reference")), F.lit("")), "k_name": company_name(F.col("name"))})
    ids = known.select("business_id", "customer_id").distinct().withColumn("by_id", F.col("customer_id"))
    out = mine.join(ids, ["business_id", "customer_id"], "left")
    for key, name in (("k_gstin", "by_gstin"), ("k_ref", "by_ref"), ("k_name", "by_name")):
        out = out.join(_only(known, key, name), ["business_id", key], "left")
    for name in ("by_ref", "by_name"):
        theirs = known.select("business_id", F.col("customer_id").alias(name), F.col("k_gstin").alias("g")).groupBy("business_id", name).agg(F.max("g").alias("g"))
        clash = F.col("g").isNotNull() & F.col("k_gstin").isNotNull() & (F.col("g") != F.col("k_gstin"))
        out = out.join(theirs, ["business_id", name], "left").withColumn(name, F.when(~clash, F.col(name))).drop("g")
    by = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_gstin").isNotNull(), "gstin").when(F.col("by_ref").isNotNull(), "reference").when(F.col("by_name").isNotNull(), "name")
    return out.select(*rows.columns, F.coalesce("by_id", "by_gstin", "by_ref", "by_name").alias("resolved_id"), by.alias("resolved_by"))


def match_references(rows: DataFrame, bills: DataFrame, *also: str) -> DataFrame:
    """``rows`` (business_id, reference) with ``matched_invoice``: the last invoice of the tenant with the same normal reference, or null; and its columns ``also``."""
    keyed = bills.select("business_id", reference_key(F.col("number")).alias("ref_key"), F.struct(F.col("invoice_id").alias("matched_invoice"), *also).alias("last")).groupBy("business_id", "ref_key").agg(F.max("last").alias("last"))
    keyed = keyed.select("business_id", "ref_key", "last.*")
    return rows.withColumn("ref_key", reference_key(F.col("reference"))).join(keyed, ["business_id", "ref_key"], "left").select(*rows.columns, "matched_invoice", *also)
