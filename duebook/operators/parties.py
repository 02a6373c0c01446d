"""Seller and buyer of an invoice: which customer it belongs to, or why it is held for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import SIMILAR, name_pairs, name_ratio, same_organization
from .documents import _stage
from .identity import resolve, tax_number
from .ingest import company_name

KEY = ["business_id", "invoice_id"]
#: The score from which a name counts, and the lead of the most similar customer below which it is ambiguous.
SURE, MARGIN = 0.75, 0.05


def similar_customers(names: DataFrame, customers: DataFrame) -> DataFrame:
    """(business_id, name, n_similar, nearest, margin): customers of a tenant whose names are like a name, never equal to it.

    ``names``: (business_id, name), distinct. ``nearest`` is the best ratio, ``margin`` its lead over the second (null of one).
    """
    owners = customers.select("business_id", "customer_id", company_name(F.col("display_name")).alias("b")).filter("b IS NOT NULL")
    pairs = name_pairs(names.select(F.col("business_id").alias("group"), "name"), owners.select(F.col("business_id").alias("group"), F.col("b").alias("name")).distinct())
    alike = pairs.withColumn("ratio", name_ratio("a", "b")).filter(F.col("ratio") >= SIMILAR).join(owners.withColumnRenamed("business_id", "group"), ["group", "b"])
    # the two best by ranks, so that a tenant of many look-alikes is never collected
    rank = Window.partitionBy("group", "a").orderBy(F.desc("ratio"), "customer_id")
    best = alike.withColumn("k", F.row_number().over(rank)).groupBy("group", "a").agg(F.count("*").alias("n_similar"), F.max("ratio").alias("nearest"), F.max(F.when(F.col("k") == 2, F.col("ratio"))).alias("second"))
    return best.select(F.col("group").alias("business_id"), F.col("a").alias("name"), "n_similar", "nearest", (F.col("nearest") - F.col("second")).alias("margin"))


def _first(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(F.coalesce(holds, F.lit(False)), name) for holds, name in rules))


def decide(rows: DataFrame, tenants: DataFrame, customers: DataFrame, allow_create: bool = True) -> DataFrame:
    """``rows`` with status (matched, created, review, unresolved), matched_by, matched_id, owner_name and reason: the first rule that holds decides.

    ``rows``: business_id, invoice_id, seller_name, seller_gstin, seller_score, buyer_name, buyer_gstin, buyer_score,
    buyer_ref, selected_id; ``tenants``: business_id, name; ``customers``: business_id, customer_id, display_name,
    gstin, reference. A seller who isn't the tenant, a buyer who is, and names that are alike without being equal
    are never booked. The selected customer is only compared with what the document says. Of several invoices
    that would create one name, the first by id creates it and the others match it; ``owner_name`` is that name.
    """
    parties = tenants.select("business_id", company_name(F.col("name")).alias("__house")).groupBy("business_id").agg(F.min("__house").alias("__house"))
    names = {"__sn": company_name(F.col("seller_name")), "__bn": company_name(F.col("buyer_name")), "__sg": tax_number(F.col("seller_gstin")), "__bg": tax_number(F.col("buyer_gstin"))}
    out = _stage(rows, **names).join(parties, "business_id", "left")

    # what the document says, without the selection
    asked = out.select(*KEY, F.lit(None).cast("long").alias("customer_id"), F.col("buyer_gstin").alias("gstin"), F.col("buyer_ref").alias("reference"), F.col("buyer_name").alias("name"))
    found = resolve(asked, customers.withColumnRenamed("display_name", "name")).select(*KEY, F.col("resolved_id").alias("__match"))
    known = _stage(customers, norm=company_name(F.col("display_name")), tax=tax_number(F.col("gstin"))).select("business_id", "customer_id", "norm", "tax")
    of = lambda key, side: known.select("business_id", F.col("customer_id").alias(key), *(F.col(c).alias(f"__{side}_{c}") for c in ("norm", "tax")), F.lit(True).alias(f"__{side}"))
    out = out.join(found, KEY, "left").join(of("selected_id", "sel"), ["business_id", "selected_id"], "left").join(of("__match", "mat"), ["business_id", "__match"], "left")
    loose = out.filter("__match IS NULL AND __bn IS NOT NULL").select("business_id", F.col("__bn").alias("name")).distinct()
    out = out.join(similar_customers(loose, customers).withColumnRenamed("name", "__bn"), ["business_id", "__bn"], "left")

    sells = F.col("seller_name").isNotNull() & (F.col("seller_score") >= SURE)
    house = same_organization(F.col("__sn"), F.col("__house"))
    unlike = sells & F.col("__sn").isNotNull() & F.col("__house").isNotNull() & ~house
    # the ratio is worked out for the few sellers that reach it
    out = out.withColumn("__ratio", name_ratio(F.when(unlike, F.col("__sn")), F.when(unlike, F.col("__house"))))
    sure = F.col("buyer_name").isNotNull() & (F.col("buyer_name") != "") & (F.col("buyer_score") >= SURE)
    selected, both = F.col("selected_id").isNotNull(), F.col("__sel_tax").isNotNull() & F.col("__bg").isNotNull()
    differs = F.when(both, F.col("__sel_tax") != F.col("__bg")).otherwise(~same_organization(F.col("__sel_norm"), F.col("__bn")))
    matched = F.col("__match").isNotNull()
    verdict = _first(
        (F.col("__sg") == F.col("__bg"), "review:seller and buyer share a tax number"),
        (sells & (F.col("__sn").isNull() | F.col("__house").isNull()), "review:seller not comparable"),
        (F.col("__ratio") >= SIMILAR, "review:seller only similar to the tenant"),
        (unlike, "review:seller is not the tenant"),
        ((F.col("buyer_score") >= SURE) & same_organization(F.col("__bn"), F.col("__house")), "review:buyer is the tenant"),
        (selected & F.col("__sel").isNull(), "review:selected customer is not the tenant's"),
        (~F.coalesce(sure, F.lit(False)) & selected, "review:no sure buyer for the selected customer"),
        (~F.coalesce(sure, F.lit(False)), "review:buyer not sure enough" if allow_create else "unresolved:"),
        (selected & differs, "review:selected customer is not the buyer"),
        (selected & (F.col("__match") != F.col("selected_id")), "review:selected customer is not the one found"),
        (selected, "matched:selected_company"),
        (~matched & (F.col("n_similar") > 1), "review:several customers are similar"),
        (~matched & (F.col("n_similar") == 1), "review:one customer is similar"),
        (matched & (F.col("__bg") != F.col("__mat_tax")), "review:tax number is not the customer's"),
        (matched, "matched:buyer_identity"),
        (F.lit(not allow_create), "unresolved:"),
        (F.col("__bn").isNull(), "review:no buyer name"),
        (F.lit(True), "created:created"),
    )
    out = _stage(out, __verdict=F.split(verdict, ":", 2))
    status, detail = F.col("__verdict")[0], F.nullif(F.col("__verdict")[1], F.lit(""))
    first = out.filter(status == "created").groupBy("business_id", "__bn").agg(F.min("invoice_id").alias("__first"))
    out = out.join(first, ["business_id", "__bn"], "left")
    later = (status == "created") & (F.col("invoice_id") > F.col("__first"))
    return out.select(
        *rows.columns, F.when(later, "matched").otherwise(status).alias("status"), F.when(later, "buyer_identity").when(status.isin("matched", "created"), detail).alias("matched_by"),
        F.when(detail == "selected_company", F.col("selected_id")).when(status == "matched", F.col("__match")).alias("matched_id"), F.when(status == "created", F.col("__bn")).alias("owner_name"), F.when(status == "review", detail).alias("reason"), "n_similar", "nearest", "margin",
    )
