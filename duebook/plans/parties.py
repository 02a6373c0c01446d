"""Registered query: seller and buyer of each order, decided against the tenant's customers, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parties
from . import views
from .queries import _query


def _documents(s: SparkSession, d: str) -> DataFrame:
    """What the orders' documents say about their parties, in many ways right and wrong."""
    n, key = F.col("o_orderkey"), F.col("o_custkey")
    owners = views.customers(s, d, whole_keys=True).select(F.col("customer_id").alias("o_custkey"), "business_id", "display_name", "gstin", "reference")
    rows = views.table(s, d, "orders").select("o_orderkey", "o_custkey").join(owners, "o_custkey").join(views.tenants(s, d), "business_id")
    name = F.col("display_name")
    return rows.select(
        "business_id", n.alias("invoice_id"),
        F.when(n % 13 == 0, "Other House Ltd").when(n % 13 == 1, F.concat("name", F.lit(" Pvt. Ltd."))).when(n % 13 == 2, F.concat("name", F.lit("x"))).when(n % 13 == 3, "Nobody").when(n % 13 == 4, "(;)").when(n % 13 != 5, F.col("name")).alias("seller_name"),
        F.when(n % 17 == 0, F.col("gstin")).alias("seller_gstin"), F.when(n % 13 == 3, 0.5).otherwise(0.92).alias("seller_score"),
        F.when(n % 11 == 0, None).when(n % 11 == 2, F.concat(name, F.lit("x"))).when(n % 11 == 3, F.concat(F.lit("Zeta Works of "), (n % 97 * 7919).cast("string"), F.lit(" and sons"))).when(n % 11 == 4, F.concat(F.lit(" "), F.upper(name), F.lit(". "))).otherwise(name).alias("buyer_name"),
        F.when((n % 17 == 0) | (n % 19 == 0), F.lower("gstin")).when(n % 23 == 0, F.concat(F.substring("gstin", 1, 14), F.lit("!"))).alias("buyer_gstin"), F.when(n % 11 == 1, 0.6).otherwise(0.95).alias("buyer_score"),
        F.when(n % 29 == 0, F.col("reference")).alias("buyer_ref"), F.when(n % 7 == 0, key).when(n % 7 == 1, key + 1).alias("selected_id"),
    )


@_query("""
WITH house AS (SELECT c_nationkey AS b, min(c_name) AS house FROM customer GROUP BY 1),
o AS (SELECT o_orderkey AS n, c.c_custkey AS c, c.c_nationkey AS b, c.c_name AS name, house, CASE WHEN o_orderkey % 7 = 0 THEN c.c_custkey WHEN o_orderkey % 7 = 1 THEN c.c_custkey + 1 END AS sel, s.c_custkey AS held
  FROM orders JOIN customer c ON o_custkey = c.c_custkey JOIN house ON house.b = c.c_nationkey LEFT JOIN customer s ON s.c_nationkey = c.c_nationkey AND s.c_custkey = CASE WHEN o_orderkey % 7 = 0 THEN c.c_custkey WHEN o_orderkey % 7 = 1 THEN c.c_custkey + 1 END),
m AS (SELECT *, n % 17 = 0 OR n % 19 = 0 OR n % 29 = 0 OR n % 11 NOT IN (0, 2, 3) AS found, n % 17 = 0 OR n % 19 = 0 AS taxed FROM o),
v AS (SELECT *, CASE
  WHEN n % 17 = 0 THEN 'review:seller and buyer share a tax number' WHEN n % 13 = 4 THEN 'review:seller not comparable' WHEN n % 13 = 2 THEN 'review:seller only similar to the tenant' WHEN n % 13 = 0 THEN 'review:seller is not the tenant'
  WHEN n % 11 NOT IN (0, 1, 2, 3) AND name = house THEN 'review:buyer is the tenant' WHEN sel IS NOT NULL AND held IS NULL THEN 'review:selected customer is not the tenant''s'
  WHEN n % 11 IN (0, 1) AND sel IS NOT NULL THEN 'review:no sure buyer for the selected customer' WHEN n % 11 IN (0, 1) THEN 'review:buyer not sure enough'
  WHEN sel IS NOT NULL AND CASE WHEN taxed THEN sel <> c ELSE n % 11 IN (2, 3) OR sel <> c END THEN 'review:selected customer is not the buyer' WHEN sel IS NOT NULL AND found AND sel <> c THEN 'review:selected customer is not the one found' WHEN sel IS NOT NULL THEN 'matched:selected_company'
  WHEN NOT found AND n % 11 = 2 THEN 'review:one customer is similar' WHEN found THEN 'matched:buyer_identity' ELSE 'created:created' END AS verdict FROM m),
w AS (SELECT *, split_part(verdict, ':', 1) AS st, split_part(verdict, ':', 2) AS detail, CASE WHEN verdict LIKE 'created%' THEN 'zeta works of ' || (n % 97 * 7919) || ' and sons' END AS owner FROM v),
x AS (SELECT *, st = 'created' AND n > min(n) OVER (PARTITION BY b, owner) AS later FROM w)
SELECT b AS business_id, n AS invoice_id, CASE WHEN later THEN 'matched' ELSE st END AS status, CASE WHEN later THEN 'buyer_identity' WHEN st IN ('matched', 'created') THEN detail END AS matched_by,
  CASE WHEN detail = 'selected_company' THEN sel WHEN st = 'matched' THEN c END AS matched_id, owner AS owner_name, CASE WHEN st = 'review' THEN detail END AS reason FROM x""", views_first=False)
def invoice_parties(s: SparkSession, d: str) -> DataFrame:
    # a tax number says whose document it is only where no other customer has it
    out = parties.decide(_documents(s, d), views.tenants(s, d), views.customers(s, d, whole_keys=True))
    return out.select("business_id", "invoice_id", "status", "matched_by", "matched_id", "owner_name", "reason")
