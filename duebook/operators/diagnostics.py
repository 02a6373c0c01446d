"""Read-only reports of doubtful identities and estimates."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ingest import company_name

KEY = ["business_id", "invoice_id"]
#: Legal suffixes that don't tell organisations apart, and the ratio from which names are similar.
SUFFIXES = ("private limited", "limited", "llp", "inc", "incorporated", "corp", "corporation", "ltd")
SIMILAR = 0.92
#: Fixed value: names that leave more texts than this meet by pieces.
MOST_WAYS = 1000


def payment_mismatches(bills: DataFrame, paid: DataFrame) -> DataFrame:
    """(business_id, invoice_id): invoices with a payment that names another customer, each once."""
    mine = bills.filter("customer_id IS NOT NULL").select(*KEY, F.concat(F.lit("customer:"), F.col("customer_id").cast("string")).alias("own"))
    return mine.join(paid.filter("customer_key IS NOT NULL").select(*KEY, "customer_key"), KEY).filter("customer_key <> own").select(*KEY).distinct()


def seller_as_customer(bills: DataFrame, customers: DataFrame, tenants: DataFrame) -> DataFrame:
    """(business_id, invoice_id): invoices whose customer has the tenant's own name."""
    own = tenants.select("business_id", company_name(F.col("name")).alias("name")).filter("name IS NOT NULL")
    alike = customers.select("business_id", "customer_id", company_name(F.col("display_name")).alias("name")).join(own, ["business_id", "name"], "left_semi")
    return bills.join(alike.select("business_id", "customer_id"), ["business_id", "customer_id"], "left_semi").select(*KEY)


def identity_report(bills: DataFrame, paid: DataFrame, customers: DataFrame, tenants: DataFrame) -> DataFrame:
    """(business_id, invoice_id, reason): both reports in order; the first reason of an invoice stands."""
    one = seller_as_customer(bills, customers, tenants).select(*KEY, F.lit(1).alias("k"), F.lit("seller stored as customer").alias("reason"))
    two = payment_mismatches(bills, paid).select(*KEY, F.lit(2).alias("k"), F.lit("payment names another customer").alias("reason"))
    return one.unionByName(two).groupBy(*KEY).agg(F.min(F.struct("k", "reason")).alias("first")).select(*KEY, F.col("first.reason").alias("reason"))


def same_organization(left, right):
    """Equal normal names, or one is the other and a legal suffix."""
    longer, shorter = F.when(F.length(left) >= F.length(right), left).otherwise(right), F.when(F.length(left) >= F.length(right), right).otherwise(left)
    rest = F.substring(longer, F.length(shorter) + 2, F.length(longer))
    return F.coalesce((left == right) | (longer.startswith(F.concat(shorter, F.lit(" "))) & F.trim(rest).isin(*SUFFIXES)), F.lit(False))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching blocks of two names over their lengths."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def similar_names(names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(group, a, b, ratio) of different names (group, name) of a group whose matching-blocks ratio is ``least`` or more, a before b."""
    pairs = name_pairs(names, names, least).filter("a < b")
    return pairs.withColumn("ratio", name_ratio("a", "b")).filter(F.col("ratio") >= least)


def name_pairs(names: DataFrame, others: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(group, a, b) of a name and a different one of ``others`` that may have that ratio; none that has it is missing.

    ``names`` and ``others``: (group, name), distinct. A pair with that ratio leaves at most (1 - least) of both lengths
    unmatched. Where that is few characters, both names without as many of theirs are one text: they meet by
    such texts, so names that only begin alike never do. Long names meet by pieces: of so many pieces of one name
    and one more, some piece stands whole in the other, moved by no more than that. Ratios verify.
    """
    sides = [t.filter("name IS NOT NULL AND name <> ''").select("group", "name", F.length("name").alias("n")).withColumn("side", F.lit(k)) for k, t in (("a", names), ("b", others))]
    reach = sides[0].unionByName(sides[1])
    # the other name's length lies between these, is one that the other side has, and the unmatched characters of both are at most d
    reach = reach.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * least / (2 - least) - 1e-9).cast("int"), F.floor(F.col("n") * (2 - least) / least + 1e-9).cast("int"))))
    lengths = reach.groupBy("group", F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), F.col("n").alias("m")).agg(F.count("*").alias("have")).drop("have")
    reach = reach.join(lengths, ["group", "side", "m"], "left_semi")
    reach = reach.withColumn("d", F.floor((F.col("n") + F.col("m")) * (1 - least) + 1e-9).cast("int"))
    reach = reach.withColumns({"less": F.floor((F.col("d") + F.col("n") - F.col("m")) / 2).cast("int"), "more": F.floor((F.col("d") + F.col("m") - F.col("n")) / 2).cast("int")})
    few = f"less >= 0 AND more >= 0 AND {_ways('n', 'less')} <= {MOST_WAYS} AND {_ways('m', 'more')} <= {MOST_WAYS}"
    texts = reach.filter(few).select("group", "side", "name", "n", "m", F.explode(_without(F.col("name"), F.col("less"))).alias("said"))
    short = texts.filter("side = 'a'").select("group", F.col("name").alias("a"), F.col("n").alias("na"), F.col("m").alias("nb"), "said")
    # sorted, since sizes are guessed from before the texts are made, and a guess that is too small would send them to all
    short = short.join(texts.filter("side = 'b'").select("group", F.col("name").alias("b"), F.col("m").alias("na"), F.col("n").alias("nb"), "said").hint("merge"), ["group", "na", "nb", "said"])
    return short.select("group", "a", "b").unionByName(_by_pieces(reach.filter(f"less >= 0 AND more >= 0 AND NOT ({few})"))).filter("a <> b").distinct()


def _ways(n: str, k: str) -> str:
    """How many texts a name of ``n`` characters leaves without ``k`` of them, at most, as SQL."""
    return f"CASE {k} WHEN 0 THEN 1.0D WHEN 1 THEN {n} WHEN 2 THEN {n} * ({n} - 1.0D) / 2 WHEN 3 THEN {n} * ({n} - 1.0D) * ({n} - 2) / 6 ELSE {MOST_WAYS} + 1.0D END"


def _without(name: Column, k: Column) -> Column:
    """The texts that remain of ``name`` without any ``k`` characters."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda at: F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + 1, F.length(t))))
    return F.aggregate(F.sequence(F.lit(0), k), F.array(name), lambda texts, at: F.when(at == 0, texts).otherwise(F.array_distinct(F.flatten(F.transform(texts, one)))))


def _by_pieces(reach: DataFrame) -> DataFrame:
    """(group, a, b) of the names that share a piece, of ``reach`` with sides a and b, lengths n and m and at most d unmatched characters."""
    cut = "CAST(floor({k} * {n} / (d + 1)) AS INT)"
    piece = lambda n: f"transform(sequence(0, d), k -> struct(k AS k, {cut.format(k='k', n=n)} AS at, {cut.format(k='(k + 1)', n=n)} - {cut.format(k='k', n=n)} AS size))"
    held = reach.filter("side = 'a'").select("group", F.col("name").alias("a"), F.col("n").alias("na"), F.col("m").alias("nb"), F.expr(f"inline({piece('n')})")).filter("size > 0")
    held = held.select("group", "a", "na", "nb", "k", F.expr("substring(a, at + 1, size)").alias("said"))
    asked = reach.filter("side = 'b'").select("group", F.col("name").alias("b"), F.col("m").alias("na"), F.col("n").alias("nb"), "d", F.expr(f"inline({piece('m')})")).filter("size > 0")
    asked = asked.filter("nb >= size").withColumn("to", F.explode(F.expr("sequence(least(greatest(0, at - d), nb - size), least(nb - size, at + d))")))
    asked = asked.select("group", "b", "na", "nb", "k", F.expr("substring(b, to + 1, size)").alias("said")).distinct()
    return held.join(asked.hint("merge"), ["group", "na", "nb", "k", "said"]).select("group", "a", "b")


def audit_estimates(stored: DataFrame, bills: DataFrame, customers: DataFrame, history: DataFrame, least: int = 3) -> DataFrame:
    """Stored estimates with ``outcome`` (eligible, ineligible, ambiguous) and the reason of an ambiguous one.

    ``stored``: business_id, invoice_id; the invoice is looked up by its id in any tenant.
    """
    mine = bills.select("invoice_id", F.col("business_id").alias("bb"), F.col("customer_id").alias("owner"))
    known = customers.select("business_id", F.col("customer_id").alias("owner"), F.lit(True).alias("known"))
    rows = stored.join(mine, "invoice_id", "left").join(known, ["business_id", "owner"], "left")
    rows = rows.join(history.select(*KEY, "settled"), KEY, "left")
    reason = F.when(F.col("bb").isNull(), "invoice is missing").when(F.col("bb") != F.col("business_id"), "tenants differ").when(F.col("owner").isNotNull() & F.col("known").isNull(), "customer is missing or of another tenant")
    outcome = F.when(reason.isNotNull(), "ambiguous").when(F.coalesce("settled", F.lit(0)) >= least, "eligible").otherwise("ineligible")
    return rows.select(*KEY, outcome.alias("outcome"), reason.alias("reason"))


def row_counts(**tables: DataFrame) -> DataFrame:
    """(business_id, name, n) of each table of a tenant."""
    counted = [t.groupBy("business_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(k)) for k, t in tables.items()]
    out = counted[0]
    for other in counted[1:]:
        out = out.unionByName(other)
    return out.select("business_id", "name", "n")


def week_items(dated: DataFrame) -> DataFrame:
    """(business_id, bucket, items): ids of a week's items by day and then the largest, of other buckets the largest first."""
    on = F.when(F.col("week").isNotNull(), F.col("on"))
    name = F.coalesce(F.concat(F.lit("week "), F.col("week").cast("string")), F.col("bucket"))
    order = F.array_sort(F.collect_list(F.struct(on.alias("on"), (-F.col("outstanding")).alias("less"), "invoice_id")))
    rows = dated.groupBy("business_id", name.alias("bucket")).agg(order.alias("items"))
    return rows.select("business_id", "bucket", F.concat_ws(",", F.transform("items", lambda x: x["invoice_id"].cast("string"))).alias("items"))

