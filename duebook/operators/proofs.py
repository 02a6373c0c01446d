"""Payment proofs: fields of receipts as text, rows of receipts as tables, and the verdict on a proof."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spread import spread
from .documents import _stage
from .grammar import CENTS, CODE, FLAGS, GAP, any_of, bound, every, first, first_said, shown
from .identity import TAX_NUMBER
from .ingest import DATE_SHAPES, compatible, days_of, parse_amount, parse_date, reference_key

#: Labels of receipts in order, what is no reference, scores and the verdict's threshold.
REFERENCES = ("against invoice", "tax invoice", "invoice", "inv", "bill", "document", "doc", "reference", "ref")
REFERENCE_WORDS = ("no", "number", "num", "#", "id")
REFERENCE_PREFIXES = ("INV", "SI", "SO", "BILL", "DOC")
NO_REFERENCES = ("PAID", "DATE", "AMOUNT", "TOTAL", "INR", "USD")
AMOUNTS = ("amount paid", "paid amount", "payment amount", "received amount", "total paid", "net paid", "amount received", "amount", "paid", "total", "net")
DAYS = ("payment date", "paid on", "paid date", "date of payment", "transaction date", "txn date", "value date", "received date", "clear date", "date")
TRANSFERS = ("utr no", "utr", "transaction id", "txn id", "transaction ref", "bank ref", "cheque no", "payment reference", "payment ref", "ref no")
PAYERS = ("paid by", "from", "received from", "customer", "client", "payer", "buyer", "company")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
CURRENCY_WORDS = ("INR", "USD", "CAD", "EUR", "GBP", "AUD", "RS.", "RS")
POINTS = {"base": 5, "reference": 2, "amount": 2, "paid_on": 1}
TABLE_CONFIDENCE = 0.9
VERIFIED_FROM = 0.85

_SIGN = rf"(?:{any_of(CURRENCY_WORDS)}|[₹$€£�]|[^\w\s\d])\s*"
_AMOUNT = rf"(\d{{1,3}}(?:,\d{{2,3}})+{CENTS}|\d+{CENTS})\b"
_SPELLED = r"\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}"
#: In the order in which they are tried: behind a label, day first, year first, with a month's name.
_DAY_PATTERNS = (
    rf"{FLAGS}{any_of(DAYS)}{GAP}(\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}|{_SPELLED})",
    r"(?U)\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b",
    r"(?U)\b(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b",
    rf"{FLAGS}\b(\d{{1,2}}\s+{any_of(MONTHS)}[a-z]*\s+\d{{4}})\b",
)


receipt_days = days_of(DATE_SHAPES)
#: A day by numbers that every month has.
_SURE_DAY = r"^(0?[1-9]|1\d|2[0-8])([/.-])(0?[1-9]|1[0-2])\2[12]\d{3}$"


def proof_fields(rows: DataFrame) -> DataFrame:
    """``rows`` (text, ...) with reference, amount, paid_on, gstin, customer_name, payment_reference, candidates (1) and confidence."""
    rows = _stage(spread(rows), __t=F.trim(compatible(F.col("text"))))
    rows = _stage(rows, __low=shown(F.col("__t")))
    t, low = F.col("__t"), F.col("__low")
    code = f"{CODE}{{1,63}}"
    named = lambda found: bound(found, lambda r: F.when(~F.upper(r).isin(*NO_REFERENCES), F.substring(r, 1, 64)))
    behind = named(first(t, rf"{FLAGS}{any_of(REFERENCES)}(?:\s*{any_of(REFERENCE_WORDS)})?{GAP}({code})"))
    prefixed = named(first(t, rf"{FLAGS}\b({any_of(REFERENCE_PREFIXES)}[A-Z0-9]*[-_/][A-Z0-9/_.-]{{1,60}})\b"))
    # the first that is an amount counts, so what stands behind no label is searched only where none behind one is
    amount = lambda pattern: F.get(F.array_compact(F.transform(every(t, pattern), lambda a: parse_amount(a, plain=True))), F.lit(0))
    labelled, *others = (every(t, p) for p in _DAY_PATTERNS)
    days = bound(labelled, lambda found: F.when(F.get(found, F.lit(0)).rlike(_SURE_DAY), F.slice(found, 1, 1)).otherwise(F.concat(found, *others)))
    paid_by = low.contains("paid") & low.contains("by")
    payer = F.when(paid_by | reduce(Column.__or__, (low.contains(w) for w in PAYERS[1:])), first(t, rf"{FLAGS}{any_of(PAYERS)}{GAP}([A-Za-z0-9\s.,&'-]{{3,80}})"))
    rows = _stage(
        rows, reference=F.coalesce(behind, prefixed), amount=F.coalesce(amount(rf"{FLAGS}{any_of(AMOUNTS)}{GAP}(?:{_SIGN})?{_AMOUNT}"), amount(rf"(?U){_SIGN}{_AMOUNT}")),
        __days=days, gstin=first(t, r"\b(" + TAX_NUMBER.strip("^$") + r")\b"), __payer=F.trim(F.get(F.split(payer, "\n"), F.lit(0))),
        payment_reference=F.substring(first_said(t, low, tuple(w.split()[0] for w in TRANSFERS), rf"{FLAGS}{any_of(TRANSFERS)}{GAP}([A-Z0-9]{{6,40}})"), 1, 128),
    )
    rows = rows.withColumn("paid_on", F.get(F.array_compact(receipt_days(F.col("__days"))), F.lit(0)))
    rows = rows.withColumns({"customer_name": F.when(F.length("__payer") >= 3, F.col("__payer")), "candidates": F.lit(1).cast("long"), "confidence": _points() / 10})
    return rows.drop("__t", "__low", "__payer", "__days")


def _points() -> Column:
    points = F.lit(POINTS["base"])
    for c in ("reference", "amount", "paid_on"):
        points = points + F.when(F.col(c).isNotNull(), POINTS[c]).otherwise(0)
    return points


def table_proofs(rows: DataFrame, key: list[str]) -> DataFrame:
    """One proof for each ``key`` from the rows of uploaded tables (row_number, invoice, date, amount, customer_name, gstin, payment_reference).

    Its fields are those of the first row, of rows with one number the least by reference, amount and so on; ``candidates`` counts the rows, since a receipt that shows several
    payments must not be booked on one of them.
    """
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    read = rows.select(*key, "row_number", text("invoice").alias("reference"), parse_amount(F.col("amount")).alias("amount"), parse_date(F.col("date")).alias("paid_on"), text("gstin").alias("gstin"), text("customer_name").alias("customer_name"), text("payment_reference").alias("payment_reference"))
    fields = ["reference", "amount", "paid_on", "gstin", "customer_name", "payment_reference"]
    out = read.groupBy(*key).agg(F.min_by(F.struct(*fields), F.struct("row_number", *fields)).alias("first"), F.count("*").alias("candidates"))
    return out.select(*key, "first.*", "candidates", F.lit(TABLE_CONFIDENCE).alias("confidence"))


def proof_verdicts(proofs: DataFrame, bills: DataFrame, existing: DataFrame, today: str) -> DataFrame:
    """``proofs`` with ``verdict`` (VERIFIED, NEEDS_REVIEW, FAILED), ``why`` and ``exists``: the first check that fails decides.

    ``proofs``: business_id, invoice_id and the fields of a proof, with resolved_id (the customer that it names)
    and candidates (how many payments it shows); ``bills``: business_id, invoice_id, number, customer_id, outstanding;
    ``existing``: business_id, customer_key, reference, paid_on, amount. The given invoice is authoritative.
    """
    mine = bills.select("business_id", "invoice_id", "number", F.col("customer_id").alias("owner"), "outstanding")
    rows = proofs.join(mine, ["business_id", "invoice_id"])
    rows = rows.withColumns({"customer_key": F.concat(F.lit("customer:"), F.col("owner").cast("string")), "natural_ref": F.lower(F.trim("number"))})
    natural = ["business_id", "customer_key", "natural_ref", "paid_on", "amount"]
    there = existing.filter("customer_key IS NOT NULL").select("business_id", "customer_key", F.lower(F.trim(F.coalesce("reference", F.lit("")))).alias("natural_ref"), "paid_on", "amount").distinct().withColumn("exists", F.lit(True))
    rows = rows.join(there, natural, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    failed = F.when(F.col("amount").isNull(), "no amount").when(F.col("paid_on").isNull(), "no date")
    review = F.when(F.col("paid_on") > F.lit(today).cast("date"), "date in the future").when(F.col("reference").isNotNull() & (reference_key(F.col("reference")) != reference_key(F.col("number"))), "other invoice")
    review = review.when(F.col("resolved_id") != F.col("owner"), "other customer").when(F.col("candidates") != 1, "several payments").when(F.col("confidence") < VERIFIED_FROM, "low confidence")
    review = review.when(~F.col("exists") & (F.col("amount") > F.greatest("outstanding", F.lit(0))), "more than outstanding")
    verdict = F.when(failed.isNotNull(), "FAILED").when(review.isNotNull(), "NEEDS_REVIEW").otherwise("VERIFIED")
    return rows.withColumns({"verdict": verdict, "why": F.coalesce(failed, review)}).drop("customer_key", "natural_ref", "owner", "number", "outstanding")
