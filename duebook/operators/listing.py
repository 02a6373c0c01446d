"""Lists of invoices, estimates and companies: filters, search, sorts, pages and display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .ingest import company_name

KEY = ["business_id", "invoice_id"]
#: The words that filters and sorts take, the days of "due soon", and provenances that count as history.
STATUSES = ("OPEN", "PARTIAL", "PAID", "OUTSTANDING")
OUTSTANDING = ("OPEN", "PARTIAL")
RISKS = ("HIGH", "MEDIUM", "LOW", "UNAVAILABLE")
SORTS = ("created", "uploaded", "due_date", "amount", "invoice_date")
DUE_SOON = 7
ELIGIBLE = ("legacy", "import", "manual", "proof_verified")


def _one_of(value: str, known: tuple[str, ...], what: str) -> str:
    if value not in known:
        raise ValueError(f"unknown {what} {value!r}")
    return value


def aging_windows(today: str) -> dict[str, Column]:
    """The condition of each aging window on ``due_date`` of an outstanding invoice; a null due date is in none."""
    now, due = F.lit(today).cast("date"), F.col("due_date")
    ago = lambda days: F.date_sub(now, days)
    windows = {
        "current": due >= now, "1-30": due.between(ago(30), ago(1)), "31-60": due.between(ago(60), ago(31)), "61-90": due.between(ago(90), ago(61)),
        "90+": due < ago(90), "overdue": due < now, "due-soon": due.between(now, F.date_add(now, DUE_SOON)),
    }
    return {k: v & F.col("status").isin(*OUTSTANDING) for k, v in windows.items()}


def aging_window_totals(bills: DataFrame, today: str) -> DataFrame:
    """(business_id, aging, n, amount) for every window that an invoice is in; windows overlap."""
    named = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in aging_windows(today).items())))
    rows = bills.select("business_id", "outstanding", F.explode(named).alias("aging"))
    return rows.groupBy("business_id", "aging").agg(F.count("*").alias("n"), F.sum("outstanding").cast("decimal(18,2)").alias("amount"))


def with_parties(bills: DataFrame, customers: DataFrame, documents: DataFrame) -> DataFrame:
    """``bills`` with the customer's name (else the unresolved one) and the upload time of the document (else the creation's)."""
    names = customers.select("business_id", "customer_id", "display_name")
    files = documents.select("business_id", "invoice_id", F.col("created_at").alias("stored_at"))
    rows = bills.join(names, ["business_id", "customer_id"], "left").join(files, KEY, "left")
    return rows.withColumn("party", F.coalesce("display_name", "unresolved_name")).withColumn("uploaded", F.coalesce("stored_at", "created_at"))


def list_invoices(rows: DataFrame, today: str, status: str | None = None, origin: str | None = None, needle: str = "", aging: str | None = None, risk: str | None = None, estimates: DataFrame | None = None, sort: str = "created", direction: str = "desc", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page for each tenant, with ``place`` in its list and ``total`` before paging.

    ``rows``: bills ``with_parties``. Status, origin, aging and risk take any case; unknown words are an
    error. The needle is plain text in any case, sought in the number and both names; ``MAN-`` and hex digits
    also find numbers that begin with these. ``estimates`` (business_id, invoice_id, tier) are those that pass
    the gate. Nulls sort last in both directions; ties go to the newest, then to the least id.
    """
    status, origin, risk, aging = (v.upper() if v else None for v in (status, origin, risk, aging))
    _one_of(sort, SORTS, "sort"), _one_of(direction, ("asc", "desc"), "direction")
    if status:
        rows = rows.filter(F.col("status").isin(*(OUTSTANDING if _one_of(status, STATUSES, "status") == "OUTSTANDING" else [status])))
    if origin:
        rows = rows.filter(F.col("origin") == origin)
    if aging:
        windows = {k.upper(): v for k, v in aging_windows(today).items()}
        rows = rows.filter(windows[_one_of(aging, tuple(windows), "aging window")])
    sought = needle.strip().lower()
    if sought:
        number = F.lower(F.col("number"))
        hit = number.contains(sought) | F.lower("unresolved_name").contains(sought) | F.lower("display_name").contains(sought)
        if sought.startswith("man-") and 0 < len(sought[4:]) <= 8 and all(c in "0123456789abcdef" for c in sought[4:]):
            hit = F.coalesce(hit, F.lit(False)) | number.startswith(sought[4:])
        rows = rows.filter(hit)
    if risk:
        rows = by_risk(rows, estimates, risk)
    key = F.col({"created": "created_at"}.get(sort, sort))
    order = Window.partitionBy("business_id").orderBy(key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last(), F.desc("created_at"), "invoice_id")
    return _page(rows, order, offset, limit)


def _page(rows: DataFrame, order: WindowSpec, offset: int, limit: int) -> DataFrame:
    """``rows`` of a page of each tenant with ``place`` and the tenant's ``total``. The filter behind the rank lets each task keep
    no more than a tenant's first rows before they are sent; totals are counted apart, first within tasks."""
    totals = rows.groupBy("business_id").agg(F.count("*").alias("total"))
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= offset + limit).filter(F.col("place") > offset)
    return first.withColumn("place", F.col("place").cast("long")).join(totals, "business_id")


def with_risk(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with ``risk``: the tier of the gated estimate, UNAVAILABLE where there is none. The words are those of ``by_risk``."""
    return rows.join(estimates.select(*KEY, "tier"), KEY, "left").withColumn("risk", F.coalesce("tier", F.lit("UNAVAILABLE"))).drop("tier")


def by_risk(rows: DataFrame, estimates: DataFrame, risk: str) -> DataFrame:
    """Rows whose gated estimate has the tier, or that have none (UNAVAILABLE)."""
    if _one_of(risk, RISKS, "risk") == "UNAVAILABLE":
        return rows.join(estimates.select(*KEY), KEY, "left_anti")
    return rows.join(estimates.filter(F.col("tier") == risk).select(*KEY), KEY, "left_semi")


def gated_page(stored: DataFrame, history: DataFrame, least: int = 3, offset: int = 0, limit: int = 50) -> DataFrame:
    """Stored estimates whose customer had ``least`` settled invoices by then: a page of each tenant, newest first, with the gated ``total``."""
    rows = stored.join(history.filter(F.col("settled") >= least).select(*KEY), KEY, "left_semi")
    order = Window.partitionBy("business_id").orderBy(F.desc("created_at"), "invoice_id")
    return _page(rows, order, offset, limit)


def scoring_readiness(rows: DataFrame) -> DataFrame:
    """(business_id, invoice_id, ready, reason): the first condition of scoring that an invoice fails, in order."""
    reason = F.when(F.col("processing") != "PROCESSED", "processing").when(F.col("amount").isNull() | (F.col("amount") <= 0), "amount")
    reason = reason.when(F.col("invoice_date").isNull() | F.col("due_date").isNull(), "dates")
    return rows.select(*KEY, reason.isNull().alias("ready"), reason.alias("reason"))


def eligible_payments(paid: DataFrame) -> DataFrame:
    """Payments that count as history: a known provenance and an amount above 0."""
    return paid.filter(F.col("provenance").isin(*ELIGIBLE) & (F.col("amount") > 0))


def companies(customers: DataFrame, bills: DataFrame, paid: DataFrame, search: str = "") -> DataFrame:
    """Customers with historical invoices or imported payments, or marked so; ``search`` is a LIKE pattern here, % and _ are wild.

    Payments name their customer by a derived key, ``customer:`` and the id.
    """
    of_bills = bills.filter("origin = 'HISTORICAL' AND customer_id IS NOT NULL").select("business_id", "customer_id")
    keyed = customers.select("business_id", "customer_id", F.concat(F.lit("customer:"), F.col("customer_id").cast("string")).alias("customer_key"))
    of_payments = keyed.join(paid.filter(F.col("provenance").isin("legacy", "import")).select("business_id", "customer_key"), ["business_id", "customer_key"], "left_semi").select("business_id", "customer_id")
    rows = customers.join(of_bills.union(of_payments).distinct(), ["business_id", "customer_id"], "left_semi")
    sought = search.strip()
    if sought:
        pattern = f"%{sought.lower()}%"
        name = company_name(F.col("display_name"))
        hit = F.lower("display_name").like(pattern) | name.like(pattern) | F.coalesce(F.lower("gstin").like(pattern), F.lit(False))
        rows = rows.filter(hit | F.coalesce(F.contains(name, company_name(F.lit(sought))), F.lit(False)))
    return rows


def review_queue(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Historical invoices that need review, with the payload of their latest parse task; ``place`` is newest first in the tenant."""
    latest = tasks.groupBy(*KEY).agg(F.max(F.struct("created_at", "task_no", "payload")).alias("latest")).select(*KEY, F.col("latest.payload").alias("payload"), F.col("latest.created_at").alias("parsed_at"))
    rows = rows.filter("origin = 'HISTORICAL' AND processing = 'NEEDS_REVIEW'").join(latest, KEY, "left")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("business_id").orderBy(F.desc("created_at"), "invoice_id")).cast("long"))


def due_tasks(tasks: DataFrame, now: str, lease_seconds: int = 300, pending: int = 100) -> DataFrame:
    """Tasks to take up: PROCESSING ones whose lease ended, and the oldest PENDING ones."""
    stale = tasks.filter((F.col("status") == "PROCESSING") & (F.col("started_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {lease_seconds} SECONDS"))).withColumn("kind", F.lit("stale"))
    first = tasks.filter("status = 'PENDING'").orderBy("created_at", "task_id").limit(pending).withColumn("kind", F.lit("pending"))
    return stale.unionByName(first)


def keep_latest(rows: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """The newest row of each key; ``newest`` has to order all rows of a key."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).filter("__k = 1").drop("__k")


def backfilled_keys(paid: DataFrame, bills: DataFrame) -> DataFrame:
    """Payments without a customer key take the one of their invoice."""
    mine = bills.select(*KEY, F.concat(F.lit("customer:"), F.col("customer_id").cast("string")).alias("__key"))
    return paid.join(mine, KEY, "left").withColumn("customer_key", F.coalesce("customer_key", "__key")).drop("__key")


def currency_summary(open_bills: DataFrame) -> DataFrame:
    """(business_id, currency, mixed): the one currency of a tenant's open invoices, INR where there are several or none is named."""
    code = F.coalesce(F.upper("currency"), F.lit("INR"))
    rows = open_bills.groupBy("business_id").agg(F.min(code).alias("one"), F.count_distinct(code).alias("n"))
    return rows.select("business_id", F.when(F.col("n") == 1, F.col("one")).otherwise("INR").alias("currency"), (F.col("n") > 1).alias("mixed"))


def ranked_customers(balances: DataFrame, customers: DataFrame) -> DataFrame:
    """(business_id, customer_id, outstanding, place): who owes most, ties by name in lower case, then by id."""
    names = customers.select("business_id", "customer_id", "display_name")
    order = Window.partitionBy("business_id").orderBy(F.desc("outstanding"), F.lower("display_name"), "customer_id")
    return balances.join(names, ["business_id", "customer_id"]).select("business_id", "customer_id", "outstanding", F.row_number().over(order).cast("long").alias("place"))


def unmatched_balances(open_bills: DataFrame) -> DataFrame:
    """(business_id, party, outstanding, n) of open invoices without a customer, by the normal form of the name on them."""
    party = F.concat(F.lit("unmatched:"), F.coalesce(company_name(F.col("unresolved_name")), F.lit("")))
    rows = open_bills.filter("customer_id IS NULL").groupBy("business_id", party.alias("party"))
    return rows.agg(F.sum("outstanding").cast("decimal(18,2)").alias("outstanding"), F.count("*").alias("n"))


def money_text(amount: Column, currency: Column) -> Column:
    """₹1,234.00, or the currency's code before the figure; rounded half-even."""
    figure = F.format_number(F.bround(amount, 2), 2)
    return F.when(F.coalesce(F.upper(currency), F.lit("INR")) == "INR", F.concat(F.lit("₹"), figure)).otherwise(F.concat(F.upper(currency), F.lit(" "), figure))


def _days(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days"))


def due_label(past_due: Column) -> Column:
    return F.when(past_due.isNull(), "No due date").when(past_due > 0, F.concat(_days(past_due), F.lit(" overdue"))).when(past_due == 0, "Due today").otherwise(F.concat(F.lit("Due in "), _days(-past_due)))


def relative_to_due(days: Column) -> Column:
    return F.when(days == 0, "on the due date").when(days > 0, F.concat(_days(days), F.lit(" after the due date"))).when(days < 0, F.concat(_days(-days), F.lit(" before the due date")))


def business_date(moment: Column, zone: str = "Asia/Kolkata") -> Column:
    """The calendar day of a UTC time where the business is."""
    return F.to_date(F.from_utc_timestamp(moment.cast("timestamp"), zone))
