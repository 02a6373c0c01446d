"""Settlement of invoices and the customer history that was visible at a day, without a self-join.

Events are counted by tenant, customer and day first, so what follows grows with the calendar and not
with a customer's invoices. A window over the days that ends the day before sees exactly what was known.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spread import dealt

MIN_HISTORY = 3
KEY = ["business_id", "invoice_id"]
PARTY = ["business_id", "customer_id"]


def ledger(bills: DataFrame, paid: DataFrame) -> DataFrame:
    """``bills`` with ``paid``, ``outstanding`` (never below 0), ``status`` and ``settled_on``.

    Payments alone decide: OPEN with nothing paid, PAID at the full amount, else PARTIAL. ``settled_on``
    is the first day on which the running sum reaches the amount. ``paid``: business_id, invoice_id, paid_on,
    amount, one row for a day.
    """
    return settled(bills.join(paid.select(*KEY, "paid_on", F.col("amount").alias("part")), KEY, "left"))


def settled(rows: DataFrame) -> DataFrame:
    """A ledger from invoices joined with their payments (paid_on, part), both null where there are none.

    Running sums and the sum of an invoice need no shuffle after that join, whose partitioning they share.
    """
    order = Window.partitionBy(*KEY).orderBy("paid_on").rowsBetween(Window.unboundedPreceding, 0)
    bill = [c for c in rows.columns if c not in ("paid_on", "part")]
    running = rows.withColumn("running", F.sum("part").over(order))
    rows = running.groupBy(*bill).agg(F.coalesce(F.max("running"), F.lit(0)).cast("decimal(14,2)").alias("paid"), F.min(F.when(F.col("running") >= F.col("amount"), F.col("paid_on"))).alias("settled_on"))
    status = F.when(F.col("paid") <= 0, "OPEN").when(F.col("paid") >= F.col("amount"), "PAID").otherwise("PARTIAL")
    return rows.withColumn("status", status).withColumn("outstanding", F.greatest(F.col("amount") - F.col("paid"), F.lit(0)).cast("decimal(14,2)"))


def settlements(rows: DataFrame) -> DataFrame:
    """(invoice_id, settled_on) of the settled rows of a ledger."""
    return rows.filter("settled_on IS NOT NULL").select("invoice_id", "settled_on")


def _day(column):
    return F.datediff(column, F.lit("1970-01-01").cast("date"))


def _outcomes(rows: DataFrame) -> DataFrame:
    rows = rows.filter("customer_id IS NOT NULL").withColumn("delay", F.datediff("settled_on", "due_date"))
    return rows.filter("delay IS NOT NULL")


class _Delays:
    """Delays of a customer so far with their median: sorted while they are few, then counts in a Fenwick tree over a range that doubles when it is left."""

    FEW = 512

    def __init__(self) -> None:
        self.few, self.n = [], 0

    def add(self, delay: int, n: int) -> None:
        if self.few is not None:
            if self.n + n <= self.FEW:
                k = bisect_right(self.few, delay)
                self.few[k:k] = [delay] * n
                self.n += n
                return
            before, self.few = self.few, None
            self.low, self.tree, self.held, self.n = -64, [0] * 129, {}, 0
            for d in before:
                self._count(d, 1)
        self._count(delay, n)

    def _count(self, delay: int, n: int) -> None:
        self.held[delay] = self.held.get(delay, 0) + n
        self.n += n
        size = len(self.tree) - 1
        if not self.low <= delay < self.low + size:
            while not self.low <= delay < self.low + size:
                self.low, size = self.low - size // 2, 2 * size
            self.tree = [0] * (size + 1)
            for d, m in self.held.items():
                self._put(d - self.low + 1, m)
        else:
            self._put(delay - self.low + 1, n)

    def _put(self, k: int, n: int) -> None:
        while k < len(self.tree):
            self.tree[k] += n
            k += k & -k

    def _place(self, rank: int) -> int:
        k, step = 0, len(self.tree) - 1
        while step:
            if k + step < len(self.tree) and self.tree[k + step] <= rank:
                k += step
                rank -= self.tree[k]
            step //= 2
        return k + self.low

    def median(self) -> float | None:
        if not self.n:
            return None
        if self.few is not None:
            return (self.few[(self.n - 1) // 2] + self.few[self.n // 2]) / 2
        low = self._place((self.n - 1) // 2)
        return (low + (low if self.n % 2 else self._place(self.n // 2))) / 2


def _with_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of owner and day, with the median of all delays and the last three outcomes on the days before in place of ``delays`` and ``last``."""
    owner, known, three = None, _Delays(), []
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        delays, last = columns.pop("delays"), columns.pop("last")
        d_at, (d, n) = delays.offsets.to_pylist(), (delays.values.field(k).to_pylist() for k in ("delay", "n"))
        l_at, fields = last.offsets.to_pylist(), [last.values.field(k).to_pylist() for k in ("paid_day", "invoice_id", "delay")]
        outcomes = list(zip(*fields, strict=True))
        medians, means, rates = [], [], []
        for k, now in enumerate(zip(columns["business_id"].to_pylist(), columns["customer_id"].to_pylist(), strict=True)):
            if now != owner:
                owner, known, three = now, _Delays(), []
            medians.append(known.median())
            means.append(sum(x[2] for x in three) / len(three) if three else None)
            rates.append(sum(x[2] > 0 for x in three) / len(three) if three else None)
            if l_at[k] < l_at[k + 1]:
                three = sorted(three + outcomes[l_at[k] : l_at[k + 1]])[-3:]
            for j in range(d_at[k], d_at[k + 1]):
                known.add(d[j], n[j])
        found = {"median_delay": medians, "last3_mean_delay": means, "last3_late_rate": rates}
        yield pa.RecordBatch.from_arrays([*columns.values(), *(pa.array(v, pa.float64()) for v in found.values())], [*columns, *found])


def history_as_of(rows: DataFrame, probes: DataFrame | None = None, cleared: bool = False, count: int | None = None) -> DataFrame:
    """Each probed invoice with a customer: what its customer's settled invoices told before its own day.

    ``rows``: a ledger; ``probes``: those of its invoices that are asked about, all by default. An outcome is
    visible when both its settlement and its invoice day (or due day, where that is null) lie before the
    probe's day; ``cleared``: by its settlement alone. Same-day events are not seen. The last three outcomes
    go by settlement day and id. ``count``: the rows of the ledger, if known; shuffles then have as many tasks
    as these need.
    """
    deal = lambda t, n, *keys: t.repartition(*keys) if count is None else dealt(t, n * count, *keys)
    probes = rows if probes is None else probes
    probes = probes.filter("customer_id IS NOT NULL AND invoice_date IS NOT NULL").select(*KEY, "customer_id", _day("invoice_date").alias("at"))
    late = F.datediff("settled_on", "due_date")
    seen_on = _day(F.col("settled_on") if cleared else F.greatest("settled_on", F.coalesce("invoice_date", "due_date")))
    none = F.lit(None).cast("int")
    outcome = F.when(late.isNotNull(), F.struct(seen_on.alias("at"), late.alias("delay"), _day("settled_on").alias("paid_day"), F.lit(0).alias("issued")))
    issue = F.when(F.col("invoice_date").isNotNull(), F.struct(_day("invoice_date").alias("at"), none.alias("delay"), none.alias("paid_day"), F.lit(1).alias("issued")))
    events = rows.filter("customer_id IS NOT NULL").select(*PARTY, "invoice_id", F.explode(F.array_compact(F.array(outcome, issue))).alias("e")).select(*PARTY, "invoice_id", "e.*")
    if count is not None:
        events = deal(events, 2, *PARTY, "at", "delay")
        probes = deal(probes, 1, *PARTY, "at")
    d = F.col("delay").cast("long")
    by_delay = events.groupBy(*PARTY, "at", "delay").agg(F.count("delay").alias("n"), F.sum("issued").alias("issued"), F.max("paid_day").alias("paid_day"), F.slice(F.sort_array(F.collect_list(F.when(d.isNotNull(), F.struct("paid_day", "invoice_id", "delay"))), False), 1, 3).alias("last"))
    # dealt by owner once: the days, the windows and the medians share that
    days = deal(by_delay, 2, *PARTY).groupBy(*PARTY, "at").agg(
        F.sum("n").alias("n"), F.sum("issued").alias("issued"), F.max("paid_day").alias("paid_day"), F.sum(F.when(d > 0, F.col("n")).otherwise(0)).alias("late"), F.sum(d * F.col("n")).alias("total"),
        F.sum(d * d * F.col("n")).alias("squares"), F.min("delay").alias("low"), F.max("delay").alias("high"), F.collect_list(F.when(d.isNotNull(), F.struct("delay", "n"))).alias("delays"),
        F.slice(F.sort_array(F.flatten(F.collect_list("last")), False), 1, 3).alias("last"),
    )
    past = Window.partitionBy(*PARTY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda f, c: f(c).over(past)
    n, total = F.col("settled"), F.col("total")
    seen = days.select(
        *PARTY, "at", before(F.sum, "n").alias("settled"), before(F.sum, "late").alias("late"), before(F.sum, "total").alias("total"), before(F.sum, "squares").alias("squares"), before(F.min, "low").alias("min_delay"),
        before(F.max, "high").alias("max_delay"), before(F.max, "paid_day").alias("paid_day"), before(F.sum, "issued").alias("prior_invoices"), F.max(F.when(F.col("issued") > 0, F.col("at"))).over(past).alias("issued_day"), "delays", "last",
    )
    kinds = ", ".join(f"{c} {kind}" for c, kind in seen.dtypes if c not in ("delays", "last"))
    seen = seen.sortWithinPartitions(*PARTY, "at").mapInArrow(_with_medians, f"{kinds}, median_delay double, last3_mean_delay double, last3_late_rate double")
    seen = seen.withColumn("settled", F.coalesce("settled", F.lit(0)))
    found = probes.join(seen, [*PARTY, "at"])
    spread = F.sqrt((n * F.col("squares") - total * total) / (n * (n - 1)))
    long = lambda c: F.col(c).cast("long").alias(c)
    prior = F.coalesce("prior_invoices", F.lit(0))
    return found.select(
        *PARTY, "invoice_id", n.cast("long").alias("settled"), F.coalesce("late", F.lit(0)).cast("long").alias("late"), F.round(F.col("late") / F.nullif(n, F.lit(0)), 6).alias("late_rate"),
        F.round(total / F.nullif(n, F.lit(0)), 6).alias("avg_delay"), "median_delay", long("min_delay"), long("max_delay"), F.round(F.when(n == 1, 0.0).when(n > 1, spread), 6).alias("std_delay"),
        (F.col("at") - F.col("paid_day")).cast("long").alias("days_since_payment"), prior.cast("long").alias("prior_invoices"), (F.col("at") - F.col("issued_day")).cast("long").alias("days_since_invoice"),
        F.when(prior < 3, 1).otherwise(0).cast("long").alias("is_new_customer"), (n >= MIN_HISTORY).alias("estimates_ready"), F.round("last3_mean_delay", 6).alias("last3_mean_delay"), F.round("last3_late_rate", 6).alias("last3_late_rate"),
    )


def recent_outcomes(rows: DataFrame, last: int = 3) -> DataFrame:
    """(business_id, customer_id, n, mean_delay, late_rate) of each customer's last settled invoices, by settlement day and id."""
    latest = Window.partitionBy(*PARTY).orderBy(F.desc("settled_on"), F.desc("invoice_id"))
    rows = _outcomes(rows).withColumn("k", F.row_number().over(latest)).filter(F.col("k") <= last)
    return rows.groupBy(*PARTY).agg(F.count("*").alias("n"), F.round(F.avg("delay"), 6).alias("mean_delay"), F.round(F.avg(F.when(F.col("delay") > 0, 1.0).otherwise(0.0)), 6).alias("late_rate"))


def predictions(bills: DataFrame, history: DataFrame) -> DataFrame:
    """Baseline estimates for invoices whose customer has enough settled history.

    risk: (late + 1) / (settled + 2) to 4 places; tier by the unrounded value; expected day: invoice day
    plus terms plus the median delay for known customers, never before the invoice, rounded half-even.
    """
    rows = history.filter("estimates_ready").join(bills.select(*KEY, "invoice_date", "terms"), KEY)
    risk = (F.col("late") + 1) / (F.col("settled") + 2)
    days = F.greatest(F.lit(0.0), F.col("terms") + F.when(F.col("is_new_customer") == 1, 0.0).otherwise(F.col("median_delay")))
    tier = F.when(risk < 0.30, "LOW").when(risk < 0.65, "MEDIUM").otherwise("HIGH")
    return rows.withColumn("d", days).select(*KEY, F.round(risk, 4).alias("risk"), tier.alias("tier"), F.expr("date_add(invoice_date, CAST(bround(CAST(d AS DECIMAL(12,1)), 0) AS INT))").alias("expected"))
