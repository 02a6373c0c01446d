"""Event streams: fixed-window counters, the task life cycle, its routing, and late binding of payments.

The sink is left to the caller. Counters and bindings take a table as well; the life cycle needs a
stream, and sorts the rows that one task has in one micro-batch in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts of a task and seconds of its lease.
MAX_ATTEMPTS = 3
LEASE_SECONDS = 300


def window_counts(events: DataFrame, window: str = "1 day", limit: int = 3, late: str = "1 day") -> DataFrame:
    """(user_id, window_start, hits, refused) of ``events`` (ts, user_id): hits beyond ``limit`` in a fixed window are refused.

    Rows without a time or a user are not counted. Rows later than ``late`` behind a stream's newest are dropped by it.
    """
    rows = events.filter("ts IS NOT NULL AND user_id IS NOT NULL")
    kind = rows.schema["ts"].dataType  # a watermark needs a time with a zone
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows
    counted = rows.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("hits"))
    return counted.select("user_id", F.col("w.start").cast(kind).alias("window_start"), "hits", F.greatest(F.col("hits") - limit, F.lit(0)).cast("long").alias("refused"))


def allowed(counts: DataFrame, limit: int = 3, cost: int = 1, now: str | None = None, seconds: int = 86400) -> DataFrame:
    """``counts`` (user_id, window_start, hits) with ``allowed`` and ``retry_after`` seconds from ``now`` to the window's end.

    A hit counts before it is judged; a cost of 0 only asks if one more would be allowed.
    """
    fits = F.col("hits") <= limit if cost else F.col("hits") < limit
    end = F.unix_timestamp(F.col("window_start").cast("timestamp")) + seconds
    left = end - F.unix_timestamp(F.lit(now).cast("timestamp")) if now else F.lit(None).cast("long")
    return counts.withColumn("allowed", fits).withColumn("retry_after", F.when(~fits, F.greatest(left, F.lit(1))))


def route(tasks: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """``tasks`` (type) with ``status`` and ``handler``: an unknown type fails for good."""
    fits = F.coalesce(F.col("type").isin(*known), F.lit(False))
    return tasks.withColumn("handler", F.when(fits, F.col("type"))).withColumn("status", F.when(fits, "PENDING").otherwise("FAILED"))


def unhandled(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks that no earlier delivery has dealt with, each once."""
    return tasks.join(done.select(key), key, "left_anti").dropDuplicates([key])


_STATE = "status string, attempt int, deadline timestamp"
_OUT = "task_id long, at timestamp, status string, attempt int"


class TaskLife(StatefulProcessor):
    """A task's states by its events: enqueue, claim, done, fail (may be tried again), reject (may not).

    An event that the state doesn't allow changes nothing, so repeated delivery is harmless. A claim
    whose lease ended before the next event goes back to PENDING at that moment, and with ``timers`` also
    where no event follows, once the stream's time has passed it.
    """

    def __init__(self, timers: bool = False) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempt, deadline = self.life.get() if self.life.exists() else (None, 0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            if status == "PROCESSING" and r.ts.to_pydatetime() > deadline:
                status, attempt = "PENDING", attempt + 1
                out.append((key[0], deadline, status, attempt))
            before = status
            if r.action == "enqueue" and status is None:
                status = "PENDING"
            elif r.action == "claim" and status == "PENDING":
                status, deadline = "PROCESSING", (r.ts + pd.Timedelta(seconds=LEASE_SECONDS)).to_pydatetime()
            elif r.action == "done" and status == "PROCESSING":
                status = "COMPLETED"
            elif r.action == "fail" and status == "PROCESSING":
                status, attempt = ("PENDING", attempt + 1) if attempt + 1 < MAX_ATTEMPTS else ("FAILED", attempt)
            elif r.action == "reject" and status == "PROCESSING":
                status = "FAILED"
            if status != before:
                out.append((key[0], r.ts, status, attempt))
        if status is not None:
            self.life.update((status, attempt, deadline))
        if self.timers and status == "PROCESSING":
            self.handle.registerTimer(int(pd.Timestamp(deadline, tz="UTC").timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=["task_id", "at", "status", "attempt"])


    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempt, deadline = self.life.get() if self.life.exists() else (None, 0, None)
        out = []
        if status == "PROCESSING" and expiredTimerInfo.getExpiryTimeInMs() >= int(pd.Timestamp(deadline, tz="UTC").timestamp() * 1000):
            self.life.update(("PENDING", attempt + 1, deadline))
            out.append((key[0], deadline, "PENDING", attempt + 1))
        yield pd.DataFrame(out, columns=["task_id", "at", "status", "attempt"])


def task_states(actions: DataFrame, late: str | None = None) -> DataFrame:
    """(task_id, at, status, attempt): each change of state that the stream ``actions`` (task_id, seq, ts, action) makes.

    With ``late``, leases also end by timers, once the newest event is that much ahead; rows later than that are dropped.
    """
    rows = actions.filter("task_id IS NOT NULL AND ts IS NOT NULL").select("task_id", "seq", "ts", "action")
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy("task_id").transformWithStateInPandas(statefulProcessor=TaskLife(bool(late)), outputStructType=_OUT, outputMode="Append", timeMode="EventTime" if late else "None")


def bind_late(payments: DataFrame, invoices: DataFrame, wait: str = "30 days", how: str = "left") -> DataFrame:
    """(payment_id, reference, invoice_id): payments with the invoice of the same tenant and reference, whichever came first.

    ``payments``: payment_id, business_id, reference, paid_at; ``invoices``: invoice_id, business_id, number,
    created_at. An invoice that is created more than ``wait`` after the payment does not bind it. As streams, a
    payment that stays unbound is given out when ``wait`` has passed; an inner join gives bound ones alone.
    """
    p = payments.select("payment_id", F.col("business_id").alias("pb"), "reference", "paid_at")
    i = invoices.select("invoice_id", F.col("business_id").alias("ib"), "number", "created_at")
    if p.isStreaming:
        p, i = p.withWatermark("paid_at", wait), i.withWatermark("created_at", wait)
    near = F.expr(f"pb = ib AND reference = number AND created_at <= paid_at + INTERVAL {wait} AND created_at >= paid_at - INTERVAL 3650 days")
    return p.join(i, near, how).select("payment_id", "reference", "invoice_id")
