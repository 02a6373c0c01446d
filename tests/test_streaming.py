import datetime

from duebook.streaming import run, tasks

ACTIONS = "task_id long, seq long, ts timestamp, action string"


def at(seconds):
    return datetime.datetime(2001, 1, 1) + datetime.timedelta(seconds=seconds)


def states(spark, folder, files):
    for rows in files:
        spark.createDataFrame(rows, ACTIONS).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = run.finished(tasks.task_states(stream), "states").collect()
    return sorted((r.task_id, r["at"], r.status, r.attempt) for r in found)


def test_task_life_over_batches(spark, tmp_path):
    first = [(1, 1, at(0), "enqueue"), (1, 2, at(1), "claim"), (1, 2, at(1), "claim"), (2, 3, at(0), "enqueue"), (2, 4, at(5), "claim"), (3, 5, at(0), "done"), (None, 6, at(0), "enqueue"), (4, 7, at(0), "enqueue"), (4, 8, at(1), "claim"), (4, 9, at(2), "reject")]
    second = [(1, 10, at(9), "done"), (1, 11, at(10), "fail"), (2, 12, at(400), "claim"), (2, 13, at(401), "fail"), (2, 14, at(402), "claim"), (2, 15, at(403), "fail")]
    assert states(spark, tmp_path / "in", [first, second]) == [
        (1, at(0), "PENDING", 0), (1, at(1), "PROCESSING", 0), (1, at(9), "COMPLETED", 0),
        (2, at(0), "PENDING", 0), (2, at(5), "PROCESSING", 0), (2, at(305), "PENDING", 1), (2, at(400), "PROCESSING", 1), (2, at(401), "PENDING", 2), (2, at(402), "PROCESSING", 2), (2, at(403), "FAILED", 2),
        (4, at(0), "PENDING", 0), (4, at(1), "PROCESSING", 0), (4, at(2), "FAILED", 0),
    ]


def test_late_binding(spark):
    paid = spark.createDataFrame([(1, 1, "A", at(0)), (2, 1, "B", at(0)), (3, 2, "A", at(0)), (4, 1, None, at(0))], "payment_id long, business_id long, reference string, paid_at timestamp")
    bills = spark.createDataFrame([(7, 1, "A", at(86400)), (8, 1, "B", at(86400 * 40))], "invoice_id long, business_id long, number string, created_at timestamp")
    got = {r.payment_id: r.invoice_id for r in tasks.bind_late(paid, bills).collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None}


def test_lease_ends_without_a_further_event(spark, tmp_path):
    rows = [(1, 1, at(0), "enqueue"), (1, 2, at(5), "claim"), (9, 3, at(10), "enqueue")]
    spark.createDataFrame(rows, ACTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, 4, at(100000), "claim")], ACTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = run.finished(tasks.task_states(stream, late="60 seconds"), "leases").collect()
    assert (1, at(305), "PENDING", 1) in {(r.task_id, r["at"], r.status, r.attempt) for r in found}


def test_results_outlive_a_restart(spark, tmp_path):
    kind = "k long, v long"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: run.finished(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "kept", keys=["k"], newest=["v"], path=str(tmp_path / "out"))
    put([(1, 1), (2, 1), (2, 3)])
    assert sorted(map(tuple, read().collect())) == [(1, 1), (2, 3)]
    put([(1, 0), (3, 5)])
    assert sorted(map(tuple, read().collect())) == [(1, 0), (2, 3), (3, 5)]


def test_counter_answers(spark):
    counts = spark.createDataFrame([(1, at(0), 3), (2, at(0), 4)], "user_id long, window_start timestamp, hits long")
    ask = lambda **kw: [(r.allowed, r.retry_after) for r in tasks.allowed(counts, limit=3, now="2001-01-01 12:00:00", **kw).orderBy("user_id").collect()]
    assert ask() == [(True, None), (False, 43200)]
    assert ask(cost=0) == [(False, 43200), (False, 43200)]
