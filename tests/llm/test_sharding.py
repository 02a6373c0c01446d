from collections import Counter, defaultdict

from duebook.llm import sharding
from pyspark.sql import functions as F


def test_law_of_rows_whole_rows_and_reruns(spark):
    rows = [(i, f"t{i % 3}", i % 5) for i in range(500)] + [(None, None, None)] * 40 + [(7, "t1", 2)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    df = df.withColumn("tags", F.create_map(F.lit("a"), F.col("slot")))  # maps have no hash of their own
    run = lambda: sorted(map(tuple, sharding.shuffle_into_shards(df, bucket_rows=50).select("doc_id", "text", "shard", "slot").collect()), key=str)
    got = run()
    assert Counter((a, b) for a, b, _, _ in got) == Counter((a, b) for a, b, _ in rows)
    slots = defaultdict(list)
    for _, _, shard, slot in got:
        slots[shard].append(slot)
    assert sorted(slots) == list(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert got == run()


def test_order_is_not_the_input_order(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    got = sorted((r["slot"] * 16 + r["shard"], r.doc_id) for r in sharding.shuffle_into_shards(df, bucket_rows=100).collect())
    ids = [x[1] for x in got]
    assert ids != sorted(ids)
    up = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 850 < up < 1150


def test_empty_and_written(spark, tmp_path):
    assert sharding.shuffle_into_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.range(40).withColumnRenamed("id", "doc_id")
    sharding.write_shards(sharding.shuffle_into_shards(df), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.select("shard").distinct().count() == 16
