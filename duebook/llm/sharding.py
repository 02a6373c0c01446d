"""Two-pass external shuffle into shards, with DataFrame operations only.

Pass one scatters the rows uniformly into buckets that fit in memory, by a seeded hash. Pass two
shuffles each bucket with a Fisher-Yates permutation (Spark's ``shuffle`` of the bucket's positions)
and lays the buckets one after another; the rows are dealt from there to the shards in turn, so
that the shards' row counts are at most one apart. Only hashes and sizes take part in that; the rows
themselves move once, to their places. Rows equal in all columns are one row with a count until then,
so a large group of them is never sorted or sent as rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, small

SHARDS = 16
BUCKET_ROWS = 4096
BUCKET_BYTES = 32 << 20
SEED = 20240531
_KEY = ["__h", "__g"]


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, size_col: str | None = None, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard) for every row.

    The 128-bit hash covers all columns, so that rows with one id or one text still spread; rows equal in
    all columns are numbered apart. ``size_col`` names a column of bytes, to bound a bucket's memory.
    Nulls hash like any value. Columns named shard or slot are replaced. An empty table gives no rows.
    Reruns give the same places.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    hashed = [F.to_json(F.col(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), *hashed)).withColumn("__g", F.xxhash64(F.lit(seed + 3), *hashed))
    size = F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)) if size_col else F.lit(0).cast("long")
    # rows equal in all columns: counted before the shuffle, then numbered
    light = keep(rows.select(*_KEY, size.alias("__bytes")).groupBy(*_KEY).agg(F.count("*").alias("copies"), F.max("__bytes").alias("__bytes")), "counted")
    total = light.agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("__bytes")).alias("b"), F.count_if(F.col("copies") > 1).alias("repeated")).first()
    buckets = max(1, math.ceil((total.n or 0) / bucket_rows), math.ceil((total.b or 0) / bucket_bytes))
    copies = light.select(*_KEY, F.explode(F.expr("sequence(1L, copies)")).alias("__copy"))
    copies = copies.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), *_KEY, "__copy"), F.lit(buckets)))
    copies = keep(copies.withColumn("__at", F.row_number().over(Window.partitionBy("__bucket").orderBy(*_KEY, "__copy")) - 1), "scattered")

    sizes = keep(copies.groupBy("__bucket").agg(F.count("*").alias("__n")), "buckets")
    largest = sizes.agg(F.max("__n")).first()[0] or 1
    places = df.sparkSession.range(0, buckets, 1, min(buckets, 256)).select(F.col("id").alias("__bucket"), F.posexplode(F.shuffle(F.sequence(F.lit(0), F.lit(largest - 1)), seed + 2)).alias("__rank", "__at"))
    bases = sizes.withColumn("__base", F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n"))
    # the permutation of the largest bucket's positions, kept to a bucket's own, is a permutation of those
    places = places.join(small(bases, buckets), "__bucket").filter("__at < __n")
    dealt = F.row_number().over(Window.partitionBy("__bucket").orderBy("__rank")) - 1 + F.col("__base")
    places = places.select("__bucket", "__at", dealt.alias("__dealt"))
    placed = copies.join(places, ["__bucket", "__at"]).select(*_KEY, "__dealt")
    if total.repeated:
        repeated = light.filter("copies > 1").select(*_KEY)
        rows = rows.join(small(repeated, total.repeated), _KEY, "left_anti").unionByName(rows.join(small(repeated, total.repeated), _KEY, "left_semi").dropDuplicates(_KEY))
    shard = F.expr(f"CAST(__dealt % {shards} AS INT)")
    return rows.join(placed, _KEY).select(*(F.col(f"`{c}`") for c in names), shard.alias("shard"), F.expr(f"__dealt DIV {shards}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder for each shard with files in slot order, as many as the sizes ask for."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
