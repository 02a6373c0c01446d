"""Work that costs far more than its bytes say, over as many tasks as a shuffle has."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A task of a shuffle gets about so many rows at most.
ROWS = 1 << 18


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in turn, or by ``keys``, over spark.sql.shuffle.partitions tasks, or three for each core if that is more.

    Splits of files and adaptive partitions go by bytes, so a small file of texts would be read into fields by one task.
    """
    session = rows.sparkSession
    return rows.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism), *keys)


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over as many tasks as ``count`` rows need, spark.sql.shuffle.partitions at least.

    Joins, groups and windows by these keys take that partitioning over, so what one task holds stays the same as the tables grow.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS)), *keys)
