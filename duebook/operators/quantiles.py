"""Exact quantiles by selection: counts of ranges tell where each rank lies, and only those ranges are searched."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_path


def counted_ranges(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(name, value, n, part): how often each column holds each value, in sorted ranges of bounded size, kept as a table.

    Equal values are counted before they are sent, so a value of a third of all rows is one row here. Ranges hold
    distinct values; nulls are left out, and NaN sorts above all numbers.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), c.cast("double").alias("value")) for k, c in columns.items()))
    found = rows.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    path = shared_path(rows.sparkSession, "ranges")
    found.repartitionByRange("name", "value").withColumn("part", F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.schema("name string, value double, n long, part int").parquet(path)


def exact(rows: DataFrame, wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """One row with a column for each of ``wanted`` (name: column, share from 0 to 1): linear between the two nearest values, null without values.

    Three passes whatever the data: values are counted and dealt into sorted ranges once for all columns, the
    ranges' totals place each rank, and running counts inside the few ranges that hold a rank find its value.
    """
    spark = rows.sparkSession
    text = {}  # the same column at several shares is counted once
    for name, (column, share) in wanted.items():
        if not 0 <= share <= 1:
            raise ValueError(f"a share outside 0 to 1: {name}")
        text.setdefault(str(column), (f"c{len(text)}", column))
    table = counted_ranges(rows, dict(text.values()))
    shares = spark.createDataFrame([(k, text[str(c)][0], float(q)) for k, (c, q) in wanted.items()], "alias string, name string, share double")
    totals = table.groupBy("name", "part").agg(F.sum("n").alias("held"))  # one row for each column and range
    mine = Window.partitionBy("name")
    totals = totals.select("name", "part", "held", (F.sum("held").over(mine.orderBy("part")) - F.col("held")).alias("base"), F.sum("held").over(mine).alias("total"))
    ranks = totals.join(F.broadcast(shares), "name").withColumn("at", F.col("share") * (F.col("total") - 1))  # as many rows as were asked for
    ranks = ranks.withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at")))).filter("base <= rank AND rank < base + held")
    ranks = ranks.select("name", "part", "base", "alias", "at", "rank").distinct()
    # both sides have at most two rows for each of ``wanted``, but for the searched ranges themselves
    inside = table.join(F.broadcast(ranks.select("name", "part", "base").distinct()), ["name", "part"])
    running = inside.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("name", "part").orderBy("value"))).withColumn("from", F.col("upto") - F.col("n"))
    hit = running.join(F.broadcast(ranks.select("name", "part", "alias", "at", "rank")), ["name", "part"]).filter("from <= rank AND rank < upto")
    # of one rank between two values, both have weights that add up to 1; a rank that is whole has one value
    part = F.when(F.floor("at") == F.ceil("at"), F.col("value")).when(F.col("rank") == F.floor("at"), (F.ceil("at") - F.col("at")) * F.col("value")).otherwise((F.col("at") - F.floor("at")) * F.col("value"))
    hit = hit.select("alias", "rank", part.alias("part")).groupBy("alias").agg(F.sum("part").alias("value"))
    return hit.agg(*(F.max(F.when(F.col("alias") == k, F.col("value"))).alias(k) for k in wanted))


def beside(facts: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of two tables of one row each as one row."""
    return facts.withColumn("__one", F.lit(1)).join(found.withColumn("__one", F.lit(1)), "__one").drop("__one")
