"""Run a stream over what its source holds now, and read the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import shared_path


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parque[t]")


def finished(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, newest: list[str] | None = None, path: str | None = None) -> DataFrame:
    """All rows that ``stream`` has given once its source is exhausted.

    Each batch goes to its own folder, which a repeated batch overwrites, so delivery at least once gives each
    row once. With a ``path``, a later call goes on where the last one ended, and its result holds both. With
    ``keys``, later batches replace rows of earlier ones with equal keys, as in update mode; of rows of one
    batch the one that is last by ``newest`` stands.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    kind = stream.select("*", F.lit(0).alias("batch")).schema
    rows = spark.read.schema(kind).option("ignoreMissingFiles", True).parquet(f"{path}/row[s]")
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.desc("batch"), *(F.desc(c) for c in newest or []))
        rows = rows.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")
    return rows.drop("batch")
