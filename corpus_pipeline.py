"""Corpus preparation in five stages, each written as a table before the next begins.

Each stage judges rows, not ids: it numbers its rows, and the number stands for the id in every
decision and join. So rows with a null id, and each of several rows that share one, are kept, dropped
and repeated by their own text.
"""

from __future__ import annotations

from duebook.llm import decontaminate, language, mixing, ngram_join, sharding
from duebook.llm.store import keep, small
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row that stays the same.

    Rows of Parquet files are numbered by file and place, so nothing is written but the list of files;
    other rows are written with their numbers.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return keep(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    listed = placed.select("__file").distinct()
    listed = keep(listed.select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).cast("long").alias("__no")), "files")
    number = F.shiftleft("__no", 40) + F.col("__at")
    return placed.join(small(listed, listed.count()), "__file").withColumn(_ROW, number).drop("__file", "__at", "__no")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row's number as its id."""
    return docs.select(F.col(_ROW).alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered ``docs`` less the rows whose numbers are ``gone`` (doc_id, unique); the number is dropped."""
    gone = keep(gone.select(F.col("doc_id").alias(_ROW)), "rejected")
    return docs.join(small(gone, gone.count()), _ROW, "left_anti").drop(_ROW)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language (null, or no letter) go, each row by its own text."""
    docs = _numbered(docs.filter("text IS NOT NULL"))
    found = language.identify(_texts(docs), language.fit(docs.filter(~language.held_out())))
    return _without(docs, found.filter(F.col("lang_pred") == language.UNDETERMINED))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each group stays, one with a null id only where no other is; ties fall to any one row."""
    docs = _numbered(docs)
    linked = keep(ngram_join.ngram_jaccard_groups(_texts(docs)).filter("doc_id <> component_id").select("doc_id", "component_id"), "linked")
    heads = linked.select(F.col("component_id").alias("doc_id"), "component_id").distinct()
    members = linked.unionByName(heads).withColumnRenamed("doc_id", _ROW)
    members = keep(members.join(docs.select(_ROW, "doc_id"), _ROW), "members")
    least = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", _ROW)).alias("least"))
    gone = members.join(least.select(F.col(f"least.{_ROW}").alias(_ROW)), _ROW, "left_anti")
    return _without(docs, gone.select(F.col(_ROW).alias("doc_id")))


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text."""
    docs = _numbered(docs)
    found = decontaminate.contamination(_texts(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole number."""
    names, docs = docs.columns, _numbered(docs)
    times = F.expr("CAST(floor(taken / size + 0.5D) AS INT)").alias("__times")
    times = keep(mixing.mixed_rows(docs, _ROW).select(_ROW, times).filter("__times > 0"), "times")
    return docs.join(small(times, times.count()), _ROW).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(names)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in shuffled shards: their columns with ``shard`` and ``slot``."""
    sized = docs.withColumn("__text_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return sharding.shuffle_into_shards(sized, size_col="__text_bytes").drop("__text_bytes")


STAGES = [
    ("language_id", identify_languages),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", remove_benchmark_text),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The language model and the seeded order of the mix have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
