"""Mixing of sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Slot i of the mix takes the golden-ratio point frac(i * phi), looked up in the cumulative target
shares of the sources; a slot's rank among those of its source names the block that it takes. The
blocks of a source are stretches of equally many words of its documents in a seeded random order,
repeated as often as needed, the last one cut where the source's target is met. So any stretch of
the mix is near the target shares, and a document's repeats are far apart. Blocks that a source's
slots do not reach, as those of a source far smaller than a block, get slots of their own, evenly
spread between the others, so every source meets its target whatever the size of the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, small

#: A source's weight by its place in code point order, the mix's size and a source's most, relative to the input.
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BLOCK_WORDS = 256
SEED = 77
_SLOTS = 16384  # slots that are ranked together
_PHI = 0.6180339887498949


def word_count(column: str):
    """Words of a text: runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.expr(rf"regexp_count(`{column}`, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size), one row per source.

    Shares of ``total`` times all sizes go by weight; a source gets ``most`` times its size at most and
    the excess goes to the others by weight. With sources in order of that limit relative to weight,
    the first ones are limited, and those after them divide the rest.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * float(most)
    placed = placed.withColumn("w", weight).withColumn("limit", limit).withColumn("all", F.sum("source_size").over(everything) * float(total))
    order = Window.orderBy(F.col("limit") / F.col("w"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = placed.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("limit"))
    first_open = F.when(F.col("open"), F.struct(F.col("limit") / F.col("w"), "place"))
    final = F.min_by("level", first_open).over(everything)
    return placed.withColumn("final", final).select("source", "source_size", "place", F.least("limit", F.coalesce(F.col("final") * F.col("w"), "limit")).alias("target"))


def _shuffled(docs: DataFrame, seed: int) -> DataFrame:
    """Each document's first word within its source, documents in seeded random order.

    Running sums are taken within ranges of the random key and then over the ranges, so that no
    source's rows meet in one task.
    """
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "uid")).withColumn("range", F.shiftright("h", 52))
    within = Window.partitionBy("place", "range").orderBy("h", "uid")
    docs = docs.withColumn("start", F.sum("size").over(within) - F.col("size"))
    ranges = keep(docs.groupBy("place", "range").agg(F.sum("size").alias("words")), "ranges")
    base = F.sum("words").over(Window.partitionBy("place").orderBy("range")) - F.col("words")
    ranges = keep(ranges.select("place", "range", base.alias("base")), "bases")
    docs = docs.join(small(ranges, ranges.count()), ["place", "range"])
    return docs.withColumn("start", F.col("start") + F.col("base")).drop("base", "range", "h")


def _schedule(plan: DataFrame, slots: int, sources: int, block_words: int | None = None) -> DataFrame:
    """(slot, place, block): the source of each slot and the slot's rank within it.

    With ``block_words``, the blocks that a source's target needs beyond its slots have slots too; the
    slots' numbers then have gaps.
    """
    spark = plan.sparkSession
    share = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(Window.orderBy("place"))
    bins = max(1024, 4 * sources)
    cuts = plan.filter("target > 0").select("place", ((upto - F.col("target")) / share).alias("low"), (upto / share).alias("high"))
    last = F.max("place").over(Window.partitionBy())
    cuts = cuts.withColumn("high", F.when(F.col("place") == last, 2.0).otherwise(F.col("high")))
    cuts = keep(cuts.withColumn("bin", F.explode(F.expr(f"sequence(CAST(floor(low * {bins}) AS BIGINT), CAST(floor(least(high, 1D) * {bins}) AS BIGINT))"))), "cuts")
    # i * phi in two parts keeps the fraction exact to many digits for any i
    part = 1 << 20
    point = F.expr(f"(id DIV {part}) * {part * _PHI % 1!r}D") + F.expr(f"(id % {part} + 1) * {_PHI!r}D")
    points = spark.range(0, slots, 1, max(1, min(2000, slots // (16 * _SLOTS) + 8))).withColumn("x", point - F.floor(point)).withColumn("bin", F.floor(F.col("x") * bins))
    owned = points.join(small(cuts, cuts.count()), "bin").filter("x >= low AND x < high").select(F.col("id").alias("slot"), "place", F.expr(f"id DIV {_SLOTS}").alias("run"))
    runs = owned.groupBy("place", "run").agg(F.count("*").alias("n"))
    runs = keep(runs.select("place", "run", "n", (F.sum("n").over(Window.partitionBy("place").orderBy("run")) - F.col("n")).alias("base")), "runs")
    rank = F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1
    owned = owned.withColumn("rank", rank).join(small(runs.drop("n"), runs.count()), ["place", "run"])
    owned = owned.select("slot", "place", (F.col("rank") + F.col("base")).alias("block"))
    return owned if block_words is None else _completed(owned, plan, runs, slots, block_words)


def _completed(owned: DataFrame, plan: DataFrame, runs: DataFrame, slots: int, block_words: int) -> DataFrame:
    """``owned`` with the blocks that its sources lack, each between two of its slots.

    A source lacks its last block and what the discrepancy of the schedule took from it, so the rows
    that are numbered here are a few for each source.
    """
    met = runs.groupBy("place").agg(F.sum("n").alias("met"))
    need = plan.filter("target >= 1").select("place", F.expr(f"CAST(floor(target) + {block_words - 1} AS BIGINT) DIV {block_words}").alias("need"))
    lack = need.join(met, "place", "left").withColumn("met", F.coalesce("met", F.lit(0))).filter("need > met")
    # a source's blocks lie evenly around the circle, and the sources' first ones at golden-ratio points
    turn = F.col("place") * _PHI + (F.col("block") - F.col("met")) / (F.col("need") - F.col("met"))
    lack = lack.withColumn("block", F.explode(F.expr("sequence(met, need - 1)"))).withColumn("turn", turn - F.floor(turn))
    lack = keep(lack.select("place", "block", (F.row_number().over(Window.orderBy("turn", "place", "block")) - 1).cast("long").alias("k")), "lacking")
    n = lack.count()
    if not n:
        return owned
    between = -(-n // max(1, slots))
    at = F.expr(f"(k * {max(1, slots)} DIV {n}) * {between + 1} + 1 + k % {between}")
    return owned.withColumn("slot", F.col("slot") * (between + 1)).unionByName(lack.select(at.alias("slot"), "place", "block"))


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (uid, source, size), and the plan (source, source_size, place, target).

    The mix has a row (slot, uid, from_word, to_word) for each stretch of a document in each slot, in
    words of the document; ``uid`` has to be unique. A source that is null is one source, the last.
    Documents without words, and an empty table, take part in no slot.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = keep(targets(keep(sizes, "sizes")), "plan")
    facts = plan.filter("target > 0").agg(F.sum("target").alias("t"), F.count("*").alias("n")).first()
    schedule = _schedule(plan, math.ceil((facts.t or 0) / block_words), facts.n, block_words)
    named = plan.select("source", "place", "source_size", F.floor("target").alias("upto"))
    docs = docs.filter("size > 0").join(small(named, facts.n), docs["source"].eqNullSafe(named["source"])).select("uid", "size", "place", "source_size", "upto")
    spans = _shuffled(docs, seed).withColumn("round", F.explode(F.expr(f"sequence(0L, {math.ceil(MOST)}L)")))
    spans = spans.withColumn("a", F.expr("start + round * source_size")).withColumn("b", F.expr("least(a + size, upto)")).filter("a < b")
    spans = spans.withColumn("block", F.explode(F.expr(f"sequence(a DIV {block_words}, (b - 1) DIV {block_words})")))
    taken = spans.join(schedule, ["place", "block"])
    first, last = F.greatest("a", F.col("block") * block_words), F.least("b", (F.col("block") + 1) * block_words)
    return taken.select("slot", "uid", (first - F.col("a")).alias("from_word"), (last - F.col("a")).alias("to_word")), plan


def mixed_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    Equal rows are told apart by a number, so each counts; a null id is kept. ``taken`` is the number
    of words of the row in the mix, repeats counted.
    """
    docs = docs.select("doc_id", "source", word_count("text").alias("size"))
    docs = docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    docs = keep(docs.select(F.struct("doc_id", "source", "size", "copy").alias("uid"), "source", "size"), "sized")
    mixed, plan = mix(docs, seed)
    taken = mixed.groupBy("uid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    plan = plan.select("source", "source_size", "target")
    rows = docs.join(small(plan, plan.count()), docs["source"].eqNullSafe(plan["source"])).select(docs["uid"], docs["size"], "source_size", "target")
    rows = rows.join(taken, "uid", "left")
    return rows.select(F.col("uid.doc_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), F.col("uid.source").alias("source"))


def mixed_rows(docs: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """(key, size, taken) for the rows of ``docs`` (key, doc_id, text, source) that the mix takes words of.

    ``key`` names a column that is unique. The order of the mix does not come from it, so where ids are
    unique a row's words are those that ``mixed_sizes`` gives. Rows that share an id, or have none, count each.
    """
    hashed = [c for c, kind in docs.dtypes if c != key and not kind.startswith(("map", "variant"))]
    docs = docs.select(key, "doc_id", "source", word_count("text").alias("size"), F.xxhash64(*hashed).alias("digest"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("digest", key)
    docs = docs.withColumn("copy", F.row_number().over(same).cast("long"))
    docs = keep(docs.select(key, F.struct("doc_id", "source", "size", "copy").alias("uid"), "source", "size"), "sized")
    mixed, _ = mix(docs.select("uid", "source", "size"), seed)
    taken = mixed.groupBy("uid").agg(F.sum(F.col("to_word") - F.col("from_word")).cast("long").alias("taken"))
    return docs.join(taken, "uid").select(key, "size", "taken")
