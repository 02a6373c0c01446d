"""Jaccard join on word shingles by token-combination prefixes.

A document's set is its distinct shingles of five words, as 64-bit hashes in hash order. Two
sets of Jaccard similarity 0.8 or more share many tokens among the first fifth of each, so a
prefix of that length is indexed. The prefix is extended by three tenths of the set. A token class is
rare or frequent by the number of groups of documents whose prefix holds the token:

* rare tokens are indexed singly;
* frequent ones (boilerplate, shared passages) don't count towards the prefix, which its extension
  makes up for. Documents whose prefix has more frequent tokens than its extension are indexed by
  the rare tokens of their whole sets. Those whose whole sets have too few rare ones even then are
  indexed by two-token combinations of frequent tokens, within classes by token hash.

Exact copies are one class by a 128-bit digest of the set. Before the join, documents are linked
to the least document with the same minimum hash, under three permutations, each link verified.
The components so found are the groups: one large group of near copies counts once in the index,
and no group is expanded into pairs of its members. Pairs of groups are verified between their
least members; where that finds no link, the members of the smaller group are guests of the larger
one. Guests and members are dealt into blocks of bounded size, and each two blocks are compared by
one matrix product that returns at most one link for each guest. So every link between different
texts ends in a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .store import arrow_rows, keep, small

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Tokens in the prefixes of more groups than this are frequent.
FREQUENT = 64
PERMUTATIONS = 6
#: Bytes of text whose words are hashed at once: a task needs about sixty times as many.
SLICE_BYTES = 1 << 19
#: Documents and shingles of a block, about.
BLOCK_DOCS, BLOCK_TOKENS = 128, 1 << 15
#: Documents whose sizes are within the ratio allowed by PERCENT are at most one size class apart.
_RATIO = 100 / PERCENT


def _need(n: np.ndarray | int):
    return -(-PERCENT * n // 100)


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(_RATIO)).astype(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest, minimum hashes and extended prefix of each document's set."""
    for batch in batches:
        for at, v, first in _sets(batch.column(1)):
            n = np.diff(first)
            have = n > 0
            begin = first[:-1][have]

            def of_rows(x: np.ndarray, how: np.ufunc) -> np.ndarray:
                out = np.zeros(len(n), np.uint64)
                if len(begin):
                    out[have] = how.reduceat(x, begin)
                return out.view(np.int64)

            prefix = n - _need(n) + 1
            taken = np.where(have, np.minimum(n, prefix + np.maximum(1, -(-3 * n // 10))), 0)
            where = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken - first[:-1], taken)
            columns = [
                batch.column(0).slice(at, len(n)),
                pa.array(n.astype(np.int32)),
                pa.array(of_rows(tx.mix(v, 11), np.add)),
                pa.array(of_rows(tx.mix(v, 12), np.add)),
                *(pa.array(of_rows(tx.mix(v, 20 + j), np.minimum)) for j in range(PERMUTATIONS)),
                pa.array(_size_class(n).astype(np.int32)),
                pa.array(np.where(have, taken - prefix, 0).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)), pa.array(v[where].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, _SKETCH_NAMES)


_SKETCH_NAMES = ["doc_id", "n", "d1", "d2", *(f"m{j}" for j in range(PERMUTATIONS)), "s", "slack", "tokens"]
_SKETCH = "doc_id long, n int, d1 long, d2 long, " + ", ".join(f"m{j} long" for j in range(PERMUTATIONS)) + ", s int, slack int, tokens array<long>"


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles, each row's first one) of runs of texts."""
    for at, raw, offsets in tx.slices(column, SLICE_BYTES):
        raw = tx.LOWER[raw]
        starts, ends, first = tx.spans(raw, offsets, tx.SPACE)
        yield at, *tx.sorted_sets(*tx.windows(tx.word_hashes(raw, starts, ends), first, SHINGLE))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's whole set and its size."""
    for batch in batches:
        for at, v, first in _sets(batch.column(1)):
            tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(v.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(first) - 1), tokens], ["doc_id", "tokens"])


#: Rows of units that are united at once, at most about 4 MB each.
JOINED = 16
_UNIT = "grp long, s int, n int, tokens array<long>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of whole sets of documents of one group and size class that stand together, and their least size."""
    for batch in batches:
        groups = batch.column(0).to_numpy()
        for at, v, first in _sets(batch.column(1)):
            n = np.diff(first)
            keys = np.stack([groups[at : at + len(n)], _size_class(n)])[:, n > 0]
            unit = np.repeat(np.cumsum(np.append(0, (np.diff(keys) != 0).any(0)))[: keys.shape[1]], n[n > 0])
            order = np.lexsort((v, unit))
            once = np.append(True, (np.diff(unit[order]) != 0) | (np.diff(v[order]) != 0))[: len(v)]
            v, unit = v[order][once], unit[order][once]
            begin = np.flatnonzero(np.append(True, np.diff(unit) != 0)[: len(v)])
            which = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(0))[: keys.shape[1]])
            least = np.minimum.reduceat(n[n > 0], which) if len(which) else n[:0]
            tokens = pa.ListArray.from_arrays(pa.array(np.append(begin, len(v)).astype(np.int32)), pa.array(v.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][which]), pa.array(keys[1][which].astype(np.int32)), pa.array(least.astype(np.int32)), tokens], ["grp", "s", "n", "tokens"])


def _joined_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of one group and size class that follow each other, united again."""
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)])
        edges = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(0))[: batch.num_rows])
        flat, offsets = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
        offsets = offsets - offsets[0] if len(offsets) else offsets
        sets = [np.unique(flat[offsets[a] : offsets[b]].view(np.uint64)).view(np.int64) for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True)]
        least = np.minimum.reduceat(batch.column(2).to_numpy(zero_copy_only=False), edges) if len(edges) else np.zeros(0, np.int32)
        begin = np.cumsum([0, *(len(x) for x in sets)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(begin), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([pa.array(keys[0][edges]), pa.array(keys[1][edges].astype(np.int32)), pa.array(least.astype(np.int32)), tokens], ["grp", "s", "n", "tokens"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intersection and union of the two texts' sets in each row."""
    for batch in batches:
        both = pa.concat_arrays([batch.column(2).cast(pa.large_string()), batch.column(3).cast(pa.large_string())])
        rows = batch.num_rows
        order = np.arange(2 * rows).reshape(2, rows).T.ravel()  # the sides of a pair next to each other
        both = both.take(pa.array(order))
        sets: list[np.ndarray] = []
        for _, v, first in _sets(both):
            sets += np.split(v, first[1:-1])
        shared = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets[::2], sets[1::2], strict=True)), np.int64, rows)
        total = np.fromiter((len(x) + len(y) for x, y in zip(sets[::2], sets[1::2], strict=True)), np.int64, rows) - shared
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(total)], ["a", "b", "shared", "total"])


def overlaps(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, shared, total) of the pairs (a, b) of ids, from the whole texts of ``docs`` (doc_id, text)."""
    pairs = keep(pairs.select("a", "b"), "pairs")
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = keep(docs.join(small(ids, ids.count()), "doc_id", "left_semi"), "texts")
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return keep(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_overlaps, "a long, b long, shared long, total long"), "overlaps")


def _linked(found: DataFrame) -> DataFrame:
    return found.filter(F.col("shared") * 100 >= F.col("total") * PERCENT).select("a", "b")


def _first_links(heads: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to the least exact copy; overlaps with the least document of each minimum-hash bucket; the distinct documents."""
    same = keep(heads.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "copies")
    heads = heads.join(small(same, same.count()), ["d1", "d2", "n"], "left")
    copies = keep(heads.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), "d1"), "copy-links")
    distinct = keep(heads.filter("rep IS NULL OR rep = doc_id").drop("d1", "d2", "rep"), "distinct")
    keyed = distinct.select("doc_id", "n", F.posexplode(F.array(*(f"m{j}" for j in range(PERMUTATIONS)))).alias("j", "m"))
    buckets = keep(keyed.groupBy("j", "m").agg(F.min(F.struct("doc_id", "n")).alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("j", "m", F.col("least.doc_id").alias("b"), F.col("least.n").alias("bn")), "buckets")
    pairs = keyed.join(small(buckets, buckets.count()), ["j", "m"]).filter("doc_id <> b").filter(_sizes("n", "bn"))
    return copies, overlaps(pairs.select(F.col("doc_id").alias("a"), "b").distinct(), docs), distinct


def _sizes(x: str, y: str):
    return F.expr(f"100L * least({x}, {y}) >= {PERCENT}L * greatest({x}, {y})")


_PAIRS = """
inline(flatten(transform(units, (x, i) -> transform(
    filter(slice(units, i + 2, size(units)), y -> y.grp <> x.grp AND abs(y.s - x.s) <= 1),
    y -> struct(least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, least(x.slack, y.slack) AS slack)))))
"""
#: The least overlap of two linked sets of x and y shingles, and the pairs of units that can reach it with f frequent tokens each.
_NEED = f"({PERCENT}L * ({{x}} + {{y}}) + {99 + PERCENT}) DIV {100 + PERCENT}"
_WHOLE_PAIRS = f"""
inline(flatten(transform(units, (x, i) -> transform(
    filter(slice(units, i + 2, size(units)), y -> y.grp <> x.grp AND abs(y.s - x.s) <= 1 AND least(x.f, y.f) >= {_NEED.format(x="x.n", y="y.n")}),
    y -> struct(least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, {_NEED.format(x="x.n", y="y.n")} AS need)))))
"""
#: Token classes at a size class: a fifth of the least size. A prefix longer by as many tokens shares two in one class.
_CLASSES = f"greatest(1L, CAST(floor(0.2D * power({_RATIO}D, level)) AS LONG))"


def _candidates(sketches: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of groups (a, b) that share a rare token of their prefixes, and those of ``_whole_candidates``.

    ``groups``: (node, component) of the documents that are in a group of several; others are their own.
    """
    docs = sketches.filter("n > 0").select("doc_id", "s", "tokens", F.expr("slack * 256L + s").alias("pack"))
    docs = docs.join(small(groups, groups.count()), F.col("doc_id") == F.col("node"), "left")
    alone = docs.filter("component IS NULL").select(F.explode("tokens").alias("t"), F.col("doc_id").alias("grp"), "pack")
    several = docs.filter("component IS NOT NULL").select(F.explode("tokens").alias("t"), F.col("component").alias("grp"), "s", "pack")
    several = several.groupBy("t", "grp", "s").agg(F.min("pack").alias("pack")).drop("s")
    index = alone.unionByName(several).withColumn("c", F.count("*").over(Window.partitionBy("t"))).filter("c > 1")
    index = keep(index.selectExpr("t", "grp", "CAST(pack % 256 AS INT) AS s", "CAST(pack DIV 256 AS INT) AS slack", "c"), "index")
    lists = index.filter(F.col("c") <= FREQUENT).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("grp", "s", "slack"))).alias("units"))
    single = lists.groupBy("units").agg(F.count("*").alias("shared")).selectExpr("shared", _PAIRS).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("slack").alias("slack"))

    # a pair shares more tokens of its prefixes than the extension has, or else frequent tokens make up the rest
    common = index.filter(F.col("c") > FREQUENT)
    units = keep(common.groupBy("grp", "s").agg(F.count("*").alias("f"), F.min("slack").alias("slack")), "units")
    most = keep(units.groupBy("grp").agg(F.max("f").alias("f")), "frequent")
    rows = most.count()
    for k in "ab":
        single = single.join(small(most.selectExpr(f"grp AS {k}", f"f AS f{k}"), rows), k, "left")
    single = single.filter("shared + least(coalesce(fa, 0), coalesce(fb, 0)) > slack").select("a", "b")

    # where only frequent tokens are shared, both units have more of them than the smaller slack, which is 0.8 of the other at least
    needy = keep(units.filter("10 * f > 8 * slack").select("grp").distinct(), "needy")
    count = needy.count()
    if not count:
        return single
    ids = docs.select("doc_id", F.coalesce("component", "doc_id").alias("grp")).join(small(needy, count), "grp", "left_semi").distinct()
    return single.union(_whole_candidates(keep(ids, "needy-ids"), texts)).distinct()


def _whole_candidates(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of groups (a, b) of ``ids`` (doc_id, grp) that share a rare token, or a combination of frequent ones, of their whole sets.

    A unit is what the members of one size class of a group hold together; its sets are united before they
    are sent, as near copies share most tokens. The overlap of two units is at most their shared rare tokens
    and the frequent ones of the unit that has fewer; pairs that can't reach the overlap of a link by that are
    left out. Units that share no rare token share at least ``_need`` frequent ones each. So only units with
    that many are indexed by combinations, of a prefix of their frequent tokens in hash order.
    """
    rows = texts.join(small(ids, ids.count()), "doc_id").select("grp", "doc_id", "text")
    rows = rows.repartitionByRange("grp", "doc_id").sortWithinPartitions("grp", F.length("text"))
    # units of a group come from many tasks: those of each JOINED neighbouring tasks are united before they are sent by token
    units = rows.select("grp", "text").mapInArrow(_units, _UNIT).withColumn("near", F.expr(f"spark_partition_id() DIV {JOINED}"))
    units = keep(units, "units")
    arrow_rows(texts.sparkSession, JOINED)
    units = keep(units.repartition("grp", "s", "near").drop("near").sortWithinPartitions("grp", "s").mapInArrow(_joined_units, _UNIT), "united")
    arrow_rows(texts.sparkSession)
    index = units.select("grp", "s", "n", F.explode("tokens").alias("t")).groupBy("t", "grp", "s").agg(F.min("n").alias("n"))
    # the groups that hold each token: both windows run on one shuffle and one sort
    place = index.withColumn("place", F.dense_rank().over(Window.partitionBy("t").orderBy("grp")))
    index = keep(place.withColumn("c", F.max("place").over(Window.partitionBy("t"))).filter("c > 1").drop("place"), "whole-index")
    least = units.groupBy("grp", "s").agg(F.min("n").alias("n")).withColumn("need", F.expr(f"(n * {PERCENT} + 99) DIV 100"))
    held = index.filter(F.col("c") > FREQUENT).groupBy("grp", "s").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    held = keep(held.join(least, ["grp", "s"]), "held")
    most = keep(held.groupBy("grp").agg(F.max(F.size("ts")).alias("f")), "frequent")
    groups = most.count()

    # f is no bound yet, since shared rare tokens add to it
    lists = index.filter(F.col("c") <= FREQUENT).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("grp", "s", "n", F.lit(1 << 30).alias("f")))).alias("units"))
    single = lists.groupBy("units").agg(F.count("*").alias("shared")).selectExpr("shared", _WHOLE_PAIRS).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
    for k in "ab":
        single = single.join(small(most.selectExpr(f"grp AS {k}", f"f AS f{k}"), groups), k, "left")
    single = single.filter("shared + least(coalesce(fa, 0), coalesce(fb, 0)) >= need").select("a", "b")

    full = held.filter("size(ts) >= need")
    return single.union(_combination_pairs(full)) if full.limit(1).count() else single


def _combination_pairs(full: DataFrame) -> DataFrame:
    """Pairs of groups (a, b) whose units (grp, s, n, need, ts) share a combination of two frequent tokens ``ts``."""
    levels = full.select("*", F.size("ts").alias("f"), F.explode(F.expr("array(s, s - 1)")).alias("level")).filter("level >= 0").withColumn("classes", F.expr(_CLASSES))
    prefix = levels.select("grp", "s", "n", "f", "level", "classes", F.explode(F.expr("slice(ts, 1, CAST(size(ts) - need + 1 + classes AS INT))")).alias("t"))
    sets = prefix.groupBy("grp", "s", "n", "f", "level", F.expr("pmod(t, classes)").alias("class")).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    combos = sets.selectExpr("grp", "s", "n", "f", "level", "inline(flatten(transform(ts, (x, i) -> transform(slice(ts, i + 2, size(ts)), y -> struct(x AS t1, y AS t2)))))")
    same = combos.groupBy("level", "t1", "t2").agg(F.array_sort(F.collect_list(F.struct("grp", "s", "n", "f"))).alias("units")).filter("size(units) > 1")
    return same.select("units").distinct().selectExpr(_WHOLE_PAIRS).select("a", "b").distinct()


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link from each guest to the least member of the other block that it is near to."""
    for batch in batches:
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ids_a, sets_a, ids_b, sets_b in zip(*batch.columns, strict=True):
            sides = []
            for ids, sets in ((ids_a, sets_a), (ids_b, sets_b)):
                lists = sets.values
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
                sides.append((ids.values.to_numpy(zero_copy_only=False), flat, sizes))
            words = np.intersect1d(sides[0][1], sides[1][1])  # as both sides are distinct per set, shared tokens decide
            if not len(words):
                continue
            matrices = []
            for _, flat, sizes in sides:
                place = np.minimum(np.searchsorted(words, flat), len(words) - 1)
                held = words[place] == flat
                m = np.zeros((len(sizes), len(words)), np.float32)
                m[np.repeat(np.arange(len(sizes)), sizes)[held], place[held]] = 1
                matrices.append(m)
            shared = np.rint(matrices[0] @ matrices[1].T).astype(np.int64)
            total = sides[0][2][:, None] + sides[1][2][None, :] - shared
            near = (shared * 100 >= total * PERCENT) & (sides[0][0][:, None] != sides[1][0][None, :])
            least = np.where(near, sides[1][0][None, :], np.iinfo(np.int64).max).min(1)
            some = near.any(1)
            out_a.append(sides[0][0][some]), out_b.append(least[some])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def _blocks(rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(host, block, ids, sets): documents of ``rows`` (host, m, n) dealt into blocks of bounded size with their sets."""
    counts = rows.groupBy("host").agg(F.expr(f"CAST(ceil(greatest(count(*) / {BLOCK_DOCS}, sum(n) / {BLOCK_TOKENS})) AS INT)").alias("blocks"))
    counts = keep(counts, "block-counts")
    dealt = rows.join(small(counts, counts.count()), "host").select("host", "m", F.expr("pmod(xxhash64(m), blocks)").alias("block"))
    with_sets = dealt.join(sets.select(F.col("doc_id").alias("m"), "tokens"), "m")
    return keep(with_sets.groupBy("host", "block").agg(F.collect_list("m").alias("ids"), F.collect_list("tokens").alias("sets")), name)


def _between_members(apart: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of the groups of each pair ``apart`` (a, b); ``members``: (g, m, n), lone documents as well.

    The smaller group's members are guests of the larger one. A pair of blocks is one row.
    """
    spark = texts.sparkSession
    count = keep(members.groupBy("g").agg(F.count("*").alias("members")), "group-sizes")
    groups = count.count()
    for k in "ab":
        apart = apart.join(small(count.selectExpr(f"g AS {k}", f"members AS n{k}"), groups), k)
    placed = keep(apart.selectExpr("if(na >= nb, a, b) AS host", "if(na >= nb, b, a) AS g"), "placed")
    guests = keep(placed.join(members, "g").select("host", "m", "n").distinct(), "guests")
    hosts = keep(placed.selectExpr("host AS g").distinct().join(members, "g").selectExpr("g AS host", "m", "n"), "hosts")
    ids = keep(guests.select("m").union(hosts.select("m")).distinct().withColumnRenamed("m", "doc_id"), "block-ids")
    rows = texts.join(small(ids, ids.count()), "doc_id").select("doc_id", "text")
    sets = keep(rows.mapInArrow(_whole_sets, "doc_id long, tokens array<long>"), "block-sets")
    one = _blocks(guests, sets, "guest-blocks").select("host", F.col("ids").alias("ia"), F.col("sets").alias("sa"))
    other = _blocks(hosts, sets, "host-blocks").select("host", F.col("ids").alias("ib"), F.col("sets").alias("sb"))
    arrow_rows(spark, 8)
    found = keep(one.join(other, "host").select("ia", "sa", "ib", "sb").mapInArrow(_block_links, "a long, b long"), "block-links")
    arrow_rows(spark)
    return found


def ngram_jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: the groups linked by near-equal texts.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A null or wordless
    text has an empty set and is its own component; fewer words than five are one shingle. Rows that
    repeat an id are one document: it is linked by any of its texts. A row with a null id is returned
    with a null component. Other columns are ignored. An empty table gives no rows.
    """
    arrow_rows(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = keep(docs.mapInArrow(_sketches, _SKETCH), "sketches")
    heads = sketches.filter("n > 0 AND doc_id IS NOT NULL").drop("tokens", "s", "slack")
    texts = docs.filter("doc_id IS NOT NULL")
    copies, near, distinct = _first_links(heads, texts)
    edges = keep(copies.select("a", "b").union(_linked(near)), "links")
    groups = components(edges)

    indexed = sketches.filter("doc_id IS NOT NULL").join(small(copies.select(F.col("a").alias("doc_id"), "d1"), copies.count()), ["doc_id", "d1"], "left_anti")
    across = overlaps(_candidates(indexed, groups, texts), texts)
    edges = keep(edges.union(_linked(across)), "links")
    merged = components(edges)

    # pairs of groups that are still apart, at least one of several distinct documents
    several = keep(groups.join(distinct.selectExpr("doc_id AS node", "n"), "node").selectExpr("node AS m", "component AS g", "n"), "members")
    large = keep(several.filter("m <> g").select("g").distinct(), "large")
    rows = large.count()
    apart = across.select("a", "b")
    for k in "ab":
        apart = apart.join(merged.selectExpr(f"node AS {k}", f"component AS c{k}"), k, "left").join(small(large.selectExpr(f"g AS {k}", f"true AS l{k}"), rows), k, "left")
    apart = keep(apart.filter("coalesce(ca, a) <> coalesce(cb, b) AND (la OR lb)").select("a", "b"), "apart")
    if apart.limit(1).count():
        involved = keep(apart.select(F.explode(F.array("a", "b")).alias("g")).distinct(), "involved")
        members = several.join(small(involved, involved.count()), "g", "left_semi").select("g", "m", "n")
        lone = involved.join(members, "g", "left_anti").join(distinct.selectExpr("doc_id AS g", "n"), "g").selectExpr("g", "g AS m", "n")
        inner = _between_members(apart, keep(members.union(lone), "block-members"), texts)
        merged = components(keep(edges.union(inner), "links"))
    out = sketches.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    return out.join(merged.selectExpr("node AS doc_id", "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
