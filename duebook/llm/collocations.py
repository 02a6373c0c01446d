"""Phrase collocations by direct-address tiles of frequency-ranked ids.

Words of each language are counted, and those frequent enough to stand in a candidate are ranked by
frequency. In a task each adjacent pair of ids falls into a tile, a square of ids beside ids; a tile
with many pairs is counted by a dense ``bincount`` over its addresses, the others together as sorted
coordinates. Spark adds up the counts of the tasks. Frequent pairs are then ranked by frequency
themselves, and triples are counted in the same way as (pair, word) tiles.

What goes to the tasks is bounded: the HEAD most frequent words and pairs with their ids, and a bit set
of BITS places for all that are frequent. What is not in the head but in the bit set is sent on by its
words, pre-aggregated, and finds its ids by joins, so nothing is lost; what the bit set rejects can't
reach the least count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .store import arrow_rows, keep, small

LEAST, TOP, INSIDE = 10, 2000, 50
HEAD = 1 << 18
#: Words and languages longer than this never go to the head.
HEAD_BYTES = 64
BITS = 1 << 26
#: Side of a tile; a tile is dense when it holds a sixteenth of its addresses.
TILE_BITS = 10
DENSE = 1 << (2 * TILE_BITS - 4)
#: Pairs that a task holds before it counts them.
BUFFER = 1 << 21
_PAIR_STEP = 1_000_003

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True

Batches = Iterator[pa.RecordBatch]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
    """(language, codes of all words, distinct words, whether a word follows the one before in its piece) of slices of texts (lang, text)."""
    for lang in pc.unique(batch.column(0)).to_pylist():
        texts = batch.column(1).filter(pc.equal(batch.column(0), pa.scalar(lang)))
        for _, raw, offsets in tx.slices(texts):
            raw = tx.LOWER[raw]
            starts, ends, first = tx.spans(raw, offsets, _GAP)
            breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
            follows = np.zeros(len(starts), bool)
            follows[1:] = breaks[starts[1:]] == breaks[ends[:-1]]
            follows[first[:-1][np.diff(first) > 0]] = False
            places = np.concatenate([[0], np.cumsum(ends - starts)])
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(raw[~_GAP[raw]])]).dictionary_encode()
            yield lang, words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist(), follows


def _word_counts(batches: Batches) -> Batches:
    """(lang, word, n) of each slice; a null word counts all."""
    for batch in batches:
        for lang, codes, words, _ in _slices(batch):
            n = np.append(np.bincount(codes, minlength=len(words)), len(codes))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.array([*(w.decode() for w in words), None], pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def count_tiles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ids and their counts: dense tiles by direct address, the rest by sorted coordinates."""
    tile = ((x >> TILE_BITS) << 32) | (y >> TILE_BITS)
    order = np.argsort(tile, kind="stable")
    x, y, tile = x[order], y[order], tile[order]
    edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]])) if len(tile) else np.zeros(1, np.int64)
    sparse, out = np.ones(len(x), bool), []
    low = (1 << TILE_BITS) - 1
    for k in np.flatnonzero(np.diff(edges) >= DENSE).tolist():
        a, b = edges[k], edges[k + 1]
        n = np.bincount(((x[a:b] & low) << TILE_BITS) | (y[a:b] & low))
        hit = np.flatnonzero(n)
        out.append(((hit >> TILE_BITS) + (x[a] & ~low), (hit & low) + (y[a] & ~low), n[hit]))
        sparse[a:b] = False
    code, n = np.unique((x[sparse] << 32) | y[sparse], return_counts=True)
    out.append((code >> 32, code & 0xFFFFFFFF, n))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


_COUNTED = "x long, y long, lang string, w1 string, w2 string, w3 string, n long"
_NAMES = [c.split()[0] for c in _COUNTED.split(", ")]


def _known(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    place = number % (8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _counted(batches: Batches, size: int, head: object, pairs: object) -> Batches:
    """Counts of pairs (``size`` 2) or triples (3) of a partition: by ids where the head knows them, else by words.

    ``head`` is a broadcast of (ids of words by language, bit set of words), ``pairs`` of (sorted codes
    of pairs, their ranks, bit set of pairs).
    """
    ids_of, word_bits = head.value
    held, waiting = [], 0

    def flush() -> Batches:
        nonlocal held, waiting
        x, y, n = count_tiles(*(np.concatenate(v) for v in zip(*held, strict=True)))
        for k in range(0, len(n), 1 << 18):
            part = [pa.array(v[k : k + (1 << 18)].astype(np.int64)) for v in (x, y, n)]
            none = pa.nulls(len(part[0]), pa.string())
            yield pa.RecordBatch.from_arrays([part[0], part[1], none, none, none, none, part[2]], _NAMES)
        held, waiting = [], 0

    for batch in batches:
        for lang, codes, words, follows in _slices(batch):
            at, prefix = ids_of.get(lang, {}), lang.encode() + b"\0"
            ids = np.fromiter((at.get(w, -1) for w in words), np.int64, len(words))
            crc = np.fromiter((zlib.crc32(prefix + w) for w in words), np.int64, len(words))
            frequent = _known(word_bits, crc)
            joined = np.flatnonzero(follows & frequent[codes] & np.concatenate([[False], frequent[codes[:-1]]]))  # at its second word
            first, second = codes[joined - 1], codes[joined]
            if size == 2:
                x, y, chosen = ids[first], ids[second], [first, second]
            else:
                pair_codes, ranks, pair_bits = pairs.value
                alive = _known(pair_bits, crc[first] * _PAIR_STEP + crc[second])
                joined, first, second = joined[alive], first[alive], second[alive]
                place = np.searchsorted(pair_codes, (ids[first] << 32) | ids[second])
                place = np.minimum(place, len(pair_codes) - 1)
                same = (pair_codes[place] == ((ids[first] << 32) | ids[second])) & (ids[first] >= 0) & (ids[second] >= 0)
                rank = np.where(same, ranks[place], -1)
                two = np.flatnonzero(joined[1:] == joined[:-1] + 1)  # this pair and the next one share a word
                x, y, chosen = rank[two], ids[second[two + 1]], [first[two], second[two], second[two + 1]]
            by_id = (x >= 0) & (y >= 0)
            if by_id.any():
                held.append((x[by_id], y[by_id]))
                waiting += int(by_id.sum())
            if not by_id.all():
                grams, n = np.unique(np.stack([c[~by_id] for c in chosen], 1), axis=0, return_counts=True)
                columns = [pa.array([words[k].decode() for k in grams[:, j].tolist()], pa.string()) if j < size else pa.nulls(len(n), pa.string()) for j in range(3)]
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.repeat(pa.scalar(lang, pa.string()), len(n)), *columns, pa.array(n, pa.int64())], _NAMES)
            if waiting >= BUFFER:
                yield from flush()
    if held:
        yield from flush()


def _ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place in the order of frequency, ``id``: sorted by ranges, numbered from each range's first place."""
    spread = keep(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__n"))  # one row for each range
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = keep(sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__first")), name)
    return keep(spread.join(small(firsts, firsts.count()), "__part").withColumn("id", F.col("__first") + F.col("__at")).drop("__part", "__at", "__first"), name)


def _bit_set(places: DataFrame) -> np.ndarray:
    """The bytes of a set of BITS places, from their numbers ``p``; at most BITS / 32 rows come to the driver."""
    packed = places.groupBy(F.expr("p DIV 32").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 32 AS INT))")).alias("v")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[packed["k"].to_numpy()] = packed["v"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _word_head(words: DataFrame, head: int) -> dict[str, dict[bytes, int]]:
    out: dict[str, dict[bytes, int]] = {}
    for r in words.filter((F.col("id") < head) & (F.octet_length("word") <= HEAD_BYTES) & (F.octet_length("lang") <= HEAD_BYTES)).select("lang", "word", "id").collect():
        out.setdefault(r.lang, {})[r.word.encode()] = r.id
    return out


def _pair_head(pairs: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    found = pairs.filter(F.col("id") < head).select("i1", "i2", "id").toArrow()
    codes = (found["i1"].to_numpy() << 32) | found["i2"].to_numpy() if len(found) else np.array([-1])
    order = np.argsort(codes)
    return codes[order], (found["id"].to_numpy() if len(found) else np.array([-1]))[order]


def _grams(texts: DataFrame, size: int, word_head: object, pair_head: object, by_id: DataFrame, words: DataFrame, n_words: int, least: int) -> DataFrame:
    """(i1, .., a) of all phrases of ``size`` words that occur ``least`` times; ``by_id`` (x, i1 ..) names the ids of a tile's rows."""
    counted = texts.mapInArrow(partial(_counted, size=size, head=word_head, pairs=pair_head), _COUNTED)
    counted = keep(counted.groupBy(*_NAMES[:-1]).agg(F.sum("n").alias("a")).filter(F.col("a") >= least), f"grams{size}")
    rest, names = counted.filter("w1 IS NOT NULL").drop("x", "y"), [f"i{k + 1}" for k in range(size)]
    for k in range(1, size + 1):
        rest = rest.join(small(words.select("lang", F.col("word").alias(f"w{k}"), F.col("id").alias(f"i{k}")), n_words), ["lang", f"w{k}"])
    known = counted.filter("w1 IS NULL").select("x", F.col("y").alias(names[-1]), "a").join(by_id, "x")
    return known.select(*names, "a").unionByName(rest.select(*names, "a"))


def _score(whole: str, left: str, right: str) -> Column:
    wide = "CAST({} AS DECIMAL(38,0))".format
    return F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * CAST({whole} * {wide(whole)} AS DECIMAL(38,0))) DIV CAST({left} * {wide(right)} AS DECIMAL(38,0))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, head: int = HEAD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 and 3 words in ``docs`` (lang, text).

    A null text is empty and a null language is ``und``; a language without candidates has no rows. All
    rows count, repeated ones each time. Ties in score fall to the larger count, then the lesser phrase
    by bytes; ties between cuts to the first. Scores are exact while a million times the square of a count
    has 38 digits. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    arrow_rows(spark, 256)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("length(text) > 0")
    counts = texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = keep(counts.filter(F.col("word").isNull() | (F.col("f") >= least)), "words")
    totals = counts.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    hashed = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word").cast("binary"))).alias("crc")
    words = _ranked(counts.filter("word IS NOT NULL").select("lang", "word", "f", hashed), [F.desc("f"), F.asc("lang"), F.asc("word")], "ranked")
    n_words = words.count()
    word_head = sc.broadcast((_word_head(words, head), _bit_set(words.select((F.col("crc") % BITS).alias("p")))))

    word_ids = words.filter(F.col("id") < head).select(F.col("id").alias("x"), F.col("id").alias("i1"))
    pairs = _grams(texts, 2, word_head, None, word_ids, words, n_words, least)
    for k in (1, 2):
        columns = [F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), F.col("crc").alias(f"c{k}")]
        pairs = pairs.join(small(words.select(*columns, *([F.col("lang")] if k == 1 else [])), n_words), f"i{k}")
    pairs = _ranked(pairs, [F.desc("a"), F.asc("i1"), F.asc("i2")], "pairs")
    n_pairs = pairs.count()
    pair_head = sc.broadcast((*_pair_head(pairs, head), _bit_set(pairs.select(((F.col("c1") * _PAIR_STEP + F.col("c2")) % BITS).alias("p")))))

    pair_ids = pairs.filter(F.col("id") < head).select(F.col("id").alias("x"), "i1", "i2")
    triples = keep(_grams(texts, 3, word_head, pair_head, pair_ids, words, n_words, least), "triples")
    arrow_rows(spark)

    # a pair inside a triple that is at least ``inside`` percent as frequent goes
    covers = triples.select("i1", "i2", "a").unionByName(triples.select(F.col("i2").alias("i1"), F.col("i3").alias("i2"), "a"))
    covers = covers.groupBy("i1", "i2").agg(F.max("a").alias("longer"))
    twos = pairs.join(covers, ["i1", "i2"], "left").filter(f"longer IS NULL OR 100 * longer < {int(inside)} * a")
    twos = twos.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    left = small(pairs.select("i1", "i2", "lang", "w1", "w2", F.col("f1").alias("l1"), F.col("a").alias("l2")), n_pairs)
    right = small(pairs.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("f2").alias("r2")), n_pairs)
    threes = triples.join(left, ["i1", "i2"]).join(right, ["i2", "i3"]).withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    threes = threes.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = twos.unionByName(threes).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(small(totals, totals.count()), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
