"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Unit vectors are projected on many random directions. A pair collides in a projection if one lies
in the window around the other; near pairs collide in almost all projections, others in few. The
window and the least count are set from the wanted recall at the least cosine.

Equal vectors are one class. A label's vectors are sorted by several tables of projections: a table
takes a few of them (more for a larger label), each cut into strips as wide as half a window, and a
cell is a place in all of them. So what lies in a query's windows is in its own cell or the next ones,
and only blocks of such cells meet. There each pair inside the windows of the table's projections is a
candidate, once, in the first table where it is one; its collisions over all projections are counted,
and pairs that pass are verified by cosine in double precision. A near pair is missed only if it leaves
a window in every table, or collides too seldom. Each meeting of two blocks sends on counts and links
to the least member, so that a large group of near copies is never written as pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import arrow_rows, keep, small

COSINE = 0.98
PROJECTIONS = 24
#: Share of pairs at the least cosine that collide in one projection; that pass the count, and that are candidates in some table.
COLLIDE, RECALL = 0.98, 0.999
BLOCK_ROWS = 1024
#: Vectors of a label for which a table sorts by one projection; each four times more take another.
TABLE_ROWS, MOST_SORTED = 1 << 14, 6
SEED = 11


def window_and_count(cosine: float = COSINE, projections: int = PROJECTIONS) -> tuple[float, int]:
    """Half-width of the window, and the least number of collisions that keeps RECALL of the pairs."""
    spread = math.sqrt(2 - 2 * cosine)
    width = NormalDist().inv_cdf((1 + COLLIDE) / 2) * spread
    tail, count = 0.0, projections
    while count and tail < RECALL:
        tail += math.comb(projections, count) * COLLIDE**count * (1 - COLLIDE) ** (projections - count)
        count -= 1
    return width, count + 1


def sorted_projections(rows: int) -> int:
    """How many projections a table of a label with so many vectors sorts by."""
    return min(MOST_SORTED, max(1, 1 + math.ceil(math.log(max(1, rows) / TABLE_ROWS, 4))))


def tables(sorted_by: int) -> list[list[int]]:
    """The projections of each table; as many tables as keep RECALL of the pairs."""
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - COLLIDE**sorted_by))
    return [[(t * sorted_by + j) % PROJECTIONS for j in range(sorted_by)] for t in range(count)]


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _place(kind: str, width: float):
    """Each vector once for each table of its label, with its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, copies, totals = (batch.column(k).to_pylist() for k in (0, 1, 2, 3))
            vectors = batch.column(4)
            sizes, flat, out = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False), []
            first = np.cumsum(sizes) - sizes
            raw = [flat[a : a + n].astype(kind).tobytes() for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
            for dim in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dim)
                cells = np.floor(_units([raw[k] for k in pick], kind) @ _directions(dim) / width).astype(np.int32)
                for k, cell in zip(pick.tolist(), cells, strict=True):
                    for t, chosen in enumerate(tables(sorted_projections(totals[k]))):
                        out.append((ids[k], labels[k], int(copies[k]), dim, t, cell[chosen].tolist(), raw[k]))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["vec_id", "label", "copies", "dim", "t", "cell", "raw"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the cells that the windows of their members can reach; rows that repeat an id leave."""
    for batch in batches:
        cells, ids, copies, raws = (batch.column(k).to_pylist() for k in range(4, 8))
        near = [[[c + d for c, d in zip(cell, move, strict=True)] for move in itertools.product((-1, 0, 1), repeat=len(cell))] for cell in cells]
        once = [np.unique(x, return_index=True)[1].tolist() for x in ids]
        packed = [[np.array([x[k] for k in pick], np.int64).tobytes() for x, pick in zip(col, once, strict=True)] for col in (ids, copies)]
        raws = [b"".join(x[k] for k in pick) for x, pick in zip(raws, once, strict=True)]
        columns = [*batch.columns[:5], pa.array(near, pa.list_(pa.list_(pa.int32()))), *(pa.array(x, pa.binary()) for x in (*packed, raws))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "label", "dim", "t", "cell", "near", "ids", "copies", "raws"])


def _meets(pa_: np.ndarray, pb: np.ndarray, chosen: list[int], width: float) -> np.ndarray:
    out = np.ones((len(pa_), len(pb)), bool)
    for j in chosen:
        out &= np.abs(pa_[:, j, None] - pb[None, :, j]) <= width
    return out


def compare(a: np.ndarray, b: np.ndarray, same: bool, table: int, sorted_by: int, cosine: float, width: float, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked pairs (rows of ``a``, rows of ``b``) of two blocks of unit vectors that meet in a table, and how many pairs were counted."""
    directions = _directions(a.shape[1])
    pa_, pb = a @ directions, b @ directions
    every = tables(sorted_by)
    candidates = _meets(pa_, pb, every[table], width)
    for earlier in every[:table]:
        candidates &= ~_meets(pa_, pb, earlier, width)
    if same:
        np.fill_diagonal(candidates, False)
    x, y = np.nonzero(candidates)
    linked: list[np.ndarray] = []
    for k in range(0, len(x), 1 << 16):
        u, v = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
        hits = np.zeros(len(u), np.int8)
        for j in range(PROJECTIONS):
            hits += np.abs(pa_[u, j] - pb[v, j]) <= width
            if not j % 4:  # pairs that can't reach the count any more leave
                on = hits >= least - (PROJECTIONS - 1 - j)
                u, v, hits = u[on], v[on], hits[on]
        on = hits >= least
        u, v = u[on], v[on]
        on = np.einsum("ij,ij->i", a[u], b[v]) >= cosine
        linked.append(np.stack([u[on], v[on]]))
    u, v = np.concatenate(linked, 1) if linked else (x, y)
    return u, v, len(x)


def _links(kind: str, cosine: float, width: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_id, out_n, out_root = ([np.zeros(0, np.int64)] for _ in range(3))
            for same, dim, t, sorted_by, ia, ca, ra, ib, cb, rb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids_a, ids_b, copies_a, copies_b = (np.frombuffer(v, np.int64) for v in (ia, ib, ca, cb))
                x, y, _ = compare(_units([ra[k : k + len(ra) // len(ids_a)] for k in range(0, len(ra), len(ra) // len(ids_a))], kind), _units([rb[k : k + len(rb) // len(ids_b)] for k in range(0, len(rb), len(rb) // len(ids_b))], kind), same, t, sorted_by, cosine, width, least)
                if not len(x):
                    continue
                root_a, root_b = ids_a.copy(), ids_b.copy()
                while True:  # the least id of each connected part of this meeting
                    before = root_a.sum() + root_b.sum()
                    np.minimum.at(root_a, x, root_b[y])
                    np.minimum.at(root_b, y, root_a[x])
                    if same:
                        root_a = np.minimum(root_a, root_b)
                        root_b = root_a.copy()
                    if root_a.sum() + root_b.sum() == before:
                        break
                n_a = np.bincount(x, copies_b[y], len(ids_a)).astype(np.int64)
                n_b = np.zeros(len(ids_b), np.int64) if same else np.bincount(y, copies_a[x], len(ids_b)).astype(np.int64)
                for ids, n, root in ((ids_a, n_a, root_a), (ids_b, n_b, root_b)):
                    out_id.append(ids[n > 0]), out_n.append(n[n > 0]), out_root.append(root[n > 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (out_id, out_n, out_root)], ["vec_id", "n", "root"])

    return run


def _usable(v: str) -> Column:
    return F.expr(f"vec_id IS NOT NULL AND label IS NOT NULL AND coalesce(size({v}), 0) > 0 AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({v}, x -> x <> 0)")


def near_embeddings(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows of one label (and one dimension) with a cosine of ``cosine`` or more are linked. A null id or
    label, a null, empty or zero vector, or one with a null or non-finite component links with nothing.
    Equal rows of one id are one vector. Rows that share an id but not the vector count their own links
    and are one node of a component. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 2000)
    width, least = window_and_count(cosine)
    element = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    key = ["label", "k1", "k2"]
    rows = keep(rows.withColumn("usable", F.coalesce(_usable("embedding"), F.lit(False))).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(SEED), "embedding")), "vectors")
    usable = rows.filter("usable")

    # equal vectors: only the least id goes on, with the number of ids
    classes = usable.select(*key, "vec_id").distinct().groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    several = keep(classes.filter("copies > 1"), "copies")
    classes_n = several.count()
    heads = usable.join(small(several, classes_n), key, "left").filter("rep IS NULL OR rep = vec_id").select("vec_id", "label", F.coalesce("copies", F.lit(1)).alias("copies"), "embedding")
    labels = keep(heads.groupBy("label").agg(F.count("*").alias("total")), "labels")
    heads = heads.join(small(labels, labels.count()), "label").select("vec_id", "label", "copies", "total", "embedding")
    placed = keep(heads.mapInArrow(_place(kind, width), "vec_id long, label string, copies long, dim int, t int, cell array<int>, raw binary"), "placed")

    cell = ["label", "dim", "t", "cell"]
    chunks = keep(placed.groupBy(*cell).agg(F.expr(f"CAST(ceil(count(*) / {BLOCK_ROWS}) AS INT)").alias("chunks")), "cells")
    dealt = placed.join(small(chunks, chunks.count()), cell).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")))
    blocks = dealt.groupBy(*cell, "chunk").agg(F.collect_list(F.struct("vec_id", "copies", "raw")).alias("m"))
    blocks = blocks.select(F.xxhash64(*cell, "chunk").alias("block"), *cell, F.col("m.vec_id").alias("ids"), F.col("m.copies").alias("copies"), F.col("m.raw").alias("raws"))
    arrow_rows(spark, 16)
    blocks = keep(blocks.mapInArrow(_neighbours, "block long, label string, dim int, t int, cell array<int>, near array<array<int>>, ids binary, copies binary, raws binary"), "blocks")
    reach = blocks.select(F.col("block").alias("a"), "label", "dim", "t", F.explode("near").alias("cell"))
    pairs = keep(reach.join(blocks.select(F.col("block").alias("b"), *cell), cell).filter("a <= b").select("a", "b"), "pairs")
    sides = [blocks.select(F.col("block").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("ids", "copies", "raws"))) for k in "ab"]
    both = pairs.join(sides[0].join(blocks.select(F.col("block").alias("a"), "dim", "t", F.size("cell").alias("sorted_by")), "a"), "a").join(sides[1], "b")
    both = both.select((F.col("a") == F.col("b")).alias("same"), "dim", "t", "sorted_by", *(f"{c}_{k}" for k in "ab" for c in ("ids", "copies", "raws")))
    links = keep(both.mapInArrow(_links(kind, cosine, width, least), "vec_id long, n long, root long"), "links")
    arrow_rows(spark)

    counted = keep(links.groupBy("vec_id").agg(F.sum("n").alias("n")), "counted")
    several = keep(several.join(counted.withColumnRenamed("vec_id", "rep"), "rep", "left").select(*key, "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("of_class")), "classes")
    out = rows.select("vec_id", "usable", *key).join(small(several, classes_n), key, "left")
    stars = out.filter("usable AND rep <> vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    merged = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).union(stars.distinct()))
    out = out.join(counted, "vec_id", "left").join(merged.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    n = F.when(F.col("usable"), F.coalesce("of_class", "n", F.lit(0))).otherwise(0)
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
