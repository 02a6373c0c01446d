"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become integers, so every sum over the corpus is exact and the same in any order: one pass for
the sums, one for the scatter of entries less the whole number below their mean, whose fraction (below
1) is then taken off as a rank-one term. Partitions send on one matrix each, in two levels, so no task
holds more than about the square root of their number. The covariance is factored by Cholesky with
diagonal pivots down to its numerical rank; plane rotations of the factor's columns make them
orthogonal: their squared norms are the eigenvalues, the normalised columns are the components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_rows, keep

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Scaled entries are held within this, so that products of two and sums of 2^31 of them stay exact.
_MOST = 1 << 44
_LIMB = np.int64(32)
#: Bytes of models sent to the tasks at once; vectors of more lengths than fit take further passes.
MODEL_BYTES = 64 << 20
_ROTATED = 1e-15

Batches = Iterator[pa.RecordBatch]
_SUMS = "dim int, n long, high binary, low binary"


def _lengths(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors as doubles) for each length of vectors in a list column."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[first[rows][:, None] + np.arange(dim)]


def _whole(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * SCALE), -_MOST, _MOST).astype(np.int64) + OFFSET


def _limbs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers of any size as high and low parts of 32 bits."""
    return (v >> int(_LIMB)).astype(np.int64), (v & 0xFFFFFFFF).astype(np.int64)


def _integers(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(object) << 32) + low.astype(object)


def product(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exact: in doubles while every partial sum is below 2^53, else in integers of any size."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        d = y.astype(np.float64)
        return (d.T @ d).astype(np.int64)
    d = y.astype(object)
    return d.T @ d


def _added(batches: Batches, rows: Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]) -> Batches:
    """One row for each length: the sums over a partition."""
    total: dict[int, list] = {}
    for batch in batches:
        for dim, n, high, low in rows(batch):
            held = total.setdefault(dim, [0, 0, 0])
            carry = held[2] + low
            held[0], held[1], held[2] = held[0] + n, held[1] + high + (carry >> _LIMB), carry & np.int64(0xFFFFFFFF)
    for dim, (n, high, low) in total.items():  # one length at a time, since a matrix may be large
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([n], pa.int64()), "high": [high.tobytes()], "low": [low.tobytes()]})


def _again(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for dim, n, high, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield dim, n, np.frombuffer(high, np.int64), np.frombuffer(low, np.int64)


def _totals(vectors: DataFrame, rows: Callable, name: str) -> list:
    """(dim, n, integers) over all ``vectors``: by partition, by about the root of the number of partitions, then by length."""
    partly = keep(vectors.mapInArrow(partial(_added, rows=rows), _SUMS).withColumn("part", F.spark_partition_id()), name)
    parts = 1 + (partly.agg(F.max("part")).first()[0] or 0)
    fewer = partly.repartition(max(1, math.isqrt(parts)), "dim", F.col("part") % math.isqrt(parts)).drop("part").mapInArrow(partial(_added, rows=_again), _SUMS)
    found = keep(fewer.repartition("dim").mapInArrow(partial(_added, rows=_again), _SUMS), name)
    return [(r.dim, r.n, _integers(np.frombuffer(r.high, np.int64), np.frombuffer(r.low, np.int64))) for r in found.toLocalIterator()]


def _sum_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for dim, rows, v in _lengths(batch.column(0)):
        yield dim, len(rows), *_limbs(_whole(v).sum(0))


def _scatter_rows(batch: pa.RecordBatch, means: dict[int, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for dim, rows, v in _lengths(batch.column(0)):
        if dim in means:
            yield dim, len(rows), *_limbs(product(_whole(v) - means[dim]).reshape(-1))


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (dim, rank) with v = L L' in the order of ``v``: each column takes the largest diagonal left, the least index of equals."""
    left, out = v.astype(np.float64).copy(), []
    diagonal = np.diag(left).copy()
    floor = len(v) * np.finfo(np.float64).eps * max(diagonal.max(initial=0.0), 0.0)
    while len(out) < len(v):
        k = int(np.argmax(diagonal))
        if diagonal[k] <= floor:
            break
        column = left[:, k] / math.sqrt(diagonal[k])
        out.append(column)
        left -= np.outer(column, column)
        diagonal = np.diag(left).copy()
    return np.array(out).T.reshape(len(v), len(out))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated in planes until all are orthogonal; disjoint planes of a round turn together."""
    a = factor.copy()
    n = a.shape[1]
    order = np.arange(n + n % 2)
    for _ in range(sweeps):
        turned = 0.0
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            p, q = p[(p < n) & (q < n)], q[(p < n) & (q < n)]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = np.einsum("ij,ij->j", x, x), np.einsum("ij,ij->j", y, y), np.einsum("ij,ij->j", x, y)
            share = np.abs(xy) / np.sqrt(np.maximum(xx * yy, np.finfo(np.float64).tiny))
            turned = max(turned, float(share.max(initial=0.0)))
            turn = share > _ROTATED
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta == 0, 1.0, np.sign(zeta)) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            order[1:] = np.roll(order[1:], 1)
        if turned <= _ROTATED * max(n, 10):
            return a
    raise ArithmeticError(f"columns not orthogonal after {sweeps} sweeps")


def decompose(covariance: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit components in columns, shares of the trace), falling; the largest entry of a component is positive."""
    trace = float(np.trace(covariance))
    turned = jacobi(pivoted_cholesky(covariance))
    norms = np.sqrt(np.einsum("ij,ij->j", turned, turned))
    order = np.argsort(-norms, kind="stable")[:components]
    unit = turned[:, order] / norms[order]
    if unit.size:
        unit = unit * np.where(unit[np.abs(unit).argmax(0), np.arange(unit.shape[1])] < 0, -1.0, 1.0)
    values = norms[order] ** 2
    return values, unit, values / trace if trace else values


def covariance_of(n: int, sums: np.ndarray, means: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of integers with these exact sums, whose products were summed about ``means``."""
    rest = [int(s) - n * int(m) for s, m in zip(sums, means, strict=True)]
    dim = len(rest)
    exact = [n * int(scatter[i * dim + j]) - rest[i] * rest[j] for i in range(dim) for j in range(dim)]
    return np.array([e / (n * n) for e in exact], np.float64).reshape(dim, dim)  # integers divide with one rounding


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """For each length of ``vectors`` (embedding of doubles): n, sums, eigenvalues, components and shares."""
    sums = {dim: (n, total) for dim, n, total in _totals(vectors, _sum_rows, "sums") if dim}
    models, lengths = {}, sorted(sums)
    while lengths:
        now = [lengths.pop(0)]
        while lengths and sum(d * d * 16 for d in (*now, lengths[0])) <= MODEL_BYTES:
            now.append(lengths.pop(0))
        means = {dim: np.array([int(s) // sums[dim][0] for s in sums[dim][1]], np.int64) for dim in now}
        some = vectors.filter(F.size("embedding").isin(now))
        for dim, n, scatter in _totals(some, partial(_scatter_rows, means=means), "scatter"):
            total = sums[dim][1]
            values, unit, shares = decompose(covariance_of(n, total, means[dim], scatter), components)
            rest = np.array([(int(s) - n * int(m)) / n for s, m in zip(total, means[dim], strict=True)])
            models[dim] = {"n": n, "sums": total, "mean": means[dim], "rest": rest, "values": values, "unit": unit, "explained": shares}
    return models


def _projected(v: np.ndarray, model: dict) -> np.ndarray:
    return ((_whole(v) - model["mean"]).astype(np.float64) - model["rest"]) @ (model["unit"] / np.sqrt(model["values"]))


def _moments(batches: Batches, models: dict[int, dict]) -> Batches:
    """One row for each length: sums and products of the whitened columns over a partition."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, v in _lengths(batch.column(0)):
            if dim in models:
                w = _projected(v, models[dim])
                held[dim] = held.get(dim, 0.0) + np.concatenate([w.sum(0), (w.T @ w).reshape(-1)])
    yield pa.RecordBatch.from_pydict({"dim": pa.array(list(held), pa.int32()), "at": pa.array([list(range(len(v))) for v in held.values()], pa.list_(pa.int32())), "sums": pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))})


def _identity_error(vectors: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    """For each length the largest absolute entry of the whitened covariance less the identity, from the rows themselves."""
    parts = vectors.mapInArrow(partial(_moments, models=models), "dim int, at array<int>, sums array<double>")
    cells = parts.select("dim", F.explode(F.arrays_zip("at", "sums")).alias("c")).groupBy("dim", F.col("c.at").alias("at")).agg(F.sum("c.sums").alias("total"))
    found: dict[int, dict] = {}
    for r in keep(cells, "moments").toLocalIterator():
        found.setdefault(r.dim, {})[r.at] = r.total
    out = {}
    for dim, cell in found.items():
        n, k = models[dim]["n"], len(models[dim]["values"])
        flat = np.array([cell[i] for i in range(k + k * k)]) / n
        out[dim] = float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max(initial=0.0))
    return out


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum of (n x - S)^2 of each row; None where it passes 63 bits."""
    most = max((abs(n * int(e) - int(s)) for e, s in [*zip(x.max(0), sums, strict=True), *zip(x.min(0), sums, strict=True)]), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        moved = x * np.int64(n) - sums.astype(np.int64)
        return np.einsum("ij,ij->i", moved, moved).tolist()
    moved = x.astype(object) * n - sums
    return [v if v < 1 << 63 else None for v in (moved * moved).sum(1).tolist()]


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _white_rows(batches: Batches, models: dict[int, dict], errors: dict[int, float]) -> Batches:
    names = [c.split()[0] for c in _WHITE.split(", ")]
    for batch in batches:
        ids = batch.column(0)
        for dim, rows, v in _lengths(batch.column(1)):
            model = models.get(dim)
            k = 0 if model is None else len(model["values"])
            if not k:
                continue
            repeated = np.repeat(np.arange(len(rows)), k)
            apart = pa.array(deviations(_whole(v), model["n"], model["sums"]), pa.int64()).take(pa.array(repeated))
            component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))
            columns = [ids.take(pa.array(rows[repeated])), component, pa.repeat(pa.scalar(model["n"], pa.int64()), len(component)), apart, _projected(v, model).reshape(-1), model["explained"][component - 1], np.full(len(component), errors[dim])]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for ``vectors`` (vec_id, embedding).

    Rows whose vector is null or holds a null or non-finite entry are dropped. An entry c counts as
    floor(64 c) + 1,000,000; scaled entries beyond 2^44 count as that bound. Vectors of different lengths
    are separate fit lists, and an empty vector has no component. Components stop at ``components`` or at
    the rank of the covariance: equal vectors, or a single one, have none and give no rows. Of equal
    eigenvalues any orthonormal basis may come, the same for all rows. Repeated rows and ids count and
    return each by itself, a null id too. A deviation past 63 bits is null. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 2000)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    models, out = fit(rows.select("embedding"), components), None
    lengths = sorted(models)
    while lengths or out is None:
        now, size = {}, 0
        while lengths and (not now or size + lengths[0] * 8 * components <= MODEL_BYTES):
            dim = lengths.pop(0)
            now[dim], size = models[dim], size + dim * 8 * components
        some = rows.filter(F.size("embedding").isin(list(now)))
        errors = _identity_error(some.select("embedding"), now) if now else {}
        white = some.mapInArrow(partial(_white_rows, models=now, errors=errors), _WHITE)
        out = white if out is None else out.unionByName(white)
    return out
