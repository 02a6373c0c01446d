"""Second-order boosting of trees over binned features: each level of a tree is one aggregation of gradients and Hessians."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_path
from .features import assert_no_leakage

#: Gradients and Hessians are summed as whole multiples of 2^-24, so sums don't depend on their order and a lost task's rerun changes no bit.
UNIT = 1 << 24
#: Margins are written anew after so many trees; between, tasks add the trees since.
REWRITE = 16


@dataclass(frozen=True)
class Settings:
    """The defaults of the late-payment classifier. ``start`` is the first margin, the log odds of the training rows if None."""

    trees: int = 500
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    least_child: float = 5.0
    gamma: float = 0.1
    l1: float = 0.1
    l2: float = 1.0
    patience: int = 50
    bins: int = 256
    seed: int = 42
    start: float | None = None


@dataclass(frozen=True)
class Boosted:
    """A fitted model: first margin, trees as arrays (feature, threshold, left, right, value, cover) by node, and the held-out loss after each tree."""

    columns: tuple[str, ...]
    base: float
    trees: tuple[tuple[np.ndarray, ...], ...]
    losses: tuple[float, ...]


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))


def cut_points(rows: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """For each column the values that begin to tell bins apart: all distinct ones where they are few, else by a bounded sketch of ranks."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), shares, 100 * bins).alias(f"c{k}") for k, c in enumerate(columns))).first()
    return [np.unique(np.array(found[k] or [], float)) for k in range(len(columns))]


def _binned(rows: DataFrame, columns: Sequence[str], label: str, cuts: list[np.ndarray], base: float) -> DataFrame:
    """(y, held, draw, margin, b0, b1, ...): the bins of the training and validation rows. A value up to a cut is left of it; nulls and NaN are above all cuts."""
    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = part[["y", "held", "draw"]].assign(margin=base)
            for k, c in enumerate(cuts):
                out[f"b{k}"] = np.searchsorted(c, part[f"x{k}"].to_numpy(float), side="left").astype(np.int32)
            yield out

    kind = "y double, held boolean, draw long, margin double" + "".join(f", b{k} int" for k in range(len(columns)))
    data = rows.filter(F.col(label).isNotNull() & F.col("split").isin("train", "validation"))
    # equal rows draw alike; the rank of a draw in a tree comes from this hash and the tree's number
    return data.select(F.col(label).cast("double").alias("y"), (F.col("split") == "validation").alias("held"), F.xxhash64(*sorted(rows.columns)).alias("draw"), *(_number(c).alias(f"x{k}") for k, c in enumerate(columns))).mapInPandas(bins, kind)


def _settle(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node of a tree (feature, bin of the cut, left, right, ...) that each row of bins ends in."""
    feature, cut, left, right = tree[:4]
    at, each = np.zeros(len(bins), int), np.arange(len(bins))
    while (feature[at] >= 0).any():
        f = feature[at]
        at = np.where(f >= 0, np.where(bins[each, np.maximum(f, 0)] <= cut[at], left[at], right[at]), at)
    return at


def _drawn(draw: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree is grown from, by their hashes alone."""
    with np.errstate(over="ignore"):
        z = draw.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % (1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(40)).astype(float) < share * (1 << 24)


def level_sums(data: DataFrame, sizes: Sequence[int], since: list, tree: tuple, number: int, settings: Settings) -> DataFrame:
    """(node, feature, bin, g, h, n): sums over the drawn training rows of each open node of a half-grown tree, first within
    tasks, then by one grouping. Node -1 holds the held-out rows' loss (g) and number. Bounded by nodes and bins, not by rows."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    nodes = len(tree[0])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, held_rows = np.zeros((3, nodes * first[-1]), np.int64), 0, 0
        for part in batches:
            bins = part[[f"b{k}" for k in range(len(sizes))]].to_numpy(int)
            margin = part["margin"].to_numpy() + sum(t[4][_settle(t, bins)] for t in since)
            y, held, p = part["y"].to_numpy(), part["held"].to_numpy(bool), 1 / (1 + np.exp(-margin))
            loss += int(np.rint((np.logaddexp(0, margin) - y * margin)[held] * UNIT).sum())
            held_rows += int(held.sum())
            use = ~held & _drawn(part["draw"].to_numpy(), settings.seed, number, settings.rows)
            g, h = np.rint((p - y)[use] * UNIT), np.rint((p * (1 - p))[use] * UNIT)
            at = _settle(tree, bins[use]) * first[-1]
            for k in range(len(sizes)):
                cell = at + first[k] + bins[use, k]
                for row, w in enumerate((g, h, None)):
                    total[row] += np.rint(np.bincount(cell, w, total.shape[1])).astype(np.int64)
        (full,) = np.nonzero(total[2])
        feature = np.searchsorted(first, full % first[-1], side="right") - 1
        yield pd.DataFrame({"node": full // first[-1], "feature": feature, "bin": full % first[-1] - first[feature], "g": total[0][full], "h": total[1][full], "n": total[2][full]})
        yield pd.DataFrame({"node": [-1], "feature": [0], "bin": [0], "g": [loss], "h": [0], "n": [held_rows]})

    kind = "node long, feature long, bin long, g long, h long, n long"
    return data.mapInPandas(sums, kind).groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n")))


def worth(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """What a leaf of these sums takes off the regularised loss, doubled."""
    return np.maximum(np.abs(g) - s.l1, 0) ** 2 / (h + s.l2)


def split_gains(cells: np.ndarray, s: Settings) -> np.ndarray:
    """The gain of each cut of each feature from sums (3: g, h, n; feature; bin) of one node; -inf where a side is empty or too light."""
    g, h = cells[0] / UNIT, cells[1] / UNIT
    n, gl, hl = cells[2].cumsum(1), g.cumsum(1), h.cumsum(1)
    whole_g, whole_h, whole_n = gl[:, -1:], hl[:, -1:], n[:, -1:]
    gain = worth(gl, hl, s) + worth(whole_g - gl, whole_h - hl, s) - worth(whole_g, whole_h, s)
    return np.where((n > 0) & (n < whole_n) & (hl >= s.least_child) & (whole_h - hl >= s.least_child), gain, -np.inf)


def _tensor(found: list, sizes: Sequence[int], node: int) -> np.ndarray:
    cells = np.zeros((3, len(sizes), max(sizes)), np.int64)
    for r in found:
        if r["node"] == node:
            cells[:, r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
    return cells


def _grow(data: DataFrame, sizes: Sequence[int], since: list, number: int, s: Settings) -> tuple[tuple[np.ndarray, ...], float | None]:
    """A tree (feature, bin of the cut, left, right, value, cover), and the held-out mean loss before it; None without such rows."""
    rng = np.random.default_rng([s.seed, number])
    open_columns = np.zeros(len(sizes), bool)
    open_columns[rng.choice(len(sizes), max(1, int(s.columns * len(sizes))), replace=False)] = True
    nodes, gains, fresh, loss = [[-1, 0, -1, -1, 0.0, 0.0]], {}, [0], None
    for depth in range(s.depth + 1):
        tree = tuple(np.array(c) for c in zip(*nodes))
        found = level_sums(data, sizes, since, tree, number, s).collect()  # at most nodes x bins rows
        if depth == 0:
            held = [r for r in found if r["node"] == -1]
            loss = held[0]["g"] / UNIT / held[0]["n"] if held and held[0]["n"] else None
        following = []
        for node in fresh:
            cells = _tensor(found, sizes, node)
            g, h = cells[0, 0].sum() / UNIT, cells[1, 0].sum() / UNIT
            nodes[node][4:] = [-s.rate * math.copysign(max(abs(g) - s.l1, 0.0), g) / (h + s.l2), h]
            gain = np.where(open_columns[:, None], split_gains(cells, s), -np.inf)
            f, cut = np.unravel_index(np.argmax(gain), gain.shape)
            if depth < s.depth and gain[f, cut] > 1e-6:
                gains[node] = gain[f, cut]
                nodes[node][:4] = [int(f), int(cut), len(nodes), len(nodes) + 1]
                following += nodes[node][2:4]
                nodes += [[-1, 0, -1, -1, 0.0, 0.0] for _ in range(2)]
        fresh = following
        if not fresh:
            break
    for node in sorted(gains, reverse=True):  # from the bottom: a split that gains less than gamma and has no split below goes
        _, _, a, b = nodes[node][:4]
        if gains[node] < s.gamma and nodes[a][0] < 0 and nodes[b][0] < 0:
            nodes[node][:4] = [-1, 0, -1, -1]
    return tuple(np.array(c) for c in zip(*nodes)), loss


def _prepared(rows: DataFrame, columns: Sequence[str], label: str, s: Settings, cuts: list[np.ndarray] | None) -> tuple[DataFrame, list[np.ndarray], float]:
    assert_no_leakage(list(columns))
    train = rows.filter((F.col("split") == "train") & F.col(label).isNotNull())
    if s.start is None:
        mean = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
        if mean is None:
            raise ValueError("no training rows with a label")
        mean = min(max(mean, 1e-6), 1 - 1e-6)
    base = math.log(mean / (1 - mean)) if s.start is None else s.start
    cuts = cut_points(train, columns, s.bins) if cuts is None else cuts
    return _kept(_binned(rows, columns, label, cuts, base)), cuts, base


def _kept(data: DataFrame) -> DataFrame:
    path = shared_path(data.sparkSession, "binned")
    data.write.parquet(path)
    return data.sparkSession.read.schema(data.schema).parquet(path)


def fit(rows: DataFrame, columns: Sequence[str], label: str = "is_late", settings: Settings = Settings()) -> Boosted:
    """Logistic boosting on the train rows of (columns..., label 0/1, split). It stops when the loss of the validation rows has
    not fallen for ``patience`` trees and keeps the trees up to the best. The driver holds one tree's sums, as many as nodes times bins."""
    data, cuts, base = _prepared(rows, columns, label, settings, None)
    sizes = [len(c) + 1 for c in cuts]
    trees, since, losses = [], [], []
    for number in range(settings.trees + 1):
        last = number == settings.trees
        tree, loss = _grow(data, sizes, since, number, settings if not last else replace(settings, depth=0))
        if number and loss is not None:
            losses.append(loss)  # after ``number`` trees
            if number - 1 - int(np.argmin(losses)) >= settings.patience:
                break
        if last:
            break
        trees.append(tree)
        since.append(tree)
        if len(since) == REWRITE:
            data, since = _kept(_moved(data, since, len(sizes))), []
    kept = trees[: int(np.argmin(losses)) + 1] if losses else trees
    named = tuple((f, np.array([cuts[a][min(b, len(cuts[a]) - 1)] if a >= 0 else 0.0 for a, b in zip(f, cut)]), *rest) for f, cut, *rest in kept)
    return Boosted(tuple(columns), base, named, tuple(losses))


def _moved(data: DataFrame, since: list, width: int) -> DataFrame:
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            bins = part[[f"b{k}" for k in range(width)]].to_numpy(int)
            yield part.assign(margin=part["margin"].to_numpy() + sum(t[4][_settle(t, bins)] for t in since))

    return data.mapInPandas(move, data.schema)


def first_gains(rows: DataFrame, columns: Sequence[str], cuts: dict[str, Sequence[float]], label: str = "is_late", settings: Settings = Settings()) -> DataFrame:
    """(feature, cut, left_rows, gain): what each cut of the first tree's root would gain over all its rows; only cuts that both sides' weights allow."""
    points = [np.array(sorted(cuts[c]), float) for c in columns]
    data, _, _ = _prepared(rows, columns, label, settings, points)
    sizes = [len(c) + 1 for c in points]
    root = tuple(np.array([v]) for v in (-1, 0, -1, -1, 0.0, 0.0))
    cells = _tensor(level_sums(data, sizes, [], root, 0, settings).collect(), sizes, 0)  # at most as many rows as bins
    gain, n = split_gains(cells, settings), cells[2].cumsum(1)
    told = [(c, float(v), int(n[k, b]), float(gain[k, b])) for k, c in enumerate(columns) for b, v in enumerate(points[k]) if np.isfinite(gain[k, b])]
    return rows.sparkSession.createDataFrame(told, "feature string, cut double, left_rows long, gain double")


def margins(rows: DataFrame, model: Boosted, name: str = "margin") -> DataFrame:
    """``rows`` with the log odds that a model gives; nulls and NaN go right at every split."""
    trees, base, width = model.trees, model.base, len(model.columns)

    @F.pandas_udf("double")
    def raw(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_list()).astype(float) if len(features) else np.zeros((0, width))
        return pd.Series(base + sum((t[4][_settle(t, x)] for t in trees), np.zeros(len(x))))

    return rows.withColumn(name, raw(F.array(*map(_number, model.columns))))
