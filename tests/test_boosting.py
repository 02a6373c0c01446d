from dataclasses import replace

import numpy as np
import pytest
from duebook.operators import boosting, models
from pyspark.sql import functions as F

S = boosting.Settings(trees=3, depth=3, rate=0.3, rows=1.0, columns=1.0, least_child=1.0, gamma=0.1, l1=0.1, l2=1.0, patience=50, bins=64)


def plain_trees(x, y, s, base):
    """The margins of boosted trees by looking at every cut of every node, and the gains of the splits made."""
    margin, splits = np.full(len(x), base), []
    soft = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)

    def grow(at, g, h, depth):
        """(values of the rows, split) of the subtree over rows ``at``; a split that gains less than gamma over two leaves goes."""
        leaf = np.full(len(at), -s.rate * soft(g[at].sum()) / (h[at].sum() + s.l2))
        best = None
        for f in range(x.shape[1]):
            for c in np.unique(x[at, f])[:-1]:
                left = x[at, f] <= c
                parts = (at[left], at[~left])
                if min(h[p].sum() for p in parts) < s.least_child:
                    continue
                gain = sum(soft(g[p].sum()) ** 2 / (h[p].sum() + s.l2) for p in parts) - soft(g[at].sum()) ** 2 / (h[at].sum() + s.l2)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, c)
        if depth == 0 or best is None or best[0] <= 1e-6:
            return leaf, False
        left = x[at, best[1]] <= best[2]
        (a, deep_a), (b, deep_b) = grow(at[left], g, h, depth - 1), grow(at[~left], g, h, depth - 1)
        if best[0] < s.gamma and not deep_a and not deep_b:
            return leaf, False
        splits.append(best)
        out = np.empty(len(at))
        out[left], out[~left] = a, b
        return out, True

    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + grow(np.arange(len(x)), p - y, p * (1 - p), s.depth)[0]
    return margin, splits


@pytest.fixture(scope="module")
def told(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((400, 3)) * [4, 7, 5]) / 2
    y = (x[:, 0] + rng.standard_normal(400) > np.abs(x[:, 1]) - 2).astype(float)
    rows = spark.createDataFrame([(k, *map(float, v), float(t), "train") for k, (v, t) in enumerate(zip(x, y))], "invoice_id long, a double, b double, c double, is_late double, split string")
    return x, y, rows


def test_trees_against_every_cut(told):
    x, y, rows = told
    model = boosting.fit(rows, ["a", "b", "c"], settings=S)
    want, splits = plain_trees(x, y, S, model.base)
    got = {r.invoice_id: r.margin for r in boosting.margins(rows, model).collect()}
    assert [got[k] for k in range(len(x))] == pytest.approx(list(want), abs=1e-5)
    assert splits and model.losses == () and len(model.trees) == 3
    again = boosting.fit(rows.repartition(7), ["a", "b", "c"], settings=S)
    assert again.base == pytest.approx(model.base) and all((p == q).all() for t, u in zip(model.trees, again.trees) for p, q in zip(t[:4], u[:4]))
    for r in models.contributions(rows.filter("invoice_id < 50"), ["a", "b", "c"], model).collect():
        assert r.bias + sum(r.parts) == pytest.approx(got[r.invoice_id], abs=1e-9)


def test_stops_by_held_out_rows_and_takes_nulls(told):
    _, _, rows = told
    noise = rows.withColumn("is_late", F.pmod(F.xxhash64("invoice_id"), F.lit(2)).cast("double")).withColumn("split", F.when(F.col("invoice_id") % 3 == 0, "validation").otherwise("train"))
    noise = noise.withColumn("a", F.when(F.col("invoice_id") % 5 != 0, F.col("a"))).withColumn("c", F.lit(None).cast("double"))
    model = boosting.fit(noise, ["a", "b", "c"], settings=replace(S, trees=12, patience=2, rows=0.8, columns=0.7))
    best = int(np.argmin(model.losses))
    assert len(model.trees) == best + 1 and len(model.losses) <= min(12, best + 3)
    assert boosting.margins(noise, model).filter("margin IS NULL OR isnan(margin)").count() == 0
    with pytest.raises(ValueError, match="no training rows"):
        boosting.fit(noise.limit(0), ["a"], settings=S)
    with pytest.raises(ValueError, match="tell the outcome"):
        boosting.fit(noise, ["is_late"], settings=S)
