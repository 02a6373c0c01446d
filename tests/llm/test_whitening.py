import numpy as np
import pytest
from duebook.llm import whitening


def expected(raw, components=32):
    x = np.floor(64 * np.array(raw, np.float64)).astype(np.int64) + 1000000
    n, sums = len(x), x.sum(0)
    moved = x - sums / n
    values, unit = np.linalg.eigh(moved.T @ moved / n)
    values, unit = values[::-1], unit[:, ::-1]
    return n, [int(sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums))) for row in x], moved, values[:components], unit[:, :components], values.sum()


def check(got, raw, ids, rank):
    n, apart, moved, values, unit, trace = expected(raw)
    assert len(got) == len(raw) * min(32, rank)
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(min(32, rank)):
        mine = np.array([by[i, k + 1].whitened for i in ids])
        want = moved @ unit[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert by[ids[0], k + 1].explained == pytest.approx(values[k] / trace, rel=1e-9)
    for i, d in zip(ids, apart):
        assert (by[i, 1].n, by[i, 1].deviation) == (n, d)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8


def test_against_plain_numpy(spark):
    rng = np.random.default_rng(3)
    raw = rng.standard_normal((700, 40)) @ rng.standard_normal((40, 40)) * np.linspace(0.1, 3, 40)
    df = spark.createDataFrame([(k, v.tolist(), "x", 7) for k, v in enumerate(raw)], "vec_id long, embedding array<double>, component string, n int").repartition(7)
    check(whitening.whitened(df).collect(), raw, list(range(700)), 40)


def test_low_rank_floats_and_partitions(spark):
    rng = np.random.default_rng(5)
    raw = np.repeat(rng.integers(-3, 4, (300, 3)), 2, axis=1).astype(np.float32)
    one = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(raw)], "vec_id long, embedding array<float>")
    check(whitening.whitened(one.repartition(20)).collect(), raw, list(range(300)), 3)
    runs = [sorted(whitening.whitened(one.repartition(p)).collect()) for p in (1, 13)]
    assert [(r.vec_id, r.component, r.whitened, r.explained) for r in runs[0]] == [(r.vec_id, r.component, r.whitened, r.explained) for r in runs[1]]


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [])]
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame(bad, schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [0.0, 5.0]), (8, [-2.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [3.0, 2.0, 1.5])]
    got = whitening.whitened(spark.createDataFrame(bad + rows, schema)).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.component, r.n) for r in got) == [((False, 7), 1, 4), ((False, 7), 1, 4), ((False, 7), 2, 4), ((False, 7), 2, 4), ((False, 8), 1, 4), ((False, 8), 2, 4), ((False, 9), 1, 2), ((False, 10), 1, 2), ((True, 0), 1, 4), ((True, 0), 2, 4)]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 2e12])], schema)
    got = whitening.whitened(huge).collect()
    assert len(got) == 6 and all(r.deviation is None and np.isfinite(r.whitened) for r in got)


def test_parts():
    rng = np.random.default_rng(1)
    half = rng.standard_normal((30, 12))
    v = half @ half.T
    low = whitening.pivoted_cholesky(v)
    assert low.shape == (30, 12) and np.abs(low @ low.T - v).max() < 1e-9
    turned = whitening.jacobi(low)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-9 and np.abs(turned @ turned.T - v).max() < 1e-9
    big = rng.integers(-(2**43), 2**43, (50, 3))
    assert (whitening.product(big) == big.astype(object).T @ big.astype(object)).all()
