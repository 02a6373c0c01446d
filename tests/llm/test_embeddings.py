import numpy as np
from duebook.llm import embeddings


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(500):
        rows.append((k, rng.standard_normal(16), k % 3))
    for c in range(40):
        base = rng.standard_normal(16)
        for j in range(8 if c else 300):
            rows.append((1000 + 10 * c + j if c else 5000 + j, base + rng.standard_normal(16) * rng.choice([0.03, 0.1, 0.14]), c % 3))
    data = [(i, [float(x) for x in v], lab, 1) for i, v, lab in rows]
    data += [(9001, None, 1, 1), (9002, [0.0] * 16, 1, 1), (9003, [1.0, None] * 8, 1, 1), (9004, [float("nan")] * 16, 1, 1), (9005, [1e300] * 16, None, 1), (9006, [1e300] * 16, 2, 1), (9007, [1e-300] * 16, 2, 1), (9008, [], 2, 1), (9009, [float("inf")] * 16, 2, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, n int").repartition(4)
    got = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
    assert len(got) == len(data)
    x = np.array([v / np.linalg.norm(v) for _, v, _ in rows])
    lab = np.array([r[2] for r in rows])
    close = (x @ x.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(close, False)
    ids = np.array([r[0] for r in rows])
    found = sum(got[i].n_links for i in ids)
    assert 0.99 * close.sum() <= found <= close.sum() and close.sum() > 1000
    comp = ids.copy()
    while True:
        new = np.array([min(comp[k], *comp[close[k]]) if close[k].any() else comp[k] for k in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    assert np.mean([got[i].component_id == c for i, c in zip(ids, comp)]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 for i in (9001, 9002, 9003, 9004, 9005, 9008, 9009))
    assert got[9006].n_links == got[9007].n_links == 1 and got[9007].component_id == 9006


def test_empty(spark):
    assert embeddings.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_calibration():
    width, least = embeddings.window_and_count()
    rng = np.random.default_rng(0)
    moved = np.abs(rng.standard_normal((20000, embeddings.PROJECTIONS)) * np.sqrt(0.04)) <= width
    assert (moved.sum(1) >= least).mean() > 0.998
