import numpy as np
from duebook.llm import toxicity


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    unary, pairs, first = rng.standard_normal(9), rng.standard_normal((2, 2)), np.array([0, 5, 5, 6, 9])
    p, both = toxicity.marginals(unary, pairs, first)
    want, cells = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        paths = list(np.ndindex(*(2,) * (b - a)))
        w = np.array([np.exp(sum(unary[a + k] * s for k, s in enumerate(q)) + sum(pairs[x, y] for x, y in zip(q, q[1:]))) for q in paths])
        w /= w.sum()
        for q, v in zip(paths, w):
            want[a:b] += v * np.array(q)
            for x, y in zip(q, q[1:]):
                cells[x, y] += v
    assert np.allclose(p, want) and np.allclose(both, cells)


def test_held_out_documents_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()), 1500)
    known = labels.filter(toxicity.held_out()).join(docs, "doc_id").select("doc_id", "text", "toxic")
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.tag(known, model).collect()}
    truth = {r.doc_id: r.toxic for r in known.collect()}
    hits = sum(got[i] for i in truth if truth[i])
    false = sum(got[i] for i in truth if not truth[i])
    assert hits >= 0.75 * sum(truth.values()) and false <= 0.03 * len(truth)
    text = "Élan of the thing, you IDIOT moron and the rest"
    cases = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "!!"), (None, "idiot " * 3000)], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.tag(cases, model).collect()}
    assert [text.encode()[s.start : s.stop] for s in out[1].spans] == [b"IDIOT moron"]
    assert out[2].score == out[3].score == out[4].score < 0.3 and out[None].score > 0.9


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id long, text string")
    out = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r.predicted == 0 and 0 <= r.score < 0.3 for r in out) and len(out) == 2
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
