import hashlib
import random
import re

from duebook.llm import decontaminate as dc
from hashes import thue_morse


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            v = words(t)
            for j in range(max(1, len(v) - 9)) if v else ():
                win = v[j : j + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, dc.contamination(d, i, **kw).collect()), key=str) == brute(docs, items)


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert any(x[-1] for x in brute(docs, items))
    check(spark, docs, items)


def test_repeats_short_items_nulls_and_chunks(spark, monkeypatch):
    rng = random.Random(3)
    alphabet = ["a", "b", "C", "é", "x1"]
    text = lambda n: " ".join(rng.choice(alphabet[: rng.randint(1, 5)]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 80))) for k in range(60)] + [(100, None), (101, ""), (102, "a," * 3000), (100, "b b b")]
    items = [(k, text(rng.randint(1, 25))) for k in range(20)] + [(2, "a a"), (30, None), (31, "-- !"), (32, "É x1"), (None, "a")]
    items = [x for x in items if x[0] is not None]
    check(spark, docs, items)
    monkeypatch.setattr(dc, "CHUNK_BYTES", 200)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = dc.benchmark_matches(d, i, chunk_bytes=100).select("doc_id", "n_words", "matches").mapInArrow(dc._summaries, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def brute_matches(doc, items, window=10):
    """(item_id, start, length, item_start) of every longest common run of words that holds a window of the item."""
    w, out = words(doc), set()
    for i, t in items:
        v = words(t)
        for a in range(len(w)):
            for b in range(len(v)):
                if w[a] == v[b] and not (a and b and w[a - 1] == v[b - 1]):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= min(window, len(v)):
                        out.add((i, a, n, b))
    return sorted(out)


def test_longest_matches_are_verbatim(spark):
    parts = lambda *spans: " ".join(f"w{k}" for a, b in spans for k in range(a, b))
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(1, parts((15, 25), (0, 10))), (2, parts((3, 28))), (3, parts((0, 30), (0, 12)))] + [(k, text(90)) for k in range(10, 30)]
    items = [(5, parts((0, 30)))] + [(k, text(rng.randint(2, 30))) for k in range(40, 60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chunk_bytes in (1 << 20, 300):
        got = {r.doc_id: sorted(tuple(m) for m in r.matches or []) for r in dc.benchmark_matches(d, i, chunk_bytes=chunk_bytes).collect()}
        assert got == {k: brute_matches(t, items) for k, t in docs}
    assert got[1] == [(5, 0, 10, 15), (5, 10, 10, 0)]


def test_stretches_and_removal(spark):
    item = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(1, f"x {item} y", "k"), (2, "clean text", "k"), (3, None, "k"), (None, item, "k"), (None, "fine", "k")], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r.doc_id: r.matches for r in dc.benchmark_matches(docs, items).collect() if r.doc_id}
    assert [tuple(m) for m in got[1]] == [(5, 1, 15, 0)]
    assert sorted(((r.doc_id, r.text) for r in dc.decontaminate(docs, items).collect()), key=str) == [(2, "clean text"), (3, None), (None, "fine")]


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(d, i).count() == 0
    assert dc.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), i).collect()[0].n_words == 2


def test_words_that_collide_under_polynomials(spark):
    for n in (1024, 2048):
        a, b = thue_morse(n)
        check(spark, [(1, f"p q r s {a} t u v"), (2, f"p q r s {b} t u v")], [(1, a)])
