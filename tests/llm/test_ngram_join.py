import random
import re
from collections import defaultdict

from duebook.llm import ngram_join
from hashes import thue_morse

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(x), root(i)) for i, x in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_groups(df).collect()}
    assert got == brute(rows)


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows)


def test_edges_of_the_contract(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (7, "x " * 3000), (8, "x " * 3000), (9, "é É"), (10, "a b c d e")]
    check(spark, rows)


def _hard_rows(rng):
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop")
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(40):
        rows.append([word() for _ in range(rng.randint(5, 60))] + passage)
    base = [word() for _ in range(80)]
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = word()
        rows.append(near)
    for _ in range(60):
        rows.append(list(rng.choice(["ab cd ef gh ij kl mn".split(), "q r s t u v w x y z".split()]))[: rng.randint(3, 10)])
    for _ in range(40):
        cut = rng.randrange(5, 40)
        rows.append(passage[: cut + 20] + [word() for _ in range(rng.randint(0, 5))])
    return rows


def test_shared_passages_families_and_tiny_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    entered = defaultdict(int)
    for name in ("_whole_candidates", "_combination_pairs", "_between_members"):

        def spied(*args, name=name, real=getattr(ngram_join, name)):
            found = real(*args)
            entered[name] += found.count()
            return found

        monkeypatch.setattr(ngram_join, name, spied)
    for seed in (5, 6, 7):  # which stages a table enters depends on its words' hashes
        check(spark, [(100 + i, " ".join(w)) for i, w in enumerate(_hard_rows(random.Random(seed)))])
    assert entered["_whole_candidates"] and entered["_combination_pairs"] and "_between_members" in entered


def test_empty_table_clashing_columns_and_null_id(spark):
    assert ngram_join.ngram_jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 9, 9), (2, "a b c d e f", 9, 9), (None, "a b c d e f", 9, 9)], "doc_id long, text string, n long, component_id long")
    got = sorted(map(tuple, ngram_join.ngram_jaccard_groups(df).collect()), key=str)
    assert got == [(1, 2, 1), (2, 2, 1), (None, 2, None)]


def test_components(spark):
    from duebook.llm.graph import components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 300), (300, 200), (7, 7), (500, 400), (500, 450)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = defaultdict(int, {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100, 400: 400, 450: 400, 500: 400})
    assert got == dict(want)


def test_words_that_collide_under_polynomials(spark):
    check(spark, [(n + k, f"p q r s {w} t u v") for n in (1024, 2048) for k, w in enumerate(thue_morse(n))])
