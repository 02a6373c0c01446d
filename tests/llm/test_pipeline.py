from collections import Counter

import corpus_pipeline as cp
from duebook.llm import mixing, store


def test_each_stage_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90001, "12 34 !!", "en", "src0", 8), (90002, None, "en", "src0", 0), (90003, docs.first().text, "en", None, 1)], docs.schema)
    docs = docs.unionByName(extra)
    names = docs.columns
    seen = []
    for name, stage in cp.STAGES:
        docs = store.keep(stage(spark, docs, sf), name)
        seen.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert docs.columns == (names if name != "sharding" else [*names, "shard", "slot"])
    first = set(seen[0])
    assert not {90001, 90002} & first and 90003 in first
    assert 90003 not in seen[1] and len(seen[1]) == len(set(seen[1]))
    assert set(seen[2]) <= set(seen[1]) and len(seen[2]) < len(seen[1])
    assert set(seen[3]) <= set(seen[2]) and max(Counter(seen[3]).values()) == 2
    assert Counter(seen[4]) == Counter(seen[3])


def test_rows_with_null_and_repeated_ids(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    words = lambda k: " ".join(f"wort{k}x{j} und" for j in range(40))
    after = lambda stage, rows: Counter((r.doc_id, r.text, r.source) for r in stage(spark, spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], given.schema), sf).collect())

    clean = [(None, words(0), "a"), (7, words(1), "a"), (7, words(2), "b"), (None, words(3), None)]
    assert after(cp.identify_languages, [*clean, (None, "12 !!", "a"), (7, "34", "a"), (None, None, "a")]) == Counter(clean)
    near = [(None, words(1) + " end", "a"), (None, words(0), "a"), (9, words(2), "b"), (7, words(1), "c"), (None, words(3), None)]
    left = after(cp.join_near_duplicates, clean + near)
    assert Counter((i, t) for i, t, _ in left.elements()) == Counter((i, t) for i, t, _ in clean)
    assert after(cp.remove_benchmark_text, [*clean, (None, f"x {item} y", "a"), (7, item, "a")]) == Counter(clean)

    # two rows of one id in two sources, and two null ids: each as often as its own words were taken
    rows = [(k, words(k) + " und", f"s{k % 3}") for k in range(10, 40)] + [(5, words(50), "s0"), (5, words(51) + " a b", "s2"), (None, words(52), "s0"), (None, words(53) + " a b c", "s2")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], given.schema)
    want = {(r.doc_id, r.source): int(r.taken / r.size + 0.5) for r in mixing.mixed_sizes(docs).collect()}
    assert want[None, "s0"] and want[5, "s0"] != want[5, "s2"]
    assert after(cp.mix_sources, rows) == Counter({(i, t, s): want[i, s] for i, t, s in rows if want[i, s]})
    assert after(cp.shard, [*clean, clean[0]]) == Counter([*clean, clean[0]])
