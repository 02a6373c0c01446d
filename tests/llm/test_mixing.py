import re

import pytest
from duebook.llm import mixing


def brute_targets(sizes):
    """Excess over the limits is reshared by weight, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    rest, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        level = (rest - sum(full.values())) / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in free}
        full |= {s: 2.0 * sizes[s] for s in over}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mixed_sizes(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], words(r[1])) for r in rows)
    sizes, taken, most = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = r.target
        assert r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert most[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * want[s]), (s, taken[s], want[s])
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mixed_sizes(df).collect()}


def test_given_table(spark):
    check(spark, [(r.doc_id, r.text, r.source, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_nulls_ties_hot_and_empty_sources(spark):
    rows = [(i, "w " * (i % 7), "big" if i % 3 else f"s{i % 5}", "x") for i in range(300)]
    rows += [(1000 + i, "a b\tc\x0bd", None, "x") for i in range(20)] + [(2000, None, "void", "x"), (2001, "", "\U0001f600", "x"), (2002, "one " * 5000, "", "x"), (7, "w", "big", "x"), (7, "w", "big", "x")]
    check(spark, rows)


def test_empty_table(spark):
    assert mixing.mixed_sizes(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_low_discrepancy_of_the_schedule(spark):
    plan = spark.createDataFrame([("a", 100, 0, 100.0), ("b", 100, 1, 50.0), ("c", 100, 2, 10.0)], "source string, source_size long, place int, target double")
    rows = sorted((r.slot, r.place, r.block) for r in mixing._schedule(plan, 1600, 3).collect())
    assert [r[0] for r in rows] == list(range(1600))
    seen = [0, 0, 0]
    for slot, place, block in rows:
        assert block == seen[place]
        seen[place] += 1
        for k, w in enumerate((100, 50, 10)):
            assert abs(seen[k] - (slot + 1) * w / 160) < 5


def test_tiny_sources_beside_a_large_corpus(spark):
    rows = [(i, "big" if i % 2 else "huge", 1_000_000) for i in range(40)] + [(1000 + k, f"s{k:02}", 5 if k < 20 else 100) for k in range(40)] + [(2000, None, 5)]
    docs = spark.createDataFrame(rows, "uid long, source string, size long")
    mixed, plan = mixing.mix(docs)
    mixed, target = mixed.join(docs, "uid").select("slot", "source", "uid", "from_word", "to_word").collect(), {r.source: r.target for r in plan.collect()}
    taken, holds = dict.fromkeys(target, 0), {}
    for r in mixed:
        taken[r.source] += r.to_word - r.from_word
        assert holds.setdefault(r.slot, r.source) == r.source
    assert target["s00"] == 10 and taken == {s: int(t) for s, t in target.items()}
    # the small sources' slots are spread over the whole mix
    last = max(holds)
    assert {10 * slot // (last + 1) for slot, s in holds.items() if s not in ("big", "huge")} == set(range(10))
