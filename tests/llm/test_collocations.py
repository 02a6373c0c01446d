import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from duebook.llm import collocations, sql

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute(rows, least=10, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if any(len(h) > len(g) and 2 * b >= a and g in (h[:2], h[1:]) for h, b in found.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((score, a, " ".join(g), left, right))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, totals[lang], s) for i, (s, a, p, left, right) in enumerate(kept[:top])]
    return sorted(out)


def text(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "; "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["New", "york", "city", "étoile", "naïve", "Ünder", "the", "of", "a", "b" * 200, "日本", "x y"] + [f"w{k}" for k in range(60)]
    out = [(rng.choice(["en", "de", None, "l" * 100]), text(rng, words, rng.randint(0, 300))) for _ in range(250)]
    out += [("en", "New York City is big. new york city! New York, city")] * 40 + [("de", None), ("de", ""), (None, "A"), ("zz", "only once here")]
    return out


def run(spark, rows, parts=5, **kw):
    df = spark.createDataFrame([(lang, t, 1, 2, "z") for lang, t in rows], "lang string, text string, n int, rank int, word string")
    return sorted(tuple(r) for r in collocations.collocations(df.repartition(parts), **kw).collect())


@pytest.mark.parametrize("head", [1 << 18, 20, 0])
def test_against_brute_force(spark, rows, head):
    assert run(spark, rows, head=head) == brute(rows)


def test_small_bit_set_and_top(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 1 << 6)
    assert run(spark, rows, parts=9, head=15, top=7) == brute(rows, top=7)


def test_empty_and_bare(spark):
    assert run(spark, []) == [] and run(spark, [("en", None), (None, ""), ("en", " .;\n")]) == []


def test_long_text(spark):
    rows = [("en", "red fox, " * 300000), ("en", "fox red"), ("de", "red fox " * 9)]
    assert run(spark, rows) == brute(rows)


def test_tiles_against_unique():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 1024, 300000), rng.integers(0, 1 << 30, 1000), [5] * 50])
    y = np.concatenate([rng.integers(1024, 2048, 300000), rng.integers(0, 1 << 30, 1000), [7] * 50])
    got = sorted(zip(*(v.tolist() for v in collocations.count_tiles(x, y))))
    pairs, n = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    assert got == [(*p, c) for p, c in zip(pairs.tolist(), n.tolist())]
    assert [len(v) for v in collocations.count_tiles(x[:0], y[:0])] == [0, 0, 0]


def test_sql(spark):
    got, want = compare(spark, duck(SF), lambda s, sf: collocations.collocations(s.read.parquet(f"{sf}/documents.parquet")), sql.OP13, SF)
    assert got == want and len(got[1]) > 1000
