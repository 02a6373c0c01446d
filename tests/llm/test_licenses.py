import re

from duebook.llm import licenses


def brute(text, least=0.8):
    found = {}
    parts = list(enumerate(re.split(r"\r?\n", text or ""))) + [(-1 - k, p) for k, p in enumerate(re.split(r"\r?\n[ \t]*\r?\n\s*", text or "")) if "\n" in p]
    for k, part in parts:
        b = set(licenses.bigrams(part))
        best = max(((2 * len(b & set(t)) / (len(b) + len(t)), -n, name) for n, (name, t) in enumerate((name, licenses.bigrams(t)) for name, ts in licenses.TEMPLATES.items() for t in ts)), default=None)
        if b and best[0] >= least:
            found[k] = (best[2], round(best[0], 9))
    return found


def test_against_brute_force(spark):
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rows = [(k, f"some words\n{t.upper()}\r\nmore") for k, t in enumerate(notices)]
    rows += [(50 + k, f"{t} indeed so") for k, t in enumerate(notices)] + [(80 + k, t.replace(" ", "\n", 3) + "\n\nend of it") for k, t in enumerate(notices)]
    rows += [(200, None), (201, ""), (202, "the mit license " * 4000), (203, "Released under the MIT License.\nReleased under the MIT License."), (None, "Released under the MIT License.")]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, n int")
    got: dict = {}
    for r in licenses.license_matches(df).collect():
        got.setdefault(r.doc_id, {})[r.part] = (r.license, round(r.dice, 9))
    assert got == {i: b for i, t in rows if (b := brute(t))}
    report = {r.doc_id: r for r in licenses.license_report(df).collect()}
    assert len(report) == len(rows)
    assert (report[203].licenses, report[203].best_dice) == ("MIT", 1.0)
    assert (report[201].n_parts, report[201].licenses, report[201].best_license) == (0, "", None)
    assert licenses.license_report(df.limit(0)).count() == 0


def test_whole_texts_and_embedded_and_wrapped_notices(spark):
    wrap = lambda t, n, mark: "\n".join(mark + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    filler = " ".join(f"word{k} of the text" for k in range(60))
    gpl = (licenses._FILES / "GPL-3.0.txt").read_text()
    cases = {
        1: (f"{filler} Released under the MIT License. {filler}", "MIT"),
        2: (f"{filler}\n{wrap(licenses.TEXTS['GPL-3.0'][0], 9, '# ')}\n{filler}", "GPL-3.0"),
        3: (wrap(licenses.TEXTS["MIT"][0], 11, " * "), "MIT"),
        4: (wrap(licenses.TEXTS["BSD-3-Clause"][0], 11, "// "), "BSD-3-Clause"),
        5: (wrap(licenses.TEXTS["ISC"][0].replace("SOFTWARE", "PROGRAM"), 11, ""), "ISC"),
        6: (f"{filler}\n{gpl}\n{filler}", "GPL-3.0"),
        7: (f"{filler} Licensed under CC BY-NC 4.0. {filler} Licensed under the Apache License, Version 2.0. {filler}", "Apache-2.0,CC-BY-NC-4.0"),
        8: (filler, ""),
        9: (f"{filler} the License under CC and the MIT of Version 2.0 {filler}", ""),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    report = {r.doc_id: r for r in licenses.license_report(df).collect()}
    assert {k: r.licenses for k, r in report.items()} == {k: want for k, (_, want) in cases.items()}
    assert all(report[k].best_dice > 0.95 for k in (1, 2, 3, 4, 6, 7))


def test_rows_of_one_id_and_of_none(spark):
    words = licenses.TEMPLATES["GPL-3.0"][2].split()
    rows = [(1, "Released under the MIT License.")] * 2 + [(2, " ".join(words[k : k + 17])) for k in (0, 16, 32)] + [(None, "Released under the MIT License."), (None, "nothing here")]
    got = sorted(((r.doc_id, r.n_parts, r.licenses, r.best_dice) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    none, mit = (0, "", None), (1, "MIT", 1.0)
    assert got == sorted([(1, *mit), (1, *mit), (2, *none), (2, *none), (2, *none), (None, *mit), (None, *none)], key=str)


def test_telling_words():
    words = licenses.telling_words(licenses.TEMPLATES, 0.8)
    assert words and len(words) < 20
    for notices in licenses.TEMPLATES.values():
        for t in notices:
            grams = licenses.bigrams(t)
            assert sum(not set(g.split()) & set(words) for g in grams) < 2 * len(grams) / 3
    assert licenses.telling_words({"x": ["of the and to be"]}, 0.8) is None
