"""Licence scans: parts of a text against licence notices, by Dice's coefficient over word bigrams.

Parts are the lines of a text and its paragraphs of several lines. A part and a template of a and b
bigrams can reach a coefficient of t only when b lies between a * t / (2 - t) and a * (2 - t) / t;
parts of other sizes leave before any bigram is made. The rest meet the templates by an equi-join
on bigrams with the fixed template table.

Notices inside longer lines, wrapped notices and whole licence texts are found as runs of words of the
whole text. A run that reaches t holds b * t / (2 - t) of a template's bigrams at least, so by counts of
its rarer ones only texts that can hold one remain, and windows over their words name the runs.
A match shares so many bigrams with its template that it has at least one of a few telling words, chosen
so that each template's bigrams without them are too few; texts with none of them leave first.
DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, small

#: Least coefficient of a match.
LEAST = 0.8

#: Licence identifiers and the notices that state them.
TEMPLATES = {
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "{it} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."

#: Headers and licence texts, sought as runs of words only; whole texts of the longer licences are in files.
TEXTS = {
    "MIT": [_MIT],
    "ISC": [_ISC],
    "BSD-3-Clause": [_BSD + _BSD_NAMES + _BSD_END],
    "BSD-2-Clause": [_BSD + _BSD_END],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "GPL-2.0": [_GNU.format(it="This program", kind="General", version="2")],
    "GPL-3.0": [_GNU.format(it="This program", kind="General", version="3")],
    "LGPL-2.1": [_GNU.format(it="This library", kind="Lesser General", version="2.1")],
    "LGPL-3.0": [_GNU.format(it="This library", kind="Lesser General", version="3")],
    "AGPL-3.0": [_GNU.format(it="This program", kind="Affero General", version="3")],
}
_FILES = Path(__file__).parent / "license_texts"
_COMMON = frozenset("a an and any are as at be by for from in is it not of on or that the this to under will with you your".split())


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def template_rows(templates: dict[str, list[str]]) -> list[tuple[int, str, int, str]]:
    """(template, licence, its bigrams' number, bigram): a table whose size the templates fix."""
    texts = [(name, bigrams(t)) for name, notices in templates.items() for t in notices]
    return [(k, name, len(grams), g) for k, (name, grams) in enumerate(texts) for g in grams]


def _pairs(words: str, join):
    follow = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), follow), F.slice(words, F.lit(2), follow), join)


def _bigram_pairs(words: str):
    return _pairs(words, lambda a, b: F.concat_ws(" ", a, b))


def telling_words(templates: dict[str, list[str]], least: float) -> list[str] | None:
    """Words of which every match of a template has one at least: all its bigrams without them don't reach ``least``. None if common words alone would do."""
    chosen: list[str] = []
    sets = [set(bigrams(t)) for notices in templates.values() for t in notices]
    needs = [math.ceil(len(grams) * least / (2 - least) - 1e-9) for grams in sets]
    while True:
        left = [[g for g in grams if not set(g.split()) & set(chosen)] for grams in sets]
        counts = Counter(w for grams, need in zip(left, needs, strict=True) if grams and len(grams) >= need for g in grams for w in set(g.split()))
        if not counts:
            return chosen
        counts = {w: n for w, n in counts.items() if w not in _COMMON and len(w) > 1}
        if not counts:
            return None
        chosen.append(max(counts, key=lambda w: (len(w) > 3, counts[w], w)))


def _telling(docs: DataFrame, templates: dict[str, list[str]], least: float) -> DataFrame:
    words = telling_words(templates, least)
    if words is None:
        return docs
    # exploding an array of one keeps the optimizer from copying the expression into each condition
    low = docs.withColumn("low", F.explode(F.array(F.lower("text"))))
    found = F.lit(False)
    for w in words:
        here = F.contains("low", F.lit(w))  # a short one has to be a word of its own
        found = found | (here if len(w) > 3 else here & F.rlike("low", F.lit(f"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)")))
    return low.filter(found).drop("low")


def _run_tables(templates: dict[str, list[str]], least: float) -> tuple[list[tuple], list[tuple]]:
    """(template, license, grams, need, rare, step, span, lengths of its windows), and (template, words of a bigram, its number, is rare).

    A run that reaches ``least`` has ``need`` of the template's bigrams, so it has all but grams - need of
    any choice of them; ``rare`` is what it has of the rarer 60 %.
    """
    texts = [(name, t) for name, notices in templates.items() for t in notices]
    sets = [bigrams(t) for _, t in texts]
    shared = Counter(g for grams in sets for g in grams)
    number = {g: k for k, g in enumerate(sorted(shared))}
    meta, known = [], []
    for k, ((name, text), grams) in enumerate(zip(texts, sets, strict=True)):
        if not grams:
            continue
        need = math.ceil(len(grams) * least / (2 - least) - 1e-9)
        chosen = max(len(grams) - need + 1, math.ceil(0.6 * len(grams)))
        by_rarity = sorted(grams, key=lambda g: (sum(w in _COMMON for w in g.split()), shared[g], g))
        span = len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split()) - 1
        low, high = math.ceil(span * least / (2 - least) - 1e-9), math.floor(span * (2 - least) / least + 1e-9)
        lengths = sorted({*range(low, high + 1, max(1, span // 8)), span, high})
        meta.append((k, name, len(grams), need, chosen - (len(grams) - need), max(1, span // 16), span, lengths))
        known += [(k, *g.split(), number[g], place < chosen) for place, g in enumerate(by_rarity)]
    return meta, known


def license_runs(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, h, license, first_word, words, dice): runs of words of the whole text whose coefficient reaches ``least``.

    Without ``templates``, those are TEMPLATES, TEXTS and the whole texts in files. Runs begin and end with a
    bigram of the template and are cut from windows over the words; for templates of 16 words or fewer those
    are all windows within the bounds of size, for longer ones begins are a sixteenth and sizes an eighth of
    the template apart. A run whose middle lies in a nearer one is left out; equal rows give one row. ``h`` is a hash of the text,
    so rows that share an id, or have none, are told apart.
    """
    if templates is None:
        templates = {name: TEMPLATES.get(name, []) + TEXTS.get(name, []) for name in {**TEMPLATES, **TEXTS}}
        for file in sorted(_FILES.glob("*.txt")):
            templates[file.stem] = [*templates.get(file.stem, []), file.read_text()]
    spark = docs.sparkSession
    meta, known = _run_tables(templates, least)
    meta = F.broadcast(spark.createDataFrame(meta, "template int, license string, grams int, need int, rare int, step int, span int, lengths array<int>"))
    known = spark.createDataFrame(known, "template int, one string, two string, number int, rarer boolean")
    known = known.select("template", F.xxhash64("one", "two").alias("gram"), "number", "rarer")
    docs = _telling(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").filter("text IS NOT NULL"), templates, least)

    def with_grams(rows: DataFrame) -> DataFrame:
        # exploding an array of one, as below
        rows = rows.select("doc_id", "h", F.explode(F.array(F.expr("regexp_extract_all(lower(text), '[a-z0-9]+', 0)"))).alias("words"))
        return rows.select("doc_id", "h", F.explode(F.array(_pairs("words", lambda a, b: F.xxhash64(a, b)))).alias("text_grams"))

    held = with_grams(docs).select("doc_id", "h", F.explode("text_grams").alias("gram")).join(F.broadcast(known.filter("rarer")), "gram")
    held = held.groupBy("doc_id", "h", "template").agg(F.count_distinct("number").alias("n")).join(meta, "template").filter("n >= rare")
    able = keep(held.select("doc_id", "h", "template"), "able")
    texts = able.groupBy("doc_id", "h").count().select(F.col("doc_id").alias("d"), F.col("h").alias("t"))
    same = (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))
    pairs = keep(with_grams(docs.join(small(texts, able.count()), same, "left_semi").dropDuplicates(["doc_id", "h"])), "able-texts")
    able = able.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), F.col("template").alias("k"))

    hits = pairs.select("doc_id", "h", F.posexplode("text_grams").alias("at", "gram")).join(F.broadcast(known.drop("rarer")), "gram")
    hits = hits.join(able, same & (F.col("template") == F.col("k")), "left_semi").groupBy("doc_id", "h", "template").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("hits"))
    # windows begin at a hit, the first one of each step, and end with the last hit that they reach
    begins = "filter(transform(hits, (x, i) -> struct(i AS i, x.at AS at)), b -> b.i = 0 OR hits[b.i - 1].at DIV step <> b.at DIV step)"
    reached = "filter(slice(hits, b.i + 1, l), y -> y.at < b.at + l)"
    found = f"transform({begins}, b -> transform(lengths, l -> transform(array({reached}), w -> struct(b.at AS first, element_at(w, -1).at AS last, size(array_distinct(transform(w, y -> y.number))) AS both))[0]))"
    runs = hits.join(meta, "template").select("doc_id", "h", "template", "license", "grams", "span", "need", F.expr(f"inline(array_distinct(flatten({found})))")).filter("both >= need").drop("need")
    runs = runs.join(pairs.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), "text_grams"), same)
    runs = runs.withColumn("n", F.expr("size(array_distinct(slice(text_grams, first + 1, last - first + 1)))")).drop("text_grams", "d", "t")
    runs = runs.withColumn("dice", F.expr("2D * both / (n + grams)")).filter(F.col("dice") >= least)
    # the nearest of a template's runs that begin within its length of words
    nearest = F.max(F.struct("dice", (-F.col("first")).alias("f"), (-F.col("last")).alias("l"), (-F.col("template")).alias("k")))
    runs = keep(runs.groupBy("doc_id", "h", "template", "license", F.expr("first DIV span").alias("cell")).agg(nearest.alias("rank")), "runs")
    covers = runs.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), F.col("rank").alias("r"), F.explode(F.expr("sequence(-rank.f, -rank.l)")).alias("word"))
    middle = F.expr("CAST(floor(-(rank.f + rank.l) / 2) AS INT)")
    runs = runs.withColumn("middle", middle).join(covers, same & (F.col("middle") == F.col("word")) & (F.col("r") > F.col("rank")), "left_anti")
    return runs.select("doc_id", "h", "license", (-F.col("rank.f")).alias("first_word"), (F.col("rank.f") - F.col("rank.l") + 2).alias("words"), F.col("rank.dice").alias("dice"))


def license_matches(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, h, part, license, dice): the licence nearest to each part, if its coefficient reaches ``least``; ties go to the first template.

    ``docs``: doc_id, text; other columns are ignored. ``part`` numbers a document's lines from 0 and
    its paragraphs of several lines from -1 downwards. Letters are lower-cased; all but ASCII letters
    and digits separate words; a part's bigrams are a set. Null and empty texts have no part that matches.
    Each row is judged by its own text, of which ``h`` is a hash; equal rows give one row.
    """
    table = template_rows(templates or TEMPLATES)
    spark = docs.sparkSession
    known = spark.createDataFrame(table, "template int, license string, grams int, bigram string")
    narrow, wide = least / (2 - least) - 1e-9, (2 - least) / least + 1e-9
    low, high = min(r[2] for r in table) * narrow, max(r[2] for r in table) * wide
    text = F.col("text")
    docs = _telling(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), templates or TEMPLATES, least)
    lines = docs.select("doc_id", "h", F.posexplode(F.split(text, r"\r?\n")).alias("part", "said"))
    paragraphs = docs.select("doc_id", "h", F.posexplode(F.split(text, r"\r?\n[ \t]*\r?\n\s*")).alias("part", "said")).filter(F.col("said").contains("\n")).withColumn("part", -1 - F.col("part"))
    parts = lines.unionByName(paragraphs).filter(F.length("said") >= int(2 * low))
    # exploding an array of one keeps the optimizer from copying the expression into each filter above it
    parts = parts.select("doc_id", "h", "part", F.explode(F.array(F.expr("regexp_extract_all(lower(said), '[a-z0-9]+', 0)"))).alias("words"))
    # distinct bigrams are no more than the words less one, and no fewer than the distinct words less one
    parts = parts.filter(F.size("words") - 1 >= low).filter(F.size(F.array_distinct("words")) - 1 <= high)
    parts = parts.select("doc_id", "h", "part", F.explode(F.array(F.array_distinct(_bigram_pairs("words")))).alias("set"))
    parts = parts.withColumn("n", F.size("set")).filter((F.col("n") >= low) & (F.col("n") <= high))
    shared = parts.select("doc_id", "h", "part", "n", F.explode("set").alias("bigram")).join(F.broadcast(known), "bigram")
    shared = shared.filter((F.col("grams") >= F.col("n") * narrow) & (F.col("grams") <= F.col("n") * wide))
    dice = shared.groupBy("doc_id", "h", "part", "template", "license", "grams", "n").agg(F.count_distinct("bigram").alias("both")).withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("grams")))
    best = F.max_by(F.struct("license", "dice"), F.struct("dice", (-F.col("template")).alias("t")))
    return dice.filter(F.col("dice") >= least).groupBy("doc_id", "h", "part").agg(best.alias("best")).select("doc_id", "h", "part", "best.license", "best.dice")


def license_report(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, n_parts, licenses, best_license, best_dice) for every row of ``docs``.

    ``licenses`` are the licences found, in order, joined by commas; ties for the best go to the first
    by name. A licence that no part states counts once if a run of words does. Rows without a match
    have 0, an empty string and nulls. Each row is judged by its own text, whether its id is null or
    shared; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    runs = license_runs(docs, templates, least).groupBy("doc_id", "h", "license").agg(F.max("dice").alias("dice"))
    runs = keep(runs.withColumn("part", F.concat(F.lit("run "), F.col("license"))), "run-parts")
    found = keep(license_matches(docs, templates, least).withColumn("part", F.col("part").cast("string")), "parts")
    stated = found.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), F.col("license").alias("l")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t"))
    found = found.unionByName(runs.join(stated, same & (F.col("license") == F.col("l")), "left_anti").select(found.columns))
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("t")).agg(
        F.count_distinct("part").alias("n_parts"), F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"),
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"),
    )
    out = docs.select("doc_id", F.xxhash64("text").alias("h")).join(found, same, "left")
    return out.select("doc_id", F.coalesce("n_parts", F.lit(0)).cast("long").alias("n_parts"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.col("best.license").alias("best_license"), F.round(-F.col("best.d"), 6).alias("best_dice"))
