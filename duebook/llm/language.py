"""Language identification of mixed-language text.

Words are runs of letters of any script, with its vowel signs and marks. The script of a word's first
letter, from ranges of code points or from Unicode's names, narrows the languages to those written in it;
words in a script that no learned language is written in speak for none. Each word is scored for each language by its byte trigrams
(with word ends), and a Viterbi path with a penalty for each switch labels the words, so that spans
of one language come out. The document's language is the one with the most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import arrow_rows, small

#: Documents that the model is fitted on, at most (a sample by hash of the id).
TRAINING_DOCS = 20_000
#: Documents of a rare language that are taken beyond that sample, about.
RARE_DOCS = 20
SWITCH = 12.0
BUCKETS = 1 << 16
UNDETERMINED = "und"

#: Scripts and their ranges of code points (letters). Other letters are of the script that begins their Unicode name.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x587)],
    "hebrew": [(0x5D0, 0x5EA)],
    "arabic": [(0x620, 0x6D3), (0x750, 0x77F)],
    "devanagari": [(0x904, 0x963)],
    "bengali": [(0x985, 0x9E3)],
    "tamil": [(0xB85, 0xBCD)],
    "thai": [(0xE01, 0xE4E)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
    "kana": [(0x3041, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
_ALSO = {"hiragana": "kana", "katakana": "kana", "cjk": "han"}


def _script_table() -> tuple[np.ndarray, int]:
    """The script number of every code point, 0 for what is no letter, and the number of scripts with that 0."""
    table, number = np.zeros(1 << 21, np.int16), {name: k + 1 for k, name in enumerate(SCRIPTS)}
    marks = []
    for point in range(0xAA, 0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind not in "LM":
            continue
        words = unicodedata.name(chr(point), "other").lower().replace("-", " ").split()
        name = words[1] if words[0] in ("fullwidth", "halfwidth") else words[0]
        name = _ALSO.get(name, name)
        if kind == "M":
            marks.append((point, name))
        else:
            table[point] = number.setdefault(name, len(number) + 1)
    for point, name in marks:
        table[point] = number.get(name, 0)
    for name, ranges in SCRIPTS.items():
        for a, b in ranges:
            table[a : b + 1] = number[name]
    return table, len(number) + 1


_TABLE, _KINDS = _script_table()


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language: log-probabilities
    scripts: np.ndarray  # script x language: is written in it
    usual: int  # the most frequent language


def _scripts(raw: np.ndarray) -> np.ndarray:
    """The script number of each byte's character, 0 for what is no letter."""
    b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    c, c1, c2, c3 = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
    point = np.where(c < 0x80, c, np.where(c < 0xE0, (c & 31) << 6 | c1, np.where(c < 0xF0, (c & 15) << 12 | c1 << 6 | c2, (c & 7) << 18 | c1 << 12 | c2 << 6 | c3)))
    return _TABLE[point][np.cumsum(lead) - 1] if len(raw) else np.zeros(0, np.int16)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trigram buckets of all letter bytes, first letter byte of each word, letters and script of each word, first word of each row."""
    script = _scripts(raw)
    letter = script > 0
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    low = tx.LOWER[raw].astype(np.uint32)
    before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    joined = letter[1:] & letter[:-1] & ~edge[1:n]
    before[1:][joined] = low[:-1][joined]
    after[:-1][joined] = low[1:][joined]
    bucket = ((before * np.uint32(0x9E3779B1)) ^ (low * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    first = letter.copy()
    first[1:] &= ~joined
    at = np.flatnonzero(letter)
    starts = np.flatnonzero(first)
    words = np.searchsorted(at, starts)
    lead = np.concatenate([[0], np.cumsum(letter & ((raw & 0xC0) != 0x80))])
    ends = at[np.append(words[1:], len(at)) - 1] + 1 if len(starts) else starts
    return bucket[at], words, lead[ends] - lead[starts], script[starts], np.searchsorted(starts, offsets)


def _counts(languages: list[str]):
    place = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        scripts = np.zeros((len(languages), _KINDS), np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for at, raw, offsets in tx.slices(batch.column(1)):
                if not len(raw):
                    continue
                bucket, words, letters, script, first = _words(raw, offsets)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                by_word = lang[at + row]
                of_byte = np.repeat(by_word, np.diff(np.append(words, len(bucket))))
                new, n = np.unique(of_byte * BUCKETS + bucket, return_counts=True)
                keys, place_of = np.unique(np.concatenate([keys, new]), return_inverse=True)
                found = np.bincount(place_of, np.concatenate([found, n]), len(keys)).astype(np.int64)
                np.add.at(scripts, (by_word, script), letters)
        k, b = np.nonzero(scripts)
        for kind, lang, bucket, n in ((0, keys // BUCKETS, keys % BUCKETS, found), (1, k, b, scripts[k, b])):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n)], ["kind", "lang", "bucket", "n"])

    return run


def fit(labelled: DataFrame, most: int = TRAINING_DOCS) -> Model:
    """A model of all languages of ``labelled`` (doc_id, text, lang), from at most about ``most`` of its rows and RARE_DOCS of each language.

    What returns to the driver are counts by language and trigram bucket, no more than the sample's trigrams;
    the model takes BUCKETS * 4 bytes for each language.
    """
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    by_lang = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = sorted(r.lang for r in by_lang)
    rows = sum(r["count"] for r in by_lang)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((_KINDS, 0), bool), 0)
    drawn = F.xxhash64("doc_id")
    taken = F.pmod(drawn, F.lit(max(1, rows))) < most
    rare = [(r.lang, r["count"]) for r in by_lang if r["count"] * most < RARE_DOCS * rows]
    if rows > most and rare:
        known = labelled.sparkSession.createDataFrame(rare, "lang string, of long")
        labelled = labelled.join(small(known, len(rare)), "lang", "left")
        taken = taken | F.coalesce(F.pmod(drawn, F.col("of")) < RARE_DOCS, F.lit(False))
    sample = labelled.filter(taken)
    counted = sample.select("lang", "text").mapInArrow(_counts(languages), "kind int, lang int, bucket int, n long").groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, lang, bucket, n = (counted.column(k).to_numpy() for k in range(4))
    scores, scripts = np.full((BUCKETS, len(languages)), 0.1, np.float32), np.zeros((_KINDS, len(languages)))
    scores[bucket[kind == 0], lang[kind == 0]] += n[kind == 0]
    scripts[bucket[kind == 1], lang[kind == 1]] = n[kind == 1]
    np.log(scores, out=scores)
    scores -= np.log(np.bincount(lang[kind == 0], n[kind == 0], len(languages)) + 0.1 * BUCKETS).astype(np.float32)
    return Model(languages, scores, scripts > 0.01 * np.maximum(scripts.sum(0), 1), languages.index(by_lang[0].lang))


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best path of states (columns) over the rows of each sequence, at ``switch`` for each change.

    Sequences are rows first[i] to first[i + 1]; a step handles one row of every sequence that is long enough.
    """
    lengths = np.diff(first)
    path = np.zeros(len(scores), np.int64)
    if not len(scores):
        return path
    by = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][by], lengths[by]
    live = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), "left")  # how many are longer than t
    state = np.zeros(live[0], np.int64)
    moved, came = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int64)
    best = scores[begin[: live[0]]]
    for t in range(lengths[0]):
        n = live[t]
        if t:
            best = best[:n]
            top = best.argmax(1)
            jump = best[np.arange(n), top][:, None] - switch
            at = begin[:n] + t
            moved[at] = jump > best
            came[at] = top
            best = np.maximum(best, jump) + scores[at]
        if live[t + 1] < n:
            state[live[t + 1] : n] = best[live[t + 1] :].argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = np.where(moved[at, state[:n]], came[at], state[:n])
    return path


def _word_scores(model: Model, bucket: np.ndarray, words: np.ndarray, script: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros((0, len(model.languages)), np.float32)
    scores = np.add.reduceat(model.scores[bucket], words)
    allowed = model.scripts[script]
    scores = np.where(allowed, scores, scores - 1e6)
    scores[~allowed.any(1)] = 0
    return scores


def _label(model: Model, switch: float):
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, offsets in tx.slices(batch.column(1)):
                rows = len(offsets) - 1
                bucket, words, letters, script, first = _words(raw, offsets) if len(raw) else (np.zeros(0, np.int64),) * 4 + (np.zeros(rows + 1, np.int64),)
                counts, every = np.zeros((rows, max(1, len(names)))), np.zeros(rows)
                if names:
                    path = viterbi(_word_scores(model, bucket, words, script), first, switch)
                    row = np.repeat(np.arange(rows), np.diff(first))
                    np.add.at(counts, (row, path), letters * model.scripts.any(1)[script])
                    every = np.bincount(row, letters, rows)
                else:
                    path = np.zeros(len(words), np.int64)
                lang, score, spans = [], [], []
                for k in range(rows):
                    span: list[dict] = []
                    if every[k]:
                        a, b = first[k], first[k + 1]
                        won = int(counts[k].argmax())
                        if not counts[k, won]:  # no script of a learned language
                            path[a:b] = won = model.usual
                        cut = np.concatenate([[0], np.flatnonzero(np.diff(path[a:b])) + 1, [b - a]])
                        span = [{"lang": names[path[a + x]], "first_word": int(x), "words": int(y - x)} for x, y in zip(cut[:-1], cut[1:], strict=True)]
                        lang.append(names[won]), score.append(float(counts[k, won] / every[k]))
                    else:
                        lang.append(UNDETERMINED), score.append(0.0)
                    spans.append(span)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(lang), pa.array(score, pa.float64()), pa.array(spans, _SPANS)], ["doc_id", "lang_pred", "score", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every row of ``docs`` (doc_id, text), whole texts.

    ``spans`` are runs of words of one language. ``score`` is the share of letters in words of the
    predicted language; ties go to the first language by name. Null texts and texts without a letter
    are ``und`` with score 0; so is every text if nothing was learned. Words in a script that no learned
    language is written in join the span beside them but count for no language; a text of such words
    only gets the most frequent language, with score 0.
    """
    arrow_rows(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_label(model, switch), "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first_word: int, words: int>>")


def held_out(doc_id: str = "doc_id"):
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def languages(docs: DataFrame, switch: float = SWITCH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a model of the rows that are not held out."""
    model = fit(docs.filter(~held_out()))
    return identify(docs, model, switch).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
