"""Toxic spans by a linear-chain conditional random field over words.

Document labels become token labels: in a toxic document, the words that are far more frequent in
toxic than in clean training documents. The field has two tags, a weight for each hashed word and
for each pair of tags, fitted by gradient steps on forward-backward marginals. Marginals of the
toxic tag give offending spans and, summed over a document, its score through a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .language import held_out
from .store import arrow_rows

#: The model is fitted on at most about so many labelled rows (a sample by hash of the id), of at most so many bytes each.
TRAINING_DOCS = 3000
TRAINING_BYTES = 1 << 16
#: A word's features are itself and its beginnings of so many bytes, for inflected and compound words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A feature has a weight if so many toxic training documents have it, so many times more often than clean ones.
LEAST_DOCS, LEAST_ODDS = 3, 3.0
STEPS = 25
THRESHOLD = 0.3


@dataclass
class Model:
    keys: np.ndarray  # hashes of the features that have a weight, in order
    weights: np.ndarray  # weight of the toxic tag for each, and 0 for all others
    bias: float
    pairs: np.ndarray  # weight of each pair of tags
    curve: tuple[float, float]  # the document's logistic curve over log(1 + expected toxic words)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = tx.LOWER[raw]
    starts, ends, first = tx.spans(low, offsets, tx.NOT_ALNUM)
    features = [tx.word_hashes(low, starts, ends)]
    for size in BEGINNINGS:
        begin = tx.mix(tx.word_hashes(low, starts, np.minimum(starts + size, ends)), size)
        features.append(np.where(ends - starts > size, begin, features[0]))
    return np.stack(features), starts, ends, first


def _places(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each feature's place among the keys, or one beyond the last; features of one word that repeat count once."""
    out = np.full(hashes.shape, len(keys), np.int64)
    if len(keys):
        mask = np.zeros(1 << 18, bool)
        mask[keys & np.uint64(len(mask) - 1)] = True
        likely = mask[hashes & np.uint64(len(mask) - 1)]
        likely[1:] &= hashes[1:] != hashes[0]
        some = hashes[likely]
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        out[likely] = np.where(keys[at] == some, at, len(keys))
    return out


def marginals(unary: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each word and the summed probabilities of each pair of tags, by forward-backward.

    ``unary``: the log-weight of the toxic tag (clean has 0). A step handles one word of every sequence.
    """
    out, both = np.zeros(len(unary)), np.zeros((2, 2))
    if not len(unary):
        return out, both
    lengths = np.diff(first)
    by = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][by], lengths[by]
    live = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), "left")
    m = np.exp(pairs)
    local = np.exp(np.clip(unary, -30, 30))  # toxic against clean
    ahead = np.zeros(len(unary))  # share of the toxic tag in the forward message
    a = np.zeros(0)
    for t in range(lengths[0]):
        at = begin[: live[t]] + t
        if t:
            a = a[: live[t]]
            clean, toxic = (1 - a) * m[0, 0] + a * m[1, 0], ((1 - a) * m[0, 1] + a * m[1, 1]) * local[at]
        else:
            clean, toxic = np.ones(live[0]), local[at]
        a = toxic / (clean + toxic)
        ahead[at] = a
    back = np.full(live[0], 0.5)  # share of the toxic tag in the backward message
    for t in range(lengths[0] - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        b = back[:n]
        toxic, clean = ahead[at] * b, (1 - ahead[at]) * (1 - b)
        out[at] = toxic / (toxic + clean)
        if t:
            before = ahead[at - 1]
            w0, w1 = 1 - b, local[at] * b
            cells = [(1 - before) * m[0, 0] * w0, (1 - before) * m[0, 1] * w1, before * m[1, 0] * w0, before * m[1, 1] * w1]
            total = cells[0] + cells[1] + cells[2] + cells[3]
            both += np.array([(c / total).sum() for c in cells]).reshape(2, 2)
            down0, down1 = m[0, 0] * w0 + m[0, 1] * w1, m[1, 0] * w0 + m[1, 1] * w1
            back[:n] = down1 / (down0 + down1)
    return out, both


def _documents(hashes: np.ndarray, row: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the picked words, and in how many rows each is."""
    h, r = hashes[:, pick].ravel(), np.tile(row[pick], len(hashes))
    order = np.lexsort((r, h))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.unique(h[new], return_counts=True)


def fit_field(texts: list[str], toxic: np.ndarray, steps: int = STEPS) -> Model:
    """A model from whole texts and their labels, in NumPy; the caller bounds their number."""
    hashes, first = [np.zeros((1 + len(BEGINNINGS), 0), np.uint64)], [np.zeros(1, np.int64)]
    for _, raw, offsets in tx.slices(pa.array(texts, pa.large_string())):
        h, _, _, f = _words(raw, offsets)
        hashes.append(h)
        first.append(f[1:] + first[-1][-1])
    hashes, first = np.concatenate(hashes, axis=1), np.concatenate(first)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))

    bad_keys, bad = _documents(hashes, row, toxic[row] == 1)
    bad_keys, bad = bad_keys[bad >= LEAST_DOCS], bad[bad >= LEAST_DOCS]
    good_keys, good = _documents(hashes, row, toxic[row] == 0)
    at = np.minimum(np.searchsorted(good_keys, bad_keys), max(0, len(good_keys) - 1))
    good = np.where(good_keys[at] == bad_keys, good[at], 0) if len(good_keys) else np.zeros(len(bad_keys))
    odds = ((bad + 0.1) / (n1 + 1)) / ((good + 0.5) / (n0 + 1))
    chosen = odds >= LEAST_ODDS
    keys = bad_keys[chosen]
    marked = np.append((odds >= 10) & (bad >= max(LEAST_DOCS, 0.04 * n1)), False)[np.append(chosen, True)]
    size = len(keys) + 1
    place = _places(keys, hashes)
    tag = marked[place].any(0) & (toxic[row] == 1)

    weights, bias, pairs = np.zeros(size), float(np.log((tag.sum() + 1) / (len(tag) + 1000))), np.zeros((2, 2))
    gold = np.zeros((2, 2))
    inner = np.ones(len(tag), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    np.add.at(gold, (tag[at - 1].astype(int), tag[at].astype(int)), 1)
    layer, word = np.nonzero(place < len(keys))
    which = place[layer, word]
    squares = [np.full(size, 1e-3), 1e-3, np.full((2, 2), 1e-3)]
    for _ in range(steps if len(tag) else 0):
        unary = np.bincount(word, weights[which], minlength=len(tag)) + bias
        p, both = marginals(unary, pairs, first)
        slopes = [np.bincount(which, (tag - p)[word], minlength=size) - 0.1 * weights, (tag.sum() - p.sum()) / len(tag) * 100, (gold - both) / max(1, len(at)) * 100 - 0.1 * pairs]
        squares = [s + g * g for s, g in zip(squares, slopes, strict=True)]
        weights += 1.5 * slopes[0] / np.sqrt(squares[0])
        bias += 0.3 * slopes[1] / np.sqrt(squares[1])
        pairs += 0.3 * slopes[2] / np.sqrt(squares[2])
    weights[-1] = 0

    p, _ = marginals(weights[place].sum(0) + bias, pairs, first)
    x = np.log1p(np.bincount(row, p, minlength=len(texts)))
    a, b = -3.0, 3.0
    for _ in range(200 if toxic.any() else 0):  # Newton steps of a logistic regression with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = q * (1 - q) + 1e-9
        slope = np.array([(toxic - q).sum() - 0.01 * a, ((toxic - q) * x).sum() - 0.01 * b])
        curve = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        change = np.clip(np.linalg.solve(curve, slope), -1, 1)
        a, b = a + change[0], b + change[1]
        if np.abs(change).max() < 1e-9:
            break
    return Model(keys, weights, float(bias), pairs, (float(a), float(b)))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> Model:
    """A model of ``labels`` (doc_id, toxic) with the texts of ``docs``, from about ``most`` labelled rows at most."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = known.count()
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows))) < most)
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAINING_BYTES)
    sample = texts.join(F.broadcast(known), "doc_id").select("text", "toxic").orderBy(F.xxhash64("text"), "toxic").toPandas()
    return fit_field(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64))


def _tagged(model: Model):
    a, b = model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, offsets in tx.slices(batch.column(1)):
                rows = len(offsets) - 1
                hashes, starts, ends, first = _words(raw, offsets)
                p, _ = marginals(model.weights[_places(model.keys, hashes)].sum(0) + model.bias, model.pairs, first)
                row = np.repeat(np.arange(rows), np.diff(first))
                x = np.log1p(np.bincount(row, p, minlength=rows))
                score = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
                spans: list[list[dict]] = [[] for _ in range(rows)]
                last = -2
                for k in np.flatnonzero(p >= 0.5):
                    own = spans[row[k]]
                    if k == last + 1 and own and k > first[row[k]]:
                        own[-1]["stop"] = int(ends[k] - offsets[row[k]])
                    else:
                        own.append({"start": int(starts[k] - offsets[row[k]]), "stop": int(ends[k] - offsets[row[k]])})
                    last = k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(score), pa.array(spans, _SPANS)], ["doc_id", "score", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) for every row of ``docs`` (doc_id, text), whole texts.

    ``spans`` are byte offsets of runs of words whose marginal of the toxic tag is 0.5 or more. A null,
    empty or wordless text has no span and the score of no toxic word.
    """
    arrow_rows(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_tagged(model), "doc_id long, score double, spans array<struct<start: int, stop: int>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a model of the labelled rows that are not held out."""
    model = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    return tag(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
