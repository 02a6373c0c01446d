"""Benchmark decontamination with suffix arrays of the training text.

Each slice of documents is a shard: its words, by hash, are sorted as suffixes by prefix doubling,
to a depth beyond the window. Every suffix of every benchmark item is looked up in each shard by
binary search, word by word, over all suffixes at once. Matches of suffixes that follow one another
in the item and in the document are one verbatim match, extended to its full length.
Items are sent to the tasks as text, in chunks of bounded size. Each chunk but the last is a pass whose
result is written, so that one chunk at a time is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import arrow_rows, keep

WINDOW = 10
#: Bytes of item text that one pass over the documents takes along. A single larger item is a chunk of its own.
CHUNK_BYTES = 8 << 20

_MATCH = "array<struct<item_id: long, start: int, length: int, item_start: int>>"
_FIELDS = [("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("item_start", pa.int32())]
_MATCH_TYPE = pa.list_(pa.struct(_FIELDS))


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at, raw, offsets in tx.slices(column):
        raw = tx.LOWER[raw]
        starts, ends, first = tx.spans(raw, offsets, tx.NOT_ALNUM)
        yield at, tx.word_hashes(raw, starts, ends), first


class Suffixes:
    """The words of some items and every place where a window of an item begins, with the window's length."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int = WINDOW) -> None:
        self.window = window
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, h, first in _words(pa.array(texts, pa.large_string())):
            hashes.append(h), sizes.append(np.diff(first))
        self.words, n = np.concatenate(hashes), np.concatenate(sizes)
        have = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
        first = np.cumsum(n) - n
        self.item = np.repeat(np.array(ids, np.int64), have)
        self.row = np.repeat(np.arange(len(n)), have)
        self.place = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)  # in the item
        self.at = np.repeat(first, have) + self.place
        self.lengths = np.repeat(np.minimum(n, window), have)

    @classmethod
    def from_bytes(cls, data: bytes, window: int) -> Suffixes:
        with pa.ipc.open_stream(data) as stream:
            table = stream.read_all()
        return cls(table.column("item_id").to_pylist(), table.column("text").to_pylist(), window)


def suffix_array(hashes: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order of their first words (``depth`` or more), words as codes from 1, and the codes' hashes.

    A suffix ends with its document: beyond it stands code 0.
    """
    alphabet, code = np.unique(hashes, return_inverse=True)
    code = code.astype(np.int64) + 1
    n = len(code)
    end = np.repeat(first[1:], np.diff(first))
    rank, reach = code, 1
    order = np.argsort(rank, kind="stable")
    while reach < depth:
        after = np.arange(n) + reach
        key = rank * (n + 1) + np.where(after < end, rank[np.minimum(after, n - 1)], 0)
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) + 1
        reach *= 2
    return order, code, alphabet


def find(items: Suffixes, order: np.ndarray, code: np.ndarray, alphabet: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window of the items, word position) of every occurrence, by binary search in the suffix array."""
    n, padded = len(order), np.concatenate([code, [0]])
    end = np.repeat(first[1:], np.diff(first))
    place = np.searchsorted(alphabet, items.words)
    codes = np.where(alphabet[np.minimum(place, len(alphabet) - 1)] == items.words, place + 1, 0)
    # only windows all of whose words are in the shard
    known = np.concatenate([[0], np.cumsum(codes > 0)])
    which = np.flatnonzero(known[items.at + items.lengths] - known[items.at] == items.lengths)
    low, high = np.zeros(len(which), np.int64), np.full(len(which), n, np.int64)
    found_w, found_low, found_high = [which[:0]], [low[:0]], [low[:0]]

    def bisect(lo: np.ndarray, hi: np.ndarray, target: np.ndarray, d: int) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            suffix = order[np.minimum(mid, n - 1)]
            word = np.where(suffix + d < end[suffix], padded[np.minimum(suffix + d, n)], 0)
            less = open_ & (word < target)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo

    for d in range(items.window):
        want = codes[items.at[which] + d]
        low, high = bisect(low, high, want, d), bisect(low, high, want + 1, d)
        live = low < high
        done = live & (items.lengths[which] == d + 1)
        found_w.append(which[done]), found_low.append(low[done]), found_high.append(high[done])
        live &= ~done
        which, low, high = which[live], low[live], high[live]
        if not len(which):
            break
    w, lo, hi = (np.concatenate(x) for x in (found_w, found_low, found_high))
    counts = hi - lo
    return np.repeat(w, counts), order[np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


def _longest(items: Suffixes, w: np.ndarray, p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """Documents and their verbatim matches: runs of occurrences whose places in item and document advance together."""
    doc = np.searchsorted(first, p, "right") - 1
    shift = p - items.at[w]
    by = np.lexsort((p, shift, items.row[w], doc))
    w, p, doc, shift = w[by], p[by], doc[by], shift[by]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(items.row[w]) != 0) | (np.diff(shift) != 0) | (np.diff(p) != 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(p))[: len(begin)] - 1
    item, start, length, place = items.item[w[begin]], p[begin] - first[doc[begin]], p[last] + items.lengths[w[last]] - p[begin], items.place[w[begin]]
    rows = np.unique(np.stack([doc[begin], item, start, length, place]), axis=1)  # rows that repeat an item count once
    fields = [pa.array(v.astype(k.to_pandas_dtype())) for v, (_, k) in zip(rows[1:], _FIELDS, strict=True)]
    return rows[0], pa.StructArray.from_arrays(fields, [name for name, _ in _FIELDS])


def _search(data: bytes, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Suffixes.from_bytes(data, window)
        for batch in batches:
            for at, hashes, first in _words(batch.column(1)):
                rows = len(first) - 1
                found = batch.column(3).slice(at, rows)
                if len(hashes) and len(items.at):
                    doc, matches = _longest(items, *find(items, *suffix_array(hashes, first, window), first), first)
                    offsets = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
                    if found.null_count == rows:
                        found = pa.ListArray.from_arrays(pa.array(offsets), matches)
                    else:
                        more = pa.ListArray.from_arrays(pa.array(offsets), matches).to_pylist()
                        found = pa.array([(x or []) + y for x, y in zip(found.to_pylist(), more, strict=True)], _MATCH_TYPE)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array(np.diff(first).astype(np.int64)), found.cast(_MATCH_TYPE)], ["doc_id", "text", "n_words", "matches"])

    return run


def benchmark_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text, n_words, matches) for each row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A window is ``window``
    consecutive words of an item, or the whole item if it has fewer. A match is a longest run of words of
    an item that stands verbatim in the document and holds a window: where it begins in both, and its
    length. Null text has no words; an item without words or with a null id matches nothing; rows that
    repeat an item count once.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = total // chunk_bytes + 1
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(_MATCH).alias("matches"))
    for k in range(chunks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as stream:
            stream.write_table(part)
        out = out.mapInArrow(_search(sink.getvalue().to_pybytes(), window), f"doc_id long, text string, n_words long, matches {_MATCH}")
        if k + 1 < chunks:
            out = keep(out, "matches")
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        hit, count, digest = [], [], []
        for matches in batch.column(2).to_pylist():
            if not matches:
                hit.append(0), count.append(0), digest.append(empty)
                continue
            covered, reach = 0, 0
            for a, b in sorted((m["start"], m["start"] + m["length"]) for m in matches):
                covered += max(0, b - max(a, reach))
                reach = max(reach, b)
            ids = sorted({str(m["item_id"]) for m in matches})
            hit.append(covered), count.append(len(ids)), digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        columns = [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array([x > 0 for x in hit])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words inside matches, items matched, their digest, and the verdict."""
    found = benchmark_matches(docs, items, window).select("doc_id", "n_words", "matches")
    return found.mapInArrow(_summaries, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has no match.

    Verdicts are joined by id: rows that share an id go together if any of them matches. Rows with a
    null id are judged by their text's digest instead.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    bad = contamination(docs.select(key.alias("doc_id"), "text"), items, window).filter("contaminated").select(F.col("doc_id").alias("__bad"))
    return docs.join(bad, key == F.col("__bad"), "left_anti")
