"""Token ids in a binary format coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all chunks. A chunk holds whole
documents in ascending order of id; its ids are cut into blocks of LANES x STEPS, each coded on its
own by interleaved lanes. A checkpoint for each block (the lanes' states and the place in the
chunk's words) and a checksum let any block be decoded alone, and all of them at once.
"""

from __future__ import annotations

import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .store import arrow_rows, keep, shared_folder, small

MAGIC = b"DBTK1\0"
LANES, STEPS = 16, 512
BLOCK = LANES * STEPS
#: A chunk closes when it has so many ids.
CHUNK_IDS = 1 << 19
SCALE = 20  # frequencies add up to 2^SCALE
_LOW = np.uint64(1 << 31)
_CACHE = 1_500_000  # pieces that a worker process keeps, about 110 MB and the bytes of long ones
_ALNUM = np.isin(np.arange(256), np.frombuffer((string.ascii_letters + string.digits).encode(), np.uint8))


# tokens of a text


@cache
def _tokenizer(path: str):
    import json

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
    added = spec.get("added_tokens", [])
    plain &= not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in added)
    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    # bytes of each id: a byte-level token has one character for a byte
    sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token)
    for t in added:
        sizes[t["id"]] = len(t["content"].encode())
    # a cut beside one of these parts no added token; an underscore continues a word, which some added tokens must be alone
    apart = set(string.punctuation.replace("_", "\n")) - set("".join(t["content"] for t in added))
    marks = np.isin(np.arange(256), [ord(c) for c in apart - {"\n"}])
    return tokenizer, plain, sizes, marks, "\n" in apart


class Encoder:
    """Ids of whole texts. Byte-level tokenizers cut a text before every single space that stands
    between other characters, around a single line feed there, and between a letter or digit and a
    mark, so there each distinct piece is encoded once and its ids are reused. Pieces are told apart
    by their bytes: short ones are two words with their size, longer ones a number. Beyond ``_CACHE``
    pieces, the half that was used least is forgotten."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.plain, self.sizes, self.marks, self.lines = _tokenizer(path)
        self.places = np.zeros((0, 2), np.uint64)  # the words of each piece
        self.long: dict[bytes, int] = {}
        self.slots = np.full(1024, -1, np.int32)  # places by hash; the next slot if one is taken
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.seed = np.uint64(int.from_bytes(os.urandom(8)))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, pieces: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and sizes of pieces that are cut from one another in any order: runs of them are encoded as one text."""
        flat: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        runs = [pieces[k : k + 512] for k in range(0, len(pieces), 512)]
        for run, ids in zip(runs, self._ids([b"".join(run).decode() for run in runs]), strict=True):
            reach = np.cumsum(self.sizes[ids])
            cuts = np.cumsum([len(p) for p in run])
            ends = np.searchsorted(reach, cuts)
            if len(reach) and reach[-1] == cuts[-1] and (reach[ends] == cuts).all():
                flat.append(ids), sizes.append(np.diff(ends, prepend=-1))
            else:
                found = self._ids([p.decode() for p in run])
                flat += found
                sizes.append(np.array([len(x) for x in found]))
        return flat, sizes

    def _learn(self, pieces: list[bytes], words: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """The places of new pieces."""
        alone = np.flatnonzero(~joined)
        flat, sizes = self._encode_joined([p for p, j in zip(pieces, joined.tolist(), strict=True) if j])
        found = self._ids([pieces[k].decode() for k in alone.tolist()])
        n = len(self.places)
        order = np.concatenate([np.flatnonzero(joined), alone])
        self.places = np.concatenate([self.places, words[order]])
        self.flat = np.concatenate([self.flat, *flat, *found])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([*sizes, np.array([len(x) for x in found], np.int64)]))])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int64)])
        self._fill(n)
        places = np.empty(len(pieces), np.int64)
        places[order] = n + np.arange(len(pieces))
        return places

    def _words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Two words of each piece, which no other piece has."""
        sizes = ends - starts
        words = tx.two_words(raw, starts, np.minimum(sizes, 15))
        words[:, 1] |= sizes.astype(np.uint64) << np.uint64(56)
        far = np.flatnonzero(sizes > 15)
        number = next(reversed(self.long.values()), -1) + 1
        for k, a, b in zip(far.tolist(), starts[far].tolist(), ends[far].tolist(), strict=True):
            at = self.long.setdefault(raw[a:b].tobytes(), number)
            number = max(number, at + 1)
            words[k, 0] = at
        words[far, 1] = np.uint64(255 << 56)
        return words

    def _home(self, words: np.ndarray) -> np.ndarray:
        return (tx.mix(words[:, 0] ^ tx.mix(words[:, 1] ^ self.seed)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _fill(self, n: int) -> None:
        """Slots for the places from ``n`` on."""
        if 2 * len(self.places) > len(self.slots):
            self.slots = np.full(2 << (2 * len(self.places)).bit_length(), -1, np.int32)
            n = 0
        rest, at = np.arange(n, len(self.places)), self._home(self.places[n:])
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            wait = self.slots[at] != rest
            rest, at = rest[wait], (at[wait] + 1) & (len(self.slots) - 1)

    def _find(self, words: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 for those that are not kept."""
        place = np.full(len(words), -1, np.int64)
        rest, at = np.arange(len(words) if len(self.places) else 0), self._home(words)
        while len(rest):
            found = self.slots[at]
            kept = self.places[found]  # the last place for an empty slot, which then is another piece
            same = (kept[:, 0] == words[:, 0]) & (kept[:, 1] == words[:, 1])
            place[rest[same]] = found[same]
            on = np.flatnonzero(~same & (found >= 0))
            rest, at, words = rest[on], (at[on] + 1) & (len(self.slots) - 1), words[on]
        return place

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin, and bytes that white space can't be before and after."""
        # neighbours that can't be white space: ASCII beyond the space, or a Latin letter of two bytes
        left = (raw > 0x20) & (raw < 0x7F)
        right = left | (raw == 0xC3)
        latin = np.zeros(len(raw), bool)
        latin[1:] = (raw[1:] >= 0x80) & (raw[:-1] == 0xC3)
        left |= latin
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            between = left[:-2] & right[2:]
            cut[1 : len(raw) - 1] = (raw[1:-1] == 0x20) & between
            if self.lines:
                lines = np.flatnonzero((raw[1:-1] == 0x0A) & between) + 1
                cut[lines] = cut[lines + 1] = True
        marks = np.flatnonzero(self.marks[raw[1:]] & left[:-1])
        last = raw[marks]
        marks = marks[_ALNUM[last] | (latin[marks] & (last != 0x97) & (last != 0xB7))]  # the signs of product and ratio are no letters
        cut[marks + 1] = True
        cut[offsets] = True
        return cut, left, right

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of rows, each row's first id)."""
        for at, raw, offsets in tx.slices(column):
            if not self.plain:
                texts = [t or "" for t in column.slice(at, len(offsets) - 1).to_pylist()]
                ids = self._ids(texts)
                yield at, np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
                continue
            cut, left, right = self._cuts(raw, offsets)
            starts = np.flatnonzero(cut[:-1])
            ends = np.append(starts[1:], len(raw))
            if len(self.places) > _CACHE:
                self._forget()
            words = self._words(raw, starts, ends)
            place = self._find(words)
            missing = np.flatnonzero(place < 0)
            if len(missing):
                missing = missing[np.lexsort(words[missing].T)]
                new = np.ones(len(missing), bool)
                new[1:] = (words[missing[1:]] != words[missing[:-1]]).any(1)
                one = missing[new]
                begin, end = starts[one], ends[one]
                joined = (raw[begin] == 0x20) & (end - begin > 1) & right[np.minimum(begin + 1, len(raw) - 1)] & left[end - 1]
                data = raw.tobytes()
                pieces = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                place[missing] = self._learn(pieces, words[one], joined)[np.cumsum(new) - 1]
            np.add.at(self.uses, place, 1)
            first = self.first[place]
            sizes = self.first[place + 1] - first
            begin = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.flat[np.arange(begin[-1]) + np.repeat(first - begin[:-1], sizes)]
            yield at, ids, begin[np.searchsorted(starts, offsets)]

    def _forget(self) -> None:
        """Keep the half of the pieces that were used most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.places) // 2])
        sizes = np.diff(self.first)[kept]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = self.flat[np.arange(begin[-1]) + np.repeat(self.first[kept] - begin[:-1], sizes)]
        self.places = self.places[kept]
        numbers = set(self.places[self.places[:, 1] == np.uint64(255 << 56), 0].tolist())
        self.long = {piece: k for piece, k in self.long.items() if k in numbers}
        self.first, self.uses = begin, self.uses[kept] // 2
        self.slots.fill(-1)
        self._fill(0)


@cache
def _encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer, so that the pieces outlive a task."""
    return Encoder(path)


def _encode(path: str, end_id: int, kind: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = _encoder(path), np.zeros(1, np.int64)
        for batch in batches:
            for at, ids, first in encoder.rows(batch.column(1)):
                if max(end_id, int(ids.max(initial=0))) >= vocabulary:
                    raise ValueError(f"the tokenizer has ids of {vocabulary} and more; pass a larger vocabulary")
                rows = len(first) - 1
                ends = first[1:] + np.arange(1, rows + 1)
                whole = np.zeros(len(ids) + rows, kind)
                is_end = np.zeros(len(whole), bool)
                is_end[ends - 1] = True
                whole[is_end] = end_id
                whole[~is_end] = ids
                seen = np.bincount(whole)
                if len(seen) > len(counts):
                    counts = np.pad(counts, (0, len(seen) - len(counts)))
                counts[: len(seen)] += seen
                width = whole.itemsize
                offsets = np.concatenate([[0], ends * width]).astype(np.int64)
                blobs = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).cast(pa.binary())
                empty = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), blobs, empty.cast(pa.int32()), empty], ["doc_id", "ids", "token", "n"])
        token = np.flatnonzero(counts)
        none = pa.nulls(len(token), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none.cast(pa.string()).cast(pa.binary()), pa.array(token.astype(np.int32)), pa.array(counts[token])], ["doc_id", "ids", "token", "n"])

    return run


# the coder


class Table:
    """Frequencies of ids, scaled to add up to 2^SCALE, at least 1 for each id that occurs."""

    def __init__(self, counts: np.ndarray) -> None:
        n = 1 << SCALE
        seen = np.flatnonzero(counts)
        if not len(seen):
            seen, counts = np.zeros(1, np.int64), np.ones(1, np.int64)
        if len(seen) > n:
            raise ValueError("more distinct ids than the scale can hold")
        share = counts[seen] / counts[seen].sum()
        freq = np.maximum(1, np.floor(share * n)).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        gap = n - int(freq.sum())
        while gap:  # the most frequent ids give or take the rest, in turn
            step = np.minimum(np.abs(gap), 1 + freq[order] // 64)
            if gap < 0:
                step = -np.minimum(step, freq[order] - 1)
            room = np.cumsum(np.abs(step))
            step[room > abs(gap)] = 0
            if not step.any():
                step[int(np.argmax(freq[order] > 1))] = 1 if gap > 0 else -1
            freq[order] += step
            gap = n - int(freq.sum())
        size = int(seen[-1]) + 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[seen] = freq
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.ids = np.repeat(np.arange(size), self.freq.astype(np.int64)).astype(np.uint32)
        self.usual = int(seen[order[0]])
        self.crc = zlib.crc32(self.freq.tobytes())

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype(np.uint32).tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64))


_HEAD = struct.Struct("<6sIQIII")


def pack(ids: np.ndarray, table: Table) -> bytes:
    """A chunk: head, then for each block its checkpoint (place, states) and checksum, then the words."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, table.usual, np.int64)
    padded[:n] = ids
    steps = padded.reshape(blocks, STEPS, LANES)
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words = np.zeros((STEPS, blocks, LANES), np.uint32)
    sent = np.zeros((STEPS, blocks, LANES), bool)
    limit = np.uint64(1 << (63 - SCALE))
    for t in range(STEPS - 1, -1, -1):
        symbol = steps[:, t]
        f, c = table.freq.take(symbol), table.start.take(symbol)
        full = state >= limit * f
        words[t], sent[t] = state.astype(np.uint32), full
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << np.uint64(SCALE)) + (state - q * f) + c
    order = sent.transpose(1, 0, 2)
    stream = words.transpose(1, 0, 2)[order]
    places = np.concatenate([[0], np.cumsum(order.reshape(blocks, BLOCK).sum(1))])[:blocks] if blocks else np.zeros(0, np.int64)
    sums = np.array([zlib.crc32(padded[k * BLOCK : min(n, (k + 1) * BLOCK)].astype("<u4").tobytes()) for k in range(blocks)], "<u4")
    body = places.astype("<u8").tobytes() + state.astype("<u8").tobytes() + sums.tobytes() + stream.astype("<u4").tobytes()
    return _HEAD.pack(MAGIC, table.crc, n, blocks, len(stream), zlib.crc32(body)) + body


def unpack(data: bytes, table: Table, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of the chunk, or of a run of its blocks; a wrong checksum is an error."""
    magic, crc, n, count, size, body_crc = _HEAD.unpack_from(data)
    if magic != MAGIC or crc != table.crc or zlib.crc32(data[_HEAD.size :]) != body_crc:
        raise ValueError("not a chunk of this table, or damaged")
    at = _HEAD.size
    places = np.frombuffer(data, "<u8", count, at).astype(np.int64)
    state = np.frombuffer(data, "<u8", count * LANES, at + 8 * count).reshape(count, LANES)
    sums = np.frombuffer(data, "<u4", count, at + 8 * count * (1 + LANES))
    stream = np.frombuffer(data, "<u4", size, at + 8 * count * (1 + LANES) + 4 * count).astype(np.uint64)
    which = np.arange(count)[blocks]
    at, state = places[which], state[which].astype(np.uint64)
    out = np.zeros((len(which), STEPS, LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(STEPS):
        slot = state & mask
        symbol = table.ids.take(slot.view(np.int64))
        out[:, t] = symbol
        symbol = symbol.astype(np.int64)
        state = table.freq.take(symbol) * (state >> np.uint64(SCALE)) + slot - table.start.take(symbol)
        need = state < _LOW
        read = np.cumsum(need, 1)
        low = np.flatnonzero(need)
        state.ravel()[low] = state.take(low) << np.uint64(32) | stream.take((read + (at[:, None] - 1)).take(low))
        at = at + read[:, -1]
    lengths = np.minimum(BLOCK, n - which * BLOCK)
    for k, length in enumerate(lengths):
        if zlib.crc32(out[k].reshape(-1)[:length].astype("<u4").tobytes()) != sums[which[k]]:
            raise ValueError(f"block {which[k]} is damaged")
    return np.concatenate([out[k].reshape(-1)[:length] for k, length in enumerate(lengths)]) if len(which) else np.zeros(0, np.uint32)


# files


_CHUNK = "part int, chunk int, doc_ids binary, missing binary, sizes binary, n long, payload binary"


def _pack_parts(table_bytes: bytes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(table_bytes)
        parts: list[tuple] = []
        have, chunk, part = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal parts, have, chunk
            ids = np.concatenate([x[2] for x in parts])
            docs = np.array([x[0] or 0 for x in parts], "<i8").tobytes()
            missing = np.array([x[0] is None for x in parts], np.uint8).tobytes()
            sizes = np.array([len(x[2]) for x in parts], "<u8").tobytes()
            row = [part, chunk, docs, missing, sizes, len(ids), pack(ids, table)]
            parts, have, chunk = [], 0, chunk + 1
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "chunk", "doc_ids", "missing", "sizes", "n", "payload"])

        for batch in batches:
            for doc_id, ids, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):  # noqa: B007
                parts.append((doc_id, part, np.frombuffer(ids.as_buffer(), kind)))
                have += len(parts[-1][2])
                if have >= CHUNK_IDS:
                    yield close()
        if parts:
            yield close()

    return run


def _unpack_parts(table_bytes: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(table_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                docs = np.frombuffer(batch.column(2)[k].as_py(), "<i8")
                missing = np.frombuffer(batch.column(3)[k].as_py(), np.uint8).astype(bool)
                sizes = np.frombuffer(batch.column(4)[k].as_py(), "<u8").astype(np.int64)
                ids = unpack(batch.column(5)[k].as_py(), table)
                first = np.concatenate([[0], np.cumsum(sizes)])
                data = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                same = lambda v, kind, m=len(docs): pa.array(np.full(m, v), kind)
                columns = [same(batch.column(0)[k].as_py(), pa.int32()), same(batch.column(1)[k].as_py(), pa.int32()), pa.array(docs, mask=missing), pa.array(first[:-1]), pa.array(sizes), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "doc_id", "at", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, vocabulary: int = 1 << 16) -> str:
    """Write the token files of ``docs`` (doc_id, text) under ``path`` and return the path.

    ``chunks`` holds the coded ids in ascending order of id (nulls first; rows that share an id by a hash
    of their ids), ``table`` the frequency table that every chunk refers to, with its checksum. The files
    need nothing else to be read. Without a path, a new one in the shared folder is taken. ``vocabulary``
    bounds the ids, larger ones are an error; the frequency table is all that returns to the driver.
    Null texts are empty: their document is the end id alone. Rows that repeat stay. An empty table has
    no chunks.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    arrow_rows(spark)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = keep(docs.mapInArrow(_encode(tokenizer_path, end_id, kind, vocabulary), "doc_id long, ids binary, token int, n long"), "ids")
    found = encoded.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[found.column("token").to_numpy()] = found.column("n").to_numpy()
    table = Table(counts)
    spark.createDataFrame([(bytearray(table.to_bytes()), table.crc)], "frequencies binary, crc32 long").write.parquet(f"{path}/table")
    parts = encoded.filter("token IS NULL").select("doc_id", "ids", F.xxhash64("ids").alias("h"))
    parts = parts.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "ids")
    parts = parts.select("doc_id", "ids", F.spark_partition_id().alias("part"))
    parts.mapInArrow(_pack_parts(table.to_bytes(), kind), _CHUNK).write.parquet(f"{path}/chunks")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files under ``path``."""
    stored = spark.read.parquet(f"{path}/table").first()
    table = bytes(stored.frequencies)
    if Table.from_bytes(table).crc != stored.crc32:
        raise ValueError("the frequency table is damaged")
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks")
    sizes = chunks.groupBy("part").agg(F.sum("n").alias("n"))
    parts = keep(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "parts")
    within = Window.partitionBy("part").orderBy("chunk")
    bases = chunks.select("part", "chunk", (F.sum("n").over(within) - F.col("n")).alias("inner"))
    bases = keep(bases.join(small(parts, parts.count()), "part").select("part", "chunk", (F.col("base") + F.col("inner")).alias("base")), "bases")
    arrow_rows(spark, 4)
    rows = keep(chunks.select("part", "chunk", "doc_ids", "missing", "sizes", "payload").mapInArrow(_unpack_parts(table), "part int, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long"), "decoded")
    arrow_rows(spark)
    return rows.join(small(bases, bases.count()), ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
