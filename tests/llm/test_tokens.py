import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from duebook.llm import tokens
from hashes import thue_morse
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "\t ", "\x1c", " ", "　", "é", "ß à", "don't", "word", " the", "123", "!?", "\U0001f600", "日本", "<|endoftext|>", "x y", "\x7f"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)] + ["", None, "long " * 4000]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeéàZ7.,'", k=rng.randint(1, 9)))
    rows = texts() + [" ".join(word() for _ in range(600)) for _ in range(20)]
    want = [x.ids for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in rows], add_special_tokens=False)]
    monkeypatch.setattr(tokens, "_CACHE", 1500)  # pieces are forgotten and learnt again
    encoder = tokens.Encoder(PATH)
    for _ in range(2):
        for k in range(0, len(rows), 7):
            got = [ids[a:b].tolist() for _, ids, first in encoder.rows(pa.array(rows[k : k + 7])) for a, b in zip(first[:-1], first[1:])]
            assert got == want[k : k + 7]
    assert len(encoder.places) < 1500 + 7 * 600


def test_a_word_is_learnt_once_before_any_mark_or_line_end():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=12)) for _ in range(300)]
    encoder = tokens.Encoder(PATH)
    text = [" ".join(w + mark for w in words) for mark in ["", ",", ".", ";", "?!", ")", "'", ":\nx", "\nx"]]
    want = [x.ids for x in Tokenizer.from_file(PATH).encode_batch(text, add_special_tokens=False)]
    assert [ids[a:b].tolist() for _, ids, first in encoder.rows(pa.array(text)) for a, b in zip(first[:-1], first[1:])] == want
    assert len(encoder.places) < 300 + 20


def test_cuts_beside_marks_part_no_token(monkeypatch, tmp_path):
    spec = json.loads(Path(PATH).read_text(encoding="utf-8"))
    more = [("b,c", False), ("zqword", True), ("x\ny", False)]
    extra = [{"id": 50257 + k, "content": c, "single_word": w, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, (c, w) in enumerate(more)]
    own = tmp_path / "tokenizer.json"
    own.write_text(json.dumps(spec | {"added_tokens": spec["added_tokens"] + extra}), encoding="utf-8")
    rng = random.Random(6)
    bits = [" ", "\n", "\r", "\x00", "\t", *".,;:!?'\"_-()<|>/", "é", "ß", "×", "÷", "\xa0", "a", "b", "c", "x", "y", "7", "'s", "'ll", "zqword", "b,c", "x\ny", "<|endoftext|>", "日本", "е", "fourteen chars", "fifteencharsabc", "sixteencharsabcd", "seventeencharsabc"]
    rows = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(3000)]
    monkeypatch.setattr(tokens, "_CACHE", 700)
    for path in (PATH, str(own)):
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
        encoder = tokens.Encoder(path)
        for k in range(0, len(rows), 50):
            got = [ids[a:b].tolist() for _, ids, first in encoder.rows(pa.array(rows[k : k + 50])) for a, b in zip(first[:-1], first[1:])]
            assert got == want[k : k + 50]
        assert len(encoder.long) < len(encoder.places) < 700 + 50 * 60


def test_ids_beyond_the_vocabulary_are_an_error(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    with pytest.raises(Exception, match="larger vocabulary"):
        tokens.write_tokens(df, PATH, 2, vocabulary=16)


@pytest.mark.parametrize("n", [0, 1, 15, tokens.BLOCK, tokens.BLOCK + 1, 5 * tokens.BLOCK - 7])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000)
    table = tokens.Table(np.bincount(np.append(ids, 7), minlength=50_257))
    again = tokens.Table.from_bytes(table.to_bytes())
    assert again.crc == table.crc and int(table.freq.sum()) == 1 << tokens.SCALE
    data = tokens.pack(ids, table)
    assert tokens.unpack(data, again).tolist() == ids.tolist()
    if n > 3 * tokens.BLOCK:
        assert tokens.unpack(data, table, slice(2, 3)).tolist() == ids[2 * tokens.BLOCK : 3 * tokens.BLOCK].tolist()
        assert len(data) < 1.05 * n * 17 / 8
    if n:
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            tokens.unpack(bytes(broken), table)


def test_files_read_back(spark, monkeypatch):
    rows = [(i * 3 % 403, t, 0) for i, t in enumerate(texts())] + [(None, "no id", 0), (5, "twice", 0), (5, "twice", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    got = sorted(tokens.read_tokens(spark, tokens.write_tokens(df, PATH, 2)).collect(), key=lambda r: r.start)
    order = lambda r: (r is not None, r or 0)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=order)
    t, at, want = Tokenizer.from_file(PATH), 0, {}
    for i, text, _ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    again = tokens.read_tokens(spark, tokens.write_tokens(df.repartition(5), PATH, 2)).collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == [tuple(r) for r in got]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_tokens(spark, tokens.write_tokens(empty, PATH, 2)).count() == 0


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_under_polynomials(n):
    rows = [f"p q r s {w} t u v" for w in thue_morse(n)]
    encoder = tokens.Encoder(PATH)
    got = [ids[a:b].tolist() for _, ids, first in encoder.rows(pa.array(rows)) for a, b in zip(first[:-1], first[1:])]
    assert got == [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids for t in rows] and got[0] != got[1]
