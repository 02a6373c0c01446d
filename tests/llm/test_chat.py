import hashlib
import random

from duebook.llm import chat

S = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|im_end|>", "\n", "<", "|", "\\", "%", "é\U0001f600", "ok ", "assistant\n", ""]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "%0A\n<|im_end|>", "", None]), rng.choice([None, "".join(rng.choices(bits, k=8))]), "x"))
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, S)).collect()}
    for conv in range(120):
        turns = [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: r[:2]) if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_machine_segments_and_ties(spark):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yo", ""), (2, 0, "assistant", "a", ""), (3, 0, "user", "q", ""), (4, 0, "system", "s", ""), (4, 1, "user", "b", ""), (4, 1, "user", "a", ""), (None, None, None, None, None)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, S)).collect()}
    assert [(got[k].valid, got[k].bad_turn) for k in (1, 2, 3, 4, None)] == [(True, None), (False, 0), (False, 1), (False, 2), (False, 0)]
    assert got[1].formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert [s.text for s in got[1].segments if s.loss] == ["yo"]
    assert [got[1].formatted[s.start - 1 :][: s.length] for s in got[1].loss_spans] == ["yo"]
    assert "user\na<|im_end|>\n<|im_start|>user\nb" in got[4].formatted
    assert chat.chat_digests(spark.createDataFrame([], S)).count() == 0
