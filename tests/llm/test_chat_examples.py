"""op1 reads its rows back from examples that are written out with their contexts."""

import hashlib

import pytest

from nestra.llm import chat

ROWS = [
    (1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "a<"), (1, 2, "user", "<|turn|>user<|text|>no<|end|>"), (1, 3, "assistant", ""), (1, 4, "user", "more"), (1, 5, "user", "still"),
    (2, 0, "user", "alone"), (None, 0, "assistant", "x"), (3, 0, "assistant", "p"), (3, 1, "assistant", "q"),
]


def test_last_turns_without_reply_are_written(spark):
    expanded = chat.expand(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    rows = chat.examples(expanded, rest=True).collect()
    assert sorted((r["conv_id"] or 0, r["example"] if r["example"] is not None else 9) for r in rows) == [(0, 0), (1, 0), (1, 1), (1, 9), (2, 9), (3, 0), (3, 1)]
    whole = {r["conv_id"]: r["text"] for r in rows if r["example"] is None}
    assert whole[1].count(chat.TURN) == 6 and all(whole[1].startswith(r["text"]) for r in rows if r["conv_id"] == 1)


def test_digest_reads_what_examples_write(spark, monkeypatch):
    expanded = chat.expand(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digest(expanded).collect()}
    for conv in (1, 2, 3, None):
        own = [(r, t) for c, _, r, t in ROWS if c == conv]
        replies = "".join(t for r, t in own if r == "assistant")
        want = len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest()
        assert tuple(got[conv])[1:5] == want
    whole = chat.examples
    monkeypatch.setattr(chat, "examples", lambda e, **k: whole(e, most_chars=60, **k))  # contexts that lose turns are noticed
    with pytest.raises(Exception, match="a context is not the text before it"):
        chat.digest(expanded).collect()
