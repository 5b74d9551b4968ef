"""Snapshots against a plain comparison of all conversations."""

from __future__ import annotations

import random

from ebbline.llm import chat


def brute(rows):
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role is not None, role or "", text is not None, text or ""))
    lists = {c: tuple(t[1:] for t in sorted(ts)) for c, ts in convs.items()}
    out = {}
    for conv, turns in lists.items():
        same = [c for c, t in lists.items() if t == turns]
        if any(len(t) > len(turns) and t[: len(turns)] == turns for t in lists.values()):
            continue
        first = min((c for c in same if c is not None), default=None)
        show = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, _, x in turns)
        out[first] = (len(turns), len(same), show)
    return out


def result(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(df).collect()}


def test_equal_to_comparing_all(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(80):
        n = rng.randrange(1, 6)
        seed = rng.randrange(12)
        own = random.Random(seed)
        for turn in range(n):
            role, text = ("user", "assistant")[turn % 2], own.choice(["a", "b", None, ""])
            if rng.random() < 0.05:
                text = "odd"
            rows.append((conv, turn * 2, role, text))
    rows += [(None, 0, "user", "x"), (None, 1, None, "y"), (500, 0, "user", "x"), (600, 0, "user", "z"), (600, 0, "user", "z")]
    rng.shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_defined_results(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo <|im_end|>"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo <|im_end|>")]
    assert result(spark, rows) == {
        2: (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo < |im_end|><|im_end|>\n")
    }
    odd = spark.createDataFrame([(1, 0, "user", "hi", 9, 9)], "conv_id long, turn long, role string, text string, id long, k long")
    assert chat.format_chats(odd).columns == ["conv_id", "n_turns", "n_copies", "rendered"]
    assert chat.format_chats(odd.limit(0)).count() == 0
