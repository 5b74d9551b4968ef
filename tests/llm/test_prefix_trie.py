"""The trie against a plain one over all conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

from ebbline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, borrow=True):
    convs: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [v[2:] for v in sorted(vs)] for c, vs in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = convs.get(base, [])[:h] + own[h:]
    nodes: dict = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    parents = {p[:-1] for p in nodes if p}
    out = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(path))))
        out.append(
            (
                min(members),
                len(path),
                min(nodes[path[:-1]]) if path else None,
                len(members),
                sum(len(q) == len(path) + 1 for q in below),
                sum(q not in parents for q in below),
                sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, prefix_trie.prefix_trie(df, **more).collect()), key=str)


def drawn(rng, convs, most):
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, most)):
            text = rng.choice(["a", "a", "bé", "", None, "𝄞 long"])
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "user", None, ""]), text))
    rng.shuffle(rows)
    return rows


def test_equal_to_brute_force(spark):
    rng = random.Random(11)
    rows = drawn(rng, [*range(0, 130), *range(-40, -1, 3), 700, 705, 10**12 + 1], 9)
    rows += [(None, 0, "user", "x")] + [r for r in rows if r[0] == 5]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, borrow=False) == brute(rows, False)


def test_shards_and_bands_of_any_size_agree(spark):
    rng = random.Random(5)
    rows = drawn(rng, range(40), 6)
    long = [(turn, "user", rng.choice("ab")) for turn in range(60)]
    for conv, n in ((50, 60), (51, 60), (52, 33), (53, 60)):
        rows += [(conv, *t) for t in long[:n]]
    rows += [(53, 70, "user", "end")]
    want = brute(rows, False)
    for shard, band in ((7, 8), (2, 4), (512, 256)):
        assert result(spark, rows, borrow=False, shard=shard, band=band) == want


def test_large_group_of_copies_and_common_first_turn(spark):
    rows = [(c, t, "user", x) for c in range(1300) for t, x in enumerate(["hi", "you", "end" if c % 2 else "stop"])]
    assert result(spark, rows) == brute(rows)


def test_turnless_conversations_and_empty_table(spark):
    # without a conversation to borrow from, a short one has no turn left
    rows = [(c, 0, "user", "x") for c in range(101, 130)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert next(r for r in got if r[1] == 0)[7] != hashlib.sha256(b"").hexdigest()
    odd = spark.createDataFrame([(1, 0, "u", "t", 1, 2)], SCHEMA + ", n long, depth long")
    assert prefix_trie.prefix_trie(odd).count() == len(brute([(1, 0, "u", "t")]))
    assert prefix_trie.prefix_trie(odd.limit(0)).count() == 0


def test_long_texts(spark):
    rows = [(c, t, "user", "é" * 1_000_000 + str(t)) for c in (0, 100, 200) for t in range(7)]
    assert result(spark, rows, borrow=False) == brute(rows, False)
