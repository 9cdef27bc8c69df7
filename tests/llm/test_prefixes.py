"""The prefix trie against a plain one in Python."""

from __future__ import annotations

import hashlib
import random
import zlib

from repoloom.llm.common import table
from repoloom.llm.prefixes import coded_turns, conversation_trie, node_texts, rebuilt_report, rebuilt_turns, trie_of

SF = "/root/testdata/sf0.001"
ROW = "conv_id long, turn long, role string, text string"


def plain_paths(rows) -> dict:
    held: dict = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        held.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return held


def rebuilt(held: dict) -> dict:
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = held.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(paths: dict) -> set:
    members: dict = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    children: dict = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out = set()

    def below(key) -> tuple[int, int]:
        leaves, saved = 0 if children.get(key) else 1, (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        for child in children.get(key, []):
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = sorted(c for c in members[key] if len(paths[c]) == len(key))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(children.get(key, [])), leaves, saved, digest, len(ends)))
        return leaves, saved

    if members:
        below(())
    return out


def rows_of(df) -> set:
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_conversations(spark):
    rows = table(spark, SF, "conversations")
    held = plain_paths([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(rebuilt_report(rows)) == plain_trie(rebuilt(held))
    assert rows_of(trie_of(rows)) == plain_trie(held)


def random_rows(seed: int, n: int = 60) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(400), n):
        length = draw.choice([1, 2, 3, 9, 12, 30])
        start = draw.choice(["a", "a", "b", None])
        rows += [(c, t if t else draw.choice([None, 0]), draw.choice(["user", None]) if t > 4 else "user",
                  start if t < 3 else draw.choice(["x", "yy", "", None, "ß语"])) for t in range(length)]
    return rows


def test_small_shards_and_blocks(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        df = spark.createDataFrame(rows, ROW)
        turns, convs = rebuilt_turns(coded_turns(df))
        got = rows_of(conversation_trie(turns, convs, shard=7, block=4))
        paths = rebuilt(plain_paths(rows))
        assert any(not p for p in paths.values()), "a turnless conversation"
        assert got == plain_trie(paths)


def test_one_common_conversation_and_a_long_one(spark):
    same = [(c, t, "user", f"t{t}") for c in range(0, 300) for t in range(3)]
    long = [(1000, t, "user", f"t{t}" if t < 150 else "end") for t in range(200)] + [(1001, t, "user", f"t{t}") for t in range(150)]
    rows = [*same, *long]
    got = rows_of(trie_of(spark.createDataFrame(rows, ROW)))
    paths = plain_paths(rows)
    assert got == plain_trie(paths)
    top = next(r for r in got if r[1] == 0)
    assert top[3] == 302 and top[5] == 1


def test_odd_tables(spark):
    empty = spark.createDataFrame([], ROW)
    assert trie_of(empty).count() == 0 and rebuilt_report(empty).count() == 0
    rows = [(None, 0, "user", "x"), (3, None, None, None), (3, None, None, None), (3, 1, "", ""), (4, 5, "r", "same"), (4, 5, "r", "same")]
    df = spark.createDataFrame([(*r, 1, "c", 9) for r in rows], ROW + ", pos long, conv string, shard long")
    assert rows_of(trie_of(df)) == plain_trie(plain_paths(rows))
    assert rows_of(rebuilt_report(df)) == plain_trie(rebuilt(plain_paths(rows)))
    tied = spark.createDataFrame([(1, 0, "user", t) for t in ("b", "a", "c")] + [(2, 0, "user", t) for t in ("c", "b", "a")], ROW)
    assert trie_of(tied).where("depth = 3").first().n_convs == 2
    long_text = spark.createDataFrame([(c, 0, "user", "word " * 200_000) for c in range(3)], ROW)
    assert trie_of(long_text).where("depth = 1").first().saved_tokens == 2_000_000
    ids = spark.createDataFrame([("b", 0, "user", "x"), ("a", 0, "user", "x")], "conv_id string, turn long, role string, text string")
    assert trie_of(ids).where("depth = 1").first().conv_id == "a"


def test_texts_of_nodes(spark):
    rows = random_rows(5, 20)
    df = spark.createDataFrame([r for r in rows if r[1] is not None], ROW)
    for r in node_texts(trie_of(df), df).collect():
        turns = sorted((t for t in rows if t[0] == r.conv_id and t[1] is not None), key=lambda t: t[1])
        assert r.depth == 0 or (r.role, r.text) == turns[r.depth - 1][2:]
