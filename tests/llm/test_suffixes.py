"""Removed bytes against a brute-force table of all 200-byte strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from repoloom.llm import suffixes
from repoloom.llm.common import keyed, table
from repoloom.llm.suffixes import dedup_report, repeated_ranges, repeats, suffix_order

SF = "/root/testdata/sf0.001"


def plain(texts: dict) -> dict:
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(d[p:p + 200] for d in data.values() for p in range(len(d) - 199))
    out = {}
    for k, d in data.items():
        gone = np.zeros(len(d) + 1, np.int64)
        for p in range(len(d) - 199):
            if seen[d[p:p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(d, np.uint8)[~hit].tobytes()
        spans = int(((np.diff(np.concatenate(([0], hit.astype(int))))) == 1).sum())
        out[k] = (len(d), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(docs):
    got = {r.doc_id: tuple(r)[1:] for r in dedup_report(docs).collect()}
    assert got == plain({r.doc_id: r.text for r in docs.collect()})
    return got


@pytest.fixture(scope="module")
def passages():
    draw = random.Random(9)

    def prose(n):
        return "".join(draw.choice("abcdé \n") for _ in range(n))

    common = [prose(n) for n in (150, 199, 200, 201, 420, 3000)]
    texts = [prose(draw.randrange(900)) for _ in range(20)]
    for c in common:
        for _ in range(6):
            a = draw.randrange(len(c) // 2)
            texts.append(prose(draw.randrange(80)) + c[a:] + prose(draw.randrange(300)) + c[:a])
    return texts + [common[5], common[5], "a" * 1500, "ab" * 300, common[4] + common[4], None, "", "short"]


def test_given_documents(spark):
    got = check(table(spark, SF, "documents"))
    assert sum(r[1] for r in got.values()) > 1000


def test_passages(make_docs, passages):
    check(make_docs(passages))


def test_crowded_keys_and_small_blocks(spark, make_docs, passages, monkeypatch):
    docs = keyed(make_docs(passages))
    want = {}
    for r in repeated_ranges(docs).collect():
        want.setdefault(r.id, set()).update(range(r.a, r.b))
    for hot, block in ((2, 2000),):
        got = {}
        for r in repeated_ranges(docs, hot, block).collect():
            got.setdefault(r.id, set()).update(range(r.a, r.b))
        assert got == want


def test_finer_runs_keep_equal_windows_together():
    """At every depth equal windows have equal keys, runs cover all windows, and the last depth tells all contents apart."""
    draw = random.Random(3)
    base = bytes(draw.choice(b"abc") for _ in range(260))
    rows = [base, base[7:] + b"xyz" * 20, bytes(draw.choice(b"abc") for _ in range(30)) + base[:230], b"ab" * 120, b"z" * 230]
    data = np.frombuffer(b"".join(rows), np.uint8)
    begin = np.cumsum([0, *map(len, rows)])
    starts = np.concatenate([np.arange(a, b - 199) for a, b in zip(begin[:-1], begin[1:], strict=True)])
    fresh = np.isin(starts, begin)
    raw, last = data.tobytes(), 0
    for depth in (2, 4, 32, 64, 128):
        key, _, first, n, grams = suffixes.finer_runs(data, starts, fresh, depth)
        assert n.sum() == len(starts) and (np.diff(np.append(first, len(starts))) == n).all() and (grams >= 1).all()
        by = {}
        for k, at in zip(np.repeat(key, n).tolist(), starts.tolist(), strict=True):
            by.setdefault(raw[at:at + 200], set()).add(k)
        assert all(len(keys) == 1 for keys in by.values())
        names = len({next(iter(keys)) for keys in by.values()})
        assert names >= last
        last = names
    assert last == len({raw[at:at + 200] for at in starts.tolist()})


def test_pieces_of_long_documents(make_docs, passages, monkeypatch):
    monkeypatch.setattr(suffixes, "BUFFER", 700)
    rows = [(i, p or "") for i, p in enumerate(passages)]
    seen = set()
    for data, valid, places in suffixes._buffers(iter(rows)):
        begins = [p for p, _, _ in places]
        for at in np.flatnonzero(valid):
            of = np.searchsorted(begins, at, "right") - 1
            start, key, shift = places[of]
            whole = rows[key][1].encode()
            assert data[at:at + 200].tobytes() == whole[at - start + shift:at - start + shift + 200]
            assert (key, at - start + shift) not in seen
            seen.add((key, at - start + shift))
    assert len(seen) == sum(max(0, len(t.encode()) - 199) for _, t in rows)


def test_empty_and_repeated(make_docs, passages):
    docs = make_docs(passages[:3])
    assert dedup_report(docs.where("false")).count() == 0
    twice = dedup_report(docs.union(docs)).collect()
    assert len(twice) == 6 and all(r.n_removed == (r.n_bytes if r.n_bytes >= 200 else 0) for r in twice)


def test_intervals_equal_sorted_suffixes():
    draw = random.Random(4)
    for n, length in ((1, 3), (60, 5), (400, 9), (900, 20), (900, 12)):
        base = bytes(draw.choice(b"ab") for _ in range(n // 2 + 1))
        text = np.frombuffer(base + b"\xff" + base[: n // 2] + b"\xfe", np.uint8)
        raw = text.tobytes() * 2
        order = suffix_order(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: raw[i:i + len(text)])
        rows, group = repeats(text, length)
        heads = [raw[i:i + length] for i in rows]
        assert [a == b for a, b in zip(heads, heads[1:])] == [a == b for a, b in zip(group, group[1:])]


def test_ids_with_several_texts(spark, make_docs, passages):
    """Rows of one id with other texts are documents of their own; copies of a row go as before."""
    rows = [(n % 4, t) for n, t in enumerate(passages)] + [(None, passages[27]), (None, "unlike " * 60), (1, passages[30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(dict(enumerate(t for _, t in rows)))
    got = sorted((tuple(r) for r in dedup_report(docs).collect()), key=repr)
    assert got == sorted(((rows[n][0], *w) for n, w in want.items()), key=repr)
    lone = spark.createDataFrame([(1, passages[27]), (1, "other text " * 40), (2, passages[27])], "doc_id long, text string")
    removed = {r.n_bytes: r.n_removed for r in dedup_report(lone).collect() if r.doc_id == 1}
    other = len("other text " * 40)
    assert removed[other] == plain({0: "other text " * 40})[0][1]


def test_copies_of_two_documents():
    """A region of two documents counts, whichever way their ids are written."""
    for low, high in ((9, 10), (-5, 3), (-10, -9), ("9", "a")):
        assert suffixes.repeated_windows([bytes(range(240))], [2], 200, [low], [high])[0].all()
    assert not suffixes.repeated_windows([bytes(range(240))], [2], 200, [7], [7])[0].any()
