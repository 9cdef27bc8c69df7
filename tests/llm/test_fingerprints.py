"""Sketches against Python's hashing; likeness against exact sets; the next document across buckets."""

from __future__ import annotations

import hashlib
import re
import struct

import pytest
import xxhash

from repoloom.llm import fingerprints
from repoloom.llm.common import table
from repoloom.llm.fingerprints import K, containment, distinct_shingles, edited_report, merged, resemblance, with_next, with_sketch

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingles(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^ \t\n\x0b\f\r]+", (text or "").lower())]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i:i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", w), h)
        out.add(signed(h))
    return out


def likeness(a, b):
    union = sorted(a | b)[:K]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def check(docs):
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(rows)
    got = {r.doc_id: r for r in edited_report(docs).collect()}
    assert len(got) == len(rows)
    for i, key in enumerate(ids):
        text, after = rows[key], rows[ids[(i + 1) % len(ids)]]
        n = len(text)
        edited = text[:n - n // 2] + after[:n // 2]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for name, t in (("fingerprint", text), ("edited_fingerprint", edited)):
            assert r[name] == "".join(f"{x % (1 << 64):016x}" for x in sorted(shingles(t))[:K])
        assert r.near_edited == pytest.approx(likeness(shingles(text), shingles(edited)))
        assert r.near_next == pytest.approx(likeness(shingles(text), shingles(after)))
    return got


def test_given_documents(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 7)
    docs = table(spark, SF, "documents").where("doc_id % 3 <> 1")
    got = check(docs)
    exact = {r.doc_id: shingles(r.text) for r in docs.collect()}
    off = [abs(r.n_shingles - len(exact[k])) / max(1, len(exact[k])) for k, r in got.items()]
    assert max(off) < 0.5 and sum(off) / len(off) < 0.08


def test_odd_rows(make_docs, odd_texts):
    check(make_docs(odd_texts, first=-4))


def test_one_row_none_and_repeated(make_docs, spark):
    assert check(make_docs(["only one"]))[0].near_next == 1.0
    docs = make_docs(["a", "b"])
    assert edited_report(docs.where("false")).count() == 0
    assert edited_report(docs.union(docs)).count() == 4
    nulls = spark.createDataFrame([(None, "x"), (5, "y")], "doc_id long, text string")
    assert {r.id: r.next_text for r in with_next(nulls).collect()} == {None: "y", 5: "x"}


def test_merged_sketches(make_docs, spark):
    texts = [" ".join(f"t{i}" for i in range(a, a + 300)) for a in (0, 100, 200, 5000)]
    sketches = with_sketch(make_docs(texts), "text", "sketch")
    union = shingles(texts[0]) | shingles(texts[1]) | shingles(texts[2]) | shingles(texts[3])
    row = merged(sketches, ["lang"]).first()
    assert row.sketch == sorted(union)[:K]
    pair = with_sketch(with_sketch(spark.createDataFrame([(texts[0], texts[0] + " " + texts[3])], "a string, b string"), "a", "sa"), "b", "sb")
    got = pair.select(resemblance("sa", "sb").alias("r"), containment("sa", "sb").alias("c"), distinct_shingles("sb").alias("d")).first()
    assert got.r == pytest.approx(0.5, abs=0.12) and got.c == pytest.approx(1, abs=0.15) and got.d == pytest.approx(596, rel=0.25)
