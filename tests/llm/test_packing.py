"""Packing is an exact round trip; token counts equal a brute-force count."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repoloom.llm import packing, tokens
from repoloom.llm.packing import pack
from repoloom.llm.token_counts import token_counts
from repoloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def check_round_trip(rows, texts, reference):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = [*reference(text), 1]
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_seq)


def test_given_documents(spark, reference):
    docs = table(spark, SF, "documents")
    rows = pack(docs.repartition(5)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = check_round_trip(rows, texts, reference)
    total = sum(r.length for r in rows)
    assert total / (n * 2048) > 0.97


def test_odd_rows(make_docs, odd_texts, reference):
    docs = make_docs([*odd_texts, "before <|endoftext|> after", "double  blank \n x", " lead and trail "])
    rows = pack(docs).collect()
    check_round_trip(rows, {r.doc_id: r.text for r in docs.collect()}, reference)


def test_empty_and_repeated(make_docs, spark):
    docs = make_docs(["a b"])
    assert pack(docs.where("false")).count() == 0
    twice = pack(docs.union(docs)).collect()
    assert sum(r.length for r in twice) == 6 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    null_id = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert pack(null_id).first().doc_id is None


def test_merge_levels_are_bounded(make_docs, reference, monkeypatch):
    """Documents of which no two share a window: all are left over, and few go on from level to level."""
    monkeypatch.setattr(packing, "KEPT", 3)
    monkeypatch.setattr(packing, "MERGE", 4)
    docs = make_docs([" ".join(["word"] * (1250 + n % 50)) for n in range(60)]).repartition(20)
    read = []
    before = packing.stored
    monkeypatch.setattr(packing, "stored", lambda df: read.append(before(df)) or read[-1])
    rows = pack(docs).collect()
    check_round_trip(rows, {r.doc_id: r.text for r in docs.collect()}, reference)
    for level in read[1:]:
        held = level.where("level = 1").groupBy("grp").agg({"sequence_id": "approx_count_distinct"}).collect()
        assert all(r[1] <= 4 * 3 for r in held)


def test_windows_are_bounded():
    open_ = 0
    docs = ((i, b"\0\0\0\0" * (700 + 37 * i % 900)) for i in range(500))
    for left, *_ in packing.pack_stream(docs, 2048, 4):
        open_ += left
    assert 0 < open_ <= 4 * 3


def test_encoder_equals_reference(reference, odd_texts):
    encode = tokens.encoder()
    for text in [*odd_texts, "don't I'll we've", "x y z", "a \x1c b", "tab\t x"]:
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == reference(text)


def test_token_counts(make_docs, odd_texts, reference):
    docs = make_docs(odd_texts)
    lengths = [len(reference(t)) for t in odd_texts]
    got = {r.context_limit: r for r in token_counts(docs).collect()}
    assert set(got) == set(lengths)
    for limit, n in Counter(lengths).items():
        r = got[limit]
        assert (r.n_docs, r.docs_over, r.docs_total) == (n, sum(x > limit for x in lengths), len(lengths))
        assert r.tokens_truncated == sum(min(x, limit) for x in lengths) == r.tokens_total - r.tokens_lost
        assert r.quantile == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    assert token_counts(docs.where("false")).count() == 0
    assert token_counts(docs.withColumn("lang", docs.lang.cast("string")).withColumn("lang", docs.text)).count() > 5
