"""Best-fit packing is an exact round trip, cuts only long documents and comes near the least number of sequences."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repoloom.llm.bestfit import Bins, pack_best_fit, pack_stream
from repoloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def check(rows, texts, reference, length=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids, at = [*reference(text), 2], 0
        held = sorted(by_doc[key], key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(len(held))) and len(held) == -(-len(ids) // length)
        for r in held:
            assert r.start == at and r.length > 0 and (r.piece == 0 or r.length == length)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_seq)


def test_given_documents(spark, reference):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack_best_fit(docs.repartition(5)).collect()
    n = check(rows, texts, reference)
    assert n <= 1.02 * (sum(r.length for r in rows) / 1024) + 1


def test_odd_rows(make_docs, odd_texts, reference, spark):
    docs = make_docs([*odd_texts, "before <|endoftext|> after", " lead and trail "])
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(pack_best_fit(docs).collect(), texts, reference) > 1
    check(pack_best_fit(docs, length=8).collect(), texts, reference, 8)
    assert pack_best_fit(docs.where("false")).count() == 0
    twice = pack_best_fit(docs.union(docs).where("doc_id = 3")).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == 2
    assert pack_best_fit(spark.createDataFrame([(None, "x")], "doc_id long, text string")).first().doc_id is None
    for kind in ("int", "string"):
        assert pack_best_fit(docs.withColumn("doc_id", F.col("doc_id").cast(kind))).dtypes[0] == ("doc_id", kind)


def test_every_level_keeps_a_bounded_number_of_bins(make_docs, reference):
    draw = random.Random(2)
    docs = make_docs([" ".join(["word"] * draw.choice([5, 6, 9])) for _ in range(400)]).repartition(70)
    rows = pack_best_fit(docs, length=16, bins=4).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()}, reference, 16)
    assert n <= 1.3 * sum(r.length for r in rows) / 16


def plain_best_fit(sizes: list[int], length: int, most: int) -> list[list[int]]:
    """Bins as plain lists: fullest with room, else a new one, for which the fullest closes."""
    open_, closed = [], []
    for size in sizes:
        fit = [b for b in open_ if sum(b) + size <= length]
        if fit:
            one = max(fit, key=sum)
        else:
            if len(open_) == most:
                fullest = max(open_, key=sum)
                open_.remove(fullest)
                closed.append(fullest)
            one = []
            open_.append(one)
        one.append(size)
        if sum(one) == length:
            open_.remove(one)
            closed.append(one)
    return closed + open_


def test_bins_against_a_plain_version():
    draw = random.Random(9)
    for most in (1, 3, 40):
        sizes = [draw.choice([1, 30, 100]) if draw.random() < 0.3 else draw.randrange(1, 101) for _ in range(600)]
        held = defaultdict(list)
        for _, name, _, piece in pack_stream(((i, 0, 0, s, 0) for i, s in enumerate(sizes)), 100, most):
            held[name].append(piece[3])
        want = plain_best_fit(sizes, 100, most)
        assert sum(map(sum, held.values())) == sum(sizes) and max(map(sum, held.values())) <= 100
        assert abs(len(held) - len(want)) <= 0.02 * len(want)


def test_bins_are_bounded():
    bins = Bins(1024, 8)
    for i in range(3000):
        list(bins.place(1 + i * 37 % 1024, (i,)))
        assert bins.open <= 8
