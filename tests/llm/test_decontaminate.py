"""Matches against brute force over all windows, and the SQL of the query."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from repoloom.llm.decontaminate import contamination_report, decontaminate, find_contamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    found, hit, mine = words(text), set(), set()
    for key, item in items.items():
        its = words(item)
        size = min(10, len(its))
        for window in {tuple(its[p:p + size]) for p in range(len(its) - size + 1)} if its else ():
            for p in range(len(found) - size + 1):
                if tuple(found[p:p + size]) == window:
                    hit |= set(range(p, p + size))
                    mine.add(str(key))
    return len(found), len(hit), len(mine), hashlib.sha256(",".join(sorted(mine)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def case():
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "ß9"]
    items = {i: " ".join(draw.choice(vocabulary) for _ in range(draw.choice([3, 9, 10, 11, 40]))) for i in range(30)}
    items |= {30: None, 31: "", 32: "...", 33: items[0], 34: items[5] + " " + items[6]}
    texts = [None, "", "-- !"]
    for _ in range(60):
        parts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(60)))]
        for _ in range(draw.randrange(3)):
            part = (items[draw.randrange(30)] or "").upper().split(" ")
            at = draw.randrange(len(part))
            parts += [draw.choice([", ", "\n"]).join(part[at:at + draw.randrange(30)]), "odd"]
        texts.append(" ".join(parts))
    return items, texts + texts[-2:]


@pytest.mark.parametrize("share", [200_000, 60])
def test_report(spark, make_docs, case, share):
    items, texts = case
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in contamination_report(make_docs(texts), bench, automaton_words=share).collect()}
    assert got == {i: plain(t, items) for i, t in enumerate(texts)}


def test_long_item_is_cut(spark, make_docs, monkeypatch):
    from repoloom.llm import decontaminate as module

    monkeypatch.setattr(module, "SEGMENT_WORDS", 25)
    long = " ".join(f"a{i}" for i in range(200))
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    row = contamination_report(make_docs([long]), bench, automaton_words=40).first()
    assert (row.n_hit, row.n_items) == (200, 1)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination_report(make_docs(["a b"]), none).first().n_hit == 0
    assert find_contamination(make_docs(["a"]).where("false"), none).count() == 0


def test_spans_are_cut_out(spark, make_docs):
    passage = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rest = " ".join(f"free{i}" for i in range(30))
    docs = make_docs([f"Before, ({passage.upper()}) after. {rest}", passage, rest, None, f"{passage} {rest} {passage}!"])
    got = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    assert set(got) == {0, 2, 3, 4}
    assert got[0].text == f"Before, () after. {rest}" and got[0].n_chars == len(got[0].text)
    assert got[2].text == rest and got[3].text is None
    assert got[4].text == f" {rest} !"
    assert decontaminate(docs, bench).columns == docs.columns
