"""Fingerprints and classes against brute force over all pairs."""

from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from repoloom.llm.common import table
from repoloom.llm.components import components
from repoloom.llm.simhash import ball_links, drop_near_duplicates, simhash_classes

SF = "/root/testdata/sf0.001"


def plain_print(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(links, nodes) -> dict:
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return root


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {k: plain_print(t) for k, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = plain_classes(links, texts)
    got = simhash_classes(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    return got


def test_given_documents(spark):
    check(table(spark, SF, "documents"))


def test_odd_rows(make_docs, odd_texts):
    got = check(make_docs([*odd_texts, "One", "ONE", None]))
    assert {r.class_size for r in got if r.doc_id in (0, 1, 2, 12)} == {4}


def test_empty(make_docs):
    assert simhash_classes(make_docs(["x"]).where("false")).count() == 0


def test_ball_links(spark):
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) for c in centres for _ in range(30)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in ball_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    pairs = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert got <= pairs
    assert plain_classes(got, signed) == plain_classes(pairs, signed)
    assert len(got) <= 65 * len(prints)


def test_components(spark):
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(200, i) for i in range(201, 260)]
    noise = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    links = [*chain, *star, *noise, (7, 7)]
    nodes = {n for pair in links for n in pair}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_classes(links, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept_by_hand(rows) -> list:
    """(doc_id, text) of one row of each class, the least id; rows without an id stay."""
    named = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=repr)
    prints = [plain_print(t) for _, t in named]
    links = [(a, b) for b in range(len(named)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 2]
    classes: dict = {}
    for n, root in plain_classes(links, range(len(named))).items():
        classes.setdefault(root, []).append(named[n])
    kept = [row for held in classes.values() for row in held if row[0] == min(i for i, _ in held)]
    return sorted(kept + [(r.doc_id, r.text) for r in rows if r.doc_id is None], key=repr)


def test_one_row_of_each_class_stays(spark, make_docs, odd_texts):
    draw = random.Random(1)
    vocabulary = [f"word{i}" for i in range(900)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randrange(80, 500))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    texts += [t + " end" for t in texts[:20]] + texts[:5] + odd_texts
    docs = make_docs(texts)
    clash = make_docs(["one text", texts[0], texts[0], None], first=3)  # ids 3 to 6 a second time, with other texts
    nameless = make_docs(["one text", "one text"]).withColumn("doc_id", F.lit(None).cast("long"))
    every = docs.union(clash).union(docs.where("doc_id < 4")).union(nameless)
    kept = drop_near_duplicates(every)
    assert kept.columns == every.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == kept_by_hand(every.collect())
    assert len(got) < every.count() - 10
    assert drop_near_duplicates(docs.where("false")).count() == 0
