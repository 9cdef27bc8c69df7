"""Translated patterns against RE2, as DuckDB runs it."""

from __future__ import annotations

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from repoloom.functions.regexes import re2_to_java, required_literals

PATTERNS = [
    r"foo$", r"^$", r"^foo", r"\bx", r"x\b", r"\Bx", r"\bfoo\b", r"(?i)é", r"(?i)K", r"\s", r"\S+", r"[\s]x", r"[^\s]", r"[^\S]x", r"[[:alpha:]]+\d",
    r"[[:^digit:]]x", r"[[:space:]]", r"[[:word:]]-", r"a{2,3}", r"a{", r"a{,2}", r"x{1}?", r"[]a]", r"[^]a]", r"[a&&b]", r"[a[b]", r"\Qa.b\E", r"\x41", r"\x{e9}",
    r"(?P<n>fo)o", r"(?:a|b)+c", r"(?i:FOO)bar", r"(?s)a.b", r"a.b", r"\pL\d", r"\p{Greek}", r"\P{L}x", r"\d+|\w+", r"a|", r"\.", r"\-", r"[\-a]", r"[a\]]", r"\101",
    r"(|a)b", r"\b(the|les?)\b", r"(a|b-)\b", r"x(?:|a)\b", r"\b[a]", r"\w\b", r"s?\b-", r"(?-s)a.b", r"\v", r"#", r" a", r"\z", r"\A\w", r"[[:punct:]]a", r"(?i)ſ",
]
LINES = [
    "", "foo", "foo\r", " foo bar", "xfoo", "foox", "éx", "xé", "É", "é", "\x0b", "\t", "a b", "aab", "aaab", "a{", "a{,2}", "]", "a]b", "a&b", "[b", "a.b", "axb", "A", "K", "\u212a",
    "αβγ 1", "1x", "-x", "a-b", "x-y_z", "the end", "lethe", "le", "b-", "!a", "A1", "#x", "\u017f", "s", "a\\b", "x a", "b-a", "word-", "ab", "xa",
]
REFUSED = [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(a)\1", "a**", "a*+", "*a", "a{1001}", "a{3,2}", "[a", "(a", "a)", r"\Z", r"(?U)a", r"\8", r"[[:nope:]]", r"\i"]


def test_matches_like_re2(spark):
    con = duckdb.connect()
    df = spark.createDataFrame([(i, l) for i, l in enumerate(LINES)], "i int, l string").coalesce(1)
    got = df.select("i", *[F.col("l").rlike(re2_to_java(p)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).collect()
    wrong = []
    for row, (k, p) in itertools.product(got, enumerate(PATTERNS)):
        want = con.execute("select regexp_matches(?, ?)", [LINES[row.i], "(?m)" + p]).fetchone()[0]
        if row[f"p{k}"] != want:
            wrong.append((p, LINES[row.i], want))
    assert not wrong


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(ValueError):
        re2_to_java(pattern)


def test_anchors_around_newlines(spark):
    """Line anchors in a text of several lines, its end included."""
    cases = [("a\n", r"^$", True), ("a\nb", r"a$", True), ("a\nb", r"^b", True), ("a\r\nb", r"a$", False), ("a\nb", r"(?-m)a$", False), ("a\n", r"(?-m)a$", False)]
    one = spark.createDataFrame([(0,)], "x int")
    got = one.select(*[F.lit(t).rlike(re2_to_java(p)) for t, p, _ in cases]).first()
    assert list(got) == [w for _, _, w in cases]


@pytest.mark.parametrize(("pattern", "literals"), [
    ("needle", [b"needle"]), ("ab", None), ("Need(le)?", [b"need"]), (r"\w+tion\b", [b"tion"]), ("foo|barn", [b"foo", b"barn"]), ("foo|b", None),
    ("(foo|bar)x", [b"foo", b"bar"]), ("(foo|bar)*x", None), ("abcd?e", [b"abc"]), ("abc+de", [b"abc"]), ("abc{0,2}xyz", [b"xyz"]), ("a.bcd", [b"bcd"]),
    (r"a\.b\.c", [b"a.b.c"]), ("(?i)ask THE", [b" the"]), ("(?i)été", None), ("é\u0301t", ["é\u0301t".encode()]), (r"\Qa.b\Ecdef", [b"cdef"]), ("[abc]def[^]]", [b"def"]),
    (r"\x41BCD", [b"bcd"]), ("((one|three)four|five)", [b"four", b"five"]), ("^$", None), ("", None)])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals
