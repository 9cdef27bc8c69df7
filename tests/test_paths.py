"""Path matching, filters, names, handles and labels."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from repoloom.functions import language, paths, text
from repoloom.functions.regexes import path_to_java

PATHS = ["lib/io/read.rs", "lib/io/mod/x1.rs", "library/io.rs", "notes", "notes/2024/jan.md", "web/app[1].ts", "q+z.h", "a/b/c/d/e.txt", "test/foo.py", "testfoo", "x/y", "xzy"]
PATTERNS = ["lib", "lib/", "lib/io/read.rs", "notes", "notes/2024", "*.rs", "*.md", "lib/*", "lib/**", "**/x1.rs", "lib/**/x1.rs", "a/*/c/**", "a/**/e.txt",
            "?otes", "x?.rs", "[l-n]*", "[^l]*", "q+z.h", "test**", "x[^a]y", "a**b", "**", "web/app[1].ts", "*[0-9].rs", "", "nope/**"]


def plain_match(path: str, pattern: str) -> bool:
    """Path patterns by walking both strings; a literal is a path or a folder above it."""
    if not pattern:
        return False
    if not set(pattern) & set("*?["):
        base = pattern.removesuffix("/")
        return path == base or path.startswith(base + "/")

    def walk(p: int, t: int) -> bool:
        if p == len(pattern):
            return t == len(text)
        if pattern.startswith("**/", p):
            return walk(p + 3, t) or any(text[i] == "/" and walk(p + 3, i + 1) for i in range(t, len(text)))
        if pattern.startswith("**", p):
            return any(walk(p + 2, i) for i in range(t, len(text) + 1))
        if pattern[p] == "*":
            return any("/" not in text[t:i] and walk(p + 1, i) for i in range(t, len(text) + 1))
        if t == len(text):
            return False
        if pattern[p] == "?":
            return text[t] != "/" and walk(p + 1, t + 1)
        if pattern[p] == "[":
            end = pattern.index("]", p + 1)
            body = pattern[p + 1:end].removeprefix("^")
            fits = any(lo <= text[t] <= hi for lo, hi in re.findall("(.)-(.)", body)) or text[t] in re.sub(".-.", "", body)
            return fits != (pattern[p + 1] == "^") and walk(end + 1, t + 1)
        return pattern[p] == text[t] and walk(p + 1, t + 1)

    text = path if "/" in pattern else path.rsplit("/", 1)[-1]
    return walk(0, 0)


MATCHES = [(path, pattern, plain_match(path, pattern)) for path in PATHS for pattern in PATTERNS]


def column_of(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_match_path(spark):
    one = spark.createDataFrame([(0,)], "x int")
    got = one.select(*[paths.match_path(F.lit(p), g).alias(str(i)) for i, (p, g, _) in enumerate(MATCHES)]).first()
    assert list(got) == [want for _, _, want in MATCHES]


def test_path_patterns_as_one_regex(spark):
    """The form used for requests agrees with the column form."""
    one = spark.createDataFrame([(0,)], "x int")
    cols = [F.lit(False) if path_to_java(g) is None else F.lit(p).rlike(path_to_java(g)) for p, g, _ in MATCHES]
    assert list(one.select(*cols).first()) == [want for _, _, want in MATCHES]


def test_prefix_column_form(spark):
    rows = [(p, g) for p, g, _ in MATCHES if not set(g) & set("*?[")]
    want = [w for _, g, w in MATCHES if not set(g) & set("*?[")]
    assert column_of(spark, rows, "p string, g string", paths.match_prefix("p", F.col("g"))) == want


def test_what_is_excluded_stays_out(spark):
    one = spark.createDataFrame([(0,)], "x int")
    keep = [paths.path_filter(F.lit("etc/conf/site.toml"), inc, exc) for inc, exc in ((["etc"], ["etc/conf"]), ([], []), ([""], []), (["usr", "etc/conf"], ["etc/conf/old"]))]
    assert list(one.select(*keep).first()) == [False, True, False, True]


def test_repo_names(spark):
    """One path segment that is neither a dot name, empty, nor a handle."""
    good = [a + b for a in ("loom", "9to5", "Ünit", ".x", "_") for b in ("", "-two", ".rs", "_3")]
    bad = [*(f"{g}{mark}{g}" for g in good[:3] for mark in "/\\\x00@"), "", *("." * n for n in (1, 2)), "/lead", "trail/", "up/../down"]
    got = column_of(spark, [(n,) for n in good + bad], "n string", paths.repo_name_problem("n"))
    assert got[: len(good)] == [None] * len(good)
    assert all(got[len(good):])


def test_ref_names(spark):
    """The rules of git's check-ref-format, and names that already mean something."""
    good = ["trunk", "rel/2024.06", "topic/wide_weave", "0f" * 20, "x@y", "é/ü", "n-1"]
    bad = [f"left{mark}right" for mark in (" ", "\t", "\x00", "\\", "~", "^", ":", "?", "*", "[", "..", "//", "@{", "/./", "/../")]
    bad += [f"{mark}name" for mark in ("-", "/", "refs/tags/", "upstream/../")] + ["name/", "", "@", "HEAD", ".."]
    got = column_of(spark, [(n,) for n in good + bad], "n string", paths.ref_name_problem("n"))
    assert got[: len(good)] == [None] * len(good)
    assert all(got[len(good):])


def test_names_from_urls(spark):
    forms = ["ssh://host.test:22/team/{}", "https://host.test/{}.git", "me@host.test:team/{}.git", "file:///srv/git/{}/", "../{}"]
    cases = [(form.format(name), name) for form in forms for name in ("loom", "weft-2", "a.b")] + [("https://host.test/..", ""), ("//", "")]
    assert column_of(spark, [(u,) for u, _ in cases], "u string", paths.name_from_url("u")) == [n for _, n in cases]


def test_handles_round_trip(spark):
    cases = [(repo + (f"@{ref}" if ref else ""), repo, ref) for repo in ("loom", "weft-2") for ref in ("", "r7", "rel/2024.06", "x@y")]
    df = spark.createDataFrame([(c[0],) for c in cases], "id string")
    rows = df.select("id", paths.id_repo("id").alias("repo"), paths.id_ref("id").alias("ref")).withColumn(
        "again", paths.checkout_id("repo", "ref")).withColumn("dir", paths.checkout_dir("repo", "ref")).collect()
    assert [(r.id, r.repo, r.ref) for r in rows] == cases
    assert all(r.again == r.id for r in rows if r.ref)
    assert rows[2].dir == "loom@rel-2024.06"


@pytest.mark.parametrize("path, bad", [
    (".git/objects/00", True), ("docs/up/../../.git", True), (".gitignore", False), ("/srv/data", True), ("docs/../../out", True),
    ("docs/./../notes", False), ("vendor/.git", False), ("docs//page", False), ("", False), (".git", True),
])
def test_safe_paths(spark, path, bad):
    got = spark.createDataFrame([(path,)], "p string").select(paths.path_problem("p")).first()[0]
    assert (got is not None) == bad


def test_languages(spark):
    cases = [
        ("a/b.go", "Go"), ("x.PY", "Python"), ("Makefile", "Make"), ("dir/Dockerfile", "Dockerfile"), ("noext", ""), ("weird.zzz", ""),
        ("build.gradle.kts", "Gradle (Kotlin DSL)"), ("makefile", ""), (".md", "Markdown"), ("a.", ""), ("dir.go/file", ""),
    ]
    assert column_of(spark, [(p,) for p, _ in cases], "p string", language.detect_language("p")) == [l for _, l in cases]


def test_first_line(spark):
    cases = [("weave\r\nmore", "weave"), ("\t indent \u00a0\u2003", "indent"), ("\nlater", ""), ("", ""), ("one two", "one two")]
    assert column_of(spark, [(t,) for t, _ in cases], "t string", text.first_line("t")) == [w for _, w in cases]


def test_small_text_helpers(spark):
    assert text.split_list(["weft,warp ", ",", "loom,,"]) == ["loom", "warp", "weft"]
    assert [text.name_pattern(p) for p in ["", "Loom", "weave*", "w?b", "warp_end", "9%"]] == ["", "%Loom%", "weave%", "w_b", "warp_end", "9%"]
    rows = [("UserRepository", "%repo%", True), ("École", "éc%", False), ("a\\b", "a\\_", True), ("abc", "a_c", True), ("abc", "b", False), ("x", "%", True)]
    got = column_of(spark, [(a, b) for a, b, _ in rows], "a string, b string", text.like_ascii_ci("a", F.col("b")))
    assert got == [w for _, _, w in rows]
    patterns = column_of(spark, [("Repo",), ("g*",), ("a_b",), ("",)], "p string", text.name_pattern_col("p"))
    assert patterns == ["%Repo%", "g%", "a_b", ""]


def test_line_ranges(spark):
    cases = [("", 0, 0, False), ("81", 81, 81, False), ("3-4000", 3, 4000, False), ("7-6", 0, 0, True), ("x2", 0, 0, True), ("9-", 0, 0, True), ("-1", 0, 0, True), (" 6 - 6 ", 6, 6, False)]
    got = spark.createDataFrame([(c[0],) for c in cases], "r string").select(text.line_range("r").alias("r")).select("r.*").collect()
    assert [(r.first, r.last, r.problem is not None) for r in got] == [c[1:] for c in cases]


def test_utf8_prefix(spark):
    for sample in ["aé", "a€b", "a😀b", "plain"]:
        raw = sample.encode()
        for n in range(1, len(raw) + 2):
            got = spark.createDataFrame([(bytearray(raw),)], "c binary").select(text.utf8_prefix("c", n)).first()[0]
            assert got == raw[:n].decode(errors="ignore")


def test_dates(spark):
    cases = [("2024-05-01T12:00:00+02:00", "2024-05-01T10:00:00Z"), ("not a date", "not a date"), ("2024-05-01T12:00:00Z", "2024-05-01T12:00:00Z"),
             ("2024-03-10T02:30:00Z", "2024-03-10T02:30:00Z"), ("2024-11-03T05:30:00Z", "2024-11-03T05:30:00Z"), ("2024-11-03T06:30:00Z", "2024-11-03T06:30:00Z"),
             ("1969-12-31T23:59:59.5-01:00", "1970-01-01T00:59:59Z")]
    assert column_of(spark, [(d,) for d, _ in cases], "d string", text.utc_rfc3339("d")) == [w for _, w in cases]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert column_of(spark, [(d,) for d, _ in cases], "d string", text.utc_rfc3339("d")) == [w for _, w in cases]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_cap_bytes(spark):
    one = spark.createDataFrame([("é" * 600,)], "t string")
    kept, cut = text.cap_bytes("t", 1, "[cut]")
    row = one.select(kept.alias("kept"), cut.alias("cut")).first()
    assert row.cut and row.kept == "é" * 512 + "[cut]"
    kept, cut = text.cap_bytes("t", 0, "[cut]")
    assert list(one.select(kept, cut).first()) == ["é" * 600, False]
