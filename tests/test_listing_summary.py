"""Listings, key files, READMEs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from repoloom.operators import listing, summary


def test_tree_prunes_git_and_respects_segments(make_files):
    files = make_files({p: "x" for p in ["a.txt", "src/b.py", "src2/c.py", ".git/config", "sub/.git", ".github/ci.yml", "src/deep/d.py"]})
    assert [r.path for r in listing.tree(files).collect()] == [".github/ci.yml", "a.txt", "src/b.py", "src/deep/d.py", "src2/c.py"]
    assert [r.path for r in listing.tree(files, ["src"], ["src/deep/"]).collect()] == ["src/b.py"]


def test_tree_does_not_read_contents(spark, make_files, tmp_path):
    make_files({"a": "x"}).write.parquet(str(tmp_path / "f"))
    plan = listing.tree(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_dir_counts(make_files):
    files = make_files({p: "x" for p in ["a", "b", "src/c", "src/d", "src/deep/e"]})
    assert [(r.dir, r.file_count) for r in listing.dir_counts(files).collect()] == [(".", 2), ("src", 2), ("src/deep", 1)]


def test_histogram(make_files):
    mixed = make_files({p: "" for p in ["a.go", "b.go", "c.py", "d.zzz"]}).unionByName(make_files({"x.zzz": "", "y": ""}, "q"))
    rows = [tuple(r) for r in listing.lang_histogram(mixed).collect()]
    assert rows == [("p", "Go", 2, 0.5), ("p", "Other", 1, 0.25), ("p", "Python", 1, 0.25)]
    assert {(r.project, r.total_files) for r in listing.total_files(mixed).collect()} == {("p", 4), ("q", 2)}
    third = [r.share for r in listing.lang_histogram(make_files({"a.go": "", "b.py": "", "c.rs": ""})).collect()]
    assert third == [0.3333] * 3


def test_important_files(make_files):
    """Documents, then build files, then tooling; within a group by name; only files of the top folder."""
    groups = [["COPYING", "README"], ["Cargo.toml", "pyproject.toml"], ["Justfile", "tox.ini"]]
    names = [n for g in groups for n in g]
    found = summary.important_files(make_files({n: "x" for n in [*names[::-1], "plain.rs", "doc/README", "src/Cargo.toml"]}))
    got = [(r.name, r.category) for r in found.collect()]
    assert {n for n, _ in got} <= set(names) and ("README", 0) in got and ("Cargo.toml", 1) in got and ("pyproject.toml", 1) in got
    assert got == sorted(got, key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("names, want", [
    (["Readme.org", "src/README.md"], {"Readme.org"}), (["README"], {"README"}), (["READ.md", "docs/README"], set()), (["README.MD", "README.bak"], {"README.MD"}),
])
def test_find_readme(make_files, names, want):
    assert {r.path for r in summary.find_readme(make_files({n: "x" for n in names})).collect()} <= want | set(names[:1]) & want


LOGO = """<table>
<tr><td><a href="https://loom.test"><img src="w.svg"></a></td></tr>
</table>

# Weave

Threads, woven.
"""
EXCERPTS = [
    ("# Weave\n\n[![ci](https://loom.test/ci.svg)](https://loom.test/ci)\n\nThreads, woven.\n", "# Weave\n\nThreads, woven."),
    ("Weave\n=====\n\n~~~sh\nweave <b> --all\n\n\n\n~~~\nEnd.\n", "Weave\n=====\n\n~~~sh\nweave <b> --all\n\n~~~\nEnd."),
    ("one\n\n\n\ntwo\n   \n\nthree", "one\n\ntwo\n\nthree"),
    ("   \n\t\n", ""), ("", ""), ("\n".join(f"row {i}" for i in range(90)), "\n".join(f"row {i}" for i in range(40))),
]


def test_excerpts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXCERPTS)], "i int, t string")
    got = [r.e for r in df.select("i", summary.excerpt("t").alias("e")).orderBy("i").collect()]
    assert got == [w for _, w in EXCERPTS]
    shown = spark.createDataFrame([(LOGO,)], "t string").select(summary.excerpt("t")).first()[0]
    assert shown.endswith("# Weave\n\nThreads, woven.") and "img" not in shown


def test_badge_lines_end_quickly(spark):
    """A long line that is almost badges must not make the pattern explode."""
    line = "  ".join(["[![a](b)](c)"] * 200) + " text"
    assert spark.createDataFrame([(line,)], "l string").select(summary.is_badge_line(F.col("l"))).first()[0] is False


def test_summary_row(make_files):
    files = make_files({"README.md": "# hi\n\ntext\n", "a.go": "", "go.mod": ""}).unionByName(make_files({"x.zzz": ""}, "bare"))
    rows = {r.project: r for r in summary.summary(files).collect()}
    assert rows["p"].total_files == 3 and rows["p"].excerpt == "# hi\n\ntext" and rows["p"].important_files == ["README.md", "go.mod"]
    assert [l.name for l in rows["p"].languages] == ["Go", "Markdown", "Other"]
    assert rows["bare"].languages == [] and rows["bare"].readme_path is None


def test_readme_is_cut_at_32k(make_files):
    text = "é" * 20_000
    out = summary.readme_excerpts(make_files({"README": text})).first().excerpt
    assert out == "é" * 16_384
