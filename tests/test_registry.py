"""Registry joins, changes to it, and stored tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from repoloom.operators import maintain, registry
from repoloom.operators.symbols import symbols_across
from repoloom.sources import tables
from repoloom.sources.corpus import corpus_scan, land_files, manifest_of, read_manifest

REPOS = "name string, url string, path string, shallow boolean, fetched_at timestamp_ntz"
CHECKOUTS = "id string, repo string, ref string, kind string, commit_hash string, path string, updated_at timestamp_ntz, parsed_at timestamp_ntz"
T0 = datetime(2024, 1, 1)
def at():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


@pytest.fixture
def store(spark):
    repos = spark.createDataFrame([(n, f"u/{n}", f"/d/{n}", False, T0) for n in ("a", "b")], REPOS)
    rows = [("a", "a", "main"), ("a@0", "a", "0"), ("a@v1", "a", "v1"), ("b", "b", "main")]
    checkouts = spark.createDataFrame([(i, r, ref, "branch" if i == r else "tag", "h" + i, "/d/" + i, T0, None) for i, r, ref in rows], CHECKOUTS)
    symbols = spark.createDataFrame([("x.py", "f", "function", 1, None, None, "python", p) for p in ("a", "a", "a@v1", "b")], tables.SYMBOLS)
    return repos, checkouts, symbols


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_join_and_order(store):
    repos, checkouts, _ = store
    rows = registry.default_first(registry.projects(checkouts, repos)).collect()
    assert [r.id for r in rows] == ["a", "a@0", "a@v1", "b"] and rows[1].repo_path == "/d/a"


def test_nested_list_in_parts(store):
    repos, checkouts, _ = store
    whole = {r.name: r for r in registry.list_repos(checkouts, repos).collect()}
    assert [c.id for c in whole["a"].checkouts] == ["a", "a@0", "a@v1"] and whole["a"].parts == 1
    split = registry.list_repos(checkouts, repos, per_row=1).where("name = 'a'").collect()
    assert sorted(c.id for r in split for c in r.checkouts) == ["a", "a@0", "a@v1"]
    assert [r.checkouts[0].id for r in split if r.part == 0] == ["a"]


def test_lookup(spark, store):
    repos, checkouts, _ = store
    asked = spark.createDataFrame([("a@v1",), ("a@v9",), ("zz",), ("zz@v1",)], "handle string")
    got = {r.handle: r.status for r in registry.lookup(asked, checkouts, repos).collect()}
    assert got == {"a@v1": "ok", "a@v9": "no such checkout", "zz": "not tracked", "zz@v1": "not tracked"}


def test_path_conflicts(spark):
    rows = [("r", "r", "main"), ("r@X/y", "r", "X/y"), ("r@x-y", "r", "x-y"), ("r@z", "r", "z"), ("s@x-y", "s", "x-y")]
    got = registry.path_conflicts(spark.createDataFrame(rows, "id string, repo string, ref string"))
    assert ids(got) == ["r@X/y", "r@x-y"]


def test_counts_show_zero(store):
    _, checkouts, symbols = store
    assert {r.id: r.symbol_count for r in registry.count_symbols(checkouts, symbols).collect()} == {"a": 2, "a@0": 0, "a@v1": 1, "b": 1}


def test_deletes_cascade(spark, store):
    repos, checkouts, symbols = store
    r, c, s, report = maintain.delete_repos(repos, checkouts, symbols, spark.createDataFrame([("a",), ("nope",)], "name string"))
    assert ids(r, "name") == ["b"] and ids(c) == ["b"] and ids(s, "project") == ["b"]
    assert [(x.repo, x.id, x.outcome) for x in report.collect()] == [
        ("a", "a@v1", "removed"), ("a", "a@0", "removed"), ("a", "a", "removed"), ("nope", None, "not found")]
    c, s, outcome = maintain.delete_checkouts(checkouts, symbols, spark.createDataFrame([("a@v1",), ("a",), ("q",)], "id string"))
    assert ids(c) == ["a", "a@0", "b"] and ids(s, "project") == ["a", "a", "b"]
    assert {x.id: x.outcome for x in outcome.collect()} == {"a@v1": "removed", "a": "default checkout", "q": "not found"}


def test_inserts(spark, store):
    repos, checkouts, _ = store
    new = spark.createDataFrame([("a", "x", "x", True, T0), ("c", "y", "y", True, T0), ("c", "z", "z", True, T0)], REPOS)
    after, outcome = maintain.insert_repos(repos, new)
    assert ids(after, "name") == ["a", "b", "c"]
    assert {r.name: r.outcome for r in outcome.collect()} == {"a": "duplicate", "c": "repeated"}
    more = spark.createDataFrame([(i, r, "x", "tag", "h", "p", T0, None) for i, r in [("a@0", "a"), ("a@9", "a"), ("zz", "zz")]], CHECKOUTS)
    after, outcome = maintain.insert_checkouts(checkouts, repos, more)
    assert ids(after) == ["a", "a@0", "a@9", "a@v1", "b"]
    assert {r.id: r.outcome for r in outcome.collect()} == {"a@0": "duplicate", "a@9": "inserted", "zz": "no such repo"}


def test_replace_is_idempotent_and_stamps(spark, store):
    _, checkouts, symbols = store
    fresh = spark.createDataFrame([("y.py", "g", "function", 1, 2, None, "python", "a")] * 2, tables.SYMBOLS)
    parsed = spark.createDataFrame([("a",), ("a@v1",)], "project string")
    once, stamped = maintain.replace_symbols(symbols, checkouts, fresh, parsed, at())
    twice, _ = maintain.replace_symbols(once, stamped, fresh, parsed, at())
    assert sorted((r.project, r.name) for r in once.collect()) == [("a", "g"), ("a", "g"), ("b", "f")]
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.id for r in stamped.where("parsed_at is not null").collect()} == {"a", "a@v1"}


def test_snapshot_and_shallow(spark, store):
    repos, checkouts, _ = store
    moves = spark.createDataFrame([("a@0", "1", "tag", "new", datetime(2025, 1, 1))], "id string, ref string, kind string, commit_hash string, updated_at timestamp_ntz")
    rows = {r.id: r for r in maintain.set_snapshots(checkouts, moves).collect()}
    assert rows["a@0"].commit_hash == "new" and rows["a"].commit_hash == "ha" and len(rows) == 4
    flags = maintain.set_shallow(repos, spark.createDataFrame([("a", True)], "name string, shallow boolean"))
    assert {r.name: r.shallow for r in flags.collect()} == {"a": True, "b": False}


def test_advance(spark, store):
    repos, checkouts, _ = store
    checkouts = checkouts.withColumn("kind", F.when(F.col("id") == "a@v1", "commit").otherwise(F.col("kind"))).withColumn(
        "parsed_at", F.when(F.col("id") != "a", F.lit(T0).cast("timestamp_ntz")))
    heads = spark.createDataFrame([("a", "ha"), ("a@0", "ha@0"), ("a@v1", "moved"), ("b", None)], "id string, commit_hash string")
    resolved = spark.createDataFrame([("a", "branch", "ha", None), ("a@0", "tag", None, "gone"), ("a@v1", "tag", "other", None), ("b", "branch", "hb", None)],
                                     "id string, kind string, commit_hash string, problem string")
    out = {r.id: r for r in maintain.advance(registry.projects(checkouts, repos), heads, resolved, at()).collect()}
    assert (out["a"].changed, out["a"].reindex, out["a"].updated_at) == (False, True, T0)
    assert (out["a@0"].ok, out["a@0"].error, out["a@0"].reindex) == (False, "gone", False)
    assert (out["a@v1"].commit, out["a@v1"].changed, out["a@v1"].kind) == ("ha@v1", True, "commit")
    assert (out["b"].changed, out["b"].prev_commit) == (True, "")


def test_index_store(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("x.py", "f", "function", 1, None, None, "python", p) for p in ("a", "b@v/1", "c")], tables.SYMBOLS)
    tables.write_symbols(rows, rows.select("project"), root)
    assert ids(tables.read_index(spark, root), "project") == ["a", "b@v/1", "c"]
    tables.write_symbols(rows.limit(0), spark.createDataFrame([("a",)], "project string"), root)
    assert ids(tables.read_index(spark, root), "project") == ["b@v/1", "c"]
    plan = tables.read_index(spark, root).where("project = 'c'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project" in plan


def test_schema_version(spark, store, tmp_path):
    root, repos = str(tmp_path), store[0]
    assert tables.ensure_schema(spark, root, version=1) is False
    tables.save_table(repos, root, "repos")
    tables.save_table(tables.load_table(spark, root, "repos").where("name = 'a'"), root, "repos")
    assert ids(tables.load_table(spark, root, "repos"), "name") == ["a"]
    assert tables.ensure_schema(spark, root, version=1) is False
    assert tables.ensure_schema(spark, root, version=2) is True
    assert not tables.exists(spark, f"{root}/repos")


def test_landing_keeps_hidden_names(spark, tmp_path):
    for path in [".github/ci.yml", "pkg/__init__.py", "_x/y", ".git/config", "sub/.git", "plain.txt"]:
        target = tmp_path / "root" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"z\x00")
    files = read_manifest(manifest_of(spark, {"p@v1": str(tmp_path / "root")}))
    land_files(files, str(tmp_path / "files"))
    back = corpus_scan(spark, str(tmp_path / "files"))
    assert ids(back, "path") == [".github/ci.yml", "_x/y", "pkg/__init__.py", "plain.txt"]
    assert {(r.project, r.size) for r in back.collect()} == {("p@v1", 2)}


def test_landed_snapshots_compare_without_contents(spark, make_files, tmp_path):
    from repoloom.operators.diff import diff_files

    sides = []
    for name, text in (("old", "1"), ("new", "2")):
        files = make_files({"a": text, "b": "same"}).withColumn("size", F.octet_length("content").cast("long"))
        land_files(files, str(tmp_path / name))
        sides.append(corpus_scan(spark, str(tmp_path / name)))
    changed = diff_files(*sides, renames=False)
    assert [(r.path, r.status) for r in changed.collect()] == [("a", "M")]
    assert "content" not in changed._jdf.queryExecution().executedPlan().toString()


def test_info(spark, store):
    repos, checkouts, _ = store
    row = registry.info(spark.createDataFrame([("a@v1",), ("zz",)], "handle string"), checkouts, repos).collect()
    assert [(r.name, r.checkout.id, len(r.checkouts)) for r in row] == [("a", "a@v1", 3)]


def test_salted_join_is_the_join(spark):
    from repoloom.session import salted_join

    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(60)], "k string, v int")
    small = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("k3", "z"), ("k0", "w")], "k string, w string")
    got = salted_join(big, small, ["k"], F.col("v"), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_folders_are_listed_by_many_tasks(spark, tmp_path):
    """All folders of one root but the root itself; unreadable roots fail, links are not followed."""
    want = set()
    for n in range(40):
        folder = tmp_path / "root" / f"d{n % 8}" / f"e{n}"
        folder.mkdir(parents=True)
        (folder / "f.txt").write_text(str(n))
        want.add(f"d{n % 8}/e{n}/f.txt")
    (tmp_path / "root" / ".git").mkdir()
    (tmp_path / "root" / ".git" / "HEAD").write_text("x")
    (tmp_path / "root" / "loop").symlink_to(tmp_path / "root", target_is_directory=True)
    listed = spark.sparkContext.accumulator(0)
    found = manifest_of(spark, {"p": str(tmp_path / "root")})
    assert {r.path for r in found.collect()} == want
    counted = found.mapInPandas(lambda it: (listed.add(bool(len(b))) or b for b in it), found.schema)
    assert counted.count() == 40 and listed.value > 1
    with pytest.raises(Exception, match="nowhere"):
        manifest_of(spark, {"p": str(tmp_path / "nowhere")})
    assert manifest_of(spark, {}).count() == 0


def test_complete_landing_drops_vanished_projects(spark, tmp_path, make_files):
    where = str(tmp_path / "files")
    both = make_files({"a": "1"}, "p@v/1").unionByName(make_files({"b": "2"}, "q")).withColumn("size", F.lit(1).cast("long"))
    land_files(both, where)
    land_files(both.where("project = 'q'"), where)
    assert ids(corpus_scan(spark, where), "project") == ["p@v/1", "q"]
    land_files(both.where("project = 'q'"), where, complete=True)
    assert ids(corpus_scan(spark, where), "project") == ["q"]


def test_lookup_reads_only_checkouts_that_can_match(spark, tmp_path):
    """The files of all other checkouts are spoilt after the write, so a look at one would fail."""
    root = str(tmp_path / "store")
    names = ["ParseTree", "open_file", "closeAll", "Ünïq", "f"]
    rows = [("x.py", names[n % 5], "class" if n % 10 == 0 else "function", 1, 2, None, "python", f"p{n}") for n in range(30)]
    s = spark.createDataFrame(rows, tables.SYMBOLS)
    tables.write_symbols(s, s.select("project"), root)
    tables.create_lookup(spark, root)
    again = spark.createDataFrame([("y.py", "reparse", "function", 1, 2, None, "go", "p1"), ("y.py", "late", "class", 1, 2, None, "go", "p31")], tables.SYMBOLS)
    tables.write_symbols(again, again.select("project"), root)
    asked = [("*parse*", [], []), ("PARSETREE", ["class"], []), ("late", ["class", "method"], ["go"]), ("ÜNïq", [], []), ("nowhere", [], []), ("o%e", [], ["python"]), ("f", [], [])]
    for name, kinds, langs in asked:
        plain, by_lookup = (sorted(tuple(r) for r in symbols_across(index, name, kinds, langs, limit=0).select("project", "name", "lang").collect())
                            for index in (tables.read_index(spark, root), tables.read_lookup(spark, root, name, kinds, langs)))
        assert by_lookup == plain and bool(plain) == (name != "nowhere")
    able = {f"p{n}" for n in range(0, 30, 5)} | {"p1"}
    for folder in (tmp_path / "store" / "symbols").glob("project=*"):
        if folder.name[8:] not in able:
            for file in folder.glob("*.parquet"):
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
                file.write_bytes(b"spoilt")
    found = symbols_across(tables.read_lookup(spark, root, "*parse*"), "*parse*", limit=0)
    assert {r.project for r in found.collect()} == able
    with pytest.raises(Exception):
        symbols_across(tables.read_index(spark, root), "*parse*", limit=0).collect()
