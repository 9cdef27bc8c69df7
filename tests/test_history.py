"""Commit graphs, refs, diffs and streams."""

from __future__ import annotations

import random
import re
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repoloom.functions import linediff
from repoloom.operators import diff, history, maintain
from repoloom.session import materialize, rows_of, scratch_dir
from repoloom.sources import tables
from repoloom.sources.history import parse_commit_log, parse_remote_refs
from repoloom.streaming import refs as streams

COMMITS = "repo string, hash string, parents array<string>, author string, email string, author_ts timestamp_ntz, subject string"


def graph(spark, edges):
    rows = [(r, h, p, "A", "a@x", datetime(2024, 1, 1) + timedelta(hours=i), "s") for i, (r, h, p) in enumerate(edges)]
    return spark.createDataFrame(rows, COMMITS)


def ancestors(edges, head):
    up = {h: p for _, h, p in edges}
    seen, todo = set(), [head]
    while todo:
        h = todo.pop()
        if h not in seen and h in up:
            seen.add(h)
            todo += up[h]
    return seen


def random_graph(seed, n=60):
    rng, edges = random.Random(seed), []
    for i in range(n):
        parents = [f"c{j}" for j in rng.sample(range(max(0, i - 6), i), min(i, rng.choice([1, 1, 1, 2, 3])))] if i % 17 else []
        edges.append(("r", f"c{i}", parents))
    return edges


def test_walk_finds_the_ancestors(spark):
    edges = random_graph(5) + [("q", "solo", ["missing"])]
    commits = graph(spark, edges)
    heads = spark.createDataFrame([("r", "c59"), ("r", "c30"), ("q", "solo")], "repo string, head string")
    want = {("r", "c59", h) for h in ancestors(edges, "c59")} | {("r", "c30", h) for h in ancestors(edges, "c30")} | {("q", "solo", "solo")}
    assert {tuple(r) for r in history.reachable(commits, heads).collect()} == want


def test_log(spark):
    edges = [("r", "a", []), ("r", "b", ["a"]), ("r", "c", ["a"]), ("r", "m", ["b", "c"]), ("r", "x", ["m"])]
    heads = spark.createDataFrame([("r", "m")], "repo string, head string")
    repos = spark.createDataFrame([("r", True)], "name string, shallow boolean")
    rows = history.log(graph(spark, edges), heads, 3, repos).orderBy(F.desc("date")).collect()
    assert [r.hash for r in rows] == ["m", "c", "b"] and rows[0].date == "2024-01-01T03:00:00Z" and "history is truncated" in rows[0].hint
    assert history.log(graph(spark, edges), heads, 0).count() == 4


def newest_by_hand(edges, times, head, limit):
    return sorted(ancestors(edges, head), key=lambda h: (-times[h].timestamp(), h))[:limit]


@pytest.mark.parametrize("clock", ["right", "ties", "wrong", "future"])
def test_newest_in_small_windows(spark, clock):
    """Heads at the top, far down and on thin branches, with windows far smaller than the history."""
    rng = random.Random(3)
    edges = random_graph(9, 900) + [("r", f"thin{i}", [f"thin{i - 1}"] if i else ["c2"]) for i in range(5)]
    times = {}
    for i, (_, h, _) in enumerate(edges):
        late = {"wrong": rng.choice([0, 0, 0, -30, 30]), "ties": -(i % 7)}.get(clock, 0)
        times[h] = datetime(2024, 1, 1) + timedelta(hours=i + late)
    if clock == "future":
        times["c1"] = datetime(2090, 1, 1)
    rows = [(r, h, p, "A", "a@x", times[h], "s") for r, h, p in edges] + [("q", "x", ["gone"], "A", "a@x", times["c0"], "s"), ("q", "y", ["x"], "A", "a@x", None, "s")]
    commits = spark.createDataFrame(rows, COMMITS)
    asked = ["c899", "c700", "c411", "c30", "c0", "thin4"]
    heads = spark.createDataFrame([("r", h) for h in asked] + [("q", "y"), ("q", "nope")], "repo string, head string")
    got = {}
    for r in history.newest(commits, heads, 3, window=12).collect():
        got.setdefault((r.repo, r.head), set()).add(r.hash)
    want = {("r", h): set(newest_by_hand(edges, times, h, 3)) for h in asked} | {("q", "y"): {"x", "y"}}
    assert got == want


def test_many_commits_of_one_moment_at_the_edge_of_a_block(spark, monkeypatch):
    """Commits of the same time are in no order, so parents of a block's first ones stand in the block before; no head is walked whole for that."""
    monkeypatch.setattr(history, "reachable", None)
    n, start = 3600, datetime(2024, 1, 1)
    hashes = [f"{i * 7919 % 3607:04}" for i in range(n)]
    rows = [("r", hashes[i], hashes[i - 1 : i] if i else [], "A", "a@x", start + timedelta(days=i // 60), "s") for i in range(n)]
    commits = materialize(spark.createDataFrame(rows, COMMITS))
    asked = range(0, n, 7)
    heads = spark.createDataFrame([("r", hashes[i]) for i in asked], "repo string, head string")
    got = {}
    for r in history.newest(commits, heads, 3, window=12).collect():
        got.setdefault(r.head, set()).add(r.hash)
    days = [sorted(hashes[d : d + 60]) for d in range(0, n, 60)]
    want = {hashes[i]: set((sorted(hashes[i - i % 60 : i + 1]) + (days[i // 60 - 1] if i >= 60 else []))[:3]) for i in asked}
    assert got == want


def test_work_grows_with_commits_not_with_heads(spark):
    """A window of one moment, where every head has to look at all that it reaches: 12,000 heads in little time."""
    n, now = 12_000, datetime(2024, 1, 1)
    ups = [[f"c{j:05}" for j in {max(0, i - 1), max(0, i - 1 - i % 3)} if i] for i in range(n)]
    names = [f"c{i:05}" for i in range(n)]
    part = pa.table({"repo": ["r"] * n, "hash": names, "ts": [now] * n, "bound": [now] * n, "parents": pa.array(ups, pa.list_(pa.string())), "asked": [True] * n})
    begin = time.process_time()
    rows = history._newest_of(part.take(pa.array(random.Random(2).sample(range(n), n))), 3).to_pylist()
    assert time.process_time() - begin < 20
    got = {}
    for r in rows:
        got.setdefault(r["head"], []).append(r["hash"])
    assert got == {names[i]: names[: min(i + 1, 3)] if i < 3 else names[:3] for i in range(n)} and len(rows) == 3 * n - 3


def test_newest_of_commits_on_a_circle():
    day = [datetime(2024, 1, d) for d in range(1, 7)]
    rows = [("a", [], day[0]), ("b", ["a"], day[1]), ("x", ["y", "x"], day[2]), ("y", ["z"], day[3]), ("z", ["x", "b", "far"], day[4]), ("t", ["y"], day[5])]
    part = pa.table({"repo": ["r"] * 6, "hash": [h for h, *_ in rows], "ts": [t for *_, t in rows], "bound": [day[5]] * 2 + [day[4]] * 3 + [day[5]],
                     "parents": [p for _, p, _ in rows], "asked": [True] * 6})
    got = {}
    for r in history._newest_of(part, 2).to_pylist():
        got.setdefault(r["head"], []).append(r["hash"])
    # What is outside has at most the least bound, which the second newest of z and t doesn't pass.
    assert got == {"a": ["a"], "b": ["b", "a"], "x": [None], "y": [None], "z": [None], "t": [None]}
    inside = part.set_column(4, "parents", pa.array([[u for u in p if u != "far"] for _, p, _ in rows], pa.list_(pa.string())))
    got = {}
    for r in history._newest_of(inside, 2).to_pylist():
        got.setdefault(r["head"], []).append(r["hash"])
    assert got == {"a": ["a"], "b": ["b", "a"], "x": ["z", "y"], "y": ["z", "y"], "z": ["z", "y"], "t": ["t", "z"]}


def test_bounds_hold(spark):
    edges = random_graph(4, 80)
    rng = random.Random(1)
    times = {h: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(90)) for _, h, _ in edges}
    commits = spark.createDataFrame([(r, h, p, "A", "a@x", times[h], "s") for r, h, p in edges], COMMITS)
    rows = {r.hash: r for r in history.commit_bounds(commits).collect()}
    for _, h, parents in edges:
        assert rows[h].bound >= max(times[a] for a in ancestors(edges, h))
        assert all(rows[p].bound <= rows[h].bound for p in parents)


@pytest.mark.parametrize("size", [30, 60])
def test_late_times_end_in_long_histories(spark, monkeypatch, size):
    """A commit whose clock was two days ahead raises the 48 after it, by many generations, and no others."""
    monkeypatch.setattr(history, "BLOCK", size)
    start, n = datetime(2024, 1, 1), 400
    times = {f"c{i}": start + timedelta(hours=i + (48 if i in (100, 110) else 0)) for i in range(n)}
    rows = [("r", f"c{i}", [f"c{i - 1}"] if i else [], "A", "a@x", times[f"c{i}"], "s") for i in range(n)]
    commits = materialize(spark.createDataFrame(rows, COMMITS))
    got = {r.hash: r.bound for r in history.commit_bounds(commits).collect()}
    assert got == {f"c{i}": max(times[f"c{j}"] for j in range(i + 1)) for i in range(n)}


def test_lines_over_many_blocks(spark, monkeypatch):
    """Blocks far smaller than the history, in an order that wrong clocks have spoilt; rows written don't grow with the rounds."""
    rng = random.Random(8)
    edges = random_graph(11, 250)
    rows = [(r, h, p, "A", "a@x", datetime(2024, 1, 1) + timedelta(hours=i + rng.choice([0, 0, -60, 60])), "s") for i, (r, h, p) in enumerate(edges)]
    heads = spark.createDataFrame([("r", h) for h in ("c249", "c120", "c121", "c3")], "repo string, head string")
    want = {(h, x) for h in ("c249", "c120", "c121", "c3") for x in ancestors(edges, h)}
    for size, columns in ((4, COMMITS), (30, COMMITS), (30, None)):
        monkeypatch.setattr(history, "BLOCK", size)
        commits = spark.createDataFrame(rows, COMMITS)
        commits = commits if columns else commits.drop("author_ts")
        assert {(r.head, r.hash) for r in history.reachable(commits, heads).collect()} == want


def test_rows_written_do_not_grow_with_rounds(spark, monkeypatch):
    counted = []

    def store(df, where=None):
        df = materialize(df, where)
        counted.append(df.count())
        return df

    monkeypatch.setattr(history, "materialize", store)
    monkeypatch.setattr(history, "BLOCK", 200)
    n = 3000
    edges = [("r", f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)]
    heads = spark.createDataFrame([("r", f"c{n - 1}")], "repo string, head string")
    assert history.reachable(graph(spark, edges), heads).count() == n
    assert sum(counted) < 5 * n


def test_refs(spark):
    refs = spark.createDataFrame([
        ("r", "refs/heads/main", "m"), ("r", "refs/heads/a/b", "x"), ("r", "refs/remotes/origin/main", "m"), ("r", "refs/remotes/origin/HEAD", "m"),
        ("r", "refs/tags/v1", "t1"), ("r", "refs/tags/v2", "x")], "repo string, full_name string, hash string")
    objects = spark.createDataFrame([("r", "t1", "m")], "repo string, hash string, target string")
    assert [(b.name, b.remote) for b in history.branches(refs).collect()] == [("a/b", False), ("main", False), ("origin/main", True)]
    tags = history.tags(refs, objects)
    assert [(t.name, t.hash) for t in tags.collect()] == [("v1", "m"), ("v2", "x")]
    heads = spark.createDataFrame([("1", "r", "main", "m"), ("2", "r", None, "m"), ("3", "r", None, "0123456789abcdef")], "id string, repo string, branch string, hash string")
    assert sorted((h.id, h.ref, h.kind) for h in history.head_kinds(heads, tags).collect()) == [("1", "main", "branch"), ("2", "v1", "tag"), ("3", "0123456789ab", "commit")]


def test_resolution_order(spark):
    full, other = "ab12" + "0" * 36, "ab13" + "0" * 36
    commits = graph(spark, [("r", full, []), ("r", other, []), ("r", "abc4" + "1" * 36, []), ("r", "abc4" + "2" * 36, [])])
    refs = spark.createDataFrame([("r", "refs/tags/v1", "obj"), ("r", "refs/tags/both", full), ("r", "refs/heads/local", other), ("r", "refs/remotes/origin/dev", other)],
                                 "repo string, full_name string, hash string")
    objects = spark.createDataFrame([("r", "obj", full)], "repo string, hash string, target string")
    remote = spark.createDataFrame([("r", "moved", "refs/tags/v1"), ("r", "peeled", "refs/tags/v1^{}"), ("r", "head", "refs/heads/v1"), ("r", "devtip", "refs/heads/dev"), ("r", "rb", "refs/heads/both")],
                                   "repo string, hash string, name string")
    cases = [("v1", False, "tag", full), ("v1", True, "tag", "peeled"), ("dev", False, "branch", "devtip"), ("both", False, "tag", full), ("both", True, "branch", "rb"),
             (full, False, "commit", full), (full, True, "commit", full), ("ab12", False, "commit", full), ("abc4", False, None, None), ("local", False, "commit", other),
             ("origin/dev", False, "commit", other), ("refs/heads/local", False, "commit", other), ("f" * 40, False, None, None), ("nope", False, None, None)]
    asked = spark.createDataFrame([(str(i), "r", c[0], c[1]) for i, c in enumerate(cases)], "req_id string, repo string, ref string, refresh boolean")
    got = {int(r.req_id): (r.kind, r.commit_hash) for r in history.resolve_refs(asked, refs, objects, commits, remote).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2:] for c in cases]
    problems = {int(r.req_id): r.problem for r in history.resolve_refs(asked, refs, objects, commits, remote).collect()}
    assert problems[12] == "commit has to be fetched by id" and problems[13] == "not a branch, tag or commit" and problems[0] is None


def test_git_text(spark):
    sep = "\x1f"
    lines = [sep.join(["h", "A", "a@x", "2024-05-01T12:00:00+02:00", f"sub{sep}ject"]), "h" + sep + "A", ""]
    rows = parse_commit_log(spark.createDataFrame([(l,) for l in lines], "value string")).collect()
    assert [(r.hash, r.date, r.subject) for r in rows] == [("h", "2024-05-01T10:00:00Z", f"sub{sep}ject")]
    got = parse_remote_refs(spark.createDataFrame([("h\trefs/heads/x",), ("nothing",)], "value string")).collect()
    assert [(r.hash, r.name) for r in got] == [("h", "refs/heads/x")]


def apply_patch(old, patch):
    """Replay a unified patch on the lines of a text."""
    lines, out, at = old.split("\n"), [], 0
    ended = lines[-1] == ""
    lines = lines[:-1] if ended else lines
    newline_end = ended
    rows = patch.split("\n")
    i = next((k for k, r in enumerate(rows) if r.startswith("@@")), len(rows))
    last_new = True
    while i < len(rows) and rows[i].startswith("@@"):
        start, count = re.match(r"@@ -(\d+)(?:,(\d+))?", rows[i]).groups()
        start = int(start) - (0 if count == "0" else 1)
        out += lines[at:start]
        at, i = start, i + 1
        while i < len(rows) and rows[i] and not rows[i].startswith("@@"):
            mark, text = rows[i][0], rows[i][1:]
            if mark in " -":
                assert lines[at] == text
                at += 1
            if mark in " +":
                out.append(text)
                last_new = True
            if mark == "\\" and rows[i - 1][0] in " +":
                last_new = False
            i += 1
    touched_end = at >= len(lines)
    out += lines[at:]
    newline_end = last_new if touched_end else ended
    return "\n".join(out) + ("\n" if newline_end and out else "")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("store", [32 << 20, 1])
def test_line_diff(monkeypatch, store):
    monkeypatch.setattr(linediff, "_STORE_BYTES", store)
    rng = random.Random(11)
    for _ in range(300):
        a = "".join(rng.choice("abcd") + "\n" for _ in range(rng.randint(0, 25))) + rng.choice(["", "tail"])
        b = "".join(rng.choice("abce") + "\n" for _ in range(rng.randint(0, 25))) + rng.choice(["", "tail"])
        la, lb = linediff.split_lines(a.encode()), linediff.split_lines(b.encode())
        pairs = linediff.matches(la, lb)
        assert all(la[i] == lb[j] for i, j in pairs) and pairs == sorted(set(pairs)) and len({j for _, j in pairs}) == len(pairs)
        assert all(p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == lcs(la, lb)
        if a != b and a:
            assert apply_patch(a, linediff.unified("f", a.encode(), b.encode())) == b


def test_large_rewrite_is_quick():
    a = [b"%d\n" % (i % 977) for i in range(20_000)]
    b = [b"%d\n" % (i % 983) for i in range(20_000)]
    assert len(linediff.matches(a, b)) > 10_000


def test_patch_shape():
    got = linediff.unified("f.py", b"def f():\n    a\n    b\n    c\n    d\n", b"def f():\n    a\n    b\n    c\n    D\n")
    assert got == ("diff --git a/f.py b/f.py\nindex 1e58ac1..0a44e0c 100644\n--- a/f.py\n+++ b/f.py\n@@ -2,4 +2,4 @@ def f():\n     a\n     b\n     c\n-    d\n+    D\n"
                   ).replace("1e58ac1..0a44e0c", re.search(r"index (\S+)", got)[1])
    assert "new file mode" in linediff.unified("x", None, b"a\n") and "+a\n" in linediff.unified("x", None, b"a\n")
    assert "Binary files a/x and b/x differ" in linediff.unified("x", b"a\x00", b"b")


def test_snapshots(spark, make_files):
    old = make_files({"same": "x", "gone": "a\nb\n", "edit": "1\n2\n3\n", "from": "moved text", "twin1": "t", "twin2": "t", ".git/x": "1", "bin": b"\x00a"})
    new = make_files({"same": "x", "edit": "1\nX\n3\n4\n", "to": "moved text", "twin3": "t", "fresh": "n\n", ".git/x": "2", "bin": b"\x00b"})
    got = {r.path: (r.status, r.old_path) for r in diff.diff_files(old, new).collect()}
    moved_twin = got.pop("twin3")
    left = {p for p in ("twin1", "twin2") if p in got}
    assert moved_twin[0] == "R" and len(left) == 1 and {moved_twin[1]} | left == {"twin1", "twin2"}
    got.pop(left.pop())
    assert got == {"gone": ("D", None), "edit": ("M", None), "to": ("R", "from"), "fresh": ("A", None), "bin": ("M", None)}
    stat = {r.path: (r.added, r.deleted) for r in diff.diff_stat(old, new).collect()}
    assert stat["edit"] == (2, 1) and stat["gone"] == (0, 2) and stat["to"] == (0, 0) and stat["bin"] == (None, None)
    totals = diff.diff_totals(diff.diff_stat(old, new, ["edit", "gone"])).first()
    assert tuple(totals) == ("p", 2, 2, 3)
    bag = {r.path: (r.added, r.deleted) for r in diff.diff_stat_bag(old, new, ["edit"]).collect()}
    assert bag == {"edit": (2, 1)}
    whole = diff.diff_documents(old, new, renames=False).first()
    patches = diff.diff_unified(old, new, renames=False).orderBy("path").collect()
    assert whole.diff == "".join(p.patch for p in patches) and not whole.truncated


def test_patches_are_made_of_few_files_at_a_time():
    """A task holds the patches of some files, not of a whole batch, whatever the batch."""
    names = pa.array([f"f{i}" for i in range(100)])
    batch = pa.RecordBatch.from_arrays([names] * 4, names=["project", "path", "status", "old_path"])
    parts = list(diff._few_files(iter([batch, batch.slice(0, 0)])))
    assert [x for part in parts for x in part["path"].to_pylist()] == names.to_pylist()
    assert max(part.num_rows for part in parts) == diff.FILES_AT_ONCE < 100


def test_document_cap(spark, make_files):
    old = make_files({f"f{i:03}": "a\n" * 50 for i in range(60)})
    new = make_files({f"f{i:03}": "é\n" * 50 for i in range(60)})
    row = diff.diff_documents(old, new, max_kb=2).first()
    body = row.diff.removesuffix(diff.CAP_MARKER)
    assert row.truncated and 2044 <= len(body.encode()) <= 2048
    whole = "".join(p.patch for p in diff.diff_unified(old, new).orderBy("path").collect())
    assert whole.startswith(body)


def test_pairs_of_checkouts(spark, make_files):
    files = make_files({"a": "1\n"}, "p@1").unionByName(make_files({"a": "2\n"}, "p@2"))
    pairs = spark.createDataFrame([("p:1..2", "p@1", "p@2")], "pair string, old string, new string")
    assert [(r.project, r.status) for r in diff.diff_files(*diff.snapshot_pairs(files, pairs)).collect()] == [("p:1..2", "M")]


MOVES = [("a", 1, "c1"), ("a", 3, "c3"), ("a", 3, "c2"), ("b", 2, "d")]


def move_rows(spark, moves):
    return spark.createDataFrame([(i, datetime(2024, 1, d), "main", "branch", h) for i, d, h in moves], streams.REF_EVENTS)


def test_latest_over_batches(spark):
    """Late moves and moves at the same time, in one batch for each file; the state has one row per checkout."""
    where = scratch_dir(spark)
    rng = random.Random(4)
    moves = MOVES + [(rng.choice("ab"), rng.choice([1, 2, 3]), f"a{n}") for n in range(20)] + [("c", 1, "x")]
    for n in range(8):
        move_rows(spark, moves[n::8]).coalesce(1).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(streams.REF_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
        if n % 3 == 1 or n == 7:
            streams.store_latest(stream, f"{where}/ck").awaitTermination()
    want = {i: max((d, h) for j, d, h in moves if j == i)[1] for i in "abc"}
    rows = streams.read_latest(spark, f"{where}/ck").collect()
    assert {r.id: r.commit_hash for r in rows} == want and len(rows) == 3
    assert sorted(rows) == sorted(streams.latest_refs(move_rows(spark, moves)).select(*rows[0].__fields__).collect())


def test_index_follows_moves(spark, make_files):
    where = scratch_dir(spark)
    files = make_files({"x.py": "def one(): pass\n"}, "a").unionByName(make_files({"y.py": "def two(): pass\n"}, "b"))
    move_rows(spark, MOVES[:1]).write.parquet(f"{where}/in")
    for _ in range(2):
        stream = streams.table_stream(spark, streams.REF_EVENTS, f"{where}/in")
        streams.incremental_index(stream, files, where, f"{where}/ck").awaitTermination()
    assert [(r.project, r.name) for r in tables.read_index(spark, where).collect()] == [("a", "one")]
    first = tables.read_marks(spark, where).collect()
    assert [(r.project, r.commit_hash) for r in first] == [("a", "c1")]
    move_rows(spark, [("a", 5, "c1")]).write.mode("append").parquet(f"{where}/in")
    streams.incremental_index(streams.table_stream(spark, streams.REF_EVENTS, f"{where}/in"), files, where, f"{where}/ck").awaitTermination()
    assert tables.read_marks(spark, where).collect() == first, "a move to the same commit writes nothing"
    move_rows(spark, [("a", 6, "c2"), ("b", 6, "c1")]).write.mode("append").parquet(f"{where}/in")
    streams.incremental_index(streams.table_stream(spark, streams.REF_EVENTS, f"{where}/in"), files, where, f"{where}/ck").awaitTermination()
    assert {(r.project, r.commit_hash) for r in tables.read_marks(spark, where).collect()} == {("a", "c2"), ("b", "c1")}


def test_reindex(spark, make_files):
    """Errors keep the old index; a batch that is run again, or after a failure, does what is left only."""
    root = scratch_dir(spark)
    day = F.lit("2024-05-01").cast("timestamp_ntz")
    later = F.lit("2024-06-01").cast("timestamp_ntz")
    good = make_files({"x.py": "def one(): pass\nclass Two: pass\n"}, "a").unionByName(make_files({"note.md": "text"}, "m"))
    broken = good.unionByName(make_files({"y.py": "def old(): pass\n"}, "b")).unionByName(
        spark.createDataFrame([("b", "z.py", None)], "project string, path string, content binary"))
    moved = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("m", "c1"), ("gone", "c1"), ("a", "c1")], "id string, commit_hash string")
    got = {r.id: (r.symbol_count, str(r.parsed_at)[:10], r.index_error) for r in maintain.reindex(broken, moved, root, day).collect()}
    assert got == {"a": (2, "2024-05-01", None), "m": (0, "2024-05-01", None), "gone": (0, "None", "no files landed"),
                   "b": (0, "None", "1 source files could not be read")}
    mended = good.unionByName(make_files({"y.py": "def new(): pass\n"}, "b"))
    got = {r.id: (r.symbol_count, str(r.parsed_at)[:10], r.index_error) for r in maintain.reindex(mended, moved, root, later).collect()}
    assert got["a"] == (2, "2024-05-01", None) and got["b"] == (1, "2024-06-01", None) and got["gone"][2] == "no files landed"
    unknown = spark.createDataFrame([("a", ""), ("m", None)], "id string, commit_hash string")
    assert {str(r.parsed_at)[:10] for r in maintain.reindex(mended, unknown, root, later).collect()} == {"2024-06-01"}
    lost = maintain.reindex(good.where("project <> 'a'"), spark.createDataFrame([("a", "c9")], "id string, commit_hash string"), root, later).first()
    assert (lost.symbol_count, lost.index_error) == (2, "no files landed"), "the old index stays"


def test_grep_stream(spark, make_files):
    where = scratch_dir(spark)
    make_files({"a": "needle\nx", "b": "needle\n"}).write.parquet(f"{where}/in")
    found = streams.grep_stream(streams.table_stream(spark, "project string, path string, content binary", f"{where}/in"), "needle", excludes=["b"])
    streams.store_stream(found, f"{where}/out", f"{where}/ck").awaitTermination()
    assert [(r.path, r.line) for r in spark.read.parquet(f"{where}/out").collect()] == [("a", 1)]


def test_moved_projects_prune_the_scan(spark, make_files):
    """Re-indexing reads only the partitions of the projects that moved."""
    where = scratch_dir(spark)
    for p in "abc":
        make_files({"x.py": "def one(): pass\n"}, p).write.mode("append").partitionBy("project").parquet(f"{where}/files")
    move_rows(spark, MOVES[:1]).write.parquet(f"{where}/moves")
    files, moves = spark.read.parquet(f"{where}/files"), spark.read.parquet(f"{where}/moves")
    touched = rows_of(files, streams.latest_refs(moves).select(F.col("id").alias("project")), F.col("path"))
    assert "dynamicpruning" in touched._jdf.queryExecution().executedPlan().toString()
    assert [r.project for r in touched.collect()] == ["a"]


def test_caps(spark):
    refs = spark.createDataFrame([("r", f"refs/tags/v{i}", "h") for i in range(4)], "repo string, full_name string, hash string")
    objects = spark.createDataFrame([], "repo string, hash string, target string")
    got = history.tags(refs, objects, limit=3).collect()
    assert [t.name for t in got] == ["v0", "v1", "v2"] and all(t.truncated for t in got)


def test_rows_grow_with_commits_not_with_merges(spark, monkeypatch):
    counted = []

    def store(df, where=None):
        df = materialize(df, where)
        counted.append(df.count())
        return df

    monkeypatch.setattr(history, "materialize", store)
    edges, n = [("r", "c0", [])], 600
    for i in range(1, n):
        edges += [("r", f"s{i}", [f"c{i - 1}"]), ("r", f"c{i}", [f"c{i - 1}", f"s{i}"])]
    edges.append(("r", "none", None))
    heads = spark.createDataFrame([("r", f"c{n - 1}"), ("r", "none"), ("r", "unknown"), ("r", "s7")], "repo string, head string")
    got = {(r.head, r.hash) for r in history.reachable(graph(spark, edges), heads).collect()}
    assert got == {(f"c{n - 1}", h) for h in ancestors(edges[:-1], f"c{n - 1}")} | {("none", "none")} | {("s7", h) for h in ancestors(edges[:-1], "s7")}
    assert max(counted) <= 3 * len(edges)


def test_many_heads_of_one_repo(spark):
    edges = random_graph(9, 90)
    heads = spark.createDataFrame([("r", f"c{i}") for i in range(90)], "repo string, head string")
    got = history.reachable(graph(spark, edges), heads).collect()
    assert {(r.head, r.hash) for r in got} == {(f"c{i}", h) for i in range(90) for h in ancestors(edges, f"c{i}")}


def test_pairs_of_many_heads_are_not_stored(spark, monkeypatch):
    """Merges everywhere, heads all along and a history of several blocks: what is written doesn't grow with the pairs."""
    counted = []

    def store(df, where=None):
        df = materialize(df, where)
        counted.append(df.count())
        return df

    monkeypatch.setattr(history, "materialize", store)
    monkeypatch.setattr(history, "BLOCK", 250)
    edges = [("r", "c0", [])]
    for i in range(1, 600):
        edges += [("r", f"s{i}", [f"c{i - 1}"])] * (i % 2) + [("r", f"c{i}", [f"c{i - 1}", *[f"s{i}"] * (i % 2)])]
    asked = [f"s{i}" for i in range(1, 600, 10)]
    heads = spark.createDataFrame([("r", h) for h in asked], "repo string, head string")
    got = history.reachable(graph(spark, edges), heads).collect()
    assert len(got) == len(set(got)) and {(r.head, r.hash) for r in got} == {(h, x) for h in asked for x in ancestors(edges, h)}
    assert max(counted) <= 2 * len(edges) and sum(counted) <= 6 * len(edges)


def test_a_commit_that_names_itself_is_reached(spark):
    """As it happens when rows of a commit come twice."""
    edges = [("r", "a", []), ("r", "b", ["b", "a"]), ("r", "c", ["b"]), ("r", "d", ["c"])]
    heads = spark.createDataFrame([("r", "d")], "repo string, head string")
    assert sorted(r.hash for r in history.reachable(graph(spark, edges), heads).collect()) == ["a", "b", "c", "d"]


def test_blocks_with_many_ways_out(spark, monkeypatch):
    """Parents far away in time make joints within a block; commits that are their own ancestors end; heads are told in chunks."""
    for name, size in (("BLOCK", 150), ("NEAR", 4), ("HEADS", 8), ("SETS", 3), ("PIECE", 5)):
        monkeypatch.setattr(history, name, size)
    late, early = datetime(2024, 1, 1), datetime(2020, 1, 1)
    edges = [("r", f"b{j}", [f"b{j - 1}"] if j else [], early + timedelta(hours=j)) for j in range(80)]
    edges += [("r", f"c{i}", [f"c{i - 1}"] * (i > 0) + [f"b{i // 5}"] * (i % 5 == 0), late + timedelta(hours=i)) for i in range(400)]
    edges += [("r", "x1", ["x2"], late), ("r", "x2", ["x1", "c10", None, "gone"], late), ("r", "none", None, None), ("q", "c0", ["c0"], late)]
    commits = spark.createDataFrame([(r, h, p, "A", "a@x", t, "s") for r, h, p, t in edges], COMMITS)
    asked = [f"c{i}" for i in range(0, 400, 7)] + ["x1", "none", "b40", "b0", "nope"]
    heads = spark.createDataFrame([("r", h) for h in asked] + [("q", "c0"), ("q", None), (None, "c0")], "repo string, head string")
    known = [(r, h, [u for u in p or [] if u]) for r, h, p, _ in edges if r == "r"]
    got = history.reachable(commits, heads).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {("r", h, x) for h in asked for x in ancestors(known, h)} | {("q", "c0", "c0")}
    part = pa.table({"repo": ["r"] * 484, "block": ["0"] * 484, "hash": [h for _, h, *_ in edges], "parents": [p or [] for _, _, p, _ in edges], "seen": [t for *_, t in edges]}).slice(80, 400)
    near = history._near(part, pa.table({"hash": ["c399"], "head": [True], "joint": [False]}))
    assert near.num_rows > 10 and max(map(len, near["parents"].to_pylist())) <= 6


def test_dropped_checkouts_leave_the_stored_index(spark, tmp_path):
    from repoloom.sources import tables

    rows = [(p, "a.py", n, "class", 1, 2, None, "python") for p in ("one", "two", "x@v") for n in ("A", "B")]
    index = spark.createDataFrame(rows, "project string, path string, name string, kind string, line int, end_line int, parent string, lang string")
    tables.write_symbols(index, index.select("project"), str(tmp_path))
    gone = spark.createDataFrame([("one",), ("x@v",), ("never",)], "project string")
    tables.drop_symbols(gone, str(tmp_path))
    assert {r.project for r in tables.read_index(spark, str(tmp_path)).collect()} == {"two"}
    assert {r.project for r in tables.read_symbols(spark, str(tmp_path)).collect()} == {"one", "two", "x@v"}, "nothing is written for unknown ones"
    assert tables.read_marks(spark, str(tmp_path)).count() == 0


def test_hints_and_uncapped_documents(spark, make_files):
    refs = spark.createDataFrame([("r", "refs/heads/m", "h"), ("q", "refs/tags/t", "h")], "repo string, full_name string, hash string")
    objects = spark.createDataFrame([], "repo string, hash string, target string")
    repos = spark.createDataFrame([("r", True), ("q", False)], "name string, shallow boolean")
    assert "r" in history.branches(refs, repos=repos).first().hint and history.tags(refs, objects, repos=repos).first().hint is None
    old, new = make_files({"a": "1\n", "b": "2\n"}), make_files({"a": "3\n", "b": "4\n", "c": "5\n"})
    parts = diff.diff_documents(old, new, max_kb=0).orderBy("project", "part").collect()
    patches = [r.patch for r in diff.diff_unified(old, new).orderBy("path").collect()]
    assert "".join(r.diff for r in parts) == "".join(patches) and not any(r.truncated for r in parts)
    small = diff._whole_documents(diff.diff_unified(old, new), 10).orderBy("part").collect()
    assert [r.part for r in small] == [0, 1, 2] and [r.diff for r in small] == patches
