"""Differences between two snapshots of files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linediff import is_binary, line_counts, unified
from ..functions.paths import not_git, path_filter
from ..functions.text import lines_raw, utf8_prefix
from ..numbering import grouped_position
from ..session import materialize, salted_join, selective

MAX_KB = 256
# An uncapped document comes in parts of about this size.
PART_BYTES = 4 * 1024 * 1024
FILES_AT_ONCE = 32
CAP_MARKER = "\n[truncated by --max-kb]\n"
# Shortest text a changed file can add to a patch.
_LEAST_PATCH = 19


def _hashed(files: DataFrame, paths: Sequence[str]) -> DataFrame:
    # A landed table carries its hashes; then no contents are read at all.
    sha = F.col("sha256") if "sha256" in files.columns else F.sha2(F.col("content").cast("binary"), 256)
    return files.where(not_git("path") & path_filter("path", paths)).select("project", "path", sha.alias("sha"))


def diff_files(old: DataFrame, new: DataFrame, paths: Sequence[str] = (), renames: bool = True) -> DataFrame:
    """(project, path, status, old_path): A added, D deleted, M changed, R renamed.

    Only hashes are compared, so contents stay out of the shuffle.  A deleted
    and an added file with equal contents are one exact rename; several such
    files of one hash are paired off in the order of their path hashes, which
    numbers them in bounded chunks.
    """
    a = _hashed(old, paths).withColumnRenamed("sha", "old_sha")
    b = _hashed(new, paths).withColumnRenamed("sha", "new_sha")
    both = a.join(b, ["project", "path"], "full_outer").where(~F.col("old_sha").eqNullSafe(F.col("new_sha")))
    status = F.when(F.col("old_sha").isNull(), "A").when(F.col("new_sha").isNull(), "D").otherwise("M")
    changed = both.select("project", "path", status.alias("status"), F.coalesce("old_sha", "new_sha").alias("sha"))
    none = F.lit(None).cast("string").alias("old_path")
    if not renames:
        return changed.select("project", "path", "status", none)

    # Read four times below, and finding it may hash both snapshots.
    changed = materialize(changed)
    # Most hashes occur on one side only; drop those before numbering.
    key = ["project", "sha"]
    loose = changed.where("status in ('A', 'D')")
    shared = loose.groupBy(*key).agg(F.min("status").alias("lo"), F.max("status").alias("hi")).where("lo <> hi").select(*key)
    mixed = loose.join(shared, key, "left_semi").withColumn("order", F.md5("path"))
    placed = grouped_position(mixed, [*key, "status"], F.substring("order", 1, 4), ["order"], "nth")
    pairs = placed.groupBy(*key, "nth").agg(
        F.max(F.when(F.col("status") == "D", F.col("path"))).alias("old_path"),
        F.max(F.when(F.col("status") == "A", F.col("path"))).alias("path"),
    ).where("old_path is not null and path is not null").select("project", "path", "old_path")
    gone = pairs.select("project", F.col("old_path").alias("path"))
    return (
        changed.join(pairs, ["project", "path"], "left")
        .join(gone.withColumn("moved", F.lit(True)), ["project", "path"], "left")
        .where("moved is null or status <> 'D'")
        .select("project", "path", F.when(F.col("old_path").isNotNull(), "R").otherwise(F.col("status")).alias("status"), "old_path")
    )


def _with_contents(changed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed files beside both contents; unchanged ones are never moved.

    The list of changed files is written first: it is narrow, it is read
    three times, and finding it hashes both snapshots.
    """
    changed = materialize(changed)
    before = F.coalesce("old_path", F.when(F.col("status") != "A", F.col("path")))
    keys = changed.withColumn("before", before)
    a = old.select("project", F.col("path").alias("before"), F.col("content").cast("binary").alias("old"))
    b = new.select("project", "path", F.col("content").cast("binary").alias("new"))
    a = a.join(keys.select("project", "before"), ["project", "before"], "left_semi")
    b = b.join(keys.where("status <> 'D'").select("project", "path"), ["project", "path"], "left_semi")
    both = keys.join(a, ["project", "before"], "left").join(b, ["project", "path"], "left").drop("before")
    return both


def _few_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, FILES_AT_ONCE at a time, so that no task holds the patches of a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, FILES_AT_ONCE):
            yield batch.slice(at, FILES_AT_ONCE)


def _beside(rows: pa.RecordBatch, **made: pa.Array) -> pa.RecordBatch:
    kept = ["project", "path", "status", "old_path"]
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *made.values()], names=[*kept, *made])


def diff_stat(old: DataFrame, new: DataFrame, paths: Sequence[str] = (), renames: bool = True) -> DataFrame:
    """Added and deleted lines per changed file; null for binary files."""
    changed = diff_files(old, new, paths, renames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _few_files(batches):
            counts = [_count(r["old"], r["new"]) for r in rows.to_pylist()]
            yield _beside(rows, added=pa.array([c[0] for c in counts], pa.int32()), deleted=pa.array([c[1] for c in counts], pa.int32()))

    return _with_contents(changed, old, new).mapInArrow(
        run, "project string, path string, status string, old_path string, added int, deleted int"
    )


def _count(old: bytes | None, new: bytes | None) -> tuple[int | None, int | None]:
    a, b = old or b"", new or b""
    return (None, None) if is_binary(a) or is_binary(b) else line_counts(a, b)


def diff_totals(stat: DataFrame) -> DataFrame:
    """Files changed and lines added and deleted per project."""
    return stat.groupBy("project").agg(
        F.count("*").alias("files_changed"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
        F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"),
    )


def diff_stat_bag(old: DataFrame, new: DataFrame, paths: Sequence[str] = ()) -> DataFrame:
    """Lines per changed file that one side has more often: an order-blind stat.

    Runs without Python; a line that only moved counts as neither.
    """
    changed = diff_files(old, new, paths, renames=False).select("project", "path")

    def side(files: DataFrame, sign: int) -> DataFrame:
        return files.join(changed, ["project", "path"], "left_semi").select(
            "project", "path", F.explode(lines_raw("content")).alias("line"), F.lit(sign).alias("sign")
        )

    net = side(old, -1).unionByName(side(new, 1)).groupBy("project", "path", "line").agg(F.sum("sign").alias("net"))
    counted = net.groupBy("project", "path").agg(
        F.sum(F.greatest("net", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("deleted")
    )
    return changed.join(counted, ["project", "path"], "left").select(
        "project", "path", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted")
    )


def _patched(changed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _few_files(batches):
            yield _beside(rows, patch=pa.array([unified(r["path"], r["old"], r["new"], r["old_path"]) for r in rows.to_pylist()], pa.string()))

    return _with_contents(changed, old, new).mapInArrow(
        run, "project string, path string, status string, old_path string, patch string"
    )


def diff_unified(old: DataFrame, new: DataFrame, paths: Sequence[str] = (), renames: bool = True) -> DataFrame:
    """A unified patch per changed file."""
    return _patched(diff_files(old, new, paths, renames), old, new)


def diff_documents(
    old: DataFrame, new: DataFrame, paths: Sequence[str] = (), renames: bool = True, max_kb: int = MAX_KB
) -> DataFrame:
    """One patch text per project in path order, cut at `max_kb` KiB.

    A patch takes at least 19 bytes, so only the first max_kb * 1024 / 19
    changed files of a project can show; the others are dropped before any
    contents are read.  What is put together is bounded by the cap, except
    for the size of the one patch that crosses it, which is cut first.  With
    0 nothing is cut: the documents then come in parts (column `part`, from 0).
    """
    if max_kb <= 0:
        return _whole_documents(diff_unified(old, new, paths, renames))
    cap = max_kb * 1024
    most = cap // _LEAST_PATCH + 1
    by_path = Window.partitionBy("project").orderBy("path")
    first = diff_files(old, new, paths, renames).withColumn("nth", F.row_number().over(by_path)).where(F.col("nth") <= most)
    pieces = _patched(first.drop("nth"), old, new)
    size = F.octet_length("patch").cast("long")
    sized = pieces.select("project", "path", size.alias("size"), F.substring(F.col("patch").cast("binary"), 1, cap + 1).alias("head"))
    total = F.sum("size").over(by_path.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sized.withColumn("end", total).where(F.col("end") - F.col("size") <= cap)
    grouped = placed.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("path", "head"))).alias("ps"), F.max("end").alias("bytes")
    )
    joined = F.concat(*[F.lit(b"")], F.aggregate("ps", F.lit(b""), lambda acc, p: F.concat(acc, p["head"])))
    text = F.when(F.col("bytes") > cap, F.concat(utf8_prefix(joined, cap), F.lit(CAP_MARKER))).otherwise(joined.cast("string"))
    return grouped.select("project", text.alias("diff"), (F.col("bytes") > cap).alias("truncated"))


def _whole_documents(patches: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(project, part, diff, truncated): all patches in path order, a part being closed once it has `part_bytes`."""
    sized = patches.withColumn("size", F.octet_length("patch").cast("long"))
    before = F.sum("size").over(Window.partitionBy("project").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    # sums move without the texts
    parts = sized.select("project", "path", F.floor(F.coalesce(before, F.lit(0)) / part_bytes).alias("nth"))
    dense = parts.withColumn("part", F.dense_rank().over(Window.partitionBy("project").orderBy("nth")) - 1).drop("nth")
    grouped = sized.join(dense, ["project", "path"]).groupBy("project", "part").agg(F.array_sort(F.collect_list(F.struct("path", "patch"))).alias("ps"))
    return grouped.select("project", "part", F.array_join(F.transform("ps", lambda p: p["patch"]), "").alias("diff"), F.lit(False).alias("truncated"))


def diff_endpoints(from_ref: Column, to_ref: Column) -> tuple[Column, Column]:
    """The two sides a diff request compares.

    Two refs are compared with each other; one ref, given either way, with the
    working tree; without refs the index is compared with the working tree.
    """
    has_from, has_to = F.coalesce(from_ref, F.lit("")) != "", F.coalesce(to_ref, F.lit("")) != ""
    left = F.when(has_from, from_ref).when(has_to, to_ref).otherwise("index")
    right = F.when(has_from & has_to, to_ref).otherwise("worktree")
    return left, right


def snapshot_pairs(files: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new) files of pairs(pair, old, new) of checkouts, named by the pair."""
    def side(which: str) -> DataFrame:
        names = selective(pairs.select(F.col(which).alias("project"), "pair"))
        return salted_join(files, names, ["project"], F.col("path"), 16).drop("project").withColumnRenamed("pair", "project")

    return side("old"), side("new")
