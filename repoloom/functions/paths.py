"""Path and name columns: matching, filters, handles, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col
from .regexes import glob_to_java, is_glob

# Source extensions the symbol extractor reads, and the
# directories it never enters.
SOURCE_LANGS = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".java": "java"}
SKIPPED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "vendor"]


def basename(path: Column | str) -> Column:
    """Text after the last slash."""
    return F.substring_index(as_col(path), "/", -1)


def file_ext(path: Column | str) -> Column:
    """From the last dot of the base name; empty without a dot."""
    return F.regexp_extract(basename(path), r"(?s)(\.[^.]*)\z", 1)


def dir_of(path: Column | str) -> Column:
    """Text before the last slash, or "." at the root."""
    p = as_col(path)
    return F.when(p.contains("/"), F.regexp_extract(p, r"(?s)\A(.*)/", 1)).otherwise(".")


def top_dir(path: Column | str) -> Column:
    """First path segment, or "." for a file at the root."""
    p = as_col(path)
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(".")


def not_git(path: Column | str) -> Column:
    """False for a `.git` entry (folder or pointer file) at any depth."""
    return ~F.array_contains(F.split(as_col(path), "/"), ".git")


def match_prefix(path: Column | str, pattern: str | Column) -> Column:
    """Whether `pattern` is the path itself or one of its ancestor folders."""
    p = as_col(path)
    if isinstance(pattern, Column):
        stem = F.regexp_replace(pattern, r"/\z", "")
        return (pattern != "") & ((p == stem) | p.startswith(F.concat(stem, F.lit("/"))))
    if pattern == "":
        return F.lit(False)
    stem = pattern.removesuffix("/")
    return (p == stem) | p.startswith(stem + "/")


def match_glob(path: Column | str, pattern: str) -> Column:
    """Whether the path matches a glob; a malformed glob matches nothing."""
    java = glob_to_java(pattern)
    return F.lit(False) if java is None else as_col(path).rlike(java)


def match_path(path: Column | str, pattern: str) -> Column:
    """Glob match for patterns with `*`, `?` or `[`, else prefix match."""
    return match_glob(path, pattern) if is_glob(pattern) else match_prefix(path, pattern)


def path_filter(
    path: Column | str, includes: Sequence[str] = (), excludes: Sequence[str] = (), *, globs: bool = False
) -> Column:
    """Excludes win; without includes everything is in; includes are ORed."""
    match = match_path if globs else match_prefix
    keep = F.lit(True)
    if includes:
        keep = F.lit(False)
        for pattern in includes:
            keep = keep | match(path, pattern)
    for pattern in excludes:
        keep = keep & ~match(path, pattern)
    return keep


def source_lang(path: Column | str) -> Column:
    """Language of a source file the extractor reads, else null."""
    ext = F.lower(file_ext(path))
    out = F.lit(None).cast("string")
    for suffix, lang in SOURCE_LANGS.items():
        out = F.when(ext == suffix, lang).otherwise(out)
    return out


def in_skipped_dir(path: Column | str) -> Column:
    """Whether a parent folder is one the extractor never enters."""
    parts = F.split(as_col(path), "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(parents, F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def walk_order(path: Column | str) -> Column:
    """Sort key of a depth-first walk: segment by segment."""
    return F.split(as_col(path), "/")


def checkout_id(repo: Column | str, ref: Column | str) -> Column:
    """Handle of a pinned checkout."""
    return F.concat(as_col(repo), F.lit("@"), as_col(ref))


def id_repo(handle: Column | str) -> Column:
    """Repo part of a handle: text before the first @."""
    return F.substring_index(as_col(handle), "@", 1)


def id_ref(handle: Column | str) -> Column:
    """Ref part of a handle: text after the first @, else empty."""
    return F.regexp_extract(as_col(handle), r"(?s)\A[^@]*@(.*)\z", 1)


def checkout_dir(repo: Column | str, ref: Column | str) -> Column:
    """Folder name of a checkout; slashes of the ref become dashes."""
    return checkout_id(repo, F.replace(as_col(ref), F.lit("/"), F.lit("-")))


def repo_name_problem(name: Column | str) -> Column:
    """Why a repo name is refused; null when it is fine."""
    n = as_col(name)
    return (
        F.when(n == "", "empty")
        .when(n.isin(".", ".."), "dots")
        .when(n.rlike(r"[/\\]"), "separator")
        .when(n.contains("@"), "at sign")
        .when(n.rlike(r"\x00"), "nul")
    )


def ref_name_problem(ref: Column | str) -> Column:
    """Why a ref name is refused; null when it is fine."""
    r = as_col(ref)
    return (
        F.when(r == "", "empty")
        .when(r.isin("HEAD", "@") | r.contains("@{"), "symbolic")
        .when(r.startswith("refs/") | r.startswith("origin/"), "prefixed")
        .when(r.startswith("-"), "dash")
        .when(r.contains(".."), "dot dot")
        .when(r.startswith("/") | r.endswith("/") | r.contains("//"), "component")
        .when(r.rlike(r"[\\ \t\n\x00~^:?*\[]"), "character")
        .when(F.array_contains(F.split(r, "/"), "."), "component")
    )


def _cleaned(path: Column, finish) -> Column:
    """`finish` of struct(kept segments, segments climbed above the root)."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("above"))

    def step(acc: Column, seg: Column) -> Column:
        kept, above = acc["kept"], acc["above"]
        return (
            F.when(seg.isin("", "."), acc)
            .when(
                (seg == "..") & (F.size(kept) > 0),
                F.struct(F.slice(kept, F.lit(1), F.size(kept) - 1).alias("kept"), above.alias("above")),
            )
            .when(seg == "..", F.struct(kept.alias("kept"), (above + 1).alias("above")))
            .otherwise(F.struct(F.concat(kept, F.array(seg)).alias("kept"), above.alias("above")))
        )

    return F.aggregate(F.split(path, "/"), start, step, finish)


def clean_path(path: Column | str) -> Column:
    """The path without ".", ".." and doubled slashes; empty for the root."""
    return _cleaned(as_col(path), lambda acc: F.array_join(acc["kept"], "/"))


def path_problem(path: Column | str) -> Column:
    """Lexical reason why a requested path is refused; null when it is safe.

    A path that climbs above the root is refused even when it would come back
    down.
    """
    p = as_col(path)

    def verdict(acc: Column) -> Column:
        return (
            F.when(p.startswith("/"), F.concat(p, F.lit(": absolute paths are not allowed")))
            .when((acc["above"] == 0) & (F.get(acc["kept"], 0) == ".git"),
                  F.concat(p, F.lit(": git metadata is not readable")))
            .when(acc["above"] > 0, F.concat(p, F.lit(": escapes the project root")))
        )

    return _cleaned(p, verdict)


def is_hex_ref(ref: Column | str) -> Column:
    """Non-empty lower-case hexadecimal."""
    return as_col(ref).rlike(r"\A[0-9a-f]+\z")


def name_from_url(url: Column | str) -> Column:
    """Repo name a URL implies; empty when no valid one can be had."""
    u = F.regexp_replace(as_col(url), r"(?U)\A\s+|\s+\z", "")
    u = F.regexp_replace(F.regexp_replace(u, r"/\z", ""), r"\.git\z", "")
    u = F.regexp_extract(u, r"([^/:]*)\z", 1)
    return F.when(repo_name_problem(u).isNull(), u).otherwise("")
