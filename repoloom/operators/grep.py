"""Regular-expression search over the files of many checkouts.

Patterns are RE2 syntax.  A file takes part when it is text, at most 10 MiB
and within the path filters; paths and sizes are tested before contents.
Lines are the pieces between newlines, so the empty piece after a final
newline is a line of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import not_git, path_filter, walk_order
from ..functions.regexes import path_to_re2, re2_to_java, repeats_group, required_literals
from ..functions.text import SEARCH_MAX_BYTES, byte_len, is_text, let, lines_raw
from ..numbering import grouped_position
from ..session import materialize, selective
from .limits import cap_per_group

DEFAULT_LIMIT = 200
_BATCH_BYTES = 16 << 20


def searchable(files: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Files a search reads."""
    size = F.col("size") if "size" in files.columns else byte_len("content")
    found = _named(files, includes, excludes).where(size <= SEARCH_MAX_BYTES).where(is_text("content"))
    return found.select("project", "path", "content")


def _named(files: DataFrame, includes: Sequence[str], excludes: Sequence[str]) -> DataFrame:
    """Files that a search asks for, told by their paths."""
    return files.where(not_git("path") & path_filter("path", [i for i in includes if i] or includes and ["\0"],
                                                     [e for e in excludes if e], globs=True))


def byte_column(line: Column, java: Column | str) -> Column:
    """1-based byte offset of the first match in `line`.

    A line that is not UTF-8 is read byte by byte instead, so that a byte
    counts once whatever it stands for.
    """
    java = java if isinstance(java, Column) else F.lit(java)

    def before(text: Column) -> Column:
        return F.call_function("regexp_extract", text, F.concat(F.lit(r"(?s)\A(.*?)(?:"), java, F.lit(")")), F.lit(1))

    single = F.decode(line.cast("binary"), "ISO-8859-1")
    broken = ~F.is_valid_utf8(line) & F.rlike(single, java)
    return (F.when(broken, F.char_length(before(single))).otherwise(F.octet_length(before(line))) + 1).cast("int")


def _hits(lines: DataFrame, pattern: str) -> DataFrame:
    """The rows of lines(text, ...) with a match, and the 1-based byte `column` of the first one.

    Java's matcher recurses once for each repetition of a group, so on a long
    line such a pattern can end the executor.  A pattern that repeats a group
    is matched by RE2 itself (through Arrow, in linear time and on bytes), any
    other one in the JVM; which of the two depends on the pattern alone.
    Places are sought in lines that match only.
    """
    java = re2_to_java(pattern)  # refuses what is no RE2 pattern
    if not repeats_group(pattern):
        return lines.where(F.col("text").rlike(java)).withColumn("column", byte_column(F.col("text"), java))

    @F.arrow_udf("int")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(first_places(texts, f"(?m:{pattern})") + 1, pa.int32())

    return lines.withColumn("column", found("text")).where("column > 0")


def first_places(texts: pa.Array, pattern: str) -> np.ndarray:
    """Byte offset of the first match of an RE2 pattern in each text, -1 where there is none.

    Arrow's own search for places reads texts as Latin-1, so a mark is put
    before the first match and then sought.
    """
    import pyarrow.compute as pc

    hit = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
    some = texts.filter(hit)
    mark = _mark(some.view(pa.binary()))
    marked = pc.replace_substring_regex(some, pattern, mark + rb"\0", max_replacements=1).view(pa.binary())
    out = np.full(len(texts), -1, np.int64)
    out[hit.to_numpy(zero_copy_only=False)] = pc.find_substring(marked, mark).to_numpy(zero_copy_only=False)
    return out


def _mark(texts: pa.Array) -> bytes:
    """Bytes that stand in none of the texts: the first one never is in UTF-8."""
    import pyarrow.compute as pc

    number = 0
    while pc.any(pc.match_substring(texts, b"\xff%d\xfe" % number)).as_py():
        number += 1
    return b"\xff%d\xfe" % number


def grep_lines(
    files: DataFrame, pattern: str, includes: Sequence[str] = (), excludes: Sequence[str] = (), context: int = 0
) -> DataFrame:
    """One row per matching line: project, path, line, column, text and context.

    Context is clipped to the file and may hold other matching lines.  Without
    context the lines stream through a generator; with it, hits are cut out of
    the line array before they become rows.
    """
    found = searchable(files, includes, excludes)
    if context <= 0 or repeats_group(pattern):
        lines = found.select("project", "path", F.posexplode(lines_raw("content")).alias("at", "text"))
        hits = _hits(lines, pattern).select("project", "path", (F.col("at") + 1).alias("line"), "column", "text")
        if context <= 0:
            return hits
        spots = hits.groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("line", "column"))).alias("spots"))
        near = found.join(spots, ["project", "path"]).withColumn("lines", lines_raw("content"))
        around = F.transform("spots", lambda s: _with_context(F.col("lines"), s["line"], s["line"], s["column"], context))
        return near.select("project", "path", F.explode(around).alias("m")).select("project", "path", "m.*")
    java = re2_to_java(pattern)
    matches = let(
        lines_raw("content"),
        lambda lines: F.transform(
            F.filter(
                F.transform(lines, lambda l, i: F.struct(l.alias("text"), i.alias("at"))),
                lambda x: x["text"].rlike(java),
            ),
            lambda x: _with_context(lines, x["at"] + 1, x["at"] + 1, byte_column(x["text"], java), context),
        ),
    )
    return found.select("project", "path", F.explode(matches).alias("m")).select("project", "path", "m.*")


def _with_context(lines: Column, first: Column, last: Column, column: Column, context: int) -> Column:
    """A match struct over lines first..last with `context` lines around it."""
    begin = F.greatest(F.lit(1), first - context)
    return F.struct(
        first.alias("line"),
        column.alias("column"),
        F.array_join(F.slice(lines, first, last - first + 1), "\n").alias("text"),
        F.slice(lines, begin, first - begin).alias("context_before"),
        F.slice(lines, last + 1, F.lit(context)).alias("context_after"),
    )


def grep_multiline(
    files: DataFrame, pattern: str, includes: Sequence[str] = (), excludes: Sequence[str] = (), context: int = 0
) -> DataFrame:
    """Every non-overlapping match of a pattern that may span lines.

    An empty match that touches the one before it does not count.  RE2 finds
    the matches, in time linear in the text for any pattern; a batch of texts
    (Arrow bounds its bytes) goes through it in one call.
    """
    re2_to_java(pattern, dotall=True)  # refuses what is no RE2 pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _multiline_rows(batch, f"(?ms:{pattern})", context)

    found = searchable(files, includes, excludes).select("project", "path", F.col("content").cast("binary").alias("content"))
    out = found.mapInArrow(run, "project string, path string, line int, column int, text string, "
                                "context_before array<string>, context_after array<string>")
    return out if context > 0 else out.drop("context_before", "context_after")


def _multiline_rows(batch: pa.RecordBatch, pattern: str, context: int) -> Iterator[pa.RecordBatch]:
    """The rows of grep_multiline for files(project, path, content), in batches of bounded bytes."""
    texts = batch.column(2).to_pylist()
    rows: list[tuple] = []
    held = 0
    for n, spans in enumerate(_spans(batch.column(2), pattern)):
        if not spans:
            continue
        text = texts[n]
        breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
        starts, ends = np.concatenate(([0], breaks + 1)).tolist(), [*breaks.tolist(), len(text)]
        begins, stops = np.array(spans).T
        first = np.searchsorted(breaks, begins)
        # a newline that ends a match opens no further line
        last = np.maximum(np.searchsorted(breaks, np.maximum(stops - 1, begins)), first)
        for begin, f, l in zip(begins.tolist(), first.tolist(), last.tolist(), strict=True):
            around = [[text[starts[i]:ends[i]] for i in range(*r)] for r in ((max(0, f - context), f), (l + 1, min(len(ends), l + 1 + context)))]
            rows.append((n, f + 1, begin - starts[f] + 1, text[starts[f]:ends[l]], *around))
            held += ends[l] - starts[f] + sum(map(len, around[0])) + sum(map(len, around[1]))
            if held >= _BATCH_BYTES:
                yield _row_batch(batch, rows)
                rows, held = [], 0
    if rows:
        yield _row_batch(batch, rows)


def _row_batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    at, line, column, text, before, after = zip(*rows, strict=True)
    at = pa.array(at)

    def strings(values: Sequence[bytes]) -> pa.Array:
        return pa.array(values, pa.binary()).view(pa.string())

    def lists(values: Sequence[list[bytes]]) -> pa.Array:
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)], dtype=np.int32), strings([v for held in values for v in held]))

    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(column, pa.int32()), strings(text), lists(before), lists(after)],
        names=["project", "path", "line", "column", "text", "context_before", "context_after"])


def _spans(contents: pa.Array, pattern: str) -> Iterator[list[tuple[int, int]]]:
    """(start, end) in bytes of every match in each text.

    One replacement puts a mark on both sides of all matches; the lengths of
    the pieces between the marks then place them.
    """
    import pyarrow.compute as pc

    mark = _mark(contents)
    marked = pc.replace_substring_regex(contents.view(pa.string()), pattern, mark + b"\\0" + mark).view(pa.binary())
    for text in marked.to_pylist():
        ends = np.cumsum([0, *map(len, text.split(mark))]).tolist() if text is not None else [0]
        yield list(zip(ends[1:-1:2], ends[2::2], strict=True))


def cap_matches(matches: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first `limit` matches of each project in walk order, and a flag.

    The cut follows the walk (segment by segment); the output is then sorted
    by path text and line, which is a different order.
    """
    limit = limit if limit > 0 else DEFAULT_LIMIT
    return cap_per_group(matches, ["project"], _walk(), limit).orderBy("project", "path", "line")


def grep_first(
    files: DataFrame, pattern: str, limit: int = DEFAULT_LIMIT, includes: Sequence[str] = (), excludes: Sequence[str] = (),
    context: int = 0, first: int = 64, growth: int = 8,
) -> DataFrame:
    """cap_matches(grep_lines(...), limit), reading on only where matches are missing.

    The files of each project are numbered in walk order, from their paths
    alone.  The first stage reads `first` files of every project; each next
    one reads `growth` times as many, of the projects that have no more than
    `limit` matches and have files left.  So a project costs at most about
    `growth` times the files up to its last match.  The ranges of paths of a
    stage go to the scan as filters, so a table sorted by path (land_files)
    skips the row groups of other stages.
    """
    limit = limit if limit > 0 else DEFAULT_LIMIT
    names = _named(files, includes, excludes).select("project", "path")
    # folders are numbered on their own, and only their sizes are summed along a project
    placed = materialize(grouped_position(names, ["project"], F.slice(walk_order("path"), 1, 2), [walk_order("path")], "pos"))
    wanting = placed.groupBy("project").agg(F.max("pos").alias("files")).withColumn("hits", F.lit(0).cast("long"))
    done, low, size = None, 0, first
    while not (wanting := materialize(wanting.where((F.col("hits") <= limit) & (F.col("files") > low)))).isEmpty():
        stage = placed.where((F.col("pos") > low) & (F.col("pos") <= low + size)).join(wanting.select("project"), "project", "left_semi")
        near = files.where(_in_ranges(stage)).join(stage.select("project", "path"), ["project", "path"], "left_semi")
        found = cap_per_group(grep_lines(near, pattern, includes, excludes, context), ["project"], _walk(), limit + 1).drop("truncated")
        found = materialize(found)
        done = found if done is None else done.unionByName(found)
        more = found.groupBy("project").agg(F.count("*").alias("more"))
        wanting = wanting.join(more, "project", "left").select("project", "files", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"))
        low, size = low + size, size * growth
    if done is None:
        done = grep_lines(files.where("false"), pattern, includes, excludes, context)
    return cap_matches(done, limit)


_MOST_RANGES = 8


def _in_ranges(stage: DataFrame) -> Column:
    """A filter on project and path that a scan can use: a range for each project, or one for all of many."""
    ends = [F.min("path").alias("low"), F.max("path").alias("high")]
    ranges = stage.groupBy("project").agg(*ends).limit(_MOST_RANGES + 1).collect()
    if len(ranges) > _MOST_RANGES:
        return F.col("path").between(*stage.agg(*ends).first())
    tests = [(F.col("project") == r.project) & F.col("path").between(r.low, r.high) for r in ranges]
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def _walk() -> list[Column]:
    return [walk_order("path"), F.col("line"), F.col("column")]


def grep_counts(files: DataFrame, pattern: str, **filters: Sequence[str]) -> DataFrame:
    """Matching lines and all lines per file, for files with a match."""
    if repeats_group(pattern):
        found = searchable(files, **filters)
        hits = grep_lines(files, pattern, **filters).groupBy("project", "path").agg(F.count("*").cast("int").alias("matches"))
        split = lines_raw("content")
        sizes = found.select("project", "path", let(split, lambda lines: F.size(lines) - F.when(F.get(lines, F.size(lines) - 1) == "", 1).otherwise(0)).alias("lines"))
        return sizes.join(hits, ["project", "path"]).select("project", "path", "matches", "lines")
    java = re2_to_java(pattern)
    counted = searchable(files, **filters).select(
        "project", "path",
        let(
            lines_raw("content"),
            lambda lines: F.struct(
                F.size(F.filter(lines, lambda l: l.rlike(java))).alias("matches"),
                (F.size(lines) - F.when(F.get(lines, F.size(lines) - 1) == "", 1).otherwise(0)).alias("lines"),
            ),
        ).alias("c"),
    )
    return counted.where("c.matches > 0").select("project", "path", "c.matches", "c.lines")


REQUESTS = (
    "req_id string, project string, pattern string, includes array<string>, excludes array<string>"
)
REQUEST_SHARE = 20_000
_HITS = "req_id string, project string, path string, line int, column int, text string"
_WINDOW = 4 << 20
_BATCH_ROWS = 20_000
_COMMON = b" etaoinsrhl"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NONE = np.zeros(0, np.int64)


def compile_requests(requests: DataFrame) -> DataFrame:
    """The requests with a `problem` that says why a pattern is refused; literals are what each match must have one of."""
    schema = f"{REQUESTS}, literals array<binary>, problem string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            literals, problems = [], []
            for pattern in batch["pattern"]:
                try:
                    re2_to_java(pattern)
                    literals.append(required_literals(pattern))
                    problems.append(None)
                except ValueError as error:
                    literals.append(None)
                    problems.append(str(error))
            yield batch.assign(literals=literals, problem=problems)

    return requests.select("req_id", "project", "pattern", "includes", "excludes").mapInPandas(run, schema)


def grep_batch(files: DataFrame, requests: DataFrame, share: int = REQUEST_SHARE) -> DataFrame:
    """Many requests against many checkouts in one job; the rows are those of grep_lines for each request.

    Every file is split into lines once.  One pass over the bytes looks three
    of them at a time up in a dictionary of the literals that patterns cannot
    match without, and a pattern then runs (in RE2, once for all requests that
    have it) on the lines with one of its literals.  A pattern without
    literals runs on all lines of its checkouts.

    Shares of at most `share` requests go to the tasks; more requests take one
    pass over the files of their checkouts for each share.
    """
    asked = compile_requests(requests).where("problem is null").drop("problem")
    # a bucket is about half a share, so that shares stay below their size
    buckets = asked.count() * 2 // share + 1
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("project", "pattern"), F.lit(buckets)))
    out = files.sparkSession.createDataFrame([], _HITS)
    for number in range(buckets):
        rows = asked.where(F.col("bucket") == number).drop("bucket").collect()
        for at in range(0, len(rows), share):
            some = Requests(rows[at:at + share])
            names = files.sparkSession.createDataFrame([(p,) for p in some.by_project], "project string")
            met = searchable(files).join(selective(names), "project", "left_semi").select(
                "project", "path", F.col("content").cast("binary").alias("content"))
            out = out.unionByName(met.mapInArrow(some.rows, _HITS))
    return out


class Requests:
    """A share of requests inside a task."""

    def __init__(self, rows: Sequence[T.Row]):
        self.by_project: dict[str, list[int]] = {}
        self.by_pattern: dict[str, list[int]] = {}
        self.literals: dict[str, list[bytes] | None] = {}
        self.ids, self.projects, self.scopes = [], [], []
        for n, r in enumerate(rows):
            self.ids.append(r.req_id)
            self.projects.append(r.project)
            self.scopes.append((tuple(r.includes or ()), tuple(r.excludes or ())))
            self.by_project.setdefault(r.project, []).append(n)
            self.by_pattern.setdefault(r.pattern, []).append(n)
            self.literals[r.pattern] = r.literals

    def grams(self) -> tuple[np.ndarray, list[list[str]]]:
        """Codes of three bytes in order, and the patterns that have a literal with each; one code stands for a literal."""
        found: dict[int, list[str]] = {}
        for pattern, literals in self.literals.items():
            for literal in literals or ():
                # letters that are rare in most texts come late in this order
                at = max(range(len(literal) - 2), key=lambda i: sum(_COMMON.find(literal[i + k:i + k + 1]) < 0 for k in range(3)))
                code = literal[at] << 16 | literal[at + 1] << 8 | literal[at + 2]
                found.setdefault(code, []).append(pattern)
        codes = sorted(found)
        return np.array(codes, np.uint32), [found[c] for c in codes]

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        codes, wanting = self.grams()
        known = np.zeros(1 << 24, bool)
        known[codes] = True
        for batch in batches:
            split = pc.split_pattern(batch.column(2), "\n")
            lines = split.flatten().view(pa.string())
            counts = np.diff(split.offsets.to_numpy())
            row_of = np.repeat(np.arange(len(counts)), counts)
            number = np.arange(len(row_of)) - np.repeat(np.cumsum(counts) - counts, counts)
            near = self.candidates(lines, known, codes, wanting)
            allowed = self.allowed(batch)
            for pattern, asked in self.by_pattern.items():
                masks = [(n, allowed(n)) for n in asked]
                some = np.logical_or.reduce([m for _, m in masks])
                at = np.arange(len(row_of)) if self.literals[pattern] is None else near.get(pattern, _NONE)
                at = at[some[row_of[at]]]
                if not len(at):
                    continue
                place = first_places(lines.take(pa.array(at)), f"(?m:{pattern})")
                at, place = at[place >= 0], place[place >= 0] + 1
                for n, mask in masks:
                    mine = mask[row_of[at]]
                    hits, column = at[mine], place[mine]
                    for begin in range(0, len(hits), _BATCH_ROWS):
                        part = hits[begin:begin + _BATCH_ROWS]
                        of = pa.array(row_of[part])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([self.ids[n]] * len(part), pa.string()), batch.column(0).take(of), batch.column(1).take(of), pa.array(number[part] + 1, pa.int32()),
                             pa.array(column[begin:begin + _BATCH_ROWS], pa.int32()), lines.take(pa.array(part))],
                            names=["req_id", "project", "path", "line", "column", "text"])

    def candidates(self, lines: pa.StringArray, known: np.ndarray, codes: np.ndarray, wanting: list[list[str]]) -> dict[str, np.ndarray]:
        """Pattern: the lines, in order, with a code of one of its literals."""
        if not len(codes) or not len(lines):
            return {}
        data = np.frombuffer(lines.buffers()[2], np.uint8) if lines.buffers()[2] else np.zeros(0, np.uint8)
        starts = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1]
        begin, end = int(starts[0]), int(starts[-1])
        found: dict[str, list[np.ndarray]] = {}
        for low in range(begin, end, _WINDOW):
            part = _LOWER[data[low:min(end, low + _WINDOW + 2)]].astype(np.uint32)
            grams = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            spots = np.flatnonzero(known[grams])
            line = np.searchsorted(starts, low + spots, "right") - 1
            which = np.searchsorted(codes, grams[spots])
            pairs = np.unique(which.astype(np.int64) << 32 | line)
            which, line = pairs >> 32, pairs & 0xFFFFFFFF
            bounds = np.searchsorted(which, np.arange(len(codes) + 1))
            for n in np.unique(which).tolist():
                for pattern in wanting[n]:
                    found.setdefault(pattern, []).append(line[bounds[n]:bounds[n + 1]])
        return {p: np.unique(np.concatenate(held)) for p, held in found.items()}

    def allowed(self, batch: pa.RecordBatch):
        """A function from a request to the rows of the batch that it searches."""
        import pyarrow.compute as pc

        paths = batch.column(1)
        bases = pc.replace_substring_regex(paths, r"(?s)\A.*/", "")
        of_project: dict[str, np.ndarray] = {}
        of_path: dict[str, np.ndarray] = {}
        of_scope: dict[tuple, np.ndarray] = {}

        def matches(pattern: str) -> np.ndarray:
            if pattern not in of_path:
                re2 = path_to_re2(pattern)
                of_path[pattern] = np.zeros(len(paths), bool) if re2 is None else pc.match_substring_regex(
                    bases if re2[1] else paths, re2[0]).to_numpy(zero_copy_only=False)
            return of_path[pattern]

        def mask(n: int) -> np.ndarray:
            project, scope = self.projects[n], self.scopes[n]
            if project not in of_project:
                of_project[project] = pc.equal(batch.column(0), project).to_numpy(zero_copy_only=False)
            if scope not in of_scope:
                keep, drop = scope
                inside = np.logical_or.reduce([matches(p) for p in keep]) if keep else np.ones(len(paths), bool)
                of_scope[scope] = inside & ~np.logical_or.reduce([matches(p) for p in drop] or [np.zeros(len(paths), bool)])
            return of_project[project] & of_scope[scope]

        return mask
