"""Suffix-array dedup: repeated strings by interval expansion on a Burrows-Wheeler transform, up to a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, id_type, keyed, stored, texts_of

LENGTH = 200
GRAM = 64
LONGEST_RUN = 256
BUFFER = 1 << 15
BLOCK = 1 << 18
HOT = 4096
_DRAW = np.random.default_rng(7)
_BYTE = _DRAW.integers(0, 2**63, 256, dtype=np.uint64)
_MIX = [(int(a) * 2 + 1, int(b) * 2 + 1) for a, b in _DRAW.integers(0, 2**62, (8, 2))]
SEPARATOR, END = 255, 254  # bytes that UTF-8 never has


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 64 and of the 128 bytes from each position; they are doubled from one byte on."""
    now, held = _BYTE[data], None
    for level in range(7):
        step = 1 << level
        if len(now) <= step:
            return (held if held is not None else now[:0]), now[:0]
        a, b = _MIX[level]
        joined = now[:-step] * np.uint64(a)
        joined += now[step:]
        joined ^= joined >> np.uint64(29)
        joined *= np.uint64(b)
        joined ^= joined >> np.uint64(32)
        now = joined
        if level == 5:
            held = now
    return held, now


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: running minima from both ends of blocks of that width."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _spread(of: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start over `sizes` (200 to 455), from those of 128 bytes that cover it."""
    out = sizes.astype(np.uint64)
    for step in (0, 128, 256, 384):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(_MIX[7][0]) + of[starts + np.minimum(step, sizes - 128)]
    return (out ^ (out >> np.uint64(29))) * np.uint64(_MIX[7][1])


def runs_of(data: np.ndarray, valid: np.ndarray, contents: bool = True) -> tuple[np.ndarray, ...]:
    """(key, start, n, content or grams): runs of neighbouring windows of LENGTH bytes with the same least gram.

    `valid` marks the starts of windows.  The key is the least hash of the
    64-byte grams of a window, so equal windows have equal keys wherever they
    stand; content is a hash of all bytes of the run's windows; without
    `contents`, grams says how often the least gram stands in them.
    """
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64 if contents else np.int64))
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return empty
    grams, wide = gram_hashes(data)
    least = sliding_least(grams, width)
    starts = np.flatnonzero(valid[:len(least)])
    if not len(starts):
        return empty
    value = least[starts]
    fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(fresh)
    within = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    first = np.flatnonzero(within % LONGEST_RUN == 0)
    n = np.diff(np.append(first, len(starts)))
    at, key = starts[first], value[first]
    if contents:
        return key, at, n, _spread(wide, at, n + LENGTH - 1)
    return key, at, n, gram_counts(grams, least, key, at, n + width - 1)


def gram_counts(grams: np.ndarray, least: np.ndarray, key: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each key stands among the `sizes` grams from `at` on; a key is the least gram of some window there."""
    top = np.iinfo(np.uint64).max
    width = LENGTH - GRAM + 1
    chosen = np.flatnonzero(grams == top - sliding_least(np.pad(top - least, width - 1, constant_values=top), width))
    low, high = np.searchsorted(chosen, at), np.searchsorted(chosen, at + sizes)
    of = np.repeat(np.arange(len(at)), high - low)
    held = chosen[np.arange(len(of)) + (low - np.concatenate(([0], np.cumsum(high - low)[:-1])))[of]]
    return np.bincount(of[grams[held] == key[of]], minlength=len(at))


def _buffers(rows: Iterator[tuple[object, str]]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(bytes, valid window starts, [(buffer start, id, document start)]) of pieces of documents laid end to end.

    A document longer than a buffer is cut so that each of its windows lies
    whole in one piece.
    """
    parts: list[bytes] = []
    places: list[tuple[int, object, int]] = []
    valid: list[np.ndarray] = []
    size = 0
    for key, text in rows:
        data = text.encode()
        for at in range(0, len(data) - LENGTH + 1, BUFFER):
            piece = data[at:at + BUFFER + LENGTH - 1]
            places.append((size, key, at))
            parts.append(piece)
            mark = np.zeros(len(piece), bool)
            mark[:len(piece) - LENGTH + 1] = True
            valid.append(mark)
            size += len(piece)
            if size >= BUFFER:
                yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate(valid), places
                parts, places, valid, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate(valid), places


def window_runs(docs: DataFrame) -> DataFrame:
    """(key, content, id, start, n) of all runs of windows of keyed documents."""
    kind = id_type(docs)
    arrow = pa.int64() if kind == "bigint" else pa.string()

    def scanned(batches):
        for data, valid, places in _buffers(texts_of(batches)):
            key, at, n, content = runs_of(data, valid)
            begin = np.array([p for p, _, _ in places])
            of = np.searchsorted(begin, at, "right") - 1
            shift = np.array([d for _, _, d in places]) - begin
            ids = pa.array([k for _, k, _ in places], arrow).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), ids, pa.array(at + shift[of]), pa.array(n)],
                                             names=["key", "content", "id", "start", "n"])

    return docs.mapInArrow(scanned, f"key long, content long, id {kind}, start long, n long")


def shared_keys(docs: DataFrame) -> DataFrame:
    """(key) of runs whose least gram occurs more than once in all documents; no other window can occur twice."""

    def scanned(batches):
        for data, valid, _ in _buffers(texts_of(batches)):
            key, _, _, grams = runs_of(data, valid, contents=False)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(grams)], names=["key", "grams"])

    return docs.mapInArrow(scanned, "key long, grams long").groupBy("key").agg(F.sum("grams").alias("total")).where("total > 1").select("key")


def suffix_order(text: np.ndarray, first: int = 8) -> np.ndarray:
    """Order of all rotations of a text that ends in a symbol found nowhere else, by prefix doubling.

    A symbol has 64 / `first` bits; so many are compared at first.
    """
    n = len(text)
    wrapped = np.resize(text, n + first).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(first):
        key = (key << np.uint64(64 // first)) | wrapped[j:j + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = first
    while not fresh.all():
        alone = fresh & np.append(fresh[1:], True)
        open_ = np.flatnonzero(~alone)
        at = order[open_]
        pair = rank[at] * n + rank[(at + step) % n]
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[open_] = at
        fresh[open_] = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = np.maximum.accumulate(np.where(fresh[open_], open_, 0))
        step *= 2
    return order


def repeats(text: np.ndarray, length: int = LENGTH, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows of the suffix order, and for each row the group of those with the same `length` first symbols.

    Common prefixes of neighbours in the suffix order come by increasing
    value.  An interval of rows has the suffixes with one prefix; extending it
    backward by each symbol that stands before them in the transform gives the
    intervals of longer prefixes, and the row after such an interval has a
    common prefix of the present value with its neighbour, if it had none yet.
    Only those intervals go on, breadth first, until `length` is reached: rows
    without a value share at least that much with their neighbour.
    """
    n = len(text)
    order = suffix_order(text, first)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]  # the row of the suffix one symbol longer
    before = text[order - 1]
    wrapped = np.resize(text, n + first)
    shared = np.zeros(n, np.int64)  # symbols shared with the row above, up to `first`
    same = np.ones(n, bool)
    for j in range(min(first, length)):
        symbol = wrapped[order + j]
        same[1:] &= symbol[1:] == symbol[:-1]
        same[0] = False
        shared += same
    if length <= first:
        return order, np.cumsum(shared < length) - 1
    known = np.append(shared < first, True)
    by_symbol = np.argsort(before, kind="stable")  # rows by the symbol before, each symbol's in order: `back` ascends
    after, ahead = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    alike = before[by_symbol[1:]] == before[by_symbol[:-1]]
    after[by_symbol[:-1][alike]] = by_symbol[1:][alike]
    ahead[by_symbol[1:][alike]] = by_symbol[:-1][alike]
    starts = np.flatnonzero(known[:-1])
    ends = np.append(starts[1:], n) - 1
    seeds = np.append(shared, first - 1)[ends + 1] == first - 1
    low, high = starts[seeds], ends[seeds]
    for _ in range(first, length):
        if not len(low):
            break
        sizes = high - low + 1
        of = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(len(of)) + (low - np.concatenate(([0], np.cumsum(sizes)[:-1])))[of]
        lasts = np.sort(back[rows[after[rows] > high[of]]])
        firsts = np.sort(back[rows[ahead[rows] < low[of]]])
        new = ~known[lasts + 1]
        low, high = firsts[new], lasts[new]
        known[high + 1] = True
    return order, np.cumsum(known[:-1]) - 1


def repeated_windows(regions: list[bytes], counts: list[int], length: int = LENGTH, low: list | None = None, high: list | None = None) -> list[np.ndarray]:
    """For each region, which of its windows occur at least twice, a region standing for `counts` equal ones.

    With `low` and `high`, the least and the greatest id of each region's
    documents, only windows of at least two documents count.
    """
    text = np.frombuffer(b"".join(r + bytes([SEPARATOR]) for r in regions) + bytes([END]), np.uint8)
    sizes = np.array([len(r) for r in regions])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    weight = np.zeros(len(text), np.int64)
    for at, size, count in zip(begin.tolist(), sizes.tolist(), counts, strict=True):
        weight[at:at + size - length + 1] = count
    order, group = repeats(text, length)
    if low is None:
        several = np.bincount(group, weight[order].astype(float)) > 1.5
    else:
        of = np.repeat(np.arange(len(regions)), sizes + 1)
        of = np.append(of, len(regions))[order]
        real = weight[order] > 0
        numbers = {v: n for n, v in enumerate(sorted({*low, *high}, key=lambda v: (v is not None, v)))}
        least = np.append([numbers[v] for v in low], 0)[of]
        most = np.append([numbers[v] for v in high], 0)[of]
        begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        several = np.minimum.reduceat(np.where(real, least, len(numbers)), begins) < np.maximum.reduceat(np.where(real, most, -1), begins)
    twice = np.empty(len(text), bool)
    twice[order] = several[group]
    return [twice[at:at + size - length + 1] for at, size in zip(begin.tolist(), sizes.tolist(), strict=True)]


def spans_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of true marks."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _solve(part: pd.DataFrame, apart: bool) -> pd.DataFrame:
    part = part.sort_values(["key", "content"])
    ends = (part["low"].tolist(), part["high"].tolist()) if apart else ()
    marks = repeated_windows([bytes(b) for b in part["bytes"]], part["count"].tolist(), LENGTH, *ends)
    out = [(k, c, a, b) for k, c, m in zip(part["key"], part["content"], marks, strict=True) for a, b in spans_of(m)]
    return pd.DataFrame(out, columns=["key", "content", "a", "b"])


def finer_runs(data: np.ndarray, starts: np.ndarray, fresh: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(key, content, first, n, grams): runs of windows split by their `depth` least grams; `first` counts windows.

    `starts` are the windows' places in `data`, `fresh` marks those that begin
    a run.  With a depth of 128 or more every window is a run and the key
    stands for all its bytes, so that a key has one content.
    """
    width = LENGTH - GRAM + 1
    grams, wide = gram_hashes(data)
    lowest = np.empty(len(starts), np.uint64)
    if depth >= 128:
        value = _spread(wide, starts, np.full(len(starts), LENGTH))
    else:
        value = np.empty(len(starts), np.uint64)
        rows = np.lib.stride_tricks.sliding_window_view(grams, width)
    for at in range(0, len(starts), 4096):
        part = slice(at, at + 4096)
        if depth >= 128:
            lowest[part] = value[part]
            continue
        few = np.sort(np.partition(rows[starts[part]], depth - 1, axis=1)[:, :depth], axis=1)
        lowest[part] = few[:, 0]
        mixed = np.full(len(few), depth, np.uint64)
        for column in few.T:
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(_MIX[7][0]) + column
        value[part] = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_MIX[7][1])
    first = np.flatnonzero(fresh | np.concatenate(([True], value[1:] != value[:-1])) | (depth >= 128))
    n = np.diff(np.append(first, len(starts)))
    at = starts[first]
    if depth >= 128:
        grams_in = n
    else:
        spans = np.repeat(np.arange(len(at)), n + width - 1)
        places = np.arange(len(spans)) - np.repeat(np.concatenate(([0], np.cumsum(n + width - 1)[:-1])), n + width - 1) + at[spans]
        grams_in = np.bincount(spans[grams[places] == lowest[first][spans]], minlength=len(at))
    return value[first], _spread(wide, at, n + LENGTH - 1), first, n, grams_in


def _split(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(key, content, at, n, sub, subcontent, grams, count, low, high) of the finer runs in rows of (key, content, count, low, high, bytes)."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 1000):
            batch = whole.slice(begin, 1000)
            held = batch.column(5).to_pylist()
            sizes = np.array([len(h) for h in held])
            windows = sizes - LENGTH + 1
            base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            of = np.repeat(np.arange(len(held)), windows)
            within = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
            key, content, first, n, grams = finer_runs(np.frombuffer(b"".join(held), np.uint8), base[of] + within, within == 0, depth)
            rows = pa.array(of[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(within[first]), pa.array(n), pa.array(key.view(np.int64)),
                 pa.array(content.view(np.int64)), pa.array(grams), *(batch.column(c).take(rows) for c in (2, 3, 4))],
                names=["key", "content", "at", "n", "sub", "subcontent", "grams", "count", "low", "high"])


def repeated_in(pieces: DataFrame, hot: int, block: int, apart: bool, depth: int = 1) -> DataFrame:
    """(key, content, a, b): windows [a, b) that occur twice in pieces(key, content, count, low, high, bytes).

    Pieces are laid into blocks of about `block` bytes by key, and each block
    is solved by repeats().  The pieces of a key with more than `hot` of them
    are split first, by twice as many of the least grams of their windows each
    time; equal windows have equal ones, so they stay together.  What is left
    of a key with one window goes at once.  By a depth of 128 a key is a
    window, so the splitting ends.
    """
    kind = id_type(pieces, "low")
    crowded = stored(pieces.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("key"))
    plain = pieces.join(crowded, "key", "left_anti")
    size = plain.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    solved = plain.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInPandas(
        lambda part: _solve(part, apart), "key long, content long, a long, b long")
    if crowded.isEmpty():
        return solved
    held = stored(pieces.join(crowded, "key", "left_semi").select("key", "content", "count", "low", "high", "bytes"))
    deeper = 2 * depth
    finer = held.mapInArrow(
        lambda batches: _split(batches, deeper),
        f"key long, content long, at long, n long, sub long, subcontent long, grams long, count long, low {kind}, high {kind}")
    finer = stored(finer)
    twice = finer.groupBy("sub").agg(F.sum(F.col("count") * F.col("grams")).alias("total")).where("total > 1").select("sub")
    finer = stored(finer.join(twice, "sub"))
    each = finer.groupBy("sub", "subcontent").agg(
        F.sum("count").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("key", "content", "at", "n")).alias("one"))
    cut = each.select("sub", "subcontent", "count", "low", "high", "one.*").join(held.select("key", "content", "bytes"), ["key", "content"]).select(
        F.col("sub").alias("key"), F.col("subcontent").alias("content"), "count", "low", "high",
        F.substring(F.col("bytes"), (F.col("at") + 1).cast("int"), (F.col("n") + LENGTH - 1).cast("int")).alias("bytes"))
    below = repeated_in(stored(cut), hot, block, apart, deeper).select(F.col("key").alias("sub"), F.col("content").alias("subcontent"), "a", "b")
    return solved.unionByName(finer.join(below, ["sub", "subcontent"]).select(
        "key", "content", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")))


def repeated_ranges(docs: DataFrame, hot: int = HOT, block: int = BLOCK, apart: bool = False) -> DataFrame:
    """(id, a, b): window starts [a, b) of keyed documents whose 200 bytes also start anywhere else.

    With `apart`, in another document (one with another id).

    Windows are grouped by content: equal windows have the same key.  Runs of
    a key whose gram occurs once go at once.  Equal runs are counted and kept
    once, and the distinct ones go to repeated_in().  Contents count as equal
    if key and 64-bit content hash are.
    """
    kind = id_type(docs)
    met = stored(window_runs(docs).join(stored(shared_keys(docs)), "key"))
    distinct = met.groupBy("key", "content").agg(
        F.count("*").alias("count"), F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.struct("id", "start", "n")).alias("one"))
    lists = distinct.select("key", "content", "count", "low", "high", "one.*").groupBy("id").agg(
        F.collect_list(F.struct("key", "content", "count", "low", "high", "start", "n")).alias("asked"))
    name = pa.int64() if kind == "bigint" else pa.string()
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("count", pa.int64()), ("low", name), ("high", name), ("bytes", pa.binary())])

    def cut(batches):
        def each():
            for batch in batches:
                for text, wants in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = text.encode()
                    for w in wants:
                        yield w["key"], w["content"], w["count"], w["low"], w["high"], data[w["start"]:w["start"] + w["n"] + LENGTH - 1]
        return batches_of(each(), schema, 5_000)

    joined = docs.join(lists.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of"))).select("text", "asked")
    pieces = joined.mapInArrow(cut, f"key long, content long, count long, low {kind}, high {kind}, bytes binary")
    # a key and content may be asked for of several rows that repeat an id and its text
    solved = repeated_in(stored(pieces), hot, block, apart)
    spans = stored(solved.groupBy("key", "content").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    return met.join(spans, ["key", "content"]).select("id", F.col("start").alias("s"), F.inline("spans")).select(
        "id", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))


def removed_spans(ranges: list, size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Bytes covered by windows that start in the ranges, as maximal spans."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        end = min(b + length - 1, size)
        if a >= end:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, b) for a, b in out]


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the removed spans, and the bytes that stay, concatenated.

    A byte goes if a string of 200 bytes that covers it also starts anywhere
    else, in the same or another document, judged on the input.  Null texts
    are empty; documents of under 200 bytes stay whole; rows that repeat an id
    and its text are copies of each other and go, rows that repeat an id with
    other texts are documents of their own; an empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    kind = id_type(rows)
    if kind != "bigint":
        rows = rows.withColumn("id", F.col("id").cast("string"))
        kind = "string"
    named, name = rows, "id"
    prints = rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    if not prints.where("a <> b").isEmpty():  # some id has several texts: then id and text name a document
        named, name = rows.withColumn("name", F.concat_ws("/", F.col("id").cast("string"), F.hex(F.xxhash64("text")))), "name"
    found = repeated_ranges(named.select(F.col(name).alias("id"), "text")).groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    joined = named.join(found, F.col(name).eqNullSafe(F.col("of")), "left").select("id", "text", "ranges")

    def kept(batches):
        for batch in batches:
            sizes, spans, left = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                gone = removed_spans(ranges or [], len(data))
                sizes.append(len(data))
                spans.append([list(s) for s in gone])
                bounds = [0, *(x for s in gone for x in s), len(data)]
                left.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(left, pa.binary())],
                                             names=["id", "n_bytes", "spans", "kept"])

    out = joined.mapInArrow(kept, f"id {kind}, n_bytes long, spans array<array<long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of drop_repeated_bytes()."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return drop_repeated_bytes(docs, id_col, text_col).select(
        id_col, "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
