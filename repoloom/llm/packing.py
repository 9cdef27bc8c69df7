"""Packing: bounded-space online packing of documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, id_type, keyed, stored, texts_of
from .tokens import encoder

LENGTH = 2048
WINDOWS = 64
SLACK = 16
MERGE = 32
KEPT = 512
END = (1).to_bytes(4, "little")
PIECE = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
         ("sequence_id", pa.int64()), ("offset", pa.int64()), ("level", pa.int32()), ("grp", pa.int64())]


class Open:
    """At most `windows` open windows, best fit first; pieces leave when their window is emitted."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        self.held[self.made] = []
        insort(self.free, (self.length, self.made))
        return self.made

    def fitting(self, size: int) -> int | None:
        """Place in `free` of the fullest window with room for `size`."""
        at = bisect_left(self.free, (size, 0))
        return at if at < len(self.free) else None

    def put(self, at: int, size: int, piece: tuple) -> list:
        """Add a piece to the window at place `at`; the window's pieces if that fills it."""
        room, name = self.free.pop(at)
        self.held[name].append((self.length - room, piece))
        if room == size:
            return self.close(name)
        insort(self.free, (room - size, name))
        return []

    def close(self, name: int) -> list:
        return [(name, offset, piece) for offset, piece in self.held.pop(name)]

    def fullest(self) -> list:
        return self.close(self.free.pop(0)[1])


def pack_stream(docs: Iterable[tuple[object, bytes]], length: int = LENGTH, windows: int = WINDOWS, slack: int = SLACK) -> Iterator[tuple[bool, int, int, tuple]]:
    """(left over, window, offset, (id, start, length, crc32, tokens)) of documents given as little-endian ids.

    A document fills whole windows while it can; the rest goes where it fits
    best.  If it fits nowhere and all windows are open, it first tops up the
    fullest one (unless that has at most `slack` places left), which is
    emitted.  At the end the open windows are left over.
    """
    open_ = Open(length, windows)
    for key, ids in docs:
        total, start = len(ids) // 4, 0

        def piece(size: int) -> tuple:
            return key, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), total  # noqa: B023

        while total - start >= length:
            open_.made += 1
            yield False, open_.made, 0, piece(length)
            start += length
        while start < total:
            size = total - start
            at = open_.fitting(size)
            if at is None and len(open_.free) < open_.windows:
                open_.new()
                at = len(open_.free) - 1
            if at is not None:
                done = open_.put(at, size, piece(size))
                start = total
            elif open_.free[0][0] > slack:
                room = open_.free[0][0]
                done = open_.put(0, room, piece(room))
                start += room
            else:
                done = open_.fullest()
            for row in done:
                yield False, *row
    while open_.free:
        for row in open_.fullest():
            yield True, *row


def merge_pieces(pieces: list[tuple], length: int = LENGTH) -> dict[int, list]:
    """Windows (name: [(offset, piece)]) for whole pieces, the longest first, each where it fits best; piece[2] is a length."""
    open_, out = Open(length, len(pieces) + 1), {}
    for piece in sorted(pieces, key=lambda p: (-p[2], repr(p[0]), p[1])):
        at = open_.fitting(piece[2])
        if at is None:
            open_.new()
            at = len(open_.free) - 1
        for name, offset, done in open_.put(at, piece[2], piece):
            out.setdefault(name, []).append((offset, done))
    return out | open_.held


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = WINDOWS,
         slack: int = SLACK, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` ids.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).  A
    document is its ids followed by the end id 1; a null or empty text is the
    end id alone.  Repeated rows are packed each time.  Each partition packs
    its documents in one pass with `windows` open windows; what is left open
    at its end is merged over 32 partitions at a time, level by level; of a
    group's windows the 512 with most room go on to the next level, so a task
    of any level has a bounded number of windows.
    Sequence ids are unique, not dense.  An empty table gives no pieces.
    """
    rows = keyed(docs, id_col, text_col)
    schema = pa.schema([("id", pa.from_numpy_dtype("int64") if id_type(rows) == "bigint" else pa.string()), *PIECE])
    kind = "long" if id_type(rows) == "bigint" else "string"
    rows = rows.withColumn("id", F.col("id").cast(kind))
    ddl = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, level int, grp long"

    def packed(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        streams = pack_stream(((key, encode(text) + END) for key, text in texts_of(batches)), length, windows, slack)
        made = ((*piece, (part << 32) | name, offset, int(left), part // MERGE) for left, name, offset, piece in streams)
        return batches_of(made, schema)

    def merged_at(level: int, last: bool):
        def merged(part: pd.DataFrame) -> pd.DataFrame:
            group = int(part["grp"].iloc[0])
            pieces = [tuple(r) for r in part[["id", "start", "length", "ids_crc32", "doc_tokens"]].astype(object).itertuples(index=False)]
            made = merge_pieces(pieces, length)
            room = {n: length - sum(p[2] for _, p in held) for n, held in made.items()}
            open_ = sorted((n for n in made if room[n] > slack), key=lambda n: (-room[n], n))
            going = set() if last else set(open_[:KEPT])
            out = []
            for n, held in sorted(made.items()):
                out += [(*p, (level << 58) | (group << 32) | n, offset, int(n in going), group // MERGE) for offset, p in held]
            return pd.DataFrame(out, columns=[f.name for f in schema])
        return merged

    now = stored(rows.mapInArrow(packed, ddl))
    done = [now.where("level = 0")]
    left = now.where("level = 1")
    groups = left.agg(F.max("grp")).first()[0]
    level = 0
    while groups is not None:
        level += 1
        now = stored(left.groupBy("grp").applyInPandas(merged_at(level, groups == 0), ddl))
        done.append(now.where("level = 0"))
        left = now.where("level = 1")
        groups = None if groups == 0 else left.agg(F.max("grp")).first()[0]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
