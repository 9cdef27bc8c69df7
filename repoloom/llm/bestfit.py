"""Best-fit packing: bounded-space online best-fit with open bins in a bitset keyed by free space."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, id_type, keyed, stored, texts_of
from .tokens import encoder

LENGTH = 1024
BINS = 512
MERGE = 32
END = (2).to_bytes(4, "little")
PIECE = "piece long, start long, length long, ids_crc32 long, sequence_id long, offset long, level int, grp long"


class Bins:
    """At most `most` open bins of `length` places; bit f of `free` is set where a bin has f places left."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free, self.by_free = 0, [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def take(self, room: int) -> tuple[int, list]:
        """A bin with `room` places left, which is no longer among the open ones."""
        held = self.by_free[room]
        one = held.pop()
        if not held:
            self.free &= ~(1 << room)
        self.open -= 1
        return one

    def keep(self, room: int, one: tuple[int, list]) -> None:
        self.by_free[room].append(one)
        self.free |= 1 << room
        self.open += 1

    def fullest(self) -> tuple[int, list]:
        return self.take((self.free & -self.free).bit_length() - 1)

    def place(self, size: int, piece: tuple) -> Iterator[tuple[int, list]]:
        """Put a piece where it fits best; the bins that this closes.

        The lowest bit from `size` on is the fullest bin with room.  Without
        one a new bin opens, for which the fullest closes if all are open.
        """
        fitting = self.free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            one = self.take(room)
        else:
            if self.open >= self.most:
                yield self.fullest()
            self.made += 1
            room, one = self.length, (self.made, [])
        one[1].append((self.length - room, piece))
        if room > size:
            self.keep(room - size, one)
        else:
            yield one


def cut(key: object, ids: bytes, length: int) -> Iterator[tuple]:
    """(id, piece, start, length, crc32) of a document: all pieces are full but the first."""
    total = len(ids) // 4
    first = (total - 1) % length + 1
    for n, start in enumerate([0, *range(first, total, length)]):
        stop = first if n == 0 else start + length
        yield key, n, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])


def pack_stream(pieces: Iterable[tuple], length: int, most: int) -> Iterator[tuple[bool, int, int, tuple]]:
    """(left over, bin, offset, piece) of pieces (id, piece, start, length, crc32) in the order in which bins close.

    What is still open at the end is left over, the fullest first.
    """
    bins = Bins(length, most)
    for piece in pieces:
        for name, held in bins.place(piece[3], piece):
            for offset, one in held:
                yield False, name, offset, one
    while bins.open:
        name, held = bins.fullest()
        for offset, one in held:
            yield True, name, offset, one


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bins: int = BINS,
                  tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` ids, as few as best-fit makes.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset).  A
    document is its ids followed by the end id 2; a null or empty text is the
    end id alone.  Only longer documents are cut, and only their first piece
    may be shorter than `length`.  Repeated rows are packed each time; null
    ids stay.  An empty table gives no pieces.  Sequence ids are unique, not
    dense.  Ids that are not integers or strings come back as strings.

    Each partition packs its documents in one pass with `bins` open bins.
    The pieces of the bins left open by 32 partitions are packed again, the
    longest first, and at most `bins` bins of these are left for the next
    level, those with most room: a task of any level has at most 32 * `bins`
    bins, whatever the sizes of their pieces.
    """
    rows = keyed(docs, id_col, text_col)
    kind, arrow_id = {"bigint": ("long", pa.int64()), "int": ("int", pa.int32())}.get(id_type(rows), ("string", pa.string()))
    rows = rows.withColumn("id", F.col("id").cast(kind))
    names = [part.split() for part in PIECE.split(", ")]
    schema = pa.schema([("id", arrow_id), *((name, pa.int64() if t == "long" else pa.int32()) for name, t in names)])
    ddl = f"id {kind}, {PIECE}"

    def packed(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        pieces = (piece for key, text in texts_of(batches) for piece in cut(key, encode(text) + END, length))
        return batches_of(((*piece, part << 32 | name, offset, int(left), part // MERGE)
                           for left, name, offset, piece in pack_stream(pieces, length, bins)), schema)

    def merged_at(level: int, last: bool):
        def merged(part: pa.Table) -> pa.Table:
            group = part["grp"][0].as_py()
            part = part.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            pieces = zip(*(part[c].to_pylist() for c in ("id", "piece", "start", "length", "ids_crc32")), strict=True)
            made = list(pack_stream(pieces, length, part.num_rows + 1))
            left = dict.fromkeys(name for up, name, *_ in made if up)
            going = set() if last else set(list(left)[-bins:])
            rows = [(*piece, level << 58 | group << 32 | name, offset, int(name in going), group // MERGE) for _, name, offset, piece in made]
            return pa.Table.from_batches(batches_of(rows, schema), schema)
        return merged

    now = stored(rows.mapInArrow(packed, ddl))
    done = [now.where("level = 0")]
    left, level = now.where("level = 1"), 0
    groups = left.agg(F.max("grp")).first()[0]
    while groups is not None:
        level += 1
        now = stored(left.groupBy("grp").applyInArrow(merged_at(level, groups == 0), ddl))
        done.append(now.where("level = 0"))
        left = now.where("level = 1")
        groups = None if groups == 0 else left.agg(F.max("grp")).first()[0]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
