"""Conversation prefix trie: vertical bitmaps of (position, turn), intersected depth first in every shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.numbering import grouped_position

from .common import id_type, spread_join, stored

SHARD = 2048
BLOCK = 64
PIECE = 1 << 16
NEVER = 1 << 40


def coded_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, code_a, code_b, n_bytes): every turn with its place from 1 on and a hash of 128 bits in place of its texts.

    Turns are ordered by turn (null first); rows of the same turn by role,
    then by hash.  A null role or text is empty; rows without a conv_id belong
    to no conversation and are left out.  A long conversation is numbered
    piece by piece.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").alias("conv"), "turn", role.alias("role"), F.xxhash64(role, text).alias("code_a"),
        F.xxhash64(F.lit("second"), text, role).alias("code_b"), F.octet_length(text).cast("long").alias("n_bytes"))
    chunk = F.coalesce(F.floor(F.col("turn").cast("double") / BLOCK), F.lit(-(1 << 62)))
    order = [F.asc_nulls_first("turn"), "role", "code_a", "code_b"]
    return grouped_position(rows, ["conv"], chunk, order, "pos").select("conv", "pos", "code_a", "code_b", "n_bytes")


def rebuilt_turns(turns: DataFrame, heads: int = 9, apart: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with the start of every conversation taken from another one.

    Conversation c becomes the first h turns of conversation c - c % apart
    (all if it has fewer, none if there is none) and its own turns after its
    first h, where h is the CRC-32 of its decimal id modulo `heads`.
    """
    turns = stored(turns)
    h = F.crc32(F.col("conv").cast("string")) % heads
    own = turns.groupBy("conv").agg(F.max("pos").alias("n_own")).select("conv", "n_own", h.alias("h"), (F.col("conv") - F.col("conv") % apart).alias("base"))
    there = own.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    convs = stored(own.join(there, "base", "left").withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base"))
    tail = spread_join(turns, convs.select("conv", "h", "kept"), ["conv"], F.floor(F.col("pos") / PIECE)).where("pos > h")
    tail = tail.withColumn("pos", F.col("pos") - F.col("h") + F.col("kept")).drop("h", "kept")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "base")
    head = convs.join(first, "base").where("pos <= h").select(*turns.columns)
    return tail.unionByName(head), convs.select("conv")


def sharded(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv, shard): conversations in the order of their ids, in shards of at most `shard`; shards follow that order too."""
    place = F.monotonically_increasing_id()
    # the part of the order is in the upper 31 bits, the place within it in the lower 33
    return stored(convs.distinct().sort("conv").select("conv", place.alias("at"))).select(
        "conv", (F.shiftright("at", 33) * (1 << 30) + F.floor(F.col("at") % (1 << 33) / shard)).alias("shard"))


def segments(turns: DataFrame, convs: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row for each conversation and each `block` of its turns, with what went before it.

    A prefix is named by the exclusive or of 128 random-looking bits for each
    (place, turn) in it, so the names at the starts of blocks come from the
    blocks before, without going through turns one by one.
    """
    convs = sharded(convs, shard)
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("n"), F.sum("n_bytes").alias("total"))
    convs = stored(convs.join(lengths, "conv", "left").na.fill(0, ["n", "total"]))
    rows = turns.select(
        "conv", F.floor((F.col("pos") - 1) / block).alias("block"),
        F.struct("pos", F.xxhash64("pos", "code_a", "code_b").alias("za"), F.xxhash64("code_b", "pos", "code_a").alias("zb"), "n_bytes").alias("turn"))
    held = rows.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"), F.bit_xor("turn.za").alias("xa"), F.bit_xor("turn.zb").alias("xb"),
        F.sum("turn.n_bytes").alias("bytes"))
    held = spread_join(held, convs, ["conv"], F.floor(F.col("block") / PIECE))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    long = held.where(F.col("n") > block).select(
        "*", F.coalesce(F.bit_xor("xa").over(earlier), none).alias("ka"), F.coalesce(F.bit_xor("xb").over(earlier), none).alias("kb"),
        F.coalesce(F.sum("bytes").over(earlier), none).alias("spent"))
    short = held.where(F.col("n") <= block).select("*", none.alias("ka"), none.alias("kb"), none.alias("spent"))
    bare = convs.where("n = 0").select(
        "conv", none.alias("block"), F.array().cast(held.schema["turns"].dataType).alias("turns"), "shard", "n", "total",
        none.alias("ka"), none.alias("kb"), none.alias("spent"))
    names = ["conv", "shard", "block", "n", "total", "ka", "kb", "spent"]
    lists = [F.col(f"turns.{c}").alias(c) for c in ("za", "zb", "n_bytes")]
    return stored(long.select(*names, *lists).unionByName(short.select(*names, *lists)).unionByName(bare.select(*names, *lists)))


class Shard:
    """The turns of one block for the conversations of one shard: a bitset of conversations for each (place, turn)."""

    def __init__(self, part: pa.Table, block: int = BLOCK):
        part = part.sort_by("conv")
        self.block = block
        self.names = part["conv"].to_pylist()
        self.start = part["block"][0].as_py() * block
        self.lengths = part["n"].to_pylist()
        self.codes = [list(zip(a, b, strict=True)) for a, b in zip(part["za"].to_pylist(), part["zb"].to_pylist(), strict=True)]
        self.sizes = part["n_bytes"].to_pylist()
        self.postings: list[dict] = [{} for _ in range(block)]
        self.going = [0] * (block + 1)
        self.ending = [0] * (block + 1)
        self.roots: dict[tuple, int] = {}
        for i, (length, *root) in enumerate(zip(self.lengths, *(part[c].to_pylist() for c in ("ka", "kb", "spent")), strict=True)):
            bit = 1 << i
            for p, code in enumerate(self.codes[i]):
                self.postings[p][code] = self.postings[p].get(code, 0) | bit
                self.going[p] |= bit
            if length <= self.start + block:
                self.ending[length - self.start] |= bit
            else:
                self.going[block] |= bit
            self.roots[tuple(root)] = self.roots.get(tuple(root), 0) | bit

    def nodes(self) -> Iterator[tuple]:
        """(members, place, ka, kb, parent, bytes of the last text, bytes before it), every parent before its children.

        A node is the intersection of its parent's bitset with a posting.  The
        posting to try next is that of the least member not yet in a child,
        so every intersection yields a child.  `parent` counts the nodes
        yielded; the starts of a later block are nodes of the block before,
        yielded with parent None.
        """
        stack = [(members, 0, ka, kb, None, 0, spent) for (ka, kb, spent), members in self.roots.items()]
        made = 0
        while stack:
            node = stack.pop()
            yield node
            members, place, ka, kb, _, size, spent = node
            if place < self.block:
                left = members & self.going[place]
                while left:
                    low = (left & -left).bit_length() - 1
                    za, zb = code = self.codes[low][place]
                    child = members & self.postings[place][code]
                    left ^= child
                    stack.append((child, place + 1, ka ^ za, kb ^ zb, made, self.sizes[low][place], spent + size))
            made += 1

    def own(self, node: tuple) -> bool:
        """Whether this block reports the node: the starts of later blocks belong to the one before."""
        return node[1] > 0 or self.start == 0

    def ends(self, node: tuple) -> int:
        """The members whose last turn is the node's."""
        return node[0] & self.ending[node[1]]


def bits(members: int) -> Iterator[int]:
    while members:
        low = members & -members
        yield low.bit_length() - 1
        members ^= low


def conversation_trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row for every distinct prefix of the conversations, the empty one included.

    turns(conv, pos, code_a, code_b, n_bytes) has the places 1 to n of each
    conversation; convs(conv) names all of them, turnless ones too.  Result:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, n_ends), where conv_id is the least member.
    No conversations give no rows, not even the root.

    Shards of `shard` conversations and blocks of `block` turns are walked
    apart, however common a turn or long a conversation is.  The first walk
    tells the least member of each prefix: the prefixes that a conversation is
    the least member of are the last ones on its path, from some depth on.
    With that depth the second walk sums, for each prefix, what its members
    repeat of others, so sums over subtrees need no rounds over depths.
    """
    held = segments(turns.select("conv", "pos", "code_a", "code_b", "n_bytes"), convs.select("conv"), shard, block)
    kind = id_type(held, "conv")

    def first(part: pa.Table) -> pa.Table:
        here = Shard(part, block)
        rows = [(n[2], n[3], here.start + n[1], here.names[next(bits(n[0]))], n[6], n[0].bit_count(), here.ends(n).bit_count())
                for n in here.nodes() if here.own(n)]
        return arrow(rows, [("ka", pa.int64()), ("kb", pa.int64()), ("depth", pa.int64()), ("conv", part["conv"].type),
                            ("spent", pa.int64()), ("n", pa.int64()), ("ends", pa.int64())])

    found = held.groupBy("shard", "block").applyInArrow(first, f"ka long, kb long, depth long, conv {kind}, spent long, n long, ends long")
    least = found.groupBy("ka", "kb").agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("spent").alias("spent"), (F.sum("n") == F.sum("ends")).alias("leaf"))
    chains = stored(least.groupBy("conv").agg(
        F.min("depth").alias("since"), F.min_by("spent", "depth").alias("repeated"), F.max("leaf").alias("leaf")))
    held = spread_join(held, chains, ["conv"], F.floor(F.col("block") / PIECE)).select(
        *held.columns, F.coalesce("since", F.lit(NEVER)).alias("since"), F.coalesce("repeated", "total").alias("repeated"),
        F.coalesce("leaf", F.lit(False)).alias("leaf"))

    def second(part: pa.Table) -> pa.Table:
        part = part.sort_by("conv")
        here = Shard(part, block)
        since, repeated = part["since"].to_pylist(), part["repeated"].to_pylist()
        leaves = sum(1 << i for i, leaf in enumerate(part["leaf"].to_pylist()) if leaf)
        nodes = list(here.nodes())
        saved = [0] * len(nodes)
        rows = []
        for at in range(len(nodes) - 1, -1, -1):
            members, place, ka, kb, parent, size, spent = node = nodes[at]
            depth, low = here.start + place, next(bits(members))
            least_here = since[low] <= depth
            saved[at] += (members.bit_count() - least_here) * size
            if place == block:
                saved[at] += sum(max(0, repeated[i] - spent - size) for i in bits(members & here.going[block]))
            if parent is not None:
                saved[parent] += saved[at]
            if here.own(node):
                up = nodes[parent][2:4] if parent is not None else (None, None)
                rows.append((ka, kb, *up, part["shard"][0].as_py(), depth, here.names[low], members.bit_count(), since[low] == depth,
                             (members & leaves).bit_count(), saved[at], [here.names[i] for i in bits(here.ends(node))]))
        whole = [(c, pa.int64()) for c in ("ka", "kb", "pa", "pb", "shard", "depth")]
        return arrow(rows, [*whole, ("conv", part["conv"].type), ("n", pa.int64()), ("top", pa.bool_()), ("leaves", pa.int64()), ("saved", pa.int64()),
                            ("ends", pa.list_(part["conv"].type))])

    walked = stored(held.groupBy("shard", "block").applyInArrow(
        second, f"ka long, kb long, pa long, pb long, shard long, depth long, conv {kind}, n long, top boolean, leaves long, saved long, ends array<{kind}>"))
    nodes = stored(walked.groupBy("ka", "kb").agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("shard").alias("shard"),
        F.sum("n").alias("n_convs"), F.max("top").alias("top"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    # Only where a conversation starts to be the least member has the parent another one.
    tops = nodes.where("top and depth > 0").select("ka", "kb", "pa", "pb", "shard")
    named = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("above"))
    above = spread_join(tops, named, ["pa", "pb"], F.floor(F.col("shard") / BLOCK)).select("ka", "kb", "above")
    key = ["ka", "kb"]
    return nodes.join(children, key, "left").join(above, key, "left").join(end_lists(walked), key, "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"))


def arrow(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    schema = pa.schema(fields)
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def end_lists(walked: DataFrame) -> DataFrame:
    """(ka, kb, n_ends, ends_sha256): the ids of all members that end at a prefix, in order, comma-joined, as SHA-256.

    Every shard's piece of a list follows the last one's, and the hash runs
    over the pieces as they come, so no list is ever held whole.
    """
    pieces = walked.where("size(ends) > 0").select("ka", "kb", "shard", "ends").repartition("ka", "kb").sortWithinPartitions("ka", "kb", "shard")

    def hashed(batches):
        key, count, state = None, 0, None
        schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for ka, kb, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                names = ",".join(map(str, ends.as_py()))
                if key == (ka, kb):
                    count += len(ends)
                    state.update(f",{names}".encode())
                    continue
                if key is not None:
                    out.append((*key, count, state.hexdigest()))
                key, count, state = (ka, kb), len(ends), hashlib.sha256(names.encode())
            yield from arrow(out, list(zip(schema.names, schema.types, strict=True))).to_batches()
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, count, state.hexdigest()), strict=True))], schema=schema)

    return pieces.mapInArrow(hashed, "ka long, kb long, n_ends long, ends_sha256 string")


def trie_of(conversations: DataFrame) -> DataFrame:
    """conversation_trie of a table (conv_id, turn, role, text) as it stands."""
    turns = stored(coded_turns(conversations))
    return conversation_trie(turns, turns.select("conv").distinct())


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes of trie_of(conversations) with the role and text of their last turn (the root: null)."""
    order = [F.asc_nulls_first("turn"), F.coalesce(F.col("role"), F.lit("")), F.xxhash64("_r", "_t"), F.xxhash64(F.lit("second"), "_t", "_r")]
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", "role", "text", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_r"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    chunk = F.coalesce(F.floor(F.col("turn").cast("double") / BLOCK), F.lit(-(1 << 62)))
    placed = grouped_position(rows, ["conv_id"], chunk, order, "depth").select("conv_id", "depth", "role", "text")
    return nodes.join(placed, ["conv_id", "depth"], "left")


def rebuilt_report(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations (see rebuilt_turns)."""
    turns, convs = rebuilt_turns(coded_turns(conversations))
    return conversation_trie(stored(turns), convs)
