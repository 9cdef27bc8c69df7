"""SimHash near-dedup: every fingerprint meets its neighbours in the balls of half the radius."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, keyed, stored, texts_of
from .components import components

RADIUS = 2
BITS = 64
SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `words` words, A-Z in lower case; of the whole sequence if it is shorter."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    width = min(words, len(found))
    joined = memoryview(b" ".join(found))
    one = xxhash.xxh64_intdigest
    return np.fromiter(
        (one(joined[a:b], SEED) for a, b in zip(starts[:len(found) - width + 1].tolist(), (ends[width - 1:] - 1).tolist(), strict=True)),
        np.uint64, len(found) - width + 1)


def simhash(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """Bit i is 1 if it is set in over half of the hashes; of none it is 0.  Signed, as Spark's long."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at:at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every row's whole text over shingles of `words` words; no words give 0."""
    rows = keyed(docs, id_col, text_col)

    def prints(batches):
        for batch in batches:
            out = [simhash(shingle_hashes(text, words)) for _, text in texts_of([batch])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(prints, f"id {id_type(rows)}, fp long")


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints of prints(fp) that differ in at most `radius` (even) bits.

    Every distinct fingerprint emits all variants in the ball of half the
    radius, and two fingerprints are within the radius if and only if they
    share a variant.  In the order of each variant's fingerprints every one is
    linked to the one before, so a class of any size gives links in proportion
    to its members, and has the same components as all its pairs.  Groups are
    small: at most as many distinct fingerprints as a ball has.
    """
    if radius % 2:
        raise ValueError("radius must be even: both sides emit balls of half of it")
    masks = [sum(1 << i for i in bits) for n in range(radius // 2 + 1) for bits in combinations(range(BITS), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    emitted = prints.select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in signed])).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = emitted.select("fp", before.alias("a")).where("a is not null")
    return pairs.select("a", F.col("fp").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_size) for every row.

    component_id is the least id among all documents that can be reached over
    links of fingerprints that differ in at most `radius` bits.  Null and
    blank texts have fingerprint zero and are linked like others; repeated
    rows and equal texts share a class; a null id never becomes a
    component_id unless a class has no other; no rows give no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words))
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = components(stored(ball_links(distinct, radius)))
    rooted = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("class_size"))
    members = stored(rooted.select("fp", "root").join(classes, "root"))
    return prints.join(members, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each class of simhash_classes, the one of least id; columns stay as they are.

    Rows without an id stay, since they can't be told apart; rows that repeat
    an id and its text stay once, and of an id with several texts those that
    belong to a class in which it is the least.
    """
    classes = stored(simhash_classes(docs, id_col, text_col, words, radius).select(F.col(id_col).alias("_id"), "fingerprint", "component_id"))
    ids = classes.groupBy("_id").agg(F.count("*").alias("rows"), F.max(F.col("_id") == F.col("component_id")).alias("least"))
    ids = stored(ids.where("least"))
    # The ids grow with the documents, so every size of input takes the plan that large ones need: one shuffle of the rows.
    kept = docs.join(ids.where("rows = 1").hint("merge"), docs[id_col] == F.col("_id"), "left_semi")
    kept = kept.unionByName(docs.where(F.col(id_col).isNull()))
    repeated = ids.where("rows > 1")
    if repeated.isEmpty():
        return kept
    # Which texts of a repeated id belong to its class is told by their fingerprints.
    again = docs.join(repeated, docs[id_col] == F.col("_id"), "left_semi").dropDuplicates([id_col, text_col])
    again = again.withColumn("_text", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    prints = fingerprints(again.dropDuplicates(["_text"]), "_text", text_col, words)
    prints = prints.select(F.col("id").alias("_text"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("_print"))
    mine = classes.where("_id = component_id").select("_id", "fingerprint").distinct()
    again = again.join(prints, "_text").join(mine, (F.col(id_col) == F.col("_id")) & (F.col("_print") == F.col("fingerprint")), "left_semi")
    return kept.unionByName(again.select(*docs.columns))
