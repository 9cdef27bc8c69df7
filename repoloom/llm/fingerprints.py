"""Document fingerprints: bottom-k sketches of word shingle hashes, built and compared by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, stored

K = 128
WORDS = 5
BUCKET = 1024


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """df with `out`: the k least distinct hashes, ascending, of all runs of `words` lower-case words.

    A text of fewer words is one shingle; one without words has an empty
    sketch.  Each step is a column of its own, so that nothing is evaluated
    once for each element.
    """
    hashed = df.withColumn("_h", F.transform(F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    ends = F.sequence(F.lit(0), F.greatest(F.size("_h") - words, F.lit(0)))
    rolled = hashed.withColumn(out, F.when(F.size("_h") > 0, F.transform(
        ends, lambda i: F.xxhash64(*[F.get(F.col("_h"), i + n) for n in range(words)]))).otherwise(F.array().cast("array<bigint>")))
    return rolled.withColumn(out, F.slice(F.sort_array(F.array_distinct(out)), 1, k)).drop("_h")


def merged(sketches: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """(by..., sketch): the sketch of the union of each group's documents.

    Only the k least hashes of a group leave a task, so a group may hold any
    share of the rows.
    """
    each = sketches.select(*by, F.explode(sketch).alias("_x")).distinct()
    kept = each.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_x"))).where(F.col("_n") <= k)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias(sketch))


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated share of shingles that both sets have of those that either has; exact for sets of at most k. Two empty ones are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def distinct_shingles(sketch: str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: from resemblance and the numbers of shingles."""
    like, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), like * (na + nb) / (1 + like) / na))


def as_text(sketch: str) -> Column:
    """A sketch as hex digits, 16 for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def following(rows: DataFrame) -> DataFrame:
    """(bucket, next_id): for each bucket of keyed rows the least id of the next bucket, for the last one of the first.

    Buckets hold 1024 ids.  Their order is told in groups of 1024 buckets and
    then over the groups, so the one task that sees all groups has a row for
    a million ids.
    """
    firsts = rows.groupBy("bucket").agg(F.min("id").alias("first")).withColumn("over", F.floor(F.col("bucket") / BUCKET))
    tops = firsts.groupBy("over").agg(F.min("first").alias("first"))
    one = Window.orderBy("over")
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(F.col("over").alias("o"), F.coalesce(F.lead("first").over(one), F.first("first").over(whole)).alias("top"))
    inner = F.lead("first").over(Window.partitionBy("over").orderBy("bucket"))
    return firsts.withColumn("inner", inner).join(tops, F.col("over") == F.col("o")).select("bucket", F.coalesce("inner", "top").alias("next_id"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch) of every row: with the text of the next id, after the last that of the first.

    Rows of one id follow each other in the order of their texts; a null id
    comes before all others.  Texts move once, to their bucket of ids; only
    the last row of a bucket takes its next text from a join.
    """
    rows = keyed(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    least = F.coalesce("id", F.lit(-(2**63)))
    rows = rows.withColumn("bucket", F.floor(least / BUCKET).cast("long"))
    sketched = with_sketch(rows, "text", "sketch", k)
    order = Window.partitionBy("bucket").orderBy("id", "text")
    led = sketched.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    ends = stored(following(rows.withColumn("id", least)))
    heads = rows.withColumn("_least", least).join(ends.select(F.col("bucket").alias("b"), "next_id"), F.col("_least") == F.col("next_id"))
    heads = with_sketch(heads.groupBy("b").agg(F.min("text").alias("head")), "head", "head_sketch", k)
    return led.join(heads, F.col("bucket") == F.col("b"), "left").select(
        "id", "text", "sketch", F.coalesce("next_text", "head").alias("next_text"), F.coalesce("next_sketch", "head_sketch").alias("next_sketch"))


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last floor(n_chars / 2) characters replaced by the
    first as many of the next document.  Null texts are empty; equal texts
    have equal fingerprints; an empty table gives no rows.
    """
    paired = with_next(docs, id_col, text_col, k).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = with_sketch(edited.drop("text", "next_text"), "edited", "edited_sketch", k)
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"), resemblance("sketch", "edited_sketch", k).alias("near_edited"),
        resemblance("sketch", "next_sketch", k).alias("near_next"), distinct_shingles("sketch", k).alias("n_shingles"),
        containment("edited_sketch", "sketch", k).alias("edited_within"))
