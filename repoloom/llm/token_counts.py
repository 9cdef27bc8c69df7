"""Token counts: an exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, stored, texts_of
from .tokens import encoder

CHUNK = 1024


def encoded_lengths(docs: DataFrame, group_col: str, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id: the group, length: ids of the text) for every row; a null text has length 0."""
    schema = pa.schema([("id", pa.string()), ("length", pa.int64())])

    def lengths(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            ids, sizes = [], []
            for key, text in texts_of([batch]):
                ids.append(key)
                sizes.append(len(encode(text)) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int64())], schema=schema)

    rows = keyed(docs, group_col, text_col).withColumn("id", F.col("id").cast("string"))
    return rows.mapInArrow(lengths, "id string, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(id, length, n_docs): exact counts, partial sums before the shuffle."""
    return lengths.groupBy("id", "length").agg(F.count("*").alias("n_docs"))


def context_answers(hist: DataFrame) -> DataFrame:
    """For each group and length that occurs, read as a context limit, what suffix sums say.

    n_docs (of exactly this length), docs_over (longer), docs_total,
    tokens_total, tokens_truncated (sum of min(length, limit)), tokens_lost,
    quantile (share of documents not longer).  A limit between two lengths has
    the docs_over of the shorter one, and tokens_truncated that of the shorter one plus docs_over times
    the difference.  Sums run inside chunks of 1024 lengths and over chunk
    totals, so no task holds more than a chunk or one row for each chunk.
    """
    chunked = hist.withColumn("chunk", F.floor(F.col("length") / CHUNK))
    chunks = chunked.groupBy("id", "chunk").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    over = Window.partitionBy("id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("id")
    chunks = chunks.select(
        "id", "chunk", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("later_d"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("later_t"),
        F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("id", "chunk").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = chunked.withColumns({
        "in_d": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
        "in_t": F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(inside), F.lit(0)),
    }).join(chunks.withColumnRenamed("id", "of").withColumnRenamed("chunk", "at"), F.col("id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")))
    docs_over, tokens_over = F.col("in_d") + F.col("later_d"), F.col("in_t") + F.col("later_t")
    lost = tokens_over - docs_over * F.col("length")
    return rows.select(
        F.col("id").alias("grp"), F.col("length").alias("context_limit"), "n_docs", docs_over.alias("docs_over"), "docs_total", "tokens_total",
        (F.col("tokens_total") - lost).alias("tokens_truncated"), lost.alias("tokens_lost"),
        (1 - docs_over / F.col("docs_total")).alias("quantile"))


def token_counts(docs: DataFrame, group_col: str = "lang", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """context_answers() of the encoded lengths of every row of docs, for each value of group_col.

    Null texts count as empty (length 0), a null group is a group of its own,
    repeated rows count each time, an empty table gives no rows.
    """
    # read by two branches: stored, so that texts are encoded once
    return context_answers(stored(histogram(encoded_lengths(docs, group_col, text_col, tokenizer))))
