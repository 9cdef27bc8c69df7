"""Order within large groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_position(df: DataFrame, keys: list[str], chunk: Column, order: list[str], out: str) -> DataFrame:
    """Row number (from 1) within `keys`, in the order (chunk, *order).

    Rows are numbered inside their chunk; only the counts of the chunks are
    summed along a whole key.
    """
    df = df.withColumn("_chunk", chunk)
    sizes = df.groupBy(*keys, "_chunk").count()
    before = F.sum("count").over(
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(*keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return (
        df.withColumn("_rn", inner)
        .join(starts, [*keys, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_rn"))
        .drop("_chunk", "_rn", "_before")
    )


def with_halo(df: DataFrame, position: str, size: int, before: int, after: int) -> DataFrame:
    """Rows spread over blocks of `size` positions, each with its neighbours.

    A row goes to its own block (`home` true) and to the next or previous one
    when it lies within `before` or `after` positions of it.  A window per
    block then sees that many rows on either side of every home row.
    """
    at = F.col(position) - 1
    own = F.floor(at / size).cast("long")
    offset = at % size
    blocks = F.array_compact(F.array(
        own, F.when(offset >= size - before, own + 1), F.when((offset < after) & (own > 0), own - 1)
    ))
    return df.withColumn("_own", own).withColumn("block", F.explode(blocks)).withColumn(
        "home", F.col("block") == F.col("_own")
    ).drop("_own")
