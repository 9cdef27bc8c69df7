"""Caps that say whether they cut something off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """First `limit` rows of each group and a `truncated` flag; 0 keeps all.

    One row more than the cap is kept until the flag is known.  The filter on
    the row number lets Spark cut every group before the shuffle, so a huge
    group sends at most limit + 1 rows per task (for caps below the session's
    spark.sql.optimizer.windowGroupLimitThreshold; the rows are the same).
    """
    if limit <= 0:
        return df.withColumn("truncated", F.lit(False))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    probe = ranked.where(F.col("_rn") <= limit + 1)
    seen = F.count("*").over(Window.partitionBy(*keys))
    return probe.withColumn("truncated", seen > limit).where(F.col("_rn") <= limit).drop("_rn")


def cap_all(df: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """First `limit` rows of the whole table and a `truncated` flag."""
    if limit <= 0:
        return df.withColumn("truncated", F.lit(False))
    probe = df.orderBy(*order).limit(limit + 1)
    ranked = probe.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    seen = F.count("*").over(Window.partitionBy())
    return ranked.withColumn("truncated", seen > limit).where(F.col("_rn") <= limit).drop("_rn")
