"""Git's text output as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utc_rfc3339

SEPARATOR = "\x1f"


def parse_commit_log(lines: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Commits from text lines(value): hash, author, email, date, subject.

    Fields are separated by 0x1F; the subject keeps any further separators and
    a line with fewer than five fields is dropped.
    """
    fields = F.split("value", SEPARATOR, 5)
    parts = lines.withColumn("f", fields).where(F.size("f") == 5)
    return parts.select(
        *(extra or []),
        F.get("f", F.lit(0)).alias("hash"), F.get("f", F.lit(1)).alias("author"), F.get("f", F.lit(2)).alias("email"),
        utc_rfc3339(F.get("f", F.lit(3))).alias("date"), F.get("f", F.lit(4)).alias("subject"),
    )


def read_commit_log(spark: SparkSession, location: str) -> DataFrame:
    """Commits from log files, one commit per line."""
    return parse_commit_log(spark.read.text(location))


def parse_remote_refs(lines: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(hash, name) from text lines(value); lines without a tab are dropped."""
    fields = F.split("value", "\t", 2)
    parts = lines.withColumn("f", fields).where(F.size("f") == 2)
    return parts.select(*(extra or []), F.get("f", F.lit(0)).alias("hash"), F.get("f", F.lit(1)).alias("name"))


def read_remote_refs(spark: SparkSession, location: str) -> DataFrame:
    """Published refs from saved remote listings."""
    return parse_remote_refs(spark.read.text(location))
