"""Topic density of files, and how to split and merge a search by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import top_dir
from ..functions.text import like_ascii_ci, name_pattern
from .grep import grep_counts
from .listing import visible

LONG_FILE_LINES = 500
TOPIC_SHARE = 0.1
TIERS = ["core", "related", "speculative"]


def topic_density(files: DataFrame, symbols: DataFrame, pattern: str, name: str) -> DataFrame:
    """Per file with a match: matching lines, lines, symbols and topic symbols.

    A file over 500 lines where under a tenth of the symbols name the topic
    only mentions it.
    """
    hits = grep_counts(files, pattern)
    named = symbols.groupBy("project", "path").agg(
        F.count("*").alias("symbols"),
        F.count_if(like_ascii_ci("name", name_pattern(name))).alias("topic_symbols"),
    )
    zero = F.lit(0)
    joined = hits.join(named, ["project", "path"], "left").select(
        "project", "path", F.col("matches").cast("long").alias("matches"), F.col("lines").cast("long").alias("lines"),
        F.coalesce("symbols", zero).cast("long").alias("symbols"), F.coalesce("topic_symbols", zero).cast("long").alias("topic_symbols"),
    )
    share = F.when(F.col("symbols") > 0, F.round(F.col("topic_symbols") / F.col("symbols") * 10000) / 10000).otherwise(0.0)
    return joined.withColumn("share", share).withColumn(
        "mentions", (F.col("lines") > LONG_FILE_LINES) & (F.col("share") < TOPIC_SHARE)
    )


def shard_plan(files: DataFrame, dense: int = 20) -> DataFrame:
    """Top-level folders with their file counts; a dense one is a scope of its own.

    The other folders of a project share the scope "rest".
    """
    counts = visible(files).groupBy("project", top_dir("path").alias("dir")).agg(F.count("*").alias("file_count"))
    alone = (F.col("dir") != ".") & (F.col("file_count") >= dense)
    return counts.withColumn("scope", F.when(alone, F.concat("dir", F.lit("/"))).otherwise("rest"))


def merge_shards(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, shards to run again) from results(project, shard, path, tier, role, truncated).

    A path found by several shards keeps its best tier.  A shard whose search
    was cut short contributes nothing and has to be split.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    cut = results.where("truncated").select("project", "shard").distinct()
    good = results.join(cut, ["project", "shard"], "left_anti").where("path is not null")
    best = good.groupBy("project", "path").agg(
        F.min(F.struct(rank.alias("rank"), "shard", "tier", "role")).alias("b"), F.count("*").alias("found_by")
    )
    return best.select("project", "path", "b.tier", "b.role", F.col("b.shard").alias("shard"), "found_by"), cut
