"""File listings, directory counts and language histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import OTHER, detect_language
from ..functions.paths import dir_of, not_git, path_filter


def visible(files: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Files a listing sees: no `.git`, within the path filters."""
    return files.where(not_git("path") & path_filter("path", includes, excludes))


def tree(files: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """(project, path) in path order."""
    return visible(files, includes, excludes).select("project", "path").orderBy("project", "path")


def dir_counts(files: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Files directly in each folder, fullest first; the root is "."."""
    return (
        visible(files, includes, excludes)
        .groupBy("project", dir_of("path").alias("dir"))
        .agg(F.count("*").alias("file_count"))
        .orderBy("project", F.desc("file_count"), "dir")
    )


def total_files(files: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Files per project."""
    return visible(files, includes, excludes).groupBy("project").agg(F.count("*").alias("total_files"))


def lang_histogram(files: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Files and share per language, most files first."""
    return lang_counts(files, includes, excludes).orderBy("project", F.desc("file_count"), "name")


def lang_counts(files: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Files and share per language; nothing for a project of unknown files only.

    The windows run over the aggregated labels, of which there are a few
    dozen per project.
    """
    label = F.when(detect_language("path") == "", OTHER).otherwise(detect_language("path"))
    counts = (
        visible(files, includes, excludes)
        .groupBy("project", label.alias("name"))
        .agg(F.count("*").alias("file_count"))
    )
    whole = Window.partitionBy("project")
    share = F.col("file_count") / F.sum("file_count").over(whole)
    return (
        counts.withColumn("share", F.round(share * 10000) / 10000)
        .withColumn("labels", F.count("*").over(whole))
        .where((F.col("labels") > 1) | (F.col("name") != OTHER))
        .select("project", "name", "file_count", "share")
    )
