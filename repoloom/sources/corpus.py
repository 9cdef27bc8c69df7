"""The files table: scanning it and landing files into it."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import not_git
from ..session import materialize
from .tables import exists, remove

FILES = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])

LANDED = T.StructType([*FILES.fields, T.StructField("sha256", T.StringType(), True)])
_BATCH_BYTES = 32 << 20
# Searching and parsing cost far more than reading, so contents are stored in small row groups, which tasks can share.
ROW_GROUP_BYTES = 4 << 20


def corpus_scan(spark: SparkSession, location: str) -> DataFrame:
    """The landed files table without anything below a `.git` entry."""
    return spark.read.schema(LANDED).parquet(location).where(not_git("path"))


def read_manifest(manifest: DataFrame) -> DataFrame:
    """files rows for a manifest(project, path, location) of readable files.

    The manifest names every file, dot files included, so nothing is lost to
    the hidden-file rule of Spark's own file sources.  Workers read the bytes;
    a file that cannot be read is skipped.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for project, path, location in batch[["project", "path", "location"]].itertuples(index=False):
                try:
                    with open(location, "rb") as handle:
                        data = handle.read()
                except OSError:
                    continue
                rows.append((project, path, len(data), data))
                held += len(data)
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=FILES.fieldNames())
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=FILES.fieldNames())

    return manifest.where(not_git("path")).mapInPandas(read, FILES)


def manifest_of(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """manifest rows for folders the workers can list: {project: root folder}.

    Folders are listed breadth first: each round deals the folders that the
    last one found to all tasks, so one root of many folders is listed by many
    of them, and a round is a stored table.  A folder that can't be read is
    skipped, a root that can't be read fails the job.  Links to folders are
    not followed.  The rows are dealt out by location, so the files of one
    root are read by many tasks.
    """
    schema = "project string, root string, folder string, path string, location string"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, root, folder in batch[["project", "root", "folder"]].itertuples(index=False):
                try:
                    entries = list(os.scandir(folder))
                except OSError:
                    if folder == root:
                        raise
                    continue
                rows = [(project, root, e.path if e.is_dir(follow_symlinks=False) else None, os.path.relpath(e.path, root).replace(os.sep, "/"), e.path)
                        for e in entries if e.name != ".git" and (e.is_dir(follow_symlinks=False) or not e.is_dir())]
                if rows:
                    yield pd.DataFrame(rows, columns=["project", "root", "folder", "path", "location"])

    # a number, because Spark would coalesce so few bytes of names into one partition again
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = spark.createDataFrame([(p, r, r) for p, r in roots.items()], "project string, root string, folder string")
    found = spark.createDataFrame([], "project string, path string, location string")
    while not todo.isEmpty():
        entries = materialize(todo.repartition(tasks, "folder").mapInPandas(listed, schema))
        found = found.unionByName(entries.where("folder is null").select("project", "path", "location"))
        todo = entries.where("folder is not null").select("project", "root", "folder")
    return found.repartition(tasks, "location")


def land_files(files: DataFrame, location: str, complete: bool = False) -> None:
    """Write files rows with their content hash, replacing the projects present.

    Comparing two landed snapshots then reads hashes, not contents.  Rows are
    sorted by path, so path filters skip row groups.  With `complete`, files
    has every project: those that it lacks are removed from the folder.
    """
    spark = files.sparkSession
    hashed = files.select(*FILES.fieldNames(), F.sha2("content", 256).alias("sha256"))
    (
        hashed.hint("rebalance", F.col("project")).sortWithinPartitions("project", "path")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy("project").parquet(location)
    )
    if complete and exists(spark, location):
        landed = spark.read.schema(LANDED).parquet(location).select("project").distinct()
        gone = landed.join(files.select("project").distinct(), "project", "left_anti")
        names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for row in gone.toLocalIterator():
            remove(spark, f"{location}/{names.getPartitionPathString('project', row.project)}")
