"""Session defaults, shared scratch space and size-checked join helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings a repoloom job wants.  Broadcasts are left to Spark's own
# statistics (spark.sql.autoBroadcastJoinThreshold and its adaptive twin), so
# a side is broadcast only once its size is known.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Caps of up to this many rows per group are cut before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
}


def build_session(app: str = "repoloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder is the one named in spark.checkpoint.dir.  A local session
    without that setting (tests) gets a temporary folder; a cluster without it
    is an error, because a machine-local folder does not outlive an executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="repoloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/repoloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    Cuts the lineage of iterative jobs; the written table survives the loss
    of any executor.
    """
    spark = df.sparkSession
    path = where or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt_of: Column, salts: int) -> DataFrame:
    """Inner equi join that spreads every key of `big` over `salts` partitions.

    `small` is repeated once per salt, so a key holding a large share of
    `big` is joined by many tasks.  Rows of the result are those of the plain
    join.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def selective(df: DataFrame, key: str = "project") -> DataFrame:
    """The rows of a list of projects, marked as a selective filter.

    Every key passes the comparison, the empty one too.  Its presence lets
    Spark prune the partitions of a table joined on `key` to those in the list.
    """
    return df.where(F.col(key) >= "")


def rows_of(table: DataFrame, projects: DataFrame, salt_of: Column, salts: int = 16) -> DataFrame:
    """The rows of `table` that belong to one of projects(project).

    Partitions of other projects are not read, and a project holding a large
    share of the table is spread over `salts` tasks.
    """
    return salted_join(table, selective(projects.select("project").distinct()), ["project"], salt_of, salts)

