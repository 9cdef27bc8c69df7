"""Stored tables: the symbol index and small registry tables.

Layout below a root folder: `symbols/project=<id>/...`, `lookup/bucket=<n>/...`
if wanted, one folder per registry table and version, and `_schema_version`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_lower, name_pattern, split_list
from ..session import materialize, selective

SCHEMA_VERSION = 1
LOOKUP_BUCKETS = 64

SYMBOLS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("parent", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("project", T.StringType()),
])

# What the mark row of an indexed checkout says: the commit that was parsed, and when.
MARK = [T.StructField("commit_hash", T.StringType()), T.StructField("parsed_at", T.TimestampNTZType())]
STORED = T.StructType([*SYMBOLS.fields[:-1], *MARK, SYMBOLS.fields[-1]])


def _fs(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, location: str) -> bool:
    """Whether the folder is there."""
    fs, path = _fs(spark, location)
    return fs.exists(path)


def remove(spark: SparkSession, location: str) -> None:
    """Delete a folder of this store."""
    fs, path = _fs(spark, location)
    fs.delete(path, True)


def read_symbols(spark: SparkSession, root: str) -> DataFrame:
    """The stored rows, symbols and marks; filters on `project` prune partitions."""
    location = f"{root}/symbols"
    if not exists(spark, location):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(location)


def write_symbols(symbols: DataFrame, parsed: DataFrame, root: str) -> None:
    """Replace the index of every project in parsed(project, and commit_hash and parsed_at if they are known).

    A project left without symbols still has to lose its old rows, which a
    dynamic overwrite alone would keep: every project gets one mark row with a
    null name, which also keeps the commit, and `read_index` leaves those out.
    """
    rows = symbols.select(*SYMBOLS.fieldNames())
    spark = symbols.sparkSession
    if exists(spark, f"{root}/lookup"):
        # First the lookup: a job that ends between the writes leaves terms without symbols, never symbols without terms.
        rows = materialize(rows.join(parsed.select("project").distinct(), "project", "left_semi").select(*SYMBOLS.fieldNames()))
        _add_terms(rows, root)
    known = {f.name: F.col(f.name) if f.name in parsed.columns else F.lit(None).cast(f.dataType) for f in MARK}
    done = parsed.select("project", *[c.alias(n) for n, c in known.items()]).dropDuplicates(["project"])
    marks = done.select("project", *known, *[F.lit(None).cast(f.dataType).alias(f.name) for f in SYMBOLS.fields if f.name != "project"])
    plain = rows.join(done.select("project"), "project", "left_semi").select(
        *SYMBOLS.fieldNames(), *[F.lit(None).cast(f.dataType).alias(f.name) for f in MARK])
    out = plain.unionByName(marks).select(*STORED.fieldNames())
    (
        # Rebalance splits a huge project over several files and keeps small
        # ones in one; sorting by name lets footers skip row groups.
        out.hint("rebalance", F.col("project")).sortWithinPartitions("project", "name")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("project").parquet(f"{root}/symbols")
    )


def drop_symbols(removed: DataFrame, root: str) -> None:
    """Empty the index of the checkouts in removed(project) that are stored.

    Their partitions are replaced by a mark without a commit, in one write by
    the tasks; only the partitions of the removed checkouts are looked at.  A
    checkout that comes back is indexed like a new one.
    """
    spark = removed.sparkSession
    there = read_symbols(spark, root).where("name is null").join(selective(removed.select("project").distinct()), "project", "left_semi")
    write_symbols(spark.createDataFrame([], SYMBOLS), there.select("project"), root)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """Symbols proper, without the rows that mark a project as indexed."""
    return read_symbols(spark, root).where(F.col("name").isNotNull()).select(*SYMBOLS.fieldNames())


def _terms(symbols: DataFrame) -> DataFrame:
    """(project, term, bucket): three neighbouring characters of folded names, kinds and languages, each once per project."""
    folded = ascii_lower("name")
    grams = F.when(F.char_length("name") >= 3, F.transform(
        F.sequence(F.lit(1), F.char_length("name") - 2), lambda at: F.concat(F.lit("n:"), F.substring(folded, at, F.lit(3)))))
    names = symbols.select("project", "name").distinct().select("project", F.explode(grams).alias("term"))
    flags = symbols.select("project", F.explode(F.array(F.concat(F.lit("k:"), "kind"), F.concat(F.lit("l:"), "lang"))).alias("term"))
    return names.unionByName(flags).where("term is not null").distinct().withColumn("bucket", (F.crc32("term") % LOOKUP_BUCKETS).cast("int"))


def _add_terms(symbols: DataFrame, root: str) -> None:
    _terms(symbols).repartition("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{root}/lookup")


def create_lookup(spark: SparkSession, root: str) -> None:
    """Build the lookup of the stored index; from then on write_symbols keeps it.

    Terms of symbols that are gone stay until the lookup is built again; they
    cost a look at a checkout, never a wrong row.
    """
    found = materialize(_terms(read_index(spark, root)))
    remove(spark, f"{root}/lookup")
    found.repartition("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/lookup")


def read_lookup(spark: SparkSession, root: str, name: str = "", kinds: Sequence[str] = (), langs: Sequence[str] = ()) -> DataFrame:
    """The stored index of the checkouts that can hold an asked name, kind and language; filters still have to be applied.

    A checkout is read only if the lookup has all three-character pieces of
    the pattern's literal parts for it, one of the kinds and one of the
    languages.  A request without any of these reads the whole index.
    """
    literal = re.split("[%_]", name_pattern(name).translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    grams = {f"n:{part[at:at + 3]}" for part in literal for at in range(len(part) - 2)}
    flags = [{f"{mark}:{value}" for value in split_list(list(values))} for mark, values in (("k", kinds), ("l", langs))]
    terms = grams.union(*flags)
    index = read_index(spark, root)
    if not terms or not exists(spark, f"{root}/lookup"):
        return index
    buckets = sorted({zlib.crc32(term.encode()) % LOOKUP_BUCKETS for term in terms})
    schema = T.StructType([T.StructField("project", T.StringType()), T.StructField("term", T.StringType()), T.StructField("bucket", T.IntegerType())])
    found = spark.read.schema(schema).parquet(f"{root}/lookup").where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(terms)))
    # kinds and languages are alternatives, pieces of a name are all needed
    need = F.when(F.col("term").startswith("n:"), F.col("term")).otherwise(F.substring("term", 1, 2))
    wanted = len(grams) + sum(bool(f) for f in flags)
    there = materialize(found.groupBy("project").agg(F.count_distinct(need).alias("n")).where(F.col("n") == wanted).select("project"))
    return index.join(selective(there), "project", "left_semi").select(*SYMBOLS.fieldNames())


def read_marks(spark: SparkSession, root: str) -> DataFrame:
    """(project, commit_hash, parsed_at) of the checkouts that are indexed."""
    return read_symbols(spark, root).where("name is null and parsed_at is not null").select("project", "commit_hash", "parsed_at")


def save_table(df: DataFrame, root: str, name: str) -> None:
    """Write a new version of a registry table, then make it the current one.

    The old version stays readable while the new one is written, so a table
    may be rewritten from itself.
    """
    spark = df.sparkSession
    version = current_version(spark, root, name) + 1
    df.write.mode("overwrite").parquet(f"{root}/{name}/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/{name}/log")


def current_version(spark: SparkSession, root: str, name: str) -> int:
    """Latest complete version of a registry table, 0 when there is none."""
    log = f"{root}/{name}/log"
    if not exists(spark, log):
        return 0
    return spark.read.schema("version int").json(log).agg(F.max("version")).first()[0] or 0


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a registry table."""
    return spark.read.parquet(f"{root}/{name}/v{current_version(spark, root, name)}")


def ensure_schema(spark: SparkSession, root: str, version: int = SCHEMA_VERSION) -> bool:
    """Reset a store written by another schema version; True when it was reset."""
    mark = f"{root}/_schema_version"
    found = spark.read.schema("version int").json(mark).first() if exists(spark, mark) else None
    if found and found.version == version:
        return False
    had_tables = False
    for name in ("repos", "checkouts", "symbols", "lookup"):
        if exists(spark, f"{root}/{name}"):
            had_tables = True
            remove(spark, f"{root}/{name}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("overwrite").json(mark)
    return had_tables
