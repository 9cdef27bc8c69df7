"""The registry: repos, their checkouts and the joins every query starts from.

Tables are values here: an operator takes DataFrames and returns DataFrames.
Broadcasting is left to Spark's size statistics, because repos and checkouts
grow with the collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import checkout_dir, id_ref, id_repo
from ..functions.text import iso_utc


def projects(checkouts: DataFrame, repos: DataFrame) -> DataFrame:
    """Checkouts joined with their repos, under the names queries use."""
    r = repos.select(
        F.col("name").alias("repo"), "url", F.col("path").alias("repo_path"), "shallow", "fetched_at"
    )
    return checkouts.join(r, "repo").select(
        "id", "repo", "url", "repo_path", "shallow", "fetched_at",
        "ref", "kind", "commit_hash", "path", "updated_at", "parsed_at",
    )


def default_first(projects_df: DataFrame) -> DataFrame:
    """Ordered by repo, its default checkout first, then by handle."""
    return projects_df.orderBy("repo", (F.col("id") == F.col("repo")).desc(), "id")


def checkout_struct() -> Column:
    """The public shape of a checkout."""
    return F.struct(
        "id", "ref", "kind", F.col("commit_hash").alias("commit"), "path",
        iso_utc("updated_at").alias("updated_at"), iso_utc("parsed_at").alias("parsed_at"),
    )


def list_repos(checkouts: DataFrame, repos: DataFrame, per_row: int = 1000) -> DataFrame:
    """Repos with their checkouts nested, the default one first.

    A row nests about `per_row` checkouts.  A repo with more of them takes
    several rows, told apart by `part`; its default checkout is in part 0.
    """
    p = projects(checkouts, repos)
    sizes = checkouts.groupBy("repo").agg(F.ceil(F.count("*") / per_row).cast("int").alias("parts"))
    default = F.col("id") == F.col("repo")
    part = F.when(default, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    entry = F.struct((~default).alias("pinned"), F.col("id").alias("key"), checkout_struct().alias("c"))
    return (
        p.join(sizes, "repo")
        .groupBy("repo", "url", "repo_path", "shallow", "fetched_at", "parts", part.alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            F.col("repo").alias("name"), "url", F.col("repo_path").alias("path"), "shallow",
            iso_utc("fetched_at").alias("fetched_at"), "part", "parts",
            F.transform("entries", lambda e: e["c"]).alias("checkouts"),
        )
    )


def repo_checkouts(checkouts: DataFrame, repos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every checkout of the repos in `wanted(repo)`, default first."""
    return default_first(projects(checkouts, repos).join(wanted.select("repo").distinct(), "repo", "left_semi"))


def info(handles: DataFrame, checkouts: DataFrame, repos: DataFrame) -> DataFrame:
    """For each tracked handle(handle): its repo with all checkouts, and itself."""
    own = checkouts.join(handles.select(F.col("handle").alias("id")).distinct(), "id", "left_semi").select(
        F.col("id").alias("handle"), F.col("repo").alias("name"), checkout_struct().alias("checkout")
    )
    return list_repos(checkouts, repos).join(own, "name")


def lookup(requests: DataFrame, checkouts: DataFrame, repos: DataFrame) -> DataFrame:
    """requests(handle) with the checkout found, or why there is none.

    status is "ok", "no such checkout" (its repo is tracked) or "not tracked";
    `hint` says what to do.
    """
    p = projects(checkouts, repos).withColumnRenamed("id", "handle")
    base = checkouts.select(F.col("id").alias("base"), F.lit(True).alias("tracked"))
    asked = requests.select("handle").distinct().withColumn("base", id_repo("handle"))
    found = asked.join(p, "handle", "left").join(base, "base", "left")
    pinned = (id_ref("handle") != "") & F.col("tracked").isNotNull()
    status = (
        F.when(F.col("repo").isNotNull(), "ok").when(pinned, "no such checkout").otherwise("not tracked")
    )
    hint = (
        F.when(F.col("repo").isNotNull(), None)
        .when(pinned, F.concat(F.lit("pin "), id_ref("handle"), F.lit(" of "), F.col("base"), F.lit(" first")))
        .otherwise(F.lit("list the tracked repos"))
    )
    return found.select(
        "handle", status.alias("status"), hint.cast("string").alias("hint"), "repo", "ref", "kind", "commit_hash"
    )


def path_conflicts(checkouts: DataFrame) -> DataFrame:
    """Checkouts whose folder name is also another checkout's, ignoring case.

    Refs that differ only in case, or in "/" against "-", share a folder.
    The first handle of a shared folder is named; no pairs are formed.
    """
    flat = F.when(F.col("id") == F.col("repo"), F.col("repo")).otherwise(checkout_dir("repo", "ref"))
    keyed = checkouts.select("id", "repo", F.lower(flat).alias("folder"))
    shared = (
        keyed.groupBy("repo", "folder")
        .agg(F.count("*").alias("holders"), F.min("id").alias("first_id"))
        .where("holders > 1")
    )
    return keyed.join(shared, ["repo", "folder"])


def count_symbols(checkouts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Indexed symbols per checkout, zero included."""
    counts = symbols.groupBy(F.col("project").alias("id")).agg(F.count("*").alias("symbol_count"))
    return checkouts.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count")
    )
