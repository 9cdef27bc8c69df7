"""Changes to the registry tables, as new tables.

Each operator returns what the tables should hold after the change.  Keys are
checked with semi and anti joins; nothing is collected.  `sources.tables`
writes the results; reindex() alone writes to the stored index itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import checkout_dir, checkout_id, name_from_url, ref_name_problem, repo_name_problem, source_lang
from ..session import materialize, rows_of, selective
from ..sources import tables
from .registry import count_symbols
from .symbols import build_index


def _first_of(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the least, all columns compared in order."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    return df.groupBy(key).agg(F.min(row).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def insert_repos(repos: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repos after, outcome per new name); a name can be taken once only."""
    new = new.select(*repos.columns)
    taken = repos.select("name", F.lit(True).alias("taken"))
    wanted = new.groupBy("name").agg(F.count("*").alias("asked"))
    outcome = wanted.join(taken, "name", "left").select(
        "name",
        F.when(F.col("taken"), "duplicate").when(F.col("asked") > 1, "repeated").otherwise("inserted").alias("outcome"),
    )
    fresh = _first_of(new, "name").join(repos, "name", "left_anti").select(*repos.columns)
    return repos.unionByName(fresh), outcome


def insert_checkouts(checkouts: DataFrame, repos: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checkouts after, outcome per new id); the repo has to exist."""
    known = repos.select(F.col("name").alias("repo"), F.lit(True).alias("known"))
    taken = checkouts.select("id", F.lit(True).alias("taken"))
    judged = _first_of(new.select(*checkouts.columns), "id").join(known, "repo", "left").join(taken, "id", "left")
    judged = judged.withColumn(
        "outcome", F.when(F.col("taken"), "duplicate").when(F.col("known"), "inserted").otherwise("no such repo")
    )
    fresh = judged.where("outcome = 'inserted'").select(*checkouts.columns)
    return checkouts.unionByName(fresh), judged.select("id", "outcome")


def replace_symbols(
    symbols: DataFrame, checkouts: DataFrame, new: DataFrame, parsed: DataFrame, at: Column
) -> tuple[DataFrame, DataFrame]:
    """(symbols after, checkouts after) once `parsed(project)` was re-read.

    Every project in `parsed` loses its rows and gets those of `new`, which
    may be none; its parsed_at becomes `at`.
    """
    done = parsed.select("project").distinct()
    kept = symbols.join(done, "project", "left_anti").select(*symbols.columns)
    fresh = new.join(done, "project", "left_semi").select(*symbols.columns)
    mark = done.select(F.col("project").alias("id"), F.lit(True).alias("hit"))
    stamped = checkouts.join(mark, "id", "left").withColumn(
        "parsed_at", F.when(F.col("hit"), at).otherwise(F.col("parsed_at"))
    )
    return kept.unionByName(fresh), stamped.select(*checkouts.columns)


def delete_repos(
    repos: DataFrame, checkouts: DataFrame, symbols: DataFrame, names: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(repos, checkouts, symbols after, report) without the repos in names(name).

    The report lists the removed checkouts, the default one of a repo last,
    and the names that were not found.
    """
    gone = names.select("name").distinct()
    by_repo = gone.withColumnRenamed("name", "repo")
    removed = checkouts.join(by_repo, "repo", "left_semi")
    missing = gone.join(repos, "name", "left_anti").select(
        F.col("name").alias("repo"), F.lit(None).cast("string").alias("id"), F.lit("not found").alias("outcome")
    )
    report = (
        removed.select("repo", "id", F.lit("removed").alias("outcome")).unionByName(missing)
        .orderBy("repo", F.col("id") == F.col("repo"), F.desc("id"))
    )
    return (
        repos.join(gone, "name", "left_anti").select(*repos.columns),
        checkouts.join(by_repo, "repo", "left_anti").select(*checkouts.columns),
        symbols.join(removed.select(F.col("id").alias("project")), "project", "left_anti").select(*symbols.columns),
        report,
    )


def delete_checkouts(
    checkouts: DataFrame, symbols: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checkouts, symbols after, outcome per id) without the ids given.

    The default checkout of a repo is refused: remove the repo instead.
    """
    asked = ids.select("id").distinct().join(checkouts.select("id", "repo"), "id", "left")
    outcome = asked.select(
        "id",
        F.when(F.col("repo").isNull(), "not found").when(F.col("repo") == F.col("id"), "default checkout")
        .otherwise("removed").alias("outcome"),
    )
    gone = outcome.where("outcome = 'removed'").select("id")
    return (
        checkouts.join(gone, "id", "left_anti").select(*checkouts.columns),
        symbols.join(gone.withColumnRenamed("id", "project"), "project", "left_anti").select(*symbols.columns),
        outcome,
    )


def set_snapshots(checkouts: DataFrame, moves: DataFrame) -> DataFrame:
    """Checkouts with ref, kind, commit and time of moves(id, ref, kind, commit_hash, updated_at)."""
    new = moves.select("id", F.struct("ref", "kind", "commit_hash", "updated_at").alias("new"))
    moved = checkouts.join(new, "id", "left")
    for c in ("ref", "kind", "commit_hash", "updated_at"):
        moved = moved.withColumn(c, F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)))
    return moved.select(*checkouts.columns)


def set_shallow(repos: DataFrame, flags: DataFrame) -> DataFrame:
    """Repos with the shallow flag of flags(name, shallow)."""
    new = flags.select("name", F.col("shallow").alias("new"))
    return repos.join(new, "name", "left").withColumn("shallow", F.coalesce("new", "shallow")).select(*repos.columns)


def advance(projects: DataFrame, heads: DataFrame, resolved: DataFrame, at: Column) -> DataFrame:
    """Where every checkout stands after an update, and whether to re-index it.

    heads(id, commit_hash) is the commit each checkout had checked out,
    resolved(id, kind, commit_hash, problem) what its ref names now.  A commit
    pin never moves.  A checkout changed when either hash is unknown or they
    differ; its time is stamped only when something moved.  Where heads has a
    `branch`, a checkout on a local branch has that as its ref from now on.
    """
    branch = F.col("branch") if "branch" in heads.columns else F.lit(None).cast("string")
    before = heads.select("id", F.col("commit_hash").alias("before"), branch.alias("on_branch"))
    now = resolved.select(
        "id", F.col("kind").alias("now_kind"), F.col("commit_hash").alias("now_hash"), F.col("problem").alias("why")
    )
    p = projects.join(before, "id", "left").join(now, "id", "left")
    pinned = F.col("kind") == "commit"
    blank = F.lit("")
    found = F.col("now_hash").isNotNull()
    after = F.when(pinned, F.col("commit_hash")).otherwise(F.coalesce("now_hash", blank))
    kind = F.when(pinned | ~found, F.col("kind")).otherwise(F.col("now_kind"))
    p = p.select(
        "id", "repo", F.when(pinned, F.col("ref")).otherwise(F.coalesce("on_branch", "ref")).alias("ref"), kind.alias("new_kind"), "kind", F.coalesce("before", blank).alias("prev_commit"),
        after.alias("commit"), F.col("commit_hash").alias("recorded"), "updated_at", "parsed_at",
        F.when(~pinned & ~found, F.coalesce("why", F.lit("ref not resolved"))).alias("error"),
    )
    changed = (F.col("prev_commit") == "") | (F.col("commit") == "") | (F.col("prev_commit") != F.col("commit"))
    moved = changed | (F.col("new_kind") != F.col("kind")) | (F.col("commit") != F.col("recorded"))
    ok = F.col("error").isNull()
    return p.select(
        "id", ok.alias("ok"), "ref", F.col("new_kind").alias("kind"), "prev_commit",
        F.when(ok, F.col("commit")).otherwise(F.col("recorded")).alias("commit"),
        (ok & changed).alias("changed"),
        F.when(ok & moved, at).otherwise(F.col("updated_at")).alias("updated_at"),
        (ok & (changed | F.col("parsed_at").isNull())).alias("reindex"),
        "error",
    )


def reindex(files: DataFrame, moved: DataFrame, root: str, at: Column) -> DataFrame:
    """Bring the stored index of the checkouts in moved(id, commit_hash) to these commits.

    Returns (id, symbol_count, parsed_at, index_error) for each of them.  A
    checkout whose index is of its commit already is left alone, so a batch
    that is run again writes nothing.  An unknown commit (null or empty) is
    never taken for the indexed one.  A checkout without files, or with source
    files that could not be read (null content), keeps its old index and time
    and has an error.  files(project, path, content) holds the current files
    of every checkout, under its id.
    """
    spark = files.sparkSession
    moved = materialize(moved.select(F.col("id").alias("project"), "commit_hash").dropDuplicates(["project"]))
    marks = tables.read_marks(spark, root).join(selective(moved.select("project")), "project", "left_semi")
    same = marks.where("commit_hash <> ''").select("project", "commit_hash")
    todo = materialize(moved.join(same, ["project", "commit_hash"], "left_anti"))
    held = rows_of(files, todo, F.col("path"))
    unread = F.col("content").isNull() & source_lang("path").isNotNull()
    health = held.groupBy("project").agg(F.count("*").alias("files"), F.sum(unread.cast("long")).alias("unread"))
    error = F.when(F.col("files").isNull(), "no files landed").when(
        F.col("unread") > 0, F.concat(F.col("unread").cast("string"), F.lit(" source files could not be read")))
    judged = materialize(todo.join(health, "project", "left").select("project", "commit_hash", error.alias("index_error")))
    good = judged.where("index_error is null").select("project", "commit_hash", at.alias("parsed_at"))
    if not good.isEmpty():
        tables.write_symbols(build_index(rows_of(files, good, F.col("path"))), good, root)
    asked = selective(moved.select("project"))
    counts = tables.read_index(spark, root).join(asked, "project", "left_semi").groupBy("project").agg(F.count("*").alias("symbol_count"))
    times = tables.read_marks(spark, root).join(asked, "project", "left_semi").select("project", "parsed_at")
    return materialize(moved.select("project").join(judged, "project", "left").join(counts, "project", "left").join(times, "project", "left").select(
        F.col("project").alias("id"), F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count"), "parsed_at", "index_error"))


def reindex_advanced(advanced: DataFrame, files: DataFrame, root: str, at: Column) -> DataFrame:
    """reindex() of the checkouts that advance() marks, at the commits they moved to."""
    return reindex(files, advanced.where("reindex").select("id", F.col("commit").alias("commit_hash")), root, at)


def update_report(advanced: DataFrame, checkouts: DataFrame, symbols: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """One row per checkout: outcome, commits and the size of its index.

    A checkout that could not be advanced shows its error and nothing else.
    `symbols` is the index after the update; with indexed(id, index_error) of
    reindex_advanced(), `reindex_error` says why an advanced checkout keeps
    its old index.
    """
    count = F.when(F.col("ok"), F.col("symbol_count"))
    rows = advanced.join(count_symbols(checkouts, symbols), "id", "left")
    if indexed is not None:
        rows = rows.join(indexed.select("id", F.col("index_error").alias("reindex_error")), "id", "left")
    return rows.select(
        F.col("id").alias("name"), "ok",
        *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("ref", "kind", "prev_commit", "commit")], "changed",
        F.coalesce(count, F.lit(0)).cast("long").alias("symbol_count"), "error", *(["reindex_error"] if indexed is not None else []),
    )


def with_index(outcome: DataFrame, files: DataFrame, root: str, at: Column) -> DataFrame:
    """The outcome of register_fetch() or pin_checkouts() after the accepted checkouts were indexed.

    Adds `index_error`, and sets `parsed_at` and `symbol_count` of the
    accepted rows.  An index that fails does not undo a registration, and a
    batch that is run again leaves indexed commits alone.
    """
    handle = "id" if "id" in outcome.columns else "name"
    outcome = materialize(outcome)
    fresh = outcome.where("outcome in ('registered', 'pinned')").select(F.col(handle).alias("id"), "commit_hash")
    done = reindex(files, fresh, root, at).select(
        F.col("id").alias(handle), F.col("symbol_count").alias("new_count"), F.col("parsed_at").alias("new_parsed"), "index_error", F.lit(True).alias("fresh"))
    taken = F.col("fresh") & F.col("outcome").isin("registered", "pinned")
    old_count = F.col("symbol_count") if "symbol_count" in outcome.columns else F.lit(0).cast("long")
    old_parsed = F.col("parsed_at") if "parsed_at" in outcome.columns else F.lit(None).cast("timestamp_ntz")
    kept = [c for c in outcome.columns if c not in ("symbol_count", "parsed_at")]
    return outcome.join(done, handle, "left").select(
        *kept, F.when(taken, F.col("new_count")).otherwise(old_count).alias("symbol_count"),
        F.when(taken, F.col("new_parsed")).otherwise(old_parsed).alias("parsed_at"), F.when(taken, F.col("index_error")).alias("index_error"))


def register_fetch(repos: DataFrame, checkouts: DataFrame, arrivals: DataFrame, root: str, at: Column) -> DataFrame:
    """Outcome of arrivals(url, name, ref, kind, commit_hash, shallow).

    The name defaults to the one the URL implies; outcome is "registered" or
    why not.  Of several arrivals with one name the first by URL, ref and
    commit has it.  `new_repos` and `new_checkouts` turn it into rows to insert.
    """
    name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(name_from_url("url"))
    taken = checkouts.select(F.col("id").alias("name")).union(repos.select("name")).distinct().withColumn("taken", F.lit(True))
    claim = Window.partitionBy("name").orderBy("url", "ref", "commit_hash")
    named = arrivals.withColumn("name", name).withColumn("claim", F.row_number().over(claim))
    problem = (
        F.when(F.col("name") == "", "no name in URL")
        .when(repo_name_problem("name").isNotNull(), F.concat(F.lit("bad name: "), repo_name_problem("name")))
        .when(F.col("taken"), "already tracked")
        .when(F.col("claim") > 1, "name claimed by another arrival")
    )
    return named.join(taken, "name", "left").select(
        "url", "name", F.coalesce(problem, F.lit("registered")).alias("outcome"),
        F.coalesce("ref", F.lit("")).alias("ref"), "kind", "commit_hash", "shallow",
        F.concat(F.lit(root.rstrip("/") + "/"), "name").alias("path"), at.alias("at"),
    )


def new_repos(outcome: DataFrame) -> DataFrame:
    """repos rows of the registered arrivals."""
    return outcome.where("outcome = 'registered'").select(
        "name", "url", "path", "shallow", F.col("at").alias("fetched_at")
    ).distinct()


def new_checkouts(outcome: DataFrame) -> DataFrame:
    """checkouts rows of the registered arrivals or pins."""
    fresh = outcome.where("outcome in ('registered', 'pinned')")
    handle = F.col("id") if "id" in outcome.columns else F.col("name")
    repo = F.col("repo") if "repo" in outcome.columns else F.col("name")
    return fresh.select(
        handle.alias("id"), repo.alias("repo"), "ref", "kind", "commit_hash", "path", F.col("at").alias("updated_at"),
        (F.col("parsed_at") if "parsed_at" in outcome.columns else F.lit(None)).cast("timestamp_ntz").alias("parsed_at"),
    ).distinct()


def pin_checkouts(
    checkouts: DataFrame, symbols: DataFrame, pins: DataFrame, resolved: DataFrame, root: str, at: Column
) -> DataFrame:
    """Outcome of pins(repo, ref): existing (as stored, with its symbol count), pinned, or why not.

    resolved(repo, ref, kind, commit_hash) names the commits; a pin whose
    path another checkout of the repo uses (ignoring case) is refused, and so
    is the later one of two pins that would share a folder.
    """
    base = root.rstrip("/") + "/"
    counts = count_symbols(checkouts, symbols)
    asked = (
        pins.select("repo", "ref").distinct()
        .withColumn("id", checkout_id("repo", "ref"))
        .withColumn("folder", checkout_dir("repo", "ref"))
    )
    default = checkouts.where("id = repo").select("repo", F.lit(True).alias("tracked"))
    existing = checkouts.join(counts, "id").select(
        "id", "symbol_count", F.lit(True).alias("exists"), F.col("kind").alias("old_kind"), F.col("commit_hash").alias("old_hash"), F.col("path").alias("old_path"),
        F.col("parsed_at").alias("old_parsed"))
    used = checkouts.where("id <> repo").groupBy("repo", F.lower("path").alias("held")).agg(F.min("id").alias("holder"))
    claims = asked.groupBy("repo", F.lower("folder").alias("key")).agg(F.min("id").alias("claimer"))
    what = resolved.select("repo", "ref", "kind", "commit_hash")
    j = (
        asked.withColumn("key", F.lower("folder")).withColumn("held", F.lower(F.concat(F.lit(base), "folder")))
        .join(default, "repo", "left").join(existing, "id", "left").join(used, ["repo", "held"], "left")
        .join(claims, ["repo", "key"]).join(what, ["repo", "ref"], "left")
    )
    problem = (
        F.when(ref_name_problem("ref").isNotNull(), F.concat(F.lit("bad ref: "), ref_name_problem("ref")))
        .when(F.col("tracked").isNull(), "not tracked")
        .when(F.col("exists"), "existing")
        .when(F.col("holder").isNotNull(), F.concat(F.lit("folder used by "), F.col("holder")))
        .when(F.col("claimer") != F.col("id"), F.concat(F.lit("folder used by "), F.col("claimer")))
        .when(F.col("commit_hash").isNull(), "ref not resolved")
        .otherwise("pinned")
    )
    return j.select(
        "id", "repo", "ref", problem.alias("outcome"), F.when(F.col("exists"), F.col("old_kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("exists"), F.col("old_hash")).otherwise(F.col("commit_hash")).alias("commit_hash"),
        F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count"),
        F.when(F.col("exists"), F.col("old_path")).otherwise(F.concat(F.lit(base), "folder")).alias("path"), at.alias("at"),
        F.when(F.col("exists"), F.col("old_parsed")).alias("parsed_at"),
    )
