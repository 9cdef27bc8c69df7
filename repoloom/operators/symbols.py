"""Symbols: extracting, indexing and querying definitions."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import SOURCE_LANGS, in_skipped_dir, source_lang
from ..functions.scan import CONTAINERS, definitions, enclosing
from ..functions.text import like_ascii_ci, name_pattern, name_pattern_col, split_list
from ..session import salted_join
from .limits import cap_all, cap_per_group

DEFAULT_LIMIT = 500
SYMBOL_COLUMNS = ["project", "path", "name", "kind", "line", "end_line", "parent", "lang"]
DEFINITIONS = (
    "project string, path string, def_ix int, name string, kind string, line int, end_line int, "
    "start_byte long, end_byte long, lang string, head string, container string"
)


def extract_definitions(files: DataFrame, skip_dirs: bool = True) -> DataFrame:
    """Definitions of every supported source file, in one pass without a shuffle.

    `container` is the smallest class, interface, struct or enum around a
    definition; `head` holds the first 120 bytes of a Go method.  A file that
    cannot be read as source yields nothing.
    """
    sources = files.withColumn("lang", source_lang("path")).where(F.col("lang").isNotNull())
    if skip_dirs:
        sources = sources.where(~in_skipped_dir("path"))
    columns = [c.split()[0] for c in DEFINITIONS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.itertuples(index=False):
                rows.extend(_rows(row.project, row.path, row.lang, row.content))
            yield pd.DataFrame(rows, columns=columns)

    narrow = sources.select("project", "path", "lang", F.col("content").cast("binary").alias("content"))
    return narrow.mapInPandas(run, DEFINITIONS)


def _rows(project: str, path: str, lang: str, content: bytes | None) -> list[tuple]:
    if content is None:
        return []
    source = bytes(content)
    found = definitions(source, lang)
    if not found:
        return []
    newlines = [i for i, b in enumerate(source) if b == 10]
    parents = enclosing([d.start for d in found], [d.end for d in found], [d.kind for d in found])
    out = []
    for ix, (d, up) in enumerate(zip(found, parents)):
        head = source[d.start : d.end][:120].decode("utf-8", "replace") if lang == "go" and d.kind == "method" else None
        out.append((
            project, path, ix, d.name, d.kind, bisect_right(newlines, d.name_at - 1) + 1,
            bisect_right(newlines, d.end - 1) + 1, d.start, d.end, lang, head, found[up].name if up >= 0 else None,
        ))
    return out


def enclosing_parents(defs: DataFrame) -> DataFrame:
    """`container` for definitions given as rows: the name of the smallest class, interface, struct or enum around each.

    A container is never its own parent, and of equal ranges the first wins.
    Ranges of a parsed file nest.  Then opening and closing containers in the
    order of their bytes gives each definition the number of containers open
    around it, and its parent is the last one that was opened at that level,
    so neither pairs nor groups are formed.  In a file with ranges that cross
    or are empty, which the parents found this way show, every definition is
    compared with the containers of its file.
    """
    file = ["project", "path"]
    holds = F.col("kind").isin(*CONTAINERS)
    same = Window.partitionBy(*file, "start_byte", "end_byte")
    own = F.array_sort(F.collect_list(F.when(holds, F.struct("def_ix", "name"))).over(same))
    rows = defs.drop("container").withColumn("_twins", own)
    first = F.get("_twins", F.lit(0))["def_ix"]
    rows = rows.withColumn("_rep", F.coalesce(holds & (first == F.col("def_ix")), F.lit(False)))
    twin = F.when(first == F.col("def_ix"), F.get("_twins", F.lit(1))["name"]).otherwise(F.get("_twins", F.lit(0))["name"])
    rows = rows.withColumn("_twin", twin).drop("_twins")

    # Closing comes before opening at the same byte, and the container of a range after other definitions with that range.
    opens = F.struct(F.lit(1).alias("delta"), F.col("start_byte").alias("at"), F.lit(1).alias("phase"), (-F.col("end_byte")).alias("back"))
    closes = F.struct(F.lit(-1).alias("delta"), F.col("end_byte").alias("at"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("back"))
    events = rows.select("*", F.explode(F.when(F.col("_rep"), F.array(opens, closes)).otherwise(F.array(opens))).alias("_e"))
    order = [F.col("_e.at"), F.col("_e.phase"), F.col("_e.back"), F.col("_rep"), F.col("def_ix")]
    before = Window.partitionBy(*file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.when(F.col("_rep"), F.col("_e.delta"))).over(before), F.lit(0))
    placed = events.withColumn("_depth", depth).where("_e.phase = 1")

    # As a seeker a row looks at its own level, as a provider it stands on the next one.
    provider = F.when(F.col("_rep"), F.struct("name", "end_byte"))
    roles = F.array_compact(F.array(
        F.struct(F.col("_depth").alias("level"), F.lit(None).cast("struct<name:string,end_byte:bigint>").alias("given")),
        F.when(F.col("_rep"), F.struct((F.col("_depth") + 1).alias("level"), provider.alias("given")))))
    levels = placed.select("*", F.explode(roles).alias("_r"))
    earlier = Window.partitionBy(*file, "_r.level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = levels.withColumn("_up", F.when(F.col("_r.level") > 0, F.last("_r.given", ignorenulls=True).over(earlier))).where("_r.given is null")
    odd = (F.col("_up.end_byte") < F.col("end_byte")) | (F.col("start_byte") >= F.col("end_byte"))
    found = found.withColumn("_odd", F.max(F.coalesce(odd, F.lit(False))).over(Window.partitionBy(*file)))
    kept = [c for c in rows.columns if not c.startswith("_")]
    nested = found.where("not _odd").select(*kept, F.coalesce("_twin", "_up.name").alias("container"))

    crossed = found.where("_odd").select(*kept)
    boxes = crossed.where(holds).groupBy(*file).agg(F.collect_list(F.struct(
        (F.col("end_byte") - F.col("start_byte")).alias("span"), "def_ix", "name", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))).alias("_boxes"))
    around = F.filter("_boxes", lambda c: (c["s"] <= F.col("start_byte")) & (c["e"] >= F.col("end_byte")) & (c["def_ix"] != F.col("def_ix")))
    others = crossed.join(boxes, file, "left").select(*kept, F.array_min(around)["name"].alias("container"))
    return nested.unionByName(others)


def normalize_kind(tag: Column) -> Column:
    """"definition.x" gives x; any other tag gives null."""
    kind = F.regexp_extract(tag, r"(?s)\Adefinition\.(.+)\z", 1)
    return F.when(kind != "", kind)


def go_receiver(head: Column) -> Column:
    """Receiver type of a Go method from the start of its text, else null."""
    name = F.regexp_extract(
        F.substring(head, 1, 120),
        r"\A\s*func\s*\(\s*\w+\s+\*?\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:\[[^\]]*\])?\s*\)", 1,
    )
    return F.when(name != "", name)


def to_symbols(defs: DataFrame) -> DataFrame:
    """Symbol rows: receivers name the parent of Go methods, and a function
    inside a container becomes a method."""
    receiver = F.when((F.col("lang") == "go") & (F.col("kind") == "method"), go_receiver(F.col("head")))
    held = receiver.isNull() & F.col("container").isNotNull()
    kind = F.when(held & (F.col("kind") == "function"), "method").otherwise(F.col("kind"))
    return defs.select(
        "project", "path", "def_ix", "name", kind.alias("kind"), "line", "end_line",
        F.coalesce(receiver, "container").alias("parent"), "lang",
    )


def build_index(files: DataFrame) -> DataFrame:
    """The symbol index of every checkout in `files`."""
    return to_symbols(extract_definitions(files)).select(*SYMBOL_COLUMNS)


def extract_totals(files: DataFrame) -> DataFrame:
    """Files parsed and symbols found per project; projects without sources count 0."""
    is_parsed = source_lang("path").isNotNull() & ~in_skipped_dir("path")
    listed = files.groupBy("project").agg(F.count(F.when(is_parsed, 1)).alias("files_parsed"))
    found = build_index(files).groupBy("project").agg(F.count("*").alias("symbols"))
    return listed.join(found, "project", "left").select(
        "project", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files_parsed", "symbols")]
    )


def check_langs(langs: Sequence[str]) -> list[str]:
    """Languages as a clean list; an unknown one is an error."""
    wanted = split_list(list(langs))
    known = sorted(set(SOURCE_LANGS.values()))
    for lang in wanted:
        if lang not in known:
            raise ValueError(f"unsupported language {lang!r}; supported: {', '.join(known)}")
    return wanted


def filter_symbols(
    symbols: DataFrame, name: str = "", kinds: Sequence[str] = (), langs: Sequence[str] = (), projects: Sequence[str] = ()
) -> DataFrame:
    """Symbols within every given filter; a filter left empty lets all pass."""
    keep = F.lit(True)
    if projects:
        keep = keep & F.col("project").isin(list(projects))
    if name:
        keep = keep & like_ascii_ci("name", name_pattern(name))
    if kinds := split_list(list(kinds)):
        keep = keep & F.col("kind").isin(kinds)
    if langs := check_langs(langs):
        keep = keep & F.col("lang").isin(langs)
    return symbols.where(keep)


def _shown(symbols: DataFrame, *more: str) -> DataFrame:
    return symbols.select(*SYMBOL_COLUMNS, *more)


def symbols_in_project(
    symbols: DataFrame, project: str, name: str = "", kinds: Sequence[str] = (), langs: Sequence[str] = (),
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Symbols of one checkout by path, line and name, capped."""
    found = filter_symbols(symbols, name, kinds, langs, [project])
    return _shown(cap_all(found, ["project", "path", "line", "name"], limit), "truncated").orderBy("path", "line", "name")


def symbols_across(
    symbols: DataFrame, name: str = "", kinds: Sequence[str] = (), langs: Sequence[str] = (),
    projects: Sequence[str] = (), limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Symbols of all or the listed checkouts; needs a name, kind or language."""
    if not (name or kinds or langs):
        raise ValueError("a query over all checkouts needs a name, a kind or a language")
    found = filter_symbols(symbols, name, kinds, langs, projects)
    order = ["project", "path", "line", "name"]
    return _shown(cap_all(found, order, limit), "truncated").orderBy(*order)


def symbols_in_file(
    files: DataFrame, project: str, path: str, name: str = "", kinds: Sequence[str] = (), langs: Sequence[str] = (),
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Symbols of one file, parsed now, in source order."""
    one = files.where((F.col("project") == project) & (F.col("path") == path))
    found = filter_symbols(to_symbols(extract_definitions(one, skip_dirs=False)), name, kinds, langs)
    return cap_all(found, ["def_ix"], limit).select("path", "name", "kind", "line", "end_line", "parent", "lang", "def_ix", "truncated").orderBy("def_ix")


REQUESTS = "req_id string, project string, name string, kinds array<string>, langs array<string>, limit int"


def find_symbols_batch(symbols: DataFrame, requests: DataFrame, limit: int = DEFAULT_LIMIT, salts: int = 8) -> DataFrame:
    """Many symbol requests, each against its checkout, each with its cap.

    A request's own limit goes before `limit`; 0 keeps all.  Null lists, like
    empty ones, let all pass.
    """
    none = F.array().cast("array<string>")
    cap = F.coalesce("limit", F.lit(limit)) if "limit" in requests.columns else F.lit(limit)
    asked = requests.select(
        "req_id", "project", name_pattern_col(F.coalesce("name", F.lit(""))).alias("pattern"), F.coalesce("kinds", none).alias("kinds"),
        F.coalesce("langs", none).alias("langs"), cap.alias("cap"))
    pairs = salted_join(symbols, asked, ["project"], F.concat("path", "name"), salts)
    keep = (
        ((F.col("pattern") == "") | like_ascii_ci("name", F.col("pattern")))
        & ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind")))
        & ((F.size("langs") == 0) | F.array_contains("langs", F.col("lang")))
    )
    found = _shown(pairs.where(keep), "req_id", "cap")
    if "limit" not in requests.columns:
        return cap_per_group(found.drop("cap"), ["req_id"], ["path", "line", "name"], limit)
    order = Window.partitionBy("req_id").orderBy("path", "line", "name")
    ranked = found.withColumns({"_rn": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy("req_id"))})
    kept = ranked.where((F.col("cap") <= 0) | (F.col("_rn") <= F.col("cap")))
    return kept.withColumn("truncated", (F.col("cap") > 0) & (F.col("_all") > F.col("cap"))).drop("_rn", "_all", "cap")


def compare_versions(symbols: DataFrame, pairs: DataFrame) -> DataFrame:
    """What symbols two checkouts do not share.

    pairs(old, new) names the checkouts.  Symbols are counted per path, name,
    kind and parent; status is "added", "removed", "moved" (other lines) or
    "recounted".  Unchanged ones are left out.
    """
    key = ["path", "name", "kind", "parent"]
    # -1 and +1 sides meet in one aggregation instead of a full join.
    sides = pairs.select(F.posexplode(F.array("old", "new")).alias("side", "project"), "old", "new")
    tagged = salted_join(symbols, sides, ["project"], F.col("path"), 8).withColumn("parent", F.coalesce("parent", F.lit("")))
    # Tasks are sized by the rows that meet, not by the rows the symbols came from; the aggregation needs no other shuffle.
    tagged = tagged.repartition("old", "new", "path")
    at = lambda side, what: F.coalesce(what(F.when(F.col("side") == side, F.col("line"))), F.lit(0))
    merged = tagged.groupBy("old", "new", *key).agg(
        at(0, F.count).alias("n_old"), at(1, F.count).alias("n_new"),
        at(0, F.min).alias("old_line"), at(1, F.min).alias("new_line"),
        at(0, F.sum).alias("s_old"), at(1, F.sum).alias("s_new"),
    )
    status = (
        F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed")
        .when(F.col("n_old") != F.col("n_new"), "recounted")
        .when((F.col("s_old") != F.col("s_new")) | (F.col("old_line") != F.col("new_line")), "moved")
    )
    return merged.withColumn("status", status).where("status is not null").select(
        "old", "new", *key, "status", "old_line", "new_line"
    )


