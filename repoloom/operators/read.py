"""Reading files and line ranges into numbered, XML-safe elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import clean_path, not_git, path_problem
from ..functions.text import (
    READ_MAX_KB, SEARCH_MAX_BYTES, byte_len, cdata_escape, is_text, let, line_range, lines_clean, number_lines, xml_attr,
)
from ..session import selective

VERSION = "1"


def _folders(files: DataFrame, missing: DataFrame) -> DataFrame:
    """Which unmatched (project, target) are folders of some file."""
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    known = files.select("project", F.explode(above).alias("target"))
    asked = selective(missing.select("project", "target").distinct())
    return known.join(asked, ["project", "target"], "left_semi").distinct().withColumn("is_dir", F.lit(True))


def read_files(files: DataFrame, requests: DataFrame, max_kb: int = READ_MAX_KB) -> DataFrame:
    """One element per request(req_id, project, path, pos, line_range).

    Columns: req_id, pos, path, first and last line emitted, error, note and
    the XML element.  Checks run in this order: path, missing, folder, size,
    binary, line range, range past the end.
    """
    asked = requests.select(
        "*", clean_path("path").alias("target"), path_problem("path").alias("unsafe"), line_range("line_range").alias("r")
    )
    size = F.col("size") if "size" in files.columns else byte_len("content")
    stored = files.where(not_git("path")).select(
        "project", F.col("path").alias("target"), size.cast("long").alias("size"), "content"
    )
    # Contents are narrowed to the requested files first: that side of a semi join may be broadcast.
    wanted = stored.join(selective(asked.select("project", "target").distinct()), ["project", "target"], "left_semi")
    found = asked.join(wanted, ["project", "target"], "left")
    dirs = _folders(files.where(not_git("path")), asked.join(stored.select("project", "target"), ["project", "target"], "left_anti"))
    j = found.join(dirs, ["project", "target"], "left")

    whole = F.lit(max(max_kb if max_kb > 0 else READ_MAX_KB, 0) * 1024)
    limit = F.when(F.col("line_range") != "", F.greatest(whole, F.lit(SEARCH_MAX_BYTES))).otherwise(whole)
    # Requests are parsed before the join, once each.
    rng = F.col("r")
    error = (
        F.when(F.col("unsafe").isNotNull(), F.col("unsafe"))
        .when(F.col("is_dir"), "is a directory")
        .when(F.col("content").isNull(), "stat: no such file")
        .when(F.col("size") > limit, F.concat(
            F.lit("exceeds --max-size limit ("), F.col("size").cast("string"), F.lit(" bytes > "),
            limit.cast("string"), F.lit(" bytes)")))
        .when(~is_text("content"), F.concat(F.lit("binary file ("), F.col("size").cast("string"), F.lit(" bytes), not emitted")))
        .when(rng["problem"].isNotNull(), F.concat(F.lit("lines flag: "), rng["problem"]))
    )
    checked = j.select("req_id", "pos", "path", error.alias("error"), "r", "content")
    body = F.when(F.col("error").isNull(), let(lines_clean("content"), lambda lines: _slice(lines, F.col("r"))))
    return checked.withColumn("b", body).select(
        "req_id", "pos", "path", F.col("b.first").alias("first"), F.col("b.last").alias("last"), "error",
        F.col("b.note").alias("note"),
        F.when(F.col("error").isNotNull(), _empty_element("error", F.col("error")))
        .when(F.col("b.note").isNotNull(), _empty_element("note", F.col("b.note")))
        .otherwise(F.concat(
            F.lit("  <file path="), xml_attr("path"), F.lit(' lines="'), F.col("b.first").cast("string"), F.lit("-"),
            F.col("b.last").cast("string"), F.lit('">\n<![CDATA[\n'), F.col("b.text"), F.lit("]]>\n  </file>\n"),
        )).alias("xml"),
    )


def _empty_element(attribute: str, message: Column) -> Column:
    return F.concat(F.lit("  <file path="), xml_attr("path"), F.lit(f" {attribute}="), xml_attr(message), F.lit("/>\n"))


def _slice(lines: Column, rng: Column) -> Column:
    """struct(first, last, note, text) of a range clamped to the file."""
    total = F.size(lines).cast("long")
    first = F.greatest(rng["first"], F.lit(1).cast("long"))
    last = F.when((rng["last"] == 0) | (rng["last"] > total), total).otherwise(rng["last"])
    outside = first > last
    note = F.concat(
        F.lit("requested lines "), rng["first"].cast("string"), F.lit("-"), rng["last"].cast("string"),
        F.lit(" out of range: file has "), total.cast("string"), F.lit(" lines"),
    )
    count = F.greatest(last - first + 1, F.lit(0).cast("long")).cast("int")
    start = F.least(first, total + 1).cast("int")
    numbered = number_lines(F.slice(lines, start, count), first, F.length(last.cast("string")))
    # A line prefix ends in a blank, so escaping the whole is escaping each line.
    text = cdata_escape(F.when(F.size(numbered) > 0, F.concat(F.array_join(numbered, "\n"), F.lit("\n"))).otherwise(""))
    return F.struct(
        F.when(~outside, first).alias("first"), F.when(~outside, last).alias("last"),
        F.when(outside, note).alias("note"), F.when(~outside, text).alias("text"),
    )


def bundle(elements: DataFrame, files_per_part: int = 100) -> DataFrame:
    """Documents per request, in parts of a bounded number of positions.

    A request's document is its parts in order, put together.  `pos` orders
    the elements; a part covers `files_per_part` positions, so no task holds
    the whole of a large request.  The first part opens the document and the
    last one closes it.
    """
    part = F.floor(F.col("pos") / files_per_part).cast("long")
    grouped = elements.groupBy("req_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "xml"))).alias("xs"), F.count("*").alias("files")
    )
    ends = elements.groupBy("req_id").agg(F.min(part).alias("head"), F.max(part).alias("tail"))
    head = F.lit(f'<files version="{VERSION}" command="read-files">\n')
    return grouped.join(ends, "req_id").select(
        "req_id", "part", "files",
        F.concat(
            F.when(F.col("part") == F.col("head"), head).otherwise(F.lit("")),
            F.array_join(F.transform("xs", lambda x: x["xml"]), ""),
            F.when(F.col("part") == F.col("tail"), "</files>\n").otherwise(F.lit("")),
        ).alias("xml"),
    )


def json_envelope(rows: DataFrame, command: str, payload: list[str], indent: bool = False) -> Column:
    """Each row's payload columns as a JSON object behind a `_meta` entry.

    Null columns are left out; characters such as & and < stay as they are.
    """
    missing = [c for c in payload if c not in rows.columns]
    if missing or not payload:
        raise ValueError(f"the payload must be an object of known columns; missing: {missing}")
    meta = F.struct(F.lit(VERSION).alias("version"), F.lit(command).alias("command")).alias("_meta")
    return F.to_json(F.struct(meta, *payload), {"pretty": "true"} if indent else {})
