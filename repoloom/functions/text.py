"""Text columns: lines, byte limits, LIKE patterns, dates, XML pieces."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col

TEXT_PROBE_BYTES = 8192
SEARCH_MAX_BYTES = 10 * 1024 * 1024
READ_MAX_KB = 100


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row.

    Spark may inline a column into every use inside a lambda; binding it to a
    lambda variable keeps a split from being repeated per element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def is_text(content: Column | str) -> Column:
    """No NUL among the first 8192 bytes."""
    head = F.substring(as_col(content).cast("binary"), 1, TEXT_PROBE_BYTES)
    return F.call_function("position", F.lit(b"\x00"), head) == 0


def byte_len(c: Column | str) -> Column:
    """Size in bytes as a long."""
    return F.octet_length(as_col(c)).cast("long")


def lines_raw(content: Column | str) -> Column:
    """Split on newline; the piece after a final newline is kept.

    Content that is not UTF-8 is split byte by byte, so that its lines keep
    their bytes.
    """
    text = as_col(content).cast("string")
    single = F.split(F.decode(text.cast("binary"), "ISO-8859-1"), "\n")
    return F.when(F.is_valid_utf8(text), F.split(text, "\n")).otherwise(
        F.transform(single, lambda line: F.encode(line, "ISO-8859-1").cast("string")))


def lines_clean(content: Column | str) -> Column:
    """Lines a reader sees: no trailing empty piece, no carriage returns."""
    text = as_col(content).cast("string")

    def tidy(parts: Column) -> Column:
        n = F.size(parts)
        return F.when(F.get(parts, n - 1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)

    def bare(l: Column) -> Column:
        return F.when(l.endswith("\r"), F.substring(l, F.lit(1), F.length(l) - 1)).otherwise(l)

    lines = let(lines_raw(text), tidy)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.contains("\r"), F.transform(lines, bare))
        .otherwise(lines)
    )


def ascii_lower(c: Column | str) -> Column:
    """Lower case for A-Z only."""
    return F.translate(as_col(c), string.ascii_uppercase, string.ascii_lowercase)


def name_pattern(pattern: str) -> str:
    """A user's name pattern as LIKE text.

    Text with % or _ is LIKE already; * and ? become % and _; anything else
    is searched as a substring.  Empty means no filter.
    """
    if pattern == "" or any(c in pattern for c in "%_"):
        return pattern
    if any(c in pattern for c in "*?"):
        return pattern.replace("*", "%").replace("?", "_")
    return f"%{pattern}%"


def name_pattern_col(pattern: Column | str) -> Column:
    """`name_pattern` for a column of patterns."""
    p = as_col(pattern)
    return (
        F.when((p == "") | p.rlike("[%_]"), p)
        .when(p.rlike("[*?]"), F.translate(p, "*?", "%_"))
        .otherwise(F.concat(F.lit("%"), p, F.lit("%")))
    )


def like_ascii_ci(text: Column | str, pattern: str | Column) -> Column:
    """LIKE that ignores the case of A-Z only and knows no escape character."""
    t = ascii_lower(text)
    if isinstance(pattern, str):
        inner = pattern[1:-1]
        if len(pattern) >= 2 and pattern[0] == pattern[-1] == "%" and not set(inner) & set("%_"):
            return t.contains(ascii_lower(F.lit(inner)))
        pattern = F.lit(pattern)
    return F.like(t, ascii_lower(pattern), F.lit("\u0001"))


def split_list(values: list[str]) -> list[str]:
    """Flag values split on commas, trimmed, without empties, sorted."""
    return sorted(p.strip() for v in values for p in v.split(",") if p.strip())


def utc_rfc3339(c: Column | str) -> Column:
    """An RFC 3339 time in UTC; anything else passes through."""
    raw = as_col(c)
    shape = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"
    parsed = F.when(raw.rlike(shape), F.try_to_timestamp(raw))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(iso_utc(epoch + F.make_dt_interval(secs=F.unix_seconds(parsed))), raw)


def iso_utc(c: Column | str) -> Column:
    """A zone-less timestamp that holds UTC, as text with whole seconds.

    Goes through text, because formatting would pass through the session's
    time zone and its missing hours.
    """
    text = as_col(c).cast("timestamp_ntz").cast("string")
    return F.concat(F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def first_line(c: Column | str) -> Column:
    """Text before the first newline, without white space around it."""
    return F.regexp_replace(F.substring_index(as_col(c), "\n", 1), r"(?U)\A\s+|\s+\z", "")


def short_hash(c: Column | str) -> Column:
    """First twelve characters."""
    return F.substring(as_col(c), 1, 12)


def utf8_prefix(content: Column | str, limit: int) -> Column:
    """At most `limit` bytes, never ending inside a character."""
    raw = as_col(content).cast("binary")

    def cut(head: Column) -> Column:
        tail = F.hex(F.substring(head, -3, 3))
        # A lead byte too close to the end, counted in bytes from the end.
        drop = (
            F.when(tail.rlike(r"[C-F].\z"), 1)
            .when(tail.rlike(r"[EF].[89AB].\z"), 2)
            .when(tail.rlike(r"\AF.[89AB].[89AB].\z"), 3)
            .otherwise(0)
        )
        return F.substring(head, F.lit(1), F.octet_length(head) - drop)

    return F.when(F.octet_length(raw) < limit, raw).otherwise(
        let(F.substring(raw, 1, limit), cut)
    ).cast("string")


def cap_bytes(c: Column | str, max_kb: int, marker: str) -> tuple[Column, Column]:
    """Text cut at `max_kb` KiB with a marker appended, and whether it was cut."""
    text = as_col(c)
    if max_kb <= 0:
        return text, F.lit(False)
    cut = F.octet_length(text) > max_kb * 1024
    return F.when(cut, F.concat(utf8_prefix(text, max_kb * 1024), F.lit(marker))).otherwise(text), cut


def xml_attr(c: Column | str) -> Column:
    """Quoted attribute value."""
    out = as_col(c)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def cdata_escape(c: Column | str) -> Column:
    """Split the CDATA terminator so it cannot close the section."""
    return F.replace(as_col(c), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def number_lines(lines: Column, first: Column, width: Column) -> Column:
    """Prefix each line with its right-aligned number and a bar."""
    return F.transform(
        lines,
        lambda l, i: F.concat(F.lpad((first + i).cast("string"), width, " "), F.lit(" | "), l),
    )


def line_range(c: Column | str) -> Column:
    """struct(first, last, problem) of a line range such as "3" or "2-9"."""
    s = F.regexp_replace(as_col(c), r"\A\s+|\s+\z", "")
    number = r"\A[+-]?\d+\z"

    def as_long(x: Column) -> Column:
        x = F.regexp_replace(x, r"\A\s+|\s+\z", "")
        return F.when(x.rlike(number), x.try_cast("long"))

    left = as_long(F.substring_index(s, "-", 1))
    right = as_long(F.regexp_extract(s, r"(?s)\A[^-]*-(.*)\z", 1))
    single = as_long(s)

    def result(first: Column, last: Column, problem: Column) -> Column:
        return F.struct(first.alias("first"), last.alias("last"), problem.alias("problem"))

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    return (
        F.when(s == "", result(zero, zero, none))
        .when(s.contains("-") & (left.isNull() | right.isNull()),
              result(zero, zero, F.lit("invalid --lines range; expected START-END")))
        .when(s.contains("-") & (left > right), result(zero, zero, F.lit("--lines range start > end")))
        .when(s.contains("-"), result(left, right, none))
        .when(single.isNull(), result(zero, zero, F.lit("invalid --lines value; expected START or START-END")))
        .otherwise(result(single, single, none))
    )


def shallow_hint(shallow: Column | str, repo: Column | str, missing: str) -> Column:
    """Hint shown when only part of the history is present."""
    return F.when(
        as_col(shallow),
        F.concat(F.lit(f"shallow clone: {missing}; deepen "), as_col(repo), F.lit(" to get the rest")),
    )
