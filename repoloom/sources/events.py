"""Search events: JSON lines of begin, context, match and end records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..numbering import grouped_position, with_halo
from ..operators.limits import cap_per_group

_SCHEMA = (
    "type string, data struct<path: struct<text: string>, lines: struct<text: string>, "
    "line_number: int, submatches: array<struct<start: int>>>"
)
_BLOCK = 4096


def parse_grep_events(lines: DataFrame, context: int, limit: int = 0, seq_block: int = 1_000_000) -> DataFrame:
    """Matches with context from lines(stream, seq, value).

    A context line belongs to the match before it while that match has fewer
    than `context` lines after it; otherwise it waits for the next match,
    which takes the last `context` waiting ones.  Begin and end records stop
    both.  Lines that are not such records are skipped.

    A match is decided by at most 2 * context rows before it and `context`
    after it, so a stream is cut into blocks that overlap by that much and no
    window spans a whole stream.  `seq_block` bounds how many sequence numbers
    are numbered in one task.  With `limit`, the first matches of each stream
    are kept and `truncated` says whether there were more.
    """
    parsed = lines.select("stream", "seq", F.from_json("value", _SCHEMA).alias("e"))
    kinds = ["begin", "match", "end"] + (["context"] if context > 0 else [])
    events = parsed.where(F.col("e.type").isin(kinds)).select(
        "stream", "seq", F.col("e.type").alias("type"),
        F.regexp_replace("e.data.path.text", r"\A\./", "").alias("path"),
        F.col("e.data.line_number").alias("line"),
        (F.coalesce(F.get(F.col("e.data.submatches"), 0)["start"], F.lit(-1)) + 1).alias("column"),
        F.regexp_replace("e.data.lines.text", r"\n+\z", "").alias("text"),
    )
    dense = grouped_position(events, ["stream"], F.floor(F.col("seq") / seq_block), ["seq"], "at")
    # a halo reaches the neighbouring block only, so a block is at least as long
    spread = with_halo(dense, "at", max(_BLOCK, 2 * context), 2 * context, max(context, 1))
    near = Window.partitionBy("stream", "block").orderBy("at")
    item = F.struct("type", "text")
    framed = spread.withColumn("ahead", F.collect_list(item).over(near.rowsBetween(1, max(context, 1)))).withColumn(
        "behind", F.reverse(F.collect_list(item).over(near.rowsBetween(-max(2 * context, 1), -1)))
    )
    matches = framed.where("home and type = 'match'")
    after = _run("ahead") if context > 0 else F.array().cast("array<string>")
    out = matches.select("stream", "seq", "path", "line", "column", "text", _before(context).alias("context_before"),
                         after.alias("context_after"))
    return cap_per_group(out, ["stream"], ["seq"], limit) if limit > 0 else out


def _run(rows: str) -> Column:
    """Texts of the leading context rows."""
    stop = F.array_position(F.transform(rows, lambda r: r["type"] != "context"), True)
    taken = F.when(stop == 0, F.col(rows)).otherwise(F.slice(rows, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    return F.transform(taken, lambda r: r["text"])


def _before(context: int) -> Column:
    """Waiting context lines of a match, in file order."""
    if context <= 0:
        return F.array().cast("array<string>")
    waiting = _run("behind")
    stopper = F.get(F.col("behind"), F.size(waiting))["type"]
    # The first `context` lines after a match stay with that match.
    theirs = F.when(stopper == "match", context).otherwise(0)
    mine = F.least(F.lit(context), F.greatest(F.size(waiting) - theirs, F.lit(0)))
    return F.reverse(F.slice(waiting, F.lit(1), mine))
