"""URL filters: dated list entries become validity intervals; every capture meets those active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KINDS = ("url", "prefix", "host", "domain")  # the most telling first
ACTIONS = ("allow", "block", "remove")  # the one that wins on one day first


def _place(names: tuple[str, ...], of: str) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(of))


def host_of(url: Column) -> Column:
    """Lower-case host, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path and query from the first slash on, without the fragment; a slash if there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def month_of(when: Column) -> Column:
    return F.year(when) * 12 + F.month(when)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, action, since, until) of entries(list, kind, value, action, dated); until is exclusive, null for ever.

    An entry holds until the next one of the same list, kind and value; of
    several on one day allow wins over block over remove.  Removals only end
    an interval; entries with a null in any column, or an unknown kind or
    action, say nothing.
    """
    ranked = entries.select("list", "kind", "value", "dated", _place(ACTIONS, "action").alias("rank")).where(
        (F.col("rank") > 0) & (_place(KINDS, "kind") > 0) & F.col("dated").isNotNull() & F.col("list").isNotNull() & F.col("value").isNotNull())
    days = ranked.groupBy("list", "kind", "value", "dated").agg(F.min("rank").alias("rank"))
    after = F.lead("dated").over(Window.partitionBy("list", "kind", "value").orderBy("dated"))
    named = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("rank").cast("int"))
    return days.select("list", "kind", "value", named.alias("action"), F.col("dated").alias("since"), after.alias("until")).where("action <> 'remove'")


def candidates(depth: int) -> Column:
    """Array of (kind, value) that an entry must have to speak of the row's url; directories down to `depth` below the host.

    No entry is deeper than `depth`, so nothing is left out by it.
    """
    host, path = F.col("_host"), F.col("_path")
    folders = F.split(F.regexp_extract(path, r"^([^?]*/)", 1), "/")
    labels = F.split(host, r"\.")

    def pair(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(folders) - 1, F.lit(max(1, depth)))), lambda n: pair(
        "prefix", F.concat(host, F.array_join(F.slice(folders, F.lit(1), n), "/"), F.lit("/"))))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: pair("domain", F.array_join(F.slice(labels, n, F.size(labels)), ".")))
    return F.concat(F.array(pair("url", F.concat(host, path)), pair("host", host)), prefixes, domains)


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, url, fetched, n_active, blocked, list, kind, value) of every distinct capture.

    n_active counts the entries that match the url and are in force at the
    time of its fetch; the most telling decides (url, longest prefix, host,
    longest domain; then allow over block, then the name of the list).  A
    capture without a url, a host or a time meets none and isn't blocked;
    rows that repeat are one capture.  Both sides meet on kind, value and
    month, so neither a host with many captures nor a value with many dates
    is one group, and the range of days is tested on those pairs alone.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at")).distinct()
    held = stored(intervals(entries))
    bounds = rows.agg(F.max("at").alias("last")).crossJoin(held.where("kind = 'prefix'").agg(F.max(F.size(F.split("value", "/"))).alias("depth"))).first()
    depth = (bounds.depth or 2) - 1
    until = F.coalesce("until", F.lit(bounds.last))
    monthly = held.where(F.lit(bounds.last).isNotNull() & (F.col("since") <= F.lit(bounds.last))).withColumn(
        "month", F.explode(F.sequence(month_of(F.col("since")), F.greatest(month_of(F.least(until, F.lit(bounds.last))), month_of(F.col("since"))))))
    asked = rows.withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url"))})
    none = F.array().cast("array<struct<kind:string,value:string>>")
    asked = asked.withColumn("_c", F.explode_outer(F.when(F.col("_host").isNotNull() & F.col("at").isNotNull(), candidates(depth)).otherwise(none)))
    asked = asked.select("id", "url", "at", F.col("_c.kind").alias("k"), F.col("_c.value").alias("v"), month_of(F.col("at")).alias("m"))
    met = asked.join(monthly, (F.col("k") == F.col("kind")) & (F.col("v") == F.col("value")) & (F.col("m") == F.col("month"))
                     & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))), "left")
    telling = F.struct(_place(KINDS, "kind").alias("rank"), (-F.char_length("value")).alias("short"), _place(ACTIONS, "action").alias("act"), "list", "kind", "value", "action")
    best = met.groupBy("id", "url", "at").agg(F.count("kind").alias("n_active"), F.min(F.when(F.col("kind").isNotNull(), telling)).alias("best"))
    return best.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), "n_active",
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("best.list").alias("list"), F.col("best.kind").alias("kind"), F.col("best.value").alias("value"))
