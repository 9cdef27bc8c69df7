"""Time the headline operators; prints one JSON line.

The corpus tables (files, code, symbols, commits, ...) are derived from the
given tables and stored once; then each operator is timed over the stored
tables, median of three warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from repoloom.operators import diff, grep, history, listing, maintain, read, registry, summary, symbols, topics  # noqa: E402
from repoloom.plans import views  # noqa: E402
from repoloom.session import build_session, scratch_dir  # noqa: E402
from repoloom.sources import tables  # noqa: E402
from repoloom.sources.corpus import ROW_GROUP_BYTES  # noqa: E402
from repoloom.streaming import refs as streams  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
PATTERN = r"\b(the|les?)\b.*(?:tion|ment)s?\b"


def prepare(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The corpus tables, written once and read back."""
    made = {
        "files": views.files(spark, SF_DIR), "files_b": views.files_b(spark, SF_DIR), "repos": views.repos(spark, SF_DIR),
        "checkouts": views.checkouts(spark, SF_DIR), "symbols": views.symbols(spark, SF_DIR),
        "code": views.code_files(spark, SF_DIR),
        "commits": views.commits(spark, SF_DIR).withColumn("parents", F.array_compact(F.array("parent"))),
        "refs": views.refs(spark, SF_DIR), "tag_objects": views.tag_objects(spark, SF_DIR),
        "remote_refs": views.remote_refs(spark, SF_DIR), "read_requests": views.read_requests(spark, SF_DIR),
        "events": views.ref_events(views.table(spark, SF_DIR, "events")),
        "symbols_50": views.symbols(spark, SF_DIR).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn(
            "path", F.concat(F.col("copy").cast("string"), F.lit("/"), "path")).drop("copy"),
    }
    out = {}
    for name, df in made.items():
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def workload(spark: SparkSession, t: dict[str, DataFrame], root: str) -> dict:
    """Operator calls by name; each returns a DataFrame or does its own write."""
    words = [r"\w+tion\b", r"^[A-Z]\S+ ", "(?i)THE", r"er[.,]$", "é[a-z]*"]
    asked = t["repos"].select(
        F.col("name").alias("project"), F.posexplode(F.array(*[F.lit(w) for w in words])).alias("n", "pattern")
    ).where("n < 3 or project in ('src0', 'src1')").select(
        F.concat("project", F.lit(":"), F.col("n").cast("string")).alias("req_id"), "project", "pattern",
        F.array().cast("array<string>").alias("includes"), F.array(F.lit("vendor")).alias("excludes"))
    heads = t["commits"].groupBy("repo").agg(F.max_by("hash", "rn").alias("head"))
    refs_asked = t["commits"].select(
        F.concat("repo", F.lit(":"), F.col("rn").cast("string")).alias("req_id"), "repo",
        F.when(F.col("rn") % 2 == 0, F.substring("hash", 1, 10)).otherwise(F.concat(F.lit("v"), F.col("rn").cast("string"))).alias("ref"),
        F.lit(False).alias("refresh"))
    projects = registry.projects(t["checkouts"], t["repos"])
    before = t["checkouts"].select("id", "commit_hash")
    now = t["checkouts"].select("id", "kind", F.md5("id").alias("commit_hash"), F.lit(None).cast("string").alias("problem"))
    at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    return {
        "tree": lambda: listing.tree(t["files"]),
        "dir_counts": lambda: listing.dir_counts(t["files"]),
        "lang_histogram": lambda: listing.lang_histogram(t["files"]),
        "grep_lines": lambda: grep.grep_lines(t["files"], PATTERN),
        "grep_context": lambda: grep.grep_lines(t["files"], PATTERN, context=2),
        "grep_capped": lambda: grep.cap_matches(grep.grep_lines(t["files"], PATTERN)),
        "grep_multiline": lambda: grep.grep_multiline(t["files"], r"\.\n[A-Z]\w*"),
        "grep_batch": lambda: grep.grep_batch(t["files"], asked),
        "extract_python": lambda: symbols.build_index(t["code"]),
        "write_index": lambda: tables.write_symbols(t["symbols"], t["symbols"].select("project").distinct(), f"{root}/store"),
        "write_index_50": lambda: tables.write_symbols(t["symbols_50"], t["symbols_50"].select("project").distinct(), f"{root}/store"),
        "symbols_like": lambda: symbols.symbols_across(t["symbols"], "M1%_b%", limit=0),
        "summary": lambda: summary.summary(t["files"]),
        "read_files": lambda: read.read_files(t["files"], t["read_requests"]),
        "diff_files": lambda: diff.diff_files(t["files"], t["files_b"]),
        "diff_stat": lambda: diff.diff_stat(t["files"], t["files_b"]),
        "diff_documents": lambda: diff.diff_documents(t["files"], t["files_b"]),
        "log_newest": lambda: history.log(t["commits"], heads),
        "resolve_refs": lambda: history.resolve_refs(refs_asked, t["refs"], t["tag_objects"], t["commits"], t["remote_refs"]),
        "latest_ref": lambda: streams.latest_refs(t["events"]),
        "advance": lambda: maintain.advance(projects, before, now, at),
        "topic_density": lambda: topics.topic_density(t["code"], t["symbols"], r"\bm\d+_", "re"),
    }


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    root = scratch_dir(spark)
    t = prepare(spark, root)
    size = t["files"].agg(F.sum(F.octet_length("content"))).first()[0]
    counts = {"files": t["files"].count(), "symbols": t["symbols"].count()}
    only = sys.argv[1:]
    seconds = {}
    for name, call in workload(spark, t, root).items():
        if only and name not in only:
            continue
        took = []
        for _ in range(RUNS + 1):
            begin = time.perf_counter()
            df = call()
            if df is not None:
                df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rates = {}
    if "grep_lines" in seconds:
        rates["grep_mb_per_sec"] = round(size / 1e6 / seconds["grep_lines"], 1)
        rates["grep_files_per_sec"] = round(counts["files"] / seconds["grep_lines"])
    for name, rows in (("extract_python", counts["symbols"]), ("write_index", counts["symbols"]), ("write_index_50", 50 * counts["symbols"])):
        if name in seconds:
            rates[f"{name}_rows_per_sec"] = round(rows / seconds[name])
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS, "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
