"""Secret scans: a ledger of content-addressed versions, so that each text meets each version of a rule once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.sources.tables import exists

from .common import keyed, stored


@dataclass(frozen=True)
class Rule:
    """A pattern; of its leftmost matches those stand whose group has at least `least` characters.

    `hint` is a string without which a text can't match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# A longest run of hex digits of 16 or more is a match of the plain run that is long enough, and the
# same holds for key ids; a failed assignment uses up its characters, so that one is matched whole.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{16,}", hint="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", hint="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
)
RULES = BASE + MORE
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,version:string>"
LEDGER = f"blob_id string, rule_versions array<string>, spans array<{SPAN}>"


def blobs(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, blob_id) of every version of every path; the address is the SHA-256 of the text, a null one being empty."""
    return keyed(versions, id_col, text_col).withColumn("blob_id", F.sha2("text", 256))


def _matches(rule: Rule, rank: int, asked: Column) -> Column:
    """Array of (rank, n, gap, size, ok) of the rule's matches: characters since the last match, and in it."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(0)).alias("m"), F.split("text", rule.pattern, -1).alias("g"))

    def one(x: Column, n: Column) -> Column:
        fits = F.char_length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.struct(F.lit(rank).alias("rank"), n.alias("n"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("size"), fits.alias("ok"))

    can = F.contains("text", F.lit(rule.hint)) if rule.hint else F.lit(True)
    none = F.array().cast("array<struct<rank:int,n:int,gap:int,size:int,ok:boolean>>")
    return F.when(asked & can & F.col("text").rlike(rule.pattern), F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), one)).otherwise(none)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New rows of the ledger: (blob_id, rule_versions, spans) for every blob that lacks a rule's version.

    Each distinct text is scanned once, with those rules alone that the ledger
    doesn't have for it; `rule_versions` names them and `spans` has what they
    found: (start, rank, kind, end, rule version) in code points, end exclusive.  Append the
    rows to the ledger; an interrupted run leaves it as it was.  Null texts are
    the empty blob; blobs seen with all rules give no row.
    """
    rows = blobs(versions, id_col, text_col)
    names = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        fresh = rows.dropDuplicates(["blob_id"]).select("blob_id", "text", names.alias("todo"))
    else:
        seen = ledger.select("blob_id", F.explode("rule_versions").alias("v")).groupBy("blob_id").agg(F.collect_set("v").alias("seen"))
        keys = rows.select("blob_id").distinct().join(seen, "blob_id", "left").select(
            "blob_id", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        fresh = rows.join(stored(keys), "blob_id").dropDuplicates(["blob_id"]).select("blob_id", "text", "todo")
    found = stored(fresh.select("blob_id", "todo", F.concat(*[
        _matches(rule, n, F.array_contains("todo", rule.version)) for n, rule in enumerate(rules)]).alias("found")))
    each = found.where(F.size("found") > 0).select("blob_id", F.inline("found"))
    before = F.expr("sum(gap + size) over (partition by blob_id, rank order by n rows between unbounded preceding and current row)")
    placed = each.withColumn("end", before.cast("long")).where("ok")
    kinds, versions_of = (F.array(*[F.lit(x) for x in xs]) for xs in ([r.kind for r in rules], [r.version for r in rules]))
    spans = placed.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("end") - F.col("size")).alias("start"), "rank", F.get(kinds, F.col("rank")).alias("kind"), "end", F.get(versions_of, F.col("rank")).alias("version")))).alias("spans"))
    return found.join(spans, "blob_id", "left").select(
        "blob_id", F.col("todo").alias("rule_versions"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
             keep_text: bool = False) -> DataFrame:
    """(id, blob_id, spans[, text]) for every path and version: what the ledger knows of its text, by start, then rank.

    Only spans of the given versions of the rules count, whatever else the
    ledger holds.  Copies and repeated rows all get the spans of their blob; a
    blob the ledger doesn't have gets none.
    """
    current = F.array(*[F.lit(r.version) for r in rules])
    mine = F.filter("spans", lambda s: F.array_contains(current, s["version"]))
    known = ledger.select("blob_id", mine.alias("spans")).where(F.size("spans") > 0)
    known = known.groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    rows = blobs(versions, id_col, text_col)
    rows = rows if keep_text else rows.drop("text")
    return rows.join(stored(known), "blob_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_into(versions: DataFrame, location: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger stored at `location`, after scanning what it lacks and appending that.

    The folder is made by the first scan.  The new rows are complete before
    they are appended, so an interrupted run can be run again.
    """
    spark = versions.sparkSession
    ledger = spark.read.schema(LEDGER).parquet(location) if exists(spark, location) else None
    stored(scan(versions, ledger, rules, id_col, text_col)).write.mode("append").parquet(location)
    return spark.read.schema(LEDGER).parquet(location)


def secrets_report(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """report_of() after scanning what the ledger lacks."""
    new = stored(scan(versions, ledger, RULES, id_col, text_col))
    return report_of(versions, new if ledger is None else ledger.unionByName(new), id_col, text_col)


def report_of(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row, as the ledger knows its text."""
    found = findings(versions, ledger, RULES, id_col, text_col)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the scan replaced by `mark`; all rows and columns stay, n_chars is that of the new text.

    Overlapping spans are replaced once; a null text stays null.
    """
    ledger = stored(scan(docs, None, RULES, id_col, text_col))
    cuts = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] < F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    known = stored(ledger.where(F.size("spans") > 0).select(F.col("blob_id").alias("_blob"), cuts.alias("_cuts")))
    joined = docs.withColumn("_of", F.sha2(F.col(text_col), 256)).join(known, F.col("_of") == F.col("_blob"), "left")
    text = F.col(text_col)
    pieces = F.transform("_cuts", lambda c, n: F.concat(
        F.substring(text, (F.coalesce(F.get(F.col("_cuts"), n - 1)["end"], F.lit(0)) + 1).cast("int"),
                    (c["start"] - F.coalesce(F.get(F.col("_cuts"), n - 1)["end"], F.lit(0))).cast("int")), F.lit(mark)))
    rest = F.substring(text, (F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.lit(2**31 - 1))
    out = joined.withColumn("_new", F.when(F.col("_cuts").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest)))
    columns = {c: F.col(c) for c in docs.columns} | {text_col: F.col("_new")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.char_length("_new")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(k) for k, v in columns.items()])
