"""Corpus tables derived from the given parquet tables.

Each function builds, with Spark, one table of the data model from the tables
in `sf_dir`.  `oracle_views.py` holds the same derivations as plain SQL.

Row numbers are never taken over a whole source or repo in one window: a
narrow top-3 finds the special files, and commits are numbered day by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS_PER_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: Column, values: list) -> Column:
    out = F.lit(values[-1]) if not isinstance(values[-1], Column) else values[-1]
    for i in range(len(values) - 2, -1, -1):
        out = F.when(number == i, values[i]).otherwise(out)
    return out


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(project, path, content, doc_id): one file per document."""
    docs = table(spark, sf_dir, "documents")
    first = (
        docs.select("doc_id", "source")
        .withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
        .where("rn <= 3")
        .select("doc_id", "rn")
    )
    doc, nth = F.col("doc_id"), F.col("rn")
    key = doc.cast("string")
    folder = _pick(doc % 7, ["", "src/", "src/deep/", "src2/", F.concat(F.lit("pkg/"), "lang", F.lit("/")), "vendor/", ".github/"])
    suffix = _pick(doc % 12, [".go", ".py", ".ts", ".tsx", ".java", ".md", ".yml", ".json", ".PY", ".xyz", "", ".rs"])
    name = F.when(doc % 12 == 10, F.concat(F.lit("d"), key, F.lit("/Makefile"))).otherwise(
        F.concat(F.lit("f"), key, suffix)
    )
    path = (
        F.when(nth == 1, "README.md").when(nth == 2, "LICENSE").when(nth == 3, "go.mod")
        .otherwise(F.concat(folder, name))
    )
    banner = (
        "[![Build](https://img.example/b.svg)](https://ci.example)\n"
        '<div align="center">\n<img src="logo.png"/>\n</div>\n\n# '
    )
    content = F.when(nth == 1, F.concat(F.lit(banner), "source", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return docs.join(first, "doc_id", "left").select(
        F.col("source").alias("project"), path.alias("path"), content.alias("content"), "doc_id"
    )


def files_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second snapshot of `files`: dropped, grown and copied files."""
    base = files(spark, sf_dir)
    n = F.length("content")
    grown = F.when(n % 7 == 3, F.concat("content", F.lit("\nadded line"))).otherwise(F.col("content"))
    # One pass over the files: each yields its kept version and its copy.
    kept = F.when(n % 10 != 0, F.struct(F.col("path").alias("path"), grown.alias("content")))
    copy = F.when(n % 50 == 1, F.struct(F.concat(F.lit("new/"), "path").alias("path"), F.col("content").alias("content")))
    return (
        base.select("project", F.explode(F.array_compact(F.array(kept, copy))).alias("f"))
        .select("project", "f.path", "f.content")
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repos(name, url, path, shallow, fetched_at): one per source."""
    name = F.col("source")
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        name.alias("name"),
        F.concat(F.lit("https://example.com/"), name, F.lit(".git")).alias("url"),
        F.concat(F.lit("/data/"), name).alias("path"),
        (F.substring(name, 4, 20).cast("int") % 2 == 0).alias("shallow"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"),
    )


def checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """checkouts: a default one per source, a pinned one per source and language."""
    docs = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    repo, lang = F.col("source"), F.col("lang")

    def at(day: str) -> Column:
        return F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")

    default = docs.select("source").distinct().select(
        repo.alias("id"), repo.alias("repo"), F.lit("main").alias("ref"), F.lit("branch").alias("kind"),
        F.md5(repo).alias("commit_hash"), F.concat(F.lit("/data/"), repo).alias("path"),
        at("02").alias("updated_at"), at("02").alias("parsed_at"),
    )
    pinned = docs.select(
        F.concat(repo, F.lit("@"), lang).alias("id"), repo.alias("repo"), lang.alias("ref"),
        F.when(lang == "en", "tag").when(lang == "fr", "commit").otherwise("branch").alias("kind"),
        F.md5(F.concat(repo, lang)).alias("commit_hash"),
        F.concat(F.lit("/data/"), repo, F.lit("@"), lang).alias("path"),
        at("03").alias("updated_at"), F.when(lang != "es", at("03")).alias("parsed_at"),
    )
    return default.unionByName(pinned)


def _code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with its project, file stem and type name.

    A file covers a fixed range of part keys, so files stay bounded and their
    number grows with the table.
    """
    kind = F.lower("p_type")
    block = (F.col("p_partkey") / PARTS_PER_FILE).cast("long")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("brand"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("project"),
        F.concat(F.lit("src/"), kind, F.lit("_"), block.cast("string")).alias("stem"),
        F.initcap(kind).alias("cls"),
        F.col("p_partkey").alias("k"),
        F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("_"),
                 F.replace("p_name", F.lit(" "), F.lit("_"))).alias("member"),
        F.col("p_size").alias("z"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol index of the Python `code_files`, computed from part."""
    parts = _code_parts(spark, sf_dir)
    win = Window.partitionBy("project", "stem")
    numbered = parts.withColumn("rn", F.row_number().over(win.orderBy("k"))).withColumn("n", F.count("*").over(win))
    path = F.concat("stem", F.lit(".py"))
    member = F.struct(
        F.col("member").alias("name"), F.lit("method").alias("kind"), (2 * F.col("rn")).cast("int").alias("line"),
        (2 * F.col("rn") + 1).cast("int").alias("end_line"), F.col("cls").alias("parent"),
    )
    owner = F.when(F.col("rn") == 1, F.struct(
        F.col("cls").alias("name"), F.lit("class").alias("kind"), F.lit(1).alias("line"),
        (2 * F.col("n") + 1).cast("int").alias("end_line"), F.lit(None).cast("string").alias("parent"),
    ))
    return numbered.select(
        "project", path.alias("path"), F.explode(F.array_compact(F.array(owner, member))).alias("s")
    ).select("project", "path", "s.*", F.lit("python").alias("lang"))


# Code templates: extension, text before the members, text of one member and
# text after them.  {c} is the type, {m} the member, {z} its number.
CODE = {
    "python": (".py", "class {c}:\n", "    def {m}(self):\n        return {z}\n", ""),
    "go": (
        ".go",
        "package p\n\n// type Ghost struct {{\ntype {c} struct {{\n\tsize int\n}}\n",
        "\nfunc (r *{c}) {m}(x int) string {{\n\ts := \"}} func no() {{\"\n\treturn s // {z} }}\n}}\n",
        "",
    ),
    "java": (
        ".java",
        "package p;\n\n/* class Ghost {{ */\npublic class {c} {{\n",
        "    public String {m}(int x) {{\n        return \"}} {z} {{\"; // }}\n    }}\n",
        "}}\n",
    ),
    "typescript": (
        ".ts",
        "// class Ghost {{\nexport class {c} {{\n",
        "  {m}(x: number): string {{\n    return `}} {z} {{`;\n  }}\n",
        "}}\n",
    ),
    "tsx": (
        ".tsx",
        "/* interface Ghost {{ */\nexport interface {c}Props {{\n  size: number;\n}}\n",
        "export function {m}(props: {c}Props) {{\n  return \"}} {z} {{\";\n}}\n",
        "",
    ),
}


def _template(text: str) -> Column:
    """A template as a concat over the columns cls, member and z."""
    cols = {"{c}": F.col("cls"), "{m}": F.col("member"), "{z}": F.col("z").cast("string")}
    pieces, rest = [], text
    while rest:
        at = min((rest.find(k) for k in cols if k in rest), default=len(rest))
        if at:
            pieces.append(F.lit(rest[:at].replace("{{", "{").replace("}}", "}")))
        if at < len(rest):
            pieces.append(cols[rest[at : at + 3]])
        rest = rest[at + 3 :]
    return F.concat(F.lit(""), *pieces)


def code_files(spark: SparkSession, sf_dir: str, lang: str = "python") -> DataFrame:
    """Generated source files whose symbols are known from part."""
    ext, head, member, tail = CODE[lang]
    return (
        _code_parts(spark, sf_dir)
        .groupBy("project", "stem", "cls")
        .agg(F.array_sort(F.collect_list(F.struct("k", _template(member).alias("t")))).alias("ms"))
        .select(
            "project",
            F.concat("stem", F.lit(ext)).alias("path"),
            F.concat(_template(head), F.array_join(F.transform("ms", lambda m: m["t"]), ""), _template(tail)).alias("content"),
        )
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits: a linear history per repo, ordered by date and order key."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    repo = F.concat(F.lit("r"), (F.col("o_custkey") % 20).cast("string")).alias("repo")
    day = F.to_date("o_orderdate").alias("day")
    base = orders.join(customer, orders.o_custkey == customer.c_custkey).select(repo, day, "o_orderkey", "o_orderdate", "c_name", "o_orderpriority", "o_orderstatus")
    # Only a day's commits are ordered; what stands before a day comes from the days' counts and last commits.
    # The parent is the previous commit: the one before within the day, or
    # the last one of the latest earlier day.  Names and hashes are made of keys after the shuffle.
    days = base.groupBy("repo", "day").agg(F.count("*").alias("size"), F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last"))
    by_day = Window.partitionBy("repo").orderBy("day")
    before = F.sum("size").over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("repo", "day", F.coalesce(before, F.lit(0)).alias("before"), F.lag("last").over(by_day).alias("carry"))
    within = Window.partitionBy("repo", "day").orderBy("o_orderdate", "o_orderkey")

    def named(key: Column) -> Column:
        return F.md5(F.concat(F.lit("c"), key.cast("string")))

    return (
        base.withColumns({"rn": F.row_number().over(within), "up": F.lag("o_orderkey").over(within)})
        .join(days, ["repo", "day"])
        .select("repo", named(F.col("o_orderkey")).alias("hash"), named(F.coalesce("up", "carry")).alias("parent"), F.col("c_name").alias("author"),
                F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
                F.col("o_orderdate").alias("author_ts"), F.col("o_orderpriority").alias("subject"), F.lower("o_orderstatus").alias("branch"),
                (F.col("before") + F.col("rn")).cast("int").alias("rn"))
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refs: local and remote heads, a remote HEAD, lightweight and annotated tags."""
    c = commits(spark, sf_dir)
    tips = c.groupBy("repo", "branch").agg(F.max(F.struct("rn", "hash")).alias("tip"))
    heads = tips.select(
        "repo",
        F.explode(F.array(F.concat(F.lit("refs/heads/"), "branch"), F.concat(F.lit("refs/remotes/origin/"), "branch"))).alias("full_name"),
        F.col("tip.hash").alias("hash"),
    )
    remote_head = tips.groupBy("repo").agg(F.max("tip").alias("tip")).select(
        "repo", F.lit("refs/remotes/origin/HEAD").alias("full_name"), F.col("tip.hash").alias("hash")
    )
    tagged = c.where(F.col("rn") % 25 == 0).select(
        "repo", F.concat(F.lit("refs/tags/v"), F.col("rn").cast("string")).alias("full_name"),
        F.when(F.col("rn") % 50 == 0, F.col("hash")).otherwise(F.md5(F.concat(F.lit("t"), "hash"))).alias("hash"),
    )
    return heads.unionByName(remote_head).unionByName(tagged)


def tag_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag_objects: targets of the annotated tags."""
    return commits(spark, sf_dir).where("rn % 25 = 0 and rn % 50 <> 0").select(
        "repo", F.md5(F.concat(F.lit("t"), "hash")).alias("hash"), F.col("hash").alias("target")
    )


def remote_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remote_refs: what origin publishes, peeled names included."""
    r, t = refs(spark, sf_dir), tag_objects(spark, sf_dir)
    plain = r.where("full_name like 'refs/heads/%' or full_name like 'refs/tags/%'").select(
        "repo", "hash", F.col("full_name").alias("name")
    )
    peeled = r.join(t, ["repo", "hash"]).select(
        "repo", F.col("target").alias("hash"), F.concat("full_name", F.lit("^{}")).alias("name")
    )
    return plain.unionByName(peeled)


def ref_events(events: DataFrame) -> DataFrame:
    """ref_events from the events table, batch or stream."""
    return events.select(
        F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string"), F.lit("@"), "event_type").alias("id"),
        "ts",
        F.col("event_type").alias("ref"),
        F.lit("branch").alias("kind"),
        F.md5(F.col("event_id").cast("string")).alias("commit_hash"),
    )


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_requests: every file once, and one missing path per project."""
    f = files(spark, sf_dir)
    asked = f.select(
        F.col("project").alias("req_id"), "project", "path", F.col("doc_id").alias("pos"),
        _pick(F.length("content") % 6, ["", "2-4", "3", "500-510", "9-2", "x"]).alias("line_range"),
    )
    missing = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("m")).select(
        F.col("source").alias("req_id"), F.col("source").alias("project"),
        F.lit("no/such/file.txt").alias("path"), (F.col("m") + 1).alias("pos"), F.lit("").alias("line_range"),
    )
    return asked.unionByName(missing)
