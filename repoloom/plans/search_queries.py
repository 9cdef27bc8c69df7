"""Queries over files: listings, search and what they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, paths, text
from ..functions.text import READ_MAX_KB, SEARCH_MAX_BYTES
from ..operators import grep, listing
from ..operators.read import read_files
from ..session import materialize, scratch_dir
from ..sources.corpus import corpus_scan, land_files
from . import views
from .catalog import query

# SQL shared by several checks.
LINES = "select project, path, cast(n as int) as line, ls[n] as text, ls from (select project, path, ls, unnest(range(1, len(ls)+1)) as n from (select project, path, string_split(content, chr(10)) as ls from files))"
LANG_OF = "case when base in (" + ", ".join(f"'{n}'" for n in language.NAME_LANG) + ") then case base " + " ".join(
    f"when '{n}' then '{l}'" for n, l in language.NAME_LANG.items()
) + " end else case lower(regexp_extract(base, '(\\.[^.]*)$', 1)) " + " ".join(
    f"when '{e}' then '{l}'" for e, l in language.EXT_LANG.items()
) + " else 'Other' end end"
BASE = "string_split(path, '/')[-1]"


@query("tree", "select project, path from files")
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.tree(views.files(spark, sf_dir))


@query("tree_include", "select project, path from files where path = 'src' or path like 'src/%' or path = 'README.md'")
def tree_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.tree(views.files(spark, sf_dir), includes=["src/", "README.md"])


@query("tree_exclude", "select project, path from files where (path like 'src/%' or path like 'pkg/%') and not (path like 'src/deep/%' or path like 'pkg/fr/%')")
def tree_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.tree(views.files(spark, sf_dir), ["src", "pkg"], ["src/deep", "pkg/fr/"])


@query("glob_filter", r"""
select project, path from files
where (regexp_matches(path, '(^|/)[^/]*\.py$') or regexp_matches(path, '^pkg/(.*/)?f[^/][^/]*\.(go|java)$')
       or regexp_matches(path, '(^|/)f[0-9]5[^/]*$') or path = 'LICENSE')
  and not regexp_matches(path, '^src/[^/]*/') and not path like 'vendor/%'""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = paths.path_filter(
        "path", ["*.py", "pkg/**/f?*.go", "pkg/**/f?*.java", "f[0-9]5*", "LICENSE"], ["src/*/**", "vendor"], globs=True
    )
    return views.files(spark, sf_dir).where(keep).select("project", "path")


@query("glob_base_name", r"""
select project, path from files
where regexp_matches(path, '(^|/)f[^/]*7[^/]*$') or regexp_matches(path, '(^|/)R[^x/][^/]*$')""")
def glob_base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs without a slash look at the last segment, whatever they could cross."""
    return views.files(spark, sf_dir).where(paths.path_filter("path", ["f**7**", "R[^x]**"], globs=True)).select("project", "path")


@query("dir_counts", """
select project, case when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1) else '.' end as dir, count(*) as file_count
from files group by 1, 2""")
def dir_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.dir_counts(views.files(spark, sf_dir))


HISTOGRAM = f"""
select project, name, file_count, round(file_count / total * 10000) / 10000 as share from (
 select project, name, count(*) as file_count, sum(count(*)) over (partition by project) as total,
        count(*) over (partition by project) as labels
 from (select project, {LANG_OF} as name from (select project, path, {BASE} as base from files) where {{where}}) group by 1, 2)
where labels > 1 or name <> 'Other'"""


@query("lang_histogram", HISTOGRAM.format(where="true"))
def lang_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.lang_histogram(views.files(spark, sf_dir))


@query("lang_histogram_scoped", HISTOGRAM.replace("path, string", "path, string").replace("from files)", "from files where path like 'vendor/%')").format(where="true"))
def lang_histogram_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.lang_histogram(views.files(spark, sf_dir), ["vendor"])


@query("lang_only_other", """
select project, 'Rust' as name, count(*) as file_count, cast(1 as double) as share from files
where project = 'src3' and path like '%.rs' group by project""")
def lang_only_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project is cut to unknown files, except one cut to Rust files."""
    f = views.files(spark, sf_dir)
    return listing.lang_histogram(
        f.where(F.when(F.col("project") == "src3", F.col("path").endswith(".rs")).otherwise(F.col("path").endswith(".xyz")))
    )


@query("total_files", "select project, count(*) as total_files from files group by project")
def total_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.total_files(views.files(spark, sf_dir))


@query("path_parts", f"""
select project, path, {BASE} as base, regexp_extract({BASE}, '(\\.[^.]*)$', 1) as ext,
 case when contains(path, '/') then string_split(path, '/')[1] else '.' end as top,
 case lower(regexp_extract({BASE}, '(\\.[^.]*)$', 1)) when '.go' then 'go' when '.py' then 'python' when '.ts' then 'typescript' when '.tsx' then 'tsx' when '.java' then 'java' end as source_lang,
 path like 'vendor/%' as skipped from files""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select(
        "project", "path", paths.basename("path").alias("base"), paths.file_ext("path").alias("ext"),
        paths.top_dir("path").alias("top"), paths.source_lang("path").alias("source_lang"),
        paths.in_skipped_dir("path").alias("skipped"),
    )


@query("text_files", """
select project, path, cast(octet_length(encode(content)) as bigint) as size,
 not (contains(content, chr(0)) and octet_length(encode(string_split(content, chr(0))[1])) < 8192) as is_text
from (select project, path, case doc_id % 3 when 0 then content when 1 then concat(content, chr(0)) else concat(substring(content, 1, 9), chr(0), content) end as content from files)""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NUL is put at the end of some files and near the start of others."""
    nul = F.unhex(F.lit("00")).cast("string")
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.col("content"))
        .when(F.col("doc_id") % 3 == 1, F.concat("content", nul))
        .otherwise(F.concat(F.substring("content", 1, 9), nul, F.col("content")))
    )
    f = views.files(spark, sf_dir).select("project", "path", content.cast("binary").alias("content"))
    return f.select("project", "path", text.byte_len("content").alias("size"), text.is_text("content").alias("is_text"))


@query("lines_clean", """
select project, path, cast(n as int) as line, regexp_replace(ls[n], '\\r$', '') as text from (
 select project, path, ls, unnest(range(1, len(ls) + 1)) as n from (
  select project, path, case when ls[-1] = '' then ls[:-2] else ls end as ls from (
   select project, path, string_split(replace(content, '. ', concat('.', chr(13), chr(10))), chr(10)) as ls from files)))""")
def lines_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    crlf = F.replace("content", F.lit(". "), F.lit(".\r\n"))
    return views.files(spark, sf_dir).select(
        "project", "path", F.posexplode(text.lines_clean(crlf)).alias("at", "text")
    ).select("project", "path", (F.col("at") + 1).alias("line"), "text")


SIZES = "case doc_id % 4 when 0 then octet_length(encode(content)) when 1 then 102400 when 2 then 10485760 else 10485761 end"


@query("size_guard", f"""
select project, path, size <= 10485760 as searched, case when size > 102400 then concat('exceeds --max-size limit (', size, ' bytes > 102400 bytes)') end as read_error,
 case when size > 10485760 then concat('exceeds --max-size limit (', size, ' bytes > 10485760 bytes)') end as range_error from (select *, {SIZES} as size from files)""")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are searched, and read whole or in part, by the sizes that the files table has for them."""
    size = views._pick(F.col("doc_id") % 4, [text.byte_len("content"), F.lit(READ_MAX_KB * 1024), F.lit(SEARCH_MAX_BYTES), F.lit(SEARCH_MAX_BYTES + 1)])
    files = views.files(spark, sf_dir).withColumn("size", size.cast("long"))
    both = F.explode(F.array(F.lit(""), F.lit("1")))
    asked = files.select(F.col("project").alias("req_id"), "project", "path", F.col("doc_id").alias("pos"), both.alias("line_range"))
    asked = asked.withColumn("req_id", F.concat_ws("|", "req_id", "line_range"))
    read = read_files(files, asked).select(
        F.substring_index("req_id", "|", 1).alias("project"), "path", F.when(F.col("req_id").endswith("|1"), F.col("error")).alias("range_error"),
        F.when(F.col("req_id").endswith("|"), F.col("error")).alias("read_error"))
    read = read.groupBy("project", "path").agg(F.max("read_error").alias("read_error"), F.max("range_error").alias("range_error"))
    found = grep.searchable(files).select("project", "path", F.lit(True).alias("searched"))
    return read.join(found, ["project", "path"], "left").na.fill(False, ["searched"])


@query("landing", """
select project, path, octet_length(encode(content)) as size, sha256(content) as sha256 from files where cast(substring(project, 4) as int) % 3 = 0
union all select project, path, octet_length(encode(content)), sha256(content) from files_b where cast(substring(project, 4) as int) % 3 = 1""")
def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files landed, then a second snapshot of some projects, then one in which some others are gone."""
    where = scratch_dir(spark)

    def rows(files: DataFrame) -> DataFrame:
        return files.select("project", "path", text.byte_len("content").alias("size"), F.col("content").cast("binary").alias("content"))

    land_files(rows(views.files(spark, sf_dir)), where)
    number = F.substring("project", 4, 9).cast("int") % 3
    land_files(rows(views.files_b(spark, sf_dir)).where(number == 1), where)
    land_files(materialize(corpus_scan(spark, where).where(number != 2)), where, complete=True)
    return corpus_scan(spark, where).select("project", "path", "size", "sha256")


PATTERN = r"\b(the|les?)\b.*(?:tion|ment)s?\b"


def first_match(pattern: str, line: str = "text") -> str:
    """SQL for the byte column of the first match: RE2 takes the leftmost one."""
    return f"cast(octet_length(encode(regexp_extract({line}, '(?s)^(.*?)(?:{pattern})', 1))) + 1 as int)"


@query("grep_lines", f"select project, path, line, {first_match(PATTERN)} as \"column\", text from ({LINES}) where regexp_matches(text, '{PATTERN}')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_lines(views.files(spark, sf_dir), PATTERN)


@query("grep_filtered", f"""
select project, path, line, {first_match('(?i)É[a-z]*MENT')} as "column", text from ({LINES})
where regexp_matches(text, '(?i)É[a-z]*MENT') and path like '%.md' and path not like 'src/%'""")
def grep_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_lines(views.files(spark, sf_dir), "(?i)É[a-z]*MENT", ["*.md"], ["src"])


REPEATED = r"(\w+tion,? )+\w+|(?:an|th)+[a-z]*ing\b"


@query("grep_repeated_groups", f"select project, path, line, {first_match(REPEATED)} as \"column\", text from ({LINES}) where regexp_matches(text, '{REPEATED}')")
def grep_repeated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_lines(views.files(spark, sf_dir), REPEATED)


@query("grep_empty_lines", f"select project, path, line, 1 as \"column\", text from ({LINES}) where text = ''")
def grep_empty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`^$` also hits the empty piece after a final newline."""
    return grep.grep_lines(views.files(spark, sf_dir), "^$")


@query("grep_context", f"""
select project, path, line, {first_match(PATTERN)} as "column", text,
 array_to_string(ls[greatest(1, line - 2):line - 1], chr(10)) as context_before,
 array_to_string(ls[line + 1:line + 2], chr(10)) as context_after
from ({LINES}) where regexp_matches(text, '{PATTERN}')""")
def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = grep.grep_lines(views.files(spark, sf_dir), PATTERN, context=2)
    return hits.withColumn("context_before", F.array_join("context_before", "\n")).withColumn(
        "context_after", F.array_join("context_after", "\n")
    )


def capped_sql(limit: int) -> str:
    return f"""
select project, path, line, {first_match(PATTERN)} as "column", text, hits > {limit} as truncated from (
 select *, row_number() over (partition by project order by string_split(path, '/'), line) as rn,
        count(*) over (partition by project) as hits
 from ({LINES}) where regexp_matches(text, '{PATTERN}')) where rn <= {limit}"""


@query("grep_capped", capped_sql(20))
def grep_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.cap_matches(grep.grep_lines(views.files(spark, sf_dir), PATTERN), 20)


@query("grep_default_cap", capped_sql(200))
def grep_default_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.cap_matches(grep.grep_lines(views.files(spark, sf_dir), PATTERN))


@query("grep_first", capped_sql(20))
def grep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cap by stages that stop when a project has enough matches."""
    return grep.grep_first(views.files(spark, sf_dir), PATTERN, 20, first=8)


@query("grep_multiline", r"""
with m as (
 select project, path, content, unnest(regexp_extract_all(content, '(?s)\.\n[A-Z]\w*')) as hit,
        generate_subscripts(regexp_extract_all(content, '(?s)\.\n[A-Z]\w*'), 1) as k from files),
p as (
 select *, len(array_to_string(string_split_regex(content, '(?s)\.\n[A-Z]\w*')[1:k], '')) - len(replace(array_to_string(string_split_regex(content, '(?s)\.\n[A-Z]\w*')[1:k], ''), chr(10), '')) + k as line,
        string_split(content, chr(10)) as ls from m)
select project, path, cast(line as int) as line, cast(octet_length(encode(ls[line])) as int) as "column",
 concat(ls[line], chr(10), ls[line + 1]) as text from p""")
def grep_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_multiline(views.files(spark, sf_dir), r"\.\n[A-Z]\w*")


REQUESTED = [
    ("full", r"\w+tion\b", [], []),
    ("scoped", r"^[A-Z]\S+ the", ["src", "pkg/**"], ["*.go"]),
    ("globbed", r"(?i)THE", ["*.m?"], []),
    ("nothing", r"qqqq+", [], []),
    ("twice", r"er[.,]$", [], ["vendor"]),
    ("refused", r"(?=a)", [], []),
]
HIT = f"""select concat(project, ':{{}}') as req_id, project, path, line, {{}} as "column", text from ({LINES}) where regexp_matches(text, '{{}}')"""


def hit(name: str, pattern: str, scope: str = "") -> str:
    """SQL for the hits of one request in every project."""
    return HIT.format(name, first_match(pattern), pattern) + scope


@query("grep_batch", " union all ".join([
    hit("full", r"\w+tion\b"),
    hit("scoped", r"^[A-Z]\S+ the", " and (path like 'src/%' or path like 'pkg/%') and path not like '%.go'"),
    hit("globbed", "(?i)THE", r" and regexp_matches(path, '\.m[^/]$')"),
    hit("twice", "er[.,]$", " and path not like 'vendor/%'"),
]))
def grep_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six requests per project, one of them refused."""
    texts = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(p).alias("pattern"),
                 F.array(*[F.lit(i) for i in inc]).cast("array<string>").alias("includes"),
                 F.array(*[F.lit(e) for e in exc]).cast("array<string>").alias("excludes"))
        for n, p, inc, exc in REQUESTED
    ])
    asked = views.repos(spark, sf_dir).select(F.col("name").alias("project"), F.explode(texts).alias("r")).select(
        F.concat("project", F.lit(":"), "r.n").alias("req_id"), "project", "r.pattern", "r.includes", "r.excludes")
    return grep.grep_batch(views.files(spark, sf_dir), asked)
