"""Queries for key files, READMEs, summaries and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import read, summary
from . import views
from .catalog import query
from .search_queries import HISTOGRAM

# Root-level names of many kinds, by document.
ROOT_NAMES = [
    "README.md", "readme.rst", "License-MIT", "go.mod", "requirements-dev.txt", "Requirements.TXT", "Dockerfile", "my-ci.yaml",
    "specific.toml", "other.yml", "Makefile", "random.txt", "DESCRIPTION", "renovate.YML", "notice",
]
ROOT_SQL = "concat(case when doc_id % 5 = 4 then 'sub/' else '' end, case doc_id % 15 " + " ".join(
    f"when {i} then '{n}'" for i, n in enumerate(ROOT_NAMES)) + " end)"


def _root_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = views._pick(F.col("doc_id") % 15, [F.lit(n) for n in ROOT_NAMES])
    return views.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), F.col("lang")).alias("project"),
        F.concat(F.when(F.col("doc_id") % 5 == 4, "sub/").otherwise(F.lit("")), name).alias("path"),
    ).distinct()


@query("important_files", f"""
select project, name, category from (
 select project, path as name, case when regexp_matches(upper(path), '^(README|CONTRIBUTING|LICENSE|COPYING|NOTICE|CHANGELOG)') then 0
  when path in ('go.mod', 'DESCRIPTION') or regexp_matches(path, '(?i)^requirements.*\\.txt$') then 1
  when path in ('Dockerfile', 'Makefile') or (regexp_matches(lower(path), '\\.(yaml|yml|toml)$') and regexp_matches(lower(path), 'ci|renovate')) then 2 end as category
 from (select distinct concat(source, '-', lang) as project, {ROOT_SQL} as path from documents)
 where not contains(path, '/')) where category is not null""")
def important_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.important_files(_root_names(spark, sf_dir))


@query("find_readme", f"""
select project, case when min(case lower(path) when 'readme.md' then 0 else 1 end) = 0 then 'README.md' else 'readme.rst' end as path
from (select distinct concat(source, '-', lang) as project, {ROOT_SQL} as path from documents)
where lower(path) in ('readme.md', 'readme.rst') group by project""")
def find_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.find_readme(_root_names(spark, sf_dir))


EXCERPT_SQL = """
with raw as (select project, string_split(substring(content, position('# ' in content)), chr(10)) as ls from files where path = 'README.md'),
l as (select project, n, ls[n] as line from (select project, ls, unnest(range(1, len(ls) + 1)) as n from raw)),
first40 as (select project, n, line, lag(trim(line)) over (partition by project order by n) as before from l where n <= 40),
packed as (select project, n, line from first40 where not (trim(line) = '' and coalesce(before, 'x') = '')),
ends as (select project, max(n) as last from packed where trim(line) <> '' group by project)
select p.project, 'README.md' as path, string_agg(line, chr(10) order by n) as excerpt from packed p join ends e on p.project = e.project and n <= last group by p.project"""


@query("readme_excerpt", EXCERPT_SQL)
def readme_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.readme_excerpts(views.files(spark, sf_dir))


LINE_KINDS = [
    "[![a](b)](c) [![d](e)](f)", "![x](y)", '<img src="z"/>', '<a href="u"><img src="v"></a>', '<p align="center">', "<pre align=left>",
    "<hr>", "<sup>short label</sup>", "<b>a longer sentence that goes on.</b>", "text ![x](y)",
]


@query("badge_lines", """
select doc_id, k <= 3 as badge, k in (4) as opens, k in (0, 1, 9) = false and k <> 8 and k <> 10 as contentless from (select doc_id, doc_id % 11 as k from documents)""")
def badge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document tagged with one kind of line, prose at the end."""
    kinds = [F.lit(k) for k in LINE_KINDS] + [F.regexp_extract("text", r"[A-Za-z].{5}", 0)]
    line = views._pick(F.col("doc_id") % 11, kinds)
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", summary.is_badge_line(line).alias("badge"), summary.opens_banner(line).alias("opens"),
        summary.is_contentless_html(line).alias("contentless"),
    )


@query("summary", f"""
with langs as ({HISTOGRAM.format(where="true")}),
l as (select project, string_agg(concat(name, '=', file_count, '=', share), ' ' order by file_count desc, name) as languages from langs group by project),
t as (select project, count(*) as total_files from files group by project),
i as (select project, string_agg(path, ' ' order by case path when 'go.mod' then 1 else 0 end, lower(path)) as important_files from files where path in ('README.md', 'LICENSE', 'go.mod') group by project)
select t.project, total_files, languages, important_files, 'README.md' as readme_path, excerpt from t join l on t.project = l.project join i on t.project = i.project
join ({EXCERPT_SQL}) x on x.project = t.project""")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.summary(views.files(spark, sf_dir))
    named = F.transform("languages", lambda x: F.concat_ws("=", x["name"], x["file_count"].cast("string"), x["share"].cast("string")))
    return s.select(
        "project", "total_files", F.array_join(named, " ").alias("languages"),
        F.array_join("important_files", " ").alias("important_files"), "readme_path", "excerpt",
    )


READS_SQL = r"""
with j as (select r.*, f.content, case when right(f.content, 1) = chr(10) then string_split(f.content, chr(10))[:-2] else string_split(f.content, chr(10)) end as ls
 from read_requests r left join files f on r.project = f.project and r.path = f.path),
s as (select *, len(ls) as total, octet_length(encode(content)) as size,
 case when line_range = '2-4' then 2 when line_range = '3' then 3 when line_range = '500-510' then 500 else 1 end as a,
 case when line_range = '2-4' then least(4, len(ls)) when line_range = '3' then least(3, len(ls)) when line_range = '500-510' then least(510, len(ls)) else len(ls) end as b from j),
e as (select *, case when content is null then 'stat: no such file'
  when line_range = '' and size > 102400 then concat('exceeds --max-size limit (', size, ' bytes > 102400 bytes)')
  when line_range = '9-2' then 'lines flag: --lines range start > end' when line_range = 'x' then 'lines flag: invalid --lines value; expected START or START-END' end as error from s),
n as (select *, case when error is null and a > b then concat('requested lines ', case line_range when '' then '0-0' when '3' then '3-3' else line_range end, ' out of range: file has ', total, ' lines') end as note from e),
x as (select *, case when error is not null then concat('  <file path="', path, '" error="', replace(error, '>', '&gt;'), '"/>', chr(10))
 when note is not null then concat('  <file path="', path, '" note="', note, '"/>', chr(10))
 else concat('  <file path="', path, '" lines="', a, '-', b, '">', chr(10), '<![CDATA[', chr(10),
  array_to_string(list_transform(range(a, b + 1), lambda i: concat(lpad(cast(i as varchar), cast(length(cast(b as varchar)) as int), ' '), ' | ', replace(ls[i], ']]>', ']]]]><![CDATA[>'), chr(10))), ''), ']]>', chr(10), '  </file>', chr(10)) end as xml from n)"""


@query("read_ranges", READS_SQL + """
select req_id, pos, path, cast(a as bigint) as first, cast(b as bigint) as last, xml from x where error is null and note is null""")
def read_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read.read_files(views.files(spark, sf_dir), views.read_requests(spark, sf_dir))
    return out.where("error is null and note is null").select("req_id", "pos", "path", "first", "last", "xml")


@query("read_errors", READS_SQL + "select req_id, pos, path, error, note from x where error is not null or note is not null")
def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read.read_files(views.files(spark, sf_dir), views.read_requests(spark, sf_dir))
    return out.where("error is not null or note is not null").select("req_id", "pos", "path", "error", "note")


@query("read_unsafe", """
select doc_id as pos, case doc_id % 5 when 0 then concat('../', path, ': escapes the project root') when 1 then concat('/', path, ': absolute paths are not allowed')
 when 2 then 'is a directory' when 3 then null else concat('a/../.git/', path, ': git metadata is not readable') end as error from files where contains(path, '/')""")
def read_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that climb, folders, and odd spellings of good paths."""
    f = views.files(spark, sf_dir).where(F.col("path").contains("/"))
    path = views._pick(F.col("doc_id") % 5, [
        F.concat(F.lit("../"), "path"), F.concat(F.lit("/"), "path"), F.regexp_extract("path", r"\A(.*)/", 1),
        F.concat(F.lit("./x/.././"), "path"), F.concat(F.lit("a/../.git/"), "path")])
    asked = f.select(F.col("project").alias("req_id"), "project", path.alias("path"), F.col("doc_id").alias("pos"), F.lit("").alias("line_range"))
    return read.read_files(views.files(spark, sf_dir), asked, max_kb=10_000).select("pos", "error")


@query("xml_bundle", READS_SQL + """,
g as (select req_id, cast(pos // 100 as bigint) as part, count(*) as files, string_agg(xml, '' order by pos) as body from x group by 1, 2),
h as (select req_id, min(part) as head, max(part) as tail from g group by 1)
select g.req_id, part, files, concat(case when part = head then concat('<files version="1" command="read-files">', chr(10)) else '' end, body, case when part = tail then concat('</files>', chr(10)) else '' end) as xml
from g join h on g.req_id = h.req_id""")
def xml_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.bundle(read.read_files(views.files(spark, sf_dir), views.read_requests(spark, sf_dir)))


@query("json_envelope", f"""
with langs as ({HISTOGRAM.format(where="true")})
select project, concat('{{"_meta":{{"version":"1","command":"detect"}},"name":"', project, '","languages":[', string_agg(concat('{{"name":"', name, '","file_count":', file_count, ',"share":', share, '}}'), ',' order by file_count desc, name), '],"total_files":', sum(file_count), '}}') as json
from langs group by project""")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.summary(views.files(spark, sf_dir)).select(
        "project", F.col("project").alias("name"),
        F.transform("languages", lambda x: F.struct(x["name"].alias("name"), x["file_count"].alias("file_count"), x["share"].alias("share"))).alias("languages"),
        "total_files", F.lit(None).cast("string").alias("absent"),
    )
    return s.select("project", read.json_envelope(s, "detect", ["name", "languages", "total_files", "absent"]).alias("json"))


@query("utf8_prefix", """
select project, path, n_bytes, case when whole then content else left(content, cast(n_chars as int)) end as head from (
 select project, path, content, octet_length(encode(content)) < 301 as whole, n_bytes, n_chars from (
  select project, path, content, least(octet_length(encode(content)), octet_length(encode(left(content, cast(k as int))))) as n_bytes, k as n_chars from (
   select project, path, content, (select max(i) from range(0, 302) t(i) where octet_length(encode(left(content, cast(i as int)))) <= 301) as k from files)))""")
def utf8_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = text.utf8_prefix("content", 301)
    return views.files(spark, sf_dir).select("project", "path", text.byte_len(head).alias("n_bytes"), head.alias("head"))


@query("line_ranges", """
select o_orderkey, asked, case k when 1 then a when 2 then a when 6 then 7 else 0 end as first, case k when 1 then a when 2 then a + 5 when 6 then 9 else 0 end as last,
 case k when 3 then '--lines range start > end' when 4 then 'invalid --lines range; expected START-END' when 5 then 'invalid --lines value; expected START or START-END' end as problem
from (select o_orderkey, o_orderkey % 7 as k, o_custkey as a, case o_orderkey % 7 when 0 then ' ' when 1 then cast(o_custkey as varchar) when 2 then concat(' ', o_custkey, ' - ', o_custkey + 5) when 3 then concat(o_custkey + 1, '-', o_custkey) when 4 then concat('-', o_custkey) when 5 then 'abc' else '+7-9' end as asked from orders)""")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_custkey").cast("string"), (F.col("o_custkey") + 5).cast("string")
    asked = views._pick(F.col("o_orderkey") % 7, [
        F.lit(" "), a, F.concat(F.lit(" "), a, F.lit(" - "), b), F.concat((F.col("o_custkey") + 1).cast("string"), F.lit("-"), a),
        F.concat(F.lit("-"), a), F.lit("abc"), F.lit("+7-9")])
    out = views.table(spark, sf_dir, "orders").select("o_orderkey", asked.alias("asked"), text.line_range(asked).alias("r"))
    return out.select("o_orderkey", "asked", "r.first", "r.last", "r.problem")

