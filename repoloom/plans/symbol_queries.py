"""Queries that extract symbols and read the symbol index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import symbols as ops
from . import views
from .catalog import query

SHOWN = "project, path, name, kind, line, end_line, parent, lang"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NAME = LOWER.format("name")


@query("extract_python", "select * from symbols")
def extract_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build_index(views.code_files(spark, sf_dir))


def known(ext: str, lang: str, owner: str, owner_kind: str, owner_line: str, owner_end: str, line: str, end: str,
          kind: str = "method", parent: str = "cls") -> str:
    """SQL for the symbols of a code template."""
    return f"""
select project, concat(stem, '{ext}') as path, member as name, '{kind}' as kind, cast({line} as int) as line, cast({end} as int) as end_line, cast({parent} as varchar) as parent, '{lang}' as lang from parts
union all select project, concat(stem, '{ext}'), {owner}, '{owner_kind}', {owner_line}, cast({owner_end} as int), null, '{lang}' from parts where rn = 1"""


GO_SQL = known(".go", "go", "cls", "struct", "4", "6", "3 + 5 * rn", "6 + 5 * rn")


JAVA_SQL = known(".java", "java", "cls", "class", "4", "5 + 3 * n", "2 + 3 * rn", "4 + 3 * rn")
TS_SQL = known(".ts", "typescript", "cls", "class", "2", "3 + 3 * n", "3 * rn", "2 + 3 * rn")
TSX_SQL = known(".tsx", "tsx", "concat(cls, 'Props')", "interface", "2", "4", "2 + 3 * rn", "4 + 3 * rn", "function", "null")


@query("extract_go", GO_SQL)
def extract_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build_index(views.code_files(spark, sf_dir, "go"))


@query("extract_java", JAVA_SQL)
def extract_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build_index(views.code_files(spark, sf_dir, "java"))


@query("extract_ts", TS_SQL)
def extract_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build_index(views.code_files(spark, sf_dir, "typescript"))


@query("extract_tsx", TSX_SQL)
def extract_tsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build_index(views.code_files(spark, sf_dir, "tsx"))


@query("build_index", " union all ".join(f"select * from ({q})" for q in ("select * from symbols", GO_SQL, JAVA_SQL, TS_SQL, TSX_SQL)))
def build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All languages at once, among prose that defines nothing."""
    mixed = views.files(spark, sf_dir).select("project", "path", "content")
    for lang in views.CODE:
        mixed = mixed.unionByName(views.code_files(spark, sf_dir, lang))
    return ops.build_index(mixed)


@query("extract_totals", "select project, cast(count(distinct path) as bigint) as files_parsed, count(*) as symbols from symbols group by project")
def extract_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extract_totals(views.code_files(spark, sf_dir))


@query("parents", f"select path, name, line, coalesce(parent, '') as container from symbols")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.extract_definitions(views.code_files(spark, sf_dir)).drop("container")
    return ops.enclosing_parents(found).select("path", "name", "line", F.coalesce("container", F.lit("")).alias("container"))


@query("promote_method", "select path, name, case kind when 'method' then 'function' else kind end as raw_kind, kind from symbols")
def promote_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.extract_definitions(views.code_files(spark, sf_dir))
    return ops.to_symbols(found.withColumn("path", F.concat("kind", F.lit(":"), "path"))).select(
        F.substring_index("path", ":", -1).alias("path"), "name", F.substring_index("path", ":", 1).alias("raw_kind"), "kind"
    )


@query("go_receiver", "select k, concat('T', k) as receiver from (select p_partkey as k from part) where k % 3 <> 2 union all select p_partkey, null from part where p_partkey % 3 = 2")
def go_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivers with a pointer, with type parameters, and a plain function."""
    k = F.col("p_partkey").cast("string")
    head = views._pick(F.col("p_partkey") % 3, [
        F.concat(F.lit("func (x  *  T"), k, F.lit(" ) Run() error {")), F.concat(F.lit("func (y T"), k, F.lit("[K, V]) Get(k K) V {")),
        F.concat(F.lit("func T"), k, F.lit("() {}"))])
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), ops.go_receiver(head).alias("receiver"))


@query("tag_kinds", """
select event_id, case event_type when 'view' then 'view' when 'click' then null when 'signup' then null else event_type end as kind from events""")
def tag_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    tag = F.when(kind == "click", F.concat(F.lit("reference."), kind)).when(kind == "signup", "definition.").otherwise(
        F.concat(F.lit("definition."), kind))
    return views.table(spark, sf_dir, "events").select("event_id", ops.normalize_kind(tag).alias("kind"))


def capped(where: str, order: str, limit: int, columns: str = SHOWN, source: str = "symbols") -> str:
    """SQL for a filtered, ordered and capped symbol query."""
    return f"""
select {columns}, hits > {limit} as truncated from (
 select *, row_number() over (order by {order}) as rn, count(*) over () as hits from {source} where {where}) where rn <= {limit}"""


@query("symbols_project", capped("project = 'brand11' and kind in ('method', 'class') and lang in ('go', 'python')", "project, path, line, name", 30))
def symbols_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.symbols_in_project(views.symbols(spark, sf_dir), "brand11", kinds=["method, class"], langs=["python,go"], limit=30)


@query("symbols_project_uncapped", "select " + SHOWN + ", false as truncated from symbols where project = 'brand12'")
def symbols_project_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.symbols_in_project(views.symbols(spark, sf_dir), "brand12", limit=0)


@query("symbols_file", capped(
    "project = 'brand11' and path = (select min(path) from symbols where project = 'brand11')", "line", 500,
    "path, name, kind, line, end_line, parent, lang, cast(rn - 1 as int) as def_ix"))
def symbols_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = views.code_files(spark, sf_dir)
    path = code.where("project = 'brand11'").agg(F.min("path")).first()[0]
    return ops.symbols_in_file(code, "brand11", path)


@query("symbols_cross", capped(f"{NAME} like '%re%d%' and kind = 'method'", "project, path, line, name", 100))
def symbols_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.symbols_across(views.symbols(spark, sf_dir), "*RE*D*", ["method"], limit=100)


@query("symbols_cross_listed", capped(f"project in ('brand11', 'brand23') and contains({NAME}, 'e')", "project, path, line, name", 500))
def symbols_cross_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.symbols_across(views.symbols(spark, sf_dir), "E", projects=["brand11", "brand23"])


@query("symbols_like", f"select {SHOWN} from symbols where {NAME} like 'm1%_b%' escape chr(1)")
def symbols_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filter_symbols(views.symbols(spark, sf_dir), "M1%_b%")


@query("symbols_batch", f"""
with asked as (select concat(project, k) as req_id, project, case k when 0 then '%' when 1 then 'm_1%' else '%s%' end as pattern,
  case k when 0 then 'class' when 1 then '' else 'method' end as want from (select distinct project from symbols), (select unnest(range(3)) as k))
select req_id, {SHOWN}, hits > 12 as truncated from (
 select a.req_id, s.*, row_number() over (partition by a.req_id order by s.path, s.line, s.name) as rn, count(*) over (partition by a.req_id) as hits
 from symbols s join asked a on s.project = a.project where {NAME} like a.pattern and (a.want = '' or a.want = s.kind)) where rn <= 12""")
def symbols_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.symbols(spark, sf_dir)
    k = F.col("k")
    none = F.array().cast("array<string>")
    asked = s.select("project").distinct().select("project", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(
        F.concat("project", k.cast("string")).alias("req_id"), "project",
        views._pick(k, [F.lit(""), F.lit("m_1%"), F.lit("S")]).alias("name"),
        views._pick(k, [F.array(F.lit("class")), none, F.array(F.lit("method"))]).alias("kinds"), none.alias("langs"),
    )
    return ops.find_symbols_batch(s, asked, limit=12)


@query("symbols_batch_limits", f"""
with asked as (select distinct project as req_id, project, cast(substring(md5(project), 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7') as int) * 7 as lim from symbols)
select req_id, {SHOWN}, lim > 0 and hits > lim as truncated from (
 select a.req_id, a.lim, s.*, row_number() over (partition by a.req_id order by s.path, s.line, s.name) as rn, count(*) over (partition by a.req_id) as hits
 from symbols s join asked a on s.project = a.project where s.kind <> 'type') where lim = 0 or rn <= lim""")
def symbols_batch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with limits of their own, 0 for all, and null lists."""
    s = views.symbols(spark, sf_dir).where("kind <> 'type'")
    none = F.lit(None).cast("array<string>")
    asked = s.select("project").distinct().select(
        F.col("project").alias("req_id"), "project", F.lit("").alias("name"), none.alias("kinds"), none.alias("langs"),
        F.when(F.substring(F.md5("project"), 1, 1) < "8", 7).otherwise(0).alias("limit"))
    return ops.find_symbols_batch(s, asked)


VERSIONS_SQL = """
select project, path, name, kind, line, end_line, parent from symbols
union all select concat(project, '@v2'), path, case when line % 12 = 4 then concat(name, '_new') else name end, kind,
 case when line % 12 = 6 then line + 1 else line end, end_line, parent from symbols where line % 12 <> 2"""


def _two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project and a second version of it, from one pass over symbols."""
    s = views.symbols(spark, sf_dir).drop("lang")
    v2 = F.struct(
        F.concat("project", F.lit("@v2")).alias("project"),
        F.when(F.col("line") % 12 == 4, F.concat("name", F.lit("_new"))).otherwise(F.col("name")).alias("name"),
        F.when(F.col("line") % 12 == 6, F.col("line") + 1).otherwise(F.col("line")).alias("line"),
    )
    both = F.array_compact(F.array(F.struct("project", "name", "line"), F.when(F.col("line") % 12 != 2, v2)))
    return s.select("path", "kind", "end_line", "parent", F.explode(both).alias("v")).select("*", "v.*").drop("v")


@query("symbols_versions", """
with versions as (""" + VERSIONS_SQL + """),
o as (select project, path, name, kind, coalesce(parent, '') as parent, count(*) n, min(line) l, sum(line) s from versions where not contains(project, '@') group by all),
w as (select replace(project, '@v2', '') as project, path, name, kind, coalesce(parent, '') as parent, count(*) n, min(line) l, sum(line) s from versions where contains(project, '@') group by all)
select coalesce(o.project, w.project) as old, concat(coalesce(o.project, w.project), '@v2') as new, coalesce(o.path, w.path) as path, coalesce(o.name, w.name) as name,
 coalesce(o.kind, w.kind) as kind, coalesce(o.parent, w.parent) as parent,
 case when o.n is null then 'added' when w.n is null then 'removed' when o.n <> w.n then 'recounted' else 'moved' end as status, coalesce(o.l, 0) as old_line, coalesce(w.l, 0) as new_line
from o full join w on o.project = w.project and o.path = w.path and o.name = w.name and o.kind = w.kind and o.parent = w.parent
where o.n is null or w.n is null or o.n <> w.n or o.s <> w.s or o.l <> w.l""")
def symbols_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _two_versions(spark, sf_dir)
    pairs = views.symbols(spark, sf_dir).select(F.col("project").alias("old")).distinct().withColumn("new", F.concat("old", F.lit("@v2")))
    return ops.compare_versions(both, pairs)


def _asked(symbols: DataFrame, **given) -> tuple[int | None, str | None]:
    """Rows of a query over all checkouts, or why it is refused."""
    try:
        return ops.symbols_across(symbols, **given, limit=0).count(), None
    except ValueError as error:
        return None, str(error)


KNOWN_LANGS = "('go', 'java', 'python', 'tsx', 'typescript')"


@query("lang_guard", f"""
select label, case when label in {KNOWN_LANGS} then (select count(*) from symbols where lang = label) end as found,
 case when label not in {KNOWN_LANGS} then concat('unsupported language ', chr(39), label, chr(39), '; supported: go, java, python, tsx, typescript') end as problem
from (select distinct lang as label from documents union select distinct lang from symbols union select unnest(['go', 'java', 'tsx', 'Go'])) q""")
def lang_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the index and of the documents as filters: those that are no source languages are refused."""
    index = views.symbols(spark, sf_dir)
    labels = {r.lang for r in views.table(spark, sf_dir, "documents").select("lang").union(index.select("lang")).distinct().collect()}
    rows = [(label, *_asked(index, langs=[label])) for label in sorted(labels | {"go", "java", "tsx", "Go"})]
    return spark.createDataFrame(rows, "label string, found long, problem string")


@query("cross_project_guard", f"""
with p as (select distinct project from symbols), w as (select 'a query over all checkouts needs a name, a kind or a language' as problem)
select project as asked, cast(null as bigint) as found, problem from p, w
union all select '', null, problem from w
union all select concat(project, ' kind'), (select count(*) from symbols s where s.project = p.project and kind = 'class'), null from p
union all select ' name', (select count(*) from symbols where contains({NAME}, 'red')), null""")
def cross_project_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all or listed checkouts a name, a kind or a language has to be given."""
    index = views.symbols(spark, sf_dir)
    rows = [("", *_asked(index)), (" name", *_asked(index, name="*red*"))]
    for r in index.select("project").distinct().collect():
        rows += [(r.project, *_asked(index, projects=[r.project])), (f"{r.project} kind", *_asked(index, projects=[r.project], kinds=["class"]))]
    return spark.createDataFrame(rows, "asked string, found long, problem string")
