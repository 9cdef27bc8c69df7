"""Queries over the registry tables and their maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import maintain, registry
from . import views
from .catalog import query

AT_SQL = "timestamp '2024-06-01 12:00:00'"


def now() -> Column:
    """The time every change is stamped with."""
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


@query("valid_names", r"""
select page_id, name, case when name = '' then 'empty' when name in ('.', '..') then 'dots'
 when contains(name, '/') or contains(name, '\') then 'separator' when contains(name, '@') then 'at sign'
 when contains(name, chr(0)) then 'nul' end as problem from (
 select page_id, case page_id % 8 when 0 then '' when 1 then '..' when 2 then url when 3 then concat('r', page_id, '@v1') when 4 then concat('a\', page_id)
  when 5 then concat('n', chr(0), page_id) when 6 then concat('.r', page_id) else concat('repo_', page_id, '.js') end as name from pages)""")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, n = views.table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    nul = F.unhex(F.lit("00")).cast("string")
    name = views._pick(F.col("page_id") % 8, [
        F.lit(""), F.lit(".."), F.col("url"), F.concat(F.lit("r"), n, F.lit("@v1")), F.concat(F.lit("a\\"), n),
        F.concat(F.lit("n"), nul, n), F.concat(F.lit(".r"), n), F.concat(F.lit("repo_"), n, F.lit(".js"))])
    return pages.select("page_id", name.alias("name")).withColumn("problem", paths.repo_name_problem("name"))


REFS_BY_KEY = [
    "main", "release/1.x", "v1@2", "HEAD", "@", "b@{1}", "refs/heads/b", "origin/b", "-b", "a..b", "/b", "b/", "a//b",
    "a b", "a~1", "a^2", "a:b", "a?", "a*", "a[b", "a/./b", "a\\b", "",
]
REF_SQL = "case o_orderkey % 23 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(REFS_BY_KEY)) + " end"


@query("valid_refs", rf"""
select o_orderkey, ref, case when ref = '' then 'empty' when ref in ('HEAD', '@') or contains(ref, '@{{') then 'symbolic'
 when ref like 'refs/%' or ref like 'origin/%' then 'prefixed' when ref like '-%' then 'dash' when contains(ref, '..') then 'dot dot'
 when ref like '/%' or ref like '%/' or contains(ref, '//') then 'component'
 when regexp_matches(ref, '[\\ ~^:?*\[]') then 'character' when list_contains(string_split(ref, '/'), '.') then 'component' end as problem
from (select o_orderkey, {REF_SQL} as ref from orders)""")
def valid_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = views._pick(F.col("o_orderkey") % 23, [F.lit(r) for r in REFS_BY_KEY])
    return views.table(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref")).withColumn(
        "problem", paths.ref_name_problem("ref")
    )


@query("safe_paths", """
select asked, case doc_id % 6 when 0 then concat(asked, ': absolute paths are not allowed') when 1 then concat(asked, ': git metadata is not readable')
 when 2 then concat(asked, ': escapes the project root') end as problem from (
 select doc_id, case doc_id % 6 when 0 then concat('/', path) when 1 then concat('./.git/', path) when 2 then concat('a/../../', path)
  when 3 then concat('sub/../', path) when 4 then concat('sub/.git/', path) else path end as asked from files)""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    asked = views._pick(F.col("doc_id") % 6, [
        F.concat(F.lit(p), "path") for p in ("/", "./.git/", "a/../../", "sub/../", "sub/.git/", "")])
    return f.select(asked.alias("asked")).withColumn("problem", paths.path_problem("asked"))


@query("split_ids", """
select id, repo_part, ref_part, concat(repo_part, '@', replace(ref_part, '/', '-')) as dir from (
 select id, string_split(id, '@')[1] as repo_part, case when contains(id, '@') then substring(id, position('@' in id) + 1) else '' end as ref_part
 from (select case when id = repo then id when kind = 'tag' then concat(id, '@x/y') else id end as id from checkouts))""")
def split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    handle = F.when(F.col("kind") == "tag", F.concat("id", F.lit("@x/y"))).otherwise(F.col("id"))
    ids = views.checkouts(spark, sf_dir).select(handle.alias("id"))
    return ids.select(
        "id", paths.id_repo("id").alias("repo_part"), paths.id_ref("id").alias("ref_part"),
        paths.checkout_dir(paths.id_repo("id"), paths.id_ref("id")).alias("dir"),
    )


@query("names_from_urls", r"""
select url, case when n in ('', '.', '..') or regexp_matches(n, '[/\\@]') then '' else n end as name from (
 select url, regexp_extract(regexp_replace(regexp_replace(trim(url), '/$', ''), '\.git$', ''), '([^/:]*)$', 1) as n
 from (select case page_id % 5 when 0 then concat(' ', url, '.git ') when 1 then concat('git@host:x/p', page_id, '.git') when 2 then concat(url, '/..') when 3 then concat('user@', page_id) else url end as url from pages))""")
def names_from_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    url = views._pick(F.col("page_id") % 5, [
        F.concat(F.lit(" "), "url", F.lit(".git ")), F.concat(F.lit("git@host:x/p"), n, F.lit(".git")),
        F.concat("url", F.lit("/..")), F.concat(F.lit("user@"), n), F.col("url")])
    return views.table(spark, sf_dir, "pages").select(url.alias("url")).withColumn("name", paths.name_from_url("url"))


PROJECTS_SQL = """
select c.id, c.repo, r.url, r.path as repo_path, r.shallow, r.fetched_at, c.ref, c.kind, c.commit_hash, c.path, c.updated_at, c.parsed_at
from checkouts c join repos r on r.name = c.repo"""


@query("projects", PROJECTS_SQL)
def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.default_first(registry.projects(views.checkouts(spark, sf_dir), views.repos(spark, sf_dir)))


CHECKOUT_TEXT = "concat(id, ' ', ref, ' ', kind, ' ', commit_hash, ' ', path, ' ', strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ'), ' ', coalesce(strftime(parsed_at, '%Y-%m-%dT%H:%M:%SZ'), '-'))"


@query("list_repos", f"""
select repo as name, any_value(url) as url, any_value(repo_path) as path, any_value(shallow) as shallow,
 strftime(any_value(fetched_at), '%Y-%m-%dT%H:%M:%SZ') as fetched_at, 0 as part, 1 as parts,
 string_agg({CHECKOUT_TEXT}, chr(10) order by id <> repo, id) as checkouts
from ({PROJECTS_SQL}) group by repo""")
def list_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = registry.list_repos(views.checkouts(spark, sf_dir), views.repos(spark, sf_dir))
    return nested.withColumn("checkouts", F.array_join(F.transform("checkouts", lambda c: F.concat_ws(
        " ", c["id"], c["ref"], c["kind"], c["commit"], c["path"], c["updated_at"], F.coalesce(c["parsed_at"], F.lit("-"))
    )), "\n"))


@query("repo_checkouts", f"select * from ({PROJECTS_SQL}) where repo in (select source from documents where lang = 'es' and n_chars > 2000)")
def repo_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.table(spark, sf_dir, "documents").where("lang = 'es' and n_chars > 2000").select(F.col("source").alias("repo"))
    return registry.repo_checkouts(views.checkouts(spark, sf_dir), views.repos(spark, sf_dir), wanted)


@query("lookup_or_hint", """
with asked as (select distinct case doc_id % 4 when 0 then source when 1 then concat(source, '@', lang) when 2 then concat(source, '@v', doc_id) else concat('x', source, '@v') end as handle from documents)
select handle, case when c.id is not null then 'ok' when contains(handle, '@') and b.id is not null then 'no such checkout' else 'not tracked' end as status,
 case when c.id is not null then null when contains(handle, '@') and b.id is not null then concat('pin ', string_split(handle, '@')[2], ' of ', b.id, ' first') else 'list the tracked repos' end as hint,
 c.repo, c.ref, c.kind, c.commit_hash
from asked left join checkouts c on c.id = handle left join checkouts b on b.id = string_split(handle, '@')[1]""")
def lookup_or_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    handle = views._pick(F.col("doc_id") % 4, [
        F.col("source"), F.concat("source", F.lit("@"), "lang"),
        F.concat("source", F.lit("@v"), F.col("doc_id").cast("string")), F.concat(F.lit("x"), "source", F.lit("@v"))])
    return registry.lookup(docs.select(handle.alias("handle")), views.checkouts(spark, sf_dir), views.repos(spark, sf_dir))


CLASHING_SQL = """
select id, repo, ref from checkouts
union all select concat(repo, '@', upper(ref)), repo, upper(ref) from checkouts where kind = 'tag'
union all select concat(repo, '@x/', ref), repo, concat('x/', ref) from checkouts where kind = 'commit'
union all select concat(repo, '@x-', ref), repo, concat('x-', ref) from checkouts where kind = 'commit'"""


@query("path_conflicts", f"""
select id, repo, folder, holders, first_id from (
 select id, repo, folder, count(*) over (partition by repo, folder) as holders, min(id) over (partition by repo, folder) as first_id
 from (select id, repo, lower(case when id = repo then repo else concat(repo, '@', replace(ref, '/', '-')) end) as folder from ({CLASHING_SQL})))
where holders > 1""")
def path_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.checkouts(spark, sf_dir).select("id", "repo", "ref", "kind")

    def extra(kind: str, ref) -> DataFrame:
        return c.where(F.col("kind") == kind).select(paths.checkout_id("repo", ref).alias("id"), "repo", ref.alias("ref"), "kind")

    more = extra("tag", F.upper("ref")).unionByName(extra("commit", F.concat(F.lit("x/"), "ref"))).unionByName(
        extra("commit", F.concat(F.lit("x-"), "ref")))
    return registry.path_conflicts(c.unionByName(more))


def _brand_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkouts that own the derived symbols, and one without any."""
    names = views.table(spark, sf_dir, "part").select(
        F.concat(F.lit("brand"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("id")
    ).distinct()
    all_ids = names.unionByName(views.repos(spark, sf_dir).select(F.col("name").alias("id")))
    return all_ids.select(
        "id", F.col("id").alias("repo"), F.lit("main").alias("ref"), F.lit("branch").alias("kind"),
        F.md5("id").alias("commit_hash"), F.concat(F.lit("/data/"), "id").alias("path"),
        F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("parsed_at"),
    )


BRANDS_SQL = "select distinct concat('brand', replace(p_brand, 'Brand#', '')) as id from part union all select name from repos"


@query("symbols_count", f"select b.id, count(s.project) as symbol_count from ({BRANDS_SQL}) b left join symbols s on s.project = b.id group by b.id")
def symbols_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.count_symbols(_brand_checkouts(spark, sf_dir), views.symbols(spark, sf_dir))


ARRIVING_SQL = f"""
select case when substring(name, 4) in ('3', '7') then name else concat('new', name) end as name, url, path, shallow, fetched_at from repos"""


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.substring("name", 4, 20).isin("3", "7")
    return views.repos(spark, sf_dir).withColumn("name", F.when(kept, F.col("name")).otherwise(F.concat(F.lit("new"), "name")))


@query("insert_repo", f"select * from repos union all select * from ({ARRIVING_SQL}) where name like 'new%'")
def insert_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.insert_repos(views.repos(spark, sf_dir), _arriving(spark, sf_dir))[0]


@query("insert_repo_outcome", f"select name, case when name like 'new%' then 'inserted' else 'duplicate' end as outcome from ({ARRIVING_SQL})")
def insert_repo_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.insert_repos(views.repos(spark, sf_dir), _arriving(spark, sf_dir))[1]


NEW_CHECKOUTS_SQL = """
select case kind when 'tag' then id when 'commit' then concat('gone', id) else concat(id, '-next') end as id,
 case kind when 'commit' then concat('gone', repo) else repo end as repo, ref, kind, commit_hash, path, updated_at, parsed_at from checkouts"""


def _new_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    return views.checkouts(spark, sf_dir).withColumn(
        "id", F.when(kind == "tag", F.col("id")).when(kind == "commit", F.concat(F.lit("gone"), "id")).otherwise(F.concat("id", F.lit("-next")))
    ).withColumn("repo", F.when(kind == "commit", F.concat(F.lit("gone"), "repo")).otherwise(F.col("repo")))


@query("insert_checkout", f"select * from checkouts union all select * from ({NEW_CHECKOUTS_SQL}) where kind = 'branch'")
def insert_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.insert_checkouts(
        views.checkouts(spark, sf_dir), views.repos(spark, sf_dir), _new_checkouts(spark, sf_dir))[0]


@query("insert_checkout_outcome", f"select id, case kind when 'tag' then 'duplicate' when 'commit' then 'no such repo' else 'inserted' end as outcome from ({NEW_CHECKOUTS_SQL})")
def insert_checkout_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.insert_checkouts(
        views.checkouts(spark, sf_dir), views.repos(spark, sf_dir), _new_checkouts(spark, sf_dir))[1]


def _replaced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Odd brands were re-read: even lines are gone, one brand is empty now."""
    s = views.symbols(spark, sf_dir)
    odd = F.substring("project", -1, 1).isin("1", "3")
    parsed = s.where(odd).select("project").distinct()
    fresh = s.where((F.col("line") % 4 == 0) & ~F.col("project").endswith("1"))
    return maintain.replace_symbols(s, _brand_checkouts(spark, sf_dir), fresh, parsed, now())


@query("replace_symbols", "select * from symbols where right(project, 1) not in ('1', '3') or (line % 4 = 0 and right(project, 1) <> '1')")
def replace_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir)[0]


@query("replace_symbols_stamp", f"select id, case when id like 'brand%' and right(id, 1) in ('1', '3') then {AT_SQL} end as parsed_at from ({BRANDS_SQL})")
def replace_symbols_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir)[1].select("id", "parsed_at")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources ending in 1, and names nobody tracks."""
    n = views.repos(spark, sf_dir).select("name")
    return n.where(F.col("name").endswith("1")).unionByName(
        n.where(F.col("name").endswith("2")).select(F.concat(F.lit("no"), "name").alias("name")))


@query("delete_repo", "select name, url, path, shallow from repos where name not like '%1'")
def delete_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = maintain.delete_repos(
        views.repos(spark, sf_dir), views.checkouts(spark, sf_dir), views.symbols(spark, sf_dir), _names(spark, sf_dir))
    return tables[0].select("name", "url", "path", "shallow")


@query("delete_repo_checkouts", "select * from checkouts where repo not like '%1'")
def delete_repo_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.delete_repos(
        views.repos(spark, sf_dir), views.checkouts(spark, sf_dir), views.symbols(spark, sf_dir), _names(spark, sf_dir))[1]


@query("delete_repo_symbols", "select * from symbols where project not like '%1'")
def delete_repo_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _brand_checkouts(spark, sf_dir)
    names = c.where(F.col("id").endswith("1")).select(F.col("id").alias("name"))
    return maintain.delete_repos(views.repos(spark, sf_dir), c, views.symbols(spark, sf_dir), names)[2]


@query("delete_repo_report", """
select repo, id, 'removed' as outcome from checkouts where repo like '%1'
union all select concat('no', name), null, 'not found' from repos where name like '%2'""")
def delete_repo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.delete_repos(
        views.repos(spark, sf_dir), views.checkouts(spark, sf_dir), views.symbols(spark, sf_dir), _names(spark, sf_dir))[3]


def _deleted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = views.checkouts(spark, sf_dir)
    ids = c.where("kind = 'tag'").select("id").unionByName(c.where("kind = 'commit'").select(F.concat(F.lit("no"), "id").alias("id"))).unionByName(
        c.where("id = repo").select("id"))
    return maintain.delete_checkouts(c, views.symbols(spark, sf_dir), ids)


@query("delete_checkout", "select * from checkouts where kind <> 'tag'")
def delete_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[0]


@query("delete_checkout_outcome", """
select id, 'removed' as outcome from checkouts where kind = 'tag' union all select concat('no', id), 'not found' from checkouts where kind = 'commit'
union all select id, 'default checkout' from checkouts where id = repo""")
def delete_checkout_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[2]


@query("set_snapshot", f"""
select id, repo, case when kind = 'branch' then concat(ref, '2') else ref end as ref, case when kind = 'branch' then 'tag' else kind end as kind,
 case when kind = 'branch' then md5(id) else commit_hash end as commit_hash, path, case when kind = 'branch' then {AT_SQL} else updated_at end as updated_at, parsed_at
from checkouts""")
def set_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.checkouts(spark, sf_dir)
    moves = c.where("kind = 'branch'").select(
        "id", F.concat("ref", F.lit("2")).alias("ref"), F.lit("tag").alias("kind"), F.md5("id").alias("commit_hash"), now().alias("updated_at"))
    return maintain.set_snapshots(c, moves)


@query("set_shallow", "select name, url, path, case when name like '%4' then false else shallow end as shallow, fetched_at from repos")
def set_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.repos(spark, sf_dir)
    return maintain.set_shallow(r, r.where("name like '%4'").select("name", F.lit(False).alias("shallow")))


@query("info", """
select c.id as handle, c.repo as name, r.url, c.ref, c.kind, c.commit_hash as commit, n.n as n_checkouts, c.repo as first_id
from checkouts c join repos r on r.name = c.repo join (select repo, count(*) as n from checkouts group by repo) n on n.repo = c.repo""")
def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every checkout with its repo, whose default checkout comes first."""
    checkouts = views.checkouts(spark, sf_dir)
    out = registry.info(checkouts.select(F.col("id").alias("handle")), checkouts, views.repos(spark, sf_dir))
    return out.select("handle", "name", "url", "checkout.ref", "checkout.kind", "checkout.commit", F.size("checkouts").cast("long").alias("n_checkouts"),
                      F.get("checkouts", F.lit(0))["id"].alias("first_id"))
