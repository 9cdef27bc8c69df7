"""Queries that advance checkouts, in batch and as streams, and derived reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grep, maintain, registry, topics
from ..operators.symbols import build_index, symbols_across
from ..session import materialize, scratch_dir
from ..sources import tables
from ..streaming import refs as streams
from . import views
from .catalog import query
from .registry_queries import AT_SQL, now
from .search_queries import LINES, PATTERN, first_match
from .symbol_queries import LOWER, SHOWN

# Checkouts the ref events speak of: r0..r19 with one per event type, of which
# "view" is a commit pin, "click" was never indexed and "error" has no head.
MOVING_SQL = """
select distinct concat('r', user_id % 20, '@', event_type) as id, concat('r', user_id % 20) as repo, event_type as ref,
 case event_type when 'view' then 'commit' else 'branch' end as kind, md5(concat('r', user_id % 20, '@', event_type)) as commit_hash,
 timestamp '2024-01-03 00:00:00' as updated_at, case when event_type <> 'click' then timestamp '2024-01-03 00:00:00' end as parsed_at from events"""


def _moving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, heads, resolved) for an update of every checkout."""
    events = views.ref_events(views.table(spark, sf_dir, "events"))
    ids = events.select("id", "ref").distinct()
    day = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    checkouts = ids.select(
        "id", F.substring_index("id", "@", 1).alias("repo"), "ref", F.when(F.col("ref") == "view", "commit").otherwise("branch").alias("kind"),
        F.md5("id").alias("commit_hash"), F.concat(F.lit("/data/"), "id").alias("path"), day.alias("updated_at"),
        F.when(F.col("ref") != "click", day).alias("parsed_at"))
    repos = checkouts.select(
        F.col("repo").alias("name"), F.lit("").alias("url"), F.lit("").alias("path"), F.lit(False).alias("shallow"), day.alias("fetched_at")).distinct()
    heads = checkouts.select("id", F.when(F.col("ref") != "error", F.col("commit_hash")).alias("commit_hash"))
    latest = streams.latest_refs(events)
    # Sign-ups did not move; purchases of even repos do not resolve any more.
    lost = (F.col("ref") == "purchase") & (F.regexp_extract("id", r"r(\d+)", 1).cast("int") % 2 == 0)
    resolved = latest.select(
        "id", "kind", F.when(F.col("ref") == "signup", F.md5("id")).when(~lost, F.col("commit_hash")).alias("commit_hash"),
        F.when(lost, "not a branch, tag or commit").alias("problem"))
    return registry.projects(checkouts, repos), heads, resolved


ADVANCE_SQL = f"""
with m as ({MOVING_SQL}),
latest as (select id, arg_max(commit_hash, (ts, commit_hash)) as h from ref_events group by id),
a as (select m.*, case when ref <> 'error' then commit_hash else '' end as prev, ref = 'purchase' and cast(substring(repo, 2) as int) % 2 = 0 as lost,
 case ref when 'view' then commit_hash when 'signup' then commit_hash else h end as now from m join latest on m.id = latest.id),
d as (select *, not lost and (prev = '' or prev <> now) as changed from a)
select id, not lost as ok, ref, kind, prev as prev_commit, case when lost then commit_hash else now end as commit, changed,
 case when not lost and (changed or now <> commit_hash) then {AT_SQL} else updated_at end as updated_at, not lost and (changed or parsed_at is null) as reindex,
 case when lost then 'not a branch, tag or commit' end as error from d"""


@query("advance", ADVANCE_SQL)
def advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.advance(*_moving(spark, sf_dir), now())


# Every checkout id gets the code files of one brand, and some get none.
BRAND_SQL = "concat('brand', (length({id}) + ascii(right({id}, 1))) % 9 + 1)"
NO_FILES_SQL = "ascii(right({id}, 1)) % 5 = 4"
COUNTS_SQL = "select project, count(*) as n_symbols, count(*) filter (line % 4 = 0) as n_old from symbols group by project"


def _files_of(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """files of the checkouts in ids(id)."""
    last = F.ascii(F.right("id", F.lit(1)))
    brand = F.concat(F.lit("brand"), ((F.length("id") + last) % 9 + 1).cast("string"))
    of = ids.select("id", brand.alias("project")).where(last % 5 != 4).distinct()
    return views.code_files(spark, sf_dir).join(of, "project").select(F.col("id").alias("project"), "path", "content")


@query("update_all", f"""
with a as ({ADVANCE_SQL}), c as ({COUNTS_SQL}),
m as ({MOVING_SQL}),
r as (select a.*, m.parsed_at is not null and not ({NO_FILES_SQL.format(id='a.id')}) as had, m.commit_hash as old, c.* from a join m on m.id = a.id left join c on c.project = {BRAND_SQL.format(id='a.id')})
select id as name, ok, case when ok then ref end as ref, case when ok then kind end as kind, case when ok then prev_commit end as prev_commit, case when ok then commit end as commit, changed,
 case when not ok or {NO_FILES_SQL.format(id='id')} then 0 when reindex and not (had and old = commit) then coalesce(n_symbols, 0) when had then coalesce(n_old, 0) else 0 end as symbol_count, error,
 case when reindex and (n_symbols is null or {NO_FILES_SQL.format(id='id')}) then 'no files landed' end as reindex_error from r""")
def update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkouts that were indexed before hold a part of the symbols of today's files until they move."""
    where = scratch_dir(spark)
    projects, heads, resolved = _moving(spark, sf_dir)
    files = _files_of(spark, sf_dir, projects)
    before = projects.where("parsed_at is not null").select(F.col("id").alias("project"), "commit_hash", "parsed_at")
    old = build_index(files).where("line % 4 = 0")
    tables.write_symbols(old, before.join(files.select("project").distinct(), "project", "left_semi"), where)
    advanced = materialize(maintain.advance(projects, heads, resolved, now()))
    indexed = maintain.reindex_advanced(advanced, files, where, now())
    return maintain.update_report(advanced, projects, tables.read_index(spark, where), indexed)


@query("update_again", f"select 0 as n_indexed, count(*) as n_checkouts from ({MOVING_SQL})")
def update_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commits a second time: no checkout has a newer time than after the first run."""
    where = scratch_dir(spark)
    projects = _moving(spark, sf_dir)[0]
    files = _files_of(spark, sf_dir, projects)
    maintain.reindex(files, projects, where, now())
    again = maintain.reindex(files, projects, where, F.lit("2030-01-01").cast("timestamp_ntz"))
    return again.agg(F.sum((F.year("parsed_at") == 2030).cast("int")).cast("int").alias("n_indexed"), F.count("*").alias("n_checkouts")).withColumn(
        "n_indexed", F.coalesce("n_indexed", F.lit(0)))


ARRIVALS_SQL = """
select distinct case k when 0 then concat('https://example.com/', source, '.git') when 1 then concat('git@host:x/new-', source, '.git') when 2 then 'https://example.com/..' when 3 then concat('https://example.com/y/', source) else concat('https://a.example/shared-', lang) end as url,
 case k when 3 then concat('bad/', source) else '' end as name from (select source, lang, doc_id % 5 as k from documents)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    src = F.col("source")
    url = views._pick(k, [
        F.concat(F.lit("https://example.com/"), src, F.lit(".git")), F.concat(F.lit("git@host:x/new-"), src, F.lit(".git")),
        F.lit("https://example.com/.."), F.concat(F.lit("https://example.com/y/"), src), F.concat(F.lit("https://a.example/shared-"), "lang")])
    return views.table(spark, sf_dir, "documents").select(
        url.alias("url"), F.when(k == 3, F.concat(F.lit("bad/"), src)).otherwise("").alias("name")
    ).distinct().select("url", "name", F.lit("main").alias("ref"), F.lit("branch").alias("kind"), F.md5("url").alias("commit_hash"), F.lit(False).alias("shallow"))


@query("register_fetch", f"""
with a as (select url, case when name <> '' then name when url like '%/..' then '' else regexp_extract(regexp_replace(url, '\\.git$', ''), '([^/:]*)$', 1) end as name,
 case when url like '%/..' then 'no name in URL' when name like 'bad/%' then 'bad name: separator' when url like 'https://example.com/%.git' then 'already tracked' else 'registered' end as outcome from ({ARRIVALS_SQL}))
select url, name, outcome, 'main' as ref, 'branch' as kind, md5(url) as commit_hash, false as shallow, concat('/data/', name) as path, {AT_SQL} as at,
 case when outcome = 'registered' and not ({NO_FILES_SQL.format(id='name')}) then coalesce(n_symbols, 0) else 0 end as symbol_count,
 case when outcome = 'registered' and not ({NO_FILES_SQL.format(id='name')}) and n_symbols is not null then {AT_SQL} end as parsed_at,
 case when outcome = 'registered' and ({NO_FILES_SQL.format(id='name')} or n_symbols is null) then 'no files landed' end as index_error
from a left join ({COUNTS_SQL}) c on c.project = {BRAND_SQL.format(id='name')}""")
def register_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals are judged, and the accepted ones indexed."""
    out = materialize(maintain.register_fetch(
        views.repos(spark, sf_dir), views.checkouts(spark, sf_dir), _arrivals(spark, sf_dir), "/data", now()))
    return maintain.with_index(out, _files_of(spark, sf_dir, out.select(F.col("name").alias("id"))), scratch_dir(spark), now())


@query("register_fetch_rows", f"""
select n as id, n as repo, 'main' as ref, 'branch' as kind, md5(url) as commit_hash, concat('/data/', n) as path from (
 select url, regexp_extract(regexp_replace(url, '\\.git$', ''), '([^/:]*)$', 1) as n from ({ARRIVALS_SQL}) where url like 'git@%' or url like 'https://a.%')""")
def register_fetch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = maintain.register_fetch(
        views.repos(spark, sf_dir), views.checkouts(spark, sf_dir), _arrivals(spark, sf_dir), "/data", now())
    return maintain.new_checkouts(out).select("id", "repo", "ref", "kind", "commit_hash", "path")


PINS_SQL = """
select distinct case when k = 1 then concat('no', source) else source end as repo, case k when 0 then lang when 2 then upper(lang) when 3 then 'bad..ref' when 4 then 'v/1' when 5 then 'v-1' else concat('v', doc_id % 3) end as ref from (select source, lang, doc_id, (doc_id // 20) % 7 as k from documents)"""


def _pins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.floor(F.col("doc_id") / 20) % 7
    ref = views._pick(k, [
        F.col("lang"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")), F.upper("lang"), F.lit("bad..ref"), F.lit("v/1"), F.lit("v-1"),
        F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string"))])
    repo = F.when(k == 1, F.concat(F.lit("no"), "source")).otherwise(F.col("source"))
    pins = views.table(spark, sf_dir, "documents").select(repo.alias("repo"), ref.alias("ref")).distinct()
    known = pins.where("ref <> 'v2'").select("repo", "ref", F.lit("tag").alias("kind"), F.md5(F.concat("repo", "ref")).alias("commit_hash"))
    return pins, known


@query("pin_checkout", f"""
with p as ({PINS_SQL}), c as (select * from checkouts),
j as (select p.*, concat(p.repo, '@', ref) as id, (select min(id) from checkouts u where u.repo = p.repo and u.id <> u.repo and lower(concat(u.repo, '@', u.ref)) = lower(concat(p.repo, '@', replace(p.ref, '/', '-')))) as holder,
 min(concat(p.repo, '@', ref)) over (partition by repo, lower(replace(ref, '/', '-'))) as claimer from p),
o as (select id, repo, ref, case when ref = 'bad..ref' then 'bad ref: dot dot' when repo not in (select name from repos) then 'not tracked' when id in (select id from c) then 'existing'
 when holder is not null then concat('folder used by ', holder) when claimer <> id then concat('folder used by ', claimer) when ref = 'v2' then 'ref not resolved' else 'pinned' end as outcome from j)
select o.id, o.repo, o.ref, outcome, case when c.id is not null then c.kind when o.ref <> 'v2' then 'tag' end as kind,
 case when c.id is not null then c.commit_hash when o.ref <> 'v2' then md5(concat(o.repo, o.ref)) end as commit_hash,
 case when c.id is not null then c.path else concat('/data/', o.repo, '@', replace(o.ref, '/', '-')) end as path, {AT_SQL} as at,
 case when c.id is not null then (select count(*) from symbols s where s.project = c.id) when outcome = 'pinned' and not ({NO_FILES_SQL.format(id='o.id')}) then coalesce(n_symbols, 0) else 0 end as symbol_count,
 case when c.id is not null then c.parsed_at when outcome = 'pinned' and not ({NO_FILES_SQL.format(id='o.id')}) and n_symbols is not null then {AT_SQL} end as parsed_at,
 case when outcome = 'pinned' and ({NO_FILES_SQL.format(id='o.id')} or n_symbols is null) then 'no files landed' end as index_error
from o left join c on c.id = o.id left join ({COUNTS_SQL}) n on n.project = {BRAND_SQL.format(id='o.id')}""")
def pin_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins are judged, and the new ones indexed."""
    pins, known = _pins(spark, sf_dir)
    out = materialize(maintain.pin_checkouts(views.checkouts(spark, sf_dir), views.symbols(spark, sf_dir), pins, known, "/data", now()))
    return maintain.with_index(out, _files_of(spark, sf_dir, out), scratch_dir(spark), now())


LATEST_SQL = """
select id, ref, kind, commit_hash, ts from (select *, row_number() over (partition by id order by ts desc, commit_hash desc) as k from ref_events) where k = 1"""


@query("latest_ref", LATEST_SQL)
def latest_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.latest_refs(views.ref_events(views.table(spark, sf_dir, "events")))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = views.table(spark, sf_dir, "events").schema
    return views.ref_events(streams.table_stream(spark, schema, sf_dir, "events.parquet"))


@query("latest_ref_stream", LATEST_SQL)
def latest_ref_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, run to its end."""
    where = scratch_dir(spark)
    streams.store_latest(_event_stream(spark, sf_dir), f"{where}/checkpoint").awaitTermination()
    return streams.read_latest(spark, f"{where}/checkpoint")


@query("incremental_index", """
select * from symbols where p % 2 = 0 union all select * from symbols where p % 2 = 1 and path < 'src/m'""".replace("p %", "cast(right(project, 1) as int) %"))
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of part of the files, then a stream of moves of all brands; those of odd number stand where they did."""
    where = scratch_dir(spark)
    code = views.code_files(spark, sf_dir)
    odd = F.right("project", F.lit(1)).cast("int") % 2 == 1
    before = code.select("project").distinct().select(
        "project", F.when(odd, F.md5("project")).otherwise("before").alias("commit_hash"), now().alias("parsed_at"))
    tables.write_symbols(views.symbols(spark, sf_dir).where("path < 'src/m'"), before, where)
    parts = streams.table_stream(spark, views.table(spark, sf_dir, "part").schema, sf_dir, "part.parquet")
    brand = F.concat(F.lit("brand"), F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    moves = parts.select(
        brand.alias("id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("main").alias("ref"), F.lit("branch").alias("kind"),
        F.md5(brand).alias("commit_hash"))
    streams.incremental_index(moves, code, where, f"{where}/checkpoint").awaitTermination()
    return tables.read_index(spark, where)


@query("index_removal", "select * from symbols where right(project, 1) not in ('1', '5') or (right(project, 1) = '5' and line % 4 = 0)")
def index_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkouts of two kinds are removed from the store; those of one kind come back with other symbols."""
    where = scratch_dir(spark)
    s = views.symbols(spark, sf_dir)
    every = s.select("project").distinct()
    tables.write_symbols(s, every, where)
    tables.drop_symbols(every.where(F.right("project", F.lit(1)).isin("1", "5")).union(spark.createDataFrame([("unknown",)], "project string")), where)
    tables.write_symbols(s.where("line % 4 = 0"), every.where(F.right("project", F.lit(1)) == "5"), where)
    return tables.read_index(spark, where)


@query("symbols_lookup", f"""
with stored as (select * from symbols where right(project, 1) not in ('1', '2') or (right(project, 1) = '2' and line % 4 = 0)),
asked as (select unnest(['Rea', '*E*d', 'green', 'red%l', 'zzz']) as name, unnest(['', 'method', '', 'class,method', '']) as kind)
select a.name as asked, {SHOWN.replace('name', 's.name').replace('kind', 's.kind')} from asked a, stored s
where {LOWER.format('s.name')} like case a.name when 'Rea' then '%rea%' when '*E*d' then '%e%d' when 'green' then '%green%' when 'red%l' then 'red%l' else '%zzz%' end
 and (a.kind = '' or contains(a.kind, s.kind))""")
def symbols_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names sought in all checkouts by the lookup, after one kind of checkouts was removed and another written anew."""
    where = scratch_dir(spark)
    s = views.symbols(spark, sf_dir)
    tables.write_symbols(s.where("line % 4 <> 0"), s.select("project").distinct(), where)
    tables.create_lookup(spark, where)
    last = F.right("project", F.lit(1))
    tables.write_symbols(s.where(last != "2").unionByName(s.where((last == "2") & (F.col("line") % 4 == 0))), s.select("project").distinct(), where)
    tables.drop_symbols(s.where(last == "1").select("project").distinct(), where)
    out = None
    for name, kinds in (("Rea", []), ("*E*d", ["method"]), ("green", []), ("red%l", ["class", "method"]), ("zzz", [])):
        found = symbols_across(tables.read_lookup(spark, where, name, kinds), name, kinds, limit=0)
        found = found.select(F.lit(name).alias("asked"), "project", "path", "name", "kind", "line", "end_line", "parent", "lang")
        out = found if out is None else out.unionByName(found)
    return out


@query("symbol_index_store", "select * from symbols where right(project, 1) <> '1' and (right(project, 1) <> '2' or line % 4 = 0)")
def symbol_index_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, then rewritten for two kinds of brands, one of which is empty now."""
    where = scratch_dir(spark)
    s = views.symbols(spark, sf_dir)
    tables.write_symbols(s, s.select("project").distinct(), where)
    again = s.where(F.substring("project", -1, 1).isin("1", "2")).select("project").distinct()
    tables.write_symbols(s.where(F.col("project").endswith("2") & (F.col("line") % 4 == 0)), again, where)
    return tables.read_index(spark, where)


@query("schema_reset", "select name, url, path, shallow, fetched_at from repos")
def schema_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of another version is emptied; then the repos are saved again."""
    where = scratch_dir(spark)
    tables.ensure_schema(spark, where, version=0)
    tables.save_table(views.repos(spark, sf_dir).withColumn("url", F.lit("old")), where, "repos")
    tables.ensure_schema(spark, where)
    tables.save_table(views.repos(spark, sf_dir), where, "repos")
    return tables.load_table(spark, where, "repos")


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = streams.table_stream(spark, views.table(spark, sf_dir, "documents").schema, sf_dir, "documents.parquet")
    return docs.select(F.col("source").alias("project"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


@query("grep_stream", f"""
with l as (select source as project, concat('d', doc_id, '.md') as path, ls, unnest(range(1, len(ls) + 1)) as n from (select source, doc_id, string_split(text, chr(10)) as ls from documents))
select project, path, cast(n as int) as line, {first_match(PATTERN, 'ls[n]')} as "column", ls[n] as text from l where regexp_matches(ls[n], '{PATTERN}')""")
def grep_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch_dir(spark)
    found = streams.grep_stream(_document_stream(spark, sf_dir), PATTERN)
    streams.store_stream(found, f"{where}/hits", f"{where}/checkpoint").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{where}/hits")


TOPIC = r"\bm\d+_[a-z_]*e"


@query("topic_density", """
with code as (select project, path, 2 * cnt + 1 as lines, cnt + 0 as named, cnt + 1 as symbols from (select project, concat(stem, '.py') as path, max(n) as cnt from parts group by all)),
hits as (select project, concat(stem, '.py') as path, count(*) filter (where regexp_matches(member, '^m[0-9]+_[a-z_]*e')) as matches, count(*) filter (where contains(lower(member), 're')) as topic from parts group by all)
select c.project, c.path, matches, c.lines, c.symbols, h.topic + s.own as topic_symbols, round((h.topic + s.own) / c.symbols * 10000) / 10000 as share, c.lines > 500 and round((h.topic + s.own) / c.symbols * 10000) / 10000 < 0.1 as mentions
from code c join hits h on c.project = h.project and c.path = h.path
join (select distinct project, concat(stem, '.py') as path, case when contains(lower(cls), 're') then 1 else 0 end as own from parts) s on c.project = s.project and c.path = s.path where matches > 0""")
def topic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_density(views.code_files(spark, sf_dir), views.symbols(spark, sf_dir), TOPIC, "re")


@query("shard_plan", """
select project, case when contains(path, '/') then string_split(path, '/')[1] else '.' end as dir, count(*) as file_count,
 case when contains(any_value(path), '/') and count(*) >= 8 then concat(case when contains(any_value(path), '/') then string_split(any_value(path), '/')[1] else '.' end, '/') else 'rest' end as scope
from files group by 1, 2""")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.shard_plan(views.files(spark, sf_dir), dense=8)


SHARDS_SQL = """
select project, concat('s', k) as shard, case when doc_id % 13 = 0 then null else path end as path, case (doc_id + k) % 3 when 0 then 'core' when 1 then 'related' else 'speculative' end as tier, concat('role ', k) as role, project = 'src3' and k = 1 as truncated
from files, (select unnest(range(3)) as k) where doc_id % (k + 2) = 0"""


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).select("project", "path", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    tier = views._pick((F.col("doc_id") + F.col("k")) % 3, [F.lit(t) for t in topics.TIERS])
    return f.where(F.col("doc_id") % (F.col("k") + 2) == 0).select(
        "project", F.concat(F.lit("s"), F.col("k").cast("string")).alias("shard"), F.when(F.col("doc_id") % 13 != 0, F.col("path")).alias("path"),
        tier.alias("tier"), F.concat(F.lit("role "), F.col("k").cast("string")).alias("role"), ((F.col("project") == "src3") & (F.col("k") == 1)).alias("truncated"))


@query("merge_shards", f"""
with s as ({SHARDS_SQL}), g as (select * from s where (project, shard) not in (select (project, shard) from s where truncated) and path is not null)
select project, path, tier, role, shard, found_by from (select *, count(*) over (partition by project, path) as found_by, row_number() over (partition by project, path order by case tier when 'core' then 1 when 'related' then 2 else 3 end, shard) as k from g) where k = 1""")
def merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.merge_shards(_shards(spark, sf_dir))[0]


@query("shards_to_rerun", f"select distinct project, shard from ({SHARDS_SQL}) where truncated")
def shards_to_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.merge_shards(_shards(spark, sf_dir))[1]


@query("grep_counts", f"""
select project, path, cast(count(*) filter (where regexp_matches(text, '{PATTERN}')) as int) as matches, cast(max(len(ls)) - case when any_value(ls)[-1] = '' then 1 else 0 end as int) as lines
from ({LINES}) group by project, path having count(*) filter (where regexp_matches(text, '{PATTERN}')) > 0""")
def grep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_counts(views.files(spark, sf_dir), PATTERN)
