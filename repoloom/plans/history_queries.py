"""Queries over commits, refs, search events and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff, history
from ..session import materialize
from ..sources import events as grep_events
from ..sources import history as git_text
from . import views
from .catalog import query


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits with parent lists; written once, because heads, walks and details all read them."""
    c = materialize(views.commits(spark, sf_dir))
    return c.withColumn("parents", F.array_compact(F.array("parent")))


def _heads(commits: DataFrame) -> DataFrame:
    """Two heads per repo: its tip and the tip of branch f."""
    last = commits.groupBy("repo").agg(F.max_by("hash", "rn").alias("tip"), F.max_by("hash", F.when(F.col("branch") == "f", F.col("rn"))).alias("f"))
    return last.select("repo", F.explode(F.array_distinct(F.array("tip", "f"))).alias("head"))


HEADS_SQL = """
select distinct repo, hash as head, rn as head_rn from (select *, row_number() over (partition by repo order by rn desc) k, row_number() over (partition by repo, branch order by rn desc) b from commits) where k = 1 or (branch = 'f' and b = 1)"""


@query("log_newest", f"""
select repo, head, hash, author, email, strftime(author_ts, '%Y-%m-%dT%H:%M:%SZ') as date, subject from (
 select c.*, h.head, row_number() over (partition by c.repo, h.head order by author_ts desc, hash) k from commits c join ({HEADS_SQL}) h on c.repo = h.repo and c.rn <= h.head_rn) where k <= 20""")
def log_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _graph(spark, sf_dir)
    return history.log(c, _heads(c))


@query("log_all", f"""
select c.repo, h.head, hash, author, email, strftime(author_ts, '%Y-%m-%dT%H:%M:%SZ') as date, subject,
 case when cast(substring(c.repo, 2) as int) % 2 = 0 then concat('shallow clone: history is truncated at fetch depth; deepen ', c.repo, ' to get the rest') end as hint
from commits c join ({HEADS_SQL}) h on c.repo = h.repo and c.rn <= h.head_rn""")
def log_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _graph(spark, sf_dir)
    flags = c.select(F.col("repo").alias("name")).distinct().withColumn("shallow", F.substring("name", 2, 9).cast("int") % 2 == 0)
    return history.log(c, _heads(c), limit=0, repos=flags)


@query("log_by_joins", f"select c.repo, h.head, hash from commits c join ({HEADS_SQL}) h on c.repo = h.repo and c.rn <= h.head_rn")
def log_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits that the heads of every repo reach."""
    c = _graph(spark, sf_dir)
    return history.reachable(c, _heads(c))


# Every fifth commit merges a side commit that left the trunk three commits before.
MERGED_SQL = """
select repo, hash, parent as up from commits where parent is not null
union all select repo, hash, md5(concat(hash, 's')) from commits where rn % 5 = 0
union all select a.repo, md5(concat(a.hash, 's')), b.hash from commits a join commits b on a.repo = b.repo and b.rn = a.rn - 3 where a.rn % 5 = 0"""


@query("log_merges", f"""
select * from (with recursive up as ({MERGED_SQL}),
heads as (select repo, md5(concat(hash, 's')) as head from commits where rn % 50 = 0),
walk as (select repo, head, head as hash from heads union select w.repo, w.head, up.up from walk w join up on up.repo = w.repo and up.hash = w.hash)
select repo, head, hash from walk) q""")
def log_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some side commits reach in histories full of merges."""
    c = materialize(views.commits(spark, sf_dir))
    heads = c.where(F.col("rn") % 50 == 0).select("repo", F.md5(F.concat("hash", F.lit("s"))).alias("head"))
    return history.reachable(_merged(c), heads)


def _merged(c: DataFrame) -> DataFrame:
    """commits in which every fifth one of the trunk merges a side commit; some side commits have a clock that runs ahead."""
    side = F.md5(F.concat("hash", F.lit("s")))
    merge = F.col("rn") % 5 == 0
    about = ["author", "email", "subject"]
    trunk = c.select("repo", "hash", F.array_compact(F.array("parent", F.when(merge, side))).alias("parents"), "author_ts", *about)
    before = c.select("repo", (F.col("rn") + 3).alias("rn"), F.col("hash").alias("base"))
    ahead = F.when(F.col("rn") % 15 == 0, F.col("author_ts") + F.expr("interval 20 days")).otherwise(F.col("author_ts"))
    sides = c.where(merge).join(before, ["repo", "rn"], "left").select(
        "repo", side.alias("hash"), F.array_compact(F.array("base")).alias("parents"), ahead.alias("author_ts"), *about)
    return trunk.unionByName(sides)


@query("log_merges_newest", f"""
select repo, head, hash, author, email, strftime(author_ts, '%Y-%m-%dT%H:%M:%SZ') as date, subject from (
 select w.*, author, email, author_ts, subject, row_number() over (partition by w.repo, w.head order by author_ts desc, w.hash) k
 from (select * from (with recursive up as ({MERGED_SQL}),
   heads as (select repo, hash as head from commits where rn % 40 = 0 union all select repo, md5(concat(hash, 's')) from commits where rn % 50 = 0),
   walk as (select repo, head, head as hash from heads union select w.repo, w.head, up.up from walk w join up on up.repo = w.repo and up.hash = w.hash)
   select repo, head, hash from walk) q) w
 join (select repo, hash, author, email, author_ts, subject from commits
   union all select repo, md5(concat(hash, 's')), author, email, case when rn % 15 = 0 then author_ts + interval 20 days else author_ts end, subject from commits where rn % 5 = 0) d
 on d.repo = w.repo and d.hash = w.hash) where k <= 20""")
def log_merges_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest commits of heads all over histories full of merges, with clocks that are wrong."""
    c = materialize(views.commits(spark, sf_dir))
    heads = c.where(F.col("rn") % 40 == 0).select("repo", F.col("hash").alias("head")).unionByName(
        c.where(F.col("rn") % 50 == 0).select("repo", F.md5(F.concat("hash", F.lit("s"))).alias("head")))
    return history.log(_merged(c), heads)


def _raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as log lines; some lack a field, some dates are not dates."""
    c = views.commits(spark, sf_dir)
    day = F.date_format("author_ts", "yyyy-MM-dd")
    date = views._pick(F.col("rn") % 4, [
        F.concat(day, F.lit("T12:00:00+02:00")), F.concat(day, F.lit("T23:30:00-05:30")), F.concat(day, F.lit("T01:02:03Z")), F.lit("yesterday")])
    sep = F.lit("\x1f")
    full = F.concat("hash", sep, "author", sep, "email", sep, date, sep, "subject", sep, F.lit("x"))
    return c.select("repo", F.when(F.col("rn") % 10 == 0, F.concat("hash", sep, "author")).otherwise(full).alias("value"))


@query("parse_commit_log", """
select repo, hash, author, email, case rn % 4 when 0 then strftime(author_ts, '%Y-%m-%dT10:00:00Z') when 1 then strftime(author_ts + interval 1 day, '%Y-%m-%dT05:00:00Z')
 when 2 then strftime(author_ts, '%Y-%m-%dT01:02:03Z') else 'yesterday' end as date, concat(subject, chr(31), 'x') as subject
from commits where rn % 10 <> 0""")
def parse_commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return git_text.parse_commit_log(_raw_log(spark, sf_dir), ["repo"])


@query("utc_dates", """
select o_orderkey, case o_orderkey % 3 when 0 then strftime(d - interval 90 minute, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(d, '%Y-%m-%dT%H:%M:%SZ') else cast(o_orderkey as varchar) end as utc,
 o_orderpriority as head from (select *, o_orderdate + interval 45 minute as d from orders)""")
def utc_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = views._pick(F.col("o_orderkey") % 3, [
        F.concat(d, F.lit("T00:45:00+01:30")), F.concat(d, F.lit("T00:45:00.25Z")), F.col("o_orderkey").cast("string")])
    message = F.concat(F.lit(" "), "o_orderpriority", F.lit(" \n\nbody"))
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.utc_rfc3339(raw).alias("utc"), text.first_line(message).alias("head"))


@query("branches", """
select repo, regexp_replace(full_name, '^refs/(heads|remotes)/', '') as name, full_name like 'refs/remotes/%' as remote, hash
from refs where full_name like 'refs/heads/%' or (full_name like 'refs/remotes/%' and full_name not like '%/HEAD')""")
def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.branches(views.refs(spark, sf_dir))


TAGS_SQL = """
select r.repo, substring(full_name, 11) as name, coalesce(t.target, r.hash) as hash from refs r left join tag_objects t on r.repo = t.repo and r.hash = t.hash where full_name like 'refs/tags/%'"""


@query("tags", TAGS_SQL)
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.tags(views.refs(spark, sf_dir), views.tag_objects(spark, sf_dir))


@query("head_kind", f"""
select id, h.repo, coalesce(branch, t.name, substring(h.hash, 1, 12)) as ref, case when branch is not null then 'branch' when t.name is not null then 'tag' else 'commit' end as kind, h.hash
from (select concat(repo, '@', rn) as id, repo, case when rn % 3 = 0 then branch end as branch, hash from commits) h
left join (select repo, hash, min(name) as name from ({TAGS_SQL}) group by all) t on h.repo = t.repo and h.hash = t.hash""")
def head_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = views.commits(spark, sf_dir).select(
        F.concat("repo", F.lit("@"), F.col("rn").cast("string")).alias("id"), "repo",
        F.when(F.col("rn") % 3 == 0, F.col("branch")).alias("branch"), "hash")
    return history.head_kinds(heads, history.tags(views.refs(spark, sf_dir), views.tag_objects(spark, sf_dir)))


def _ref_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, branches, hashes in full and short, and unknown names."""
    n = F.col("rn").cast("string")
    ref = views._pick(F.col("rn") % 10, [
        F.concat(F.lit("v"), n), F.col("hash"), F.substring("hash", 1, 10), F.col("branch"), F.concat(F.lit("origin/"), "branch"),
        F.concat(F.lit("v"), n), F.concat(F.lit("nope"), n), F.sha1("hash"), F.lit("origin"), F.substring("hash", 1, 3)])
    return views.commits(spark, sf_dir).select(
        F.concat("repo", F.lit(":"), n).alias("req_id"), "repo", ref.alias("ref"), (F.col("rn") % 4 == 1).alias("refresh"))


@query("resolve_ref", f"""
with q as (select concat(repo, ':', rn) as req_id, repo, rn, hash as h, branch, rn % 4 = 1 as refresh, case rn % 10 when 0 then concat('v', rn) when 1 then hash when 2 then substring(hash, 1, 10) when 3 then branch
 when 4 then concat('origin/', branch) when 5 then concat('v', rn) when 6 then concat('nope', rn) when 7 then sha1(hash) when 8 then 'origin' else substring(hash, 1, 3) end as ref from commits),
tips as (select repo, branch, max_by(hash, rn) as tip from commits group by all),
lasts as (select repo, max_by(hash, rn) as tip from commits group by all),
t as ({TAGS_SQL}),
a as (select q.*, case when rn % 10 in (0, 5) then t.hash when rn % 10 in (1, 2) then h when rn % 10 in (3, 4) then tips.tip when rn % 10 = 8 then lasts.tip end as commit_hash,
 case when rn % 10 in (0, 5) and t.hash is not null then 'tag' when rn % 10 in (1, 2) then 'commit' when rn % 10 = 3 then 'branch' when rn % 10 in (4, 8) then 'commit' end as kind
 from q left join t on q.repo = t.repo and q.ref = t.name left join tips on q.repo = tips.repo and q.branch = tips.branch left join lasts on q.repo = lasts.repo)
select req_id, repo, ref, kind, commit_hash, case when commit_hash is not null then null when rn % 10 = 7 then 'commit has to be fetched by id' else 'not a branch, tag or commit' end as problem from a""")
def resolve_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.resolve_refs(
        _ref_requests(spark, sf_dir), views.refs(spark, sf_dir), views.tag_objects(spark, sf_dir),
        views.commits(spark, sf_dir), views.remote_refs(spark, sf_dir))


@query("remote_precedence", """
select concat(repo, ':', rn) as req_id, repo, concat('v', rn) as ref, case when rn % 25 = 0 then 'tag' else 'branch' end as kind,
 case when rn % 25 = 0 then hash else '0000' end as commit_hash, cast(null as varchar) as problem from commits""")
def remote_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On refresh the remote decides: its peeled tag beats the tag object and
    a branch of the same name."""
    asked = views.commits(spark, sf_dir).select(
        F.concat("repo", F.lit(":"), F.col("rn").cast("string")).alias("req_id"), "repo",
        F.concat(F.lit("v"), F.col("rn").cast("string")).alias("ref"), F.lit(True).alias("refresh"))
    remote = views.remote_refs(spark, sf_dir)
    lines = remote.select("repo", F.concat("hash", F.lit("\t"), "name").alias("value")).unionByName(
        asked.select("repo", F.concat(F.lit("0000\trefs/heads/"), "ref").alias("value"))
    ).unionByName(asked.select("repo", F.lit("no tab").alias("value")))
    published = git_text.parse_remote_refs(lines, ["repo"])
    return history.resolve_refs(
        asked, views.refs(spark, sf_dir), views.tag_objects(spark, sf_dir), views.commits(spark, sf_dir), published)


EVENT_CONTEXT = 2


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search event stream per project: some lines match, some are context,
    some are left out, and some records are broken."""
    lines = views.files(spark, sf_dir).select(
        "project", "path", "doc_id", F.posexplode(text.lines_raw("content")).alias("at", "line"))
    n = F.length("line") % 11
    kind = F.when(n.isin(0, 4), "match").when(n.isin(1, 2, 3, 6, 7, 8), "context")
    data = F.struct(
        F.struct(F.concat(F.lit("./"), "path").alias("text")).alias("path"), F.struct(F.concat("line", F.lit("\n")).alias("text")).alias("lines"),
        (F.col("at") + 1).alias("line_number"), F.when(n == 0, F.array(F.struct(n.alias("start")))).alias("submatches"))
    record = F.when(n == 5, F.lit('{"type":"match","data":')).otherwise(F.to_json(F.struct(kind.alias("type"), data.alias("data"))))
    seq = F.col("doc_id") * 1_000_000
    body = lines.where(kind.isNotNull() | (n == 5)).select(F.col("project").alias("stream"), (seq + F.col("at") + 1).alias("seq"), record.alias("value"))
    f = views.files(spark, sf_dir)

    def edge(kind: str, offset: int) -> DataFrame:
        return f.select(F.col("project").alias("stream"), (seq + offset).alias("seq"), F.lit(f'{{"type":"{kind}","data":{{}}}}').alias("value"))

    return body.unionByName(edge("begin", 0)).unionByName(edge("end", 999_999))


@query("grep_events", f"""
with l as (select project, path, doc_id, n, ls[n] as text, length(ls[n]) % 11 as k from (select project, path, doc_id, ls, unnest(range(1, len(ls) + 1)) as n from (select project, path, doc_id, string_split(content, chr(10)) as ls from files))),
e as (select *, k in (0, 4) as hit, row_number() over w as r, sum(case when k in (0, 4) then 1 else 0 end) over w as g from l where k in (0, 1, 2, 3, 4, 6, 7, 8) window w as (partition by doc_id order by n)),
f as (select *, count(*) filter (where not hit) over (partition by doc_id, g order by r) as i, count(*) filter (where not hit) over (partition by doc_id, g) as k2 from e),
c as (select *, case when g > 0 and i <= {EVENT_CONTEXT} then g else null end as after_of, case when (g > 0 and i <= {EVENT_CONTEXT}) or k2 - i + 1 > {EVENT_CONTEXT} then null else g + 1 end as before_of from f where not hit)
select m.project as stream, m.doc_id * 1000000 + m.n as seq, m.path, cast(m.n as int) as line, case when m.k = 0 then 1 else 0 end as "column", m.text,
 coalesce((select string_agg(c.text, chr(10) order by r) from c where c.doc_id = m.doc_id and before_of = m.g), '') as context_before,
 coalesce((select string_agg(c.text, chr(10) order by r) from c where c.doc_id = m.doc_id and after_of = m.g), '') as context_after
from f m where hit""")
def grep_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grep_events.parse_grep_events(_event_lines(spark, sf_dir), EVENT_CONTEXT)
    return found.withColumn("context_before", F.array_join("context_before", "\n")).withColumn("context_after", F.array_join("context_after", "\n"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.files(spark, sf_dir).select("project", "path", "content"), views.files_b(spark, sf_dir)


STATUS_SQL = """
select coalesce(a.project, b.project) as project, coalesce(a.path, b.path) as path, case when a.path is null then 'A' when b.path is null then 'D' else 'M' end as status, a.content as old, b.content as new
from files a full join files_b b on a.project = b.project and a.path = b.path where a.content is distinct from b.content"""


@query("diff_files", f"select project, path, status, cast(null as varchar) as old_path from ({STATUS_SQL})")
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_files(*_snapshots(spark, sf_dir), renames=False)


@query("diff_renames", """
with o as (select project, path, doc_id, md5(content) as sha from files),
n as (select project, case when doc_id % 4 = 0 then concat('moved/', path) else path end as path, sha from o where doc_id % 4 <> 1),
d as (select *, row_number() over (partition by project, sha order by md5(path)) as k from o where doc_id % 4 in (0, 1)),
a as (select *, row_number() over (partition by project, sha order by md5(path)) as k from n where path like 'moved/%')
select coalesce(a.project, d.project) as project, coalesce(a.path, d.path) as path, case when a.path is not null and d.path is not null then 'R' when a.path is null then 'D' else 'A' end as status,
 case when a.path is not null then d.path end as old_path
from d full join a on a.project = d.project and a.sha = d.sha and a.k = d.k""")
def diff_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the files moves, another quarter goes away; files of equal contents pair off in the order of the MD5 of their paths."""
    old = views.files(spark, sf_dir)
    moved = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return diff.diff_files(old, old.where("doc_id % 4 <> 1").withColumn("path", moved))


@query("diff_checkouts", f"select concat(project, ':a..b') as project, path, status, cast(null as varchar) as old_path from ({STATUS_SQL})")
def diff_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of pairs of checkouts, all in one table."""
    old, new = _snapshots(spark, sf_dir)
    at = lambda f, ref: f.withColumn("project", F.concat("project", F.lit(f"@{ref}")))
    pairs = old.select("project").distinct().select(
        F.concat("project", F.lit(":a..b")).alias("pair"), F.concat("project", F.lit("@a")).alias("old"), F.concat("project", F.lit("@b")).alias("new"))
    return diff.diff_files(*diff.snapshot_pairs(at(old, "a").unionByName(at(new, "b")), pairs), renames=False)


SCOPED = ["src", "vendor/"]


@query("diff_scoped", f"select project, path, status, cast(null as varchar) as old_path from ({STATUS_SQL}) where path like 'src/%' or path like 'vendor/%'")
def diff_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_files(*_snapshots(spark, sf_dir), paths=SCOPED, renames=False)


LINE_COUNT = "(case when {0} is null or {0} = '' then 0 else len(string_split({0}, chr(10))) - case when right({0}, 1) = chr(10) then 1 else 0 end end)"
STAT_SQL = f"""
select project, path, status, cast(null as varchar) as old_path, cast(case status when 'A' then {LINE_COUNT.format('new')} when 'D' then 0 else 2 end as int) as added,
 cast(case status when 'D' then {LINE_COUNT.format('old')} when 'A' then 0 else case when right(old, 1) = chr(10) or old = '' then 0 else 1 end end as int) as deleted from ({STATUS_SQL})"""


@query("diff_stat", STAT_SQL)
def diff_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_stat(*_snapshots(spark, sf_dir), renames=False)


@query("diff_totals", f"select project, count(*) as files_changed, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted from ({STAT_SQL}) group by project")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_totals(diff.diff_stat(*_snapshots(spark, sf_dir), renames=False))


@query("diff_stat_bag", f"""
with c as ({STATUS_SQL}),
l as (select project, path, unnest(string_split(old, chr(10))) as line, -1 as s from c where old is not null union all select project, path, unnest(string_split(new, chr(10))), 1 from c where new is not null),
n as (select project, path, line, sum(s) as net from l group by all)
select project, path, cast(sum(greatest(net, 0)) as bigint) as added, cast(sum(greatest(-net, 0)) as bigint) as deleted from n group by all""")
def diff_stat_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_stat_bag(*_snapshots(spark, sf_dir))


# The changes of the second snapshot are known: files come, go, or grow at the end.
UNIFIED_SQL = f"""
with c as (select *, chr(10) as nl, right(old, 1) = chr(10) as old_ended, right(new, 1) = chr(10) as new_ended from ({STATUS_SQL})),
l as (select *, case when old is null or old = '' then [] when old_ended then string_split(old, nl)[:-2] else string_split(old, nl) end as a,
 case when new is null or new = '' then [] when new_ended then string_split(new, nl)[:-2] else string_split(new, nl) end as b,
 case when old is null then '0000000' else left(sha1(concat('blob ', octet_length(encode(old)), chr(0), old)), 7) end as old_id,
 case when new is null then '0000000' else left(sha1(concat('blob ', octet_length(encode(new)), chr(0), new)), 7) end as new_id from c),
h as (select *, greatest(1, len(a) - case when old_ended then 2 else 3 end) as s, concat('diff --git a/', path, ' b/', path, nl,
  case status when 'A' then concat('new file mode 100644', nl) when 'D' then concat('deleted file mode 100644', nl) else '' end, 'index ', old_id, '..', new_id, case status when 'M' then ' 100644' else '' end, nl) as head,
 concat(nl, chr(92), ' No newline at end of file') as bare from l),
t as (select *, coalesce(trim(list_last(list_filter(a[1:s - 1], lambda x: regexp_matches(x, '^[A-Za-z_$]'))), concat(' ', chr(9), nl, chr(13))), '') as title from h),
g as (select *, coalesce((select left(title, cast(max(i) as int)) from range(0, 81) r(i) where octet_length(encode(left(title, cast(i as int)))) <= 80), '') as section from t)
select project, path, status, case
 when status = 'A' and new = '' or status = 'D' and old = '' then head
 when status = 'A' then concat(head, '--- /dev/null', nl, '+++ b/', path, nl, '@@ -0,0 +1', case when len(b) = 1 then '' else concat(',', len(b)) end, ' @@', nl, '+', array_to_string(b, concat(chr(10), '+')), case when new_ended then '' else bare end, nl)
 when status = 'D' then concat(head, '--- a/', path, nl, '+++ /dev/null', nl, '@@ -1', case when len(a) = 1 then '' else concat(',', len(a)) end, ' +0,0 @@', nl, '-', array_to_string(a, concat(chr(10), '-')), case when old_ended then '' else bare end, nl)
 else concat(head, '--- a/', path, nl, '+++ b/', path, nl, '@@ -', case when len(a) = 0 then '0,0' when len(a) - s = 0 then cast(s as varchar) else concat(s, ',', len(a) - s + 1) end, ' +', case when len(b) - s = 0 then cast(s as varchar) else concat(s, ',', len(b) - s + 1) end, ' @@', case when section = '' then '' else concat(' ', section) end, nl,
  case when old_ended or len(a) = 0 then concat(array_to_string(list_transform(a[s:], lambda x: concat(' ', x, nl)), ''), array_to_string(list_transform(b[len(a) + 1:], lambda x: concat('+', x)), chr(10)))
   else concat(array_to_string(list_transform(a[s:len(a) - 1], lambda x: concat(' ', x, nl)), ''), '-', a[-1], bare, nl, '+', array_to_string(b[len(a):], concat(chr(10), '+'))) end, bare, nl) end as patch
from g"""


@query("diff_unified", UNIFIED_SQL)
def diff_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diff.diff_unified(*_snapshots(spark, sf_dir), renames=False)
    return out.select("project", "path", "status", "patch")


@query("diff_renamed_patches")
def diff_renamed_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with exact renames found."""
    return diff.diff_unified(*_snapshots(spark, sf_dir))


@query("diff_appended", f"""
with c as (select project, path, case when right(old, 1) = chr(10) then string_split(old, chr(10))[:-2] else string_split(old, chr(10)) end as ls, right(old, 1) = chr(10) as ended from ({STATUS_SQL}) where status = 'M' and old <> '')
select project, path, concat('@@ -', case when n = 1 then '1' else concat(a, ',', n) end, ' +', a, ',', n + case when ended then 2 else 1 end, ' @@') as span from (
 select *, greatest(1, len(ls) - case when ended then 2 else 3 end) as a, len(ls) - greatest(1, len(ls) - case when ended then 2 else 3 end) + 1 as n from c)""")
def diff_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunk headers of changed files: all changes are at the end of a file."""
    out = diff.diff_unified(*_snapshots(spark, sf_dir), renames=False).where("status = 'M'")
    return out.select("project", "path", F.regexp_extract("patch", r"(?m)^(@@ [-+,0-9 ]+ @@)", 1).alias("span")).where("span <> ''")


@query("diff_capped", f"""
with u as ({UNIFIED_SQL}), d as (select project, string_agg(patch, '' order by path) as doc from u group by project),
k as (select project, doc, octet_length(encode(doc)) > 8192 as truncated, left(doc, 8193) as head from d)
select project, truncated, case when truncated then concat(left(head, cast((select max(i) from range(0, 8193) r(i) where octet_length(encode(left(head, cast(i as int)))) <= 8192) as int)), chr(10), '[truncated by --max-kb]', chr(10)) else doc end as diff from k""")
def diff_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_documents(*_snapshots(spark, sf_dir), renames=False, max_kb=8)


@query("diff_endpoints", """
select o_orderkey, case k when 0 then 'v1' when 1 then 'v1' when 2 then 'v2' else 'index' end as left_side, case k when 0 then 'v2' else 'worktree' end as right_side from (select o_orderkey, o_orderkey % 4 as k from orders)""")
def diff_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    left, right = diff.diff_endpoints(F.when(k.isin(0, 1), "v1"), F.when(k.isin(0, 2), "v2").otherwise(""))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", left.alias("left_side"), right.alias("right_side"))
