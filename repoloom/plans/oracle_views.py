"""The derived tables of `views.py` as plain SQL for the DuckDB check."""

from __future__ import annotations

import re

from .views import PARTS_PER_FILE

VIEWS = {
    "files": """
with r as (select *, row_number() over (partition by source order by doc_id) rn from documents)
select source as project,
 case rn when 1 then 'README.md' when 2 then 'LICENSE' when 3 then 'go.mod' else
 concat(case doc_id % 7 when 0 then '' when 1 then 'src/' when 2 then 'src/deep/' when 3 then 'src2/' when 4 then concat('pkg/',lang,'/') when 5 then 'vendor/' else '.github/' end,
 case when doc_id % 12 = 10 then concat('d',cast(doc_id as varchar),'/Makefile') else
 concat('f',cast(doc_id as varchar), case doc_id % 12 when 0 then '.go' when 1 then '.py' when 2 then '.ts' when 3 then '.tsx' when 4 then '.java' when 5 then '.md' when 6 then '.yml' when 7 then '.json' when 8 then '.PY' when 9 then '.xyz' else '.rs' end) end) end as path,
 case when rn=1 then concat('[![Build](https://img.example/b.svg)](https://ci.example)',chr(10),'<div align="center">',chr(10),'<img src="logo.png"/>',chr(10),'</div>',chr(10),chr(10),'# ',source,chr(10),chr(10),text) else text end as content,
 doc_id
from r""",
    "files_b": """
select project, path, case when length(content) % 7 = 3 then concat(content, chr(10), 'added line') else content end as content from files where length(content) % 10 <> 0
union all select project, concat('new/', path), content from files where length(content) % 50 = 1""",
    "repos": """
select source as name, concat('https://example.com/', source, '.git') as url, concat('/data/', source) as path,
 cast(substring(source, 4) as int) % 2 = 0 as shallow, timestamp '2024-01-01 00:00:00' as fetched_at from documents group by source""",
    "checkouts": """
select source as id, source as repo, 'main' as ref, 'branch' as kind, md5(source) as commit_hash, concat('/data/', source) as path, timestamp '2024-01-02 00:00:00' as updated_at, timestamp '2024-01-02 00:00:00' as parsed_at from documents group by source
union all select concat(source,'@',lang), source, lang, case lang when 'en' then 'tag' when 'fr' then 'commit' else 'branch' end, md5(concat(source,lang)), concat('/data/',source,'@',lang), timestamp '2024-01-03 00:00:00', case when lang='es' then null else timestamp '2024-01-03 00:00:00' end from documents group by source, lang""",
    "parts": f"""
select *, row_number() over (partition by project, stem order by k) as rn, count(*) over (partition by project, stem) as n from (
 select concat('brand',replace(p_brand,'Brand#','')) as project,
  concat('src/',lower(p_type),'_',cast(p_partkey // {PARTS_PER_FILE} as varchar)) as stem,
  concat(upper(substring(p_type,1,1)),lower(substring(p_type,2))) as cls, p_partkey as k,
  concat('m',cast(p_partkey as varchar),'_',replace(p_name,' ','_')) as member from part)""",
    "symbols": """
select project, concat(stem,'.py') as path, member as name, 'method' as kind, cast(2*rn as int) as line, cast(2*rn+1 as int) as end_line, cls as parent, 'python' as lang from parts
union all select project, concat(stem,'.py'), cls, 'class', 1, cast(2*n+1 as int), cast(null as varchar), 'python' from parts where rn = 1""",
    "commits": """
with j as (select concat('r',cast(o_custkey % 20 as varchar)) as repo, o_orderkey, o_orderdate, o_orderstatus, c_name, o_orderpriority, md5(concat('c',cast(o_orderkey as varchar))) as hash from orders join customer on o_custkey=c_custkey)
select repo, hash, lag(hash) over (partition by repo order by o_orderdate,o_orderkey) as parent, c_name as author, concat(lower(replace(c_name,'#','.')),'@example.com') as email, o_orderdate as author_ts, o_orderpriority as subject, lower(o_orderstatus) as branch, row_number() over (partition by repo order by o_orderdate,o_orderkey) as rn from j""",
    "refs": """
select repo, concat('refs/heads/',branch) as full_name, hash from (select *, row_number() over (partition by repo, branch order by rn desc) as k from commits) t where k = 1
union all select repo, concat('refs/remotes/origin/',branch), hash from (select *, row_number() over (partition by repo, branch order by rn desc) as k from commits) t where k = 1
union all select repo, 'refs/remotes/origin/HEAD', hash from (select *, row_number() over (partition by repo order by rn desc) as k from commits) t where k = 1
union all select repo, concat('refs/tags/v',cast(rn as varchar)), case when rn % 50 = 0 then hash else md5(concat('t',hash)) end from commits where rn % 25 = 0""",
    "tag_objects": """
select repo, md5(concat('t',hash)) as hash, hash as target from commits where rn % 25 = 0 and rn % 50 <> 0""",
    "remote_refs": """
select repo, hash, full_name as name from refs where full_name like 'refs/heads/%' or full_name like 'refs/tags/%'
union all select r.repo, t.target, concat(r.full_name,'^{}') from refs r join tag_objects t on r.repo=t.repo and r.hash=t.hash""",
    "ref_events": """
select concat('r',cast(user_id % 20 as varchar),'@',event_type) as id, ts, event_type as ref, 'branch' as kind, md5(cast(event_id as varchar)) as commit_hash from events""",
    "read_requests": """
select project as req_id, project, path, doc_id as pos, case length(content) % 6 when 0 then '' when 1 then '2-4' when 2 then '3' when 3 then '500-510' when 4 then '9-2' else 'x' end as line_range from files
union all select source, source, 'no/such/file.txt', max(doc_id) + 1, '' from documents group by source""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(?:from|join)\s+{v}\b", sql)]


def with_views(body: str) -> str:
    """`body` with the derived tables it reads (and those they read) in front."""
    wanted: set[str] = set()
    todo = _needs(body)
    while todo:
        view = todo.pop()
        if view not in wanted:
            wanted.add(view)
            todo += _needs(VIEWS[view])
    parts = [f"{v} as ({VIEWS[v].strip()})" for v in VIEWS if v in wanted]
    body = body.strip()
    if not parts:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
