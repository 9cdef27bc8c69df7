"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.session import scratch_dir

from .bestfit import pack_best_fit
from .common import table
from .decontaminate import contamination_report
from .extract import page_texts
from .fingerprints import edited_report
from .packing import pack
from .prefixes import rebuilt_report
from .quality import quality_scores, train
from .secrets import report_of, scan_into
from .simhash import simhash_classes
from .suffixes import dedup_report
from .token_counts import token_counts
from .url_filters import filter_urls, host_of, path_of
from .whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language and encoded length: counts, totals and truncated totals at that context limit."""
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose fingerprints are linked at two differing bits or fewer."""
    return simhash_classes(table(spark, sf_dir, "documents"))


@query
def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that stand in a repeated string of 200 bytes."""
    return dedup_report(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of ten words of a benchmark item."""
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
ORACLES["op4_decontamination"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, size, array_to_string(w[p:p + size - 1], ' ') as s
  from (select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from b where len(w) > 0)),
places as (
  select doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') as s
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p from d, (select distinct size from windows))),
met as (select doc_id, p, size, item_id from places join windows using (size, s)),
hits as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from met) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, cast(item_id as varchar) as item from met) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)"""


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; equal texts are scanned once, and nothing again when the scan is repeated on its ledger."""
    docs, where = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/ledger"
    scan_into(docs, where)
    return report_of(docs, scan_into(docs, where))


def _secret_rows(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """SQL for (doc_id, rank, kind, start, end) of a pattern's matches."""
    return f"""
  select doc_id, {rank} as rank, '{kind}' as kind, stop - size as start, stop, ok from (
    select doc_id, size, ok, sum(gap + size) over (partition by doc_id order by n rows unbounded preceding) as stop from (
      select doc_id, unnest(range(1, len(m) + 1)) as n, length(unnest(m)) as size, length(unnest(g[1:len(m)])) as gap, length(unnest(v)) >= {least} as ok
      from (select doc_id, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g,
        regexp_extract_all(t, '{pattern}', {group}) as v from d where regexp_matches(t, '{pattern}'))))"""


ORACLES["op10_secrets"] = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join([
    _secret_rows(0, "assign", "(?i)(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    _secret_rows(1, "access", "AKIA[A-Z0-9]+", 0, 18), _secret_rows(2, "hex", "[0-9a-f]+", 0, 16),
    _secret_rows(3, "github", "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0), _secret_rows(4, "slack", "xox[abprs]-[A-Za-z0-9-]{16,}", 0, 0),
    _secret_rows(5, "google", "AIza[A-Za-z0-9_-]{35,}", 0, 0),
    _secret_rows(6, "jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 0),
    _secret_rows(7, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 0)])}),
k as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank) filter (rank < 3) as base,
  string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank) as spans from s where ok group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join k using (doc_id)"""


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return edited_report(table(spark, sf_dir, "documents"))


@query
def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_texts(table(spark, sf_dir, "pages"))


def _digit(of: Column, n: int) -> Column:
    """Place of the n-th hex digit of the MD5 of a value, from 1 on."""
    return F.call_function("locate", F.substring(F.md5(of), n, 1), F.lit("0123456789abcdef"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries for the hosts, domains, folders and urls of the pages, dated by digits of their hashes."""
    named = pages.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host is not null")
    hosts = named.select("host").distinct()
    first = F.regexp_extract("path", r"^(/[^/?]*/)", 1)
    values = (
        hosts.select(F.lit("hosts").alias("list"), F.lit("host").alias("kind"), F.col("host").alias("value"))
        .union(hosts.select(F.lit("domains"), F.lit("domain"), F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1)))
        .union(named.where(first != "").select(F.lit("folders"), F.lit("prefix"), F.concat("host", first)))
        .union(named.select(F.lit("urls"), F.lit("url"), F.concat("host", "path")))
    ).where("value <> ''").distinct()
    digit = lambda n: _digit(F.col("value"), n)
    start = F.date_add(F.lit("2024-01-01").cast("date"), digit(2) * 15 + digit(3))
    listed = values.where(digit(1) <= 8).select(
        "list", "kind", "value", F.when(F.col("kind") == "prefix", "allow").otherwise("block").alias("action"), start.alias("dated"), digit(4).alias("d4"), digit(5).alias("d5"))
    gone = listed.where("d4 <= 10").select("list", "kind", "value", F.lit("remove").alias("action"), F.date_add("dated", F.col("d4") * 9).alias("dated"))
    back = listed.where("d5 <= 6").select("list", "kind", "value", F.lit("allow").alias("action"), F.date_add("dated", F.col("d5") * 20).alias("dated"))
    return listed.drop("d4", "d5").union(gone).union(back)


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the list entries in force on the day of its fetch, which its id gives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    return filter_urls(captures, dated_entries(pages))


def _place(n: int) -> str:
    return f"strpos('0123456789abcdef', substr(md5(value), {n}, 1))"


ORACLES["op2_url_filters"] = f"""
with p as (select distinct page_id, url, date '2024-01-01' + cast(page_id % 366 as integer) as fday,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) as rest from pages),
n as (select *, case when rest like '/%' then rest else '/' || rest end as path from p),
v as (select distinct 'hosts' as list, 'host' as kind, host as value from n where host is not null
  union select distinct 'domains', 'domain', regexp_extract(host, '([^.]+[.][^.]+)$', 1) from n where host is not null
  union select distinct 'folders', 'prefix', host || regexp_extract(path, '^(/[^/?]*/)', 1) from n where host is not null and regexp_matches(path, '^/[^/?]*/')
  union select distinct 'urls', 'url', host || path from n where host is not null),
l as (select list, kind, value, case when kind = 'prefix' then 'allow' else 'block' end as action,
    date '2024-01-01' + cast({_place(2)} * 15 + {_place(3)} as integer) as dated, {_place(4)} as d4, {_place(5)} as d5
  from v where value <> '' and {_place(1)} <= 8),
e as (select list, kind, value, action, dated from l
  union all select list, kind, value, 'remove', dated + cast(d4 * 9 as integer) from l where d4 <= 10
  union all select list, kind, value, 'allow', dated + cast(d5 * 20 as integer) from l where d5 <= 6),
-- of one day's entries allow wins over block over remove, which is their order by name
i as (select list, kind, value, min(action) as action, dated as since,
    lead(dated) over (partition by list, kind, value order by dated) as until from e group by list, kind, value, dated),
c as (
  select page_id, url, fday, 'url' as kind, host || path as value from n where host is not null
  union all select page_id, url, fday, 'host', host from n where host is not null
  union all select page_id, url, fday, 'domain', array_to_string(string_split(host, '.')[k:], '.')
    from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as k from n where host is not null)
  union all select page_id, url, fday, 'prefix', host || array_to_string(string_split(split_part(path, '?', 1), '/')[1:k], '/') || '/'
    from (select *, unnest(range(1, len(string_split(split_part(path, '?', 1), '/')))) as k from n where host is not null)),
m as (select page_id, url, fday, i.list, i.kind, i.value, i.action,
    row_number() over (partition by page_id, url, fday order by list_position(['url', 'prefix', 'host', 'domain'], i.kind), -length(i.value), i.action, i.list) as place,
    count(*) over (partition by page_id, url, fday) as n_active
  from c join i on c.kind = i.kind and c.value = i.value and fday >= since and (until is null or fday < until) and i.action <> 'remove')
select p.page_id, p.url, p.fday as fetched_at, coalesce(n_active, 0) as n_active, coalesce(action = 'block', false) as blocked, list, kind, value
from p left join (select * from m where place = 1) m on p.page_id is not distinct from m.page_id and p.url is not distinct from m.url"""


@query
def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the start of another one."""
    return rebuilt_report(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefixes"] = """
with tab as (select list(v order by i) as tab from (
    select i, list_reduce([cast(i as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
    from range(256) r(i))),
o as (select conv_id as c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own
  from conversations where conv_id is not null group by conv_id),
k as (select c, own, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(cast(c as varchar)) + 1),
    lambda p: cast(ascii(substr(cast(c as varchar), cast(p as integer), 1)) as bigint))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 as h from o, tab),
s as (select k.c, list_concat(list_slice(coalesce(b.own, []), 1, h), list_slice(k.own, h + 1, len(k.own))) as seq
  from k left join o b on b.c = k.c - k.c % 5),
p as (select c, seq, d, seq[1:d] as path from (select c, seq, unnest(range(0, len(seq) + 1)) as d from s)),
n as (select path, d, min(c) as conv_id, count(*) as n_convs, case when d = 0 then 0 else strlen(any_value(path[d].x)) end as size,
    count(*) filter (len(seq) = d) as n_ends, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (len(seq) = d), '')) as ends_sha256 from p group by path, d),
kids as (select path[1:d - 1] as path, count(*) as n_children from n where d > 0 group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (path)),
below as (select path[1:e] as path, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * size) as saved_tokens
  from (select path, n_children, n_convs, size, unnest(range(0, d + 1)) as e from f) group by 1)
select f.conv_id, f.d as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, f.ends_sha256, f.n_ends
from f join below using (path) left join n up on up.path = f.path[1:f.d - 1] and f.d > 0"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first sixteen principal axes of the distinct vectors, at unit variance."""
    return whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by best fit into sequences of 1024 ids, cut only where they are longer."""
    return pack_best_fit(table(spark, sf_dir, "documents"))
