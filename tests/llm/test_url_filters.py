"""The as-of join against a plain walk over all entries."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from urllib.parse import urlsplit

from repoloom.llm.url_filters import ACTIONS, KINDS, filter_urls, intervals

DAY = dt.date(2024, 1, 1)
ENTRY = "list string, kind string, value string, action string, dated date"
CAPTURE = "page_id long, url string, fetched_at date, kind int, value int, month int"


def names(url):
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if not host:
        return []
    path = (parts.path or "") + (f"?{parts.query}" if parts.query else "")
    path = path if path.startswith("/") else "/" + path
    folders = path.split("?")[0].split("/")[:-1]
    labels = host.split(".")
    return ([("url", host + path), ("host", host)] + [("prefix", host + "/".join(folders[:n]) + "/") for n in range(1, len(folders) + 1)]
            + [("domain", ".".join(labels[n:])) for n in range(len(labels))])


def plain(captures, entries):
    dated = defaultdict(dict)
    for name, kind, value, action, day in entries:
        if None not in (name, kind, value, action, day) and kind in KINDS and action in ACTIONS:
            old = dated[name, kind, value].get(day)
            dated[name, kind, value][day] = action if old is None else min(old, action, key=ACTIONS.index)
    out = {}
    for key, url, at, *_ in captures:
        found = []
        for name, kind, value in dated:
            days = [d for d in dated[name, kind, value] if at and d <= at]
            action = dated[name, kind, value][max(days)] if days else "remove"
            if url and (kind, value) in names(url) and action != "remove":
                found.append((KINDS.index(kind), -len(value), ACTIONS.index(action), name, kind, value, action))
        best = min(found) if found else (None,) * 7
        out[key, url, at] = (len(found), best[6] == "block", best[3], best[4], best[5])
    return out


def test_against_plain_walk(spark):
    draw = random.Random(2)
    hosts = ["a.example.com", "b.example.com", "example.com", "Z.org", "m.z.org"]
    urls = [f"https://{draw.choice(['', 'u:p@'])}{h}{draw.choice(['', ':8080'])}{p}" for h in hosts for p in ("", "/", "/x", "/x/y/?q=1/2#top", "/x/y/z.html", "?q")]
    urls += [None, "", "no url", "ftp:///nohost", "http://A.EXAMPLE.com/x/y/w"]
    captures = [(i, u, DAY + dt.timedelta(draw.randrange(400)), 1, 2, 3) for i, u in enumerate(urls * 4)] + [(900, urls[0], None, 1, 2, 3), (None, urls[3], DAY, 1, 2, 3)]
    values = sorted({n for u in urls if u for n in names(u)})
    entries = [(draw.choice("PQ"), *draw.choice(values), draw.choice(ACTIONS), DAY + dt.timedelta(draw.randrange(-40, 420))) for _ in range(500)]
    entries += entries[:20] + [(None, "host", "z.org", "block", DAY), ("P", "host", None, "block", DAY), ("P", "host", "z.org", "block", None), ("P", "odd", "z.org", "block", DAY)]
    got = {(r.page_id, r.url, r.fetched_at): (r.n_active, r.blocked, r.list, r.kind, r.value) for r in
           filter_urls(spark.createDataFrame(captures + captures[:9], CAPTURE), spark.createDataFrame(entries, ENTRY)).collect()}
    assert got == plain(captures, entries)
    assert len({v[1] for v in got.values()}) == 2


def test_intervals(spark):
    rows = [("L", "host", "h", "block", DAY), ("L", "host", "h", "allow", DAY), ("L", "host", "h", "remove", DAY + dt.timedelta(3)), ("L", "host", "h", "block", DAY + dt.timedelta(9))]
    got = sorted((r.action, r.since, r.until) for r in intervals(spark.createDataFrame(rows, ENTRY)).collect())
    assert got == [("allow", DAY, DAY + dt.timedelta(3)), ("block", DAY + dt.timedelta(9), None)]


def test_empty_tables(spark):
    captures, entries = spark.createDataFrame([(1, "http://h/", DAY, 1, 2, 3)], CAPTURE), spark.createDataFrame([], ENTRY)
    assert filter_urls(captures, entries).first().blocked is False
    assert filter_urls(captures.where("false"), entries).count() == 0
