"""HTML extraction: a host's suffix array over the token streams of all its pages finds boilerplate, checked against the blocks' structure."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, id_type, stored
from .suffixes import repeats, sliding_least
from .url_filters import host_of

SPAN = 10  # tokens of the shortest string that counts as repeated
GRAM = 4
LONGEST_RUN = 32
PAGES = 500  # pages whose tokens are handled at once
BLOCK = 1 << 18  # tokens of a suffix array
HOT = 4096  # pages with a gram, from which on it is no key
_DRAW = np.random.default_rng(11)
_BYTE = _DRAW.integers(0, 2**63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF93
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Fixed values of HTML: elements without content, with raw text, and those that don't break a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
APART = {"nav", "header", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "dialog", "menu", "audio", "video", "map", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
# Words in class names and ids that mark what is no article.
WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "sidebar", "sidebars", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header",
    "footer", "masthead", "comment", "comments", "commentlist", "respond", "disqus", "share", "sharing", "social", "newsletter", "subscribe",
    "popup", "modal", "overlay", "related", "recommended", "widget", "widgets", "toolbar", "pagination", "pager", "skip", "hidden",
}
# Words after these that only say what kind of box it is.
BOXES = {"area", "bar", "block", "box", "btn", "button", "bottom", "col", "container", "content", "group", "inner", "item", "items", "left", "link", "links",
         "list", "outer", "panel", "right", "row", "section", "slot", "text", "title", "top", "unit", "wrap", "wrapper", "zone"}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>]+)*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _marked(name: str) -> bool:
    """Whether a class name or id says that its element is no main text: by its last word that isn't one for a box."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    while len(words) > 1 and words[-1] in BOXES:
        words.pop()
    return bool(words) and words[-1] in WORDS


@lru_cache(maxsize=20_000)
def _is_apart(name: str, attributes: str) -> bool:
    """Whether an element's name, role or names of classes mark what is no main text."""
    if name in APART:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for key, value in _MARKS.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and any(map(_marked, value.split())):
            return True
    return False


@lru_cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


def zones(page: str) -> tuple[list[str], list[str], list[str]]:
    """Texts of the blocks of the page in its articles, outside them, and in menus and the like.

    References are decoded and white space inside a block is one space.  An
    element that is never closed ends with the one around it, a raw one or a
    comment at the end of the page.
    """
    inside: list[str] = []
    outside: list[str] = []
    marked: list[str] = []
    held: list[str] = []
    open_: list[tuple[str, bool, bool]] = []
    apart = article = False

    def flush() -> None:
        words = html.unescape("".join(held)).split()
        if words:
            (marked if apart else inside if article else outside).append(" ".join(words))
        held.clear()

    at, search = 0, _MARKUP.search
    while True:
        m = search(page, at)
        if not m:
            held.append(page[at:])
            flush()
            return inside, outside, marked
        start, end_ = m.span()
        if start > at:
            held.append(page[at:start])
        at = end_
        closing, name, attributes, *loose = m.groups()
        if not name:
            closing, name, attributes = loose
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing:
                end = _end_of(name).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name != "wbr":
                held.append(" ")
            continue
        if held and name not in INLINE:
            flush()
        if closing:
            if open_ and (open_[-1][0] == name or any(x[0] == name for x in open_)):
                while True:
                    last, was_apart, was_article = open_.pop()
                    if last == name:
                        break
                if (was_apart, was_article) != (apart, article):
                    flush()
                    apart, article = was_apart, was_article
            continue
        if open_ and open_[-1][0] in _CLOSES.get(name, ()):
            _, was_apart, was_article = open_.pop()
            if (was_apart, was_article) != (apart, article):
                flush()
                apart, article = was_apart, was_article
        open_.append((name, apart, article))
        if not apart and _is_apart(name, attributes):
            flush()
            apart = True
        elif not apart and not article and name in ("article", "main"):
            flush()
            article = True


def blocks(page: str) -> tuple[list[str], list[str]]:
    """zones() without the blocks of menus and the like."""
    return zones(page)[:2]


def token_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the tokens between the single spaces of a text: differences of running sums of bytes times powers."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    found = []
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), 1 << 20)), len(starts)))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # stretches of about 1 MiB
        base, size = starts[low], ends[high - 1] - starts[low]
        power = np.cumprod(np.append(np.uint64(1), np.full(size, _BASE, np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(_BYTE[data[base:base + size]] * power[:-1]))
        a, b = starts[low:high] - base, ends[low:high] - base
        back = np.uint64(pow(_BASE, -int(size), 1 << 64))  # so that a token's place doesn't count
        value = (sums[b] - sums[a]) * power[size - a] * back + (b - a).astype(np.uint64) * _MIX
        value = (value ^ (value >> np.uint64(32))) * _MIX
        found.append(value ^ (value >> np.uint64(29)))
    return np.concatenate(found)


def streams(hosts: list[str | None], parts: list[tuple[list[str], ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the tokens of the zones() of pages laid end to end, 0 after each zone, and how many each zone has.

    Hashes differ between hosts and between articles and the rest.
    """
    texts = [" ".join(zone) for zones_ in parts for zone in zones_]
    sizes = np.array([t.count(" ") + 1 if t else 0 for t in texts])
    lead = np.array([xxhash.xxh64_intdigest(f"{host or ''}\0{n == 0}") for host, zones_ in zip(hosts, parts, strict=True) for n in range(len(zones_))], np.uint64)
    hashes = token_hashes(" ".join(filter(None, texts)).encode()) ^ np.repeat(lead, sizes)
    out = np.zeros(sizes.sum() + len(sizes), np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = np.maximum(hashes, 1)
    return out, sizes


def least_grams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, at, n): runs of at most LONGEST_RUN neighbouring strings of SPAN tokens, none of them 0, with the same least hash of their grams.

    Equal strings have equal keys, wherever they stand.
    """
    if len(tokens) < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(tokens) - GRAM + 1
    grams = tokens[:size]
    for step in range(1, GRAM):
        grams = (grams ^ (grams >> np.uint64(31))) * _MIX + tokens[step:step + size]
    least = sliding_least((grams ^ (grams >> np.uint64(29))) * _MIX, SPAN - GRAM + 1)
    stops = np.append(0, np.cumsum(tokens == 0))
    at = np.flatnonzero(stops[SPAN:] == stops[:-SPAN])
    key = least[at]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1))[:len(at)])
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(within % LONGEST_RUN == 0)
    return key[first], at[first], np.diff(np.append(first, len(at)))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `sizes` of them, end to end."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def covered_by(starts: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` tokens lie in a string of SPAN tokens that begins where `starts` is true."""
    edges = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, np.minimum(at + SPAN, size), -1)
    return np.cumsum(edges[:-1]) > 0


def named_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, host, html, page): rows with a number that equal ids and contents share."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    if id_type(rows) != "bigint":
        rows = rows.withColumn("id", F.col("id").cast("string"))
    return rows.withColumn("page", F.xxhash64("id", "host", "html"))


def pieces_of(batches: Iterator[pa.RecordBatch], size: int = PAGES) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def gram_pages(rows: DataFrame) -> DataFrame:
    """(page, key): 40 bits of the least grams of all strings of SPAN tokens of each page."""

    def each(batches):
        for batch in pieces_of(batches):
            parts = [zones(text) for text in batch.column(2).to_pylist()]
            tokens, sizes = streams(batch.column(1).to_pylist(), parts)
            key, at, _ = least_grams(tokens)
            of = np.searchsorted(np.cumsum(sizes.reshape(-1, 3).sum(axis=1) + 3), at, "right")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array((key >> np.uint64(24)).view(np.int64))], names=["page", "key"])

    return rows.select("page", "host", "html").mapInArrow(each, "page long, key long")


def met_keys(rows: DataFrame, hot: int) -> DataFrame:
    """(page, keys, crowded): the keys of gram_pages() that other pages have too, and those of them that over `hot` pages have."""
    window = Window.partitionBy("key")
    counted = gram_pages(rows).select("page", "key", (F.min("page").over(window) < F.max("page").over(window)).alias("several"), F.count("*").over(window).alias("m"))
    return counted.where("several").groupBy("page").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("m") > hot, F.col("key"))).alias("crowded"))


def packed(rows: DataFrame) -> DataFrame:
    """(page, host, zones): the zones() of each page, compressed."""

    def each(batches):
        for batch in pieces_of(batches):
            texts = ("\t".join("\n".join(zone) for zone in zones(text)).encode() for text in batch.column(2).to_pylist())  # no block has such white space
            found = [len(t).to_bytes(4, "little") + pa.compress(t, "zstd", asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["page", "host", "zones"])

    return rows.select("page", "host", "html").mapInArrow(each, "page long, host string, zones binary")


def unpacked(held: bytes) -> tuple[list[str], ...]:
    text = pa.decompress(held[4:], int.from_bytes(held[:4], "little"), "zstd", asbytes=True).decode()
    return tuple(zone.split("\n") if zone else [] for zone in text.split("\t"))


def parsed(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(page, host, article, stream, crowded, tokens, blocks) of the stretches of each page whose strings may stand in another page, all zones of all pages being searched.

    `stream` has the hashes of the tokens, 8 bytes each, 0 after each stretch.
    `article` is a hash of the blocks in articles; where there are none,
    `tokens` has (at, token): which token of the outside blocks stands where.
    `blocks` has (n, hash, a, b) of every block in an article that lies whole
    in a stretch.  A string that is left out has a least gram that no other
    page has.
    """
    asked = packed(rows).join(stored(met_keys(rows, hot)), "page").select("page", "host", "zones", "keys", "crowded")
    numbers = pa.int64()
    schema = pa.schema([
        ("page", numbers), ("host", pa.string()), ("article", numbers), ("stream", pa.binary()), ("crowded", pa.list_(numbers)),
        ("tokens", pa.list_(pa.struct([("at", pa.int32()), ("token", pa.int32())]))),
        ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("hash", numbers), ("a", pa.int32()), ("b", pa.int32())])))])

    def found(batch):
        pages, hosts, zipped, keys, crowded = (c.to_pylist() for c in batch.columns)
        parts = [unpacked(z) for z in zipped]
        tokens, sizes = streams(hosts, parts)
        begins = np.append(0, np.cumsum(sizes + 1))
        key, at, n = least_grams(tokens)
        of = np.searchsorted(begins[3::3], at, "right")
        wanted = np.array([k << 24 | page for page, some in enumerate(keys) for k in some], np.uint64)
        met = np.isin((key >> np.uint64(24)) << np.uint64(24) | of.astype(np.uint64), wanted)
        starts = np.zeros(len(tokens), bool)
        starts[spread(at[met], n[met])] = True
        held = covered_by(starts, len(tokens))
        kept = held | (np.diff(held.astype(np.int8), prepend=0) < 0)
        place = np.append(0, np.cumsum(kept))
        whole = np.append(0, np.cumsum(held))
        left = np.where(held, tokens, 0)
        for page, (inside, outside, _) in enumerate(parts):
            begin, middle, last, end = begins[3 * page:3 * page + 4].tolist()
            base = place[begin]
            sizes_of = np.array([b.count(" ") + 1 for b in inside], np.int64)
            b = begin + np.cumsum(sizes_of)
            a = b - sizes_of
            blocks_of = [(n, xxhash.xxh64_intdigest(inside[n]) - 2**63, int(place[a[n]] - base), int(place[a[n]] - base + sizes_of[n]))
                         for n in np.flatnonzero(whole[b] - whole[a] == sizes_of).tolist()]
            loose = [] if inside else [(int(place[t] - base), t - middle) for t in (middle + np.flatnonzero(held[middle:last])).tolist()]
            article = xxhash.xxh64_intdigest("\n".join(inside)) - 2**63 if inside else None
            yield pages[page], hosts[page], article, left[begin:end][kept[begin:end]].tobytes(), crowded[page], loose, blocks_of

    def each(batches):
        return batches_of((row for batch in pieces_of(batches) for row in found(batch)), schema, PAGES)

    return asked.mapInArrow(each, "page long, host string, article long, stream binary, crowded array<long>, tokens array<struct<at:int,token:int>>, blocks array<struct<n:int,hash:long,a:int,b:int>>")


def string_runs(made: DataFrame) -> DataFrame:
    """(key, content, tokens, places): runs of strings of the streams with the same least gram, and the (page, at) where they stand.

    Of a gram that very many pages have each string is a run, its hash the key.
    """

    def each(batches):
        for batch in pieces_of(batches, 4 * PAGES):
            held = batch.column(1).to_pylist()
            tokens = np.frombuffer(b"".join(held), np.uint64)
            ends = np.cumsum([len(h) // 8 for h in held])
            key, at, n = least_grams(tokens)
            of = np.searchsorted(ends, at, "right")
            wanted = np.array([k << 24 | page for page, some in enumerate(batch.column(2).to_pylist()) for k in some], np.uint64)
            single = np.isin((key >> np.uint64(24)) << np.uint64(24) | of.astype(np.uint64), wanted)
            at, of = np.append(at[~single], spread(at[single], n[single])), np.append(of[~single], np.repeat(of[single], n[single]))
            n = np.append(n[~single], np.ones(len(at) - np.sum(~single), np.int64))
            key, alone = key[~single], len(key) - np.sum(single)
            if not len(at):
                continue
            content = n.astype(np.uint64)
            for step in range(int(n.max()) + SPAN - 1):
                more = step < n + SPAN - 1
                content[more] = (content[more] ^ (content[more] >> np.uint64(31))) * _MIX + tokens[at[more] + step]
            key = np.append(key, content[alone:])
            order = np.lexsort((content, key))
            key, content, at, n, of = (x[order] for x in (key, content, at, n, of))
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
            sizes = n[first] + SPAN - 1
            data = tokens[spread(at[first], sizes)]
            begins = np.append(0, ends)[of]
            places = pa.StructArray.from_arrays([batch.column(0).take(pa.array(of)), pa.array((at - begins).astype(np.int32))], names=["page", "at"])
            offsets = np.append(0, np.cumsum(sizes * 8)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first].view(np.int64)), pa.array(content[first].view(np.int64)),
                 pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                 pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), places)],
                names=["key", "content", "tokens", "places"])

    return made.select("page", "stream", "crowded").mapInArrow(each, "key long, content long, tokens binary, places array<struct<page:long,at:int>>")


def shared_strings(tokens: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which strings of SPAN tokens of pieces laid end to end stand in several pages; a piece stands in pages from `low` to `high`."""
    symbols = np.unique(tokens, return_inverse=True)[1]
    text = np.empty(len(tokens) + len(sizes) + 1, np.int64)
    begin = np.append(0, np.cumsum(sizes + 1))
    text[spread(begin[:-1], sizes)] = symbols
    text[np.append(begin[1:] - 1, len(text) - 1)] = len(symbols) + np.arange(len(sizes) + 1)  # each end is another symbol
    order, group = repeats(text, SPAN, 2)
    strings = spread(begin[:-1], sizes - SPAN + 1)
    real = np.zeros(len(text), bool)
    real[strings] = True
    of = np.append(np.repeat(np.arange(len(sizes)), sizes + 1), 0)[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    limits = np.iinfo(np.int64)
    several = np.minimum.reduceat(np.where(real[order], low[of], limits.max), first) < np.maximum.reduceat(np.where(real[order], high[of], limits.min), first)
    twice = np.empty(len(text), bool)
    twice[order] = several[group]
    return twice[strings]


def _solved(key, content, sizes, tokens, counts, pages, places) -> Iterator[pa.RecordBatch]:
    """(page, a, b): strings [a, b) of streams that stand in several pages, from rows with `sizes` tokens and `counts` places, sorted by key and content."""
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
    begin = (np.cumsum(counts) - counts)[first]  # places of a piece
    stand = np.diff(np.append(begin, len(pages)))
    marks = shared_strings(tokens[spread((np.cumsum(sizes) - sizes)[first], sizes[first])], sizes[first], np.minimum.reduceat(pages, begin), np.maximum.reduceat(pages, begin))
    strings = sizes[first] - SPAN + 1
    at = np.cumsum(strings + 1) - strings - 1
    apart = np.zeros(len(marks) + len(first), np.int8)
    apart[spread(at, strings)] = marks
    edge = np.flatnonzero(np.diff(apart, prepend=0, append=0))
    of = np.searchsorted(at, edge[::2], "right") - 1
    for few in range(0, len(of), 20_000):
        part = slice(few, few + 20_000)
        piece = of[part]
        where, span = spread(begin[piece], stand[piece]), np.repeat(np.arange(len(piece)), stand[piece])
        a, b = ((edge[side::2][part] - at[piece])[span].astype(np.int32) + places[where] for side in (0, 1))
        yield from pieces_of([pa.RecordBatch.from_arrays([pa.array(pages[where]), pa.array(a), pa.array(b)], names=["page", "a", "b"])], 100_000)


def repeated_strings(made: DataFrame, block: int = BLOCK) -> DataFrame:
    """(page, a, b): where strings start in the streams that stand in another page too.

    Equal strings have the same key.  The runs of neighbouring keys make a
    suffix array of about `block` tokens each.
    """

    def columns(batch):
        held, lists = batch.column(2).cast(pa.binary()), batch.column(3)
        bounds, listed = np.frombuffer(held.buffers()[1], np.int32)[held.offset:held.offset + len(held) + 1], lists.offsets.to_numpy()
        tokens = np.frombuffer(held.buffers()[2], np.uint64, (bounds[-1] - bounds[0]) // 8, bounds[0])
        pages, places = (lists.values.field(i).to_numpy()[listed[0]:listed[-1]] for i in (0, 1))
        return batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(bounds).astype(np.int64) // 8, tokens, np.diff(listed).astype(np.int64), pages, places

    def each(batches):
        waiting, size = [], 0
        for batch in pieces_of(batches, 2000):
            waiting.append(columns(batch))
            size += len(waiting[-1][3]) + len(waiting[-1][5]) // 8
            if size < block or waiting[0][0][0] == waiting[-1][0][-1]:
                continue
            key, content, sizes, tokens, counts, pages, places = (np.concatenate(c) for c in zip(*waiting, strict=True))
            n = np.searchsorted(key, key[-1])  # the last key may go on
            t, p = sizes[:n].sum(), counts[:n].sum()
            yield from _solved(key[:n], content[:n], sizes[:n], tokens[:t], counts[:n], pages[:p], places[:p])
            waiting = [(key[n:], content[n:], sizes[n:], tokens[t:], counts[n:], pages[p:], places[p:])]
            size = len(tokens) - t + (len(pages) - p) // 8
        if waiting:
            yield from _solved(*(np.concatenate(c) for c in zip(*waiting, strict=True)))

    return string_runs(made).repartition("key").sortWithinPartitions("key", "content").mapInArrow(each, "page long, a int, b int")


def repeated_parts(made: DataFrame) -> DataFrame:
    """(page, host, article, gone, blocks): tokens of the outside blocks, and (n, hash) of blocks in articles, that repeated strings cover."""
    ranges = repeated_strings(made).groupBy("page").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    asked = made.where("size(tokens) > 0 or size(blocks) > 0")  # of other pages no part is covered whole
    joined = asked.select("page", "host", "article", F.expr("octet_length(stream) div 8").alias("size"), "tokens", "blocks").join(ranges, "page")

    def one(page, host, article, size, tokens, blocks, ranges):
        starts = np.zeros(size, bool)
        for r in ranges:
            starts[r["a"]:r["b"]] = True
        covered = covered_by(starts, size)
        return page, host, article, [t["token"] for t in tokens if covered[t["at"]]], [(b["n"], b["hash"]) for b in blocks if covered[b["a"]:b["b"]].all()]

    schema = pa.schema([("page", pa.int64()), ("host", pa.string()), ("article", pa.int64()), ("gone", pa.list_(pa.int32())),
                        ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("hash", pa.int64())])))])

    def each(batches):
        return batches_of((one(*row) for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "article", "size", "tokens", "blocks", "ranges")), strict=True)), schema, 2000)

    return joined.mapInArrow(each, "page long, host string, article long, gone array<int>, blocks array<struct<n:int,hash:long>>")


def boilerplate(rows: DataFrame, share: float, least: int) -> DataFrame:
    """(page, gone): numbers of the blocks in articles, or else of the tokens of the outside blocks, that are a host's boilerplate."""
    found = stored(repeated_parts(stored(parsed(rows))))
    each = found.where("article is not null").select("page", F.coalesce("host", F.lit("")).alias("host"), "article", F.inline("blocks"))
    sizes = rows.select(F.coalesce("host", F.lit("")).alias("host"), "page").distinct().groupBy("host").agg(F.count("*").alias("size"))
    often = each.select("host", "hash", "article").distinct().groupBy("host", "hash").agg(F.count("*").alias("m")).where(F.col("m") >= least)
    often = often.join(sizes, "host").where(F.col("m") >= share * F.col("size")).select("host", "hash")
    inside = each.join(often, ["host", "hash"]).groupBy("page").agg(F.collect_set("n").alias("gone"))
    outside = found.where("article is null and size(gone) > 0").groupBy("page").agg(F.first("gone").alias("gone"))
    return inside.unionByName(outside)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5, least: int = 5) -> DataFrame:
    """(id, url, text) of every page: its articles, or else its other blocks, without what is boilerplate of its host.

    The token streams of all pages of a host, articles, other blocks and
    menus, go through its suffix array, which finds the strings of ten tokens
    or more that stand in another page too.  The page's structure then checks
    them.  A page with an article or main element gives the blocks in it, less
    menus, headers, footers, sidebars, notices, adverts, forms and comments by
    their elements, roles and class names, and less blocks that such strings
    cover in `least` different articles and in a `share` of the host's pages,
    unless they are over half of its text, which makes it a version of another
    article; so passages and whole articles that some pages share stay.  Any other page gives its remaining blocks, less all
    such strings that also stand outside the articles of another page.  A null
    page has an empty text; rows that repeat an id and html are one page, those
    that repeat an id with other html are pages of their own; an empty table
    gives no rows.
    """
    rows = named_pages(pages, id_col, url_col, html_col)
    joined = rows.join(stored(boilerplate(rows, share, least)), "page", "left").select("id", "url", "html", "gone")

    def text_of(page, gone):
        inside, outside, _ = zones(page)
        parts = inside or " ".join(outside).split()
        lost = set(gone or ())
        left = [part for n, part in enumerate(parts) if n not in lost]
        if inside and 2 * sum(map(len, left)) < sum(map(len, inside)):
            return " ".join(inside)
        return " ".join(left)

    def kept(batches):
        for batch in batches:
            texts = [text_of(*row) for row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    found = joined.mapInArrow(kept, f"id {id_type(rows)}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of main_text() for every row."""
    return main_text(pages, id_col, url_col, html_col).withColumn("n_chars", F.char_length("text").cast("long"))
