"""Main text of pages: structure, references, broken markup, and boilerplate that only a host's other pages show."""

from __future__ import annotations

import html
import random
import re

from repoloom.llm.common import table
from repoloom.llm.extract import blocks, main_text, named_pages, page_texts, parsed, repeated_parts, repeated_strings, token_hashes, zones

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string, id string, text string, codes string"


def test_given_pages(spark):
    got = {r.page_id: r for r in page_texts(table(spark, SF, "pages")).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = p.html[p.html.index("<article>") + 9:].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", body))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_structure():
    page = """<html><head><title>T</title></head><body><header>H</header><div class="site-menu">M</div><main>
      <h1>One&nbsp;&amp;<b>two</b></h1><script>var a = "</p>";</script><p class='x'>Three<br>four <i>fi</i>ve<p>six
      <div class="cookie-notice"><p>N</div><form><p>F</form><aside>S</aside><ul><li>a<li>b</ul><!-- <p>no -->
      <div id=comments>C<div>D</div></div><p style="display:none">X</p><a title="1 > 0" href='y'>seven</a></main><footer>E</footer>"""
    assert blocks(page)[0] == ["One &two", "Three four five", "six", "a", "b", "seven"]
    assert blocks("<article><p>cut off <b")[0] == ["cut off"]
    assert blocks("<p>a</p> b <") == ([], ["a", "b <"])
    assert blocks("<article><p class=ad>x<p>y</article>z")[0] == ["y"]
    assert blocks("") == ([], []) and blocks("plain &lt; text") == ([], ["plain < text"])
    assert blocks("<div " + "a='" * 2000) == ([], [])
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert blocks(deep) == ([], ["x"])


def test_names_of_classes():
    """The last word of a name decides, so a name that only mentions a header or a notice marks nothing."""
    for name in ("hidden-gems", "header-image", "related-work", "skip-to-results", "adverbs", "menu-of-the-day", "content", "box"):
        assert blocks(f"<main><p class='x {name}'>kept</p></main>")[0] == ["kept"], name
        assert blocks(f"<main><p id={name}>kept</p></main>")[0] == ["kept"], name
    for name in ("ad", "ad-slot", "site-menu", "cookie_notice", "sidebar-left", "comments", "comment-list", "ad-300", "nav2", "share-links", "top sponsored"):
        assert blocks(f"<main><div class='{name}'>gone</div>kept</main>")[0] == ["kept"], name


def test_host_boilerplate(spark):
    menu = " ".join(f"menu{i}" for i in range(14))
    own = [" ".join(f"own{n}x{i}" for i in range(25)) for n in range(4)]
    rows = [(n, "http://h.org/a", f"<div>{menu}</div><p>{own[n]}</p>") for n in range(3)]
    rows += [(3, "http://other.org/", f"<div>{menu}</div><p>{own[3]}</p>"), (4, "http://h.org/b", "<p>short one</p>"), (5, "http://h.org/c", None),
             (6, None, "<p>no host</p>"), (7, "http://h.org/d", f"<article>{menu}</article>"), (8, "http://solo.org/", f"<p>{menu}</p><p>{menu}</p>")]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGE)
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert [got[n] for n in range(3)] == own[:3]
    assert got[3] == f"{menu} {own[3]}" and got[4] == "short one" and got[5] == "" and got[6] == "no host"
    assert got[7] == menu and got[8] == f"{menu} {menu}"
    assert main_text(pages.where("false")).count() == 0
    assert main_text(pages.union(pages)).count() == 18


def words(lead: str, n: int) -> str:
    return " ".join(f"{lead}{i}" for i in range(n))


def test_all_pages_are_searched(spark):
    """Menus of pages with an article tell what is a menu of a page without one, whether they are marked there or not."""
    menu, legal = words("menu", 14), words("legal", 12)
    rows = [(n, "http://h.org/a", f"<div>{menu}</div><article>{words(f'own{n}x', 20)}</article><footer>{legal}</footer>") for n in range(3)]
    rows += [(3, "http://h.org/b", f"<div>{menu}</div><p>{words('loose', 20)}</p><p>{legal}</p>"),
             (4, "http://h.org/print", f"<p>{words('own0x', 20)}</p>"), (5, "http://other.org/b", f"<div>{menu}</div><p>{legal}</p>")]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGE)
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert [got[n] for n in range(3)] == [words(f"own{n}x", 20) for n in range(3)]
    assert got[3] == words("loose", 20) and got[4] == words("own0x", 20) and got[5] == f"{menu} {legal}"


def test_boilerplate_in_articles(spark):
    """A block in the articles of most pages of a host goes; what fewer pages or copies of one article share stays."""
    plea, shared = words("plea", 12), words("shared", 15)
    rows = [(n, "http://h.org/a", f"<article><p>{words(f'own{n}x', 20)}</p><div class='x1'>{plea}</div><p>end{n}</article>") for n in range(6)]
    rows += [(n, "http://h.org/a", f"<article><p>{words(f'own{n}x', 20)}</p><p>{shared}</p></article>") for n in range(6, 9)]
    rows += [(n, "http://copies.org/a", f"<article><p>{words('copy', 20)}</p><p>{shared}</p></article>") for n in range(9, 19)]
    rows += [(n, "http://few.org/a", f"<article><p>{words(f'few{n}x', 20)}</p><p>{plea}</p></article>") for n in range(19, 23)]
    rows += [(23, "http://h.org/plea", f"<main>{plea}</main>"), (23, "http://h.org/plea", f"<main>{plea} and more</main>"), (None, "http://h.org/c", None)]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGE)
    got = {(r.page_id, r.text) for r in main_text(pages).collect()}
    want = {(n, f"{words(f'own{n}x', 20)} end{n}") for n in range(6)} | {(n, f"{words(f'own{n}x', 20)} {shared}") for n in range(6, 9)}
    want |= {(n, f"{words('copy', 20)} {shared}") for n in range(9, 19)} | {(n, f"{words(f'few{n}x', 20)} {plea}") for n in range(19, 23)}
    assert got == want | {(23, plea), (23, f"{plea} and more"), (None, "")}
    assert zones("<nav>a<p>b</nav><article>c<aside>d</aside>e</article>f") == (["c", "e"], ["f"], ["a", "b", "d"])


def test_versions_of_an_article(spark):
    """Blocks that are most of an article stay, however many versions of it a host has."""
    want = {n: f"{words('long', 30)} version{n} {words('end', 15)}" for n in range(7)}
    rows = [(n, "http://v.org/a", f"<main><p>{words('long', 30)}</p><p>version{n}</p><p>{words('end', 15)}</p></main>", "x", "y", "z") for n in want]
    assert {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGE)).collect()} == want


def test_repeated_strings_by_brute_force(spark):
    """Every string of ten tokens that another page of the host has is found, whatever its context, from 8 bytes for each token that is kept."""
    draw = random.Random(3)
    shared = [[f"s{n}x{i}" for i in range(draw.randrange(9, 16))] for n in range(4)] + [["again"] * 60]
    rows = []
    for n in range(40):
        parts = [f"<p>{' '.join(draw.choice(shared))} {words(f'own{n}x{k}x', draw.randrange(12))}</p>" for k in range(6)]
        body = "".join(parts[:3]) if n % 3 else f"<main>{''.join(parts[:3])}</main>"
        rows.append((n, f"http://h{n % 2}.org/", body + f"<nav>{''.join(parts[3:])}</nav>", "x", "y", "z"))
    pages = named_pages(spark.createDataFrame(rows + rows[:2], PAGE), "page_id", "url", "html").localCheckpoint()
    seen: dict[tuple, set] = {}
    held = {}
    for r in pages.collect():
        held[r.page] = zones(r.html)
        for n, zone in enumerate(held[r.page]):
            tokens = " ".join(zone).split()
            for at in range(len(tokens) - 9):
                seen.setdefault((r.host, n == 0, *tokens[at:at + 10]), set()).add(r.page)
    want = {}
    for r in pages.collect():
        cover = []
        for n, zone in enumerate(held[r.page][:2]):
            tokens = " ".join(zone).split()
            found = [len(seen[r.host, n == 0, *tokens[at:at + 10]]) > 1 for at in range(len(tokens) - 9)]
            cover.append([any(found[max(0, t - 9):t + 1]) for t in range(len(tokens))])
        at, whole = 0, []
        for n, block in enumerate(held[r.page][0]):
            size = len(block.split())
            whole += [n] * all(cover[0][at:at + size])
            at += size
        gone = [] if held[r.page][0] else [t for t, c in enumerate(cover[1]) if c]
        if gone or whole:
            want[r.page] = (gone, whole)
    assert len(want) > 20
    for hot in (10_000, 2):
        made = parsed(pages, hot).localCheckpoint()
        assert all(len(r.stream) % 8 == 0 and len(r.stream) <= 8 * sum(len(b.split()) + 1 for zone in held[r.page] for b in zone) for r in made.collect())
        assert {r.page: (r.gone, [b.n for b in r.blocks]) for r in repeated_parts(made).collect() if r.gone or r.blocks} == want
        several = repeated_strings(made, block=50).collect()
        assert {(r.page, t) for r in several for t in range(r.a, r.b)} == {(r.page, t) for r in repeated_strings(made).collect() for t in range(r.a, r.b)}


def test_two_pages_of_each_host(spark):
    """A menu goes from both of the only two pages that have it, however their numbers are ordered."""
    rows = [(2 * n + k, f"http://h{n}.org/", f"<div>{words(f'menu{n}x', 60)}</div><p>{words(f'own{n}x{k}x', 12)}</p>", "x", "y", "z") for n in range(20) for k in range(2)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {2 * n + k: words(f"own{n}x{k}x", 12) for n in range(20) for k in range(2)}


def test_hashes_of_tokens():
    """Equal tokens have equal hashes wherever they stand in a text, others don't."""
    text = " ".join(["one", "two", "語", "eno", "one", "x" * 3_000_000, *(f"w{i}" for i in range(300_000)), "one", "\0one", "on"])
    got = token_hashes(text.encode()).tolist()
    assert len(set(got)) == len(set(text.split(" "))) and got[0] == got[4] == got[-3]
    assert len(token_hashes(b"")) == 0 and token_hashes(b"one").tolist() == got[:1]
