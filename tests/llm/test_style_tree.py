"""The site style tree against a plain one, with and without marks."""

import math
import random
from collections import Counter, defaultdict

import pytest

from quire.llm import html_text
from quire.llm.html_text import TreeParams, main_text, parse

SCHEMA = "page_id long, url string, html string"


def plain(rows, p):
    """{page_id: text} of (page_id, host, html) rows, by recursion over each host's tree."""
    parsed = {html: parse(html, p) for _, _, html in rows}
    trees = {}
    for host in {h for _, h, _ in rows} | {None}:
        pages = {(h, html) for _, h, html in rows if host is None or h == host}
        t = {k: defaultdict(Counter) for k in (1, 2)} | {"m": Counter(), "words": Counter(), "parent": {}, "marked": {}, "mark": {}, "children": defaultdict(set), "votes": Counter()}
        for _, html in pages:
            _, nodes, vote = parsed[html]
            t["votes"][vote] += 1
            for place, parent, kind, feature, words, marked, mark, _ in nodes:
                t["parent"][place], t["marked"][place], t["mark"][place] = parent, marked, mark
                t["children"][parent].add(place)
                if kind:
                    t[kind][place][feature] += 1
                else:
                    t["m"][place] += 1
                    t["words"][place] += words
        own = {}
        for place, m in t["m"].items():
            if t[2][place]:
                c = t[2][place].values()
                own[place] = 1 - sum(x * math.log(x) for x in c) / sum(c) / math.log(m) if m > 1 else 1.0
            else:
                c = t[1][place].values()
                own[place] = p.presentation * ((math.log(sum(c)) - sum(x * math.log(x) for x in c) / sum(c)) / math.log(m) if m > 1 else 1.0)

        def figures(place):
            parts = [(c, *figures(c)) for c in t["children"][place]]
            info = own[place] * t["words"][place] if t[2][place] else sum(i for _, _, i in parts)
            share = sum(t["words"][c] / t["words"][place] * x for c, x, _ in parts) if t["words"][place] else 0.0
            t["at"][place] = own[place] + (1 - own[place]) * share, info
            return t["at"][place]

        t["at"] = {}
        for top in [x for x in t["m"] if t["parent"][x] not in t["m"]]:
            figures(top)
        t["total"] = sum(i for x, (_, i) in t["at"].items() if t[2][x] and not t["marked"][x])
        trees[host] = t
    out = {}
    for page_id, host, html in rows:
        t, every = trees[host], trees[None]
        texts, _, vote = parsed[html]

        def figure(x):
            w = t["m"][x] / (t["m"][x] + p.borrow)
            return round(w * t["at"][x][0] + (1 - w) * every["at"][x][0], 9)

        def gone(x):
            while x in t["at"]:
                if figure(x) < p.least and (t[2][x] or t["at"][x][1] < p.most * t["total"]):
                    return True
                x = t["parent"][x]
            return False

        def free(g):
            if not g or not p.marks:
                return True
            if t["votes"][g] and t["m"][g] > 1:
                return 2 * t["votes"][g] >= t["m"][g] and figure(g) >= p.least
            return g == vote

        out[page_id] = " ".join(x for place, g, x in texts if free(g) and not gone(place))
    return out


def site(host, n, r):
    """Pages with a repeated sidebar of several parts, own articles, and menus that vary."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    side = "".join(f"<div class='b{k}'><p>{word()} {word()} every page says it</p></div>" for k in range(3))
    some = [" ".join(word() for _ in range(8)) for _ in range(4)]
    rows = []
    for i in range(n):
        extra = f"<p>{' '.join(word() for _ in range(2))}</p>" if i % 3 == 0 else ""
        own = "".join(f"<p>{' '.join(word() for _ in range(r.randint(3, 20)))}</p>" for _ in range(r.randint(1, 3)))
        menu = "".join(f"<li><a href='/'>{word()}</a></li>" for _ in range(3))
        rows.append((host, f"<body><nav><ul>{menu}</ul></nav><div id='left'>{side}{extra}</div><div id='text'><h1>{word()}</h1>{own}<p>{r.choice(some)}</p></div><div class='ad'>{word()} now</div></body>"))
    return rows


def corpus():
    r = random.Random(4)
    rows = site("a.com", 60, r) + site("b.com", 3, r) + site("c.com", 25, r)
    rows += [("c.com", rows[-1][1])] * 30
    rows += [("d.com", f"<form id='f'><div class='menu'>some menu text</div><p>{i} is the page of number {i * 7} in a form</p></form>") for i in range(9)]
    rows += [("e.com", x) for x in ("<p>just this", "", "<div><div><div><b>deep</b></div></div></div>", "<nav>only</nav>")]
    return [(i, h, x) for i, (h, x) in enumerate(rows)]


@pytest.mark.parametrize("p", [TreeParams(), TreeParams(marks=False), TreeParams(borrow=0, least=0.45, presentation=0.5), TreeParams(broadcast_places=0)], ids=["production", "no marks", "other figures", "shuffle joins"])
def test_equals_a_plain_tree(spark, p):
    rows = corpus()
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, h, x in rows], SCHEMA)
    got = {r["page_id"]: r["text"] for r in main_text(df, p).collect()}
    assert got == plain(rows, p)


def test_tree_alone_removes_whole_branches(spark):
    r = random.Random(6)
    rows = site("a.com", 80, r)
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(rows)], SCHEMA)
    got = {r["page_id"]: r["text"] for r in main_text(df, TreeParams(marks=False)).collect()}
    for i, (_, x) in enumerate(rows):
        text = [t for _, _, t in parse(x)[0]]
        assert "every page says it" not in got[i]
        # the left branch goes whole, with the few texts in it that no other page has; the body's own texts stay
        assert all(t in got[i] for t in text[text.index(next(t for t in text if " " not in t and t not in text[:3])) :])
        if i % 3 == 0:
            assert text[6] not in got[i]


WRAPPED = ["<div class='layout has-sidebar'><article><p>Text {} of it</article></div>", "<form id='aspnetForm'><p>The page text {}</p></form>", "<div class='post comments-open'><p>Hello text {}</p></div>", "<section class='legal-news'><p>News text {}</p></section>", "<html><head><title>x</title><body><main><p>No {} head end</main>"]


@pytest.mark.parametrize("hosts", [1, 5])
def test_wrapped_articles_stay(spark, hosts):
    rows = [(i, f"http://h{i % hosts}.com/{i}", WRAPPED[i % 5].format(i)) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(str(i) in got[i].split() for i in range(40))


def test_copies_of_a_page_are_one_page_of_its_site(spark):
    rows = [(i, "http://a.com/x", "<div class='top'>Same words on all</div><div><p>The one text of this site</p></div>") for i in range(300)]
    got = {r["text"] for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"Same words on all The one text of this site"}


def test_extreme_pages_end():
    for page in ("<div>" * 20000 + "x", "<b>" * 20000 + "x", "<div " * 50000, "<div '" * 20000 + ">", "<p>" * 20000, "</p>" * 20000, "<!" * 20000, "<li><ul>" * 5000):
        html_text.parse(page)
