"""Main text of web pages by a site style tree.

Method.  The element trees of all pages of a host are merged: an element's place is its path of block elements with
their class, id and role, and each run of text in an element is a content node below it.  Over the m pages that have a
place, a content node's features are its texts and an element's features are its presentations (the sequence of its
children).  A feature that c of the m pages have has entropy log c / log m, so text that every page repeats has entropy
one and a page's own text zero; a content node's importance is one minus the mean entropy of its texts.  An element's is
composed from its children upward: the mean of its children's, weighed by their words, raised by the entropy of its
presentations.  A host of few pages borrows from the tree of all hosts: its own figure counts m / (m + borrow).
Branches of less than `least` are removed from each page, with all that hangs below them, unless the branch holds most
of the site's information (words times importance); then its parts are judged one by one.

Marks.  A branch whose tag, class, id or role says that it is no content (menu, advert, form, ...) is marked, and what
hangs below it has the mark.  A mark is a prior that the tree overrules: an article or main element below starts anew; and
a page that would have next to no text without a marked branch votes for it.  A place with the votes of half of its pages,
and of enough importance, is a main body of its site and keeps its text on all of them.

Scale.  Each page is parsed once into a table in the shared folder; counts are sums by (host, place, feature), with equal
pages of a host counted once.  Importance climbs the tree by pointer jumping, so the rounds grow with the logarithm of
the depth, and no host is gathered in one task.  Only the places to be removed go back to the pages, one list a host,
broadcast up to a checked number of places and joined by host beyond it."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop, materialise, pieces_of, spread
from quire.llm.url_filter import host_of


@dataclass(frozen=True)
class TreeParams:
    presentation: float = 0.2  # weight of presentations in an element's importance
    borrow: int = 20  # pages that the tree of all hosts counts as
    least: float = 0.3
    most: float = 0.5  # share of a site's information from which a branch isn't removed as a whole
    marks: bool = True
    rest: float = 0.25  # unmarked words of a page, as a share of the marked branch's, below which it votes for the branch
    strong_words: int = 50  # words that a branch with a strong mark must have for that
    broadcast_places: int = 100_000


#: Tags by their part in a page, and the words by which an element says that it is no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br input ruby rt rp".split())
MARK_TAGS = frozenset("nav footer aside form dialog menu".split())
STRONG_TAGS = MARK_TAGS - {"form"}
NO_TEXT = frozenset("button select option svg canvas object audio video map math".split())
HEAD_TAGS = frozenset("base link meta title script style noscript template".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard sponsor sponsored promo promotion nav navigation navbar menu menubar breadcrumb breadcrumbs header masthead topbar "
    "footer foot sidebar side aside rail widget widgets cookie cookies consent gdpr notice notices alert popup overlay modal newsletter subscribe subscription signup signin login register share sharing social "
    "related recommended recommendations pagination pager comment comments commentlist reply replies respond disqus discussion form search copyright legal disclaimer toolbar skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
ARTICLE_WORDS = frozenset("article story hentry post entry main".split())
WITHOUT = frozenset("has no with without".split())  # has-sidebar says that there is one elsewhere
TITLE_WORDS = frozenset("header masthead".split())  # of an article, these hold its title
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th")}
SCOPES = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "option": frozenset(("select",)), "tbody": frozenset(("table",)), "thead": frozenset(("table",))}

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_MARKS = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z]+")
NONE, WEAK, STRONG = 0, 1, 2


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)))


class _Open:
    """An open element."""

    __slots__ = ("tag", "place", "group", "hard", "article", "block", "link", "outer", "children", "words", "mark")

    def __init__(self, tag: str, place: int, group: int, hard: bool, article: bool, block: bool, link: bool, outer: "_Open | None", mark: int = NONE):
        self.tag, self.place, self.group, self.hard, self.article, self.block, self.link, self.outer, self.mark = tag, place, group, hard, article, block, link, outer, mark
        self.children: list[str] = []
        self.words = 0


_marks_cache: dict[str, tuple[str, int, int, bool]] = {}


def _marks(attributes: str) -> tuple[str, int, int, bool]:
    """What class, id and role say: a key for the place, the mark, the mark inside an article, and whether it is the article."""
    found = _marks_cache.get(attributes)
    if found is None:
        key, mark, inside, article = [], NONE, NONE, False
        for name, a, b, c in _MARKS.findall(attributes):
            value, role = a or b or c, name.lower() == "role"
            key.append(f"{name.lower()}={value}")
            for token in value.split():
                words = _SPLIT.split(_HUMP.sub(" ", token).lower())
                own = set(words)
                if own & WITHOUT:
                    continue
                if role:
                    says = STRONG if own & NOISE_ROLES else NONE
                    mark, inside, article = max(mark, says), max(inside, says), article or bool(own & {"main", "article"})
                    continue
                says = NONE if not own & NOISE_WORDS else STRONG if own <= COMMENT_WORDS else WEAK
                mark = max(mark, says)
                inside = max(inside, says if own & (NOISE_WORDS - TITLE_WORDS) else NONE)
                article |= own <= ARTICLE_WORDS
        if article and mark < STRONG:
            mark = inside = NONE
        if len(_marks_cache) > 50_000:
            _marks_cache.clear()
        found = _marks_cache[attributes] = ("|".join(sorted(key)), mark, inside, article)
    return found


Text = tuple[int, int, str]
Node = tuple[int, int, int, int, int, int, int, int]


def parse(page: str | None, p: TreeParams = TreeParams()) -> tuple[list[Text], list[Node], int]:
    """Texts (place, marked place above or 0, text) in page order, the page's features for the tree (place, parent, kind,
    feature, words, marked place above or 0, own mark, depth), kind 0 once a place, 1 for each presentation, 2 for each text,
    and the marked place that the page votes for, or 0.  Words in links don't count."""
    texts: list[Text] = []
    kinds: dict[tuple[int, int, int], list] = {}
    if not page:
        return texts, [], 0
    stack = [_Open("", 0, 0, False, False, True, False, None)]
    parts: list[str] = []
    opened: Counter = Counter()
    holder = stack[0]  # the innermost open block element
    linked = 0  # words in links since the last flush

    def note(place: int, parent: int, kind: int, feature: int, words: int, group: int, mark: int, depth: int) -> None:
        found = kinds.get((place, kind, feature))
        if found is None:
            kinds[place, kind, feature] = [parent, words, group, mark, depth]
        else:
            found[1] += words

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = _html.unescape(text)
            split = text.split()
            if split and not holder.hard:
                text, words = " ".join(split), max(0, len(split) - linked)
                place = _hash(holder.place, "#text")
                texts.append((place, holder.group, text))
                holder.children.append("#text")
                holder.words += words
                note(place, holder.place, 0, 0, words, holder.group, NONE, len(stack))
                note(place, holder.place, 2, _hash(text), words, holder.group, NONE, len(stack))
            linked = 0

    def close(depth: int) -> None:
        nonlocal holder
        while len(stack) > depth:
            top = stack[-1]
            if top.block:
                flush()
            stack.pop()
            opened[top.tag] -= 1
            stack[-1].words += top.words
            if top.block:
                holder = top.outer
                if not top.hard:
                    shape = _hash(*(c for i, c in enumerate(top.children) if not i or top.children[i - 1] != c))
                    note(top.place, holder.place, 0, 0, top.words, top.group, top.mark, len(stack))
                    note(top.place, holder.place, 1, shape, top.words, top.group, top.mark, len(stack))

    def leave_head() -> None:
        if opened["head"]:
            close(next(i for i, x in enumerate(stack) if x.tag == "head"))

    at, end, last = 0, len(page), page.rfind(">")
    search = _TOKEN.search
    while at < end:
        m = search(page, at) if at <= last else None
        start = m.start() if m else page.find("<!--", at) if "<!--" in page[at:] else end  # a comment may be open at the end
        if start > at:
            piece = page[at:start]
            if opened["head"] and not piece.isspace():
                leave_head()
            if not stack[-1].hard:
                parts.append(piece)
                if stack[-1].link:
                    linked += len(piece.split())
        if not m:
            break
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if opened[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
            elif tag == "p":
                flush()
            continue
        if tag not in HEAD_TAGS and tag not in ("html", "head"):
            leave_head()
        if tag in CLOSES_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in ("td", "th", "button", "table"):
                    break
        if tag in SAME_LEVEL and any(opened[x] for x in SAME_LEVEL[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SCOPES[tag]:
                    break
                if stack[depth].tag in SAME_LEVEL[tag]:
                    close(depth)
                    if tag not in ("tr", "tbody", "thead"):
                        break
        if tag in ("br", "hr"):
            parts.append(" ")
            if tag == "hr":
                flush()
        if tag in VOID:
            continue
        if tag in RAW:
            close_at = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = close_at.end() if close_at else end
            continue
        up = stack[-1]
        key, mark, inside, main = _marks(attributes) if "=" in attributes else ("", NONE, NONE, False)
        main |= tag in ("article", "main")
        if up.article:
            mark = inside
        if tag in ("html", "body") or (tag in ("article", "main") and mark < STRONG):
            mark = NONE
        elif tag in MARK_TAGS or (tag == "header" and not up.article):
            mark = max(mark, STRONG if tag in STRONG_TAGS else WEAK)
        block = tag not in INLINE or mark > NONE
        place = _hash(up.place, tag, key) if block else up.place
        group, article = up.group, up.article
        if mark:
            group = place
        elif main and (not up.group or not _within_strong(stack)):
            group, article = 0, True
        if block:
            flush()
            holder.children.append(tag)
        elem = _Open(tag, place, group, up.hard or tag in NO_TEXT, article, block, up.link or tag == "a", holder if block else None, mark)
        stack.append(elem)
        opened[tag] += 1
        if block:
            holder = elem
        if attributes.endswith("/") and tag not in ("a", "p", "div", "span", "li"):
            close(len(stack) - 1)
    close(1)
    flush()
    nodes = [(place, parent, kind, feature, words, group, mark, depth) for (place, kind, feature), (parent, words, group, mark, depth) in kinds.items()]
    return texts, nodes, _vote(nodes, p)


def _vote(nodes: list[Node], p: TreeParams) -> int:
    """The outermost of the page's marked branches that hold most words (then the one with more words, then the larger
    place), if there are next to no words beside them."""
    words: Counter = Counter()
    for _, _, kind, _, n, group, _, _ in nodes:
        if kind == 2:
            words[group] += n
    able = [(depth, words[place], place) for place, _, kind, _, _, _, mark, depth in nodes if kind == 0 and mark and words[place] >= (p.strong_words if mark == STRONG else 1)]
    top = max((w for _, w, _ in able), default=0)
    if words[0] >= p.rest * top:
        return 0
    return max((-d, w, x) for d, w, x in able if w >= p.rest * top)[2]


def _within_strong(stack: list[_Open]) -> bool:
    """Whether the marked branch that is open has a strong mark."""
    return next((x.mark == STRONG for x in reversed(stack) if x.mark), False)


_NODE = "struct<place: long, parent: long, kind: int, feature: long, words: long, marked: long, mark: int, depth: int>"


def _parsed(pages: DataFrame, p: TreeParams) -> DataFrame:
    """From pages(keep, host, html): keep, host, page (a hash of html), vote, texts and nodes of each row, written once."""
    kind = pages.schema["keep"].dataType.simpleString()
    text_type = pa.list_(pa.struct([("place", pa.int64()), ("marked", pa.int64()), ("text", pa.string())]))
    names = ["place", "parent", "kind", "feature", "words", "marked", "mark", "depth"]
    node_type = pa.struct([(n, pa.int32() if n in ("kind", "mark", "depth") else pa.int64()) for n in names])
    signed = lambda x: np.array(x, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, 256):
            texts, nodes, sizes, votes = [], [], [], []
            for page in b.column(2).to_pylist():
                t, n, vote = parse(page, p)
                votes.append(vote)
                texts.append([{"place": i - (1 << 64) if i >> 63 else i, "marked": g - (1 << 64) if g >> 63 else g, "text": x} for i, g, x in t])
                nodes += n
                sizes.append(len(n))
            columns = list(zip(*nodes, strict=True)) or [()] * 8
            arrays = [pa.array(np.array(c, np.int32)) if n in ("kind", "mark", "depth") else pa.array(signed(c)) for n, c in zip(names, columns, strict=True)]
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, fields=list(node_type)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(signed(votes)), pa.array(texts, text_type), lists], ["keep", "host", "page", "vote", "texts", "nodes"])

    rows = spread(pages.select("keep", "host", "html", F.xxhash64("html").alias("page")))
    out = rows.mapInArrow(run, f"keep {kind}, host string, page long, vote long, texts array<struct<place: long, marked: long, text: string>>, nodes array<{_NODE}>")
    return materialise(out, "parsed")


def _features(parsed: DataFrame, p: TreeParams) -> DataFrame:
    """host (null: all hosts), place, kind (3: votes), feature: c pages that have it, and what hangs on the place. Equal pages
    of a host count as one."""
    copies = materialise(parsed.groupBy("host", "page").count().where("count > 1"), "copies")
    few = copies.limit(p.broadcast_places + 1).count() <= p.broadcast_places
    vote = F.array(F.struct(F.col("vote").alias("place"), *[F.lit(x).cast(k).alias(n) for n, x, k in (("parent", None, "long"), ("kind", 3, "int"), ("feature", 0, "long"), ("words", 0, "long"), ("marked", None, "long"), ("mark", None, "int"), ("depth", None, "int"))]))
    rows = parsed.select("host", "page", F.when(F.col("vote") != 0, F.concat("nodes", vote)).otherwise(F.col("nodes")).alias("nodes")).join(F.broadcast(copies) if few else copies, ["host", "page"], "left")
    rows = rows.select("host", (1 / F.coalesce("count", F.lit(1))).alias("w"), F.explode("nodes").alias("n"))
    same = ["parent", "marked", "mark", "depth"]  # these follow from the place
    own = rows.groupBy("host", "n.place", "n.kind", "n.feature").agg(F.sum("w").alias("c"), F.sum(F.col("n.words") * F.col("w")).alias("words"), *[F.max(f"n.{x}").alias(x) for x in same])
    own = materialise(own, "features")
    every = own.groupBy("place", "kind", "feature").agg(F.sum("c").alias("c"), F.sum("words").alias("words"), *[F.max(x).alias(x) for x in same])
    return own.unionByName(every.withColumn("host", F.lit(None).cast("string")))


def _tree(features: DataFrame, p: TreeParams) -> DataFrame:
    """host, place, parent, text (whether a content node), m, words, marked, mark, depth, votes, own: a content node's importance,
    and the part of an element's that its presentations give."""
    spread = F.col("c") * F.ln("c")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(F.lit(0.0)))
    stats = features.groupBy("host", "place").agg(
        *[F.max(x).alias(x) for x in ("parent", "marked", "mark", "depth")], of(0, F.col("c")).alias("m"), of(0, F.col("words")).alias("words"),
        of(1, F.col("c")).alias("shapes"), of(1, spread).alias("shape_spread"), of(2, F.col("c")).alias("texts"), of(2, spread).alias("text_spread"), of(3, F.col("c")).alias("votes"),
    )
    several = F.col("m") > 1.5  # m is a whole number, but summed from parts
    content = F.when(several, 1 - F.col("text_spread") / F.col("texts") / F.ln("m")).otherwise(1.0)
    style = F.when(several & (F.col("shapes") > 0), (F.ln("shapes") - F.col("shape_spread") / F.col("shapes")) / F.ln("m")).otherwise(F.when(several, 0.0).otherwise(1.0))
    text = F.col("texts") > 0
    own = F.when(text, content).otherwise(p.presentation * style)
    return stats.select("host", "place", "parent", text.alias("text"), "m", "words", "marked", "mark", "depth", "votes", F.least(F.lit(1.0), F.greatest(F.lit(0.0), own)).alias("own"))


def _climb(tree: DataFrame) -> DataFrame:
    """tree with importance (composed from the children upward) and information (words times importance of the texts below).

    x(E) = own(E) + (1 - own(E)) * sum of share(C) * x(C) over the children C is summed by pointer jumping: a node passes what
    it has gathered to the ancestor `up` it points to, times the product `f` of the factors on the way, and then points to
    the ancestor's ancestor."""
    on = lambda a, b: a["host"].eqNullSafe(b["host"])
    above = tree.select("host", F.col("place").alias("at"), F.col("own").alias("above"), F.col("words").alias("of"))
    f = F.when(F.col("of") > 0, F.col("words") / F.col("of")).otherwise(0.0) * (1 - F.col("above"))
    t = tree.join(above, on(tree, above) & (tree["parent"] == above["at"]), "left").select(tree["*"], F.when(F.col("at").isNotNull(), F.col("parent")).alias("up"), F.coalesce(f, F.lit(0.0)).alias("f"))
    t = materialise(t.withColumn("importance", F.col("own")).withColumn("information", F.when(F.col("text"), F.col("own") * F.col("words")).otherwise(0.0)), "climb")
    deepest = t.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):  # after k rounds, what lies up to 2 ** k - 1 levels below has come up
        sums = t.where("up is not null").groupBy(F.col("host").alias("h"), F.col("up").alias("p")).agg(F.sum(F.col("f") * F.col("importance")).alias("x"), F.sum("information").alias("y"))
        over = t.select(F.col("host").alias("oh"), F.col("place").alias("op"), F.col("up").alias("over"), F.col("f").alias("of"))
        t2 = t.join(sums, t["host"].eqNullSafe(sums["h"]) & (t["place"] == sums["p"]), "left").join(over, t["host"].eqNullSafe(over["oh"]) & (t["up"] == over["op"]), "left")
        was = t
        t = materialise(t2.select(*tree.columns, F.col("over").alias("up"), (F.col("f") * F.coalesce("of", F.lit(0.0))).alias("f"), (F.col("importance") + F.coalesce("x", F.lit(0.0))).alias("importance"), (F.col("information") + F.coalesce("y", F.lit(0.0))).alias("information")), "climb")
        drop(was)
    return t.drop("up", "f")


def removed_places(parsed: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """host, bodies, denied, places: the marked places that are main bodies, those that have votes and are none, and the places
    whose texts the host's tree removes.  All of them stand on two pages or more, so lists don't grow with unique ids."""
    p = params
    nodes = _climb(materialise(_tree(_features(parsed, p), p), "tree"))
    every = nodes.where("host is null").select("place", F.col("importance").alias("general"))
    own = nodes.where("host is not null")
    total = own.where("text and marked = 0").groupBy("host").agg(F.sum("information").alias("total"))
    weight = F.col("m") / (F.col("m") + p.borrow)
    figure = F.round(weight * F.col("importance") + (1 - weight) * F.col("general"), 9)
    judged = own.join(every, "place").join(total, "host", "left")
    low = (figure < p.least) & (F.col("text") | (F.col("information") < p.most * F.coalesce("total", F.lit(0.0))))
    body = (F.col("votes") > 0) & (F.col("m") > 1.5), (2 * F.col("votes") >= F.col("m")) & (figure >= p.least)
    t = judged.select("host", "place", F.col("parent").alias("up"), "text", low.alias("gone"), F.when(body[0], body[1]).alias("body"))
    t = materialise(t, "judged")
    of = lambda x: F.collect_list(F.when(x, F.col("place")))
    bodies = t.where("body is not null").groupBy("host").agg(of(F.col("body")).alias("bodies"), of(~F.col("body")).alias("denied"))
    t = t.drop("body")
    some = materialise(t.where("gone").select("host").distinct(), "hosts")  # only where something goes does it go down
    few = some.limit(p.broadcast_places + 1).count() <= p.broadcast_places
    t = t.join(F.broadcast(some) if few else some, "host", "left_semi")
    branches = not t.where("gone and not text").isEmpty()
    deepest = own.agg(F.max("depth")).first()[0] if branches else 0
    for _ in range(int(deepest or 0).bit_length()):
        over = t.select("host", F.col("place").alias("up"), F.col("up").alias("over"), F.col("gone").alias("above"))
        step = t.join(over, ["host", "up"], "left").select("host", "place", F.col("over").alias("up"), "text", (F.col("gone") | F.coalesce("above", F.lit(False))).alias("gone"))
        t = materialise(step, "judged")
    lists = t.where("gone and text").groupBy("host").agg(F.collect_list("place").alias("places"))
    return lists.join(bodies, "host", "full").select("host", "bodies", "denied", "places")


def _kept(p: TreeParams) -> Column:
    """The text of a parsed page with its host's lists."""
    among = lambda name, x: F.coalesce(F.array_contains(name, x), F.lit(False))
    free = lambda t: (t["marked"] == 0) | among("bodies", t["marked"]) | ((t["marked"] == F.col("vote")) & ~among("denied", t["marked"]))
    stays = lambda t: ~among("places", t["place"])
    keep = (lambda t: free(t) & stays(t)) if p.marks else stays
    return F.array_join(F.transform(F.filter("texts", keep), lambda t: t["text"]), " ")


def main_text(pages: DataFrame, params: TreeParams = TreeParams(), keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """`keep` columns and text: the main text of each page, blocks joined by one space.

    Null and empty pages and pages that hold nothing but noise have empty text; a page of a host (or of a null url, host
    empty) that no other page has is judged by the tree of all hosts; repeated rows stay, and equal pages of a host count as
    one in its tree; very long pages are parsed whole, in one pass; of a page's marked branches with equal claims its vote
    goes to the outermost, then to the one with more words, then to the larger place; an empty table gives an empty result;
    other columns don't matter."""
    parsed = _parsed(pages.select(F.struct(*keep).alias("keep"), host_of(F.col(url)).alias("host"), F.col(html).alias("html")), params)
    places = materialise(removed_places(parsed, params), "places")
    few = (places.agg(F.sum(sum(F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)) for x in ("bodies", "denied", "places")))).first()[0] or 0) <= params.broadcast_places
    rows = parsed.select("keep", "host", "vote", "texts").join(F.broadcast(places) if few else places, "host", "left")
    return rows.select("keep", _kept(params).alias("text")).select("keep.*", "text")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
