"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node is the path of presentation
styles (tag, class, id, role) from the body down, and under it are counted the pages that have
it, the different sequences of child styles, and the different contents. A node's
presentation importance is the entropy of its child sequences over its pages, its
content importance the entropy of its contents, both to the base of the page count,
so that a branch which most pages share scores near 0 and one that is new on every page near 1. Branches of low composite
importance are removed from each page.

Importance has a prior: presentation styles that say what they are (article, main;
navigation, header, footer, aside, form, notice, advert, comment and the like) keep or
remove a branch by themselves, so that a host with few pages is treated as one with
many. A page's outermost articles and main elements outside such branches are its main
text; a page without any gives its body. Branches within main text are judged too: for them the
prior is a term of the importance, so that only those go which hardly ever change, and pages of a host
with the same main text count once, so that copies of an article don't make it unimportant.

Spark counts (host, node, feature) with partial aggregation, so a host with a third
of the pages has no task of its own. A branch must be on a few pages of its host, whatever
the host's size. The low branches go to the pages by broadcast up to a checked size; beyond, each page's own
nodes are joined with them, so that no list grows with its host.

Null and empty pages give an empty text, null URLs form a host of their own, broken
markup is read as browsers do in common cases, repeated rows are treated alike and
extra columns are ignored. Pages may be of any length and depth: nothing recurses, and time is linear.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_unquoted = re.compile(r"""[^>"']*""")
#: Each step takes a whole name, so that the time stays linear.
_attribute = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select object audio video canvas".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "body", "html"}
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
#: An opening tag ends an open element of these, up to the given scope.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROP_TAGS = frozenset("nav footer aside form button input head menu dialog".split()) | RAW
KEEP_TAGS = frozenset(("article", "main"))
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class and id values that name what is not main text.
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footers masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond replies related recommended widget widgets pagination pager search searchbox toolbar skip copyright disclaimer outbrain taboola".split())
#: In a name with one of these, another word says what lies around the element, not what it is.
WRAPPER_WORDS = frozenset("with has have no without enabled content main page wrapper layout body article post text entry".split())
HEADER_WORDS = frozenset("header site-header page-header topbar".split())
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+").findall


class Node:
    __slots__ = ("tag", "style", "parts", "kids", "prior")

    def __init__(self, tag: str, style: str, prior: int) -> None:
        self.tag, self.style, self.prior = tag, style, prior
        self.parts: list = []  # texts, nodes, None for a break of words
        self.kids: list[Node] = []


def presentation(tag: str, raw: str, inside_main: bool) -> tuple[str, int]:
    """Style of an element, and its prior: 1 main text, -1 not, 0 unknown."""
    if not raw or raw.isspace():
        style, words, role, hidden = tag, set(), "", False
    else:
        found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _attribute.findall(raw) if m[1] or m[2] or m[3]}
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        names_lower = {n.lower() for n in names}
        role = found.get("role", "").strip().lower()
        parts = [{w.lower() for w in _name_words(n)} for n in names]
        words = set().union(*[p for p in parts if not p & WRAPPER_WORDS]) | names_lower if tag not in KEEP_TAGS else names_lower
        hidden = "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw) is not None
        style = ".".join([tag, *sorted({re.sub(r"\d{2,}", "0", n) for n in names})]) + (f"[{role}]" if role else "")
    if tag in KEEP_TAGS and not words & DROP_WORDS or role == "main":
        return style, 1
    if tag in DROP_TAGS or role in DROP_ROLES or hidden or tag not in ("body", "html", "article", "main") and words & DROP_WORDS:
        return style, -1
    if tag in KEEP_TAGS or not inside_main and (tag == "header" or words & HEADER_WORDS) and tag not in ("body", "html"):
        return style, -1
    return style, 0


def tag_end(page: str, at: int, known: dict[int, int]) -> int:
    """Where the > of a tag is: the first outside quotes or, if quotes don't close, the next; -1 for none.

    known: by the place of an opening quote where the scan from there ends, -1 for nowhere, so that each quote of a page is passed once.
    """
    place, end, passed = at, -1, []
    while True:
        place = _unquoted.match(page, place).end()
        if place == len(page):
            break
        if page[place] == ">":
            end = place
            break
        if place in known:
            end = known[place]
            break
        passed.append(place)
        place = page.find(page[place], place + 1) + 1
        if not place:
            break
    known.update(dict.fromkeys(passed, end))
    return end if end >= 0 else page.find(">", at)


def tree(page: str) -> Node:
    """The elements of a page; unclosed and misnested ones are mended. Time grows with the page's length alone, however deep it is."""
    root = Node("html", "html", 0)
    stack, at, end = [root], 0, len(page)
    last = page.rfind(">")
    main = 0  # elements with prior 1 on the stack
    opened: dict[str, int] = {}  # elements on the stack by tag
    known: dict[int, int] = {}

    def close(i: int) -> int:
        lost = 0
        for x in stack[i:]:
            opened[x.tag] -= 1
            lost += x.prior == 1
        del stack[i:]
        return lost

    while at < end:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            stack[-1].parts.append(page[at:])
            break
        if page.startswith("<!--", begin):
            stack[-1].parts.append(page[at:begin])
            at = page.find("-->", begin + 4) + 3
            if at < 3:
                break
            continue
        if page[begin + 1] in "!?":
            stack[-1].parts.append(page[at:begin])
            at = page.find(">", begin) + 1
            continue
        m = _tag.match(page, begin)
        if not m:  # a sign of its own
            stack[-1].parts.append(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            stack[-1].parts.append(page[at:begin])
        at = tag_end(page, m.end(), known) + 1
        closing, tag, raw = m[1], m[2].lower(), page[m.end() : at - 1]
        if closing:
            if tag in ("body", "html") or not opened.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    main -= close(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:  # a stray inline end tag
                    break
            continue
        if tag == "html":
            continue
        if tag == "body" and opened.get("body"):
            continue
        if tag == "body" or stack[-1].tag == "head" and tag not in HEAD_TAGS:
            main -= close(1)
        ends = {"p"} if tag in CLOSES_P else set()
        scope: set[str] = {"article", "section", "div", "td", "th", "li", "blockquote", "main", "body", "table", "button"} if ends else set()
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag][0] | ends, IMPLIED[tag][1]
        if any(map(opened.get, ends)):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    main -= close(i)
                    break
                if stack[i].tag in scope:
                    break
        style, prior = presentation(tag, raw, main > 0)
        node = Node(tag, style, prior)
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            after = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = after.end() if after else end
            continue
        if raw.endswith("/") and tag not in BLOCKS:
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        main += prior == 1
    return root


def top(root: Node) -> Node:
    return next((k for k in root.kids if k.tag == "body"), root)


def content(node: Node) -> list:
    """The node's own words, with those of inline elements below it."""
    out: list[str] = []
    stack = [iter(node.parts)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                out.append(x)
            elif x.tag == "br":
                out.append(" ")
            elif x.tag not in BLOCKS and x.prior >= 0:
                stack.append(iter(x.parts))
                break
        else:
            stack.pop()
    return out


class Visit:
    """A node on the way down: what has been gathered of it so far."""

    __slots__ = ("at", "inside", "kids", "main", "node", "shape", "words")

    def __init__(self, node: Node, path: int, inside: bool, said: list[str]) -> None:
        self.node, self.inside, self.kids, self.shape = node, inside, iter(node.kids), 0
        self.at = zlib.crc32(node.style.encode(), path)
        own = " ".join("".join(content(node)).split())
        self.words = zlib.crc32(own.encode("utf-8", "replace"))
        self.main = False  # a branch around main text is no candidate
        if inside:
            said.append(own)


def branches(page: str) -> list[tuple[int, bool, int, int, int]]:
    """(node, within main text, main text, child sequence, content) of the unlabelled branches, once for each node.

    The main text is a hash of all the page's, for nodes outside 0.
    """
    seen: dict[int, tuple[bool, int, int]] = {}
    said: list[str] = []
    way = [Visit(top(tree(page)), 0, False, said)]
    while way:
        v = way[-1]
        for k in v.kids:
            if k.prior == 1 or k.tag in BLOCKS and k.prior == 0:
                way.append(Visit(k, v.at, v.inside or k.prior == 1, said))
                break
            v.shape = zlib.crc32(k.style.encode(), v.shape)
        else:
            way.pop()
            if not v.main and v.node.prior != 1:
                if v.at in seen:  # a further one with the same style
                    _, shape, words = seen[v.at]
                    v.shape, v.words = zlib.crc32(v.shape.to_bytes(4, "little"), shape), zlib.crc32(v.words.to_bytes(4, "little"), words)
                seen[v.at] = v.inside, v.shape, v.words
            if way:
                over = way[-1]
                if v.node.prior == 1:
                    over.main = True
                else:
                    over.words = zlib.crc32(v.words.to_bytes(4, "little"), over.words)
                    over.main |= v.main
                over.shape = zlib.crc32(v.node.style.encode(), over.shape)
    text = int.from_bytes(hashlib.blake2b("\n".join(said).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
    return [(at, inside, text if inside else 0, shape, words) for at, (inside, shape, words) in seen.items()]


def mains(body: Node, start: int, low: frozenset[int]) -> list[tuple[Node, int]]:
    """The outermost elements of main text in page order, with their paths."""
    found = []
    way = [(iter(body.kids), start)]
    while way:
        kids, path = way[-1]
        for k in kids:
            at = zlib.crc32(k.style.encode(), path)
            if k.prior == 1:
                found.append((k, at))
            elif k.prior == 0 and at not in low:
                way.append((iter(k.kids), at))
                break
        else:
            way.pop()
    return found


def extract(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """Main text of a page, without branches of a prior against them and those in low."""
    if not page:
        return ""
    body = top(tree(page))
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(words)).split()):
            blocks.append(text)
        words.clear()

    start = zlib.crc32(body.style.encode(), 0)
    for node, at in mains(body, start, low) or [(body, start)]:
        way = [(iter(node.parts), at, True)]
        while way:
            parts, path, block = way[-1]
            for x in parts:
                if isinstance(x, str):
                    words.append(x)
                elif x.tag in ("br", "wbr"):
                    words.append(" " if x.tag == "br" else "")
                else:
                    below = zlib.crc32(x.style.encode(), path)
                    if x.tag in BLOCKS:
                        flush()
                    if x.prior >= 0 and not (x.prior == 0 and below in low):
                        way.append((iter(x.parts), below, x.tag in BLOCKS))
                        break
            else:
                way.pop()
                if block:
                    flush()
    return "\n\n".join(blocks)


def page_nodes(pages: DataFrame) -> DataFrame:
    """host, page, node and what branches() says of it, for each page. pages: host, html; page is the html's hash."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, n, *x) for h, n, page in zip(b["host"], b["page"], b["html"], strict=True) if page for x in branches(page)]
            yield pd.DataFrame(rows, columns=["host", "page", "node", "inside", "main", "shape", "words"])

    return pages.select("host", F.xxhash64("html").alias("page"), "html").mapInPandas(nodes, "host string, page long, node long, inside boolean, main long, shape long, words long")


def low_branches(found: DataFrame, least_pages: int = 4, threshold: float = 0.35, content_weight: float = 0.7, prior_weight: float = 0.25) -> DataFrame:
    """host, node: what to remove. found: rows of page_nodes.

    A node must be on least_pages pages of its host. Within main text pages are the different main texts, and the prior
    (1 there, else 0) has prior_weight in the importance.
    """
    alike = found.groupBy("host", "node", "inside", "main", "shape", "words").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("n", F.when(F.col("inside"), F.lit(1)).otherwise(F.col("n")))

    def entropy(feature: str) -> DataFrame:
        n = alike.groupBy("host", "node", "inside", feature).agg(F.sum("n").alias("n"))
        own = n.groupBy("host", "node", "inside").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
        # entropy to the base of the page count: ln m - sum(n ln n) / m, over ln m
        return own.select("host", "node", "inside", "pages", (1 - F.col("s") / (F.col("pages") * F.log(F.greatest(F.col("pages"), F.lit(2))))).alias(feature))

    both = entropy("shape").join(entropy("words").drop("pages"), ["host", "node", "inside"])
    news = (1 - content_weight) * F.col("shape") + content_weight * F.col("words")
    importance = news + prior_weight * (1 - news) * F.col("inside").cast("int")
    return both.filter((F.col("pages") >= least_pages) & (importance < threshold)).select("host", "node").distinct()


def main_text(pages: DataFrame, broadcast_hosts: int = 20_000, broadcast_nodes: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1)), F.lit(""))
    rows = common.plain(pages, "page_id", "url", "html").withColumn("host", host)
    found = common.materialise(page_nodes(rows), "style-nodes")
    low = common.materialise(low_branches(found), "low-branches")
    n = low.agg(F.count_distinct("host").alias("hosts"), F.count(F.lit(1)).alias("nodes")).first()
    if n["hosts"] <= broadcast_hosts and n["nodes"] <= broadcast_nodes:
        lists: dict[str, set[int]] = {}
        for r in low.collect():
            lists.setdefault(r["host"], set()).add(r["node"])
        held = spark.sparkContext.broadcast({h: frozenset(x) for h, x in lists.items()})

        @F.pandas_udf("string")
        def text_of(page: pd.Series, hosts: pd.Series) -> pd.Series:
            return pd.Series([extract(p, held.value.get(h, frozenset())) for p, h in zip(page, hosts, strict=True)], dtype=object)

        text = text_of("html", "host")
    else:
        # pages whose hashes are equal share a list, which holds low nodes of their host only
        own = found.select("host", "page", "node").distinct().join(low, ["host", "node"]).groupBy("host", "page").agg(F.collect_list("node").alias("low"))
        rows = rows.withColumn("page", F.xxhash64("html")).join(common.materialise(own, "page-branches"), ["host", "page"], "left")

        @F.pandas_udf("string")
        def text_of(page: pd.Series, nodes: pd.Series) -> pd.Series:
            return pd.Series([extract(p, frozenset() if x is None else frozenset(np.asarray(x).tolist())) for p, x in zip(page, nodes, strict=True)], dtype=object)

        text = text_of("html", "low")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
