"""Main text of web pages by site template removal.

Every page is parsed into a light element tree. Its element subtrees are hashed and counted per host in Spark,
those inside the article by themselves; what many pages of a host share is its template and is deleted (inside an
article: what at least half of them share). Elements that HTML or a role names as something else than text go too, and those whose
class names what no article has, such as comments. Other words of a class, such as related or legal, only break ties: an
element with one goes if many pages of its host have one like it, whatever it says there.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import pieces, written

#: A subtree is template if it stands on at least so many pages of a host, and on so many of a hundred of them.
LEAST_PAGES, LEAST_PERCENT = 5, 10
#: The share for subtrees inside an article, high enough to spare paragraphs that some pages repeat.
INSIDE_PERCENT = 50
#: What tells the digest of a subtree inside an article from one outside, and that of an element's tag and words; the mark of a host with LEAST_PAGES pages.
INSIDE, FRAME, COUNTED = 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 1

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S
)
ATTRIBUTES = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: Elements that never are text of an article.
DROPPED = frozenset("head script style noscript template iframe svg math canvas object audio video nav aside footer form button select textarea input dialog menu noframes xmp map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option legend".split())
#: What a start tag of the key ends, up to the nearest of the second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)), "option": (("option",), ("select", "datalist")),
}
#: Words of a class or id, and roles, that name what no article has.
NOISE = frozenset("nav navbar navigation menu menubar masthead topbar sidebar ad ads advert adverts advertisement advertising adslot sponsored cookie cookies consent gdpr newsletter comment comments commentlist disqus".split())
ROLES = frozenset("navigation menu menubar banner complementary contentinfo search form dialog alert alertdialog toolbar".split())
#: Words that break ties.
HINTS = frozenset(
    """footer bottom aside rail widget widgets banner sponsor promo promotion notice notices alert popup modal overlay subscribe subscription signup signin login form search share sharing social
    related recommended recommendations respond reply replies breadcrumb breadcrumbs crumbs pagination pager toolbar tags skip copyright legal contentinfo hidden paywall teaser trending""".split()
)
MAIN_WORDS = frozenset("article main post entry story content articlebody".split())


class Node:
    __slots__ = ("tag", "kids", "digest", "noise", "hint", "main")

    def __init__(self, tag: str, about: str = "") -> None:
        self.tag, self.kids, self.digest = tag, [], 0
        said: set[str] = set()
        noise = tag in DROPPED
        for m in ATTRIBUTES.finditer(about) if about else ():
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
                noise = True
            elif name != "aria-hidden":
                # Words of "main-nav", "mainNav" and "main_nav".
                said.update(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        self.main = tag in ("article", "main") or bool(said & MAIN_WORDS) and tag in ("div", "section", "td")
        self.noise = noise or bool(said & NOISE)
        if said & {"comment", "comments"}:
            self.main = False
        #: The digest of tag and words where one of them breaks ties.
        self.hint = 0
        if said & HINTS and not said & MAIN_WORDS or tag == "header":
            self.hint = xxhash.xxh3_64_intdigest("\0".join((tag, *sorted(said))).encode()) - (1 << 63) ^ FRAME


def parse(text: str) -> Node:
    root = Node("#root")
    stack, at, end = [root], 0, len(text)
    while at < end:
        m = TOKEN.search(text, at)
        if not m:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # An inline end tag doesn't reach out of its block.
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS:
            own, stop = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in own:
                    del stack[i:]
                    break
                if stack[i].tag in stop:
                    break
        about = m[3] or m[6] or ""
        node = Node(tag, about)
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            node.kids.append(text[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not about.rstrip().endswith("/") or tag in BLOCK:
            if tag not in VOID:
                stack.append(node)
    return root


def regions(root: Node) -> list[Node]:
    """The outermost elements that hold the article: article, then main, then what a class calls so, then all."""
    for kind in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.main):
        found: list[Node] = []
        todo = [root]
        while todo:
            n = todo.pop()
            if n.noise:
                continue
            if kind(n):
                found.append(n)
            else:
                todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))
        if found:
            return found
    return [root]


#: A page may nest its elements as deep as it likes; the walk over them is plain Python, which needs no C stack.
DEEP = 1_000_000


def hashed(root: Node, skip: set[int]) -> list[int]:
    """The digests of the elements below root by tags and words; those in skip (by id()) and what is in them are left out."""
    out: list[int] = []

    def visit(n: Node) -> int:
        parts = [n.tag]
        for k in n.kids:
            parts.append(" ".join(k.split()) if isinstance(k, str) else f"<{visit(k)}>" if id(k) not in skip else "")
        n.digest = xxhash.xxh3_64_intdigest("\0".join(parts).encode()) - (1 << 63)
        if n.tag in BLOCK and n is not root and n.tag not in ("html", "body"):
            out.append(n.digest)
        return n.digest

    visit(root)
    return out


def blocks(region: Node, template: frozenset[int], whole: bool) -> list[str]:
    """The blocks of a region without template subtrees. whole: the region is the page."""
    salt = 0 if whole else INSIDE
    counted = COUNTED in template
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    def gone(k: Node) -> bool:
        if k.noise or k.tag in BLOCK and k.digest ^ salt in template:
            return True
        if not k.hint or k.tag == "header" and not whole:
            return False
        # A page without an article, of a host without counts, has nothing else to go by.
        return k.hint in template if counted else whole and k.tag != "header"

    def visit(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                line.append(k)
            elif k.tag == "br":
                line.append(" ")
            elif gone(k):
                # What is cut out still parts the text before from the text after.
                if k.tag in BLOCK:
                    flush()
            elif k.tag in BLOCK:
                flush()
                visit(k)
                flush()
            else:
                visit(k)

    visit(region)
    flush()
    return out


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given the template digests of its host. A null or empty page has none; a very long or deep page is read whole, in time that grows with its length."""
    if not html:
        return ""
    sys.setrecursionlimit(DEEP)
    root = parse(html)
    found = regions(root)
    whole = found == [root]
    if template:
        for r in found:
            hashed(r, set())
    return "\n".join(b for r in found for b in blocks(r, template, whole))


def subtrees_of(html: str | None) -> tuple[list[int], list[int]]:
    """The digests of a page's elements outside its article, with those of hints anywhere, and of the elements inside, salted with INSIDE; both without repeats."""
    if not html:
        return [], []
    sys.setrecursionlimit(DEEP)
    root = parse(html)
    found = regions(root)
    inside = [] if found == [root] else [d for r in found for d in hashed(r, set())]
    outside = set(hashed(root, {id(r) for r in found if r is not root}))
    todo = [root]
    while todo:
        n = todo.pop()
        if n.hint:
            outside.add(n.hint)
        todo.extend(k for k in n.kids if isinstance(k, Node))
    return sorted(outside - {0, COUNTED}), sorted({d ^ INSIDE for d in inside} - {0, COUNTED})


def host_of(url):
    """The host of a url column, lower-cased; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, least: int = LEAST_PAGES, percent: int = LEAST_PERCENT) -> DataFrame:
    """(host, template array<long>): digests of the subtrees on at least `least` pages and percent of the host's pages.

    Those inside articles are salted with INSIDE and stand on INSIDE_PERCENT of the pages at least; a host with `least` pages has COUNTED, too. So the array is bounded,
    however many pages a host has: by 100 / percent times the subtrees of a page.
    """

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            hosts, rows = batch.column("host"), [subtrees_of(h) for h in batch.column("html").to_pylist()]
            # 0 counts the page itself.
            size = [len(a) + len(b) + 1 for a, b in rows]
            digests = pa.array([d for a, b in rows for d in (0, *a, *b)], pa.int64())
            inside = pa.array([x for a, b in rows for x in [False] * (len(a) + 1) + [True] * len(b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([hosts.take(pa.array(np.repeat(np.arange(len(rows)), size))), digests, inside], names=["host", "digest", "inside"])

    counted = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(subtrees, "host string, digest long, inside boolean").groupBy("host", "digest", "inside").agg(F.count("*").alias("n")).where(f"n >= {least} or digest = 0 and not inside")
    counted = written(counted, "subtrees", narrow=True)
    size = counted.where("digest = 0 and not inside").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    many = counted.where("digest <> 0").join(size, F.col("host") == F.col("h")).where(f"100 * n >= if(inside, {max(percent, INSIDE_PERCENT)}, {percent}) * pages")
    marks = size.where(F.col("pages") >= least).select(F.col("h").alias("host"), F.lit(COUNTED).cast("long").alias("digest"))
    return many.select("host", "digest").union(marks).groupBy("host").agg(F.collect_list("digest").alias("template"))


def extract(pages: DataFrame, least: int = LEAST_PAGES, percent: int = LEAST_PERCENT) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    text is the article's blocks, each with single spaces, in page order, joined by a line feed; empty for a null
    or empty html and for a page without an article's text. n_chars counts its code points. A null url has the
    empty host. Repeated rows count as pages of their own. Other columns are ignored.
    """
    found = written(templates(pages, least, percent), "templates").select(F.col("host").alias("h"), "template")
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(found, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "host", "template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, frozenset()
        for batch in pieces(batches, "html"):
            out = []
            template = batch.column("template")
            for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
                if host != last:
                    last, known = host, frozenset(template[i].as_py() or ())
                out.append(main_text(page, known))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(texts, own.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
