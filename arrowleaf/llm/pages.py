"""HTML extraction by site template removal.

A page is parsed once into its blocks of text in page order and the spans of blocks that its elements
cover.  Every block element's subtree (tag, classes, text of all below) is hashed; lists of links outside
an article are hashed by their shape too (tags and classes, runs of equal siblings as one), as their
targets differ from page to page.  Spark counts, for each host, on how many different article bodies each
hash occurs; subtrees on ``min_pages`` of them are the site's template and their spans are deleted from
the host's pages.  Copies of one article count once.  Inside an article a paragraph, heading or list item
by itself is template only when at least half of all bodies of its host hold it: articles quote alike.

Rules of structure settle what no template covers, as on hosts of few pages: navigation, site headers,
footers, asides, forms, scripts, hidden parts and elements whose role or whole class or id names such a
part are never text; the text is that of the articles, else of the main element, else of the body without
blocks that are mostly links.

Defined cases: null and empty html give the empty text; broken markup is repaired as browsers do (open
paragraphs end at the next block, the head ends at the first element of the body, stray end tags are
ignored); a null url is the empty host; repeated rows give repeated results; rows of one id with different
html are pages of their own; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_safe_semi, sliced

_INNER = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
_MARK = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|noscript|iframe|noembed|noframes|textarea|title)(?=[\s/>]){_INNER}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_INNER})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PIECE = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta title script style noscript template head".split())
FOREIGN = frozenset(("svg", "math"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("caption tbody td tfoot th thead tr body html".split())
#: start tag -> (open elements that it ends, elements beyond which it does not look)
_LISTS = frozenset("ul ol menu dir".split())
_TABLE = frozenset(["table"])
ENDS = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), _TABLE), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: An end tag of a block does not look beyond these.
SCOPE = frozenset("table td th caption button object template".split())
TABLES = frozenset("table tbody thead tfoot tr td th caption".split())
#: Never main text, and never main text outside an article.
DROP = frozenset("nav aside form button select textarea input label dialog menu footer frameset applet option datalist head template svg canvas object audio video".split())
DROP_OUTSIDE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status".split())
#: Words that name such a part, and words that may stand beside them in a class or id.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer comments comment disqus respond reply replies share sharing social related recommended newsletter "
    "subscribe subscription signup login search skip toolbar widget complementary contentinfo".split()
)
NAMED_OUTSIDE = frozenset("header masthead topbar".split())
BESIDE = frozenset(
    "box block bar bars list links link button buttons btn btns section wrapper wrap container area panel slot unit posts articles stories items item content inner outer main top bottom "
    "left right site global primary secondary mobile desktop sticky fixed form icons icon group row col module component message text body".split()
)
#: Inside an article these may be template at any host; and these alone are judged by an id.
CONTAINER = frozenset("div section ul ol dl table figure aside nav header footer form menu details".split())


@lru_cache(1 << 16)
def _named(token: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names a part that is never text; outside an article only; by one word."""
    parts = [p.lower() for p in _PIECE.split(token) if p]
    rest = [p for p in parts if p not in NAMED and p not in BESIDE and not p.isdigit()]
    hit = any(p in NAMED for p in parts) and not rest
    outside = bool(parts) and all(p in NAMED_OUTSIDE for p in rest) and (hit or bool(rest))
    return hit, outside, len(parts) == 1 and hit


class Node:
    __slots__ = ("tag", "parts", "classes", "ident", "role", "hidden", "main", "key", "shape", "size", "linked")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.parts = tag, []
        self.classes, self.ident, self.role, self.hidden, self.main = (), "", "", False, tag == "main"
        self.key = self.shape = self.size = self.linked = 0
        if attrs:
            seen = set()
            for m in _ATTR.finditer(attrs):
                what, value = m[1].lower(), (m[2] or "").strip("\"'")
                if what in seen:
                    continue
                seen.add(what)
                if what == "class":
                    self.classes = tuple(unescape(value).split())
                elif what == "id":
                    self.ident = unescape(value).strip()
                elif what == "role":
                    self.role = value.strip().lower()
                    self.main = self.main or self.role == "main"
                elif what == "itemprop":
                    self.main = self.main or value == "articleBody"
                elif what == "style":
                    self.hidden = self.hidden or "display:none" in "".join(value.split()).lower()
                elif what == "hidden":
                    self.hidden = self.hidden or value.lower() != "until-found"
                elif what == "aria-hidden":
                    self.hidden = self.hidden or value.lower() == "true"


def parse(html: str | None) -> Node:
    """The page's elements; a node's parts are texts and nodes in order."""
    root = Node("#")
    stack = [root]
    if not html:
        return root
    at, foreign, head = 0, 0, False

    def text(a: int, b: int) -> None:
        nonlocal head
        if head and html[a:b].strip():
            head = False
            _end(stack, ("head",), ())
        stack[-1].parts.append(html[a:b])

    for m in _MARK.finditer(html):
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        tag = name.lower()
        if m[2] or m[5]:
            _close(stack, tag)
            foreign -= tag in FOREIGN and foreign > 0
            head = head and tag != "head"
            continue
        if head and tag not in HEAD:
            head = False
            _end(stack, ("head",), ())
        if tag in ENDS_P:
            _end(stack, ("p",), ("button", "table", "td", "th", "caption"))
        if tag in ENDS:
            _end(stack, *ENDS[tag])
        attrs = m[4] or m[7] or ""
        node = Node(tag, attrs)
        stack[-1].parts.append(node)
        closed = attrs.endswith("/") and (foreign or tag in FOREIGN)  # elsewhere a slash means nothing
        if tag not in VOID and not closed:
            stack.append(node)
            foreign += tag in FOREIGN
            head = head or tag == "head"
    if at < len(html):
        text(at, len(html))
    return root


def _end(stack: list[Node], tags, bounds) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in bounds:
            return


def _close(stack: list[Node], tag: str) -> None:
    """An end tag: an inline one does not end blocks, a block's does not leave its table cell."""
    if tag in ("body", "html"):
        return
    if tag in TABLES:
        bounds = frozenset() if tag == "table" else _TABLE
    else:
        bounds = SCOPE if tag in BLOCK else BLOCK
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in bounds:
            return


def _walk(node: Node):
    """Nodes below, each after what is below it, without recursion."""
    todo, out = [node], []
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [p for p in n.parts if type(p) is Node]
    return reversed(out)


def hash_subtrees(root: Node) -> None:
    """Give every element the hash of all below, its shape, and its sizes of text and of linked text."""
    for n in _walk(root):
        own = f"{n.tag} {' '.join(n.classes)}"
        h, s = xxhash.xxh64(own), xxhash.xxh64(own)
        last = 0
        for p in n.parts:
            if type(p) is Node:
                h.update(p.key.to_bytes(8, "little"))
                if p.shape != last:
                    s.update(p.shape.to_bytes(8, "little"))
                last = p.shape
                n.size += p.size
                n.linked += p.linked
            elif t := " ".join(p.split()):
                h.update(t)
                n.size += len(t)
        if n.tag == "a":
            n.linked = n.size
        n.key, n.shape = h.intdigest(), s.intdigest()


def _dropped(n: Node, inside: bool, by_name: bool = True) -> bool:
    if n.tag in DROP or n.hidden or n.role in ROLES or not inside and n.tag in DROP_OUTSIDE:
        return True
    if not by_name or not (n.classes or n.ident) or n.tag in ("html", "body", "main"):
        return False
    if n.tag == "article":
        return any(c.lower() in ("comment", "comments") for c in n.classes)
    whole = n.tag in CONTAINER
    for c in (*n.classes, n.ident) if whole else n.classes:
        hit, outside, single = _named(c)
        if hit and (whole or single) or outside and whole and not inside:
            return True
    return False


def _roots(root: Node) -> list[Node]:
    """Where the main text is: the outermost articles, else main parts; empty when neither is marked.

    Articles below an element of a telling name count only where there are no others.
    """
    for wanted in (lambda n: n.tag == "article", lambda n: n.main):
        for by_name in (True, False):
            found, todo = [], [root]
            while todo:
                n = todo.pop()
                if n is not root and _dropped(n, False, by_name):
                    continue
                if wanted(n):
                    found.append(n)
                    continue
                todo += [p for p in reversed(n.parts) if type(p) is Node]
            if found:
                return found
    return []


def outline(root: Node) -> tuple[list[str | None], list[tuple[int, int, int, bool]]]:
    """The page's blocks in order, ``None`` for those that the rules drop, and its elements' spans.

    A span is (hash, first block, end, whether it has to be on half of all bodies).
    """
    hash_subtrees(root)
    roots = set(map(id, _roots(root)))
    blocks: list[str | None] = []
    spans: list[tuple[int, int, int, bool]] = []
    now: list[str] = []
    other = False  # text of a dropped part since the last block
    entered = 0

    def flush() -> None:
        nonlocal other
        if line := " ".join(unescape("".join(now)).split()):
            blocks.append(line)
        elif other:
            blocks.append(None)
        now.clear()
        other = False

    todo: list = [(root, not roots, True)]
    while todo:
        x, inside, keep = todo.pop()
        if type(x) is str:
            if inside and keep:
                now.append(x)
            elif x.strip():
                other = True
        elif type(x) is tuple:  # the end of a block element
            flush()
            node, first, before = x
            if len(blocks) > first and node.tag not in ("#", "html", "body", "article", "main") and id(node) not in roots:
                spans.append((node.key, first, len(blocks), bool(roots) and inside and node.tag not in CONTAINER))
                if roots and not inside and before == entered and 2 * node.linked > node.size:
                    spans.append((node.shape, first, len(blocks), False))
        elif x.tag == "br":
            if inside and keep:
                now.append(" ")
        else:
            if id(x) in roots:
                inside, keep, entered = True, True, entered + 1
            elif keep and x is not root:
                keep = not _dropped(x, bool(roots)) if inside else False if roots else keep
                if keep and not roots and x.tag in CONTAINER and 2 * x.linked > x.size > 0:
                    keep = False
            below = [(p, inside, keep or bool(roots) and not inside) for p in reversed(x.parts)]
            if x.tag in BLOCK or id(x) in roots or x is root:
                flush()
                todo.append(((x, len(blocks), entered), inside, keep))
            todo += below
    flush()
    return blocks, spans


def text_blocks(root: Node) -> list[str]:
    """The blocks of the main text in page order, by the rules alone."""
    return [b for b in outline(root)[0] if b is not None]


def _host():
    url = F.coalesce(F.col("url"), F.lit(""))
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _outlines(pages: DataFrame) -> DataFrame:
    """(page_id, url, row, site, blocks, spans, body) of each page; row, site and body are hashes of html, host and text."""

    def run(batches):
        for big in batches:
            for b in sliced(big):
                blocks, spans, bodies = [], [], []
                for html in b.column(4).to_pylist():
                    own, cover = outline(parse(html))
                    blocks.append(own)
                    spans.append([{"h": h - (1 << 64) if h >> 63 else h, "a": a, "b": z, "fine": f} for h, a, z, f in cover])
                    bodies.append(xxhash.xxh64_intdigest("\n".join(x for x in own if x is not None)) >> 1)
                kind = pa.list_(pa.struct([("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("fine", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(4)), pa.array(blocks, pa.list_(pa.string())), pa.array(spans, kind), pa.array(bodies, pa.int64())],
                    ["page_id", "url", "row", "site", "blocks", "spans", "body"],
                )

    p = pages.select("page_id", "url", F.xxhash64("html").alias("row"), F.xxhash64(_host()).alias("site"), "html")
    kind = p.schema["page_id"].dataType.simpleString()
    return p.mapInArrow(run, f"page_id {kind}, url string, row long, site long, blocks array<string>, spans array<struct<h:long,a:int,b:int,fine:boolean>>, body long")


def templates(outlines: DataFrame, min_pages: int = 5, share: float = 0.5) -> DataFrame:
    """(site, h, n, met): subtrees on n bodies of the site (the host's hash), met by ``met`` spans of all its pages."""
    s = outlines.select("site", "body", F.explode("spans").alias("s")).select("site", "body", "s.h", "s.fine")
    each = s.groupBy("site", "h", "body").agg(F.max("fine").alias("fine"), F.count(F.lit(1)).alias("met"))
    often = each.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n"), F.max("fine").alias("fine"), F.sum("met").alias("met")).where(F.col("n") >= min_pages)
    bodies = outlines.select("site", "body").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("bodies"))
    return often.join(bodies, "site").where(~F.col("fine") | (F.col("n") >= share * F.col("bodies"))).select("site", "h", "n", "met")


def _key(site: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (site * np.int64(0x5851F42D4C957F2D)) ^ h


def _cut_by_broadcast(found: DataFrame, often: DataFrame) -> DataFrame:
    """(page_id, url, text, n_template): every task has the templates' keys, sorted, and looks its spans up."""
    got = often.select("site", "h").toArrow()
    known = found.sparkSession.sparkContext.broadcast(np.sort(_key(got.column("site").to_numpy(), got.column("h").to_numpy())))

    def run(batches):
        keys = known.value
        for b in batches:
            site, blocks, spans = b.column(2).to_numpy(), b.column(3), b.column(4)
            each, first = spans.value_lengths().to_numpy(), blocks.offsets.to_numpy() - blocks.offsets[0].as_py()
            flat, parts = blocks.flatten(), spans.flatten()
            of = np.repeat(np.arange(b.num_rows), each)
            own = _key(site[of], parts.field("h").to_numpy())
            hit = np.zeros(len(own), bool)
            if len(keys):
                hit = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, first[of[hit]] + parts.field("a").to_numpy()[hit], 1)
            np.add.at(edge, first[of[hit]] + parts.field("b").to_numpy()[hit], -1)
            covered = np.cumsum(edge[:-1]) > 0
            keep = (np.asarray(flat.is_valid()) & ~covered).tolist()
            texts, before = flat.to_pylist(), np.concatenate([[0], np.cumsum(covered)])
            text = ["\n".join([texts[i] for i in range(x, y) if keep[i]]) for x, y in zip(first.tolist(), first[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(before[first[1:]] - before[first[:-1]], pa.int64())], ["page_id", "url", "text", "n_template"])

    kind = found.schema["page_id"].dataType.simpleString()
    return found.select("page_id", "url", "site", "blocks", "spans").mapInArrow(run, f"page_id {kind}, url string, text string, n_template long")


def _cut_by_shuffle(found: DataFrame, often: DataFrame) -> DataFrame:
    """The same through a lookup of the spans and a join by page."""
    spans = found.select("page_id", "row", "site", F.explode("spans").alias("s")).select("page_id", "row", "site", "s.h", "s")
    hits = skew_safe_semi(spans, often, ["site", "h"], "met", often.agg(F.sum("met")).first()[0] or 0)
    gone = hits.groupBy("page_id", "row").agg(F.collect_set("s").alias("gone")).select(F.col("page_id").alias("_id"), F.col("row").alias("_row"), "gone")
    p = found.join(gone, found["page_id"].eqNullSafe(F.col("_id")) & (found["row"] == F.col("_row")), "left")
    covered = lambda i: F.exists(F.col("gone"), lambda g: (i >= g["a"]) & (i < g["b"]))
    none = F.col("gone").isNull()
    kept = F.when(none, F.filter("blocks", lambda x: x.isNotNull())).otherwise(F.filter("blocks", lambda x, i: x.isNotNull() & ~covered(i)))
    n = F.when(none, 0).otherwise(F.size(F.filter("blocks", lambda x, i: covered(i))))
    return p.select("page_id", "url", F.array_join(kept, "\n").alias("text"), n.cast("long").alias("n_template"))


def extract(pages: DataFrame, min_pages: int = 5, share: float = 0.5, broadcast: int = 500_000) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) of each page's whole html; the last counts blocks that templates cover.

    At most ``broadcast`` templates (16 bytes each) go to every task; more are looked up through a shuffle.
    """
    found = materialise(_outlines(pages), "outlines")
    often = materialise(templates(found, min_pages, share), "templates")
    out = (_cut_by_broadcast if often.count() <= broadcast else _cut_by_shuffle)(found, often)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
