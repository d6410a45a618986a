"""Main text of web pages by site template removal.

Each page is read into a tree of elements.  The subtree of an element is hashed
with its tags, classes and text; Spark counts on how many pages of a host each
hash occurs, and subtrees that recur on many pages of a host are its template
and are deleted.  Copies of a page count as one page: what is counted is the
number of different bodies a subtree occurs in.  Within an article or main element
near copies of an article share their paragraphs, so there the rest of the article
must differ as well: ``SKETCH`` min-hashes of its word triples estimate how alike
two pages with the subtree are elsewhere, and the mean over all pairs of them must
be at most 1 / ``MIN_PAGES``, as for so many unlike articles.  So a notice stays
where other recurring text makes up most of the article besides it.  Headings,
cells and items are never taken alone: "Introduction" or "0" recurs in articles.

Elements that are no text of the article by their tag or role (menus, headers,
footers, asides, scripts, styles) are deleted on every page, also on hosts with
too few pages to tell a template.  So are forms and hidden elements, but for one
that wraps the article, or on a page without one most of its prose; and elements with a class
that names boilerplate (``ad``, ``sidebar``, ``comments``) as a whole token, but
never one that holds the article or most of the page's prose, and no heading.

Broken markup is read as browsers do in the common cases: unclosed paragraphs,
list items and cells end where the next begins, an end tag closes what is open
inside it, and the rest of a cut page is read to its end.  A null page is empty.
Pages without a host are their own site each.  Repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.common import map_batches, partitions
from logveil.sources.staging import staged

#: A subtree is template if it is on so many different pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.05
#: Min-hashes of the rest of an article, over so many words each.
SKETCH, TRIPLE = 8, 3

# Tags, roles and classes, by their meaning in HTML and by common use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option datalist dialog menu object canvas audio video math".split())
#: Elements of other languages, in which a slash closes a start tag.
FOREIGN = frozenset({"svg", "math"})
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tr td th ul ol li dl dt dd figure figcaption br hr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements of which an article may hold equal ones, and those that hold such: in an article these are template as a whole or not at all.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption".split())
WHOLES = frozenset("table ul ol dl figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Whole class tokens that name what is no article; those of OUTSIDE only where no article or main element is around.
COMMENTS = frozenset("comments comment-list commentlist comments-area comments-section disqus disqus_thread".split())
NAMED = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle ad-banner ad-container ad-slot ad-unit ad-wrapper "
    "banner-ad sponsored sidebar cookie-banner cookie-bar cookie-consent cookie-notice cookie-popup gdpr newsletter-signup "
    "share-buttons social-share sharedaddy related-posts".split())
# Tokens made of "comments", but not those that only say whether there are any.
_COMMENTS = re.compile(r"(?:(?!(?:has|no|with|without|show|hide|open|closed)[-_])[a-z]+[-_])?(?:comments(?:[-_](?:area|section|list|wrapper|block|thread|"
                       r"container))?|comment[-_](?:area|section|list|wrapper|block|thread|container))")
OUTSIDE = frozenset("nav navbar navigation main-navigation site-navigation menubar breadcrumb breadcrumbs pagination topbar masthead "
                    "site-header site-footer footer skip-link widget-area popup modal".split())
SAFE = frozenset({"html", "body", "main", "article"})
#: Elements that may wrap a whole page; and those that a list of comments is made of.
WRAPPERS = frozenset({"form"})
SECTIONS = frozenset("div section ul ol".split())
#: A start tag on the left ends an open element on the right.
ENDS = {tag: frozenset({"p"}) for tag in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
        "h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDS |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
         "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
         "option": frozenset({"option"})}
#: Elements that an implied end does not cross.
WALLS = frozenset("html body table ul ol dl div article section main td th blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=\s|$|/)""", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    attributes: str = ""
    children: list[Element | str] = field(default_factory=list)


def parse(html: str) -> Element:
    """The tree of a page; texts have their character references decoded."""
    root, at = Element("html"), 0
    open_: list[Element] = [root]
    # places of the open elements by tag and of the walls among them, so that no tag searches a deep page
    places: dict[str, list[int]] = {}
    walls: list[int] = []

    def text(upto: int) -> None:
        if upto > at:
            open_[-1].children.append(unescape(html[at:upto]))

    def cut(place: int) -> None:
        while len(open_) > place:
            places[open_.pop().tag].pop()
        while walls and walls[-1] >= place:
            walls.pop()

    while m := _TOKEN.search(html, at):
        text(m.start())
        at = m.end()
        if m[0].startswith("<![CDATA["):
            open_[-1].children.append(m[0][9:].removesuffix("]]>"))
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if places.get(tag) and not ((tag in INLINE or tag == "p") and walls and walls[-1] > places[tag][-1]):
                cut(places[tag][-1])
            continue
        ended = max((places[t][-1] for t in ENDS.get(tag, ()) if places.get(t)), default=0)
        if ended and not (walls and walls[-1] > ended):
            cut(ended)
        if tag in ("html", "body") and tag == open_[-1].tag:
            continue
        element = Element(tag, m[3].strip().removesuffix("/"))
        open_[-1].children.append(element)
        if tag in FOREIGN and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(open_))
            if tag in WALLS:
                walls.append(len(open_))
            open_.append(element)
    text(len(html))
    return root


@lru_cache(maxsize=4096)
def _attributes(text: str) -> tuple[bool, bool, frozenset[str], frozenset[str]]:
    """Of an element's attributes: whether its role says that it is no text, whether it is hidden, its class tokens and its ids."""
    role = hidden = False
    tokens: dict[str, set[str]] = {"class": set(), "id": set()}
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in tokens:
            tokens[name].update(value.lower().split())
        role = role or name == "role" and value.lower() in ROLES
        hidden = hidden or name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
            or name == "style" and "display:none" in value.replace(" ", "").lower()
    return role, hidden, frozenset(tokens["class"]), frozenset(tokens["id"])


def is_dropped(element: Element, inside: bool) -> bool:
    """Whether an element is no text by its tag or role; ``inside`` an article its own header stays."""
    tag = element.tag
    if tag in DROPPED:
        return tag not in WRAPPERS and not (inside and tag == "header")
    return tag not in SAFE and bool(element.attributes) and _attributes(element.attributes)[0]


def is_wrapper(element: Element) -> bool:
    """Whether an element is no text unless it wraps the article: a form, or what is hidden."""
    return element.tag in WRAPPERS or element.tag not in SAFE and bool(element.attributes) and _attributes(element.attributes)[1]


def _of_comments(token: str) -> bool:
    return token in COMMENTS or bool(_COMMENTS.fullmatch(token))


def names(element: Element, inside: bool) -> set[str]:
    """Class tokens of an element that name boilerplate.  An id counts as one on a plain ``div`` outside an article only,
    since sections and headings are named by their subject, and an id of reader comments on a section or list there."""
    if element.tag in SAFE or element.tag in HEADINGS or not element.attributes:
        return set()
    _, _, found, ids = _attributes(element.attributes)
    known = NAMED if inside else NAMED | OUTSIDE
    out = {t for t in found if t in known or _of_comments(t)}
    if element.tag == "div" and not inside and "section" not in found:
        return out | {t for t in ids if t in known or _of_comments(t)}
    return out | {t for t in ids if _of_comments(t)} if element.tag in SECTIONS and not inside else out


def boilerplate(root: Element) -> set[int]:
    """The ids of the elements that are no text of the article by what they are.

    An element is not dropped for its name if it holds a main element, the page's
    first article or most of its prose.  Comments may be longer than the article
    they are on: where there is an article or main element, length keeps none.
    """
    gone: set[int] = set()
    nodes: list[list] = []  # element, parent's place, characters of prose, of all text
    named: list[tuple[int, set[str] | None]] = []
    holders: list[int] = []
    article = False
    stack = [(root, -1, False, False)]
    while stack:
        e, parent, inside, prose = stack.pop()
        if is_dropped(e, inside):
            gone.add(id(e))
            continue
        at = len(nodes)
        if is_wrapper(e):
            named.append((at, None))
        elif found := names(e, inside):
            named.append((at, found))
        if e.tag == "main" or e.tag == "article" and not article:
            holders.append(at)
            article = article or e.tag == "article"
        inside, prose = inside or e.tag in ("article", "main"), prose or e.tag in PROSE and e.tag not in ("ul", "ol", "li", "dl")
        size = sum(len(c.strip()) for c in e.children if not isinstance(c, Element))
        nodes.append([e, parent, size if prose else 0, size])
        stack.extend((c, at, inside, prose) for c in reversed(e.children) if isinstance(c, Element))
    if not named:
        return gone
    for _, parent, prose, size in reversed(nodes[1:]):
        nodes[parent][2] += prose
        nodes[parent][3] += size
    keep: set[int] = set()
    for at in holders:
        while at >= 0 and at not in keep:
            keep.add(at)
            at = nodes[at][1]
    measure = 2 if nodes[0][2] else 3
    for at, found in named:
        # what is hidden or a form is kept by length only where nothing else tells the article
        most = 2 * nodes[at][measure] > nodes[0][measure] and not (holders and (found is None or any(map(_of_comments, found))))
        if at not in keep and not most:
            gone.add(id(nodes[at][0]))
    return gone


_ODD = (np.arange(1, SKETCH + 1, dtype=np.uint32) * np.uint32(0x9E3779B1)) | np.uint32(1)


def _sketches(texts: list[str]) -> np.ndarray:
    """For each text the least of each of ``SKETCH`` hashes over its word triples; a text of fewer words is one triple."""
    words = [t.lower().encode("utf-8", "replace").split(b" ") for t in texts]
    words = [w if len(w) >= TRIPLE else w + [b""] * (TRIPLE - len(w)) for w in words]
    each = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.uint32)
    n = np.array([len(w) - TRIPLE + 1 for w in words])
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat((TRIPLE - 1) * np.arange(len(n)), n)
    found = np.zeros(len(at), np.uint32)
    for k in range(TRIPLE):
        found = (found ^ each[at + k]) * np.uint32(0x9E3779B1)
        found ^= found >> np.uint32(15)
    found = found[:, None] * _ODD
    return np.minimum.reduceat((found ^ (found >> np.uint32(13))) * np.uint32(0x85EBCA6B), first, axis=0)


def _hashed(root: Element, gone: set[int], out: list[tuple[Element, bytes, int, int]], texts: list[str]) -> bytes:
    """The hash of a tree without what is gone; ``out`` gets what may be template, with the places of its ``texts`` in articles.

    A stack of its own takes pages of any depth.
    """
    stack: list[list] = []

    def enter(element: Element, inside: bool, held: bool) -> None:
        made = hashlib.blake2b(f"{element.tag} {element.attributes}".encode("utf-8", "replace"), digest_size=16)
        stack.append([element, inside or element.tag in ("article", "main"), held, iter(element.children), made, element.tag in PROSE, len(texts)])

    enter(root, False, False)
    while True:
        element, inside, held, children, made, prose, start = stack[-1]
        for child in children:
            if not isinstance(child, Element):
                line = _SPACE.sub(" ", child).strip()
                made.update(b"\x00" + line.encode("utf-8", "replace"))
                if inside and line:
                    texts.append(line)
            elif id(child) not in gone:
                enter(child, inside, held or element.tag in WHOLES)
                break
        else:
            stack.pop()
            digest = made.digest()
            if element.tag not in SAFE and element.tag not in INLINE and not (inside and prose and (held or element.tag in PARTS)):
                # one more byte keeps the counts of subtrees in articles apart
                out.append((element, digest + b"\x01" if inside else digest, start, len(texts)))
            if not stack:
                return digest
            stack[-1][4].update(b"\x00" + digest)
            stack[-1][5] = stack[-1][5] or prose


def subtrees(root: Element, gone: set[int]) -> tuple[bytes, list[tuple[Element, bytes]]]:
    """The hash of a page's body without what is gone, and the subtrees that may be template."""
    out: list[tuple[Element, bytes, int, int]] = []
    body = _hashed(root, gone, out, [])
    return body, [(e, h) for e, h, _, _ in out if e.children]


def surroundings(root: Element, gone: set[int]) -> tuple[bytes, dict[bytes, list[int] | None]]:
    """As ``subtrees``, each hash with the sketch of the rest of the article; null outside of articles."""
    out: list[tuple[Element, bytes, int, int]] = []
    texts: list[str] = []
    body = _hashed(root, gone, out, texts)
    nothing = np.full((1, SKETCH), 0xFFFFFFFF, np.uint32)
    each = np.concatenate([nothing, _sketches(texts), nothing] if texts else [nothing, nothing])
    before, after = np.minimum.accumulate(each), np.minimum.accumulate(each[::-1])[::-1]
    found: dict[bytes, list[int] | None] = {}
    for e, h, start, end in out:
        if e.children and h not in found:
            found[h] = np.minimum(before[start], after[end + 1]).view(np.int32).tolist() if len(h) > 16 else None
    return body, found


def blocks(element: Element, gone: set[int]) -> list[str]:
    """The texts of the blocks that are left, in page order."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if line := _SPACE.sub(" ", "".join(held)).strip():
            out.append(line)
        held.clear()

    stack = [(element, iter(element.children))]
    while stack:
        e, children = stack[-1]
        for child in children:
            if isinstance(child, str):
                held.append(child)
            elif child.tag in ("br", "hr"):
                close()
            elif id(child) not in gone:
                if child.tag not in INLINE:
                    close()
                stack.append((child, iter(child.children)))
                break
        else:
            stack.pop()
            if e.tag not in INLINE:
                close()
    close()
    return out


def _main(element: Element, gone: set[int]) -> list[Element]:
    """The articles of a page, outermost only; else its main element; else the page."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    stack = [element]
    while stack:
        e = stack.pop()
        if e.tag in found:
            found[e.tag].append(e)
        if e.tag != "article":
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element) and id(c) not in gone)
    return found["article"] or found["main"][:1] or [element]


def extract(html: str | None, template: set[bytes]) -> str:
    """The main text of a page of a site with that template."""
    if not html:
        return ""
    root = parse(html)
    gone = boilerplate(root)
    if template:
        gone |= {id(e) for e, h in subtrees(root, gone)[1] if h in template}
    return "\n".join(line for e in _main(root, gone) for line in blocks(e, gone))


def host_of(url: str):
    """The host of a URL as a column, lower-cased and without ``www.``; null where there is none."""
    found = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), r"^www\.", "")
    return F.when(found != "", found)


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(host, hash)`` of the subtrees that are template.

    Counting is over distinct (host, hash, body), which Spark combines before and
    after shuffling, so a host with a third of all pages is spread by its hashes.
    Candidates within articles are joined to their pages once for each salt.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, hashes, bodies, rests = [], [], [], []
        for host, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(value.as_py())
            body, found = surroundings(root, boilerplate(root))
            for digest, rest in [*found.items(), (b"", None)]:
                hosts.append(host)
                hashes.append(digest)
                bodies.append(body)
                rests.append(rest)
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(hashes, pa.binary()), pa.array(bodies, pa.binary()), pa.array(rests, pa.list_(pa.int32()))],
            names=["host", "hash", "body", "rest"])

    rows = pages.select(host_of(url).alias("host"), F.col(html)).where("host IS NOT NULL").where(F.col(html).isNotNull())
    rows = staged(map_batches(rows, run, "host string, hash binary, body binary, rest array<int>").distinct(), "subtrees")
    counted = rows.groupBy("host", "hash").agg(F.count("*").alias("count")).where((F.octet_length("hash") == 0) | (F.col("count") >= min_pages))
    counted = staged(counted, "counted")
    totals = counted.where(F.octet_length("hash") == 0).select("host", F.col("count").alias("pages"))
    often = counted.where(F.octet_length("hash") > 0).join(totals, "host").where(F.col("count") >= F.col("pages") * min_share)
    often = staged(often.select("host", "hash", "count"), "often")
    salts = partitions(pages.sparkSession)
    within = often.where(F.octet_length("hash") > 16).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    alike = rows.where("rest IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(salts)).cast("int")) \
        .join(within, ["host", "hash", "salt"]).select("host", "hash", "count", F.posexplode("rest").alias("k", "least")) \
        .groupBy("host", "hash", "count", "k", "least").agg(F.count("*").alias("n")) \
        .groupBy("host", "hash", "count").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    unlike = alike.where(F.col("pairs") * min_pages <= F.col("count") * F.col("count") * SKETCH)
    return often.where(F.octet_length("hash") == 16).select("host", "hash").unionAll(unlike.select("host", "hash"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row.

    A host has at most 1 / ``MIN_SHARE`` templates for each subtree of a page, so
    its set is small.  It is joined to its pages as one array, once for each salt,
    so that the pages of a large host go to many tasks.
    """
    salts = partitions(pages.sparkSession)
    sets = templates(pages, url, html).groupBy("host").agg(F.collect_set("hash").alias("template")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")) \
        .withColumn("host", host_of("url")).withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)).cast("int")) \
        .join(sets, ["host", "salt"], "left").select("page_id", "url", "html", "template")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h.as_py(), set(t.as_py() or ())) for h, t in zip(batch.column(2), batch.column(3))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = f"page_id {pages.schema[page_id].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, text string"
    return map_batches(rows, run, schema).withColumn("n_chars", F.char_length("text").cast("bigint"))
