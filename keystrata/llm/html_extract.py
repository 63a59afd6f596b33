"""HTML main text by consensus of host paths (operator 4).

Pass 1 parses each page, finds its content container (the deepest element that still holds most of the
page's running text) and votes for the container's path: its tags with their classes, digits generalised.
Spark adds the votes up for each host.  Pass 2 parses each page again and extracts the elements at the
path that leads its host's vote; a page without that path, or where it holds too little of the page's text,
takes the next path of its host, and at last its own container.  Every path with ``VOTES`` votes is tried,
however many a host has: they are broadcast, or, beyond ``BROADCAST_BYTES``, joined with the paths that each
page holds.

What is dropped everywhere: scripts, styles, markup, menus, forms, sidebars, footers, page headers and
elements whose class, id or role names them as such, or as adverts, notices or comments.  A name does so as
a whole: ``comments``, ``cookie-notice``, ``sidebar-left``, but not ``related-work`` or ``side-by-side``.  Of
elements with names of the latter kind only those go that are mostly links, or that stand outside the
page's article.  Class and id of a heading tell what it is about, and drop nothing.

Defined results: null or empty html and pages without text give an empty text; pages without a host vote
together; repeated rows get equal results; unclosed and truncated markup is read as browsers do, as far as
blocks are concerned.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, shared_dir

#: A container is entered while one child holds this share of its text; a host's path must hold this much of a page's best.
SHARE, ENOUGH = 0.6, 0.5
#: The same for elements that say they are the article.
NAMED_SHARE = 0.3
#: A path needs this many votes to be a consensus.
VOTES = 2
#: Bytes of hosts and paths that are broadcast at most; beyond, they are joined by path and page.
BROADCAST_BYTES = 16 << 20
#: What a path counts beside its letters.
ROW_BYTES = 100
#: A path that a host's pages share is joined in this many tasks.
SALTS = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math xmp".split())
DROPPED = frozenset("nav footer aside form button select dialog menu object audio video canvas head fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
#: What opening a tag closes, if it is the innermost of its kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
#: Elements that an implied end doesn't cross.
SCOPES = frozenset("article section main div table ul ol dl body html blockquote td th".split())
#: Elements whose text is one block; never containers.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr ul ol dl table tbody thead figure address".split())
BOILERPLATE = frozenset("nav navbar navigation menu menubar sidebar side footer foot masthead topbar ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login search breadcrumb breadcrumbs pagination pager share sharing social related recommended comment comments commentlist disqus reply replies respond widget tags toolbar complementary contentinfo header".split())
#: Words that a name of boilerplate may have besides.
FURNITURE = frozenset("area articles bar block body bottom box button buttons close col column container content desktop fixed float floating form global google group icon icons inner item items layout left link links list main mobile module outer page panel posts primary region right row secondary section site slot sticky title toggle top unit wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of text: their class must name boilerplate in all its words, their id in one.
TEXTS = frozenset("p section blockquote pre".split()) | INLINE
#: An element with a boilerplate word in its name goes if this share of its text is links.
LINKED = 0.5
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[^\W\d_]+")


class Element(NamedTuple):
    parent: int
    tag: str
    path: str
    dropped: bool
    doubtful: bool = False  #: a boilerplate word is part of its name; never a container unless it holds the article


class Tree(NamedTuple):
    elements: list[Element]
    blocks: list[tuple[int, str, int]]  #: element, text, characters in links; in page order


@lru_cache(maxsize=20_000)
def names_boilerplate(name: str) -> tuple[bool, bool]:
    """Whether the name is one of boilerplate as a whole; whether a part of it is."""
    parts = PARTS.findall(name.lower())
    some = not BOILERPLATE.isdisjoint(parts)
    return some and all(p in BOILERPLATE or p in FURNITURE for p in parts), some


def named(tag: str, names: dict[str, str]) -> tuple[bool, bool]:
    """Whether class, id or role name the element as boilerplate; whether they may."""
    if any(names_boilerplate(r)[0] for r in names.get("role", "").split()):
        return True, True
    if tag in HEADINGS:
        return False, False
    classes = [names_boilerplate(c) for c in names.get("class", "").split()]
    slug = names.get("id", "").strip()
    whole, some = names_boilerplate(slug)
    if tag in TEXTS:
        bad = bool(classes) and all(w for w, _ in classes) or (whole and len(PARTS.findall(slug)) == 1)
    else:
        bad = whole or any(w for w, _ in classes)
    return bad, some or any(part for _, part in classes)


def settled(tree: Tree) -> Tree:
    """Drops the doubtful elements that are mostly links or stand outside the page's article."""
    elements = tree.elements
    if not any(e.doubtful for e in elements):
        return tree
    chars, linked = [0] * len(elements), [0] * len(elements)
    for e, text, n in tree.blocks:
        chars[e] += len(text)
        linked[e] += min(n, len(text))
    inside, around = [e.tag in ("article", "main") for e in elements], [False] * len(elements)
    for k in range(len(elements) - 1, 0, -1):
        chars[elements[k].parent] += chars[k]
        linked[elements[k].parent] += linked[k]
        around[elements[k].parent] |= around[k] or inside[k]
    running = 0
    for k, e in enumerate(elements):
        if k and inside[e.parent]:
            inside[k] = True
        elif inside[k]:
            running += chars[k] - linked[k]
    article = running > NAMED_SHARE * (chars[0] - linked[0])
    out = elements[:1]
    for k, e in enumerate(elements[1:], 1):
        gone = e.doubtful and (linked[k] > LINKED * chars[k] or (article and not inside[k] and not around[k]))
        out.append(e._replace(dropped=e.dropped or out[e.parent].dropped or gone, doubtful=e.doubtful and not around[k]))
    return Tree(out, [b for b in tree.blocks if not out[b[0]].dropped])


def parse(html: str) -> Tree:
    elements = [Element(-1, "", "", False)]
    stack, blocks = [0], []
    run: list[str] = []
    links = link_chars = 0
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal link_chars
        if run:
            if text := " ".join(unescape("".join(run)).split()):
                blocks.append((stack[-1], text, link_chars))
            run.clear()
        link_chars = 0

    def close(tags, scopes=SCOPES) -> None:
        """Ends the innermost open element among tags, unless a scope stands between."""
        for k in range(len(stack) - 1, 0, -1):
            tag = elements[stack[k]].tag
            if tag in tags:
                flush()
                del stack[k:]
                return
            if tag in scopes:
                return

    while at < size:
        m = TAG.search(html, at)
        stop = m.start() if m else size
        if stop > at and not elements[stack[-1]].dropped:
            run.append(html[at:stop])
            if links:
                link_chars += stop - at
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        ends, name, attributes = m[1] or m[4], name.lower(), m[3] or m[6] or ""
        if ends:
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                run.append(" ")
            if name in INLINE and not any(elements[i].tag == name for i in stack[1:]):
                continue
            close({name}, frozenset(("article", "body", "html")) - {name} if name in LEAVES or name in INLINE else frozenset())
            if name in ("p", "div"):
                flush()
            continue
        if name in RAW:
            low = html.find(f"</{name}", at)
            if low < 0:
                low = html.lower().find(f"</{name}", at)
            if low < 0:
                at = size
            else:
                at = html.find(">", low) + 1 or size
            continue
        if name == "br" or name == "wbr":
            run.append(" " if name == "br" else "")
            continue
        names = {k.lower(): a or b or c for k, a, b, c in NAMES.findall(attributes)} if attributes else {}
        bad, doubtful = named(name, names) if names and name not in ("html", "body", "article", "main") else (False, False)
        if name in INLINE and not bad:
            links += name == "a"
            continue
        flush()
        if name in VOID:
            continue
        if name not in INLINE:
            close({"p"})
        if name in CLOSES:
            close(CLOSES[name], SCOPES - {"td", "th"} if name in ("tr", "td", "th", "tbody", "thead") else SCOPES)
        if name in ("html", "body") and any(elements[i].tag == name for i in stack):
            continue
        above = elements[stack[-1]]
        inside = any(elements[i].tag in ("article", "main") for i in stack)
        dropped = above.dropped or bad or name in DROPPED or (name == "header" and not inside)
        step = name + "".join(f".{c}" for c in sorted(set(DIGITS.sub("#", names.get("class", "")).split())))
        elements.append(Element(stack[-1], name, above.path if name in ("html", "body") else f"{above.path}/{step}", dropped, doubtful))
        stack.append(len(elements) - 1)
        if attributes.endswith("/") and name in INLINE:
            stack.pop()
    flush()
    return settled(Tree(elements, [b for b in blocks if not elements[b[0]].dropped]))


def weights(tree: Tree) -> list[int]:
    """Characters outside links under each element."""
    own = [0] * len(tree.elements)
    for e, text, linked in tree.blocks:
        own[e] += max(0, len(text) - linked)
    for k in range(len(own) - 1, 0, -1):
        own[tree.elements[k].parent] += own[k]
    return own


def best_container(tree: Tree, weight: list[int]) -> int:
    """The deepest element that still holds most of the running text above it."""
    children: dict[int, list[int]] = {}
    for k, e in enumerate(tree.elements):
        if k and e.tag not in LEAVES and not e.dropped and not e.doubtful:
            children.setdefault(e.parent, []).append(k)
    at = 0
    while below := children.get(at):
        top = max(below, key=lambda k: (weight[k], -k))
        told = [k for k in below if tree.elements[k].tag in ("article", "main") and weight[k] > NAMED_SHARE * weight[at]]
        if weight[top] <= SHARE * weight[at] and not told:
            break
        at = max(told, key=lambda k: (weight[k], -k)) if told else top
    return at


def text_under(tree: Tree, roots: set[int]) -> str:
    inside = [False] * len(tree.elements)
    for k, e in enumerate(tree.elements):
        inside[k] = k in roots or (k > 0 and inside[e.parent])
    return " ".join(text for e, text, _ in tree.blocks if inside[e])


def vote(html: str | None) -> tuple[str, int] | None:
    """Path and running characters of the page's container."""
    if not html:
        return None
    tree = parse(html)
    weight = weights(tree)
    if not weight[0]:
        return None
    at = best_container(tree, weight)
    return tree.elements[at].path, weight[at]


def candidates(tree: Tree, weight: list[int], best: int) -> dict[str, set[int]]:
    """The paths that hold enough of the page's best container, and their elements."""
    roots: dict[str, set[int]] = {}
    for k, e in enumerate(tree.elements):
        if k and not e.dropped:
            roots.setdefault(e.path, set()).add(k)
    found = {path: ks for path, ks in roots.items() if sum(weight[k] for k in ks if tree.elements[k].parent not in ks) >= ENOUGH * weight[best]}
    if tree.elements[best].path == "":
        found[""] = {0}
    return found


def page_paths(html: str | None) -> list[str]:
    """The paths that the page can be extracted at."""
    if not html:
        return []
    tree = parse(html)
    weight = weights(tree)
    return list(candidates(tree, weight, best_container(tree, weight)))


def extract(html: str | None, paths: Mapping[str, int] | Sequence[str]) -> str:
    """The text at the first path (in order, or of least number) that holds enough of the page's best container, else that container's."""
    if not html:
        return ""
    if not isinstance(paths, Mapping):
        paths = {path: k for k, path in reversed(list(enumerate(paths)))}
    tree = parse(html)
    weight = weights(tree)
    best = best_container(tree, weight)
    held = candidates(tree, weight, best) if paths else {}
    first = min((path for path in held if path in paths), key=paths.__getitem__, default=None)
    return text_under(tree, {best} if first is None else held[first])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, n, chars): every path that has VOTES votes of its host's pages."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        votes = [vote(h) for h in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([v and v[0] for v in votes], pa.string()), pa.array([v and v[1] for v in votes], pa.int64())], ["host", "path", "chars"])

    votes = map_slices(pages.select("host", "html"), "html", "host string, path string, chars bigint", run)
    return votes.where(F.col("path").isNotNull()).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).where(F.col("n") >= VOTES)


def leading_paths(keyed: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, path): the path of most votes among those that a page can be extracted at; pages without one are left out."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        held = [page_paths(h) for h in part.column(2).to_pylist()]
        rows = pa.array([k for k, found in enumerate(held) for _ in found], pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array([path for found in held for path in found], pa.string())], ["key", "host", "path"])

    held = map_slices(keyed.select("key", "host", "html"), "html", "key bigint, host string, path string", run)
    # All pages of a host may share a path: they meet its votes in SALTS tasks.
    salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = held.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    return met.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("chars")).alias("chars"), "path")).alias("first")).select("key", F.col("first.path").alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    spark = pages.sparkSession
    shared_dir(spark)
    paths = host_paths(source).checkpoint()
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + ROW_BYTES)).first()[0] or 0
    kind = source.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars bigint"

    def made(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= broadcast_bytes:
        ranks: dict[str, dict[str, int]] = {}
        for r in sorted(paths.collect(), key=lambda r: (-r.n, -r.chars, r.path)):
            ranks.setdefault(r.host, {})[r.path] = len(ranks.get(r.host, ()))
        shared = spark.sparkContext.broadcast(ranks)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            ranks = shared.value
            return made(part, [extract(h, ranks.get(host, {})) for host, h in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)])

        return map_slices(source.select("page_id", "url", "host", "html"), "html", schema, run)

    # Too much to broadcast: a page's path is found without its html, so no host's pages meet in one task.
    keyed = source.withColumn("key", F.xxhash64("page_id", "url", "html"))
    placed = keyed.join(leading_paths(keyed, paths), "key", "left")

    def run_placed(part: pa.RecordBatch) -> pa.RecordBatch:
        return made(part, [extract(h, [] if p is None else [p]) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)])

    return map_slices(placed.select("page_id", "url", "html", "path"), "html", schema, run_placed)
