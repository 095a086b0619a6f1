"""Main text of web pages by wrapper induction.

Each page becomes a tree of its block elements. One page of a host gives the frame, and every other page of the host
is aligned with it by simple tree matching: blocks that stand in for each other share a slot. A text that most
different pages of a host have in the same slot is template, what varies is content. Blocks that the frame lacks have
their place in the page as a slot. Pages of one host often differ in their menus and adverts too, so slots that an
element, a class or a role marks as page furniture are left out as well, unless they hold the page's only text.
"""

from __future__ import annotations

import html as references
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import cut_lineage

from .tokens import in_arrow

#: A text is template if at least so many different pages of a host, and this share of them, have it in one slot.
LEAST_PAGES = 4
TEMPLATE_SHARE = 0.5
#: Levels of a tree; what lies deeper hangs on the last.
DEPTH = 48
#: Bytes of host models that are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20

# Elements and names of page furniture, and elements that HTML treats in a special way.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript iframe svg canvas object audio video math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var img wbr".split())
FURNITURE = set("head title nav footer aside dialog menu select button textarea input datalist fieldset".split()) | RAW
FURNITURE_NAMES = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer colophon masthead banner ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription social share sharing related recommended recommendations comment "
    "comments commentlist disqus discussion replies respond search login signup widget widgets toolbar pagination pager skip "
    "contentinfo complementary dialog".split())
HEADER_NAMES = {"header", "topbar"}
#: Parts of compound names that say nothing else.
GENERIC_NAMES = set(
    "area articles bar block body bottom box btn button buttons card container content form global group header icon icons inner item items "
    "left links list main module outer page panel post posts primary reader reply right row secondary section site slot stories "
    "thread top unit user wrap wrapper".split())
OPENERS = {"has", "with", "no", "is", "not"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"table", "ul", "ol", "dl", "html", "body"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>", re.S)
# name and value of one attribute after another, so that no name is looked for inside a value or another name
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANK = re.compile(r"\s+")


@dataclass
class Node:
    """A block element with the texts right inside it, each before the child of that number."""

    tag: str
    furniture: bool = False
    weak: bool = False  # furniture, unless the page has its text there
    depth: int = 0
    kids: list["Node"] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)
    shape: str = ""


def _named(attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the attributes of an element mark page furniture, or hide it; and whether only a compound name says so.

    Inside an article a compound name counts only if none of its parts says something else.
    """
    weak = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if parts[0] in OPENERS:
                    continue
                told = [part in FURNITURE_NAMES or part in HEADER_NAMES and not in_article for part in parts]
                if len(parts) == 1 and told[0]:
                    return True, False
                if in_article and not all(t or part in GENERIC_NAMES or part.isdigit() for t, part in zip(told, parts, strict=True)):
                    continue
                weak = weak or told[0] or told[-1]
    return weak, weak


def _plain(node: Node, weak: bool = False) -> int:
    """Characters of text inside `node` but outside all furniture; weak furniture counts if asked for."""
    return sum(len(t.strip()) for _, t in node.texts) + sum(_plain(k, weak) for k in node.kids if not k.furniture and (weak or not k.weak))


def _bounded(node: Node) -> bool:
    """Whether an article or a main element stands in `node`, but in no furniture."""
    return any(not k.furniture and not k.weak and (k.tag in ("article", "main") or _bounded(k)) for k in node.kids)


def _outermost(node: Node) -> list[Node]:
    return [x for k in node.kids if not k.furniture for x in ([k] if k.weak else _outermost(k))]


def settled(root: Node) -> Node:
    """Decide the weak furniture: what holds the page's article, or nearly all of its text where it has none, is content."""
    open_ = _outermost(root)
    if not open_:
        return root
    while open_ and not _bounded(root):
        with_article = [k for k in open_ if _bounded(k) or k.tag in ("article", "main")]
        best = max(with_article or open_, key=lambda k: _plain(k, True))
        if not with_article and _plain(best, True) <= 10 * _plain(root):
            break
        best.weak = False
        open_ = _outermost(root)
    stack = [root]
    while stack:
        node = stack.pop()
        for k in node.kids:
            k.furniture = k.furniture or k.weak or node.furniture
            stack.append(k)
    return root


def parse(page: str) -> Node:
    """The tree of a page. Unclosed and stray tags are mended the way browsers mostly do."""
    root = Node("#page")
    stack: list[tuple[str, Node]] = [("#page", root)]  # all open elements with the block their text goes to
    articles = 0
    at, size = 0, len(page)

    def write(text: str) -> None:
        node = stack[-1][1]
        if node.texts and node.texts[-1][0] == len(node.kids):
            node.texts[-1] = (len(node.kids), node.texts[-1][1] + text)
        elif text:
            node.texts.append((len(node.kids), text))

    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            write(page[at:] if "<" not in page[at:] else re.sub(r"<[/!?a-zA-Z][^>]*\Z", "", page[at:]))
            break
        if token.start() > at:
            write(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if place:
                articles -= sum(t in ("article", "main") for t, _ in stack[place:])
                del stack[place:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in ("br", "hr"):
            stack[-1][1].texts.append((len(stack[-1][1].kids), "\0"))  # a break inside a block
            continue
        if tag in VOID:
            continue
        furniture, weak = tag in FURNITURE or tag == "header" and not articles, tag == "form"
        if tag not in ("html", "body", "main") and not furniture:
            furniture, named = _named(token[3], articles > 0)
            weak = weak and not furniture or named
        if tag in INLINE and not furniture:
            if not token[3].endswith("/"):
                stack.append((tag, stack[-1][1]))
            continue
        closes = CLOSED_BY.get(tag, set()) | {"p"}
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closes:
                articles -= sum(t in ("article", "main") for t, _ in stack[k:])
                del stack[k:]
                break
            if stack[k][0] in SCOPES or stack[k][0] not in INLINE and stack[k][0] != "p" and tag not in CLOSED_BY:
                break
        parent = stack[-1][1]
        if parent.depth >= DEPTH and not furniture and not weak:
            parent.texts.append((len(parent.kids), "\0"))
            stack.append((tag, parent))
        else:
            node = Node(tag, furniture and not weak or parent.furniture, weak, parent.depth + 1)
            parent.kids.append(node)
            stack.append((tag, node))
        articles += tag in ("article", "main")
    return settled(root)


def shaped(node: Node) -> str:
    """The shape of a tree: tags in brackets; furniture counts as one leaf."""
    inside = "" if node.furniture else ",".join(shaped(k) for k in node.kids)
    node.shape = f"{node.tag}({inside})" if inside else node.tag
    return node.shape


def frame(shape: str) -> Node:
    """The tree of a shape, its nodes numbered in `depth` in the order of the page."""
    root = Node("")
    stack, number = [root], 0
    for tag, bracket in re.findall(r"([^(),]*)([(),]?)", shape):
        if tag:
            node = Node(tag, depth=number)
            number += 1
            stack[-1].kids.append(node)
        if bracket == "(":
            stack.append(stack[-1].kids[-1])
        elif bracket == ")":
            stack.pop()
    top = root.kids[0] if root.kids else root
    shaped(top)
    return top


def matching(a: Node, b: Node, known: dict) -> int:
    """Simple tree matching: the most node pairs that keep tags, order and ancestry."""
    if a.tag != b.tag:
        return 0
    if not a.kids or not b.kids:
        return 1
    key = (a.shape, b.shape)
    if key not in known:
        if len(known) > 50_000:
            known.clear()
        known[key] = 1 + _rows(a.kids, b.kids, known)[-1][-1]
    return known[key]


def _rows(left: list[Node], right: list[Node], known: dict) -> list[list[int]]:
    rows = [[0] * (len(right) + 1)]
    for x in left:
        above, row = rows[-1], [0]
        for j, y in enumerate(right):
            row.append(max(above[j + 1], row[j], above[j] + matching(x, y, known)))
        rows.append(row)
    return rows


def align(page: Node, model: Node, slots: dict[int, int], known: dict) -> None:
    """Give the nodes of `page` that match nodes of `model` their numbers. Equal ends of the lists match one to one."""
    slots[id(page)] = model.depth
    left, right = ([] if page.furniture else page.kids), model.kids
    low = 0
    while low < min(len(left), len(right)) and left[low].shape == right[low].shape:
        align(left[low], right[low], slots, known)
        low += 1
    i, j = len(left), len(right)
    while i > low and j > low and left[i - 1].shape == right[j - 1].shape:
        i, j = i - 1, j - 1
        align(left[i], right[j], slots, known)
    left, right = left[low:i], right[low:j]
    rows = _rows(left, right, known)
    i, j = len(left), len(right)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            align(left[i], right[j], slots, known)


def blocks(page: Node, slots: dict[int, int]) -> list[tuple[int, str]]:
    """(slot, text) of the content blocks in page order; where nothing matched, the slot is a number below -2 made from the path.

    If a main element stands outside furniture, or articles do that hold more text than there is outside of them, only
    text inside counts.
    """
    out: list[tuple[int, str, int]] = []  # the last is 1 inside an article, 2 inside a main element, 0 elsewhere

    def walk(node: Node, inside: int, path: int) -> None:
        if node.furniture:
            return
        inside = max(inside, 2 if node.tag == "main" else node.tag == "article")
        path = zlib.crc32(node.tag.encode(), path)
        parts: list[str] = []

        def flush() -> None:
            # breaks end a block; a block of blanks is none
            for text in "".join(parts).split("\0"):
                text = _BLANK.sub(" ", references.unescape(text)).strip()
                if text:
                    out.append((slots.get(id(node), -3 - path % (1 << 30)), text, inside))
            parts.clear()

        texts = iter([*node.texts, (len(node.kids) + 1, "")])
        place, text = next(texts)
        for k in range(len(node.kids) + 1):
            while place == k:
                parts.append(text)
                place, text = next(texts)
            if k < len(node.kids):
                flush()
                walk(node.kids[k], inside, path)
        flush()

    walk(page, 0, 0)
    size = [sum(len(t) for _, t, k in out if k == inside) for inside in range(3)]
    bounded = size[2] > 0 or size[1] > size[0]
    return [(slot, text) for slot, text, inside in out if inside or not bounded]


def bare(node: Node) -> bool:
    """Whether a page has no text outside furniture."""
    return node.furniture or not any(references.unescape(t).strip("\0 \t\n\r\f") for _, t in node.texts) and all(bare(k) for k in node.kids)


def _digest(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) | (zlib.adler32(data) & 0x7FFFFFFF) << 32


def _aligned(page: str, shape: str | None, frames: dict, known: dict) -> list[tuple[int, str]]:
    tree = parse(page)
    shaped(tree)
    slots: dict[int, int] = {}
    if shape:
        if shape not in frames:
            if len(frames) > 1000:
                frames.clear()
            frames[shape] = frame(shape)
        align(tree, frames[shape], slots, known)
    return blocks(tree, slots)


def host(url: Column) -> Column:
    """The host of a URL in lower case; the empty text where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _with_models(pages: DataFrame, models: DataFrame, size: Column) -> DataFrame:
    """Pages with the model of their host; the models are broadcast when their measured size allows it."""
    total = models.agg(F.sum(size)).first()[0] or 0
    models = models.withColumnRenamed("host", "of")
    return pages.join(F.broadcast(models) if total <= BROADCAST_BYTES else models, F.col("host") == F.col("of"), "left").drop("of")


def frames(pages: DataFrame) -> DataFrame:
    """(host, shape): the shape of the page with the least hash among those with content, for each host of (host, url, html)."""

    def run(batches):
        for batch in batches:
            trees = [parse(p or "") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bare(t) for t in trees]), batch.column(1), pa.array([shaped(t) for t in trees])],
                                             ["host", "bare", "h", "shape"])

    rows = pages.select("host", F.xxhash64("url", "html").alias("h"), "html").transform(in_arrow, run, "host string, bare boolean, h long, shape string")
    return rows.groupBy("host").agg(F.min(F.struct("bare", "h", "shape")).alias("m")).select("host", "m.shape")


def templates(pages: DataFrame, models: DataFrame, least_pages: int = LEAST_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """(host, constant): the slot and text of the template blocks of each host, counted over all its pages.

    Pages with the same content blocks count as one, so copies of an article don't make it a template.
    """

    def run(batches):
        shapes, known = {}, {}
        for batch in batches:
            hosts, slots, texts, of = [], [], [], []
            for name, page, shape in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = _aligned(page or "", shape, shapes, known)
                whole = _digest("\n".join(t for _, t in found))
                for slot, text in {(-2, 0), *((s, _digest(t)) for s, t in found)}:  # slot -2 counts the page
                    hosts.append(name)
                    slots.append(slot)
                    texts.append(text)
                    of.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int32()), pa.array(texts, pa.int64()), pa.array(of, pa.int64())], ["host", "slot", "text", "page"])

    rows = _with_models(pages.select("host", "html"), models, F.length("shape")).transform(in_arrow, run, "host string, slot int, text long, page long")
    counts = cut_lineage(rows.distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("n")))
    pages_of = counts.filter("slot = -2").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    constant = counts.filter(F.col("n") >= least_pages).filter("slot != -2").join(pages_of, F.col("host") == F.col("of")).filter(F.col("n") >= share * F.col("pages"))
    # a page has each text of a slot once, so a host has at most as many as 1 / share of its pages have blocks
    return constant.groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("constant"))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", least_pages: int = LEAST_PAGES,
              share: float = TEMPLATE_SHARE) -> DataFrame:
    """`pages` with the main text in the column `out`.

    Character references are decoded, blanks inside a block become one, blocks are joined by one blank in page order.
    Template blocks are left out; pages with equal content count as one, so copies of one article are no template.

    Null and empty html and pages without content: the empty text. Null url or none with a host: pages of one unnamed
    host. Very long pages are read whole, very deep ones flattened. Repeated rows get equal texts; an empty table
    gives no rows. Other columns pass through; a column `out` of `pages` is replaced.
    """
    rows = pages.drop(out) if out not in (url, html) else pages
    keyed = rows.select(F.struct("*").alias("row"), host(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.col(f"`{html}`").alias("html"))
    shapes = cut_lineage(frames(keyed))
    constant = templates(keyed, shapes, least_pages, share)
    models = cut_lineage(shapes.join(constant, "host", "left"))
    size = F.length("shape") + 16 * F.coalesce(F.size("constant"), F.lit(0))
    joined = _with_models(keyed.select("row", "host", "html"), models, size).select("row", "html", "shape", "constant")
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("found", T.StringType())])

    def run(batches):
        shapes, known = {}, {}
        for batch in batches:
            texts = []
            for page, shape, constant in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                found = _aligned(page or "", shape, shapes, known)
                fixed = {(c["slot"], c["text"]) for c in constant or ()}
                vary = [t for s, t in found if (s, _digest(t)) not in fixed] if fixed else [t for _, t in found]
                texts.append(" ".join(vary))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "found"])

    done = joined.transform(in_arrow, run, schema)
    return done.select(*[F.col("row")[c].alias(c) for c in rows.columns], F.col("found").alias(out))
