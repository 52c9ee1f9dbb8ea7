"""Main text of web pages: what a site repeats, and what is no article by its markup, goes.

Template removal: each element subtree is hashed bottom-up, Spark counts for every host on how
many different pages a hash occurs, and subtrees on many pages of their host are deleted before
the text is read. Pages whose bodies are equal count as one, so copies of a page never make its
own paragraphs a template. Inside an element marked as the article or the main part it is the
different articles that count, and a subtree goes only if what stands beside it differs as
well: the paragraphs of an article and of its edited copies stay.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_apart, is_empty, stage

#: A subtree is a template from this many different pages (inside articles: different articles) of its host on.
LEAST_PAGES = 5
#: Inside articles it must have so many different surroundings for each article that holds it, whatever the host's size.
UNLIKE = 0.25
#: Keys that a template's pages are dealt to.
SALTS = 16

#: Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NO_ARTICLE = frozenset(
    "script style noscript template head title nav header footer aside form button select textarea input label fieldset iframe"
    " object embed svg canvas audio video menu dialog noembed noframes xmp".split()
)
CONTENT = frozenset(("article", "main"))
#: Words that mark what is no article. A name in class, id or role says so if all its parts are such words
#: or ``_NEUTRAL`` ones, with one of the former at least: "cookie-notice" and "site-footer" do, "share-price",
#: "notice-board-history" and "with-sidebar" don't.
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense banner promo promoted promotion sponsor sponsored sponsors"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo"
    " comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended widget search pagination pager toolbar copyright".split()
)
_NEUTRAL = frozenset(
    "all area article articles bar block blocks bottom box btn button buttons col column container content count each first floating form global"
    " group holder icon icons inner item items last layer left link links list lists main message messages outer page panel post posts primary"
    " right row secondary section sections site slot slots small social sticky stories strip text thread title top unit units user widget widgets wrap wrapper".split()
)
#: Elements deeper than this become their parent's siblings, as in browsers; it bounds every walk up.
DEEPEST = 512
#: An opening tag of the key ends an open element of these kinds.
_P_ENDERS = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "option": ("option",), "body": ("head",)}
_SCOPES = frozenset("table ul ol dl select body html article main section div".split())

_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: A quote opens a string only right after an equals sign, and only if it is closed somewhere.
_ATTRS = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+")
_ENDS = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}
_MARK = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-z]+")


_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}


class Node:
    """An element; ``parts`` holds its texts and elements in page order."""

    __slots__ = ("tag", "off", "parts")

    def __init__(self, tag: str, off: bool = False):
        self.tag, self.off, self.parts = tag, off, []


@lru_cache(1 << 14)
def _says_no_article(name: str) -> bool:
    parts = _NAME.findall(name)
    return not _BOILERPLATE.isdisjoint(parts) and all(x in _BOILERPLATE or x in _NEUTRAL for x in parts)


def _is_off(tag: str, attrs: str) -> bool:
    """Whether an element is no article by its own tag or attributes."""
    if tag in NO_ARTICLE:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, value in _MARK.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            if any(map(_says_no_article, value.split())):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def parse(page: str) -> Node:
    """A tree from tag soup: omitted end tags are filled in, stray ones skipped. Takes time in proportion to the page.

    A tag ends at the first ">" outside quoted values. A quote that isn't closed is the last of its
    kind on the page, so looking for its end in vain happens once for each kind.
    """
    root = Node("html")
    stack, open_ = [root], Counter()
    at, last = 0, page.rfind(">")

    def shut(i: int) -> None:
        open_.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def say(text: str) -> None:
        if text:
            stack[-1].parts.append(entities.unescape(text) if "&" in text else text)

    while m := _START.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            end = page.find(_ENDS[m[0]], at)
            at = len(page) if end < 0 else end + len(_ENDS[m[0]])
            continue
        if at > last:  # nothing ends the tag: it is text
            say(m[0])
            continue
        end = _ATTRS.match(page, at).end()
        if page[end : end + 1] != ">":  # the last ">" stands in a quoted value
            end = page.find(">", at)
        attrs, at = page[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                _close(stack, tag, shut)
            continue
        if tag == "html":
            continue
        if tag in _P_ENDERS and open_["p"] > 0:
            _end(stack, ("p",), shut)
        if tag in _SIBLINGS:
            _end(stack, _SIBLINGS[tag], shut)
        node = Node(tag, _is_off(tag, attrs))
        stack[-1].parts.append(node)
        if tag in RAW:
            found = _RAW_ENDS[tag].search(page, at)
            node.parts.append(page[at : found.start() if found else len(page)])
            at = found.end() if found else len(page)
        elif tag not in VOID and not attrs.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
            open_[tag] += 1
    say(page[at:])
    return root


def _end(stack: list[Node], tags: tuple[str, ...], shut) -> None:
    """Close the innermost open element of these kinds, unless a wider one stands between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            shut(i)
            return
        if stack[i].tag in _SCOPES:
            return


def _close(stack: list[Node], tag: str, shut) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            shut(i)
            return
        if stack[i].tag in CONTENT and tag not in BLOCKS:
            return


def candidates(root: Node) -> dict[int, tuple[int, int | None, int | None]]:
    """id(element) -> (hash of its tag, texts and subtrees, article's hash, surroundings), for what may be a template.

    These are the block elements with something in them that hold no article proper and are none.
    The article is the outermost one around, or else the main part, or None; its surroundings are the
    smallest hash of a text there that the element does not hold. By an explicit stack, as pages can
    nest deeply.
    """
    holds: set[int] = set()
    order: list[tuple[Node, Node | None, int]] = []
    todo: list = [(root, None, None)]
    above: dict[int, int | None] = {}
    while todo:
        node, parent, inside = todo.pop()
        above[id(node)] = parent
        order.append((node, inside, len(order)))
        if node.tag in CONTENT and not node.off:
            while parent is not None and parent not in holds:
                holds.add(parent)
                parent = above[parent]
            if inside is None or inside.tag == "main" and node.tag == "article":
                inside = node
        todo += [(p, id(node), inside) for p in reversed(node.parts) if isinstance(p, Node)]
    hashes: dict[int, int] = {}
    ends: dict[int, int] = {}
    leaf: list[int | None] = [None] * len(order)
    said_something: set[int] = set()
    for node, _, at in reversed(order):  # children come before their parents
        said = [str(hashes[id(p)]) if isinstance(p, Node) else p.strip() for p in node.parts]
        said = [x for x in said if x]
        digest = blake2b("\x1f".join([node.tag, *said]).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        hashes[id(node)] = int.from_bytes(digest, "big", signed=True)
        ends[id(node)] = max((ends[id(p)] for p in node.parts if isinstance(p, Node)), default=at + 1)
        if any(not isinstance(p, Node) and p.strip() for p in node.parts):
            leaf[at] = hashes[id(node)]
        if said:
            said_something.add(id(node))
    begins = {id(node): at for node, _, at in order}
    sides: dict[int, tuple[list, list]] = {}
    out: dict[int, tuple[int, int | None, int | None]] = {}
    for node, inside, at in order:
        if id(node) in holds or id(node) not in said_something or node.tag not in BLOCKS or node.tag in ("html", "body"):
            continue
        if inside is None:
            if node.tag not in CONTENT or node.off:
                out[id(node)] = hashes[id(node)], None, None
            continue
        if inside.tag == "main" and node.tag == "article" and not node.off:
            continue
        a, b = begins[id(inside)], ends[id(inside)]
        if id(inside) not in sides:
            sides[id(inside)] = _least(leaf[a:b]), _least(leaf[a:b][::-1])
        before, after = sides[id(inside)]
        beside = [x for x in (before[at - a], after[b - ends[id(node)]]) if x is not None]
        out[id(node)] = hashes[id(node)], hashes[id(inside)], min(beside, default=0)
    return out


def _least(values: list[int | None]) -> list[int | None]:
    """The least of the first 0, 1, 2, ... values."""
    out: list[int | None] = [None]
    for x in values:
        out.append(out[-1] if x is None or out[-1] is not None and out[-1] < x else x)
    return out


def blocks_of(root: Node, trees: dict[int, tuple]) -> list[tuple[str, list[int]]]:
    """The blocks that markup leaves, each with single spaces, and the hashes of the ``trees`` around it.

    Where classes would leave nothing of a page, its tags alone decide.
    """
    content = _content_roots(root)
    return _blocks(content, trees, False) or _blocks(content, trees, True)


def _blocks(content: list[Node], trees: dict[int, tuple], tags_only: bool) -> list[tuple[str, list[int]]]:
    blocks: list[tuple[str, list[int]]] = []
    line: list[str] = []
    around: list[int] = []

    def flush() -> None:
        if words := " ".join("".join(line).split()):
            blocks.append((words, list(around)))
        line.clear()

    for top in content:
        todo: list = [top]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                line.append(part)
            elif isinstance(part, tuple):
                flush()
                if part[0]:
                    around.pop()
            elif part.off and part not in content and (not tags_only or part.tag in NO_ARTICLE):
                if part.tag in BLOCKS:
                    flush()
            elif part.tag == "br":
                line.append(" ")
            elif part.tag in BLOCKS:
                flush()
                tree = trees.get(id(part))
                if tree is not None:
                    around.append(tree[0])
                todo.append((tree is not None,))
                todo += reversed(part.parts)
            else:
                todo += reversed(part.parts)
        flush()
    return blocks


def main_text(page: str, templates: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given its host's templates."""
    root = parse(page)
    return "\n\n".join(text for text, trees in blocks_of(root, candidates(root)) if templates.isdisjoint(trees))


def _content_roots(root: Node) -> list[Node]:
    """The outermost articles, else the main parts, else the whole page.

    Where all of them stand in elements whose classes say no article (a wrapper may be named
    after its sidebar), these elements are looked into as well.
    """
    for inside in (False, True):
        for wanted in ("article", "main"):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.off and (not inside or node.tag in NO_ARTICLE or node.tag in CONTENT):
                    continue
                if node.tag == wanted:
                    found.append(node)
                else:
                    todo += reversed([p for p in node.parts if isinstance(p, Node)])
            if found:
                return found
    return [root]


def host_of(url: str = "url"):
    """The lower-cased host of a URL column; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_templates(seen: DataFrame, least_pages: int = LEAST_PAGES, unlike: float = UNLIKE) -> DataFrame:
    """``seen(host, body, found)`` -> ``(host, tree)``, a row for each template of a host."""
    one = seen.select("host", "body", F.explode("found").alias("x"))
    # equal pages have equal subtrees, and count once as equal articles do
    once = one.groupBy("host", F.col("x.tree").alias("tree"), F.coalesce("x.article", "body").alias("page"), F.col("x.article").isNull().alias("free"))
    places = once.agg(F.min(F.coalesce("x.beside", "body")).alias("beside"))
    # counts are combined before they move
    alike = places.groupBy("host", "tree", "free", "beside").agg(F.count(F.lit(1)).alias("n"))
    counts = alike.groupBy("host", "tree").agg(
        F.sum(F.when(F.col("free"), F.col("n")).otherwise(0)).alias("free"), F.sum(F.when(F.col("free"), 0).otherwise(F.col("n"))).alias("articles"), F.sum(F.when(F.col("free"), 0).otherwise(1)).alias("unlike"),
    )
    inside = F.when(F.col("unlike") >= unlike * F.col("articles"), F.col("unlike")).otherwise(0)
    return counts.where(F.col("free") + inside >= least_pages).select("host", "tree")


def _body(html: str) -> int:
    return int.from_bytes(blake2b(html.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def subtrees(pages: DataFrame) -> DataFrame:
    """``pages(html, host)`` -> ``(host, body, found)``: the page's subtrees; ``open`` ones have text of the article in them."""
    kind = pa.struct([("tree", pa.int64()), ("article", pa.int64()), ("beside", pa.int64()), ("open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, out = [], []
            for html in b.column(0).to_pylist():
                html = html or ""
                root = parse(html)
                trees = candidates(root)
                open_ = {t for _, around in blocks_of(root, trees) for t in around}
                bodies.append(_body(html))
                out.append([{"tree": t, "article": a, "beside": x, "open": t in open_} for t, a, x in set(trees.values())])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(bodies, pa.int64()), pa.array(out, pa.list_(kind))], ["host", "body", "found"])

    return pages.select("html", "host").mapInArrow(run, "host string, body long, found array<struct<tree long, article long, beside long, open boolean>>")


def page_blocks(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, host)`` -> ``(page_id, url, host, body, blocks)``, each block with the subtrees around it."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("trees", pa.list_(pa.int64()))]))
    names = ["page_id", "url", "host", "body", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, out = [], []
            for html in b.column(2).to_pylist():
                html = html or ""
                root = parse(html)
                bodies.append(_body(html))
                out.append([{"text": t, "trees": x} for t, x in blocks_of(root, candidates(root))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(bodies, pa.int64()), pa.array(out, kind)], names)

    return pages.select("page_id", "url", "html", "host").mapInArrow(run, "page_id long, url string, host string, body long, blocks array<struct<text string, trees array<long>>>")


def template_hits(seen: DataFrame) -> DataFrame:
    """``seen(host, body, found)`` -> ``(host, body, hits array<long>)``: the templates that stand around text of a page."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    templates = host_templates(seen).withColumn("salt", salts)
    own = seen.select("host", "body", F.explode(F.filter("found", lambda x: x["open"])).alias("x"))
    own = own.select("host", "body", F.col("x.tree").alias("tree"), F.pmod("body", F.lit(SALTS)).cast("int").alias("salt"))
    return own.join(templates, ["host", "tree", "salt"]).groupBy("host", "body").agg(F.collect_set("tree").alias("hits"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row for each input row whatever its other columns are.

    A null html counts as empty and gives the empty text; pages without a host share one. Pages are
    parsed once for the subtrees' hashes and again for the text, so that no text is written between.
    """
    rows = columns_apart(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    rows = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host_of())
    hits = stage(template_hits(stage(subtrees(rows), "subtrees")), "hits")
    blocks = page_blocks(rows)
    if is_empty(hits):
        kept = F.col("blocks")
    else:
        blocks = blocks.join(hits, ["host", "body"], "left")
        kept = F.when(F.col("hits").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.arrays_overlap(b["trees"], F.col("hits"))))
    return blocks.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
