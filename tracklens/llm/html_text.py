"""Main text of web pages: role rules plus removal of element subtrees that recur across a site's pages."""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import stored

#: A subtree is a template if it is in so many pages of its host, and in such a share of them.
MIN_PAGES = 10
MIN_SHARE = 0.3
#: The share of a host's distinct declared articles from which on a paragraph, heading or list item in them is a template; other blocks need MIN_SHARE.
PROSE_SHARE = 0.8
#: Template keys that may be sent to all executors (8 bytes each); beyond, they are joined.
MAX_BROADCAST = 1_000_000

# Element names of HTML, by what they are to a reader.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
DROPPED = ("head", "nav", "aside", "form", "footer", "button", "select", "svg", "menu", "dialog", "object", "canvas", "audio", "video", "math", *RAW)
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img")
#: Blocks that carry an article's own words.
PROSE = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "tr", "td", "th", "figcaption")
#: An element that holds more than this share of a page's text isn't chrome by its class, nor is a form.
MOST = 0.7
#: Words in class, id or role that mark chrome around an article.
CHROME = ("ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget")
#: Words that such a word may be joined with by a hyphen or underscore; joined with others ("has-sidebar", "entry-header") it marks something else.
JOINED = ("area", "bar", "block", "bottom", "box", "buttons", "container", "global", "inner", "left", "links", "list", "main", "posts", "right", "section", "site", "slot", "thread", "top", "unit", "wrap", "wrapper")
#: Elements that one may leave open, and those whose start closes them.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_ENDERS = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "words", "kids")

    def __init__(self, tag: str, words: frozenset[str] = frozenset()):
        self.tag, self.words, self.kids = tag, words, []


def parse(page: str) -> Node:
    """A tolerant element tree; text children are str, with references still encoded."""
    root = Node("#root")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # where the open elements of each name are in the stack

    def deepest(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        """End the innermost open element of ``tags``, and all in it, unless one of ``barrier`` is between."""
        depth = deepest(tags)
        if depth > deepest(barrier):
            for node in stack[depth:]:
                places[node.tag].pop()
            del stack[depth:]

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or (at == len(page) and page[-1] != ">"):
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        if m[1]:
            close((tag,))
            continue
        if tag in CLOSES and tag != "p":
            close(CLOSES[tag], ("ul", "ol", "dl", "table", "select", "menu"))
        if tag in P_ENDERS:
            close(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "body", "main", "button", "object"))
        attrs = " ".join(v[1] or v[2] or v[3] for v in _ATTR.findall(m[3])).lower() if m[3] else ""
        node = Node(tag, frozenset(attrs.split()) if attrs else frozenset())
        stack[-1].kids.append(node)
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def _marks(token: str) -> bool:
    parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
    return any(x in CHROME for x in parts) and all(x in CHROME or x in JOINED or x.isdigit() for x in parts)


def chrome(node: Node, in_article: bool) -> bool:
    """Whether an element's name or role says that it isn't article text."""
    if node.tag in DROPPED or (node.tag == "header" and not in_article):
        return True
    return node.tag not in ("html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6") and any(map(_marks, node.words))


def _main(node: Node) -> bool:
    return node.tag == "main" or (node.tag == "div" and any("main" in re.split(r"[^a-z0-9]+", x) and not _marks(x) for x in node.words))


def _wraps(root: Node, holders: bool) -> set[int]:
    """Elements that aren't chrome by class, nor as forms, as they hold most of the page's text; with ``holders`` also those that hold a declared article."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node) and k.tag not in RAW and k.tag != "head"]
    size: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(order):
        size[id(node)] = sum(size.get(id(k), 0) if isinstance(k, Node) else len("".join(k.split())) for k in node.kids)
        if node.tag == "article" or _main(node) or any(id(k) in holds for k in node.kids):
            holds.add(id(node))
    return {id(n) for n in order if (n.tag == "form" or n.tag not in DROPPED) and (size[id(n)] > MOST * size[id(root)] or (holders and id(n) in holds))}


def articles(root: Node) -> list[Node]:
    """The outermost declared articles, else the declared main parts; empty if the page has none.

    Those in chrome count only if no others are declared and the chrome is a wrapper of the page.
    """
    kept: set[int] = set()
    for again in (False, True):
        if again:
            kept = _wraps(root, False)
        for tag in ("article", "main"):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.tag == tag or (tag == "main" and _main(node)):
                    found.append(node)
                    continue
                todo += [k for k in reversed(node.kids) if isinstance(k, Node) and (id(k) in kept or not chrome(k, False))]
            if found:
                return found
    return []


def _key(host: str, parts: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join([host.encode(), *parts]), digest_size=8).digest(), "little", signed=True)


#: Where a subtree is: outside of declared articles, a block in them, prose in them.
OUTSIDE, BLOCK, TEXT = 0, 1, 2


def subtrees(root: Node, host: str) -> tuple[dict[int, tuple[int, int]], int | None]:
    """id(node) -> key of its host, place, names, roles and text, and its place; and a key of all declared articles.

    Outside of declared articles each element has a key, in them each block but the
    article itself. Keys of the two never meet, so a page's own words aren't taken for
    the chrome that quotes them.
    """
    own = {id(n) for n in articles(root)}
    out: dict[int, tuple[int, int]] = {}
    digest: dict[int, bytes] = {}
    declared: list[bytes] = []
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, done, inside = todo.pop()
        if not done:
            todo.append((node, True, inside))
            todo += [(k, False, inside or id(node) in own) for k in reversed(node.kids) if isinstance(k, Node)]
            continue
        parts = [node.tag.encode(), " ".join(sorted(node.words)).encode()]
        parts += [digest[id(k)] if isinstance(k, Node) else " ".join(k.split()).encode() for k in node.kids]
        made = hashlib.blake2b(b"\0".join(parts), digest_size=12).digest()
        if id(node) in own:
            declared.append(made)
            made = b"article"
        elif inside:
            if node.tag not in INLINE and node.tag not in VOID:
                out[id(node)] = _key(host, [b"inside", made]), TEXT if node.tag in PROSE else BLOCK
        elif node.tag not in ("#root", "html", "body"):
            out[id(node)] = _key(host, [made]), OUTSIDE
        digest[id(node)] = made
    return out, _key(host, declared) if declared else None


def text_of(root: Node, removed: set[int]) -> str:
    """Text of the declared articles, else of the whole page, without chrome and ``removed`` nodes."""
    found = articles(root)
    kept = set() if found else _wraps(root, True)
    out: list[str] = []
    todo: list = [(n, bool(found)) for n in reversed(found or [root])]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        node, inside = item
        block = node.tag not in INLINE
        if block:
            out.append(" ")
        if node.tag in VOID:
            continue
        if block:
            todo.append(" ")
        for kid in reversed(node.kids):
            if isinstance(kid, str):
                todo.append(html_lib.unescape(kid))
            elif id(kid) not in removed and (id(kid) in kept or not chrome(kid, inside)):
                todo.append((kid, inside))
    return " ".join("".join(out).split())


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def template_keys(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Keys of subtrees that recur across a host's pages. Each page counts a key once; counts are partial sums.

    In declared articles, distinct articles count instead of pages: copies of an article
    are no evidence that its parts are chrome.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple[str, int | None, int, int | None]] = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                host = host_of(url)
                got, article = subtrees(parse(page.as_py() or ""), host)
                rows += [(host, key, place, None if place == OUTSIDE else article) for key, place in {*got.values()}]
                rows.append((host, None, OUTSIDE, None))  # rows without a key count the page and the article themselves
                if article is not None:
                    rows.append((host, None, BLOCK, article))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds, strict=True)], names=["host", "key", "place", "article"])

    each = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "host string, key long, place int, article long").groupBy("host", "key", "place", "article").agg(F.count("*").alias("n"))
    n = each.groupBy("host", "key", "place").agg(F.sum(F.when(F.col("article").isNull(), F.col("n")).otherwise(1)).alias("n")).filter((F.col("n") >= min_pages) | F.col("key").isNull())
    n = stored(n.withColumn("outside", F.col("place") == OUTSIDE), "subtrees")  # read twice, and a small part of the pages
    total = n.filter("key is null").select("host", "outside", F.col("n").alias("all"))
    share = F.when(F.col("place") == TEXT, F.lit(max(min_share, PROSE_SHARE))).otherwise(F.lit(min_share))
    return n.filter("key is not null").join(total, ["host", "outside"]).filter(F.col("n") >= F.col("all") * share).select("key")


def _extract(with_keys: bool, fixed: np.ndarray | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, urls = batch.column(0), batch.column(1)
            page_keys = batch.column(3).to_pylist() if with_keys else None
            texts = []
            for i, (url, page) in enumerate(zip(urls.to_pylist(), batch.column(2), strict=True)):
                root = parse(page.as_py() or "")
                removed: set[int] = set()
                if page_keys is not None or (fixed is not None and len(fixed)):
                    own = {n: k for n, (k, _) in subtrees(root, host_of(url))[0].items()}
                    if page_keys is not None:
                        known = set(page_keys[i] or ())
                        removed = {n for n, k in own.items() if k in known}
                    elif own:
                        keys = np.fromiter(own.values(), np.int64, len(own))
                        at = np.minimum(np.searchsorted(fixed, keys), len(fixed) - 1)
                        removed = {n for n, hit in zip(own, fixed[at] == keys, strict=True) if hit}
                texts.append(text_of(root, removed))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Main text per page row.

    First pass: subtrees are hashed and counted per host. Second pass: template
    subtrees, chrome by name or role, and markup go; blocks are joined by spaces. Up to
    ``max_broadcast`` template keys are sent to the executors; beyond, each page's own
    template keys are joined to it. Null or empty html gives empty text; a null url is
    a host of its own; repeated rows give repeated rows; an empty table gives no rows;
    other columns are not read.
    """
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    out = "page_id long, url string, text string, n_chars long"
    templates = template_keys(base, min_pages, min_share)
    few = [r[0] for r in templates.limit(max_broadcast + 1).collect()]
    if len(few) <= max_broadcast:
        return base.mapInArrow(_extract(False, np.sort(np.array(few, np.int64))), out)

    def own_keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(i, k) for i, u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) for k, _ in {*subtrees(parse(p.as_py() or ""), host_of(u))[0].values()}]
            row, key = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.int64())], names=["row_key", "key"])

    keyed = base.withColumn("row_key", F.xxhash64("page_id", "url", "html"))
    sliced = templates.select("key", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    held = keyed.select("row_key", "url", "html").dropDuplicates(["row_key"]).mapInArrow(own_keys, "row_key long, key long").withColumn("salt", F.pmod("row_key", F.lit(32)).cast("int"))
    wanted = held.join(sliced, ["key", "salt"]).groupBy("row_key").agg(F.collect_set("key").alias("keys"))
    return keyed.join(wanted, "row_key", "left").select("page_id", "url", "html", "keys").mapInArrow(_extract(True, None), out)
