"""Main text of web pages with a site style tree.

Pass 1 parses every page and lays its block elements into its host's style tree: a node is a path of element
names and classes, and holds how often each content (hash of the text below it) and each presentation (hash of the names
of its children) was seen.  The tree is an aggregate over (host, node, feature), never one object.  Pages of a host with the
same main text are copies and count as one page: repeated rows and mirrors make no template.

Importance.  A node's is the larger of its two entropies over the host's pages, to the base of their number: near 1 where
every page differs, 0 where all are alike.  A content's falls with its share of the host's pages.  Both are smoothed with
``PRIOR`` pages on which everything differs, so a host of few pages keeps more and one page keeps all.  In a page a leaf block is as
important as the lesser of its node and content; an inner block mixes its own importance with the mean of its children's by
length, its own counting more the more children it has.

Pass 2 drops from every page the branches of an importance under ``LEAST_IMPORTANCE``.  What a name says only lowers
importance (``NAMED``): by how much depends on whether a class or id consists of such words alone, with words of layout, or
with others too; so do places outside ``article`` and ``main`` (``OUTSIDE``) and blocks that are mostly links there
(``LINKED``).  Elements and roles that HTML defines as something other than content (menus, forms, scripts, page headers and
footers, asides) have none.  ``article``, ``main`` and what holds them always stay.  If a page has them and they hold
at least ``MAIN_SHARE`` of what is left, the text is taken from them, else from the whole page.

Defined results: null or empty html has an empty text; a null or unparsable address is a host without a tree; broken or
cut markup is read as far as it goes, in time proportional to its length; repeated rows each come out; texts of any length and
depth are read whole; an empty table gives an empty result; only the three named columns are read, so others' names cannot clash.
"""

from __future__ import annotations

import contextlib
import gc
import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redliner.llm.common import Staged

PRIOR, CONTENT_PRIOR, LEAST_IMPORTANCE = 4.0, 2.0, 0.35
#: Factors of importance: by names (noise words alone, with layout words, with others), outside the article, mostly links.
NAMED, OUTSIDE, LINKED, LINK_SHARE, LEVEL, MAIN_SHARE = (0.2, 0.4, 0.6), 0.8, 0.5, 0.6, 0.9, 0.2
#: Nodes and contents on this share of a host's pages go to its pages in one list a host; rarer ones are joined to the pages that hold them.
COMMON_SHARE = 0.01
#: What ``style_tree`` shows is of less importance than this.
TOLD = 0.7
#: Hosts whose lists a task keeps as dictionaries.
HOSTS_KEPT = 64
#: A tree of at most so many bytes is broadcast to the pages; a larger one is joined by host.
BROADCAST_BYTES = 16 << 20
#: HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
NOISE_ELEMENTS = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe input map menu nav noscript object script select style "
    "svg template textarea title video".split()
)
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright discussion disqus dropdown footer gdpr legal login masthead menu modal nav navbar navigation newsletter "
    "notice notification outbrain pager pagination popup promo promoted recommended related replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget".split()
)
LAYOUT_WORDS = frozenset(
    "area bar bottom box button buttons col column container content footer global group header inner item items left link links list main "
    "outer page panel post primary right row section secondary site slot top unit wrap wrapper".split()
)
#: A start tag here closes an open element of the set, up to the nearest bound.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "classes", "children", "weight", "main", "holds")

    def __init__(self, tag: str, classes: str = "", weight: float = 1.0):
        self.tag, self.classes, self.weight = tag, classes, weight
        self.children: list = []
        self.main = tag in ("article", "main")
        self.holds = False  # an article or main element below

    @property
    def noise(self) -> bool:
        return self.weight == 0


def _named(name: str) -> float:
    """The factor of one class or id."""
    words = {w.lower() for w in _NAME_PARTS.findall(name)}
    if not words & NOISE_WORDS:
        return 1.0
    other = words - NOISE_WORDS
    return NAMED[0] if not other else NAMED[1] if other <= LAYOUT_WORDS else NAMED[2]


def _element(tag: str, attributes: str, inside_main: bool) -> Node:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        found.setdefault(name.lower(), value.strip("\"'"))
    classes = found.get("class", "")
    if (
        tag in NOISE_ELEMENTS
        or tag == "header" and not inside_main
        or found.get("role", "").lower() in NOISE_ROLES
        or found.get("aria-hidden", "").lower() == "true"
        or "hidden" in found
    ):
        return Node(tag, classes, 0.0)
    if tag in ("html", "body", "main", "article"):
        return Node(tag, classes)
    return Node(tag, classes, min((_named(x) for x in [*classes.split(), found.get("id", "")]), default=1.0))


def _tag_end(html: str, at: int, closed: dict[str, bool]) -> int:
    """The place of the ``>`` that ends a tag, past quoted values; -1 if there is none.  A quote that is closed nowhere is a sign like others."""
    end = html.find(">", at)
    while end >= 0:
        quote, i = "", at
        while i < end:  # is the sign inside a quoted value?
            marks = [k for k in (html.find('"', i, end), html.find("'", i, end)) if k >= 0]
            if not marks:
                break
            quote = html[min(marks)]
            i = html.find(quote, min(marks) + 1, end) + 1
            if not i:
                break
            quote = ""
        if not quote or not closed[quote]:
            return end
        close = html.find(quote, end)
        if close < 0:
            closed[quote] = False
            return end
        at, end = close + 1, html.find(">", close + 1)
    return -1


def parse(html: str) -> Node:
    """The page as a tree; text is still undecoded.  Every sign is looked at a bounded number of times."""
    root = Node("#root")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # where in the stack the elements of a name are open
    blocks = [0]  # where the block elements are
    inside, closed = 0, {'"': True, "'": True}  # open article and main elements; whether a later quote can close one

    def close(to: int) -> None:
        nonlocal inside
        for node in reversed(stack[to:]):
            inside -= node.main
            places[node.tag].pop()
            if node.tag in BLOCK:
                blocks.pop()
        del stack[to:]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(piece)

    while True:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            return root
        sign = html[start + 1 : start + 2]
        if html.startswith("<!--", start) or html.startswith("<![CDATA[", start):
            text(html[at:start])
            stop = "-->" if sign == "!" and html[start + 2] == "-" else "]]>"
            end = html.find(stop, start + 4)
            if end < 0:
                return root
            at = end + 3
            continue
        if sign in ("!", "?"):
            text(html[at:start])
            end = html.find(">", start)
            if end < 0:
                return root
            at = end + 1
            continue
        closing = sign == "/"
        m = _NAME.match(html, start + 1 + closing)
        if m is None:  # a sign of the text
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        end = _tag_end(html, m.end(), closed)
        if end < 0:  # an unfinished tag at the end of a cut page is no text
            return root
        at, tag, attributes = end + 1, m[0].lower(), html[m.end() : end]
        if closing:
            if places.get(tag) and (tag in BLOCK or places[tag][-1] > blocks[-1]):  # an inline end tag does not close blocks
                close(places[tag][-1])
            continue
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            if found is None:
                return root
            at = html.find(">", found.start()) + 1 or len(html)
            continue
        if tag in BLOCK and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in CLOSES:
            shut, bounds = CLOSES[tag]
            while (k := last(shut)) > last(bounds):
                close(k)
        node = _element(tag, attributes, inside > 0)
        stack[-1].children.append(node)
        if node.main:
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
            inside += node.main


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _walk(root: Node):
    """Depth first: (node, path hash, True) going in, (node, path hash, False) coming out, (text, None, None) between."""
    todo: list = [(root, "", True)]
    while todo:
        node, path, entering = todo.pop()
        if isinstance(node, str):
            yield node, None, None
            continue
        yield node, path, entering
        if entering:
            todo.append((node, path, False))
            for child in reversed(node.children):
                if isinstance(child, str):
                    todo.append((child, None, None))
                else:
                    name = f"{path[-16:]}>{child.tag}.{child.classes}" if child.tag in BLOCK else path
                    todo.append((child, xxhash.xxh3_64_hexdigest(name) if child.tag in BLOCK else path, True))


def _content(parts: list[str | bytes]) -> bytes:
    """The hash of a block's text pieces and of the contents of the blocks inside it; empty without any."""
    found, run = [], []
    for part in [*parts, b""]:
        if isinstance(part, str):
            run.append(part)
            continue
        if run and (text := _clean(run)):
            found.append(text.encode("utf-8", "replace"))
        run = []
        if part:
            found.append(part)
    return xxhash.xxh3_64_digest(b"\0".join(found)) if found else b""


def features(root: Node) -> list[tuple[int, int, int]]:
    """Of every block element that is not noise by itself: node, content hash, presentation hash."""
    out = []
    opened: list[list[str | bytes]] = []
    skip = 0
    for node, path, entering in _walk(root):
        if path is None:
            if not skip and opened:
                opened[-1].append(node)
            continue
        if entering:
            skip += node.noise
            if node.tag in BLOCK:
                opened.append([])
            continue
        if node.tag in BLOCK:
            content = _content(opened.pop())
            if opened:
                opened[-1].append(content)
            if not skip and path and content:
                shape = " ".join(c.tag for c in node.children if not isinstance(c, str))
                out.append((_signed(path.encode()), int.from_bytes(content, "big", signed=True), _signed(shape.encode())))
        skip -= node.noise
    return out


def _signed(x: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(x)
    return h - (1 << 64) if h >= 1 << 63 else h


Tree = tuple[dict[int, float], dict[tuple[int, int], float]]
_NO_TREE: Tree = ({}, {})


def main_text(html: str | None, tree: Tree = _NO_TREE) -> str:
    """The page's blocks, one a line, less those of low importance under its host's tree (importance by node and by node and content)."""
    return _main_text(parse(html or ""), tree)


def _main_text(root: Node, tree: Tree) -> str:
    drop = _dropped(root, tree)
    mass = [0, 0]  # what is left outside and inside article and main elements
    inside = skip = 0
    for node, path, entering in _walk(root):
        if path is None:
            mass[inside > 0] += 0 if skip else len(node.strip())
            continue
        skip += (1 if entering else -1) * (id(node) in drop)
        inside += (1 if entering else -1) * node.main
    only_main = mass[1] > 0 and mass[1] >= MAIN_SHARE * sum(mass)
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            if text := _clean(parts):
                blocks.append(text)
            parts.clear()

    for node, path, entering in _walk(root):
        if path is None:
            if not skip and (inside or not only_main):
                parts.append(node)
            continue
        if node.tag in BLOCK:
            flush()
        elif node.tag == "br" and entering:
            parts.append(" ")
        step = 1 if entering else -1
        skip += step * (id(node) in drop)
        inside += step * node.main
    flush()
    return "\n".join(blocks)


class _Open:
    """An open block: its content, its size and what of it is links, and its children's importance by length."""

    __slots__ = ("parts", "size", "linked", "children", "weighed", "importance")

    def __init__(self):
        self.parts: list[str | bytes] = []
        self.size = self.linked = self.children = self.weighed = 0
        self.importance = 0.0


def _dropped(root: Node, tree: Tree) -> set[int]:
    """The nodes to leave out."""
    by_node, by_content = tree
    out: set[int] = set()
    opened: list[_Open] = []
    inside = in_link = skip = 0
    for node, path, entering in _walk(root):
        if path is None:
            if not skip and opened:
                size = len(node.strip())
                if by_content:
                    opened[-1].parts.append(node)
                opened[-1].size += size
                opened[-1].linked += size if in_link else 0
            continue
        if entering:
            if node.noise:
                out.add(id(node))
            skip += node.noise
            inside += node.main
            in_link += node.tag == "a"
            if node.tag in BLOCK:
                opened.append(_Open())
            continue
        if node.tag in BLOCK:
            own = opened.pop()
            content = _content(own.parts) if by_content else b""
            if own.size and not skip:
                key = _signed(path.encode()) if by_node or by_content else 0
                importance = by_node.get(key, 1.0)
                if own.children:
                    level = LEVEL**own.children
                    mean = (own.importance + (own.size - own.weighed) * importance) / own.size
                    importance = (1 - level) * importance + level * mean
                if by_content:
                    importance = min(importance, by_content.get((key, int.from_bytes(content, "big", signed=True)), 1.0))
                outside = not inside and not node.main
                score = importance * node.weight * (OUTSIDE if outside else 1) * (LINKED if outside and own.linked >= LINK_SHARE * own.size else 1)
                if score < LEAST_IMPORTANCE and not (node.main or node.holds or node.tag in ("html", "body")):
                    out.add(id(node))
                if opened:
                    above = opened[-1]
                    above.children += 1
                    above.weighed += own.size
                    above.importance += own.size * importance
            if opened:
                opened[-1].parts.append(content)
                opened[-1].size += own.size
                opened[-1].linked += own.linked
        elif node.weight < 1 and not node.noise and node.weight * (1 if inside else OUTSIDE) < LEAST_IMPORTANCE:
            out.add(id(node))  # an inline element has no place in the tree
        skip -= node.noise
        inside -= node.main
        in_link -= node.tag == "a"
    return out


@contextlib.contextmanager
def _no_collector():
    """Page trees hold no cycles: looking for some costs more than all else on pages of many elements."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _page_key(page: str) -> int:
    return _signed(page.encode("utf-8", "replace"))


def style_tree(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``(host, nodes, contents)``: what is common and of importance below ``TOLD`` on each host, to be looked at; pages are given ``whole_tree``."""
    low = lambda c: F.filter(c, lambda x: x["importance"] < TOLD)
    common = whole_tree(pages, url_col, html_col)[0].select("host", low("nodes").alias("nodes"), low("contents").alias("contents"))
    return common.where("size(nodes) > 0 or size(contents) > 0")


def whole_tree(pages: DataFrame, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """``(host, nodes, contents)``: what is of importance below 1 on each host, as lists of (node, importance) and (node, content, importance).

    The first table has what is common on a host (``COMMON_SHARE``, so at most 1 / ``COMMON_SHARE`` pages' blocks), the second, which also has the
    key of a ``page``, whatever else its blocks are: together all of the tree that a page can ask for.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                hosts, rows = [], []
                for url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if host := _host(url):
                        with _no_collector():
                            root = parse(page or "")
                            text = _main_text(root, _NO_TREE) or page or ""
                            copy = _signed(text.encode("utf-8", "replace"))
                            own = [(_page_key(page or ""), copy, *f) for f in {*features(root), (None, 0, 0)}]  # the null node counts the page
                        hosts += [host] * len(own)
                        rows += own
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["host", "page", "copy", "node", "content", "shape"]
                )

    seen = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(
        run, "host string, page long, copy long, node long, content long, shape long"
    )
    staged = Staged(pages.sparkSession, "style-tree")
    seen = staged.put(seen)
    tree = staged.put(seen.drop("page").distinct().groupBy("host", "node", "content", "shape").agg(F.count("*").alias("n")))
    hosts = staged.put(tree.where("node is null").select("host", F.col("n").alias("pages")))
    tree = tree.where("node is not null")

    def entropy(feature: str, name: str) -> DataFrame:
        counts = tree.groupBy("host", "node", feature).agg(F.sum("n").alias("c"))
        sums = counts.groupBy("host", "node").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        # -sum p log p to the base m, from sums alone
        return sums.select("host", "node", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0).alias(name), "m")

    own = F.greatest("by_content", "by_shape")
    nodes = (
        entropy("content", "by_content")
        .join(entropy("shape", "by_shape").drop("m"), ["host", "node"])
        .join(hosts, "host")
        .withColumn("importance", (F.col("m") * own + PRIOR) / (F.col("m") + PRIOR))
        .where("importance < 1")
        .select("host", "node", "importance", (F.col("m") >= COMMON_SHARE * F.col("pages")).alias("common"))
    )
    contents = (
        tree.groupBy("host", "node", "content")
        .agg(F.sum("n").alias("c"))
        .join(hosts, "host")
        .withColumn("importance", 1 - (F.col("c") - 1) / (F.col("pages") - 1 + CONTENT_PRIOR))
        .where("importance < 1")
        .select("host", "node", "content", "importance", (F.col("c") >= COMMON_SHARE * F.col("pages")).alias("common"))
    )
    nodes, contents = staged.put(nodes), staged.put(contents)

    def listed(nodes: DataFrame, contents: DataFrame, *keys: str) -> DataFrame:
        nodes = nodes.groupBy(*keys).agg(F.collect_list(F.struct("node", "importance")).alias("nodes"))
        contents = contents.groupBy(*keys).agg(F.collect_list(F.struct("node", "content", "importance")).alias("contents"))
        return staged.put(nodes.join(contents, list(keys), "full"))

    held = seen.where("node is not null").select("host", "page", "node", "content").distinct()
    rare = listed(
        held.select("host", "page", "node").distinct().join(nodes.where("not common"), ["host", "node"]), held.join(contents.where("not common"), ["host", "node", "content"]), "host", "page"
    )
    return listed(nodes.where("common"), contents.where("common"), "host"), rare


def _size(table: DataFrame) -> int:
    return table.agg(F.sum(F.length("host") + 16 * F.coalesce(F.size("nodes"), F.lit(0)) + 24 * F.coalesce(F.size("contents"), F.lit(0)))).first()[0] or 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_language: bool = False) -> DataFrame:
    """One row ``(page_id, url, text, n_chars)`` per row; with ``with_language`` also ``lang``, the language declared in the markup."""
    tree, rare = whole_tree(pages, url_col, html_col)

    def with_host(batches):
        for batch in batches:
            hosts = [_host(u) for u in batch.column(1).to_pylist()]
            keys = [_page_key(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string()), pa.array(keys, pa.int64())], names=[*batch.schema.names, "host", "page"])

    def told(nodes, contents) -> Tree:
        return {x["node"]: x["importance"] for x in nodes or ()}, {(x["node"], x["content"]): x["importance"] for x in contents or ()}

    def run(batches):
        known: dict[str, Tree] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = []
                nodes, contents = part.column("nodes"), part.column("contents")
                for j, (host, page, *own) in enumerate(zip(*(part.column(x).to_pylist() for x in ("host", "html", "rare_nodes", "rare_contents")), strict=True)):
                    if host not in known:
                        if len(known) >= HOSTS_KEPT:
                            known.clear()
                        known[host] = told(nodes[j].as_py(), contents[j].as_py())
                    common, rarer = known[host], told(*own)
                    with _no_collector():
                        texts.append(main_text(page, tuple(x | y if y else x for x, y in zip(common, rarer, strict=True))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column("lang")],
                    names=["page_id", "url", "text", "n_chars", "lang"],
                )

    declared = F.regexp_extract(html_col, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1) if with_language else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), declared.alias("lang"))
    rows = rows.mapInArrow(with_host, "page_id long, url string, html string, lang string, host string, page long")
    rows = rows.join(F.broadcast(tree) if _size(tree) <= BROADCAST_BYTES else tree, "host", "left")
    near = _size(rare) <= BROADCAST_BYTES
    rare = rare.select("host", "page", F.col("nodes").alias("rare_nodes"), F.col("contents").alias("rare_contents"))
    rows = rows.join(F.broadcast(rare) if near else rare, ["host", "page"], "left")
    rows = rows.select("page_id", "url", "html", "lang", "host", "nodes", "contents", "rare_nodes", "rare_contents")
    out = rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, lang string")
    return out if with_language else out.drop("lang")
