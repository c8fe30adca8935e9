"""Main text of HTML pages by wrapper induction.

Pages become trees of block elements. Pages of a host and layout (the kinds of their outer elements) are aligned with one of them, the
reference, by simple tree matching (the largest order-preserving matching of nodes of equal kind, by dynamic programming
over the children). A node of the reference with the same text in nearly all aligned pages is template, one whose text varies is a
slot. The content region is found by going down the reference from its root as long as one child holds most of the text of
slots that isn't links. Content are the slots in the region.

Names of elements and classes decide where the alignment can't: text in elements for navigation, comments and the like counts
a tenth and text in marked articles twice in the descent; such elements inside the region are left out even if they vary; and pages
of a layout with fewer than LEAST_PAGES distinct pages are cut by marks alone. Copies of a text on a host count once, and no template
takes all of a page's content.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, gathered, pick, quoted
from .token_counts import slices
from .url_filter import parts

# Elements whose content is no text, that begin and end blocks, that are no content, and that have no content.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "textarea", "select", "button", "canvas", "math"}
BLOCKS = {"html", "body", "address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NO_CONTENT = {"nav", "aside", "footer", "header", "form", "menu", "dialog", "fieldset"}
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
ARTICLE = {"article", "main"}
# Words of class, id and role attributes of elements that are no content.
NO_CONTENT_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "disqus", "footer", "header", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"}
#: Elements that end at the next one of their kind, or of a kind that can't be inside.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: From behind a tag's name to its end; quoted values may hold ">". No step back, so it is linear.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
#: Least other pages of a layout to call a node template, and the share of them with its text.
LEAST_PAGES, CONSTANT_SHARE = 3, 0.9
#: Outer levels of elements that make a layout, share of its parent's text from which a child holds the content, and weights of text by marks.
LAYOUT_DEPTH, MOST_OF_TEXT, BAD_WEIGHT, ARTICLE_WEIGHT = 3, 0.6, 0.1, 2.0
#: Nesting beyond counts as of this level.
MAX_DEPTH = 150
#: Pairs of nodes up to which trees are matched cell by cell; larger ones are matched a row at a time, with the same result.
CELL_BY_CELL = 50_000
#: Cells of a table whose bits are kept at once, a quarter of a byte each.
CELLS_KEPT = 1 << 27
#: Most layouts, and most characters of their outlines, that are broadcast.
MAX_LAYOUTS, MAX_OUTLINES = 10_000, 32_000_000


class Node:
    """An element: its kind, text checksum and children.

    ``bad`` is the innermost element around it, or itself, that is no content by its marks; ``strict`` leaves headers out, as
    that of an article may hold its title.
    """

    __slots__ = ("kind", "tag", "children", "up", "bad", "strict", "inside", "number", "own", "crc", "level")

    def __init__(self, kind: str, tag: str, up: Node | None, around: Node | None, level: int) -> None:
        self.kind, self.tag, self.up, self.level = kind, tag, up, level
        self.bad, self.strict, self.inside = (around.bad, around.strict, around.inside) if around else (None, None, False)
        self.children: list[Node] = []
        #: Number of the matched node of the reference, of this node or the next around it; ``own``: of this node.
        self.number, self.own, self.crc = -1, False, 0


class Block:
    """A run of text in an element, and its characters in links."""

    __slots__ = ("node", "text", "links")

    def __init__(self, node: Node, text: str, links: int) -> None:
        self.node, self.text, self.links = node, text, links


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, mark, name, rest) of tags and comments in turn; a "<" that begins none is text. Linear in the page.

    The caller may send the position to go on from.
    """
    at, quotes, closed = 0, True, True
    while True:
        start = source.find("<", at)
        if start < 0:
            return
        at = start + 1
        mark = source[at : at + 1]
        if source.startswith("!--", at):
            close = source.find("-->", at + 3)
            end = close + 3 if close >= 0 else len(source)
            at = (yield start, end, "!", "", "") or end
            continue
        if mark in ("!", "?", "/"):
            at += 1
        else:
            mark = ""
        name = _NAME.match(source, at)
        if (not name and mark not in ("!", "?")) or not closed:
            continue
        begin = name.end() if name else at
        found = _REST.match(source, begin) if quotes else None
        if found:
            end = found.end()
        else:  # a quote that never closes: from here on they count for nothing
            quotes = False
            end = source.find(">", begin) + 1
            if not end:
                closed = False
                continue
        at = (yield start, end, mark, name[0].lower() if name else "", source[begin : end - 1]) or end


def parse(source: str) -> tuple[Node, list[Block]]:
    """The tree of block elements and the text blocks with their elements, in page order."""
    root = Node("", "", None, None, 0)
    stack, names, blocks, run = [root], {"": 1}, [], []
    linked, links = False, 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        run.clear()
        if text:
            blocks.append(Block(stack[-1], text, min(links, len(text))))
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            run.append(text)
            links += len(text) * linked

    def pop() -> None:
        names[stack.pop().tag] -= 1

    upto = 0
    scan = tags(source)
    found = next(scan, None)
    while found:
        start, end, mark, tag, rest = found
        add(source[upto:start])
        upto, go_on = end, None
        if mark in ("!", "?"):
            pass
        elif mark == "/":
            if tag == "a":
                linked = False
            elif tag in BLOCKS:
                flush()
                if names.get(tag):
                    while stack[-1].tag != tag:
                        pop()
                    pop()
        elif tag in SKIPPED:
            if not rest.endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, end)
                # Without its end tag a head ends at the body, other elements at the end of the page.
                if close is None:
                    unclosed.add(tag)
                    close = re.compile(r"(?=<body\b)", re.IGNORECASE).search(source, end) if tag == "head" else None
                upto = go_on = close.end() if close else len(source)
            if tag not in ("svg", "math", "canvas", "button", "select"):
                flush()
        elif tag in BLOCKS:
            flush()
            if tag not in VOID:
                open_now = CLOSES.get(tag, {"p"})
                while len(stack) > 1 and stack[-1].tag in open_now:
                    pop()
                words = set(re.split(r"[\s_\-]+", " ".join(_NAMES.findall(rest)).replace('"', " ").replace("'", " ").lower())) - {""} if rest else set()
                around = stack[-1]
                up = around if around.level < MAX_DEPTH else around.up
                kind = f"{tag}.{'.'.join(sorted(re.sub('[0-9]+', '0', w) for w in words))}" if words else tag
                node = Node(kind, tag, up, around, up.level + 1)
                marks = NO_CONTENT_WORDS.intersection(words) | NO_CONTENT.intersection({tag})
                if marks:
                    node.bad = node
                if marks - {"header"}:
                    node.strict = node
                node.inside = around.inside or (node.bad is None and tag in ARTICLE)
                up.children.append(node)
                stack.append(node)
                names[tag] = names.get(tag, 0) + 1
        elif tag == "br":
            add(" ")
        elif tag == "a":
            linked = True
        try:
            found = scan.send(go_on)
        except StopIteration:
            found = None
    add(source[upto:])
    flush()
    for block in blocks:
        block.node.crc = zlib.crc32(block.text.encode(), block.node.crc)
    return root, blocks


def hash_text(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def number(root: Node) -> list[Node]:
    """All nodes in page order, numbered."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo += reversed(node.children)
    return out


def skeleton(root: Node) -> str:
    """Kind, text checksum and parent of each node, a line each."""
    return "\n".join(f"{n.up.number if n.up else -1} {n.crc} {n.kind}" for n in number(root))


def layout(root: Node) -> int:
    """A hash of the kinds of the outer elements, each named once among its siblings."""
    level, out = [root], []
    for _ in range(LAYOUT_DEPTH):
        level = [c for n in level for c in n.children]
        out.append(",".join(dict.fromkeys(c.kind for c in level)))
    return hash_text("/".join(out))


def rebuild(text: str) -> list[Node]:
    nodes: list[Node] = []
    for line in text.split("\n"):
        up, crc, kind = line.split(" ", 2)
        around = nodes[int(up)] if int(up) >= 0 else None
        node = Node(kind, "", around, None, 0)
        node.number, node.crc = len(nodes), int(crc)
        if around:
            around.children.append(node)
        nodes.append(node)
    return nodes


def sizes(root: Node) -> dict[Node, int]:
    """Nodes of each subtree."""
    order = [root]
    for node in order:
        order += node.children
    out = dict.fromkeys(order, 1)
    for node in reversed(order):
        for c in node.children:
            out[node] += out[c]
    return out


def match(x: Node, y: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Size of a largest matching of two nodes of a kind, and its pairs below them; cell by cell."""
    p, q = x.children, y.children
    if not p or not q:
        return 1, []
    best = [[0] * (len(q) + 1)]
    inner: dict[tuple[int, int], tuple[int, list]] = {}
    for i, c in enumerate(p):
        above = best[i]
        row = above[:]
        for j, d in enumerate(q):
            most = row[j] if row[j] > above[j + 1] else above[j + 1]
            if c.kind == d.kind:
                found = match(c, d) if c.children and d.children else (1, [])
                if above[j] + found[0] > most:
                    most = above[j] + found[0]
                    inner[i, j] = found
            row[j + 1] = most
        best.append(row)
    pairs, i, j = [], len(p), len(q)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((p[i], q[j]))
            pairs += inner[i, j][1]
    return best[-1][-1] + 1, pairs


class Levels:
    """The nodes below one by levels, to match a node with all nodes of a level at once.

    A level's lists of siblings lie one behind the other in a row of the table; each has a base over all that comes before,
    so that one running maximum serves them all.
    """

    def __init__(self, top: Node, most: int) -> None:
        self.codes: dict[str, int] = {}
        #: By level: kinds; places of nodes with children; the last child of each and the base of each child, on the next level.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        level = top.children
        while level:
            inner = [i for i, n in enumerate(level) if n.children]
            counts = np.array([len(level[i].children) for i in inner], np.int64)
            kinds = np.array([self.codes.setdefault(n.kind, len(self.codes)) for n in level])
            self.levels.append((kinds, np.array(inner, np.int64), counts.cumsum() - 1, np.repeat(np.arange(len(inner)) * most, counts)))
            level = [c for n in level for c in n.children]

    def sizes(self, node: Node, k: int = 0) -> np.ndarray:
        """Sizes of the largest matchings of a node with those of level k, 0 for another kind."""
        kinds, inner, last, base = self.levels[k]
        out = (kinds == self.codes.get(node.kind, -1)).astype(np.int64)
        if node.children and len(inner) and out[inner].any():
            row = base
            for c in node.children:
                row = step(row, self.sizes(c, k + 1), base)
            out[inner] *= 1 + row[last] - base[last]
        return out


def step(above: np.ndarray, gain: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The next row of the table."""
    row = np.empty_like(above)
    row[0], row[1:] = base[0], np.maximum(above[:-1], base[1:])
    row += gain
    return np.maximum.accumulate(np.maximum(row, above, out=row), out=row)


def match_children(x: Node, y: Node, first: bool, most: int) -> list[tuple[Node, Node]]:
    """The pairs of children that ``match`` takes, row by row; of equal ways back that along x comes ``first``, else that along y.

    The last rows are kept with two bits for a cell, of a longer table others at intervals, between which they are made again on the way back.
    """
    p, q = x.children, y.children
    kinds, at = {c.kind for c in p}, {d.kind: j for j, d in enumerate(q)}
    if len(kinds) == len(p) and len(at) == len(q):
        met = [(c, at[c.kind]) for c in p if c.kind in at]
        if all(j < k for (_, j), (_, k) in zip(met, met[1:], strict=False)):  # all of a kind meet, in order
            return [(c, q[j]) for c, j in met]
    levels, base = Levels(y, most), np.zeros(len(q), np.int64)

    def fill(row: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, list]:
        bits, n = [], len(row)
        for c in p[lo:hi]:
            above, row = row, step(row, levels.sizes(c)[:n], base[:n])
            bits.append((np.packbits(row == above), np.packbits(row == np.concatenate((base[:1], row[:-1])))))
        return row, bits

    block, kept, row, bits = max(4 * math.isqrt(len(p)) + 1, CELLS_KEPT // len(q)), [], base, None
    for lo in range(0, len(p), block):
        kept.append(row)
        row, bits = fill(row, lo, lo + block)
    pairs, i, j = [], len(p), len(q)
    while kept and j:
        row, lo = kept.pop(), len(kept) * block
        bits = bits or fill(row[:j], lo, i)[1]
        while i > lo and j:
            up, left = (b[j - 1 >> 3] >> (7 - (j - 1 & 7)) & 1 for b in bits[i - 1 - lo])
            if up and (first or not left):
                i -= 1
            elif left:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((p[i], q[j]))
        bits = None
    return pairs


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes by simple tree matching; the roots are taken as matched. How it is computed depends on the size, the pairs don't."""
    size = sizes(a) | sizes(b)
    pairs, todo = [(a, b)], [(a, b)]
    while todo:
        x, y = todo.pop()
        if size[x] * size[y] <= CELL_BY_CELL:
            pairs += match(x, y)[1]
        elif x.children and y.children:
            most = min(size[x], size[y]) + 1
            # Rows belong to the smaller tree.
            met = match_children(x, y, True, most) if size[x] <= size[y] else [(c, d) for d, c in match_children(y, x, False, most)]
            pairs += met
            todo += met
    return pairs


def weight(block: Block) -> float:
    """How much a block's text counts for the place of the content."""
    text = len(block.text) - block.links
    return text * (BAD_WEIGHT if block.node.bad else ARTICLE_WEIGHT if block.node.inside else 1.0)


def region(nodes: list[Node], mass: dict[int, float]) -> tuple[int, int]:
    """First and last number of the subtree that holds the content, by the text of slots (``mass`` by node)."""
    last, total = list(range(len(nodes))), [mass.get(i, 0.0) for i in range(len(nodes))]
    for node in reversed(nodes[1:]):
        last[node.up.number] = max(last[node.up.number], last[node.number])
        total[node.up.number] += total[node.number]
    at = nodes[0]
    while at.children:
        most = max(at.children, key=lambda c: total[c.number])
        if total[most.number] < MOST_OF_TEXT * total[at.number] or not total[most.number]:
            break
        others = [c for c in at.children if c is not most and total[c.number]]
        # A text of several stays with them, and a varying heading with what it heads.
        if others and (not most.children or any(re.match(r"h[1-6]\b", c.kind) for c in others)):
            break
        at = most
    return at.number, last[at.number]


def marks(block: Block) -> int:
    """0: no content by its marks, 1: outside of a marked article, 2: inside of one."""
    node = block.node
    return 2 if node.inside and not node.strict else 0 if node.bad else 1


def outlines(pages: DataFrame) -> DataFrame:
    """Parsed pages (id, url, html, host): their tree, blocks with element, weight, marks and element that is no content, and a hash of the text."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, hosts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in slices(sources):
                out: list[tuple] = []
                for source, host in zip(sources[lo:hi], hosts[lo:hi], strict=True):
                    root, blocks = parse(source)
                    tree = skeleton(root)
                    places = [b.node.number for b in blocks]
                    out.append((
                        hash_text(f"{host} {layout(root)}"), tree, tree.count("\n") + 1, [b.text for b in blocks], places, [weight(b) for b in blocks],
                        [marks(b) for b in blocks], [b.node.strict.number if b.node.strict else -1 for b in blocks], hash_text("\n".join(b.text for b in blocks if not b.node.bad)),
                    ))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *columns], names=["id", "url", "layout", "tree", "nodes", "blocks", "places", "weights", "marks", "bad", "unit"])

    kind = pages.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, layout long, tree string, nodes long, blocks array<string>, places array<int>, weights array<double>, marks array<int>, bad array<int>, unit long"
    return pages.mapInArrow(outline, schema)


def references(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(layout, ref, n, ref_unit, ref_tree): the page that each layout's pages are aligned with, null for one with too few distinct pages."""
    units = table.groupBy("layout", "unit").agg(F.min(F.struct("nodes", "row")).alias("least"), F.count(F.lit(1)).alias("n"))
    layouts = units.groupBy("layout").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("n"), F.min(F.struct("least", "unit")).alias("first"))
    layouts = layouts.where(F.col("units") > LEAST_PAGES).select("layout", "n", F.col("first.least.row").alias("ref"), F.col("first.unit").alias("ref_unit"))
    layouts = scratch.save(layouts, "layouts")
    trees = pick(table.select(F.col("row").alias("ref"), F.col("tree").alias("ref_tree")), layouts, "ref")
    return scratch.save(trees.select("layout", "n", "ref", "ref_unit", "ref_tree"), "references")


class Aligner:
    """Aligns outlines with those of references, of which a few are kept."""

    def __init__(self) -> None:
        self.known: dict[int, Node] = {}

    def nodes(self, tree: str, ref: int, ref_tree: str) -> tuple[list[Node], list[tuple[Node, Node]]]:
        """Nodes of the page with their numbers in the reference, and the matched pairs."""
        if ref not in self.known:
            if len(self.known) > 200:
                self.known.clear()
            self.known[ref] = rebuild(ref_tree)[0]
        nodes = rebuild(tree)
        pairs = align(nodes[0], self.known[ref])
        for node in nodes:
            node.number = -1
        for node, other in pairs:
            node.number, node.own = other.number, True
        for node in nodes[1:]:
            if not node.own:
                node.number = node.up.number
        return nodes, pairs


def wrappers(table: DataFrame, refs: DataFrame, scratch: Scratch) -> DataFrame:
    """(layout, lo, hi, template): content region and constant nodes of each reference."""
    # Copies of a text count once, and the reference's own text not at all.
    once = scratch.save(table.groupBy("layout", "unit").agg(F.min("row").alias("row")).select("row"), "once")
    met = by_size(pick(table.select("row", "layout", "unit", "tree", "places", "weights"), once, "row"), refs, "layout", "length(ref_tree)").where("unit <> ref_unit")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ref", "tree", "ref_tree", "places", "weights")]
            out: list[list] = [[], [], [], []]
            at: list[int] = []
            for i, (ref, tree, ref_tree, places, weights) in enumerate(zip(*columns, strict=True)):
                nodes, pairs = aligner.nodes(tree, ref, ref_tree)
                # Whether a matched node has the reference's text, and the weight of its own text and of text in elements that aren't matched.
                said: dict[int, list] = {o.number: [int(n.crc == o.crc), 0.0, 0.0] for n, o in pairs if n.crc or o.crc}
                for p, w in zip(places, weights, strict=True):
                    said.setdefault(nodes[p].number, [-1, 0.0, 0.0])[1 if nodes[p].own else 2] += w
                for k, v in said.items():
                    for column, x in zip(out, (k, *v), strict=True):
                        column.append(x)
                at += [i] * len(said)
            made = [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("layout").take(pa.array(at, pa.int64())), *made], names=["layout", "node", "same", "own", "other"])

    said = met.select("layout", "ref", "tree", "ref_tree", "places", "weights").mapInArrow(read, "layout long, node int, same int, own double, other double")
    nodes = said.groupBy("layout", "node").agg(F.count_if(F.col("same") >= 0).alias("pages"), F.count_if(F.col("same") == 1).alias("same"), F.sum("own").alias("own"), F.sum("other").alias("other"))
    fixed = (F.col("pages") >= LEAST_PAGES) & (F.col("same") >= CONSTANT_SHARE * F.col("pages"))
    # A list of a reference's nodes at most.
    nodes = nodes.groupBy("layout").agg(F.collect_list(F.struct("node", fixed.alias("fixed"), (F.col("other") + F.when(fixed, 0.0).otherwise(F.col("own"))).alias("mass"))).alias("nodes"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lo, hi = region(rebuild(tree), {n["node"]: n["mass"] for n in nodes})
                out.append((lo, hi, [n["node"] for n in nodes if n["fixed"]]))
            lo, hi, template = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(template, pa.list_(pa.int32()))], names=["layout", "lo", "hi", "template"])

    return refs.join(nodes, "layout").select("layout", "ref_tree", "nodes").mapInArrow(decide, "layout long, lo int, hi int, template array<int>")


def contents(table: DataFrame) -> DataFrame:
    """id, url and text of pages met with their references; the reference is null where there is none."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ref", "tree", "ref_tree", "blocks", "places", "marks", "bad", "lo", "hi", "template")]
            out = []
            for ref, tree, ref_tree, blocks, places, marked, bad, lo, hi, template in zip(*columns, strict=True):
                kept: list[str] = []
                if lo is not None:
                    nodes, fixed = aligner.nodes(tree, ref, ref_tree)[0], set(template)
                    for text, p, b in zip(blocks, places, bad, strict=True):
                        node, around = nodes[p], nodes[b] if b >= 0 else None
                        # An element that is no content counts if it lies in the region and isn't the region itself.
                        out_of = around is not None and lo <= around.number <= hi and not (around.own and around.number == lo)
                        if lo <= node.number <= hi and not (node.own and node.number in fixed) and not out_of:
                            kept.append(text)
                # Without a wrapper, or if it leaves nothing, the marks decide.
                out.append("\n".join(kept or [t for t, m in zip(blocks, marked, strict=True) if m == 2] or [t for t, m in zip(blocks, marked, strict=True) if m == 1]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"])

    return table.mapInArrow(choose, f"id {table.schema['id'].dataType.simpleString()}, url string, text string")


def by_size(rows: DataFrame, wanted: DataFrame, key: str, size: str) -> DataFrame:
    """Left join with a written table, which is broadcast up to MAX_LAYOUTS rows and MAX_OUTLINES of ``size``, else shuffled."""
    n, much = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()
    return rows.join(F.broadcast(wanted) if n <= MAX_LAYOUTS and much <= MAX_OUTLINES else wanted, key, "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Blocks are in page order and joined by \\n; white space in a block is one space, and character
    references are decoded. A null or empty page, or one without content, has an empty text. A page without a
    host (null URL or no ``://``) counts as of the host ''. Of equally small references the first counts. Rows are extracted one by
    one: repeated rows repeat, null ids stay null. Other columns are ignored, an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "html")
    df = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"), F.coalesce(F.col(quoted(html_col)), F.lit("")).alias("html"))
    df = df.withColumn("host", parts("url")[0])
    table = scratch.save(outlines(gathered(df)).select(F.monotonically_increasing_id().alias("row"), "*"), "pages")
    refs = references(table, scratch)
    found = scratch.save(refs.join(wrappers(table, refs, scratch), "layout", "left").drop("n", "ref_unit"), "wrappers")
    out = contents(by_size(table.drop("row", "nodes", "unit", "weights"), found, "layout", "length(ref_tree)"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
