"""Main-text extraction by wrapper induction.

Pages of one host come from one template. A page's DOM tree is reduced to its block elements, siblings of one
label to one node. For each host the commonest reduced tree is the reference; the other trees are aligned with
it by simple tree matching (the largest order-keeping match of nodes of equal labels, bottom up), so that every
page's nodes are named by the reference's. A text that stands in a node on (nearly) all different pages that have the
node is template, beside whatever else stands there; the rest, which varies, is content. Blocks inside elements that HTML
or their class names mark as menus, headers, footers, sidebars, notices, adverts, forms or reader comments are not content
either. If a page has an article or main element, content is all that is inside it, constant or not.

A tree is a text of a line a node (depth and label), a node's name the hash of its labels from the root: both grow with
the page, not with its depth. Nothing recurses.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, parts, read_table

#: Elements by what they do to text; fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "noframes", "xmp")
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
OUTSIDE = frozenset("head nav footer aside form button select option dialog menu object audio video canvas map fieldset legend datalist".split())
#: Words of class names, ids and roles that mark what is not the article.
MARKS = frozenset("ad ads adv advert advertisement adverts banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe signup share sharing social related comment comments disqus replies reply respond footer masthead login search widget pager pagination contentinfo complementary alert".split())
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=4096)
def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """A node's label (tag and class) and whether the element is marked as outside the article."""
    named = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in NAMES.finditer(attributes)}
    words = {w for v in named.values() for w in WORD.findall(v.lower())}
    label = ".".join([tag, *sorted(WORD.findall(named.get("class", "").lower()))[:3]])
    return label, tag in OUTSIDE or (bool(words & MARKS) and tag not in ("html", "body", "article", "main"))


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & ((1 << 64) - 1)) - (1 << 63)


class Page:
    """A page's text blocks in order: (node, text, whether outside the article, whether inside an article or main element).

    `nodes` has the reduced tree: for each node's name its parent's name and its label.
    """

    def __init__(self, page: str):
        self.nodes: dict[int, tuple[int, str]] = {}
        self.blocks: list[tuple[int, str, bool, bool]] = []
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, node, outside, main
        open_: dict[str, int] = {}  # how often a tag is open
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = "".join(text)
                text.clear()
                joined = " ".join(html.unescape(joined).split() if "&" in joined else joined.split())
                if joined:
                    _, node, outside, main = stack[-1]
                    self.blocks.append((node, joined, outside, main))

        def close(i: int) -> None:
            for tag, *_ in stack[i:]:
                open_[tag] -= 1
            del stack[i:]

        last = 0
        for m in TAG.finditer(page):
            if m.start() > last:
                text.append(page[last : m.start()])
            last = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                continue
            flush()
            if m[2]:
                if open_.get(tag):
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P and open_.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in CLOSES_P:
                        break
            if stack[-1][0] in SAME_CLOSES.get(tag, ()):
                close(len(stack) - 1)
            label, marked = _label(tag, m[4] or "")
            _, parent, outside, main = stack[-1]
            if tag == "header" and not main:  # a page's header, not an article's
                marked = True
            if tag == "body":
                outside = False
            if not (m[4] or "").endswith("/"):
                node = _hash(label, parent)
                self.nodes.setdefault(node, (parent, label))
                open_[tag] = open_.get(tag, 0) + 1
                stack.append((tag, node, outside or marked, main or tag in ("article", "main") or "articlebody" in (m[4] or "").lower()))
        text.append(page[last:])
        flush()

    def tree(self) -> str:
        """The reduced tree in document order, a line for each node: its depth and label."""
        children: dict[int, list[int]] = {}
        for node, (parent, _) in self.nodes.items():
            children.setdefault(parent, []).append(node)
        out, todo = [], [(n, 0) for n in reversed(children.get(0, []))]
        while todo:
            node, depth = todo.pop()
            out.append(f"{depth} {self.nodes[node][1]}")
            todo += [(n, depth + 1) for n in reversed(children.get(node, []))]
        return "\n".join(out)


def _read_tree(tree: str) -> dict[int, dict[str, int]]:
    """For each node's name (0: the root) its children by label, in order."""
    children: dict[int, dict[str, int]] = {0: {}}
    above = [0]
    for line in tree.split("\n") if tree else ():
        depth, _, label = line.partition(" ")
        del above[int(depth) + 1 :]
        node = _hash(label, above[-1])
        children[above[-1]][label] = node
        children.setdefault(node, {})
        above.append(node)
    return children


def heaviest_increasing(places: list[int], weights: list[int]) -> list[int]:
    """Indices of the subsequence of increasing places with the greatest sum of weights (n log n)."""
    size = max(places, default=0) + 2
    best: list[tuple[int, int]] = [(0, -1)] * (size + 1)
    before = []
    for i, (place, weight) in enumerate(zip(places, weights)):
        top, k = (0, -1), place
        while k > 0:
            top = max(top, best[k])
            k -= k & -k
        before.append(top[1])
        k = place + 1
        while k <= size:
            best[k] = max(best[k], (top[0] + weight, i))
            k += k & -k
    top, k = (0, -1), size
    while k > 0:
        top = max(top, best[k])
        k -= k & -k
    out, i = [], top[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


@lru_cache(maxsize=2048)
def align(tree: str, reference: str) -> dict[int, int]:
    """The reference's node for each node of a tree whose name differs, by simple tree matching.

    Nodes of equal label under matched parents are pairs; of those of one parent the heaviest set that keeps order
    stays, a pair's weight being the number of pairs below it. What is left over is matched by its tag, in order.
    """
    if tree == reference:
        return {}
    x, y = _read_tree(tree), _read_tree(reference)
    order, todo = [], [(0, 0)]
    while todo:  # pairs of equal labels from the root on: their names are equal too
        a, b = todo.pop()
        order.append((a, b))
        todo += [(x[a][label], y[b][label]) for label in x[a] if label in y[b]]
    weight: dict[tuple[int, int], int] = {}
    kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in reversed(order):
        at = {label: k + 1 for k, label in enumerate(y[b])}
        pairs = [(x[a][label], y[b][label], at[label]) for label in x[a] if label in at]
        chosen = [pairs[i] for i in heaviest_increasing([p[2] for p in pairs], [weight[p[0], p[1]] for p in pairs])]
        kept[a, b] = [(p[0], p[1]) for p in chosen]
        weight[a, b] = 1 + sum(weight[p] for p in kept[a, b])
    out: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        both = kept.get((a, b), [])
        mine, theirs = {p[0] for p in both}, {p[1] for p in both}
        spare: dict[str, list[int]] = {}
        for label, node in y[b].items():
            if node not in theirs:
                spare.setdefault(label.split(".")[0], []).append(node)
        for label, node in x[a].items():
            if node not in mine and (same := spare.get(label.split(".")[0])):
                both = [*both, (node, same.pop(0))]
        for p in both:
            if p[0] != p[1]:
                out[p[0]] = p[1]
        todo += both
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


SHARE, PAGES = 0.9, 3
#: Wrappers are broadcast up to so many bytes (reference trees and template texts' hashes).
MAX_BROADCAST_BYTES = 16 << 20


def _mark(node: int, text: int) -> int:
    """A template text in a node, as one number."""
    return (node * 0x9E3779B97F4A7C15 + text + (1 << 63)) % (1 << 64) - (1 << 63)


def induce(pages: DataFrame) -> DataFrame:
    """(host, reference, fixed): each host's reference tree and its template texts in their nodes. `pages`: host, html.

    Rows are a page's distinct (node, text) pairs; a tree is sent once a page, without them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out: list[list] = [[], [], [], [], [], []]
            for h, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(raw or "")
                pairs = list(dict.fromkeys((node, _hash(t)) for node, t, _, _ in page.blocks))
                if not pairs:
                    continue
                tree = page.tree()
                name, whole = _hash(tree), _hash(" ".join(f"{n} {t}" for n, t in pairs))
                for row in ((h, name, whole, tree, None, None), *((h, name, whole, None, n, t) for n, t in pairs)):
                    for c, v in zip(out, row):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["host", "tree", "body", "shape", "node", "text"])

    rows = pages.mapInArrow(read, "host string, tree long, body long, shape string, node long, text long")
    # a page counts once, however many copies it has
    rows = cut_lineage(rows.groupBy("host", "tree", "body", "node", "text").agg(F.first("shape").alias("shape")).groupBy("host", "tree", "node", "text").agg(F.count(F.lit(1)).alias("n"), F.first("shape").alias("shape")))
    trees = rows.where("node IS NULL").select("host", "tree", "shape", "n")
    refs = trees.groupBy("host").agg(F.max_by(F.struct("tree", "shape"), F.struct("n", "tree")).alias("r")).select("host", F.col("r.tree").alias("ref"), F.col("r.shape").alias("reference"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out: list[list] = [[], [], [], []]
            for h, tree, shape, reference in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for a, b in align(shape, reference).items():
                    for c, v in zip(out, (h, tree, a, b)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], names=["host", "tree", "node", "named"])

    others = trees.join(refs, "host").where("tree <> ref").select("host", "tree", "shape", "reference")
    names = others.mapInArrow(name, "host string, tree long, node long, named long")
    slots = rows.where("node IS NOT NULL").join(names, ["host", "tree", "node"], "left").select("host", "tree", F.coalesce("named", "node").alias("node"), "text", "n")
    # pages that have a node: those of each tree that has it
    has = slots.select("host", "tree", "node").distinct().join(trees.select("host", "tree", F.col("n").alias("_pages")), ["host", "tree"]).groupBy("host", "node").agg(F.sum("_pages").alias("pages"))
    texts = slots.groupBy("host", "node", "text").agg(F.sum("n").alias("n"))
    fixed = texts.join(has, ["host", "node"]).where((F.col("pages") >= PAGES) & (F.col("n") >= F.col("pages") * SHARE))
    lists = fixed.groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("fixed"))
    return cut_lineage(refs.join(lists, "host").select("host", "reference", "fixed"))


def main_text(page: str, reference: str | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """The main text of a page under a host's wrapper (`fixed`: marks of its template texts)."""
    read = Page(page)
    found = read.blocks
    if any(main and not outside for *_, outside, main in found):
        return "\n\n".join(t for _, t, outside, main in found if main and not outside)
    if fixed and reference is not None and found:
        names = align(read.tree(), reference)
        found = [b for b in found if _mark(names.get(b[0], b[0]), _hash(b[1])) not in fixed]
    return "\n\n".join(t for _, t, outside, _ in found if not outside)


def extract(pages: DataFrame, url: str = "url", html_column: str = "html", column: str = "text") -> DataFrame:
    """`pages` with the main text of each page in `column`.

    Null or empty html gives the empty text; a page without an article is judged by its host's wrapper
    alone. A null or odd url is the host "". All rows, repeated ones too, and other columns are kept; a column of the
    result's name is replaced. Copies of a page count once for its host's wrapper; of equally common trees one is the
    reference, by its hash. Time and memory grow with a page's length, however deep or wide it is. No pages, no rows.
    """
    pages = pages.drop(column)
    hosted = pages.withColumn("_host", host_of(F.col(url)))
    wrappers = induce(hosted.select("_host", html_column)).withColumnRenamed("host", "_host")
    size = wrappers.agg(F.sum(F.octet_length("reference") + 16 * F.size("fixed") + F.octet_length("_host"))).first()[0] or 0
    joined = hosted.join(F.broadcast(wrappers) if size <= MAX_BROADCAST_BYTES else wrappers, "_host", "left").select(*pages.columns, F.col("reference").alias("_reference"), F.col("fixed").alias("_fixed"))
    kept = pages.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), f"`{column}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in parts(batches):
            at = batch.schema.get_field_index
            texts = []
            for page, ref, fixed in zip(*(batch.column(at(c)).to_pylist() for c in (html_column, "_reference", "_fixed"))):
                marks = known.get(ref)
                if marks is None or marks[0] != fixed:
                    known.clear()
                    marks = known[ref] = (fixed, frozenset(_mark(f["node"], f["text"]) for f in fixed or ()))
                texts.append(main_text(page or "", ref, marks[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, column])

    return joined.mapInArrow(run, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
