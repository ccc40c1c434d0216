"""Main text of pages by wrapper induction.

A page becomes a tree of its block elements in which siblings of one label (tag and names) are one repeated node,
so a tree is small however long its page.  Of each host the richest tree is the reference; every
page of the host is aligned with it by simple tree matching.  As labels are unique among siblings, a node can only match the one of its own
path, and the best order-preserving match of two lists of children is their heaviest increasing subsequence: the matching is
exact in n log n steps, and parsing is linear, however a page is nested.  Text that stands in the same aligned
node on nearly all pages of a host is template; slots that vary are content.  Copies of one article vote
once, so they do not make its text a template, and votes are counts that merge: all
pages of a host vote, in no one task.  Copies are told by their first h1 that the markup does not leave out; where
there is none, or one outside article and main stands on nearly all differing pages (the site's name), by all the text not left out.

From the slots, what the markup itself names as a menu, header, footer, sidebar, notice, advert, form, script, style
or reader comment is left out, and of what is left the article is taken (else main, else the body).  Where a page has a main, an article
counts only in it: a card beside it is a teaser.

Defined results: a null or empty html, and a page without an article's text, give ''.  A null
or malformed url belongs to the host ''.  Cut pages are read as far as they go; repeated rows are read each on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from bisect import bisect_right
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import keyed_join, read_table, stored

LEAST_PAGES, SHARE = 2, 0.8
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {"html", "body", "div", "p", "article", "section", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
         "caption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "address", "fieldset", "details", "summary", "dialog", "menu", "hr", "center", "head", "legend"}
LEFT_OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "option", "label", "input", "fieldset"}
#: Class, id and role values, or the head words of compound ones, that name parts other than the article.
NAMED = set("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar side aside complementary widget ad ads advert adverts advertisement sponsor sponsored promo "
            "notice cookie cookies consent alert popup modal newsletter subscribe signup login form search comment comments reply replies disqus share sharing social related recommended pagination pager contentinfo toolbar".split())  # fmt: skip
COMMENTS = {"comment", "comments", "reply", "replies"}
#: Names that are parts of an article inside one, and words that tie a header to it.
OWN_PARTS, ARTICLE_WORDS = {"header", "masthead", "side"}, {"article", "post", "entry", "story", "content"}
#: How a block belongs to the main text: in an article (of main, if there is one), in main, in an article beside main.
ARTICLE, MAIN, BESIDE = 3, 2, 1
#: Words that leave the one before as the head of a compound, words that deny it, and elements whose id in an article is but the target of a link.
PLACES = set("container wrapper wrap box area list section bar block inner outer top bottom left right slot unit links link buttons button posts primary secondary".split())
DENIED = {"no", "not", "non", "has", "have", "with", "without", "hide", "is", "after", "before"}
TARGETS = {"section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "figure", "blockquote", "pre", "table", "span", "a"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "article", "section", "main", "div", "body", "html", "nav", "aside", "footer", "header", "form", "blockquote", "td", "th"}


class Node:
    __slots__ = ("tag", "names", "children", "label", "heads", "id_heads", "holds", "holds_main")

    def __init__(self, tag: str, names: frozenset = frozenset(), heads: frozenset = frozenset(), id_heads: frozenset = frozenset()):
        self.tag, self.names, self.children = tag, names, []
        self.heads, self.id_heads = heads, id_heads  # of class and role; of id
        self.holds, self.holds_main = 0, False  # how many articles and mains are inside
        self.label = tag + "".join(f".{n}" for n in sorted(names)) if tag in BLOCK else ""


@lru_cache(4096)
def head(value: str) -> str:
    """The head word of a class, id or role: its last word that isn't a place or a number; '' if the value denies it (no-sidebar)."""
    words = [w for w in re.split(r"[_-]+", value) if w]
    if not words or words[0] in DENIED:
        return ""
    while len(words) > 1 and (words[-1] in PLACES or words[-1].isdigit()):
        words.pop()
    return "" if words[-1] in OWN_PARTS and words[0] in ARTICLE_WORDS else words[-1]


@lru_cache(4096)
def attribute_names(attributes: str) -> tuple[frozenset, frozenset, frozenset]:
    """All words of class, id and role; the head words of class and role; those of id."""
    values = [(a[1].lower(), v) for a in ATTRIBUTE.finditer(attributes) for v in (a[2] or a[3] or a[4] or "").lower().split()]
    return frozenset(w for _, v in values for w in re.split(r"[_-]+", v) if w), frozenset(head(v) for k, v in values if k != "id"), frozenset(head(v) for k, v in values if k == "id")


def parse(html: str) -> Node:
    """The tree of a page: Nodes and strings (character references still in them)."""
    root = Node("html")
    stack = [root]
    made: list[tuple[Node, Node]] = []  # nodes and their parents, in page order
    open_at: dict[str, list[int]] = {}  # places on the stack, by tag
    scopes: list[int] = []

    def cut(k: int) -> None:
        while len(stack) > k:
            gone = stack.pop().tag
            open_at[gone].pop()
            if gone in SCOPE:
                scopes.pop()

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if html[m.start()] != "<" or m.end() - m.start() == 1:
                stack[-1].children.append(m[0])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if open_at.get(tag):
                cut(open_at[tag][-1])
            continue
        attributes = m[3] if m[2] else m[6]
        names = attribute_names(attributes) if attributes and "=" in attributes else ()
        # a block ends an open paragraph, and a list item or cell the one before
        if tag in BLOCK and open_at.get("p") and open_at["p"][-1] > (scopes[-1] if scopes else 0):
            cut(open_at["p"][-1])
        if tag in CLOSES:
            last = max((open_at[x][-1] for x in CLOSES[tag] if open_at.get(x)), default=0)
            k = len(scopes) - 1
            while k >= 0 and stack[scopes[k]].tag in CLOSES[tag]:
                k -= 1
            if last > (scopes[k] if k >= 0 else 0):
                cut(last)
        node = Node(tag, *names)
        made.append((node, stack[-1]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if tag == "title":
                node.children.append(html[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/") or tag in BLOCK and tag != "hr":
            if tag in SCOPE:
                scopes.append(len(stack))
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)
    for node, parent in reversed(made):
        own = node.tag == "main" or node.tag == "article" and not node.heads & COMMENTS
        parent.holds += node.holds + own
        parent.holds_main = parent.holds_main or node.holds_main or node.tag == "main"
    return root


def named(node: Node, level: int) -> bool:
    """Whether class, id or role name a part that isn't the article."""
    if node.tag == "article":
        return bool(node.heads & COMMENTS)
    if node.tag in ("body", "html", "main"):
        return False
    heads = node.heads if level and node.tag in TARGETS else node.heads | node.id_heads
    if level in (ARTICLE, BESIDE):
        heads = heads - OWN_PARTS
    return bool(heads & NAMED) or bool(node.id_heads & COMMENTS) and node.tag == "section"


def outside(node: Node, level: int, holders: bool = False) -> bool:
    """holders: elements around an article are not left out by their names; those around main never are."""
    if node.tag in LEFT_OUT or node.tag in RAW or node.tag == "header" and level not in (ARTICLE, BESIDE):
        return True
    return not (node.holds_main or holders and node.holds) and named(node, level)


def level_of(node: Node, level: int, has_main: bool) -> int:
    if node.tag == "article":
        return ARTICLE if level in (ARTICLE, MAIN) or not has_main else BESIDE
    if node.tag == "main":
        return max(level, MAIN)
    return MAIN if not level and node.tag == "div" and "main" in node.names else level


def main_blocks(found: list) -> list:
    """Of the blocks not left out those of the article, else of main, else all."""
    found = [b for b in found if not b[3]]
    level = max((b[4] for b in found), default=0)
    return [b for b in found if b[4] == level]


def held(root: Node) -> bool:
    """Whether an element around an article or main is named as another part."""
    todo = [root]
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str) and c.holds:
                if named(c, 0) or named(c, 1):
                    return True
                todo.append(c)
    return False


def blocks(root: Node) -> list[tuple[str, Node, int, bool, int]]:
    """The blocks of a page. An element named as another part that holds articles is read where no article stands outside of it,
    if it holds the page's only one or more text than else is the main text; otherwise they are teasers or the like."""
    found = _blocks(root)
    if root.holds and held(root):
        own = main_blocks(found)
        level, size = max((b[4] for b in own), default=0), sum(len(b[0]) for b in own)
        if level in (0, MAIN):
            other = _blocks(root, holders=True)
            if sum(len(b[0]) for b in main_blocks(other)) > size or level == 0 and root.holds == 1:
                return other
    return found


def _blocks(root: Node, holders: bool = False) -> list[tuple[str, Node, int, bool, int]]:
    """Blocks in page order: text, its block element, the hash of the labels on the path to it, whether left out, and how it belongs to the main text."""
    out: list = []
    parts: list[str] = []

    def flush(state) -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, *state))

    # an explicit stack: pages may be nested deeper than Python may recurse
    todo: list = [(root, (root, step(0, "html"), False, 0), 0)]
    while todo:
        node, state, k = todo.pop()
        if k == 0 and node.tag in BLOCK:
            flush(todo[-1][1] if todo else state)
        children = node.children
        while k < len(children):
            child = children[k]
            k += 1
            if isinstance(child, str):
                parts.append(child)
                continue
            if child.tag in ("br", "hr", "img", "wbr"):
                parts.append(" " if child.tag != "wbr" else "")
            if child.tag in RAW:
                continue
            own, path, left, level = state
            left = left or outside(child, level, holders)
            level = level_of(child, level, root.holds_main)
            if child.tag in BLOCK:
                todo.append((node, state, k))
                flush(state)
                todo.append((child, (child, step(path, child.label), left, level), 0))
                break
            todo.append((node, state, k))
            todo.append((child, (own, path, left, level), 0))
            break
        else:
            if node.tag in BLOCK:
                flush(state)
    return out


# ---- trees and their alignment --------------------------------------------------------------------------------


def step(path: int, label: str) -> int:
    """The hash of a path of labels that goes on by one; the same in every process."""
    return xxhash.xxh64_intdigest(label, path) >> 2


def skeleton(root: Node) -> str:
    """The tree of a page as lines in preorder, depth and label of each node: block elements only, siblings of one label as one node with the children of all."""
    lines: list[str] = []
    todo: list[tuple[int, str, list[Node]]] = [(0, "html", [root])]
    while todo:
        depth, label, members = todo.pop()
        lines.append(f"{depth} {label}")
        groups: dict[str, list[Node]] = {}
        for n in members:
            found: list = list(reversed(n.children))
            while found:
                c = found.pop()
                if isinstance(c, str) or c.tag in RAW:
                    continue
                if c.tag in BLOCK:
                    groups.setdefault(c.label, []).append(c)
                else:
                    found.extend(reversed(c.children))
        todo += [(depth + 1, name, group) for name, group in reversed(groups.items())]
    return "\n".join(lines)


def nodes(tree: str) -> list[tuple[int, int]]:
    """The path's hash of each node, and the number of its parent (-1: none), in preorder."""
    out: list[tuple[int, int]] = []
    above: list[int] = []
    for line in tree.split("\n"):
        depth, label = line.split(" ", 1)
        del above[int(depth) :]
        parent = above[-1] if above else -1
        above.append(len(out))
        out.append((step(out[parent][0] if parent >= 0 else 0, label), parent))
    return out


def heaviest(rows: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """Of (place, weight) in order the heaviest subsequence of ascending places: its weight, and which rows it is made of."""
    if all(a[0] < b[0] for a, b in zip(rows, rows[1:], strict=False)):
        return sum(w for _, w in rows), list(range(len(rows)))
    ends: list[int] = []  # ascending places; a later one ends a heavier subsequence
    best: list[tuple[int, int]] = []  # its weight and its last row
    before = [-1] * len(rows)
    for k, (place, weight) in enumerate(rows):
        at = bisect_right(ends, place)
        total = weight
        if at:
            total += best[at - 1][0]
            before[k] = best[at - 1][1]
        stop = at
        while stop < len(ends) and best[stop][0] <= total:
            stop += 1
        ends[at:stop], best[at:stop] = [place], [(total, k)]
    total, k = best[-1]
    chosen = []
    while k >= 0:
        chosen.append(k)
        k = before[k]
    return total, chosen[::-1]


def matched(own: str, reference: str) -> tuple[int, dict[int, int]]:
    """Simple tree matching, the largest top-down, order-preserving match of equal labels: its size, and for the path of each matched node the
    number of the reference's node."""
    a = nodes(own)
    number = {path: k for k, (path, _) in enumerate(nodes(reference))}
    children: dict[int, list[int]] = {}
    for k, (path, parent) in enumerate(a):
        if path in number:
            children.setdefault(parent, []).append(k)
    weight: dict[int, int] = {}
    chosen: dict[int, list[int]] = {}
    for k in range(len(a) - 1, -1, -1):
        if a[k][0] in number:
            below = children.get(k, [])
            total, rows = heaviest([(number[a[c][0]], weight[c]) for c in below])
            weight[k], chosen[k] = 1 + total, [below[r] for r in rows]
    out, todo = {}, [0] if 0 in weight else []
    while todo:
        k = todo.pop()
        out[a[k][0]] = number[a[k][0]]
        todo += chosen[k]
    return weight.get(0, 0), out


_kept = lru_cache(512)(matched)
#: Trees of so many characters together are matched anew each time, so the memory of matches is bounded.
LARGE_TREES = 1 << 13


def aligned(own: str, reference: str) -> dict[int, int]:
    return (_kept if len(own) + len(reference) <= LARGE_TREES else matched)(own, reference)[1]


def slot(path: int, alignment: dict[int, int]) -> int:
    """The aligned node's number; below 0 for a node of no counterpart, by its path."""
    k = alignment.get(path)
    return k if k is not None else -1 - path


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


# ---- the operator -----------------------------------------------------------------------------------------------


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def copy_key(found: list) -> tuple[int, int, bool]:
    """What a page's copies share: the hash of its first h1 not left out (in an article or main, if there is one there), that of all text
    not left out, and whether the h1 may be the site's name. Without such an h1 the first is the second."""
    own = [b for b in found if not b[3]]
    body = text_hash("\n".join(b[0] for b in own))
    heads = [b for b in own if b[1].tag == "h1"]
    if not heads:
        return body, body, False
    head = next((b for b in heads if b[4]), heads[0])
    return text_hash(f"{min(head[4], 1)} {head[0]}"), body, not head[4]


TREE_TYPES = {"tree": pa.string(), "title": pa.int64(), "body": pa.int64(), "unsure": pa.bool_(), "hashes": pa.list_(pa.int64()), "paths": pa.list_(pa.int64())}


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for html in batch.column("html").to_pylist():
            root = parse(html or "")
            found = blocks(root)
            seen = [(t, path) for t, _, path, *_ in found]
            rows.append((skeleton(root), *copy_key(found), [text_hash(t) for t, _ in seen], [p for _, p in seen]))
        columns = list(zip(*rows, strict=True)) or [[]] * len(TREE_TYPES)
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, TREE_TYPES.values(), strict=True))], ["host", "row", *TREE_TYPES])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = []
        for tree, reference, where in zip(*(batch.column(c).to_pylist() for c in ("tree", "reference", "paths")), strict=True):
            alignment = aligned(tree, reference)
            slots.append([slot(p, alignment) for p in where])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("title"), pa.array(slots, pa.list_(pa.int64())), batch.column("hashes")], ["host", "title", "slots", "hashes"])


def induce(pages: DataFrame) -> DataFrame:
    """Wrappers: host, n_rows (pages), reference (a tree), template (slots and hashes of texts that stand on nearly all pages); hosts without template texts have none."""
    trees = pages.select(host(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("row"), "html").mapInArrow(_trees, "host string, row long, tree string, title long, body long, unsure boolean, hashes array<long>, paths array<long>")
    # differing pages of each h1, then of each host; pages without text are none
    richest = F.max(F.struct(F.length("tree").alias("n"), F.col("tree").alias("reference")))
    differing = trees.where(F.size("hashes") > 0).groupBy("host", "title", "unsure", "body").agg(richest.alias("r"), F.count("*").alias("n_rows"))
    titles = differing.groupBy("host", "title", "unsure").agg(F.max("r").alias("r"), F.count("*").alias("n_bodies"), F.sum("n_rows").alias("n_rows"))
    most = F.max(F.when(F.col("unsure"), F.struct("n_bodies", "title")))
    hosts = titles.groupBy("host").agg(F.max("r").alias("r"), most.alias("most"), F.sum("n_bodies").alias("n_bodies"), F.count("*").alias("n_titles"), F.sum("n_rows").alias("n_rows"))
    named = F.coalesce((F.col("most.n_bodies") > 1) & (F.col("most.n_bodies") >= SHARE * F.col("n_bodies")), F.lit(False))
    hosts = hosts.select("host", "n_rows", "r.reference", F.when(named, F.col("most.title")).alias("site"), (F.col("n_titles") + F.when(named, F.col("most.n_bodies") - 1).otherwise(0)).alias("n_titles"))
    references = stored(hosts.where(F.col("n_titles") >= LEAST_PAGES), "references")
    votes = keyed_join(trees, references.drop("n_titles"), "host", ["row"]).withColumn("title", F.when(F.col("title") == F.col("site"), F.col("body")).otherwise(F.col("title")))
    votes = votes.select("host", "tree", "reference", "title", "hashes", "paths").mapInArrow(_slots, "host string, title long, slots array<long>, hashes array<long>")
    votes = votes.select("host", "title", F.explode(F.arrays_zip("slots", "hashes")).alias("x")).select("host", "x.slots", "x.hashes", "title").distinct()
    counted = votes.groupBy("host", "slots", "hashes").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    constant = keyed_join(counted, references.drop("reference", "site"), "host", ["slots", "hashes"]).where(F.col("n") >= SHARE * F.col("n_titles"))
    # at most 1 / SHARE times the blocks of a page
    templates = constant.groupBy("host").agg(F.collect_list(F.struct(F.col("slots").alias("slot"), F.col("hashes").alias("hash"))).alias("template"))
    return references.drop("n_titles", "site").join(templates, "host")


def main_text(html: str | None, reference: str | None = None, template: frozenset = frozenset()) -> str:
    root = parse(html or "")
    found = blocks(root)
    if template and found:
        alignment = aligned(skeleton(root), reference)
        found = [b for b in found if (slot(b[2], alignment), text_hash(b[0])) not in template]
    return "\n".join(b[0] for b in main_blocks(found))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row for each page."""
    wrappers = stored(induce(pages), "wrappers")
    joined = keyed_join(pages.select("page_id", "url", "html", host(F.col("url")).alias("host")), wrappers, "host", ["page_id", "url"], "left").select("page_id", "url", "html", "reference", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, reference, template in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "template")), strict=True):
                texts.append(main_text(html, reference, frozenset((t["slot"], t["hash"]) for t in template or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"))
