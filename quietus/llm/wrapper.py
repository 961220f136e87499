"""Main text of pages by wrapper induction: pages of one host share a template, found by simple tree matching of their trees.

Every page is read into its blocks, and runs of like blocks become one node, so pages of one make share a skeleton. Spark sums by host, skeleton and node how long the texts are, how much of them is
links, and whether all pages say the same. The skeletons of a host are then merged into its template: two trees at a time, aligned by simple tree matching, in groups of bounded size and in as many
rounds as their number asks for, so a host of very many pages or makes is no task's whole load. A template's nodes whose text is the same on all pages are the wrapper; of the slots that
vary, those that elements, roles or names mark as menus, headers, footers, sidebars, notices, adverts, forms or comments go too; the article is the slot
that states it, or the smallest that holds most of what varies. Each skeleton is aligned with its host's template once more and takes the nodes to keep from it; pages are
joined to that small table, broadcast while its counted size allows.

Edge cases: a null or empty html has an empty text; a null url, or one without a host, belongs to the host of that name, none; a host with fewer than ``SUPPORT`` different texts has no wrapper that its pages prove, only marked slots; a page whose
slots are not in the host's article is judged by its own tree; copies of one text count once; page ids may be null or repeated, and repeated rows are all returned; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietus.llm import dom
from quietus.session import TEXTS, if_small, kept

#: Different main texts that must agree on a node for its text to be the wrapper's.
SUPPORT = 4
#: Trees merged in one group.
GROUP = 16
#: Rows of verdicts (some hundred bytes) that may be broadcast.
BROADCAST_VERDICTS = 100_000
#: Pages that go to Python at once.
PAGES = TEXTS // 4

#: Elements, roles and words of names that mark what is no part of an article.
NEVER_ELEMENTS = frozenset("nav footer aside menu dialog search".split())
SOFT_ELEMENTS = frozenset("form header fieldset".split())
NEVER_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar tooltip banner".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus replies".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar footer cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets pagination pager teaser teasers banner".split()
)
SOFT_WORDS = frozenset("header masthead login form".split())
ARTICLE_ROLES = frozenset("main article articlebody article-body".split())
LEAVES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption caption legend summary".split())


def _parts(label: str) -> tuple[str, list[str], list[str]]:
    """(element, words, roles) of a label."""
    head, *marks = label.rstrip("*").replace("@", "\0@").replace(".", "\0.").split("\0")
    return head, [m[1:] for m in marks if m[0] == "."], [m[1:] for m in marks if m[0] == "@"]


@lru_cache(100_000)
def kind(label: str) -> str:
    """``never``, ``comment``, ``soft`` (unless it holds the article), ``article`` or nothing."""
    element, words, roles = _parts(label)
    if COMMENT_WORDS & set(words):
        return "comment"
    if element in NEVER_ELEMENTS or NEVER_ROLES & set(roles) or NEVER_WORDS & set(words):
        # A name on the whole page's frame (``has-sidebar``) is told by what it holds, see ``chosen``.
        return "never" if element in NEVER_ELEMENTS or NEVER_ROLES & set(roles) else "named"
    if element in SOFT_ELEMENTS or SOFT_WORDS & set(words):
        return "soft"
    return "article" if element in ("article", "main") or ARTICLE_ROLES & set(roles) else ""


def noisy(label: str) -> bool:
    return kind(label) in ("never", "comment", "named")


class Node:
    """A node of a template: n pages' main texts behind it, characters of text outside and inside links, smallest and largest hash of a page's text there."""

    __slots__ = ("children", "hi", "label", "link", "lo", "n", "size", "text")

    def __init__(self, label: str, n: int, text: int, link: int, lo: int, hi: int, children: list[Node] | None = None):
        self.label, self.n, self.text, self.link, self.lo, self.hi = label, n, text, link, lo, hi
        self.children = children if children is not None else []
        self.size = 1

    def like(self, other: Node) -> bool:
        return self.label.rstrip("*") == other.label.rstrip("*")


def _flat(root: Node) -> list[tuple[int, Node]]:
    out, todo = [], [(0, root)]
    while todo:
        depth, node = todo.pop()
        out.append((depth, node))
        todo += [(depth + 1, c) for c in reversed(node.children)]
    return out


def packed(root: Node) -> str:
    return json.dumps([[d, x.label, x.n, x.text, x.link, x.lo, x.hi] for d, x in _flat(root)], separators=(",", ":"))


def tree(depths: list[int], nodes: list[Node]) -> Node:
    """Nodes in page order with their depths, as a tree; sizes are filled in."""
    path: list[Node] = []
    for depth, node in zip(depths, nodes, strict=True):
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    for node in reversed(nodes):
        node.size = 1 + sum(c.size for c in node.children)
    return nodes[0]


def unpacked(text: str) -> Node:
    rows = json.loads(text)
    return tree([r[0] for r in rows], [Node(*r[1:]) for r in rows])


def matching(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: the most pairs of like nodes that keep parents and order, where the two roots are a pair."""
    if not a.like(b):
        return 0
    if (found := memo.get((id(a), id(b)))) is not None:
        return found[0]
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        above, row = rows[-1], [0]
        for k, y in enumerate(b.children):
            best = max(row[-1], above[k + 1])
            if min(x.size, y.size) + above[k] > best:
                best = max(best, above[k] + matching(x, y, memo))
            row.append(best)
        rows.append(row)
    memo[id(a), id(b)] = (score := 1 + rows[-1][-1], rows)
    return score


def pairs(a: Node, b: Node, memo: dict) -> list[tuple[Node | None, Node | None]]:
    """The children of two matched nodes in order: pairs, and those that stand alone."""
    matching(a, b, memo)
    rows = memo[id(a), id(b)][1]
    i, k, out = len(a.children), len(b.children), []
    while i or k:
        if i and k and (w := matching(a.children[i - 1], b.children[k - 1], memo)) and rows[i][k] == rows[i - 1][k - 1] + w:
            i, k = i - 1, k - 1
            out.append((a.children[i], b.children[k]))
        elif k and rows[i][k] == rows[i][k - 1]:
            k -= 1
            out.append((None, b.children[k]))
        else:
            i -= 1
            out.append((a.children[i], None))
    return out[::-1]


def merged(a: Node, b: Node, memo: dict | None = None) -> Node:
    """One tree with the nodes of both."""
    memo = {} if memo is None else memo
    out = Node(a.label if a.label.endswith("*") else b.label, a.n + b.n, a.text + b.text, a.link + b.link, min(a.lo, b.lo), max(a.hi, b.hi))
    out.children = [merged(x, y, memo) if x and y else x or y for x, y in pairs(a, b, memo)]
    out.size = 1 + sum(c.size for c in out.children)
    return out


def chosen(root: Node) -> set[int]:
    """ids of the nodes whose own text is the article's."""
    flat = _flat(root)
    # Holds an article, or its heading, that no mark takes out.
    held: dict[int, bool] = {}
    titled: dict[int, bool] = {}
    for _, x in reversed(flat):
        own = kind(x.label)
        out = own in ("comment", "never")
        held[id(x)] = not out and (own == "article" or any(held[id(c)] for c in x.children))
        titled[id(x)] = not out and not x.label.startswith("header") and (x.label.startswith("h1") and x.text > 0 or any(titled[id(c)] for c in x.children))

    def alive(lenient: bool) -> tuple[dict[int, bool], set[int]]:
        keep, articles = {}, set()

        def walk(x: Node, within: bool) -> None:
            own = kind(x.label)
            if own in ("never", "comment") or own == "named" and not held[id(x)] and not titled[id(x)]:
                return
            if own == "soft" and not lenient and not held[id(x)] and not (within and "form" not in x.label.split(".")[0] and "fieldset" not in x.label):
                return
            keep[id(x)] = True
            if own == "article":
                articles.add(id(x))
            for c in x.children:
                walk(c, within or own == "article")

        walk(root, False)
        return keep, articles

    keep, articles = alive(False)
    if not sum(x.text for _, x in flat if id(x) in keep):
        keep, articles = alive(True)  # a page that is a form as a whole

    def wraps(x: Node) -> bool:
        return x.n >= SUPPORT and x.lo == x.hi and not x.label.endswith("*") and not x.label.startswith("h1")

    def weight(x: Node) -> tuple[int, int]:
        if id(x) not in keep:
            return 0, 0
        texts, links = (0, 0) if wraps(x) else (x.text, x.link)
        for c in x.children:
            t, k = weights[id(c)]
            texts, links = texts + t, links + k
        return texts, links

    weights: dict[int, tuple[int, int]] = {}
    for _, x in reversed(flat):
        weights[id(x)] = weight(x)
    whole = sum(weights[id(root)])
    total = lambda x: sum(weights[id(x)])
    found = [x for _, x in flat if id(x) in articles]
    inner = [x for x in found if x.label.startswith("article")] or found
    best = max((total(x) for x in inner), default=0)
    has: dict[int, bool] = {}
    for _, x in reversed(flat):
        has[id(x)] = x in found or any(has[id(c)] for c in x.children)
    rival = max((total(x) for _, x in flat if id(x) in keep and not has[id(x)]), default=0)  # an article's own parts are no more than it is
    if best and best >= 0.5 * rival:
        heads = [x for x in inner if total(x) >= 0.5 * best]
        stated = True
    else:
        at, stated = root, False
        while True:
            if any(c.label.rstrip("*").split(".")[0] in ("h1", "h2") and total(c) for c in at.children):
                break
            down = max(at.children, key=total, default=None)
            if down is None or total(down) < 0.7 * total(at) or not total(down) or down.label.rstrip("*").split(".")[0].split("@")[0] in LEAVES:
                break
            at = down
        heads = [at]
    out: set[int] = set()

    def take(x: Node) -> None:
        if id(x) not in keep:
            return
        texts, links = weights[id(x)]
        if not stated and x not in heads and links > 0.6 * (texts + links) and texts + links < 0.3 * whole and x.label.rstrip("*").split(".")[0] not in LEAVES:
            return  # a menu without a name
        if not wraps(x):
            out.add(id(x))
        for c in x.children:
            take(c)

    for x in heads:
        take(x)
    if stated and not any(id(x) in out and x.label[:2] in ("h1", "h2") for _, x in flat):
        first = next((k for k, (_, x) in enumerate(flat) if x is heads[0]), 0)
        out |= {id(x) for _, x in flat[:first] if x.label.startswith("h1") and id(x) in keep}
    return out


def verdict(own: Node, template: Node) -> list[int]:
    """The nodes of a skeleton, by place, whose text stays: as its host's template has it, or by itself where that leaves nothing."""
    flat = _flat(own)
    keep, memo = chosen(template), {}
    to: dict[int, Node] = {}
    todo = [(own, template)]
    while todo:
        a, b = todo.pop()
        to[id(a)] = b
        for x, y in pairs(a, b, memo):
            if x is not None and y is not None:
                todo.append((x, y))
    out = [k for k, (_, x) in enumerate(flat) if id(x) in to and id(to[id(x)]) in keep]
    if sum(flat[k][1].text + flat[k][1].link for k in out) == 0:
        alone = chosen(own)
        out = [k for k, (_, x) in enumerate(flat) if id(x) in alone]
    return out


DISSECTED = "struct<skeleton:string,body:long,texts:array<long>,links:array<long>,hashes:array<long>,nodes:array<int>,pieces:array<string>>"


def dissect(html: pd.Series) -> pd.DataFrame:
    """A page's skeleton as JSON, the hash of its longest node's text, per node characters outside and inside links and the text's hash, and its texts with their nodes."""
    out = []
    for page in html:
        read = dom.read(page, noisy)
        found = dom.skeleton(read)
        n = len(found.labels)
        texts, links, own = [0] * n, [0] * n, [[] for _ in range(n)]
        for block, text, linked in read.pieces:
            k = found.node[block]
            texts[k] += len(text) - linked
            links[k] += linked
            own[k].append(text)
        hashes = [xxhash.xxh64_intdigest("\n".join(t)) - (1 << 63) for t in own]
        longest = max(range(n), key=texts.__getitem__)
        out.append((json.dumps([found.depths, found.labels], separators=(",", ":")), hashes[longest], texts, links, hashes, [found.node[b] for b, _, _ in read.pieces], [t for _, t, _ in read.pieces]))
    return pd.DataFrame(out, columns=["skeleton", "body", "texts", "links", "hashes", "nodes", "pieces"])


def _tree(skeleton: pd.Series, n: pd.Series, stats: pd.Series) -> pd.Series:
    """A skeleton with its sums, as a packed tree."""

    def one(text: str, pages: int, rows) -> str:
        depths, labels = json.loads(text)
        by = {r["k"]: r for r in rows}
        return packed(tree(depths, [Node(x, int(pages), *(int(by[k][c]) for c in ("text", "link", "lo", "hi"))) for k, x in enumerate(labels)]))

    return pd.Series([one(*x) for x in zip(skeleton, n, stats, strict=True)])


def _verdict(own: pd.Series, template: pd.Series) -> pd.Series:
    read = lru_cache(64)(unpacked)
    return pd.Series([verdict(unpacked(a), read(b)) for a, b in zip(own, template, strict=True)])


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def skeletons(read: DataFrame) -> DataFrame:
    """(host, name, tree) of every skeleton of a host, from host, name, skeleton, body, texts, links, hashes of its pages."""
    bodies = read.groupBy("host", "name", "body").agg(F.lit(1).alias("one")).groupBy("host", "name").agg(F.count("*").alias("n"))
    nodes = read.select("host", "name", F.posexplode(F.arrays_zip("texts", "links", "hashes")).alias("k", "x")).select("host", "name", "k", "x.*")
    sums = nodes.groupBy("host", "name", "k").agg(F.sum("texts").alias("text"), F.sum("links").alias("link"), F.min("hashes").alias("lo"), F.max("hashes").alias("hi"))
    stats = sums.groupBy("host", "name").agg(F.collect_list(F.struct("k", "text", "link", "lo", "hi")).alias("stats"))  # NODES at most
    texts = read.groupBy("name").agg(F.any_value("skeleton").alias("skeleton"))
    return bodies.join(stats, ["host", "name"]).join(texts, "name").select("host", "name", F.pandas_udf(_tree, "string")("skeleton", "n", "stats").alias("tree"))


def templates(trees: DataFrame) -> DataFrame:
    """(host, template): the trees (host, name, tree) of each host merged into one, ``GROUP`` or so at a time."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        whole = unpacked(pdf["tree"].iloc[0])
        for text in pdf["tree"].iloc[1:]:
            whole = merged(whole, unpacked(text))
        return pdf.head(1).assign(tree=packed(whole))[["host", "name", "tree"]]

    while True:
        counts = trees.groupBy("host").agg(F.count("*").alias("many"))
        if counts.where("many > 1").isEmpty():
            return trees.select("host", F.col("tree").alias("template"))
        sized = trees.join(counts, "host")
        group = F.pmod(F.xxhash64("name"), F.ceil(F.col("many") / F.lit(float(GROUP)))).alias("at")
        rest = sized.where("many > 1").select("host", "name", "tree", group).groupBy("host", "at").applyInPandas(merge, "host string, name long, tree string")
        trees = kept(sized.where("many = 1").select("host", "name", "tree").unionByName(rest), "templates")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    page = rows.select("page_id", "url", host_of("url").alias("host"), F.pandas_udf(dissect, DISSECTED)("html").alias("d"))
    name = F.xxhash64("d.skeleton").alias("name")
    read = kept(page.select("host", name, "d.skeleton", "d.body", "d.texts", "d.links", "d.hashes"), "pages", PAGES)
    trees = kept(skeletons(read), "skeletons")
    verdicts = kept(trees.join(templates(trees), "host").select("host", "name", F.pandas_udf(_verdict, "array<int>")("tree", "template").alias("keep")), "verdicts")
    texts = page.select("page_id", "url", "host", name, "d.nodes", "d.pieces").join(if_small(verdicts, BROADCAST_VERDICTS), ["host", "name"])
    stays = F.filter(F.arrays_zip("nodes", "pieces"), lambda x: F.array_contains("keep", x["nodes"]))
    text = F.array_join(F.transform(stays, lambda x: x["pieces"]), "\n")
    return kept(texts.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long")), "texts", PAGES)
