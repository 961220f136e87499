"""Pages as trees of blocks: a tolerant reader of HTML, and the skeleton of a page, in which runs of like blocks are one node.

Reading follows what browsers do with faulty pages as far as text needs it: end tags may be missing, misnested or unknown, comments and quotes may be left open, raw text ends at its own
end tag. A page is gone through once.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?--!?>|.*)|[!?][^>]*>|/(?![A-Za-z])[^>]*>|(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*"|=\s*+'[^']*'|["'=])*+)>)""", re.S)
_OPEN_END = re.compile(r"<[A-Za-z/!?]")
_ATTR = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s"'/]|$)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: The elements of HTML that are blocks, that have no end, whose text is raw, and that show no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg canvas audio video object select button datalist".split())
#: Open elements that a start tag ends, and those beyond which it does not look.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
#: Elements that come in runs: several in a row are one node of the skeleton. Of others, this many.
RUNS = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 blockquote pre figure".split())
LIKE = 4
#: Open elements beyond which a block is its ancestor's, as in browsers.
NESTED = 512
#: Beyond so many children of a node, those of one label are one; beyond so many nodes, deep ones are their ancestors.
WIDE, DEEP, NODES = 24, 40, 500


class Page(NamedTuple):
    """labels, parents (indices, -1 for the root) of a page's blocks, and its pieces of text in order: (block, text, characters in links)."""

    labels: list[str]
    parents: list[int]
    pieces: list[tuple[int, str, int]]


def _label(name: str, attrs: str) -> tuple[str, bool]:
    """(label, hidden): the element with the words of its class, id and role, without digits."""
    marks: list[str] = []
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return name, True
        if key == "style" or key == "aria-hidden":
            continue
        words = [w.lower() for w in _WORDS.findall(value)][:8]
        marks += [f"@{'-'.join(words)}"] if key in ("role", "itemprop") else [f".{w}" for w in words]
    return name + "".join(dict.fromkeys(marks)), False


def read(html: str | None, noisy=lambda label: False) -> Page:
    """The blocks and text of a page. Inline elements whose label is ``noisy`` are left out."""
    html = html or ""
    whole = html.rfind(">") + 1
    labels, parents, pieces = ["root"], [-1], []
    stack: list[tuple[str, int]] = []  # open elements and their blocks, -1 for inline ones, -2 for silent ones
    open_: Counter = Counter()
    block, silent, links = 0, 0, 0
    held: list[str] = []
    linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if silent or not raw:
            return
        shown = _html.unescape(raw) if "&" in raw else raw
        held.append(shown)
        if links:
            linked += len(shown.strip())

    def flush() -> None:
        nonlocal linked
        if held:
            joined = " ".join("".join(held).split())
            if joined:
                pieces.append((block, joined, min(linked, len(joined))))
            held.clear()
        linked = 0

    def close(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal block, silent, links
        while len(stack) > k:
            name, at = stack.pop()
            open_[name] -= 1
            if at == -2:
                silent -= 1
            elif at >= 0:
                flush()
                block = parents[at]
            elif name == "a":
                links -= 1

    at = 0
    while at < whole and (m := _TAG.search(html, at, whole)):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                text(" ")
            elif name in ("html", "body", "head"):
                if not silent:
                    flush()
            elif name == "p" and not open_["p"]:
                flush()
            elif open_[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if name not in BLOCKS and stack[k][1] >= 0 and name not in SILENT:
                        break  # an inline end tag does not end a block
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in ("html", "body", "head"):
            if not silent:
                flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text(" ")
            continue
        attrs = m[3]
        if name in BLOCKS:
            if name not in ("li", "dt", "dd", "tr", "td", "th") and open_["p"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in ("td", "th", "table"):
                        break
            if any(open_[x] for x in _ENDS.get(name, ())):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _SCOPE[name]:
                        break
                    if stack[k][0] in _ENDS[name]:
                        close(k)
                        if name not in ("tr", "tbody", "tfoot"):
                            break
        label, hidden = _label(name, attrs) if attrs else (name, False)
        if attrs.endswith("/") and name not in BLOCKS:
            continue
        if len(stack) >= NESTED and name not in SILENT:
            if name in BLOCKS:
                flush()
            continue
        open_[name] += 1
        if name in SILENT or hidden or name not in BLOCKS and noisy(label):
            stack.append((name, -2))
            silent += 1
        elif name in BLOCKS:
            flush()
            labels.append(label)
            parents.append(block)
            block = len(labels) - 1
            stack.append((name, block))
        else:
            stack.append((name, -1))
            links += name == "a"
    rest = html[at:]
    cut = _OPEN_END.search(rest)  # a tag that never ends
    text(rest[: cut.start()] if cut else rest)
    close(0)
    flush()
    return Page(labels, parents, pieces)


class Skeleton(NamedTuple):
    """Nodes in page order of their first blocks, parents before children: depth and label (``*`` behind runs), and the node of each block."""

    depths: list[int]
    labels: list[str]
    node: list[int]


def skeleton(page: Page) -> Skeleton:
    """Runs of like blocks become one node, and their parts likewise; the text of a block belongs to its node."""
    below: list[list[int]] = [[] for _ in page.labels]
    for k, parent in enumerate(page.parents):
        if parent >= 0:
            below[parent].append(k)
    deep = DEEP
    while True:
        found = _skeleton(page, below, deep)
        if len(found.labels) <= NODES or deep == 1:
            return found
        deep //= 2


def _groups(labels: list[str], blocks: list[int], below: list[list[int]]) -> list[list[int]]:
    groups: list[list[int]] = []
    if len(blocks) == 1:
        for k in below[blocks[0]]:
            if groups and labels[groups[-1][0]] == labels[k]:
                groups[-1].append(k)
            else:
                groups.append([k])
        groups = [part for g in groups for part in ([g] if len(g) >= LIKE or labels[g[0]].split(".")[0].split("@")[0] in RUNS else [[k] for k in g])]
        if len(groups) <= WIDE:
            return groups
    by: dict[str, list[int]] = {}
    for b in blocks:
        for k in below[b]:
            by.setdefault(labels[k], []).append(k)
    if len(by) > WIDE:  # names that are made for each block say nothing
        short: dict[str, list[int]] = {}
        for label, ks in by.items():
            short.setdefault(label.split(".")[0].split("@")[0], []).extend(ks)
        by = short
    return list(by.values())


def _skeleton(page: Page, below: list[list[int]], deep: int) -> Skeleton:
    depths, labels, node = [], [], [0] * len(page.labels)
    todo = [(0, [0])]
    while todo:
        depth, blocks = todo.pop()
        me = len(labels)
        same = len({page.labels[b] for b in blocks}) == 1
        label = page.labels[blocks[0]] if same else page.labels[blocks[0]].split(".")[0].split("@")[0]
        depths.append(depth)
        labels.append(label + "*" * (len(blocks) > 1 or label.split(".")[0].split("@")[0] in RUNS))
        for b in blocks:
            node[b] = me
        if depth == deep:
            rest = [k for b in blocks for k in below[b]]
            while rest:
                k = rest.pop()
                node[k] = me
                rest += below[k]
        else:
            todo += [(depth + 1, g) for g in reversed(_groups(page.labels, blocks, below))]
    return Skeleton(depths, labels, node)
