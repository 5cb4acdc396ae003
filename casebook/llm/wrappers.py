"""Main text of web pages by wrapper induction.

Pages of a host share a few templates, told by their containers. A page of each
template, the first by a hash, gives a reference tree; every page is aligned
with it by simple tree matching. Counts over the different pages of the
template, copies counted once, then tell template nodes, whose text stays
the same, from slots, whose text varies, and the slot with the most varying
text, with its siblings, from the others. Runs of like siblings count as one node, so that lists
and paragraphs of any length align. That slot, with the article around it, is
the text on every page that has it, without constant nodes and the elements
for menus, footers, side bars and forms. Class names are evidence only: text
under one counts a quarter when the slot is chosen. Where no slot is known,
as on a host with a single page, articles, else all blocks are the text, and
class names tell menus, notices, adverts and reader comments.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table

# Element and class names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("nav footer aside form menu dialog button select head".split())
_NAMES = (
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments disqus respond replies cookie cookies consent notice popup modal newsletter subscribe subscription share sharing social "
    "related recommended widget toolbar login search pagination pager copyright"
).split()
_ENDINGS = "area banner bar block box buttons container form items links list menu posts section widget wrap wrapper".split()
_FRONTS = "bottom left main page right site top".split()
#: Whole tokens of class or role.
SKIPPED_NAMES = frozenset(
    _NAMES + ["contentinfo", "complementary"] + [f"{x}{d}{e}" for x in _NAMES for e in _ENDINGS for d in "-_"]
    + [f"{e}{d}{x}" for x in ("ad", "banner", "footer", "menu", "nav", "navigation", "sidebar") for e in _FRONTS for d in "-_"]
)
UNNAMED = frozenset("root html body main article h1 h2 h3 h4 h5 h6".split())  # no name leaves these out
BOXES = frozenset("div section ul ol dl table details header address".split())  # inside an article names leave out only these
PAGE = frozenset("root html body".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^'\">]|\"[^\"]*\"|'[^']*')*+>|[^<]+|<", re.S)
_OPEN = re.compile(r"</?[a-zA-Z]")
_QUOTED = re.compile(r"[>\"']")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    """A block element: what it holds in order, text and nodes."""

    __slots__ = ("tag", "marks", "named", "parts", "parent", "weight", "articles", "mains")

    def __init__(self, tag: str, token: str = "", parent: Node | None = None):
        self.tag, self.parts, self.parent = tag, [], parent
        self.marks, self.named = _marks(token) if "=" in token else ("", False)
        self.named = self.named and tag not in UNNAMED
        above = 4 if parent is None else parent.weight
        #: Evidence that a node is text: 0 in a menu, form or the like, 1 under a skipped name, else 4.
        self.weight = 0 if tag in SKIPPED else min(above, 1) if self.named else above
        self.articles = self.mains = 0  # outermost elements inside, but for those in skipped elements

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag

    @property
    def skipped(self) -> bool:
        return self.tag in SKIPPED


class _Ends:
    """Where tags and elements of a page end; what was looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page, self.last, self.missing = page, page.rfind(">"), set()
        self.places: list[int] | None = None

    def tag(self, at: int) -> int:
        """The place after the ">" that ends a tag with a name at ``at``, quoted ones passed over; -1 if there is none."""
        if self.places is None:
            self._index()
        k = bisect_left(self.places, at)
        return self.ends[k]

    def _index(self) -> None:
        """From right to left: the end that is reached outside quotes from each ">" and quote."""
        self.places = [m.start() for m in _QUOTED.finditer(self.page)]
        self.ends = [-1] * (len(self.places) + 1)
        ahead: dict[str, int] = {}
        for k in range(len(self.places) - 1, -1, -1):
            sign = self.page[self.places[k]]
            self.ends[k] = self.places[k] + 1 if sign == ">" else self.ends[ahead[sign] + 1] if sign in ahead else -1
            ahead[sign] = k

    def element(self, tag: str, at: int) -> int:
        """The place after the end tag of an element; -1 if there is none."""
        if tag in self.missing:
            return -1
        found = re.compile(rf"</{re.escape(tag)}\b", re.I).search(self.page, at)
        end = self.page.find(">", found.end()) if found else -1
        if end < 0:
            self.missing.add(tag)
        return end + 1 if end >= 0 else -1


def _tokens(page: str, ends: _Ends) -> Iterator[tuple[str, int]]:
    """(token, place after it); a place sent back is where the next token starts."""
    at, broken = 0, False
    while at < len(page):
        if page[at] == "<" and not page.startswith("<!--", at) and (at > ends.last or broken and _OPEN.match(page, at)):
            end = ends.tag(at) if at <= ends.last else -1
            token, at = (page[at:end], end) if end > 0 else ("<", at + 1)
        else:
            token = _TOKEN.match(page, at)[0]
            broken |= token == "<" and _OPEN.match(page, at) is not None  # a tag without an end: from here on ends are looked up
            at += len(token)
        moved = yield token, at
        if moved is not None:
            at = moved
            yield "", at


def parse(page: str) -> Node:
    """Tree of block elements. Inline elements leave their text, unclosed ones end with their parent.

    The time grows with the length of the page, whatever is nested or left open in it.
    """
    root = here = Node("root")
    ends = _Ends(page)
    count: Counter[str] = Counter()  # open elements by tag

    def enter(node: Node) -> Node:
        node.parent.parts.append(node)
        count[node.tag] += 1
        nodes.append(node)
        return node

    def leave(node: Node) -> Node:
        count[node.tag] -= 1
        return node.parent

    nodes: list[Node] = []
    tokens = _tokens(page, ends)
    for token, at in tokens:
        if not token:
            continue
        if token[0] != "<" or len(token) == 1:
            here.parts.append(html.unescape(token) if "&" in token else token)
            continue
        name = _NAME.match(token)
        if name is None:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if here.parent is not None and here.tag == tag:
                here = leave(here)
            elif tag in BLOCK and count[tag] > 0:
                while here.tag != tag:
                    here = leave(here)
                here = leave(here)
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                end = ends.element(tag, at)
                tokens.send(end if end >= 0 else len(page))
            continue
        if tag == "br" or tag not in BLOCK and tag not in VOID:
            if tag == "br":
                here.parts.append(" ")
                continue
            if tag not in SKIPPED:
                if not token.endswith("/>") and "=" in token and (node := Node(tag, token, here)).named:  # an inline advert or the like
                    here = enter(node)
                continue
        if tag in VOID:
            continue
        while tag in BLOCK and (here.tag == "p" or here.tag not in BLOCK and here is not root):
            here = leave(here)
        while here.parent is not None and here.tag in CLOSED_BY.get(tag, ()):
            here = leave(here)
        if tag in BLOCK:
            here = enter(Node(tag, token, here))
        elif not token.endswith("/>") and (end := ends.element(tag, at)) >= 0:  # an inline button: left out as a whole
            tokens.send(end)
    for node in reversed(nodes):  # children come before their parents
        if not node.skipped:
            above = node.parent
            above.articles += 1 if node.tag == "article" else node.articles
            above.mains += 1 if node.tag == "main" else node.mains
    return root


def _marks(token: str) -> tuple[str, bool]:
    """Class, id and role of a tag, and whether a whole token of class or role is a skipped name."""
    found = [(kind.lower(), x) for kind, *values in _MARK.findall(token) for y in values for x in y.lower().split()]
    return " ".join(sorted({x for _, x in found})), any(kind != "id" and x in SKIPPED_NAMES for kind, x in found)


@dataclass
class Group:
    """A run of like siblings: one node of the aligned tree."""

    label: str
    nodes: list[Node]
    children: list[Group]


def _runs(nodes: list[Node]) -> list[Group]:
    out: list[Group] = []
    for node in nodes:
        if out and out[-1].label == node.label:
            out[-1].nodes.append(node)
        else:
            out.append(Group(node.label, [node], []))
    return out


def grouped(nodes: list[Node]) -> list[Group]:
    """Groups of a sequence of siblings, with those of their children."""
    out = _runs(nodes)
    left = list(out)
    while left:
        g = left.pop()
        g.children = _runs([x for node in g.nodes for x in node.parts if isinstance(x, Node)])
        left.extend(g.children)
    return out


def own_text(group: Group) -> str:
    return _SPACE.sub(" ", " ".join(x for node in group.nodes for x in node.parts if isinstance(x, str))).strip()


def _shapes(top: list, parts, known: dict[tuple, int]) -> dict[int, int]:
    """Number of the shape of each child list below ``top``: equal labels all the way down have one number; an empty list has 0."""
    lists, left = [], [top]
    while left:
        here = left.pop()
        lists.append(here)
        left.extend(inner for x in here if (inner := parts(x)[1]))
    numbers: dict[int, int] = {}
    for here in reversed(lists):
        shape = tuple((label, numbers[id(inner)] if inner else 0) for label, inner in map(parts, here))
        numbers[id(here)] = known.setdefault(shape, len(known)) if shape else 0
    return numbers


def match(a: list, b: list[Group]) -> tuple[int, list[tuple[int, Group]]]:
    """Simple tree matching of two child sequences: most matched nodes in order, and the pairs (reference number, group).

    Reference nodes are [number, label, children, text]. Each pair of
    different shapes is settled once, from the leaves up, on a stack of its own.
    """
    known: dict[tuple, int] = {(): 0}
    left_shapes = _shapes(a, lambda x: (x[1], x[2]), known)
    right_shapes = _shapes(b, lambda y: (y.label, y.children), known)
    shapes = list(known)
    settled: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(left_shapes[id(a)], right_shapes[id(b)], False)]
    while todo:
        p, q, ready = todo.pop()
        if (p, q) in settled:
            continue
        if ready:
            settled[p, q] = _aligned_children(shapes[p], shapes[q], settled)
            continue
        todo.append((p, q, True))
        inside: dict[str, list[int]] = {}
        for label, shape in set(shapes[q]):
            if shape:
                inside.setdefault(label, []).append(shape)
        todo.extend((shape, other, False) for label, shape in set(shapes[p]) if shape for other in inside.get(label, ()))
    pairs, left = [], [(a, b)]
    while left:
        xs, ys = left.pop()
        for i, j in settled[left_shapes[id(xs)], right_shapes[id(ys)]][1]:
            x, y = xs[i], ys[j]
            pairs.append((x[0], y))
            if x[2] and y.children:
                left.append((x[2], y.children))
    return settled[left_shapes[id(a)], right_shapes[id(b)]][0], pairs


#: Shorter products of two sequences are settled in lists, which is faster for them; the result is the same.
WIDE = 2000


def _aligned_children(a: tuple, b: tuple, settled: dict) -> tuple[int, list[tuple[int, int]]]:
    """(score, places matched, in reverse order) of two sequences of (label, shape) whose inner pairs are settled."""
    if not a or not b:
        return 0, []
    if len(a) * len(b) > WIDE:
        return _aligned_wide(a, b, settled)
    scores = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (label, shape) in enumerate(a, 1):
        above, row = scores[i - 1], scores[i]
        for j, (other, inner) in enumerate(b, 1):
            best = above[j] if above[j] > row[j - 1] else row[j - 1]
            if label == other:
                best = max(best, above[j - 1] + 1 + (settled[shape, inner][0] if shape and inner else 0))
            row[j] = best
    return scores[-1][-1], _places(a, b, settled, scores.__getitem__)


def _places(a: tuple, b: tuple, settled: dict, row_of) -> list[tuple[int, int]]:
    i, j, places = len(a), len(b), []
    row, above = row_of(i), row_of(i - 1)
    while i and j:
        (label, shape), (other, inner) = a[i - 1], b[j - 1]
        if label == other and row[j] == above[j - 1] + 1 + (settled[shape, inner][0] if shape and inner else 0):
            i, j = i - 1, j - 1
            places.append((i, j))
        elif row[j] == above[j]:
            i -= 1
        else:
            j -= 1
            continue
        row, above = above, row_of(i - 1) if i else above
    return places


def _aligned_wide(a: tuple, b: tuple, settled: dict) -> tuple[int, list[tuple[int, int]]]:
    """The same a row of scores at a time; every so many rows are kept, and those between are made again on the way back."""
    at: dict[str, np.ndarray] = {}
    labels = np.array([label for label, _ in b], object)
    for label in {label for label, _ in a}:
        at[label] = np.flatnonzero(labels == label)
    gains: dict[tuple, np.ndarray] = {}

    def below(x: tuple, row: np.ndarray) -> np.ndarray:
        where = at[x[0]]
        if not len(where):
            return row
        if x not in gains:
            gains[x] = 1 + np.array([settled[x[1], b[j][1]][0] if x[1] and b[j][1] else 0 for j in where.tolist()], np.int32)
        out = row.copy()
        out[where + 1] = np.maximum(out[where + 1], row[where] + gains[x])
        return np.maximum.accumulate(out)

    step = isqrt(len(a)) + 1
    kept, row = [], np.zeros(len(b) + 1, np.int32)
    for i, x in enumerate(a):
        if i % step == 0:
            kept.append(row)
        row = below(x, row)
    block: tuple[int, list[np.ndarray]] = (len(kept), [row])

    def row_of(i: int) -> np.ndarray:
        nonlocal block
        if i == len(a):
            return row
        if block[0] != i // step:
            rows = [kept[i // step]]
            for x in a[i // step * step : min((i // step + 1) * step - 1, len(a) - 1)]:
                rows.append(below(x, rows[-1]))
            block = i // step, rows
        return block[1][i % step]

    return int(row[-1]), _places(a, b, settled, row_of)


def flat_reference(page: str) -> list:
    """Reference tree of a page as [label, place of the parent or -1, text number] in the order of the page."""
    out: list[list] = []
    left = [(g, -1) for g in reversed(grouped([x for x in parse(page).parts if isinstance(x, Node)]))]
    while left:
        g, above = left.pop()
        left.extend((child, len(out)) for child in reversed(g.children))
        out.append([g.label, above, text_number(own_text(g))])
    return out


def tree_of(flat: list) -> list:
    """Reference nodes [number, label, children, text] of a flat reference tree."""
    nodes = [[number, label, [], text] for number, (label, _, text) in enumerate(flat)]
    for node, (_, above, _) in zip(nodes, flat):
        if above >= 0:
            nodes[above][2].append(node)
    return [node for node, (_, above, _) in zip(nodes, flat) if above < 0]


def reference(page: str) -> list:
    """Reference tree of a page."""
    return tree_of(flat_reference(page))


def text_number(text: str) -> int:
    """A stable 60-bit number of a text; 0 for an empty one."""
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest()) >> 4 if text else 0


def _references(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in table:
        trees = [json.dumps(flat_reference(x or "")) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("kind"), pa.array(trees, pa.string())], ["host", "kind", "tree"])


def _content(root: Node) -> Iterator[str]:
    """What a page shows but for menus, adverts and the like: alike on copies that differ in these."""
    left = [iter(root.parts)]
    while left:
        for x in left[-1]:
            if isinstance(x, str):
                yield x
            elif x.weight == 4 and x.tag != "header":
                yield f"<{x.tag}>"
                left.append(iter(x.parts))
                break
        else:
            left.pop()


_ALIGNED = "host string, kind bigint, content bigint, node bigint, same boolean, chars bigint"


def _aligned(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, kind, content, node, same, chars) of the pages of a batch; rows of the same content are copies."""
    trees: dict[tuple, tuple[list, list]] = {}
    for batch in table:
        out: dict[tuple, tuple[bool, int]] = {}
        seen: set[tuple] = set()
        for host, kind, page, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "kind", "html", "tree"))):
            if not page or tree is None:
                continue
            root = parse(page)
            copy = host, kind, text_number(_SPACE.sub(" ", "".join(_content(root))).strip())
            if copy in seen:
                continue
            seen.add(copy)
            if copy[:2] not in trees:
                if len(trees) > 2000:
                    trees.clear()
                flat = json.loads(tree)
                trees[copy[:2]] = tree_of(flat), [text for _, _, text in flat]
            known, texts = trees[copy[:2]]
            _, pairs = match(known, grouped([x for x in root.parts if isinstance(x, Node)]))
            for number, group in pairs:
                text = own_text(group)
                equal = text_number(text) == texts[number]
                out[*copy, number] = equal, 0 if equal else len(text) * group.nodes[0].weight // 4
        columns = list(zip(*((*k, *v) for k, v in out.items()))) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["host", "kind", "content", "node", "same", "chars"])


def _distinct(nodes: list[Node | None]) -> list[Node]:
    return list({id(x): x for x in nodes if x is not None}.values())


def _around(nodes: list[Node]) -> list[Node]:
    """The slot of a run of nodes: their parent and its siblings' parent, then the article or main element around it."""
    slot = _distinct([x.parent for x in nodes])
    while len(slot) > 1 and any(x.tag != "article" for x in slot):
        above = _distinct([x.parent for x in slot])
        if any(x.tag in PAGE for x in above):
            break
        slot = above
    out = []
    for node in slot:
        best, main, up = None, None, node
        while up is not None:
            best, main = up if up.tag == "article" else best, up if up.tag == "main" else main
            up = up.parent
        if best is None and main is not None and not main.articles:
            best = main
        out.append(best or node)
    return _distinct(out)


def _found(node: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag that are not in a skipped element."""
    out, left = [], [node]
    while left:
        x = left.pop()
        if x.tag == tag and x is not node:
            out.append(x)
        else:
            left.extend(y for y in reversed(x.parts) if isinstance(y, Node) and not y.skipped)
    return out


def _size(node: Node, left_out) -> int:
    size, left = 0, [node]
    while left:
        for x in left.pop().parts:
            if isinstance(x, str):
                size += len(x.strip())
            elif not left_out(x):
                left.append(x)
    return size


def text_of(page: str, tree: list | None, constant: frozenset[int], main: int | None) -> str:
    """Blocks of the main text, joined by line breaks."""
    root = parse(page)
    dropped: set[int] = set()
    slot: list[Node] = []
    if tree and (constant or main is not None):
        for number, group in match(tree, grouped([x for x in root.parts if isinstance(x, Node)]))[1]:
            if number in constant:
                dropped.update(map(id, group.nodes))
            if number == main:
                slot = _around(group.nodes)
    known = bool(slot) and slot[0].tag not in PAGE  # then names decide nothing inside
    inside = known

    def left_out(x: Node) -> bool:
        if x.skipped or x.tag == "header" and not inside:
            return True
        if known or not x.named or inside and x.tag not in BOXES:
            return False
        return not (root.articles and x.articles == root.articles or x.mains)  # a layout class around the whole page is no evidence

    if not slot:
        shown: list[Node] = []

        left = [root]
        while left:
            x = left.pop()
            if x.tag == "article" and x is not root:
                shown.append(x)
            else:
                left.extend(y for y in reversed(x.parts) if isinstance(y, Node) and not left_out(y))
        if len(shown) > 1 and 2 * sum(_size(x, left_out) for x in shown) < _size(root, left_out):
            shown = []  # teasers beside the text
        slot = shown or _found(root, "main")
        inside = bool(slot)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip(" ")
        line.clear()
        if text:
            blocks.append(text)

    for top in slot or [root]:
        open_nodes = [(top, iter(top.parts))]
        if top.tag in BLOCK or top is root:
            flush()
        while open_nodes:
            node, parts = open_nodes[-1]
            for x in parts:
                if isinstance(x, str):
                    if id(node) not in dropped:
                        line.append(x)
                elif not left_out(x):
                    open_nodes.append((x, iter(x.parts)))
                    if x.tag in BLOCK:
                        flush()
                    break
            else:
                open_nodes.pop()
                if node.tag in BLOCK or node is root:
                    flush()
    flush()
    return "\n".join(blocks)


def _extracted(table: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    trees: dict[tuple, tuple] = {}
    for batch in table:
        out = []
        for host, kind, page, tree, constant, main in zip(*(batch.column(c).to_pylist() for c in ("_host", "_kind", "_html", "_tree", "_constant", "_main"))):
            if tree is not None and (host, kind) not in trees:
                if len(trees) > 2000:
                    trees.clear()
                trees[host, kind] = tree_of(json.loads(tree)), frozenset(constant or ()), main
            out.append(text_of(page or "", *(trees[host, kind] if tree is not None else (None, frozenset(), None))))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*columns, "text", "n_chars"])


def template(html: str) -> Column:
    """A number of the containers of a page: its distinct openings of body, main, article, section, header and div, with their classes but for digits and skipped names."""
    names = "|".join(sorted(SKIPPED_NAMES))
    tags = F.expr(f"regexp_extract_all({html}, '(?i)<(?:body|main|article|section|header|div)\\\\b[^<>]*>', 0)")

    def kept(x: Column) -> Column:
        marks = F.regexp_extract(x, r"(?i)\sclass\s*=\s*[\x22']?([^\x22'>]*)", 1)
        return F.lower(F.concat_ws(" ", F.regexp_extract(x, r"<(\w+)", 1), F.regexp_replace(marks, r"\d+", "")))

    known = F.filter(F.transform(tags, kept), lambda x: ~x.rlike(rf"\s(?:{names})(?:\s|$)"))
    return F.coalesce(F.xxhash64(F.array_sort(F.array_distinct(known))), F.lit(0))


def wrappers(pages: DataFrame, least: int = 8, percent: int = 80) -> DataFrame:
    """(host, kind, tree, constant, main): the wrapper of each template of a host.

    A node is constant if it was met on at least ``least`` different pages and
    has the reference's text on ``percent`` of them. ``main`` is the node with
    the most varying text.
    """
    pages = pages.select("host", "kind", "html", F.xxhash64("html").alias("rank")).filter("html IS NOT NULL AND html <> ''")
    firsts = written_table(pages.groupBy("host", "kind").agg(F.min("rank").alias("rank")))
    trees = pages.join(firsts, ["host", "kind", "rank"]).dropDuplicates(["host", "kind"]).mapInArrow(_references, "host string, kind bigint, tree string")
    trees = written_table(trees)  # read back with its size, by which Spark picks the join below
    met = pages.select("host", "kind", "html").join(trees, ["host", "kind"], "left").mapInArrow(_aligned, _ALIGNED)
    once = met.groupBy("host", "kind", "node", "content").agg(F.max("same").alias("same"), F.max("chars").alias("chars"))
    sums = once.groupBy("host", "kind", "node").agg(F.count(F.lit(1)).alias("pages"), F.count_if("same").alias("same"), F.sum("chars").alias("chars"))
    constant = F.collect_list(F.when((F.col("pages") >= least) & (100 * F.col("same") >= percent * F.col("pages")), F.col("node")))
    main = F.max_by(F.when(F.col("chars") > 0, F.col("node")), F.struct("chars", -F.col("node")))
    found = sums.groupBy("host", "kind").agg(constant.alias("constant"), main.alias("main"), F.max("pages").alias("pages"))
    return written_table(trees.join(found, ["host", "kind"], "left"))


def extract(pages: DataFrame) -> DataFrame:
    """Columns of ``pages`` but html, with text and n_chars.

    Null or empty html gives an empty text. Pages with a null url count as one
    host. A page whose template no other page of the host has is aligned with
    the most frequent template. Broken markup is read as far as it goes: an element that is not
    closed ends with its parent, and a stray "<" is text.
    """
    columns = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    found = wrappers(pages.select("html", host.alias("host"), template("html").alias("kind")))
    usual = found.groupBy("host").agg(F.max_by(F.struct("tree", "constant", "main", "kind"), F.struct("pages", "kind")).alias("usual"))
    found = found.join(usual, "host").withColumn("own", F.when(F.col("pages") > 1, F.struct("tree", "constant", "main")))
    found = found.select("host", "kind", *(F.when(F.col("own").isNull(), F.col("usual")[c]).otherwise(F.col("own")[c]).alias(c) for c in ("tree", "constant", "main")))
    known = pages.select(*columns, F.col("html").alias("_html"), host.alias("_host"), template("html").alias("_kind"))
    both = known.join(written_table(found).select(*(F.col(c).alias(f"_{c}") for c in found.columns)), ["_host", "_kind"], "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*columns).schema)
    return both.mapInArrow(partial(_extracted, columns=columns), f"{kinds}, text string, n_chars bigint")
