"""HTML extraction by minimum-cut labelling: blocks of text are split into content and boilerplate by max-flow."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_layouts
from .common import extended, table

#: Markup: a comment, a declaration or instruction, a tag with quoted attributes, or a tag as it comes.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
#: Elements whose text is not prose at all; everything to their end tag goes.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "select", "button", "title", "head", "canvas", "audio", "video", "datalist"}
#: Where they end; a head without an end tag ends at the body.
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])" + r"|<body(?=[\s/>])" * (x == "head"), re.I) for x in RAW}
#: Those of them whose text is no markup: without an end tag they run to the end of the page. Others end at the next block.
TEXT_ONLY = {"script", "style", "textarea", "title", "iframe"}
BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)(?=[\s/>])",
    re.I,
)
#: Elements that cannot hold themselves: one that begins again had no end tag.
AGAIN = {x: re.compile(rf"<{x}(?=[\s/>])", re.I) for x in ("button", "select")}
#: Elements within a line; any other but these begins or ends a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "nobr", "output",
    "progress", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "picture", "source", "map", "area",
}
#: Elements without an end.
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
#: Elements that end where one of these begins (inside the nearest element of the second set).
CLOSED_BY = {
    "p": (set(), {"*"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "tbody", "thead", "tfoot"}, {"table"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ITEMS = {"li", "td", "th", "dt", "dd", "option"}
#: Elements that hold boilerplate, and those that hold the main text.
AWAY = {"nav", "footer", "aside", "menu", "dialog", "search"}
#: Those that hold it unless they are wrapped around the main text.
WRAPPERS = {"form", "fieldset"}
MAIN = {"article", "main"}
#: Words of class, id and role that say the same, in four languages: as a whole name, or as its last part (what a compound is) or, of FIRST, its first.
AWAY_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead banner sidebar rail widget widgets cookie cookies"
    " consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar pagination pager legal copyright search complementary contentinfo"
    " werbung anzeige anzeigen hauptmenue navigationsleiste seitenleiste randspalte fusszeile fußzeile kopfzeile hinweis anmeldung"
    " publicite publicité annonce annonces pied avertissement connexion inscription publicidad anuncio anuncios navegacion navegación pie aviso registro".split()
)
#: Words of what readers say below a text, which count whatever else is on the page.
TALK_WORDS = set("comment comments reply replies respond discussion disqus kommentar kommentare leserkommentare commentaire commentaires avis comentario comentarios opiniones".split())
FIRST = set("ad ads advert nav sidebar footer cookie consent newsletter related share social comment comments kommentar kommentare barre barra pied pie menu".split())
#: Two-part names whose parts say nothing alone.
PHRASES = {"barre laterale", "colonne laterale", "barra lateral", "columna lateral", "menu principal", "bas page", "seiten fuss"}
MAIN_WORDS = set("article content main post entry story body text artikel beitrag inhalt contenu corps billet contenido cuerpo entrada".split())
#: First and last parts that make a name say what else a page has, or how it is laid out.
STATES = set("has with no without is open opened closed enabled disabled on off wrap wrapper layout container page row left right".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
SENTENCE = re.compile(r"[.!?\u2026:;\u3002\uff01\uff1f](?=[\s\"\u201d\u00bb')]|$)")
#: Features of a block, in the order of the classifier's weights.
FEATURES = ["bias", "length", "short", "linked", "sentences", "ends", "heading", "item", "paragraph", "main", "outside", "core", "after", "main_name", "away", "named", "talk", "form", "share", "alone", "bars"]
#: The most that a name's weight may be, that one block's classifier may weigh, and smoothness: of neighbours, and of blocks by distance in the tree.
NAMED, LIMIT, NEXT, NEAR = 3.0, 4.0, 0.5, 2.0
#: Scales of the smoothness of which training takes the one that labels further pages best.
SCALES = (1.0, 1.5, 2.0, 3.0)


@dataclass(slots=True)
class Model:
    """Weights of FEATURES, and how strong smoothness is."""

    weights: np.ndarray
    scale: float


@dataclass(slots=True)
class Node:
    name: str
    parent: int
    depth: int
    main: bool
    main_name: bool
    away: bool
    hidden: bool
    marks: tuple[tuple[int, str], ...]  # (element, kind) of the away marks around it: name, talk or form


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    node: int

    def prose(self) -> int:
        """Characters that are no links, of a block that is no mere label."""
        return len(self.text) - self.linked if len(self.text) >= 20 else 0


def _says(value: str) -> tuple[bool, str]:
    """(main, what is said against it: name, talk or nothing) of a class, id or role."""
    main, against = False, ""
    for name in value.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if not words or len(words) > 1 and STATES & {words[0], words[-1]}:
            continue
        if words[-1] in TALK_WORDS or words[0] in TALK_WORDS & FIRST:
            against = "talk"
        elif words[-1] in AWAY_WORDS or words[0] in FIRST or " ".join(w for w in words if w != "de")[:40] in PHRASES:
            against = against or "name"
        else:
            main |= words[0] in MAIN_WORDS or words[-1] in MAIN_WORDS
    return main and not against, against


def _names(attributes: str) -> tuple[bool, str, bool]:
    """(says main, what is said against it, is hidden) of a tag's attributes."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False, "", False
    main, against, hidden = False, "", False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name != "aria-hidden":
            m, said = _says(value)
            main, against = main or m, "talk" if "talk" in (said, against) else said or against
    return main, against, hidden


def blocks(source: str) -> tuple[list[Block], list[Node]]:
    """The page's blocks of text in order, and the elements that they are in (the first is the page)."""
    out: list[Block] = []
    nodes = [Node("", 0, 0, False, False, False, False, ())]
    stack = [0]
    ends: dict[str, int] = {}
    parts: list[str] = []
    linked = link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text and not nodes[stack[-1]].hidden:
            out.append(Block(text, min(linked, len(text)), stack[-1]))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if link:
            linked += len(text)

    def implied(name: str) -> None:
        """Ends what has no end tag of its own and cannot hold ``name``."""
        if nodes[stack[-1]].name == "p":
            stack.pop()
        if name in CLOSED_BY and name != "p":
            closed, inside = CLOSED_BY[name]
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].name in inside:
                    break
                if nodes[stack[k]].name in closed and nodes[stack[k]].name != "tr" or nodes[stack[k]].name == "tr" == name:
                    if nodes[stack[k]].name in ("tbody", "thead", "tfoot"):
                        break
                    del stack[k:]
                    break

    at = 0
    while (m := TAG.search(source, at)) is not None:
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, end, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in RAW:
            if name not in ("title", "select", "button"):
                flush()
            if not end and not attributes.endswith("/"):
                at = _raw_end(source, at, name, ends)
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                link = 0 if end else 1
            continue
        flush()
        link = 0
        if name in VOID or name in ("html", "body"):
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].name == name:
                    del stack[k:]
                    break
                if name == "p" or name in ITEMS and nodes[stack[k]].name in ("ul", "ol", "table", "dl"):
                    break
            continue
        implied(name)
        says_main, against, hidden = _names(attributes)
        up = nodes[stack[-1]]
        within = up.main or up.main_name
        if name == "header" or re.search(r"(?:class|id)\s*=\s*[\"']?[^\"'>]*header", attributes, re.I):  # a header in the main text has its title
            against = against or "" if within else "name"
        if name in MAIN and against != "talk":  # an article may be about anything
            against = ""
        number = len(nodes)
        marks = () if name == "main" else up.marks
        if against:
            marks = (*marks, (number, against))
        if name in WRAPPERS:
            marks = (*marks, (number, "form"))
        nodes.append(Node(name, stack[-1], up.depth + 1, up.main or name in MAIN, up.main_name or says_main, up.away or name in AWAY, up.hidden or hidden, marks))
        stack.append(number)
    add(source[at:])
    flush()
    return out, nodes


def _raw_end(source: str, at: int, name: str, ends: dict[str, int]) -> int:
    """Where an element of RAW ends whose content begins at ``at``; ``ends`` has the next end tag of each name, once found."""
    if ends.get(name, -1) < at:
        stop = RAW_END[name].search(source, at)
        ends[name] = stop.start() if stop else len(source)
    end = ends[name]
    if end < len(source) and not (name in AGAIN and AGAIN[name].search(source, at, end)):
        return end
    if name in TEXT_ONLY:
        return len(source)
    block = BLOCK.search(source, at)
    return block.start() if block else len(source)


def _cancelled(found: list[Block], nodes: list[Node]) -> set[int]:
    """Elements whose marks do not count, as they hold most of the page's prose.

    None outside the elements that hold main text does, if those have text of their own. What readers say may be most of a page,
    too: its mark is cancelled only where there is no other prose in a main part and a title inside, the other marks
    where that prose is less than a quarter of what they hold.
    """
    inside: dict[int, int] = {}
    kinds: dict[int, str] = {}
    titled: set[int] = set()
    total = plain = 0
    told = False
    for b in found:
        own = nodes[b.node]
        if own.away:
            continue
        n = b.prose()
        total += n
        if not own.marks:
            told |= own.main
            plain += n * (own.main or own.main_name)
        for k, kind in own.marks:
            inside[k], kinds[k] = inside.get(k, 0) + n, kind
            if own.name == "h1":
                titled.add(k)
    free = lambda k, n: k in titled and not plain if kinds[k] == "talk" else 4 * plain < n
    return {k for k, n in inside.items() if 2 * n > total and (nodes[k].main or not told) and free(k, n)}


def _core(found: list[Block], nodes: list[Node], kinds: list[set[str]]) -> int:
    """The element around most prose: each block counts for what its paragraph stands in, and half for the element around that."""
    held: dict[int, float] = {}
    for b, own in zip(found, kinds):
        if own or nodes[b.node].away:
            continue
        at, n = _around(b, nodes), b.prose()
        held[at] = held.get(at, 0) + n
        held[nodes[at].parent] = held.get(nodes[at].parent, 0) + n / 2
    return max(held, key=lambda k: (held[k], k), default=0) if any(held.values()) else 0


def _around(b: Block, nodes: list[Node]) -> int:
    own = nodes[b.node]
    return own.parent if own.name in ITEMS or own.name in HEADINGS or own.name in ("p", "ul", "ol", "blockquote") else b.node


def features(found: list[Block], nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES for each block: its text, its place among what holds the page's prose, and what names say."""
    out = np.zeros((len(found), len(FEATURES)))
    cancelled = _cancelled(found, nodes)
    kinds = [{kind for k, kind in nodes[b.node].marks if k not in cancelled} for b in found]
    open_: dict[int, int] = {}  # text without marks or links by the element around it
    for b, own in zip(found, kinds):
        if not own and not nodes[b.node].away:
            open_[_around(b, nodes)] = open_.get(_around(b, nodes), 0) + len(b.text) - b.linked
    most = max(open_.values(), default=0) or 1
    core = _core(found, nodes, kinds)
    below = {core}
    for k in range(core + 1, len(nodes)):  # elements are numbered as they begin
        if nodes[k].parent in below:
            below.add(k)
    prose = [b.prose() * (not nodes[b.node].away) for b in found]
    framed = 3 * sum(n for n, b in zip(prose, found) if nodes[b.node].main) >= sum(prose) > 0
    last = max((i for i, b in enumerate(found) if b.node in below), default=-1)
    for i, (row, b, own) in enumerate(zip(out, found, kinds)):
        n, text, node = len(b.text), b.text, nodes[b.node]
        row[:] = (
            1.0,
            min(3.0, math.log1p(n / 40)),
            n < 25,
            b.linked / n,
            math.log1p(min(8, sum(1 for _ in zip(range(8), SENTENCE.finditer(text))))),
            text[-1] in ".!?\u2026:;\"\u201d\u00bb\u3002",
            node.name in HEADINGS,
            node.name in ITEMS,
            node.name == "p",
            node.main,
            framed and not node.main,
            core > 0 and b.node in below,
            core > 0 and i > last,
            node.main_name,
            node.away,
            "name" in own,
            "talk" in own,
            "form" in own,
            0.0 if own or node.away else open_.get(_around(b, nodes), 0) / most,
            len(found) <= 2,
            min(1.0, sum(text.count(x) for x in "|\u00b7\u00a9\u203a\u00bb") / (1 + n / 20)),
        )
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut.

    A node with a positive score is joined with the source at that capacity, one with a negative score with the sink;
    edges (a, b, capacity) go both ways. Shortest augmenting paths saturate the graph; the source side is what the
    source still reaches.
    """
    n = len(scores)
    to: list[int] = []
    room: list[float] = []
    around: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        around[a].append(len(to))
        to.append(b)
        room.append(c)
        around[b].append(len(to))
        to.append(a)
        room.append(c)
    supply = [max(0.0, s) for s in scores]
    demand = [max(0.0, -s) for s in scores]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            if demand[i] > tiny:
                reached = True
                continue
            for e in around[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        step = [0] * n
        for source in range(n):
            if level[source] != 0:
                continue
            while supply[source] > tiny:  # a path along rising levels to a node with demand
                path: list[int] = []
                i = source
                while demand[i] <= tiny:
                    moved = False
                    while step[i] < len(around[i]):
                        e = around[i][step[i]]
                        if room[e] > tiny and level[to[e]] == level[i] + 1:
                            path.append(e)
                            i = to[e]
                            moved = True
                            break
                        step[i] += 1
                    if moved:
                        continue
                    if not path:
                        break
                    e = path.pop()
                    i = to[e ^ 1]
                    step[i] += 1
                if demand[i] <= tiny:
                    break
                flow = min([supply[source], demand[i], *(room[e] for e in path)])
                supply[source] -= flow
                demand[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def smoothness(found: list[Block], nodes: list[Node]) -> list[tuple[int, int, float]]:
    """Edges (a, b, capacity): between neighbours, and between blocks close in the tree.

    Tree distance counts the steps from one block's element to the other's over what holds both; the capacity falls
    with its square. A block is also joined with the last block of the same parent where that is not its neighbour.
    """

    def distance(a: int, b: int) -> int:
        d = 0
        while a != b:
            if nodes[a].depth >= nodes[b].depth:
                a = nodes[a].parent
            else:
                b = nodes[b].parent
            d += 1
        return d

    edges, last = [], {}
    for i, b in enumerate(found):
        parent = nodes[b.node].parent
        if i:
            d = distance(found[i - 1].node, b.node)
            edges.append((i - 1, i, NEXT / max(1, d) + NEAR / max(2, d) ** 2))
        before = last.get(parent)
        if before is not None and before != i - 1:
            edges.append((before, i, NEAR / max(2, distance(found[before].node, b.node)) ** 2))
        last[parent] = i
    return edges


def labelled(source: str, model: Model) -> tuple[list[Block], np.ndarray, list[bool]]:
    """Blocks of a page, their classifier scores (positive: content), and whether each is content by the minimum cut."""
    found, nodes = blocks(source)
    scores = np.clip(features(found, nodes) @ model.weights, -LIMIT, LIMIT)
    return found, scores, min_cut(scores.tolist(), [(a, b, c * model.scale) for a, b, c in smoothness(found, nodes)])


def main_text(source: str | None, model: Model) -> str:
    """The content blocks of a page, in order, joined by one space."""
    found, _, content = labelled(source or "", model)
    return " ".join([b.text for b, inside in zip(found, content) if inside])


def train(pages: list[tuple[str, dict[str, bool]]], epochs: int = 600, rate: float = 0.5, decay: float = 3e-4) -> Model:
    """A model of the blocks of labelled pages: (html, text of a block -> is it content).

    Two thirds of the pages give the weights of a logistic regression, by gradient steps on the mean log loss, both classes
    weighing the same and names within NAMED. The others give the scale of smoothness, the one with which the cut
    labels most of their blocks right. Blocks without a label are left out.
    """
    fitted = [p for k, p in enumerate(pages) if k % 3] or pages
    x, y = [], []
    for source, says in fitted:
        found, nodes = blocks(source)
        known = [k for k, b in enumerate(found) if b.text in says]
        x.append(features(found, nodes)[known])
        y += [says[found[k].text] for k in known]
    x, y = np.concatenate(x), np.array(y, float)
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    bound = np.array([NAMED if name in ("named", "talk", "main_name") else np.inf for name in FEATURES])
    for _ in range(epochs):
        slope = x.T @ (share * (1 / (1 + np.exp(-(x @ w))) - y)) + decay * w
        velocity = 0.9 * velocity - rate * slope
        w = np.clip(w + velocity, -bound, bound)

    def right(scale: float) -> int:
        out = 0
        for source, says in pages[::3]:
            found, _, content = labelled(source, Model(w, scale))
            out += sum(says[b.text] == inside for b, inside in zip(found, content) if b.text in says)
        return out

    return Model(w, max(SCALES, key=lambda s: (right(s), s)))


def extracted(pages: DataFrame, training: list[tuple[str, dict[str, bool]]] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    The classifier is learned from ``training`` (html, text of a block -> is it content), by default from the
    generated layouts of html_layouts, as no table has labels for blocks.

    White space inside a block becomes one space, blocks are joined by one space, character references are decoded.
    A null or empty html, or one without content, gives an empty text. Repeated rows give equal rows; an empty table
    gives an empty result; other columns are ignored.
    """
    model = train(html_layouts.pages() if training is None else training)
    taken = pages.select("page_id", "url", F.col("html").cast("string").alias("_html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py(), model) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return taken.mapInArrow(work, extended(taken.select("page_id", "url"), "text string, n_chars long"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extracted(table(spark, sf_dir, "pages"))
