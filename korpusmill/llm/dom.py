"""A small reader of HTML: elements and runs of text with the features that a classifier needs."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

#: Markup, in the order tried at each "<". A quote opens a value after "=" alone; quoted values may hold ">"; a tag that never ends takes the rest.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
TOKEN = re.compile(r"[a-z]+")

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select option button head annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark meter object output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var video "
    "math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTROLS = frozenset("button input select textarea".split())
SCOPE = frozenset("article section div main body td th li blockquote aside".split())

#: Words of class, id and role that tell parts of a page apart.
GOOD = frozenset("article body content copy entry main post prose read story text".split())
BAD = frozenset(
    "ad ads advert advertisement aside author banner bar bottom breadcrumb breadcrumbs byline cookie consent comment comments disqus discussion foot footer form gdpr head header links login masthead menu modal nav "
    "navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended related replies reply respond share sharing side sidebar signup skip social sponsor sponsored subscribe tags toolbar top widget".split()
)
TAGS = "article main section div p h1 h2 h3 header footer nav aside form ul ol li table tr td blockquote pre body figure figcaption dl #text".split()
_TAG = {t: i for i, t in enumerate(TAGS)}
HASHED = 16


def telling(attributes: str) -> tuple[int, int, int, bool]:
    """Of the attributes of an element: good words, bad words, a bit for each hashed word, and whether it is hidden."""
    good = bad = hashed = 0
    hidden = False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words = TOKEN.findall(value.lower())
            good += sum(w in GOOD for w in words)
            bad += sum(w in BAD for w in words)
            for w in words:
                hashed |= 1 << sum(w.encode()) % HASHED
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and "true" in value):
            hidden = True
    return good, bad, hashed, hidden


class Node:
    __slots__ = ("bad", "blocks", "chars", "children", "depth", "direct", "end", "good", "hashed", "hidden", "links", "n_tags", "order", "own", "parent", "space", "stops", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.links = self.n_tags = self.blocks = self.stops = self.own = self.direct = 0
        self.text = ""
        self.space = True  # of a text: whether white space or the edge of a block is before it
        self.good = self.bad = self.hashed = 0
        self.hidden = False
        if parent:
            parent.children.append(self)
        if attributes:
            self.good, self.bad, self.hashed, self.hidden = telling(attributes)


def parse(page: str) -> Node:
    """The tree of a page: block elements, with each run of text between boundaries as a ``#text`` leaf.

    Inline elements dissolve into the run around them, except those whose attributes tell them apart (an advert or a share
    link): they are nodes too, and their edges leave no space. Scripts, styles, the head, controls and comments are left out.
    Elements nest to any depth.
    """
    root = Node("#root", None)
    stack = [root]
    run: list[str] = []
    opened: Counter = Counter()  # elements of the stack by tag
    inner: list[list] = []  # inline nodes of the stack: tag, place, elements of that tag that dissolved inside
    in_link = linked = tags = 0
    space = True

    def flush(block: bool = True) -> None:
        nonlocal linked, tags, space
        if run:
            raw = html.unescape("".join(run))
            text = " ".join(raw.split())
            run.clear()
            if text:
                leaf = Node("#text", stack[-1])
                leaf.text, leaf.chars, leaf.links, leaf.own = text, len(text), min(linked, len(text)), len(text)
                leaf.stops = sum(text.count(c) for c in ".!?,")
                leaf.n_tags, leaf.blocks = tags, 1
                leaf.space = space or raw[0].isspace()
                space = raw[-1].isspace()
            else:
                space = space or bool(raw)
        space = space or block
        linked = tags = 0

    def push(name: str, attributes: str) -> None:
        stack.append(Node(name, stack[-1], attributes))
        opened[name] += 1

    def cut(k: int) -> None:
        """Close the elements from place ``k`` on."""
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]
        while inner and inner[-1][1] >= k:
            inner.pop()

    at = 0
    while m := MARKUP.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            run.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in CONTROLS and not m[1]:
            stack[-1].direct += 1
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                if name in ("head", "title", "script", "style"):
                    flush(name in ("head", "title"))
                close = _find(page, name, at)
                if close >= 0 or name in ("script", "style", "title", "textarea"):
                    at = close if close >= 0 else len(page)
            continue
        if name in INLINE:
            tags += 1
            if name == "a":
                in_link = 0 if m[1] else 1
            own = next((x for x in reversed(inner) if x[0] == name), None) if inner else None
            if m[1]:
                if own and own[2]:
                    own[2] -= 1
                elif own:
                    flush(False)
                    cut(own[1])
            elif not m[3].endswith("/"):
                if m[3] and ((t := telling(m[3]))[1] > t[0] or t[3]):
                    flush(False)
                    inner.append([name, len(stack), 0])
                    push(name, m[3])
                elif own:
                    own[2] += 1
            continue
        flush()
        in_link = 0
        if name in VOID:
            stack[-1].n_tags += 1
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k].tag == name:
                    cut(k)
                    break
                if name == "p" and stack[k].tag in SCOPE:
                    break
            continue
        ends = {"li": ("li",), "tr": ("tr",), "td": ("td",), "th": ("th",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(name, ())
        if name in CLOSES_P:
            ends = (*ends, "p")
        if any(opened[e] for e in ends):
            for k in range(len(stack) - 1, 0, -1):
                tag = stack[k].tag
                if tag in ends:
                    cut(k)
                    break
                if tag in SCOPE or tag in ("ul", "ol", "table", "dl"):
                    break
        push(name, m[3])
        if m[3].endswith("/"):
            cut(len(stack) - 1)
    if at < len(page):
        run.append(page[at:])
    flush()
    return root


_CLOSE = {n: re.compile(f"</{n}(?=[\\s/>])" + "|<body(?=[\\s/>])" * (n == "head"), re.I) for n in RAW}


def _find(page: str, name: str, at: int) -> int:
    m = _CLOSE[name].search(page, at)
    return m.start() if m else -1


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order; sums over subtrees are filled in on the way."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.order = len(out)
        out.append(n)
        todo += n.children[::-1]
    for n in reversed(out):
        if n.parent:
            for field in ("chars", "links", "n_tags", "blocks", "stops"):
                setattr(n.parent, field, getattr(n.parent, field) + getattr(n, field))
            n.parent.n_tags += n.tag != "#text"
    return out


WIDTH = 3 * len(TAGS) + HASHED + 33


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node but the root."""
    n_all, total = len(nodes), max(nodes[0].chars, 1)
    state: list[tuple] = [(0, 0, 0, 0)] * n_all  # of a node and those above: good, bad, hidden words; tags seen
    least = [nodes[0]] * n_all  # the nearest element around a node that has controls, if any
    tags, ups, seens, hashes, rest = [], [], [], [], []
    for n in nodes[1:]:
        up = n.parent
        good, bad, hidden, seen = state[up.order]
        i = _TAG.get(n.tag, -1)
        tags.append(i)
        ups.append(_TAG.get(up.tag, -1))
        seens.append(seen)
        hashes.append(n.hashed)
        state[n.order] = (good + n.good, bad + n.bad, hidden or n.hidden, seen | 1 << i if i >= 0 else seen)
        chars, kin = n.chars, up.children
        box = least[n.order] = n if n.direct else least[up.order]
        place, most = _place(n, kin)
        before, after = kin[place - 1] if place else None, kin[place + 1] if place + 1 < len(kin) else None
        some = chars or 1
        rest.append((
            chars, chars / total, chars / (up.chars or 1), chars / (most or 1), n.links / some, n.n_tags / some, n.n_tags, n.blocks, n.stops, before.chars if before else -0.6, after.chars if after else -0.6,
            chars / (n.blocks or 1), n.stops / some, n.depth, len(kin), place, place / len(kin), n.order / n_all, before.links / (before.chars or 1) if before else -1, after.links / (after.chars or 1) if after else -1,
            n.good, n.bad, n.hidden, good, bad, hidden, len(n.children), n.direct, up.direct, up.parent.direct if up.parent else 0, box.chars / total, up.chars / total, up.links / (up.chars or 1),
        ))
    x = np.zeros((n_all - 1, WIDTH), np.float32)
    if not rest:
        return x
    k, rows = len(TAGS), np.arange(n_all - 1)
    for at, ids in ((0, np.array(tags)), (k, np.array(ups))):
        x[rows[ids >= 0], at + ids[ids >= 0]] = 1
    x[:, 2 * k : 3 * k] = np.array(seens, np.int64)[:, None] >> np.arange(k) & 1
    x[:, 3 * k : 3 * k + HASHED] = np.array(hashes, np.int64)[:, None] >> np.arange(HASHED) & 1
    more = np.array(rest, np.float32)
    for j in (0, 6, 7, 8, 9, 10):
        more[:, j] = np.log1p(more[:, j])
    x[:, 3 * k + HASHED :] = more
    return x


def _place(n: Node, kin: list[Node]) -> tuple[int, int]:
    """Where ``n`` stands among its siblings, and the most text of any of them; remembered, so that wide parents stay cheap."""
    if not hasattr(n, "end"):
        most = max(k.chars for k in kin)
        for i, k in enumerate(kin):
            k.end = (i, most)
    return n.end


def decode(nodes: list[Node], logits: np.ndarray) -> list[str]:
    """The texts kept, in page order; those that no white space or edge of a block parts are one.

    A kept node has kept ancestors only. Among all such choices this is the one of greatest likelihood: the gain of keeping a
    node is its logit and the gains of its children that are worth keeping; a branch without gain is dropped whole.
    """
    gain = [0.0] * len(nodes)
    for n in reversed(nodes[1:]):
        gain[n.order] += float(logits[n.order - 1])
        if gain[n.order] > 0:
            gain[n.parent.order] += gain[n.order]
    kept, out, space = [True] + [False] * (len(nodes) - 1), [], True
    for n in nodes[1:]:
        kept[n.order] = kept[n.parent.order] and gain[n.order] > 0
        if n.text:
            space = space or n.space
            if kept[n.order]:
                out += [n.text] if space or not out else [out.pop() + n.text]
                space = False
    return out
