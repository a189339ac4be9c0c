"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with the open element it lies in. A
bidirectional LSTM in numpy reads a vector of the hashed path (names of elements and their class, id and role), a vector of the
hashed words and a few shapes for each block, and says for every block, with the whole page as context, whether it is article text.

There are no labels of blocks, so the network learns from a bounded sample of the pages, by their structure: of a page with
<article> or <main>, the blocks under it; of any other page, those under the element that has most unlinked text of its own.
Elements that are never text (nav, aside, form, footer, ...) are left out in either case, and those whose class or id is, as a
whole, one that furniture is made with below; parts of names aren't asked. Variants of those pages teach what the sample lacks, with labels known because they are made: other containers, menus, headers,
notices, adverts, forms and comments before, after and inside the article, and parts of the article under made-up class names.

Elements are a tree of shared nodes; a node knows a bounded number of features of its path, so that deep pages cost what long ones cost.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonegrain.llm import common

#: Pages that the fit sees at most, in order of a hash of page_id (whole, however long), and variants made of each.
FIT_PAGES, VARIANTS = 300, 5
#: Characters after which the fit takes no further page.
FIT_CHARS = 30_000_000
BUCKETS, PATH_DIM, WORD_DIM, SHAPES, HIDDEN = 4096, 16, 8, 9, 16
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Features of a path: so many of the outermost elements and of the nearest ones.
OUTER, NEAREST = 12, 24
#: Bytes of html that are labelled at a time; pages that go through the network together, and their blocks with padding (a longer page goes alone).
SLICE_BYTES, ROWS, CELLS = 2 << 20, 64, 1 << 14

# Elements by their part in a page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|textarea|svg|iframe|object|canvas"
SHUTS = {"p": {"p"}, "li": {"li"}, "dt": {"dd", "dt"}, "dd": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOT_TEXT = frozenset("nav footer aside form head title button select option menu dialog label fieldset legend".split())
INLINE = frozenset("p b i a span li".split())
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 pre figcaption b i em strong span".split())
# What variants are made of: names that pages give to the article's container and to what isn't article.
CONTAINERS = ["article", "main", "div", "section", "td", 'div class="content"', 'div id="content"', 'div id="main"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div class="main-text"', 'div id="page"', 'div class="text"', 'div itemprop="articleBody"']
FURNITURE = ["nav", "header", "footer", "aside", "form", 'div class="ad"', 'div class="advert"', 'div class="ads banner"', 'div class="sponsored promo"', 'div class="sidebar"', 'div id="sidebar"', 'div class="menu"', 'ul class="nav"', 'div class="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div class="consent-banner"', 'div class="comments"', 'section class="comments"', 'section id="comments"', 'div id="comments"', 'div class="comment"', 'ol class="comment-list"', 'ul class="comments"', 'div class="header"', 'div id="header"', 'header class="site-header"', 'div id="footer"', 'div class="share social"', 'div class="newsletter subscribe"', 'div class="related"', 'div class="breadcrumb"', 'div class="popup modal"', 'div class="widget"', 'aside class="sidebar"', 'div class="login search"', 'section class="replies discussion"', 'section class="responses"', 'div class="reader-comments"', 'div class="navigation"', 'div class="pagination"', 'div class="advertisement"', 'div class="cookie"', 'div class="topbar"']
#: Class and id names, as a whole, of what isn't article.
NAMED_FURNITURE = frozenset("." + "-".join(x for x in re.split("[^a-z]+", w) if x) for f in FURNITURE if "header" not in f for m in re.finditer('"([^"]*)"', f) for w in m[1].split())
#: Words that class names in the article are made of, together with those of its own names.
NAMES = "text intro body lead part main block item results price work note story section first wide inner wrap row col box card share notice comment menu related search ad header footer form nav".split()
LEAVES = [(), ("p",), ("p",), ("li",), ("ul", "li", "a"), ("div",), ("h1",), ("h2",), ("h3",), ("div", "p"), ("a",), ("span",), ("div", "div", "p"), ("b",), ("h1", "a")]
#: Words of the short sayings that furniture has besides pieces of the page's own texts.
SAYINGS = "nice post thanks site home about us contact login sign up subscribe now read more share this we use cookies accept all great article i agree reply to menu search privacy terms copyright follow name mail send next previous page top news sponsored buy".split()

_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S | re.I)
_REST = re.compile(r"<!--.*+|</?[a-zA-Z!?].*+", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    """An open element: its parent, its name, features of it and of its path, and the blocks under it (first to last)."""

    __slots__ = ("above", "first", "last", "linked", "name", "own", "parent", "path", "text", "within")

    def __init__(self, name: str, attributes: str, parent: Node | None, first: int = 0):
        self.name, self.parent, self.first, self.last = name, parent, first, 1 << 60
        self.own = _own(name, attributes)
        outer, near = (parent.path if parent else ((), ()))
        self.path = ((*outer, self.own), near) if len(outer) < OUTER else (outer, (*near[1 - NEAREST :], self.own))
        self.within = bool(parent and parent.within) or name in ("article", "main")
        # A header inside the article is part of it.
        self.text = (parent is None or parent.text) and name not in NOT_TEXT and not (name == "header" and not self.within)
        if self.text and name not in ("html", "body", "article", "main"):
            self.text = NAMED_FURNITURE.isdisjoint(self.own)
        self.linked = bool(parent and parent.linked) or name == "a"


def _own(name: str, attributes: str) -> tuple[str, ...]:
    """Features of an element: its name, its class names as they are, and their parts where they have several."""
    if not attributes:
        return (name,)
    out = [name]
    for m in _NAMED.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [x for x in _SPLIT.split(word) if x]
            out.append("." + "-".join(parts))
            out += [f"~{x}" for x in parts] if len(parts) > 1 else []
    return tuple(out[:12])


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked  # linked: characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page that have text, in page order; character references decoded, white space one space."""
    out: list[Block] = []
    root = Node("", "", None)
    stack = [root]
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name
    block_places, wide = [0], [0]  # of block elements, and of those that an inline end tag doesn't reach beyond
    parts: list[str] = []
    home, linked = root, 0

    def say(raw: str) -> None:
        nonlocal home, linked
        if raw and not raw.isspace():
            home = home or stack[-1]
            if stack[-1].linked:
                linked += len(raw)
        if raw:
            parts.append(raw)

    def end() -> None:
        nonlocal home, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, home or stack[-1], min(linked, len(text))))
            parts.clear()
        home, linked = None, 0

    def shut(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            node.last = len(out)
            places[node.name].pop()
            if node.name in BLOCK:
                block_places.pop()
            if node.name in ("article", "main", "body"):
                wide.pop()

    end()
    at, whole = 0, page.rfind(">") + 1
    for m in _TAG.finditer(page, 0, whole):
        say(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        name = name.lower()
        if name in BLOCK:
            end()
        elif name == "br":
            parts.append(" ")
        if closing:
            found = places.get(name)
            if found and not (name in INLINE and found[-1] < wide[-1]):
                shut(found[-1])
        elif name not in VOID and not attributes.endswith("/"):
            while name in SHUTS and stack[block_places[-1]].name in SHUTS[name]:
                shut(block_places[-1])
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                block_places.append(len(stack))
            if name in ("article", "main", "body"):
                wide.append(len(stack))
            stack.append(Node(name, attributes, stack[-1], len(out)))
    say(_REST.sub(" ", page[at:]))
    end()
    shut(1)
    return out


def taught(page: list[Block]) -> list[int]:
    """1 for blocks of the article: by markup, or else under the element with most unlinked text of its own."""
    if any(b.node.within for b in page):
        return [int(b.node.text and b.node.within) for b in page]
    weight: dict[Node, float] = {}
    for b in page:
        if b.node.text and 2 * b.linked < len(b.text):
            node = b.node.parent or b.node if b.node.name in LEAF else b.node
            for i in range(4):
                weight[node] = weight.get(node, 0.0) + (len(b.text) - b.linked) / 2**i
                node = node.parent
                if node is None:
                    break
    if not weight:
        return [0] * len(page)
    best = max(weight, key=lambda n: (weight[n], n.first))
    return [int(b.node.text and 2 * b.linked < len(b.text) and best.first <= i < best.last) for i, b in enumerate(page)]


def _element(described: str, parent: Node | None) -> Node:
    name, _, attributes = described.partition(" ")
    return Node(name, attributes, parent)


def variants(page: list[Block], n: int, rng: np.random.Generator) -> Iterator[tuple[list[Block], list[int]]]:
    """The page itself, and variants of it with labels."""
    labels = taught(page)
    yield page, labels
    texts = [b.text for b in page] or ["x"]

    def pick(some: list):  # noqa: ANN202
        return some[rng.integers(len(some))]

    def saying() -> str:
        if rng.random() < 0.5:
            words = [pick(SAYINGS) for _ in range(rng.integers(1, 9))]
            return " ".join(words).capitalize() + pick(["", "", ".", "!", "?"])
        words = pick(texts).split()
        at = int(rng.integers(len(words)))
        return " ".join(words[at : at + int(rng.integers(1, 30))])

    def furniture(base: Node, inside: bool = False) -> list[tuple[Block, int]]:
        own, made = _element(pick([f for f in FURNITURE if "header" not in f] if inside else FURNITURE), base), []
        for _ in range(int(rng.integers(1, 6))):
            node = own
            for name in pick(LEAVES):
                node = Node(name, "", node)
            text = saying() if rng.random() < 0.7 else pick(texts)
            made.append((Block(text, node, len(text) if node.linked else 0), 0))
        return made

    for _ in range(n):
        body = Node("body", "", Node("html", "", None))
        outer = body
        for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.4 else 0):
            outer = _element(pick(["div", "div", 'div class="wrapper"', 'div id="page"', 'div class="container"', "section", "table", "tbody", "tr"]), outer)
        inner = _element(pick(CONTAINERS), outer)
        moved: dict[Node | None, Node] = {}

        def under(node: Node | None) -> Node:
            """The node's copy below the new container; a few get a class name."""
            if node is None or node.name in ("article", "main", "body", "html", ""):
                return inner
            if node not in moved:
                name = f'class="{pick(NAMES)}-{pick(NAMES)}"' if rng.random() < 0.03 else ""
                moved[node] = _element(f"{node.name} {name or ' '.join(f'class={x[1:]}' for x in node.own if x[0] == '.')}", under(node.parent))
            return moved[node]

        titled = rng.random() < 0.3
        outside = rng.random() < 0.3  # only made furniture around the article
        out = []
        part = None
        for b, y in zip(page, labels, strict=True):
            if y:
                if rng.random() < 0.06:
                    part = None if part else _element(f'{pick(["div", "section", "figure", "blockquote"])} class="{pick(NAMES)}-{pick(NAMES)}"', inner)
                node = Node(b.node.name, "", part) if part else under(b.node)
                out.append((Block(b.text, node, b.linked), 1))
            elif not outside:
                out.append((b, 0))
        if titled and any(y for _, y in out):  # a title that stands for itself, short paragraphs
            k = next(i for i, x in enumerate(out) if x[1])
            out[k:k] = [(Block(saying(), Node(pick(["h1", "h2", "p"]), "", inner), 0), 1) for _ in range(rng.integers(1, 4))]
            out = [(Block(" ".join(b.text.split()[: rng.integers(3, 20)]) or b.text, b.node, b.linked), y) if y and rng.random() < 0.5 else (b, y) for b, y in out]
            if rng.random() < 0.5:
                kept = [i for i, x in enumerate(out) if x[1]][: int(rng.integers(1, 8))]
                out = [x for i, x in enumerate(out) if not x[1] or i in kept]
        for _ in range(0 if outside and rng.random() < 0.3 else int(rng.integers(2, 8))):
            ones = [i for i, x in enumerate(out) if x[1]]
            first, last = (ones[0], ones[-1] + 1) if ones else (0, len(out))
            where = rng.random()
            if where < 0.3 and ones:
                out[(k := int(rng.integers(first, last + 1))) : k] = furniture(inner, True)
            elif where < 0.65:
                out[first:first] = furniture(pick([body, body, outer]))
            else:
                out[last:last] = furniture(pick([body, body, outer]))
        yield [x[0] for x in out], [x[1] for x in out]


# --- the network ------------------------------------------------------------------------------------------------------


class Inputs:
    """Blocks of several pages: hashed path parts and words (flat, with counts by block), shapes, blocks by page."""

    def __init__(self, path: np.ndarray, n_path: np.ndarray, word: np.ndarray, n_word: np.ndarray, shape: np.ndarray, sizes: np.ndarray):
        self.path, self.n_path, self.word, self.n_word, self.shape, self.sizes = path, n_path, word, n_word, shape, sizes


_PATHS: dict[tuple, np.ndarray] = {}


def _path_codes(node: Node) -> np.ndarray:
    """Features of the path, and of the innermost element once more, hashed; bucket 0 isn't used."""
    outer, near = node.path
    if (outer, near) not in _PATHS:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        parts = [*dict.fromkeys(x for e in (*outer, *near) for x in e), f"={node.name}"]
        data, off = common.string_buffers(pa.array(parts))
        w = common.words(data, off)
        _PATHS[outer, near] = (w.hashes % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return _PATHS[outer, near]


def inputs(pages: list[list[Block]]) -> Inputs:
    flat = [b for p in pages for b in p]
    codes = [_path_codes(b.node) for b in flat]
    data, off = common.string_buffers(pa.array([b.text for b in flat], pa.string()))
    w = common.words(data, off, bare=True)
    sizes = np.array([len(p) for p in pages])
    chars = np.array([len(b.text) for b in flat], float)
    place = np.concatenate([np.arange(n) / max(n, 1) for n in sizes]) if len(flat) else np.zeros(0)
    has = np.repeat([float(any(b.node.within for b in p)) for p in pages], sizes)
    within = np.array([b.node.within for b in flat], float)
    ends = np.array([b.text[-1] in ".!?\"'" for b in flat], float)
    text = np.array([b.node.text for b in flat], float)
    shape = np.column_stack([np.minimum(np.log1p(chars) / 8, 1), np.minimum(np.log1p(w.counts) / 6, 1), np.array([b.linked for b in flat], float) / np.maximum(chars, 1), place, ends, within - 0.5, has * (1 - within), 2 * text - 1, np.ones(len(flat))]) if flat else np.zeros((0, SHAPES))
    return Inputs(np.concatenate([np.zeros(0, np.int32), *codes]), np.array([len(c) for c in codes], int), (w.hashes % np.uint64(BUCKETS - 1)).astype(np.int32) + 1, w.counts, shape.astype(np.float32), sizes)


def _means(table: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(counts), table.shape[1]), np.float32)
    some = counts > 0
    if some.any():
        sums[some] = np.add.reduceat(table[codes], (np.cumsum(counts) - counts)[some])
    return sums / np.sqrt(np.maximum(counts, 1))[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """An LSTM over (time, page, input); a padded step changes nothing."""
    steps, pages, _ = x.shape
    z = x @ wx + b
    h = c = np.zeros((pages, HIDDEN), np.float32)
    out, past = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        a = z[t] + h @ wh
        i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = np.where(m, f * c + i * g, c)
        tc = np.tanh(c2)
        h2 = np.where(m, o * tc, h)
        if keep:
            past.append((i, f, o, g, c, tc, h))
        h, c = h2, c2
        out[t] = h
    return out, past


def _back(dout: np.ndarray, x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, past: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps, pages, _ = x.shape
    dz = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, tc, h = past[t]
        m = mask[t][:, None].astype(np.float32)
        dh = dh + dout[t]
        on = dh * m
        dcell = dc * m + on * o * (1 - tc * tc)
        a = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), on * tc * o * (1 - o), dcell * i * (1 - g * g)], 1)
        dz[t] = a
        dwh += h.T @ a
        dh = dh * (1 - m) + a @ wh.T
        dc = dc * (1 - m) + dcell * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0), dz @ wx.T


def _shaped(model: dict, data: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as (time, page, input), which of them are blocks, and the place of each block in it."""
    v = np.concatenate([_means(model["path"], data.path, data.n_path), _means(model["word"], data.word, data.n_word), data.shape], 1)
    steps, n = int(data.sizes.max(initial=0)), len(data.sizes)
    page = np.repeat(np.arange(n), data.sizes)
    t = np.arange(len(page)) - np.repeat(np.cumsum(data.sizes) - data.sizes, data.sizes)
    x, mask = np.zeros((steps, n, v.shape[1]), np.float32), np.zeros((steps, n), bool)
    x[t, page], mask[t, page] = v, True
    return x, mask, t * n + page


def label(model: dict, data: Inputs) -> np.ndarray:
    """The probability of article text for each block."""
    if not len(data.shape):
        return np.zeros(0)
    x, mask, at = _shaped(model, data)
    h1, _ = _run(x, mask, model["wx1"], model["wh1"], model["b1"])
    h2, _ = _run(x[::-1], mask[::-1], model["wx2"], model["wh2"], model["b2"])
    h = np.concatenate([h1, h2[::-1], x], 2).reshape(-1, 2 * HIDDEN + x.shape[2])[at]
    return _sigmoid(h @ model["v"] + model["c"])


def train(pages: list[list[Block]], labels: list[list[int]], epochs: int = EPOCHS) -> dict:
    rng = np.random.default_rng(5)
    dim = PATH_DIM + WORD_DIM + SHAPES
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    model = {"path": rng.normal(0, 0.3, (BUCKETS, PATH_DIM)).astype(np.float32), "word": rng.normal(0, 0.1, (BUCKETS, WORD_DIM)).astype(np.float32), "v": draw(2 * HIDDEN + dim), "c": np.zeros(1, np.float32)}
    for k in "12":
        model |= {f"wx{k}": draw(dim, 4 * HIDDEN), f"wh{k}": draw(HIDDEN, 4 * HIDDEN), f"b{k}": np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    some = [i for i in range(len(pages)) if pages[i]]
    for _ in range(epochs if some else 0):
        order = rng.permutation(some)
        order = order[np.argsort([len(pages[i]) + rng.integers(0, 8) for i in order], kind="stable")]
        lots = _lots(order, [len(x) for x in pages], BATCH)
        for k in rng.permutation(len(lots)):
            data, y = inputs([pages[i] for i in lots[k]]), np.concatenate([labels[i] for i in lots[k]]).astype(np.float32)
            grads, step = _gradients(model, data, y), step + 1
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                model[name] -= (RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _gradients(model: dict, data: Inputs, y: np.ndarray) -> dict:
    x, mask, at = _shaped(model, data)
    h1, p1 = _run(x, mask, model["wx1"], model["wh1"], model["b1"], True)
    h2, p2 = _run(x[::-1], mask[::-1], model["wx2"], model["wh2"], model["b2"], True)
    steps, n, dim = x.shape
    h = np.concatenate([h1, h2[::-1], x], 2).reshape(-1, 2 * HIDDEN + dim)[at]
    d = ((_sigmoid(h @ model["v"] + model["c"]) - y) / len(y)).astype(np.float32)
    dh = np.zeros((steps * n, 2 * HIDDEN + dim), np.float32)
    dh[at] = d[:, None] * model["v"]
    dh = dh.reshape(steps, n, -1)
    g = {"v": h.T @ d, "c": d.sum(keepdims=True)}
    g["wx1"], g["wh1"], g["b1"], dx1 = _back(dh[:, :, :HIDDEN], x, mask, model["wx1"], model["wh1"], p1)
    g["wx2"], g["wh2"], g["b2"], dx2 = _back(dh[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1], mask[::-1], model["wx2"], model["wh2"], p2)
    dx = (dx1 + dx2[::-1] + dh[:, :, 2 * HIDDEN :]).reshape(-1, dim)[at]
    for name, lo, hi, codes, counts in (("path", 0, PATH_DIM, data.path, data.n_path), ("word", PATH_DIM, PATH_DIM + WORD_DIM, data.word, data.n_word)):
        g[name] = np.zeros_like(model[name])
        np.add.at(g[name], codes, np.repeat(dx[:, lo:hi] / np.sqrt(np.maximum(counts, 1))[:, None], counts, 0).astype(np.float32))
    return g


def learn(pages: DataFrame, fit_pages: int = FIT_PAGES, n_variants: int = VARIANTS) -> dict:
    """The network from a bounded sample of pages."""
    few = pages.where("html is not null").select(F.xxhash64("page_id").alias("o"), "html").orderBy("o", "html").limit(fit_pages)
    before = F.sum(F.length("html")).over(Window.orderBy("o", "html").rowsBetween(Window.unboundedPreceding, -1))  # of a bounded number of pages
    sample = few.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < FIT_CHARS).select("html").toArrow()
    rng = np.random.default_rng(9)
    made = [v for x in sample.column("html").to_pylist() for v in variants(blocks(x), n_variants, rng)]
    return train([x[0] for x in made], [x[1] for x in made])


def _lots(order: list[int], sizes: list[int], rows: int) -> list[list[int]]:
    """Pages that go through the network together, from pages in order of size."""
    lots: list[list[int]] = []
    for i in order:
        if not lots or len(lots[-1]) >= rows or (len(lots[-1]) + 1) * sizes[i] > CELLS:
            lots.append([])
        lots[-1].append(i)
    return lots


def texts(model: dict, pages: list[str]) -> list[str]:
    """The main text of each page."""
    found = [blocks(x) for x in pages]
    out, sizes = [""] * len(found), [len(x) for x in found]
    for lot in _lots(sorted(range(len(found)), key=sizes.__getitem__), sizes, ROWS):
        p, at = label(model, inputs([found[i] for i in lot])), 0
        for i in lot:
            out[i] = "\n".join(b.text for b, x in zip(found[i], p[at : at + sizes[i]], strict=True) if x >= 0.5)
            at += sizes[i]
    return out


def _extract(model: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(common.string_buffers(batch.column("html"))[1], SLICE_BYTES):
                part = batch.slice(a, b - a)
                found = texts(model, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null html is the empty page; a page without article blocks has the empty text. Pages of any length count whole.
    Repeated rows give equal rows; an empty table gives none. Other columns of pages aren't read.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_column(pages, "html").alias("html"))
    return plain.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, learn(pages))
