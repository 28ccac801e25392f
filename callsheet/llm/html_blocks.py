"""Main text of web pages: a recurrent labeller over the sequence of text blocks.

A page becomes its sequence of leaf blocks. A block is described by its tag path
(names, classes, ids and roles of the elements around it, hashed), its hashed words and
a few numbers. A bidirectional LSTM in numpy reads the whole sequence, so each block is
judged in the light of the whole page, and labels it main text or not.

The model is fitted here on a bounded sample of pages: blocks whose path says what
they are (`article`, `nav`, ...) label themselves, and layouts of other kinds are
composed from the sample's texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import shipped, with_small_batches

#: Pages that the model is fitted on (expected; twice as many at most), and the longest page
#: among them, in code points.
SAMPLE_PAGES = 200
SAMPLE_CHARS = 20_000
#: Composed layouts, and the most blocks of a training page.
LAYOUTS = 800
TRAIN_BLOCKS = 120
EPOCHS = 10
HIDDEN = 24
PATH_SIZE, WORD_SIZE, NUMBERS = 96, 32, 8
FEATURES = PATH_SIZE + WORD_SIZE + NUMBERS
#: Block vectors that are in memory at a time.
CELLS = 40_000
#: Distance of an element that is not around a block.
_FAR = 1 << 30

# HTML elements by their role in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
EMPTY = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Their content is no text of the page.
HIDDEN_ELEMENTS = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")
#: An element that ends when one of the same group begins.
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th",
            "th": "td th", "option": "option", "p": "p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in tag names, classes, ids and roles that mark main text and the rest.
MAIN_WORDS = frozenset("article body content entry main post prose story text".split())
REST_WORDS = frozenset(
    "ad ads advert advertisement aside banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer form masthead menu modal nav navbar navigation newsletter notice "
    "popup promo promoted related replies reply share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    # An svg tag that closes itself; a slash at the end of a value without quotes is the value's.
    r"|<svg(?=[\s/])(?:\s++|/(?!>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+/>"
    r"|<(?P<hide>" + "|".join(HIDDEN_ELEMENTS) + r")\b[^>]*+>.*?(?:</(?P=hide)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORD = re.compile(r"[a-z]+")


class Element:
    """An open block-level element: name, words of class, id and role, and what stands around it.

    `nearest` has for each hashed word the number of elements from here out to the
    closest one with that word, so that a block knows its whole path at the cost of one
    element, however deep it stands.
    """

    __slots__ = ("parent", "words", "depth", "nearest")

    def __init__(self, parent: Element | None, words: tuple[str, ...]):
        self.parent, self.words = parent, words
        self.depth = parent.depth + 1 if parent else 1
        self.nearest = parent.nearest + 1 if parent else np.full(PATH_SIZE, _FAR, np.int32)
        self.nearest[[crc32(word.encode()) % PATH_SIZE for word in words]] = 0


class Block:
    """Text between block-level tags, with the innermost element around it."""

    __slots__ = ("inside", "text", "linked")

    def __init__(self, inside: Element | None, text: str, linked: int):
        self.inside, self.text, self.linked = inside, text, linked

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        """The elements around it, the outermost first."""
        found, element = [], self.inside
        while element:
            found.append(element.words)
            element = element.parent
        return tuple(reversed(found))


class _Open:
    """The open elements, the innermost of each name and the innermost block found at once."""

    def __init__(self):
        self.names: list[str] = []
        self.elements: list[Element | None] = []  # the innermost block, at each place
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = 0

    @property
    def inside(self) -> Element | None:
        return self.elements[-1] if self.elements else None

    def add(self, name: str, words: list[str]) -> None:
        place, inside = len(self.names), self.inside
        if name not in INLINE:
            self.blocks.append(place)
            inside = Element(inside, (name, *words))
        self.names.append(name)
        self.elements.append(inside)
        self.places.setdefault(name, []).append(place)
        self.links += name == "a"

    def close(self, place: int) -> None:
        while len(self.names) > place:
            name = self.names.pop()
            self.elements.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            self.links -= name == "a"

    def end(self, name: str) -> None:
        """An end tag; an inline one does not close the blocks that stand open in it."""
        places = self.places.get(name)
        if places and (name not in INLINE or not self.blocks or self.blocks[-1] < places[-1]):
            self.close(places[-1])

    def end_sibling(self, name: str) -> None:
        """Closes the block that the start of a block of this name ends, if it is the innermost."""
        if self.blocks and self.names[self.blocks[-1]] in SIBLINGS.get(name, "p").split():
            self.close(self.blocks[-1])


def blocks_of(html: str | None) -> list[Block]:
    """The page's non-empty text blocks in order, character references decoded.

    White space in a block becomes one space. Open elements are closed as far as the
    tags tell; a page may end anywhere.
    """
    found: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    linked = at = 0
    html = html or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(stack.inside, text, linked))
        parts.clear()
        linked = 0

    for token in _TOKEN.finditer(html):
        if token.start() > at:
            text = unescape(html[at : token.start()])
            parts.append(text)
            if stack.links:
                linked += len(text)
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if token["end"] or token["end2"]:
            stack.end(name)
            continue
        if name not in INLINE:
            stack.end_sibling(name)
        if name not in EMPTY:
            stack.add(name, [
                w
                for values in _ATTRIBUTE.findall(token["more"] or "")
                for w in _NAME_WORD.findall("".join(values).lower())
            ])
    if at < len(html):
        parts.append(unescape(html[at:]))
        if stack.links:
            linked += len(parts[-1])
    flush()
    return found


def own_label(block: Block) -> int | None:
    """1 main text, 0 the rest, as the innermost telling element says; None if none does."""
    path = block.path
    names = [e[0] for e in path]
    for i in range(len(names) - 1, -1, -1):
        words = set(path[i])
        if names[i] == "header":
            if "article" in names[:i] or "main" in names[:i]:
                continue  # a heading of the article
            return 0
        if words & REST_WORDS:
            return 0
        if names[i] != "body" and words & MAIN_WORDS:
            return 1
    return None


def features(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row per block: hashed tag path, hashed words, numbers.

    The blocks stand from place `first` on among the `total` blocks of their page.
    """
    total = total or len(blocks)
    rows = np.zeros((len(blocks), FEATURES), np.float32)
    inside, paths = None, None
    for i, block in enumerate(blocks):
        if block.inside is not None:
            if block.inside is not inside:
                inside = block.inside
                # Elements close to the text count more.
                paths = np.where(inside.nearest < _FAR, 1 / (1 + 0.2 * inside.nearest), 0)
            rows[i, :PATH_SIZE] = paths
        words = block.text.lower().split()
        hashed = np.bincount(
            np.fromiter((crc32(w.encode()) for w in words), np.int64, len(words)) % WORD_SIZE,
            minlength=WORD_SIZE,
        )
        rows[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = hashed / len(words)
        size = len(block.text)
        rows[i, PATH_SIZE + WORD_SIZE :] = (
            np.log1p(size) / 8,
            np.log1p(len(words)) / 6,
            min(block.linked / size, 1),
            block.text[-1] in ".!?:",
            block.inside is not None and block.inside.words[0] in HEADINGS,
            (first + i) / total,
            (block.inside.depth if block.inside else 0) / 10,
            1,
        )
    return rows


class Labeller:
    """Bidirectional LSTM over block vectors with a logistic output per block."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden

        def weights(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1  # remember at first
        self.weights = {
            **{f"x{d}": weights(FEATURES, 4 * hidden) for d in "fb"},
            **{f"h{d}": weights(hidden, 4 * hidden) for d in "fb"},
            **{f"c{d}": bias.copy() for d in "fb"},
            "o": weights(2 * hidden, 1),
            "p": weights(FEATURES, 1),
            "q": np.zeros(1, np.float32),
        }

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, start=None, trace: list | None = None):
        """States of one direction over time-first padded input, and the last two of them.

        It goes on from `start`, what it returned for the stretch before. What learning
        needs is added to `trace`.
        """
        n, wh = self.hidden, self.weights["h" + d]
        gates_x = x @ self.weights["x" + d] + self.weights["c" + d]
        h, c = start or (np.zeros((x.shape[1], n), np.float32),) * 2
        states = np.zeros((*x.shape[:2], n), np.float32)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in steps:
            z = gates_x[t] + h @ wh
            s = 1 / (1 + np.exp(-z[:, : 3 * n]))
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, tanh_c, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tanh_c) + (1 - m) * h
            states[t] = h
        return states, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray):
        """Probabilities (time, page) of main text."""
        w = self.weights
        traces: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._direction(x, mask, d, trace=traces[d])[0] for d in "fb"], axis=2)
        z = (both @ w["o"] + x @ w["p"] + w["q"])[:, :, 0]
        return 1 / (1 + np.exp(-z)), both, traces

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradient of the mean weighted cross-entropy; padded blocks have weight 0."""
        n, w = self.hidden, self.weights
        p, both, traces = self.forward(x, mask)
        dz = ((p - y) * weight / max(weight.sum(), 1)).astype(np.float32)[:, :, None]
        flat = lambda a: a.reshape(-1, a.shape[-1])
        grads = {
            "o": flat(both).T @ flat(dz),
            "p": flat(x).T @ flat(dz),
            "q": dz.sum((0, 1)),
        }
        d_both = dz @ w["o"].T
        for k, d in enumerate("fb"):
            gates = np.zeros((*x.shape[:2], 4 * n), np.float32)
            dwh = np.zeros_like(w["h" + d])
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            for t, h, c, i, f, o, g, tanh_c, m in reversed(traces[d]):
                dh = dh + d_both[t, :, k * n : (k + 1) * n]
                new_dc = m * (dc + dh * o * (1 - tanh_c**2))
                dg = np.concatenate(
                    [
                        new_dc * g * i * (1 - i),
                        new_dc * c * f * (1 - f),
                        m * dh * tanh_c * o * (1 - o),
                        new_dc * i * (1 - g**2),
                    ],
                    axis=1,
                )
                gates[t] = dg
                dwh += h.T @ dg
                dh = dg @ w["h" + d].T + (1 - m) * dh
                dc = new_dc * f + (1 - m) * dc
            grads |= {"x" + d: flat(x).T @ flat(gates), "h" + d: dwh, "c" + d: gates.sum((0, 1))}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> None:
        """Adam over batches of pages of similar length: vectors, labels, weights."""
        rng = np.random.default_rng(11)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [order[i : i + 24] for i in range(0, len(order), 24)]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, rate = 0, 0.01
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                x, mask, (y, weight) = _padded([pages[i] for i in batches[b]])
                step += 1
                for k, g in self.gradient(x, mask, y, weight).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    scale = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7
                    self.weights[k] -= rate / (1 + epoch) * first[k] / (1 - 0.9**step) / scale

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, whether each block is main text.

        Pages of similar length go together. Vectors are made for CELLS blocks at a time
        and a block leaves one number behind, so memory does not grow with vectors or states.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # Pages are sorted, so the last of a group is the longest.
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(pages[order[stop]]) <= CELLS:
                stop += 1
            group = order[at:stop]
            for i, logits in zip(group, self._logits([pages[i] for i in group])):
                out[i] = logits > 0
            at = stop
        return out

    def _logits(self, pages: list[list[Block]]) -> list[np.ndarray]:
        w, n, longest = self.weights, self.hidden, max(map(len, pages))
        step = max(CELLS // len(pages), 1)
        stretches = range(0, longest, step)
        logits = np.zeros((longest, len(pages)), np.float32)

        def vectors(t: int) -> tuple[np.ndarray, np.ndarray]:
            parts = [(features(p[t : t + step], t, len(p)),) for p in pages]
            return _padded(parts)[:2]

        # A group of one stretch, the usual case, has its vectors made once.
        once = vectors(0) if len(stretches) == 1 else None
        for k, d in enumerate("fb"):
            last = None
            for t in stretches if d == "f" else reversed(stretches):
                x, mask = once or vectors(t)
                states, last = self._direction(x, mask, d, last)
                logits[t : t + len(x)] += (states @ w["o"][k * n : (k + 1) * n])[:, :, 0]
                if d == "f":
                    logits[t : t + len(x)] += (x @ w["p"] + w["q"])[:, :, 0]
        return [logits[: len(p), column] for column, p in enumerate(pages)]


def _padded(pages: list[tuple]):
    longest = max(len(p[0]) for p in pages)
    x = np.zeros((longest, len(pages), FEATURES), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    others = [np.zeros((longest, len(pages)), np.float32) for _ in pages[0][1:]]
    for i, (rows, *more) in enumerate(pages):
        x[: len(rows), i], mask[: len(rows), i] = rows, 1
        for to, values in zip(others, more):
            to[: len(rows), i] = values
    return x, mask, others


def compose(rng: np.random.Generator, main: list[str], rest: list[str]) -> tuple[str, list[int]]:
    """A page of a common layout made of given texts, and the label of each of its blocks."""
    out: list[str] = []
    labels: list[int] = []
    pick = lambda options: options[int(rng.integers(len(options)))]
    some = lambda texts: pick(texts or ["."])

    def put(tag: str, text: str, label: int) -> None:
        out.append(f"<{tag}>{text}</{tag.split()[0]}>")
        labels.append(label)

    def links(n: int) -> None:
        out.append("<ul>")
        for _ in range(n):
            text = " ".join(some(rest).split()[: int(rng.integers(1, 4))]) or "."
            out.append(f'<li><a href="#">{text}</a></li>')
            labels.append(0)
        out.append("</ul>")

    def boxed(opening: str, inside) -> None:
        out.append(f"<{opening}>")
        inside()
        out.append(f"</{opening.split()[0]}>")

    def prose(n: int) -> None:
        for _ in range(n):
            put(pick(["p", "p", "div"]), some(rest + main), 0)

    side = [
        lambda: boxed(pick(["div class=ad", "div class=advert", "aside class=promo", 'div class="banner ads"']), lambda: prose(1)),
        lambda: boxed(pick(["aside", "div class=sidebar", "div id=side-bar class=widget", "aside class=related"]), lambda: (prose(int(rng.integers(3))), links(3))),
        lambda: boxed(pick(["div class=cookie-notice", "div id=cookies role=dialog", "div class=consent", "div class=notice"]), lambda: prose(1)),
        lambda: boxed(pick(["form", "form class=newsletter", "div class=signup-form"]), lambda: put("label", some(rest), 0)),
    ]

    def sides(chance: float) -> None:
        for box in side:
            if rng.random() < chance:
                box()

    out.append("<html><body>")
    if rng.random() < 0.7:
        boxed(pick(["header", "div class=header", "div id=masthead"]), lambda: put("div", some(rest), 0))
    if rng.random() < 0.8:
        boxed(pick(["nav", "div class=menu", "div id=nav role=navigation"]), lambda: links(int(rng.integers(1, 7))))
    sides(0.35)
    wrap = pick(["article", "main", "div class=content", "div id=main class=post", "div class=entry-content",
                 "div class=story", "section", "div class=c1", "div"])
    out.append(f"<{wrap}>")
    put("h1", " ".join(some(main).split()[:9]) or ".", 1)
    for _ in range(int(rng.integers(1, 10))):
        kind = rng.random()
        if kind < 0.75:
            put("p", some(main), 1)
        elif kind < 0.85:
            put(pick(["h2", "blockquote", "pre", "figcaption"]), some(main), 1)
        elif kind < 0.93:
            out.append("<ul>")
            for _ in range(int(rng.integers(1, 4))):
                put("li", some(main), 1)
            out.append("</ul>")
        elif wrap.split()[0] != "div" or "=" in wrap:
            pick(side)()
    out.append(f"</{wrap.split()[0]}>")
    if rng.random() < 0.4:
        boxed(pick(["section class=comments", "div id=comments", "div class=comment-list"]),
              lambda: [boxed("div class=comment", lambda: prose(1)) for _ in range(int(rng.integers(1, 5)))])
    sides(0.3)
    if rng.random() < 0.8:
        boxed(pick(["footer", "div class=footer", "div id=footer"]), lambda: prose(1))
    out.append("</body></html>")
    return "".join(out), labels


def train(htmls: list[str]) -> Labeller:
    """Fits a labeller on sample pages and on layouts composed of their texts."""
    from html import escape

    rng = np.random.default_rng(5)
    examples, main, rest = [], [], []
    for html in htmls:
        blocks = blocks_of(html)[:TRAIN_BLOCKS]
        labels = [own_label(b) for b in blocks]
        if 1 in labels:
            weight = np.array([x is not None for x in labels], np.float32)
            examples.append((features(blocks), np.array([x or 0 for x in labels], np.float32), weight))
        for block, label in zip(blocks, labels):
            (rest if label == 0 else main).append(escape(block.text))
    for _ in range(LAYOUTS):
        html, labels = compose(rng, main, rest)
        blocks = blocks_of(html)
        if len(blocks) == len(labels):
            examples.append((features(blocks), np.array(labels, np.float32), np.ones(len(labels), np.float32)))
    labeller = Labeller()
    labeller.fit(examples)
    return labeller


def fit(pages: DataFrame, html_column: str = "html", sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller fitted on about `sample_pages` pages of at most SAMPLE_CHARS code points.

    The sample is the distinct pages with the smallest hashes, whatever the order of the
    rows. A cut among the hash values picks them where they lie, so that a task sends on
    no more than its share of the sample; twice `sample_pages` is the most that is used.
    """
    share = min(1.0, sample_pages / max(pages.count(), 1))
    cut = min(int(share * 2**64), 2**64 - 1) - 2**63
    html = F.col(html_column).cast("string")
    sample = (
        pages.select(html.alias("html"), F.xxhash64(html).alias("h"))
        .where((F.col("h") <= cut) & F.length("html").between(1, SAMPLE_CHARS))
        .groupBy("h")
        .agg(F.min("html").alias("html"))
        .orderBy("h")
        .limit(2 * sample_pages)
        .collect()
    )
    return train([row["html"] for row in sample])


def main_texts(htmls: list[str | None], labeller: Labeller) -> list[str]:
    """Main text of each page: its main blocks in page order, joined by line feeds."""
    parsed = [blocks_of(h) for h in htmls]
    labels = labeller.label(parsed)
    return [
        "\n".join([b.text for b, keep in zip(blocks, keeps) if keep])
        for blocks, keeps in zip(parsed, labels)
    ]


def extract(pages: DataFrame, labeller: Labeller, html_column: str = "html") -> DataFrame:
    """The rows with their main text in `main_text`; empty for null, empty and textless pages.

    Pages are independent of each other: nothing is shuffled, and equal pages get equal
    texts. A column of that name in `pages` is an error.
    """
    if "main_text" in pages.columns:
        raise ValueError("column exists already: main_text")
    shared = shipped(pages.sparkSession, labeller)  # weights of a fixed size

    @F.pandas_udf("string")
    def text_of(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in htmls:
            texts: list[str] = []
            for at in range(0, len(series), 256):
                texts += main_texts(series.iloc[at : at + 256].tolist(), shared())
            yield pd.Series(texts)

    return with_small_batches(pages).withColumn("main_text", text_of(F.col(html_column).cast("string")))
