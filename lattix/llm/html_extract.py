"""Main text of web pages by a recurrent labeller of blocks.

A page is read into its leaf blocks in order: runs of text between tags that break
lines, each with the path of open tags (names, and the words of class, id and role
attributes). A bidirectional LSTM in numpy reads, for every block, hashed vectors of
its tag path and of all its words together with a few measures (length, share of linked
text, place), so each block is labelled with the whole page as context. Blocks
labelled as main text, in page order, joined by a space, are the page's text.

The labels to learn from come from the markup of a bounded sample of pages: text
within ``article`` or ``main`` is main text except within parts that are never so
(menus, asides, forms, comments and the like), text outside is not. As other pages
mark such parts differently, each sampled page is also rewritten in several ways,
with the labels carried along: containers renamed, classes for tags or none, and
menus, notices, adverts, forms, comments and sidebars of other pages' text put in.
Some invented articles are rewritten likewise; where no sampled page has ``article``
or ``main`` the labeller learns from those only.

Defined results: null, empty and text-less pages give the empty text; pages cut off
in the middle of a tag keep what stands before it; unclosed tags end with their
container; scripts, styles, comments, templates and elements marked as hidden (the
attribute, or display or visibility in their style) hold no text; very long pages are
read whole; repeated rows repeat; an empty table gives an empty result; only id, url
and html are read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenTable, bounded_sample, segment_sum, strings, text_slices

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements by how they are read, from the HTML standard.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas select textarea head title".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
STYLE = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
BARE_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s/=]|$)")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")


def is_hidden(attributes: str) -> bool:
    """Whether an element is marked as not shown, by the attribute or by its style."""
    if "hidden" not in (low := attributes.lower()) and "none" not in low:
        return False
    if (style := STYLE.search(low)) and UNSHOWN.search(style[0]):
        return True
    return bool(BARE_HIDDEN.search(QUOTED.sub("=''", low)))


@dataclass
class Block:
    path: tuple[str, ...]  # tag names and attribute words, outermost first
    text: str
    linked: int  # characters within links
    own: int = 0  # label while learning


def blocks_of(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # name, words, whether it holds no visible text
    pieces: list[str] = []
    linked = links = hidden = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append(Block(tuple(w for _, words, _ in stack for w in words), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, hidden
        while len(stack) > depth:
            name, _, unseen = stack.pop()
            links -= name == "a"
            hidden -= unseen

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        end = m.start() if m else size
        if end > at and not hidden:
            pieces.append(page[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        name = m[2] or m[5]
        if not name:
            continue
        if at == size and not page.endswith(">"):  # cut off within the tag
            break
        name = name.lower()
        if m[1] or m[4]:
            if name not in INLINE and not hidden:
                close()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if name in VOID:
            if name not in ("wbr", "img", "input") and not hidden:
                if name == "br":
                    pieces.append(" ")
                else:
                    close()
            continue
        if name in RAW:
            closing = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = closing.end() if closing else size
            if name in ("script", "style"):
                continue
            if not hidden and name not in INLINE:
                close()
            continue
        if name not in INLINE:
            if not hidden:
                close()
            if name in CLOSES_P:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p":
                        pop_to(depth)
                        break
                    if stack[depth][0] not in INLINE:
                        break
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, (name,))
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in alike:
                        pop_to(depth)
                        if name != "tr" or not stack or stack[-1][0] not in alike:
                            break
                    elif stack[depth][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select"):
                        break
        attributes = m[3] or m[6] or ""
        words: tuple[str, ...] = (name,)
        if attributes:
            found = [(k.lower(), a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)]
            words += tuple(f".{w}" for _, v in found for w in NAME.findall(v.lower()))
        unseen = name in HIDDEN or is_hidden(attributes)
        stack.append((name, words, unseen))
        links += name == "a"
        hidden += unseen
    if not hidden:
        close()
    return out


MOST_BLOCKS = 8_000  # of pages that are labelled together, or one page
PATH_DIM, WORD_DIM, MEASURES, HIDDEN_DIM = 48, 8, 10, 16
INPUT = PATH_DIM + WORD_DIM + MEASURES

_signs: dict[tuple[str, int], np.ndarray] = {}


def sign_vector(word: str, size: int) -> np.ndarray:
    """A fixed random vector for a word, by its hash."""
    got = _signs.get((word, size))
    if got is None:
        if len(_signs) > 200_000:
            _signs.clear()
        seed = zlib.crc32(word.encode())
        got = np.random.default_rng(seed).standard_normal(size).astype(np.float32) / np.sqrt(size)
        _signs[word, size] = got
    return got


def _sign_rows(words: list[str]) -> np.ndarray:
    """Even numbers of variance 1 from the word's hash."""
    seed = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    out = np.empty((len(words), WORD_DIM), np.float32)
    for k in range(WORD_DIM):
        x = (seed + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return (out - 0.5) * np.sqrt(12)


_words = TokenTable(_sign_rows, WORD_DIM)
PART = 50_000  # words summed at a time


def word_vectors(texts: list[list[str]]) -> np.ndarray:
    """The sum of the fixed random vectors of all words of each text, at a length of 0.75."""
    out = np.zeros((len(texts), WORD_DIM))
    parts: list[list[str]] = []
    of: list[int] = []
    held = 0

    def add() -> None:
        rows, counts = _words.lookup(parts)
        np.add.at(out, of, segment_sum(rows, counts))

    for i, words in enumerate(texts):
        for at in range(0, len(words), PART):
            parts.append(words[at : at + PART])
            of.append(i)
            held += len(parts[-1])
            if held >= PART:
                add()
                parts, of, held = [], [], 0
    if parts:
        add()
    return 0.75 * out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-6)


_paths: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    got = _paths.get(path)
    if got is None:
        if len(_paths) > 100_000:
            _paths.clear()
        got = np.zeros(PATH_DIM, np.float32)
        for w in dict.fromkeys(path):
            got += sign_vector(w, PATH_DIM)
        if path:
            got += 0.5 * sign_vector(path[-1] + "/", PATH_DIM)
        _paths[path] = got
    return got


def inputs(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUT), np.float32)
    n = max(1, len(blocks) - 1)
    texts = [b.text.lower().split() for b in blocks]
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = word_vectors(texts)
    for i, (b, words) in enumerate(zip(blocks, texts, strict=True)):
        out[i, :PATH_DIM] = path_vector(b.path)
        size = len(b.text)
        out[i, PATH_DIM + WORD_DIM :] = (
            np.log1p(size) / 6,
            np.log1p(len(words)) / 5,
            b.linked / size,
            i / n,
            b.text[-1] in ".!?…\"”»",
            min(1.0, sum(map(b.text.count, ".,;")) / (1 + len(words)) * 4),
            "©" in b.text or "@" in b.text,
            "a" in b.path,
            "p" in b.path,
            bool(b.path) and b.path[-1] in ("h1", "h2", "h3"),
        )
    return out


@dataclass
class Labeller:
    """A bidirectional LSTM with one output a block."""

    wx: np.ndarray  # 2 x INPUT x 4H
    wh: np.ndarray  # 2 x H x 4H
    b: np.ndarray  # 2 x 4H
    out: np.ndarray  # 2H + INPUT
    bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 3) -> Labeller:
        r = np.random.default_rng(seed)
        h = HIDDEN_DIM
        b = np.zeros((2, 4 * h), np.float32)
        b[:, h : 2 * h] = 1  # open forget gates
        return cls(r.normal(0, 0.2, (2, INPUT, 4 * h)).astype(np.float32), r.normal(0, 0.2, (2, h, 4 * h)).astype(np.float32), b, r.normal(0, 0.1, 2 * h + INPUT).astype(np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b, self.out, self.bias]

    def forward(self, x: np.ndarray, mask: np.ndarray, learning: bool = False) -> tuple[np.ndarray, list]:
        """Logits of padded sequences (batch, time); while learning also what a backward pass needs."""
        n, t, _ = x.shape
        h = HIDDEN_DIM
        states = np.zeros((2, n, t, h), np.float32)
        keep = []
        for d in (0, 1):
            gates_x = x @ self.wx[d] + self.b[d]
            hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            steps = []
            for j in range(t) if d == 0 else range(t - 1, -1, -1):
                z = gates_x[:, j] + hid @ self.wh[d]
                s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
                g = np.tanh(z[:, 3 * h :])
                m = mask[:, j, None]
                new_cell = m * (s[:, h : 2 * h] * cell + s[:, :h] * g)
                tc = np.tanh(new_cell)
                new = m * (s[:, 2 * h :] * tc)
                if learning:
                    steps.append((j, s, g, cell, hid, tc))
                hid, cell = new, new_cell
                states[d, :, j] = hid
            keep.append(steps)
        logits = states[0] @ self.out[:h] + states[1] @ self.out[h : 2 * h] + x @ self.out[2 * h :] + self.bias[0]
        return logits, [states, keep]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        h = HIDDEN_DIM
        logits, (states, keep) = self.forward(x, mask, learning=True)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        dz = mask * (p - y) / total
        d_out = np.concatenate([np.einsum("nt,nth->h", dz, states[0]), np.einsum("nt,nth->h", dz, states[1]), np.einsum("nt,nti->i", dz, x)])
        d_wx, d_wh, d_b = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        for d in (0, 1):
            w = self.out[d * h : (d + 1) * h]
            dh_next, dc_next = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            for j, s, g, cell, hid, tc in reversed(keep[d]):
                m = mask[:, j, None]
                dh = (dz[:, j, None] * w + dh_next) * m
                i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                dc = (dh * o * (1 - tc * tc) + dc_next) * m
                gates = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                d_wx[d] += x[:, j].T @ gates
                d_wh[d] += hid.T @ gates
                d_b[d] += gates.sum(0)
                dh_next, dc_next = gates @ self.wh[d].T, dc * f
        return loss, [d_wx, d_wh, d_b, d_out.astype(np.float32), np.array([dz.sum()], np.float32)]

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length go through together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            longest = len(pages[order[at]])
            group = [order[at]]
            while at + len(group) < len(order) and (len(group) + 1) * len(pages[order[at + len(group)]]) < MOST_BLOCKS and len(pages[order[at + len(group)]]) <= 1.15 * longest + 2:
                group.append(order[at + len(group)])
            at += len(group)
            x, mask = padded([inputs(pages[i]) for i in group])
            logits, _ = self.forward(x, mask)
            for row, i in enumerate(group):
                out[i] = logits[row, : len(pages[i])] > 0
        return out


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, parts))
    x, mask = np.zeros((len(parts), t, parts[0].shape[1]), np.float32), np.zeros((len(parts), t), np.float32)
    for i, p in enumerate(parts):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


SYLLABLES = "ba co de el fi gu ha in jo ka lo me no or pe qui ra so tu ve wi xa yo za st en th er".split()
MAIN = frozenset(("article", "main"))
#: Words of tag names and attributes that mark a part as no main text.
ASIDE = frozenset("nav aside footer header form button menu dialog .ad .ads .advert .advertisement .banner .comment .comments .cookie .consent .newsletter .notice .promo .related .share .sidebar .sponsor .subscribe .breadcrumb .breadcrumbs .popup .modal .widget .replies .reply".split())


def weak_label(path: tuple[str, ...]) -> int:
    """1 within ``article`` or ``main`` unless a part that is never main text lies within that."""
    inside = False
    for w in path:
        if w in MAIN:
            inside = True
        elif w in ASIDE and (inside or w != "header"):
            return 0
    return int(inside)


CONTAINERS = [(), ("div",), ("div", "div"), ("table", "tr", "td"), ("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post", ".body"), ("div", ".entry", ".content"), ("section", ".article"), ("div", ".main"), ("div", ".story"), ("div", ".text"), ("main", "div"), ("article", "section"), ("div", ".article", ".body"), ("div", ".wrapper", "article", ".post")]
BEFORE = [("div", "a"), ("ul", "li", "a"), ("p", "a"), ("table", "tr", "td", "a"), ("nav", "ul", "li", "a"), ("div", ".menu", "a"), ("div", ".navigation", "ul", "li", "a"), ("header", "a"), ("header", "div", ".logo"), ("div", ".header"), ("ul", ".nav", "li", "a"), ("div", ".ad"), ("div", ".banner"), ("div", ".cookie", ".notice"), ("div", ".breadcrumb", "a"), ("div", ".topbar"), ("div", ".alert"), ("form", ".search"), ("header", "h2"), ("header", "p")]
WITHIN = [("div", ".ad"), ("aside",), ("aside", "p"), ("div", ".related", "ul", "li", "a"), ("div", ".share", "a"), ("form",), ("form", ".newsletter", "p"), ("div", ".promo"), ("div", ".sponsored"), ("nav", ".toc", "li", "a"), ("div", ".notice"), ("section", ".comments", "p"), ("footer",)]
AFTER = [("div", "a"), ("ul", "li", "a"), ("p", "a"), ("footer",), ("footer", "p"), ("div", ".footer"), ("aside", ".sidebar", "p"), ("div", ".sidebar", "ul", "li", "a"), ("div", ".sidebar", "p"), ("aside", "div", ".widget"), ("section", ".comments", "p"), ("div", ".comments", "div", ".comment", "p"), ("div", ".comment"), ("ol", ".commentlist", "li", "p"), ("div", ".related", "a"), ("div", ".ad"), ("form", ".subscribe", "p"), ("div", ".newsletter"), ("div", ".copyright"), ("div", ".cookie"), ("aside",), ("section", ".reader", ".comments", "article", ".comment", "p"), ("div", ".responses", "p")]


def rewritten(blocks: list[Block], r: random.Random, texts: list[str]) -> list[Block]:
    """The page with other containers and other parts, labels carried along.

    Parts take texts of all lengths, main texts of other pages among them, so the
    labeller has to read paths and context and not the wording.
    """
    root = ("html", "body") + r.choice([(), (), ("div",), ("div", ".page"), ("div", ".wrapper"), ("div", ".container")])
    container = root + r.choice(CONTAINERS)

    def part(kinds: list[tuple[str, ...]], base: tuple[str, ...], most: int) -> list[Block]:
        out = []
        for _ in range(r.randrange(most + 1)):
            kind = r.choice(kinds)
            link = kind[-1] == "a"  # a block's path doesn't hold the link that was closed within it
            path = base + kind[: len(kind) - link]
            for _ in range(r.choice((1, 1, 2, 3, 6))):
                text = r.choice(texts)
                if link:
                    text = " ".join(text.split()[: r.randrange(1, 5)])
                elif r.random() < 0.5:
                    text = " ".join(text.split()[: r.randrange(2, 20)])
                if text:
                    out.append(Block(path, text, len(text) if link else 0, 0))
        return out

    main = []
    no_p = r.random() < 0.2  # pages whose paragraphs are plain divisions
    for b in blocks:
        if b.own:
            inner = b.path[next((i for i, w in enumerate(b.path) if w in MAIN), 0) + 1 :]
            if no_p:
                inner = tuple("div" if w == "p" else w for w in inner)
            kind = r.random()
            if kind < 0.1:
                inner = r.choice((("div",), ("section", "p"), ("blockquote", "p"), ("ul", "li"), ("table", "tr", "td"), ("pre",), ("h2",), ("div", "p"), ("figure", "figcaption")))
            main.append(Block(container + inner, b.text, b.linked, 1))
            if r.random() < 0.06:
                main += part(WITHIN, container, 1)
    if main and r.random() < 0.2:
        main = [Block(container + ("header", *m.path[len(container) :]), m.text, m.linked, 1) if i == 0 else m for i, m in enumerate(main)]
    return part(BEFORE, root, 4) + main + part(AFTER, root if r.random() < 0.8 else container, 4)


def invented(r: random.Random) -> list[Block]:
    """An article of made-up words: headings, paragraphs, lists, a quotation."""
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3))))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize()
    text = lambda n: " ".join(line(r.randrange(4, 16)) + r.choice(".....?!") for _ in range(n))
    out = [Block(("article", "h1"), line(r.randrange(2, 9)), 0, 1)]
    for _ in range(r.randrange(1, 9)):
        kind = r.random()
        if kind < 0.1:
            out.append(Block(("article", "h2"), line(r.randrange(1, 6)), 0, 1))
        elif kind < 0.18:
            out += [Block(("article", "ul", "li"), line(r.randrange(2, 14)), 0, 1) for _ in range(r.randrange(2, 6))]
        elif kind < 0.22:
            out.append(Block(("article", "blockquote", "p"), text(2), 0, 1))
        else:
            out.append(Block(("article", "p"), text(r.randrange(1, 6)), 0, 1))
    return out


def train(pages: list[str], copies: int = 6, epochs: int = 12, seed: int = 11, made_up: int = 60) -> Labeller:
    """Learn from sample pages, each as it is and ``copies`` times rewritten, and from ``made_up`` invented ones likewise."""
    model = Labeller.fresh()
    r = random.Random(seed)
    kept: list[list[Block]] = []
    for page in pages:
        blocks = blocks_of(page)
        for b in blocks:
            b.own = weak_label(b.path)
        if any(b.own for b in blocks):
            kept.append(blocks)
    own = [invented(r) for _ in range(made_up if kept else 4 * made_up)]
    texts = [b.text for p in kept + own for b in p]
    r.shuffle(texts)
    data = kept + [rewritten(p, r, texts) for p in kept + own for _ in range(copies)]
    # long pages are learnt from in stretches; they are labelled whole
    data = [p[k : k + 80] for p in data for k in range(0, len(p), 80)]
    ready = [(inputs(p), np.array([b.own for b in p], np.float32)) for p in data if p]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    step = 0
    for epoch in range(epochs):
        r.shuffle(ready)
        ready.sort(key=lambda x: len(x[0]) // 8)
        groups = [ready[k : k + 32] for k in range(0, len(ready), 32)]
        r.shuffle(groups)
        for group in groups:
            x, mask = padded([a for a, _ in group])
            y, _ = padded([b[:, None] for _, b in group])
            _, grads = model.gradient(x, mask, y[:, :, 0])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = 0.01 * 0.75**epoch / max(1.0, norm / 5)
            for p, g, (m, v) in zip(model.parts(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def learn(pages: DataFrame, most: int = 300) -> Labeller:
    """Train on a hash-ordered sample of at most ``most`` pages."""
    rows = bounded_sample(pages.where("html is not null").select("page_id", "html", F.lit(1).alias("one")), "one", "page_id", most)
    return train([r["html"] for r in rows])


def extract_texts(model: Labeller, pages: list[str]) -> list[str]:
    found = [blocks_of(p) for p in pages]
    return [" ".join(b.text for b, main in zip(blocks, keep, strict=True) if main) for blocks, keep in zip(found, model.label(found), strict=True)]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """One row a page; a map over the scan without any shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some ten thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html", 4 << 20):
            texts = extract_texts(shared.value, strings(batch.column("html")))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, SCHEMA)
