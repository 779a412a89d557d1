"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags. A block's
vector holds its tag path (hashed tag names, classes and ids of the open elements), its hashed
words and a few measures. A bidirectional LSTM, in numpy, reads the whole sequence both ways
and labels every block as main text or not from the context of the whole document.

The network is trained here, from a fixed seed, on pages built by rules: articles in many
kinds of mark-up, among menus, headers, footers, side bars, notices, adverts, forms and reader
comments, with invented words. No page of the corpus is needed for it.

Character references are decoded, white space inside a block becomes one space, and the main
blocks are joined by newlines. Scripts, styles and comments of the mark-up are no text, up to
their ends or, without one, the page's. Neither is what stands inside embedded objects, drawings
and ``noscript``, which browsers that run scripts don't show; without an end, or closed in
itself, such an element has no inside.
Defined results: null and empty pages, and pages without main text, have an empty text; repeated
rows have equal texts, an empty table none; a block of which the network is undecided is main
text; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML by how they are read.
BLOCK = set("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CODE, NO_TEXT = "script|style", "noscript|template|svg|iframe|object|math|audio|video|canvas"
CLOSES_P = BLOCK - set("body html head title button label option select".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}

# Attributes: a quote opens a value only behind an equals sign. Nothing is read twice, so a tag costs its length.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?>[^<>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>|<[!?][^>]*>",
    re.S,
)
HIDDEN = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in (CODE + "|" + NO_TEXT).split("|")}
NAMES = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")

PATH_DIM, WORD_DIM, MEASURES = 1024, 64, 6
DIM = PATH_DIM + WORD_DIM + MEASURES


def path_tokens(tag: str, attrs: str) -> list[int]:
    out = [tag]
    if attrs:
        for kind, a, b, c in NAMES.findall(attrs):
            out += [f".{w.lower()}" for w in PART.findall(a or b or c)]
    return [crc32(x.encode()) % PATH_DIM for x in out]


class Names(tuple):
    """The different hashed names of all open elements, and how many there are with repetitions."""

    size = 0


class Path:
    """The hashed names of all open elements, changed at their ends only."""

    def __init__(self):
        self.stack: list[tuple[str, list[int]]] = []
        self.open: Counter[str] = Counter()
        self.names: dict[int, int] = {}
        self.size = 0
        self.known: Names | None = Names()

    def push(self, tag: str, names: list[int]) -> None:
        self.stack.append((tag, names))
        self.open[tag] += 1
        self.size += len(names)
        for i in names:
            self.names[i] = self.names.get(i, 0) + 1
        self.known = None

    def pop(self) -> str:
        tag, names = self.stack.pop()
        self.open[tag] -= 1
        self.size -= len(names)
        for i in names:
            self.names[i] -= 1
            if not self.names[i]:
                del self.names[i]
        self.known = None
        return tag

    def top(self) -> str | None:
        return self.stack[-1][0] if self.stack else None

    def held(self) -> Names:
        if self.known is None:
            self.known = Names(self.names)
            self.known.size = self.size
        return self.known


def blocks(html: str | None) -> list[tuple[str, tuple[int, ...], float]]:
    """(text, hashed tag path, share of the text inside links) of each leaf block, in order. One pass:
    the end of an element without text is looked for once where there is none."""
    html = html or ""
    out: list[tuple[str, tuple[int, ...], float]] = []
    path, held, endless = Path(), [], set()
    link, linked, at, begin = 0, 0, 0, 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((text, path.held(), min(1.0, linked / len(text))))
            held, linked = [], 0

    while m := TOKEN.search(html, begin):
        if m.start() > at:
            held.append(html[at : m.start()])
            if link:
                linked += m.start() - at
        at = begin = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in HIDDEN and not m["end"]:
            code = tag in CODE.split("|")
            if code or not m["attrs"].endswith("/"):
                end = None if tag in endless else HIDDEN[tag].search(html, at)
                if end:
                    at = begin = end.end()
                else:
                    endless.add(tag)
                    if code:
                        at = begin = len(html)
            continue
        if tag == "a":
            link = 0 if m["end"] else 1
        if tag == "br":
            held.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if m["end"]:
            if path.open[tag]:
                while path.pop() != tag:
                    pass
        elif tag not in VOID:
            if tag in CLOSES_P and path.top() == "p":
                path.pop()
            while path.stack and path.top() in IMPLIED.get(tag, ()):
                path.pop()
            path.push(tag, path_tokens(tag, m["attrs"]))
    if at < len(html):
        held.append(html[at:])
    flush()
    return out


@lru_cache(200_000)
def hash_word(w: str) -> int:
    return PATH_DIM + crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM


def sparse(page: list[tuple[str, tuple[int, ...], float]]) -> tuple[list[int], list[float], list[int]]:
    """(features, values, number of features of each block) of a page."""
    n, cols, vals, sizes = len(page), [], [], []
    for k, (text, path, links) in enumerate(page):
        words = text.lower().split()
        counts = np.bincount([*map(hash_word, words)], minlength=PATH_DIM + WORD_DIM)[PATH_DIM:]
        there = np.flatnonzero(counts)
        marks = sum(map(text.count, ".,;:!?"))
        own = [*dict.fromkeys(path), *(there + PATH_DIM).tolist(), *range(DIM - MEASURES, DIM)]
        cols += own
        vals += [1.0] * (len(own) - MEASURES - len(there)) + (counts[there] / len(words)).tolist()
        vals += (log1p(len(text)) / 8, links, min(1.0, 10 * marks / len(text)), k / n, getattr(path, "size", len(path)) / 16, 1.0)
        sizes.append(len(own))
    return cols, vals, sizes


def vectors(page: list[tuple[str, tuple[int, ...], float]]) -> np.ndarray:
    cols, vals, sizes = sparse(page)
    x = np.zeros((len(page), DIM), np.float32)
    np.add.at(x, (np.repeat(np.arange(len(page)), sizes), cols), vals)
    return x


class Network:
    """A bidirectional LSTM of one layer with a logistic label for each step."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h = h = hidden
        self.p = {}
        for side in "fb":
            self.p[f"W{side}"] = (r.standard_normal((DIM, 4 * h)) * 0.1).astype(np.float32)
            self.p[f"U{side}"] = (r.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.p[f"c{side}"] = bias
        self.p["V"] = (r.standard_normal(2 * h) * 0.1).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def sweep(self, z: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states over the steps (axis 1) of the inputs ``z``; masked steps pass the state on."""
        n, steps, h = z.shape[0], z.shape[1], self.h
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.zeros((n, steps, h), np.float32), []
        for t in range(steps):
            a = z[:, t] + s @ u
            g = 1 / (1 + np.exp(-a[:, : 3 * h]))
            i, f, o, q = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(a[:, 3 * h :])
            m = mask[:, t, None]
            c2 = f * c + i * q
            k = np.tanh(c2)
            if keep:
                tape.append((s, c, i, f, o, q, k, m))
            s, c = m * (o * k) + (1 - m) * s, m * c2 + (1 - m) * c
            out[:, t] = s
        return out, tape

    def projected(self, pages: list[list]) -> np.ndarray:
        """What both directions' gates get from the inputs, block by block of all pages, from the
        few features that a block has."""
        cols, vals, sizes = map(np.concatenate, zip(*[tuple(map(np.array, sparse(p))) for p in pages], strict=True))
        w = np.concatenate([self.p["Wf"], self.p["Wb"]], axis=1)
        rows = w[cols] * vals.astype(np.float32)[:, None]
        return np.add.reduceat(rows, np.cumsum(sizes) - sizes) + np.concatenate([self.p["cf"], self.p["cb"]])

    def states(self, zf: np.ndarray, zb: np.ndarray, mask: np.ndarray, keep: bool = False):
        sf, tf = self.sweep(zf, self.p["Uf"], mask, keep)
        sb, tb = self.sweep(zb[:, ::-1], self.p["Ub"], mask[:, ::-1], keep)
        s = np.concatenate([sf, sb[:, ::-1]], axis=2)
        return 1 / (1 + np.exp(-(s @ self.p["V"] + self.p["d"]))), s, tf, tb

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        flat, p = x.reshape(-1, DIM), self.p
        zf, zb = ((flat @ p[f"W{side}"] + p[f"c{side}"]).reshape(*x.shape[:2], -1) for side in "fb")
        return self.states(zf, zb, mask, keep)

    def backward(self, x, mask, y, weight):
        """Gradients of the mean cross entropy."""
        p, h = self.p, self.h
        prob, s, tf, tb = self.forward(x, mask, True)
        d = ((prob - y) * mask * weight / mask.sum()).astype(np.float32)
        g = {"V": np.einsum("nt,nth->h", d, s), "d": np.array([d.sum()], np.float32)}
        ds = d[:, :, None] * p["V"]
        flat = x.reshape(-1, DIM)
        for side, tape, grad in (("f", tf, ds[:, :, :h]), ("b", tb, ds[:, ::-1, h:])):
            dz = np.zeros((*x.shape[:2], 4 * h), np.float32)
            du = np.zeros_like(p[f"U{side}"])
            back_s, back_c = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                s0, c0, i, f, o, q, k, m = tape[t]
                e = grad[:, t] + back_s
                dk = e * m * o * (1 - k * k) + back_c * m
                a = np.concatenate([dk * q * i * (1 - i), dk * c0 * f * (1 - f), e * m * k * o * (1 - o), dk * i * (1 - q * q)], axis=1)
                dz[:, t] = a
                du += s0.T @ a
                back_s = a @ p[f"U{side}"].T + e * (1 - m)
                back_c = dk * f + back_c * (1 - m)
            dz = dz if side == "f" else dz[:, ::-1]
            g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = du, flat.T @ dz.reshape(-1, 4 * h), dz.sum((0, 1))
        return g

    def labels(self, pages: list[list], at_once: int = 1024) -> list[np.ndarray]:
        """Probabilities for all blocks of all pages; few blocks at a time, long pages apart."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            take = [order[at]]
            while at + len(take) < len(order) and (len(take) + 1) * len(pages[order[at + len(take)]]) <= at_once:
                take.append(order[at + len(take)])
            sizes = [len(pages[i]) for i in take]
            mask = (np.arange(max(sizes)) < np.array(sizes)[:, None]).astype(np.float32)
            z = np.zeros((*mask.shape, 8 * self.h), np.float32)
            z[mask > 0] = self.projected([pages[i] for i in take])
            prob = self.states(z[:, :, : 4 * self.h], z[:, :, 4 * self.h :], mask)[0]
            for k, i in enumerate(take):
                out[i] = prob[k, : len(pages[i])]
            at += len(take)
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((len(rows), steps, DIM), np.float32), np.zeros((len(rows), steps), np.float32)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
    return x, mask


# Fixed values of the training pages: class and id words of the parts of a page that are not its main text.
PARTS = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topbar tabs pagination pager toc skip links",
    "header": "header masthead banner top branding logo site tagline subtitle hero",
    "footer": "footer foot bottom copyright colophon legal credits imprint",
    "aside": "sidebar aside widget widgets rail related recommended popular trending tags share social author bio secondary complementary",
    "notice": "cookie cookies consent gdpr notice alert popup modal banner overlay message warning privacy",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion promoted adsense dfp teaser offer",
    "form": "form signup subscribe newsletter search login contact input register",
    "comments": "comments comment replies reply discussion disqus respond thread feedback reader responses",
}
MAIN_NAMES = "content main article post entry story body text page prose single primary container wrapper blog news markdown".split()
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside", "dialog"], "ad": ["div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol", "aside"]}


LETTERS = "aeiounrstldmchbgé"
MAIN, OTHER = "\ue000", "\ue001"  # marks in front of a text: its label


class Pages:
    """Invented pages; each block carries its label until the page is parsed."""

    def __init__(self, seed: int):
        self.r = r = np.random.default_rng(seed)
        letters = r.integers(0, len(LETTERS), (4000, 9))
        self.words = ["".join(LETTERS[i] for i in row[: 2 + k % 8]) for k, row in enumerate(letters)]

    def text(self, least: int, most: int) -> str:
        n = int(self.r.integers(least, most + 1))
        out = [self.words[i] for i in self.r.integers(0, len(self.words), n)]
        for i in np.flatnonzero(self.r.random(n) < 0.12):
            out[i] += ".,!?"[i % 4]
        return " ".join(out).capitalize()

    def pick(self, *xs):
        return xs[int(self.r.integers(len(xs)))]

    def names(self, words: list[str]) -> str:
        if self.r.random() < 0.1:
            return ""
        chosen = "-".join(self.r.choice(words, min(len(words), int(self.r.integers(1, 3))), replace=False))
        return f' {self.pick("class", "class", "id")}="{chosen}"'

    def marked(self, main: bool, text: str) -> str:
        """The text behind a mark that :func:`labelled` takes off again."""
        return (MAIN if main else OTHER) + text

    def part(self, kind: str) -> str:
        r, tag = self.r, self.pick(*TAGS[kind])
        attrs = self.names(PARTS[kind].split()) if tag not in ("nav", "header", "footer", "form") or r.random() < 0.5 else ""
        if tag in ("div", "section", "ul", "ol") and not attrs:
            attrs = f' class="{self.pick(*PARTS[kind].split())}"'
        m = lambda a, b: self.marked(False, self.text(a, b))
        n = int(r.integers(1, 8))
        if kind == "nav":
            items = "".join(f'<li><a href="/x">{m(1, 3)}</a></li>' for _ in range(n))
            body = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "form":
            body = "".join(self.pick(f"<label>{m(1, 4)}</label><input>", f"<p>{m(3, 20)}</p>", f"<button>{m(1, 3)}</button>", f"<select><option>{m(1, 2)}<option>{m(1, 2)}</select>") for _ in range(int(r.integers(1, 4))))
        elif kind == "comments":
            item = lambda: self.pick(f"<li><p>{m(3, 60)}</p></li>", f'<div class="comment"><p>{m(3, 60)}</p><p>{m(3, 40)}</p></div>', f"<p>{m(3, 60)}</p>", f"<article><header>{m(1, 3)}</header><p>{m(3, 50)}</p></article>")
            body = self.pick("", f"<h2>{m(1, 3)}</h2>", f"<h3>{m(1, 3)}</h3>") + "".join(item() for _ in range(n))
        elif kind == "header":
            body = self.pick(m(1, 12), f"<h1>{m(1, 6)}</h1>", f"<p>{m(2, 12)}</p>", f"<div>{m(1, 6)}</div><p>{m(2, 10)}</p>")
        elif kind == "aside":
            body = "".join(self.pick(f"<h3>{m(1, 4)}</h3>", f"<p>{m(3, 40)}</p>", f'<ul><li><a href="#">{m(2, 8)}</a></li></ul>', m(2, 30)) for _ in range(int(r.integers(1, 5))))
        else:
            start = self.pick("", "&copy; ", "&middot; ") if kind == "footer" else ""
            body = "".join(self.pick(self.marked(False, start + self.text(2, 40)), f"<p>{m(2, 40)}</p>") for _ in range(int(r.integers(1, 3))))
        return f"<{tag}{attrs}>{body}</{tag}>"

    def article(self) -> str:
        r = self.r
        m = lambda a, b: self.marked(True, self.text(a, b))
        out = [f"<h1>{m(2, 12)}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.3:
            out.append(f"<p><b>{m(3, 20)}<br>")
        for _ in range(int(r.integers(1, 12))):
            out.append(
                self.pick(
                    *[f"<p>{m(1, 90)}</p>"] * 4, f"<p>{m(90, 400)}</p>", f"<p>{m(1, 3)}</p>", f"<p>{m(4, 60)}", f"<h2>{m(1, 8)}</h2>", f"<h3>{m(1, 6)}</h3>", f"<blockquote><p>{m(4, 40)}</p></blockquote>", f"<blockquote>{m(4, 40)}</blockquote>",
                    f"<ul><li>{m(1, 20)}</li><li>{m(1, 20)}</li></ul>", f"<ol><li>{m(1, 20)}</li><li>{m(1, 20)}</li></ol>", f"<pre>{m(3, 30)}</pre>", f"<table><tr><td>{m(1, 5)}</td><td>{m(1, 5)}</td></tr></table>",
                    f"<figure><figcaption>{m(3, 15)}</figcaption></figure>", f"<div>{m(4, 60)}</div>", f"<div><p>{m(4, 60)}</p></div>", f"<section><p>{m(4, 60)}</p></section>",
                )
            )
            if r.random() < 0.06:
                out.append(self.part(self.pick("ad", "ad", "form", "aside", "notice")))
        body = "".join(out)
        return self.pick(*[f"<article>{body}</article>"] * 3, f"<article{self.names(MAIN_NAMES)}>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="{self.pick(*MAIN_NAMES)}">{body}</div>', f'<div id="{self.pick(*MAIN_NAMES)}"><div{self.names(MAIN_NAMES)}>{body}</div></div>')

    def page(self) -> str:
        r = self.r
        some = lambda p, *kinds: "".join(self.part(k) for k in kinds if r.random() < p)
        before = some(0.5, "header", "nav", "notice", "ad", "aside")
        after = some(0.45, "aside", "ad", "form", "comments", "footer", "notice")
        middle = self.article()
        if r.random() < 0.35:
            middle = f"<div{self.names(MAIN_NAMES)}>{some(0.3, 'nav', 'ad', 'header')}{middle}{some(0.3, 'aside', 'comments', 'form')}</div>"
        return f"<html><head><title>{self.marked(False, self.text(2, 12))}</title></head><body>{before}{middle}{after}</body></html>"


def labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    page = blocks(html)
    y = np.array([b[0].startswith(MAIN) for b in page], np.float32)
    return vectors([(b[0].replace(MAIN, "").replace(OTHER, "") or "-", b[1], b[2]) for b in page]), y


@lru_cache(4)
def trained(pages: int = 1600, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
    made = Pages(seed)
    rows = sorted((labelled(made.page()) for _ in range(pages)), key=lambda r: len(r[1]))
    net, r = Network(), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    starts = np.arange(0, len(rows), batch)
    for epoch in range(epochs):
        for at in r.permutation(starts):
            part = rows[at : at + batch]
            x, mask = padded([a for a, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, own) in enumerate(part):
                y[k, : len(own)] = own
            # some path and word features are hidden at random, so that context is read too
            x[:, :, :PATH_DIM] *= r.random(PATH_DIM) > 0.03
            x[:, :, PATH_DIM:-MEASURES] *= r.random(WORD_DIM) > 0.5
            g, step = net.backward(x, mask, y, 1.0), step + 1
            for k, x_ in net.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                x_ -= np.float32(rate * 0.6**epoch) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def main_text(page: list, prob: np.ndarray) -> str:
    return "\n".join(b[0] for b, p in zip(page, prob, strict=True) if p >= 0.5)


TEXTS = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame, network: Network | None = None) -> DataFrame:
    """page_id, url, text and its number of characters for every row of ``pages``."""
    held = pages.sparkSession.sparkContext.broadcast((network or trained()).p)  # a fixed number of weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def task(batches):
        net = Network()
        net.p = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                parsed = [blocks(h) for h in part.column(2).to_pylist()]
                texts = [main_text(b, p) for b, p in zip(parsed, net.labels(parsed), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(task, TEXTS)
