"""Operator 7: main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, inline tags (formulas
and drawings among them) being part of them. Only what a browser never shows as text is left out by rule: the
contents of script, style, template, title, textarea and iframe elements, if they end, and comments; all else
is judged by the network. Each block is a vector of its hashed tag path (tags, classes, ids and roles of all open elements, and
of the nearest one again), its hashed words and a few measures (length, share of links, digits, sentence
ends). A bidirectional LSTM in numpy reads the blocks of a whole page in both directions, so a block is judged
by all of the page, and those labelled main are joined in page order. The network is trained on the driver,
on TRAINING_PAGES generated pages of many layouts whose blocks are labelled; no row of the corpus is used.

Edge cases: a null or empty page, or one without text, gives an empty text; pages of any length are read whole;
broken markup is read as far as it goes (open elements end with the page, ends without a start are skipped, and
a script or another raw element without an end hides nothing behind its start tag); a block at a probability
of exactly one half is main text; repeated rows give equal rows, also under one page_id; an empty table gives
an empty result; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textops import Words, in_arrow, span_hashes

TRAINING_PAGES = 700
EPOCHS = 8
BUCKETS = 4096
EMBEDDING = 8
HIDDEN = 12
MEASURES = 7
INPUT = 2 * EMBEDDING + MEASURES
#: Pages and blocks that go through the network together.
TOGETHER, TOGETHER_BLOCKS = 64, 20_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mtable mtr mtd semantics annotation "
    "svg g path circle rect line polyline polygon ellipse text tspan defs use lineargradient stop".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
#: A start tag of the key ends an open element of these, if it is the innermost.
ENDS = {"li": ("li", "p"), "option": ("option",), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}

_ids: dict[str, int] = {}


def _id(name: str) -> int:
    if len(_ids) > 100_000:
        _ids.clear()
    k = _ids.get(name)
    if k is None:
        k = _ids[name] = crc32(name.encode()) % BUCKETS
    return k


class Block:
    __slots__ = ("text", "path", "links", "tag")

    def __init__(self, text: str, path: tuple[int, ...], links: int, tag: str):
        self.text, self.path, self.links, self.tag = text, path, links, tag


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    # (tag, features of all open elements, features of this one)
    stack: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = [("", (), ())]
    parts: list[str] = []
    link_open, links, at, n = False, 0, 0, len(html)

    def flush() -> None:
        nonlocal links
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                tag, every, own = stack[-1]
                out.append(Block(text, every + own, min(links, len(text)), tag))
            parts.clear()
        links = 0

    while at < n:
        m = TAG.search(html, at)
        while m is not None and m.start() == m.end():
            m = TAG.search(html, m.end() + 1)
        end = m.start() if m else n
        if end > at:
            parts.append(html[at:end])
            if link_open:
                links += end - at
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                link_open = not closing
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW and not closing:
            over = None if rest.endswith("/") else _RAW_END[tag].search(html, at)
            if over:
                at = over.end()
            if tag != "title":
                parts.append(" ")
            continue
        flush()
        link_open = False
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID or rest.endswith("/"):
            continue
        for old in ENDS.get(tag, ("p",)):
            if stack[-1][0] == old:
                stack.pop()
        names = [tag]
        for a in ATTRIBUTE.findall(rest) if "=" in rest else ():
            names += TOKEN.findall((a[0] or a[1] or a[2]).lower())
        every = stack[-1][1]
        new = tuple(k for k in dict.fromkeys(_id("in " + x) for x in names) if k not in every)
        stack.append((tag, every + new, tuple(_id("at " + x) for x in dict.fromkeys(names))))
    flush()
    return out


def measures(page: list[Block]) -> np.ndarray:
    out = np.empty((len(page), MEASURES), np.float32)
    for k, b in enumerate(page):
        n = len(b.text)
        words = b.text.count(" ") + 1
        out[k] = (np.log1p(n) / 5, np.log1p(words) / 4, b.links / n, b.text[-1] in ".!?:\"')", min(1, (b.text.count(".") + b.text.count(",")) / words), b.tag in ("h1", "h2", "h3"), k / len(page))
    return out


def word_buckets(page: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of the blocks, and the number of them in each block."""
    data = [b.text.encode("utf-8", "replace") for b in page]
    w = Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64), lower=True)
    return (span_hashes(w.data, w.starts, w.ends) % np.uint64(BUCKETS)).astype(np.int64), w.counts


class Features:
    """The inputs of some pages: the pages' blocks one after the other."""

    def __init__(self, pages: list[list[Block]]):
        every = [b for p in pages for b in p]
        self.lengths = np.array([len(p) for p in pages])
        self.paths = np.array([k for b in every for k in b.path], np.int64)
        self.path_counts = np.array([len(b.path) for b in every], np.int64)
        self.words, self.word_counts = word_buckets(every)
        self.measures = np.concatenate([measures(p) for p in pages]) if every else np.zeros((0, MEASURES), np.float32)


def _means(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        first = np.cumsum(counts) - counts
        out[full] = np.add.reduceat(table[ids], first[full], axis=0) / counts[full, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.values = {"paths": f(BUCKETS, EMBEDDING, scale=0.3), "words": f(BUCKETS, EMBEDDING, scale=0.1), "out": f(2 * HIDDEN + INPUT, scale=0.2), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.values |= {f"x{d}": f(INPUT, 4 * HIDDEN, scale=0.25), f"h{d}": f(HIDDEN, 4 * HIDDEN, scale=0.2), f"c{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def inputs(self, x: Features) -> np.ndarray:
        v = self.values
        return np.concatenate([3 * _means(v["paths"], x.paths, x.path_counts), 3 * _means(v["words"], x.words, x.word_counts), x.measures], axis=1)

    def direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (page, block, HIDDEN) of one direction; x and mask are padded at the end."""
        v, n = self.values, HIDDEN
        px = x @ v[f"x{d}"] + v[f"c{d}"]
        h = c = np.zeros((len(x), n), np.float32)
        out, tape = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            g = px[:, t] + h @ v[f"h{d}"]
            s, u = _sigmoid(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            m = mask[:, t, None]
            cn = f * c + i * u
            tc = np.tanh(cn)
            if keep:
                tape.append((t, h, c, i, f, o, u, tc, m))
            c, h = np.where(m, cn, c), np.where(m, o * tc, h)
            out[:, t] = h
        return out, tape

    def back(self, d: str, tape: list, slope: np.ndarray, x: np.ndarray, grads: dict) -> np.ndarray:
        v, n = self.values, HIDDEN
        dg = np.zeros((*x.shape[:2], 4 * n), np.float32)
        dh = dc = np.zeros((len(x), n), np.float32)
        gh = np.zeros_like(v[f"h{d}"])
        for t, h, c, i, f, o, u, tc, m in reversed(tape):
            dh = dh + slope[:, t]
            own = np.where(m, dh, 0)
            dcn = np.where(m, dc, 0) + own * o * (1 - tc * tc)
            g = np.concatenate([dcn * u * i * (1 - i), dcn * c * f * (1 - f), own * tc * o * (1 - o), dcn * i * (1 - u * u)], axis=1)
            dg[:, t] = g
            gh += h.T @ g
            dh = np.where(m, 0, dh) + g @ v[f"h{d}"].T
            dc = np.where(m, dcn * f, dc)
        grads[f"h{d}"] = gh
        grads[f"x{d}"] = np.tensordot(x, dg, ([0, 1], [0, 1]))
        grads[f"c{d}"] = dg.sum((0, 1))
        return dg @ v[f"x{d}"].T

    def pad(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.arange(lengths.max())[None] < lengths[:, None]
        out = np.zeros((*mask.shape, *flat.shape[1:]), np.float32)
        out[mask] = flat
        return out, mask

    def probabilities(self, x: Features) -> np.ndarray:
        flat = self.inputs(x)
        if not len(flat):
            return np.zeros(0, np.float32)
        padded, mask = self.pad(flat, x.lengths)
        states = [self.direction(d, padded, mask, False)[0][mask] for d in "fb"]
        return _sigmoid(np.concatenate([*states, flat], axis=1) @ self.values["out"] + self.values["bias"])

    def gradients(self, x: Features, y: np.ndarray) -> dict:
        v, grads = self.values, {}
        flat = self.inputs(x)
        padded, mask = self.pad(flat, x.lengths)
        (hf, tf), (hb, tb) = (self.direction(d, padded, mask, True) for d in "fb")
        last = np.concatenate([hf[mask], hb[mask], flat], axis=1)
        slope = ((_sigmoid(last @ v["out"] + v["bias"]) - y) / len(y)).astype(np.float32)
        grads["out"], grads["bias"] = last.T @ slope, slope.sum(keepdims=True)
        down = slope[:, None] * v["out"]
        dx = down[:, 2 * HIDDEN :].copy()
        for d, k, tape in (("f", 0, tf), ("b", HIDDEN, tb)):
            own, _ = self.pad(down[:, k : k + HIDDEN], x.lengths)
            dx += self.back(d, tape, own, padded, grads)[mask]
        for name, k, ids, counts in (("paths", 0, x.paths, x.path_counts), ("words", EMBEDDING, x.words, x.word_counts)):
            g = np.zeros_like(v[name])
            np.add.at(g, ids, np.repeat(3 * dx[:, k : k + EMBEDDING] / np.maximum(counts, 1)[:, None], counts, axis=0))
            grads[name] = g
        return grads


#: Short texts that pages carry around their articles; they only feed the generated training pages.
PHRASES = (
    "We use cookies to improve your experience", "Accept all", "Subscribe to our newsletter", "Sign up", "Log in", "Your email address", "Search", "Share this", "Follow us", "Read more", "Related articles", "Most read",
    "Advertisement", "Sponsored", "Privacy policy", "Terms of use", "Contact", "About us", "All rights reserved", "Leave a reply", "Reply", "Comments", "Posted by", "Home", "Next", "Previous", "Tags", "Impressum", "Datenschutz",
    "Anmelden", "Suche", "Kommentare", "Wir verwenden Cookies", "Anzeige", "Mehr lesen", "Nous utilisons des cookies", "Se connecter", "Commentaires", "Publicité", "Mentions légales", "Utilizamos cookies", "Iniciar sesión", "Comentarios", "Publicidad", "Aviso legal",
)
_MAIN = ("<article>", "<article>", "<article>", "<main>", '<main id="content">', '<article class="post">', '<div class="article-body">', '<div id="content">', '<div class="entry-content">', '<section class="story">', '<div class="text">', "<main><article>", "<div><div>", "<table><tr><td>", "")
_SIDE = ("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="related">', '<section class="widget">', '<div class="right-column">', '<div class="teaser">')
_NOTICE = ('<div class="cookie-notice">', '<div id="banner" role="dialog">', '<div class="notice">', '<section class="consent">', '<div class="alert">', '<div class="modal">')
_AD = ('<div class="ad">', '<div class="ad">', '<div class="ads">', '<div id="ad-top">', '<div class="advert">', '<aside class="sponsored">', '<div class="promo">', '<section class="banner-ad">')
_COMMENTS = ('<section id="comments">', '<div class="comments">', '<section class="comment-list">', '<div id="disqus" class="thread">', '<ol class="commentlist">', '<div class="replies">')


def sample_page(r: random.Random) -> tuple[str, list[int]]:
    """A generated page and the label of each of its blocks: 1 main text, 0 not."""
    syllables = ["".join(r.choices("bcdfghklmnprstvwz", k=r.randint(0, 2))) + r.choice("aeiouéü") + r.choice(["n", "r", "s", "t", "l", "m", ""]) for _ in range(r.randint(15, 60))]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    noise = r.choice(["", "", "", "", "###", "&amp;", "$$"])

    def text(low: int, high: int) -> str:
        words = [word() + (noise if r.random() < 0.3 else "") for _ in range(r.randint(low, high))]
        k = 0
        while k < len(words):
            words[k] = words[k].capitalize()
            k += r.randint(4, 15)
            if k <= len(words):
                words[k - 1] += r.choice([".", ".", ".", ","])
        return " ".join(words) + r.choice([".", ".", ""])

    short = lambda: r.choice(PHRASES) if r.random() < 0.6 else text(1, 6)
    out: list[str] = []
    labels: list[int] = []

    def block(tag: str, body: str, label: int) -> None:
        end = "" if tag.startswith(("<p", "<li")) and r.random() < 0.15 else f"</{tag[1:].split()[0].rstrip('>')}>"
        out.append(f"{tag}{body}{end}")
        labels.append(label)

    def close(opening: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))

    def links(n: int) -> None:
        out.append("<ul>" if r.random() < 0.8 else '<ul class="menu">')
        for _ in range(n):
            block("<li>", f'<a href="/{word()}">{text(1, 2) if r.random() < 0.8 else short()}</a>', 0)
        out.append("</ul>")

    def aside(kinds: tuple[str, ...], low: int, high: int) -> None:
        opening = r.choice(kinds)
        if r.random() < 0.5:
            out.append(opening)
            labels.append(0)
            out.append(text(low, high) if r.random() < 0.7 else short())
        else:
            out.append(opening)
            for _ in range(r.randint(1, 4)):
                block(r.choice(["<p>", "<h3>", "<div>", "<p>"]), text(low, high) if r.random() < 0.7 else short(), 0)
            if r.random() < 0.3:
                links(r.randint(2, 5))
        out.append(close(opening))

    def form() -> None:
        out.append(r.choice(["<form>", '<form class="newsletter">', '<form id="search">']))
        block("<label>", short(), 0)
        out.append('<input type="text">')
        if r.random() < 0.3:
            choices()
        block("<button>", short(), 0)
        out.append("</form>")

    def fallback(label: int) -> None:
        """What stands in for something that a browser may not show."""
        tag = r.choice(["noscript", "object", "video", "audio", "canvas"])
        out.append(f"<{tag}>")
        if label:
            block("<p>", text(8, 60), 1)
        else:
            labels.append(0)
            out.append(r.choice(["Please enable JavaScript to view this page.", "Your browser does not support this.", short(), text(3, 12)]))
        out.append(f"</{tag}>")

    def choices() -> None:
        out.append('<select name="x">')
        for _ in range(r.randint(2, 6)):
            block("<option>", text(1, 3), 0)
        out.append("</select>")

    def paragraph(tag: str = "<p>") -> None:
        body = text(1, 3) if r.random() < 0.12 else text(5, 80)
        if r.random() < 0.3:
            body = f"<{(t := r.choice(['b', 'em', 'a']))}>{text(1, 6)}</{t}> {body}" if r.random() < 0.7 else f"<b>{body}<br>"
        if r.random() < 0.03:
            body += " <math><mi>x</mi><mo>=</mo><mn>2</mn></math> " + text(2, 9) if r.random() < 0.6 else " <svg><text>" + text(1, 3) + "</text></svg> " + text(2, 9)
        block(tag, body, 1)

    out.append(f"<!DOCTYPE html><html><head><title>{text(2, 8)}</title><script>var x='<p>';</script></head><body>")
    for part in r.sample(["nav", "header", "notice", "ad", "form", "crumbs"], r.randint(1, 5)):
        if part == "nav":
            out.append(opening := r.choice(["<nav>", "<nav>", '<div class="menu">', '<div id="navigation">']))
            links(r.randint(3, 9))
            out.append(close(opening))
        elif part == "header":
            out.append(opening := r.choice(["<header>", '<div id="header">', '<div class="masthead">']))
            block(r.choice(["<h1>", "<div>", "<p>"]), text(1, 4), 0)
            if r.random() < 0.5:
                links(r.randint(2, 6))
            out.append(close(opening))
        elif part == "crumbs":
            block(r.choice(['<div class="breadcrumb">', '<p class="breadcrumbs">']), f'<a href="/">{short()}</a> &gt; <a href="/x">{short()}</a>', 0)
        elif part == "form":
            form()
        else:
            aside(_NOTICE if part == "notice" else _AD, 3, 25)
    if r.random() < 0.08:
        fallback(0)
    if r.random() < 0.05:
        choices()
    if r.random() < 0.15:
        aside(_SIDE, 5, 50)
    out.append(opening := r.choice(_MAIN))
    if r.random() < 0.85:
        block("<h1>", text(2, 12), 1)
    if r.random() < 0.2:
        block(r.choice(['<p class="byline">', '<div class="meta">', '<div class="author">']), short(), 0)
    style = r.choice(["<p>"] * 6 + ["<div>"])
    for _ in range(r.choice([1, 2, 4, 8, 15, 30])):
        x = r.random()
        if x < 0.06:
            block(r.choice(["<h2>", "<h3>"]), text(1, 8), 1)
        elif x < 0.09:
            out.append("<ul>")
            for _ in range(r.randint(2, 5)):
                block("<li>", text(2, 20), 1)
            out.append("</ul>")
        elif x < 0.11:
            block("<blockquote>", text(5, 40), 1)
        elif x < 0.13:
            aside(_AD, 3, 25)
        elif x < 0.14:
            block(r.choice(['<div class="share">', '<div class="social">']), short(), 0)
        elif x < 0.15:
            fallback(int(r.random() < 0.5))
        elif x < 0.165:
            block("<pre>", text(5, 40), 1)
        elif x < 0.18:
            out.append("<figure><img>")
            block("<figcaption>", text(2, 15), 1)
            out.append("</figure>")
        elif x < 0.195:
            out.append("<table>")
            for _ in range(r.randint(2, 4)):
                out.append("<tr>")
                for _ in range(r.randint(2, 3)):
                    block("<td>", text(1, 6), 1)
                out.append("</tr>")
            out.append("</table>")
        else:
            paragraph(style)
    out.append(close(opening))
    for part in r.sample(["comments", "side", "ad", "form", "related"], r.randint(0, 4)):
        if part == "comments":
            out.append(opening := r.choice(_COMMENTS))
            block("<h2>", short(), 0)
            for _ in range(r.randint(1, 6)):
                out.append(inner := r.choice(["<article>", '<div class="comment">', '<li class="comment">', "<div>"]))
                if r.random() < 0.5:
                    block("<div>", text(1, 3), 0)
                block("<p>", text(3, 60), 0)
                out.append(close(inner))
            out.append(close(opening))
        elif part == "related":
            out.append('<div class="related">')
            links(r.randint(2, 5))
            out.append("</div>")
        elif part == "form":
            form()
        else:
            aside(_SIDE if part == "side" else _AD, 3, 50)
    if r.random() < 0.9:
        out.append(opening := r.choice(["<footer>", "<footer>", '<div id="footer">', '<div class="footer">']))
        out.append(f"{r.choice(['&copy;', '&middot;', '', 'Copyright'])} {text(2, 12)}" if r.random() < 0.7 else short())
        labels.append(0)
        out.append(close(opening))
    if r.random() < 0.8:
        out.append("</body></html>")
    return "".join(out), labels


@cache
def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fits the network by Adam on generated pages, in batches of pages of like length."""
    r, rng = random.Random(seed), np.random.default_rng(seed)
    found = []
    for _ in range(pages):
        html, labels = sample_page(r)
        page = blocks(html)
        if len(page) == len(labels) and page:
            found.append((page, labels))
    found.sort(key=lambda p: len(p[0]))
    batches = [(Features([p for p, _ in part]), np.array([y for _, own in part for y in own], np.float32)) for part in (found[k : k + 16] for k in range(0, len(found), 16))]
    net = Network(seed)
    first = {k: np.zeros_like(v) for k, v in net.values.items()}
    second = {k: np.zeros_like(v) for k, v in net.values.items()}
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            step += 1
            rate = 0.02 * (1 - 0.9 * step / steps)
            for name, g in net.gradients(*batches[k]).items():
                g = g + 1e-5 * net.values[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                net.values[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label(htmls: list[str], net: Network) -> list[tuple[list[Block], np.ndarray]]:
    """The blocks of each page with the probability that each is main text."""
    pages = [blocks(h) for h in htmls]
    out: list = [(p, np.zeros(0, np.float32)) for p in pages]
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < TOGETHER and (end - at + 1) * len(pages[order[end]]) <= TOGETHER_BLOCKS:
            end += 1
        own = order[at:end]
        p = net.probabilities(Features([pages[k] for k in own]))
        cuts = np.cumsum([len(pages[k]) for k in own])[:-1]
        for k, part in zip(own, np.split(p, cuts), strict=True):
            out[k] = (pages[k], part)
        at = end
    return out


RESULT = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_main bigint"
BLOCKS = "page_id bigint, position int, tag string, text string, probability double"


def _extract(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = label([h.as_py() or "" for h in part["html"]], shared.value)
                texts = ["\n\n".join(b.text for b, x in zip(page, p, strict=True) if x >= 0.5) for page, p in found]
                counts = [[len(t) for t in texts], [len(page) for page, _ in found], [int((p >= 0.5).sum()) for _, p in found]]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def _blocks(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [(k, n, b.tag, b.text, float(x)) for k, (page, p) in zip(part["page_id"].to_pylist(), label([h.as_py() or "" for h in part["html"]], shared.value), strict=True) for n, (b, x) in enumerate(zip(page, p, strict=True))]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

    return run


def extract(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """Per row of pages: page_id, url, the main text, its length, and how many blocks the page has and kept."""
    shared = pages.sparkSession.sparkContext.broadcast(net or train())
    return in_arrow(pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html"), _extract(shared), RESULT)


def labelled_blocks(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """Every block of every page, with the probability that it is main text."""
    shared = pages.sparkSession.sparkContext.broadcast(net or train())
    return in_arrow(pages.selectExpr("cast(page_id as bigint) page_id", "cast(html as string) html"), _blocks(shared), BLOCKS)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
