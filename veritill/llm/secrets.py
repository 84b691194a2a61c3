"""Operator 5: secret scans by patterns and a character convolutional network.

Three fixed patterns give the base spans. Besides them, every run of 16 or more key characters that isn't inside
a base span is a candidate, also one without a digit or one that a base span covers in part; a small
convolutional network in numpy reads all of it with the 24 characters on either side (longer candidates in
overlapping windows, the highest score counting), and those at or above the threshold of their shape are added
as kind `learned`. The network is trained on the driver, on generated labelled findings and look-alikes, every
window of them: their number is the bound TRAINING_ROWS, and no corpus row is used. Scores are calibrated by a
logistic fit on findings that weren't trained on, and each shape's threshold is the highest one that keeps
RECALL of its labelled secrets. Keys of lower-case letters alone can't be told from words and aren't among them.

Edge cases: a null or empty text has no spans; texts of any length are scanned whole; of overlapping spans all
are reported, and masking replaces them as one; repeated rows give equal rows, and several texts under one id
are scanned apart; an empty table gives an empty result; columns other than doc_id and text are ignored by
`find` and passed on by the stage; offsets are code points of the whole text.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textops import documents, in_arrow

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
KINDS = ("assign", "access", "hex", "learned")

CONTEXT, INNER = 24, 48
LENGTH = INNER + 2 * CONTEXT
TRAINING_ROWS = 10_000
EPOCHS = 6
RECALL = 0.97
FILTERS, WIDTH, EMBEDDING = 24, 5, 12
SYMBOLS = 98  # 0 beyond the text, 1 any other character, 2.. printable ASCII

_CODE = np.ones(0x110000, np.uint8)
_CODE[32:127] = np.arange(2, 97)
_CODE[[9, 10, 13]] = 97

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs of key characters that aren't inside one of the spans found so far, which come in order."""
    starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_right(starts, a)
        if not k or reach[k - 1] < b:
            out.append((a, b))
    return out


def windows(text: str, a: int, b: int) -> list[tuple[str, int, int, int]]:
    """The candidate in windows: their text, and where in the input they begin and the candidate starts and ends."""
    out = []
    for s in range(a, b, INNER // 2):
        e = min(b, s + INNER)
        left = max(0, s - CONTEXT)
        out.append((text[left : e + CONTEXT], CONTEXT - (s - left), CONTEXT, CONTEXT + e - s))
        if e == b:
            break
    return out


def encode(parts: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each window, and a mask of the candidate's own characters."""
    x = np.zeros((len(parts), LENGTH), np.uint8)
    inside = np.zeros((len(parts), LENGTH), bool)
    for k, (text, at, a, b) in enumerate(parts):
        x[k, at : at + len(text)] = _CODE[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        inside[k, a:b] = True
    return x, inside


def shape(candidate: str) -> int:
    """0: hexadecimal digits only, 1: one case of letters, 2: mixed."""
    if all(c in "0123456789abcdefABCDEF-" for c in candidate):
        return 0
    return 1 if candidate == candidate.lower() or candidate == candidate.upper() else 2


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray  # (WIDTH * EMBEDDING, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (3 * FILTERS,): the most and the mean inside the candidate, then the most around it
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (0.5, 0.5, 0.5)

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.embedding[x]
        cut = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, WIDTH * EMBEDDING)
        return cut, np.maximum(cut @ self.filters + self.bias, 0)

    def pooled(self, h: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = inside[:, WIDTH // 2 : LENGTH - WIDTH // 2, None]
        share = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        own, around = np.where(m, h, 0), np.where(m, 0, h)
        ia, ib = own.argmax(axis=1), around.argmax(axis=1)
        p = np.concatenate([np.take_along_axis(own, ia[:, None], 1)[:, 0], (h * share).sum(axis=1), np.take_along_axis(around, ib[:, None], 1)[:, 0]], axis=1)
        return p, ia, ib, share

    def logits(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(self.hidden(x[k : k + 512])[1], inside[k : k + 512])[0] @ self.dense + self.offset for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))


def labelled_findings(n: int, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """Generated (text, start, end, secret 0/1): keys of several issuers in code, settings and prose, and look-alikes."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    onsets = "b c d f g h k l m n p r s t v w z br ch cl dr fl gr pl pr qu sc sch sh sp st th tr wh".split()
    codas = "n r s t l m d ch nd ng ns nt rs st th x ck tz".split()
    spoken: list[str] = []

    def language() -> None:
        """Other syllables for the findings to come, so that no words are learned by heart."""
        vowels = r.choices(["a", "e", "i", "o", "u", "ei", "ie", "ou", "au", "y", "ea", "io"], k=6)
        spoken[:] = [(r.choice(onsets) if r.random() < 0.75 else "") + r.choice(vowels) + (r.choice(codas) if r.random() < 0.6 else "") for _ in range(r.randint(12, 50))]

    plain_word = lambda: "".join(r.choices(spoken, k=r.randint(1, 4)))
    word = lambda: plain_word() if r.random() < 0.8 else plain_word() + r.choice("äéèàôüß") + r.choice(spoken)
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    alnum, small, large = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits
    # by shape: hexadecimal, one case, mixed
    secret = [
        [lambda: pick("0123456789abcdef", r.randint(16, 31)), lambda: pick("0123456789ABCDEF", r.randint(16, 64))],
        [lambda: pick(small, r.randint(16, 48)), lambda: pick(large, r.randint(16, 40)), lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r.choice([16, 26, 32, 52])), lambda: pick(string.ascii_uppercase, r.randint(20, 40)), lambda: pick(small, 3) + r.choice("-_") + pick(small, r.randint(16, 40))],
        [
            lambda: pick(alnum, r.randint(16, 48)),
            lambda: pick(string.ascii_letters, r.randint(16, 40)),
            lambda: pick(alnum + "+/", r.choice([24, 32, 40, 44, 64, 88])) + r.choice(["", "=", "=="]),
            lambda: r.choice(["ghp_", "gho_", "sk_live_", "rk_test_", "xoxb-", "AIza", "glpat-", "npm_", "SG."]) + pick(alnum, r.randint(20, 40)),
            lambda: "eyJ" + pick(alnum, r.randint(20, 90)) + "." + pick(alnum + "_-", r.choice([43, 86])),
        ],
    ]
    end = lambda: r.choice(["", "", ".", ".", "=", "-", "..", "/"])
    plain = [
        lambda: "/".join([*(plain_word() for _ in range(r.randint(3, 9))), str(r.randint(1, 999))]),
        lambda: "-".join([plain_word(), plain_word(), str(r.randint(1900, 2030)), plain_word()]),
        lambda: ".".join([plain_word(), plain_word(), plain_word(), str(r.randint(0, 99))]),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(10, 59)}.{r.randint(10, 59)}",
        lambda: "".join(plain_word().capitalize() for _ in range(4)) + r.choice(["", str(r.randint(0, 99))]),
        lambda: pick(string.digits, r.randint(16, 30)),
        lambda: "_".join(plain_word() for _ in range(r.randint(3, 7))) + r.choice(["", f"_{r.randint(0, 9)}"]),
        lambda: "_".join(plain_word() for _ in range(4)).upper(),
        lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: plain_word() * r.randint(3, 6) + r.choice(["", str(r.randint(0, 9))]),
        lambda: "".join(plain_word() for _ in range(r.randint(3, 7))) + end(),
        lambda: "".join(plain_word() for _ in range(r.randint(3, 7))) + end(),
        lambda: "".join(plain_word() for _ in range(r.randint(3, 7))).capitalize() + end(),
        lambda: "".join(plain_word() for _ in range(r.randint(3, 7))).upper() + end(),
        lambda: f"{plain_word()}{r.randint(0, 99)}.{plain_word()}{r.choice(['.com', '.org', '.example.com', '.co.uk', '.net'])}",
        lambda: r.choice("=-._/") * r.randint(16, 80),
        lambda: r.choice(string.ascii_letters + string.digits) * r.randint(16, 60),
        lambda: f"//www.{plain_word()}.{r.choice(['com', 'org', 'de'])}/" + "/".join(plain_word() for _ in range(r.randint(1, 6))) + r.choice(["", ".html", "/index.php"]),
    ]
    hint = [lambda: f'{plain_word()}_key = "', lambda: "Authorization: Bearer ", lambda: "credential: ", lambda: f"{word()} key ", lambda: f"export {plain_word().upper()}_KEY=", lambda: f"{prose()} ", lambda: f"{prose()} = '", lambda: f"{prose()} "]
    other = [lambda: f"{prose()} ", lambda: f"see {word()} ", lambda: '<a href="', lambda: "version: ", lambda: f"{word()} = ", lambda: "id ", lambda: f"{prose()}, ", lambda: f"{word()}@", lambda: "https:"]
    out = []
    for k in range(n):
        y = k % 2
        if k % 4 == 0:
            language()
        body = ""
        while not CANDIDATE.fullmatch(body):
            body = r.choice(r.choice(secret) if y else plain)()
        lead = (prose() + " " if r.random() < 0.5 else "") + r.choice(hint if y else other)()
        text = lead + body + r.choice(['"', "'", " ", "\n", "", " ", ", "]) + (prose() if r.random() < 0.6 else "")
        # the run as a scan would find it: it may take in key characters that stand before it
        a, b = next((m.span() for m in CANDIDATE.finditer(text) if m.end() > len(lead)), (len(lead), len(lead) + len(body)))
        out.append((text, a, b, y))
    return out


def _windows_of(found: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and masks of all windows of the findings, and the finding of each."""
    parts = [windows(t, a, b) for t, a, b, _ in found]
    return *encode([w for p in parts for w in p]), np.repeat(np.arange(len(found)), [len(p) for p in parts])


def probabilities(net: Network, found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """The score of each finding: its highest window."""
    x, inside, owner = _windows_of(found)
    out = np.zeros(len(found))
    np.maximum.at(out, owner, net.probabilities(net.logits(x, inside)))
    return out


@cache
def train(rows: int = TRAINING_ROWS, epochs: int = EPOCHS, recall: float = RECALL, seed: int = 5) -> Network:
    """Fits the network by Adam, calibrates it and sets its thresholds on a third of the findings, kept apart."""
    rng = np.random.default_rng(seed)
    found = labelled_findings(rows, seed)
    apart = [f for k, f in enumerate(found) if k % 6 < 2]
    learned = [f for k, f in enumerate(found) if k % 6 >= 2]
    x, inside, owner = _windows_of(learned)
    y = np.array([f[3] for f in learned], float)[owner]
    net = Network(rng.normal(0, 0.3, (SYMBOLS, EMBEDDING)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * EMBEDDING, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 3 * FILTERS), 0.0)
    names = ("embedding", "filters", "bias", "dense")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step, steps = 0, epochs * max(1, len(x) // 64)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            step += 1
            cut, h = net.hidden(x[at])
            p, ia, ib, share = net.pooled(h, inside[at])
            slope = (1 / (1 + np.exp(-np.clip(p @ net.dense + net.offset, -40, 40))) - y[at]) / len(at)
            dp = slope[:, None] * net.dense * (p > 0)
            dh = np.zeros(h.shape, np.float32)
            rows_at, columns = np.arange(len(at))[:, None], np.arange(FILTERS)[None]
            np.add.at(dh, (rows_at, ia, columns), dp[:, :FILTERS])
            np.add.at(dh, (rows_at, ib, columns), dp[:, 2 * FILTERS :])
            dh += dp[:, None, FILTERS : 2 * FILTERS] * share * (h > 0)
            dcut = dh @ net.filters.T
            symbols = np.lib.stride_tricks.sliding_window_view(x[at], WIDTH, axis=1).reshape(-1)
            dembedding = np.stack([np.bincount(symbols, v, SYMBOLS) for v in dcut.reshape(-1, EMBEDDING).T], axis=1)
            slopes = {"embedding": dembedding, "filters": np.tensordot(cut, dh, ([0, 1], [0, 1])), "bias": dh.sum((0, 1)), "dense": slope @ p}
            net.offset -= 0.05 * slope.sum()
            for k in names:
                g = slopes[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                getattr(net, k)[...] -= 0.005 * (1 - 0.8 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    x, inside, owner = _windows_of(apart)
    z = np.full(len(apart), -np.inf)
    np.maximum.at(z, owner, net.logits(x, inside))
    t = np.array([f[3] for f in apart], float)
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic calibration
        e = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - t
        a, b = a - 0.05 * (e * z).mean(), b - 0.05 * e.mean()
    net.scale = (float(a), float(b))
    p, shapes = net.probabilities(z), np.array([shape(text[i:j]) for text, i, j, _ in apart])
    # the highest threshold that keeps the recall; a shape without labelled secrets has that of all
    limits = []
    for k in range(3):
        own = np.sort(p[(shapes == k) & (t == 1)])
        own = own if len(own) else np.sort(p[t == 1])
        limits.append(float(own[int((1 - recall) * len(own))]) if len(own) else 1.0)
    net.thresholds = tuple(limits)
    return net


def scan(texts: list[str], net: Network) -> list[list[Span]]:
    """All spans of each text, by start and then kind."""
    spans = [base_spans(t) for t in texts]
    owners, parts = [], []
    for k, t in enumerate(texts):
        for a, b in candidates(t, spans[k]):
            for w in windows(t, a, b):
                owners.append((k, a, b))
                parts.append(w)
    best: dict[tuple[int, int, int], float] = {}
    for k in range(0, len(parts), 4096):
        for owner, p in zip(owners[k : k + 4096], net.probabilities(net.logits(*encode(parts[k : k + 4096]))), strict=True):
            best[owner] = max(best.get(owner, 0.0), float(p))
    for (k, a, b), p in best.items():
        if p >= net.thresholds[shape(texts[k][a:b])]:
            spans[k].append((a, 3, b))
    return [sorted(s) for s in spans]


def joined(spans: list[Span], kinds: int) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < kinds)


RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_learned bigint"


def _report(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = scan([t.as_py() or "" for t in part["text"]], shared.value)
                counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(4)]
                base = pa.array([hashlib.sha256(joined(s, 3).encode()).hexdigest() for s in found], pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], *counts[:3], base, pa.array([joined(s, 4) for s in found], pa.string()), counts[3]], [x.split()[0] for x in RESULT.split(", ")])

    return run


def find(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Per row of docs: counts of each kind, the digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(net or train())
    return in_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), _report(shared), RESULT)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, and spans that overlap as one, replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part["text"].to_pylist()
                found = scan([t or "" for t in texts], shared.value)
                clean = pa.array([masked(t, s) if t and s else t for t, s in zip(texts, found, strict=True)], part.schema.field("text").type)
                yield part.set_column(part.schema.get_field_index("text"), "text", clean)

    return run


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row of docs, its secrets masked."""
    return in_arrow(docs, _mask(spark.sparkContext.broadcast(train())), docs.schema)
