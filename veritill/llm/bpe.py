"""Operator 6: byte-level BPE encoding and decoding with a segment tree.

A text is cut by the vocabulary's pattern; the bytes of each piece are merged pair by pair, lowest rank
first and leftmost among equals. A segment tree over the byte positions keeps, at its root, the smallest
(rank, position) of all live neighbouring pairs; a merge updates the pairs on either side of it, each in
logarithmic time, so a piece of n bytes takes O(n log n) however long it is. Pieces repeat, so each worker
remembers the ids of recent ones, in a memory of bounded size. The rank file is read on the driver, where
its path is a parameter, and broadcast: a vocabulary has a fixed size, whatever the input.

Edge cases: a null or empty text has no tokens; repeated rows give equal rows; an empty table gives an
empty result; columns other than doc_id and text are ignored. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .textops import documents, in_arrow

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces remembered by a worker in each of two generations; when the younger is full it replaces the older.
REMEMBERED = 300_000

RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The token of each rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [ranks[piece]]
    none = 1 << 62
    ends = list(range(1, n + 1))  # of the live part that starts here
    left = list(range(-1, n - 1))  # the live part before
    half = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * half)
    find = ranks.get
    for i in range(n - 1):
        r = find(piece[i : i + 2])
        if r is not None:
            tree[half + i] = r * n + i
    for k in range(half - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, key: int) -> None:
        k = half + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] < none:
        i = tree[1] % n
        j = ends[i]
        end = ends[i] = ends[j]
        if end < n:
            left[end] = i
            r = find(piece[i : ends[end]])
            put(i, none if r is None else r * n + i)
            if j < n - 1:
                put(j, none)
        else:
            put(i, none)
            if j < n - 1:
                put(j, none)
        before = left[i]
        if before >= 0:
            r = find(piece[before:end])
            put(before, none if r is None else r * n + before)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Encoder:
    """Encodes and decodes with the tokens of a vocabulary, given by rank."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {t: r for r, t in enumerate(tokens) if t}
        self.pieces = regex.compile(pattern).findall
        outer = self

        older: dict[str, bytes] = {}

        class Memory(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = older.get(piece)
                if ids is None:
                    found = merge(piece.encode(), outer.ranks)
                    ids = pack(f"<{len(found)}I", *found)
                if len(piece) <= 64:
                    if len(self) >= REMEMBERED:
                        older.clear()
                        older.update(self)
                        self.clear()
                    self[piece] = ids
                return ids

        self.memory = Memory()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memory.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(tokens: list[bytes], pattern: str) -> Encoder:
    """One per worker and vocabulary."""
    key = (hash(tuple(tokens)), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(tokens, pattern)
    return _encoders[key]


def _digest(shared, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch["text"]:
                ids = own.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(shared, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(own.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    return spark.sparkContext.broadcast(read_ranks(path)), pattern


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) per row: the token ids of each text by the rank file at `path`."""
    shared = _vocabulary(docs.sparkSession, path, pattern)
    return in_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), _ids(*shared), "doc_id bigint, ids array<int>")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: each text is encoded, and decoded from its ids."""
    shared = _vocabulary(docs.sparkSession, path, pattern)
    return in_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), _digest(*shared), RESULT)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: token count and digests of each document."""
    return digests(docs)
