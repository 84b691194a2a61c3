"""Helpers shared by the operators of this subpackage: word and line views over Arrow text, tables in the shared folder.

Texts are handled as the UTF-8 bytes that Arrow delivers, in slices of bounded size, so that no Python
object is made per word and a task's memory does not follow the size of its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritill.sources.shipping import ship
from veritill.sources.storage import _paths, checkpoint_dir, release, scratch, stored  # noqa: F401  the operators and the pipeline take them from here

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 4096)
        one = np.ones(1, np.uint64)
        _powers[:] = [np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum over all of them."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets of its rows in them; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words (runs of bytes other than blank, \\t, \\n, \\v, \\f, \\r) of some rows of a text column."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.base = int(offsets[0])
        self.offsets = offsets - self.base
        self.data = data[self.base : int(offsets[-1])]
        if lower:
            self.data = LOWER[self.data]
        self.solid = ~SPACE[self.data]
        before = np.zeros(len(self.data) + 1, bool)
        before[1:] = self.solid
        before[self.offsets] = False  # a row's first byte follows nothing
        after = np.zeros(len(self.data) + 1, bool)
        after[: len(self.data)] = self.solid
        after[self.offsets] = False  # a row's last byte precedes nothing
        self.starts = np.flatnonzero(self.solid & ~before[:-1])
        self.ends = np.flatnonzero(self.solid & ~after[1:]) + 1
        #: the first word of each row, and the row of each word
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words that starts at a word, over the whole slice (callers cut at row ends)."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


def word_slices(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        yield i, j, Words(data, offsets[i : j + 1], lower)


def in_arrow(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow, the package's sources having gone to the executors before: a function takes their list when it is made."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


ROW_KEY = "struct<a:bigint,b:bigint>"


def row_key(df: DataFrame) -> Column:
    """A 128-bit key of a row's doc_id, source and text (null where df has no source): equal for repeated rows only, so verdicts are joined back by it."""
    parts = [F.col("doc_id").cast("bigint"), F.col("source").cast("string") if "source" in df.columns else F.lit(None).cast("string"), F.col("text").cast("string")]
    parts = [x for c in parts for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return [next(c for k in range(len(taken) + 1) if (c := f"veritill_{name}" + "_" * k) not in taken) for name in names]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)
