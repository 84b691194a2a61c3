"""Operator 12: exact top-k search by inner product with a bit-sliced index.

The index holds blocks of rows. Inside a block every component is quantised to six bits, and bit j of component
d of all rows is one bitmap, a slice. For a query the slices are added up with weights: the query's components,
quantised to five bits and a sign, say which slice is added at which place (a negative weight adds the slice's
complement), and carry-save adders over whole bitmaps leave the sum of every row as slices of its bits. From the
most significant slice downward the k-th greatest sum of the block is found by counting bits; rows whose sum is
below it by more than twice the quantisation error can't be among the k, nor rows that can't reach the k-th exact
score that the task has found so far. The rest, the boundary, is resolved by exact inner products of integers.

The index is built where the rows lie, without a shuffle, and stored in the shared folder. Queries go in blocks of
at most QUERY_BLOCK rows, which is what a task gets to hold: every block of queries is a pass over the index, in
which a task keeps k rows per query, and only those are shuffled.

Edge cases: rows without an id, without a vector, or with a null or non-finite component take no part; a shorter
vector counts as filled up with 0, an empty one as all 0; rows that share the query's id are its own and no
candidates; repeated candidates each take a place; a repeated query row gives its rows again; an empty table gives
an empty result; other columns are ignored. Integer components are held inside 2**24 either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import in_arrow, scratch, stored
from .vectors import integers, matrix

K = 5
EVERY = 50
#: Rows of the index in a block, and bits of a quantised component and of a quantised weight.
BLOCK, BITS, WEIGHT_BITS = 16_384, 6, 5
#: Most queries that a pass over the index serves; a task holds their vectors and k results of each.
QUERY_BLOCK = 16_384

INDEX = "dims int, ids binary, vectors binary, lows binary, steps binary, planes binary"
FOUND = "q int, vec_id bigint, score bigint"


class Block:
    """Rows of the index: ids in order, integer vectors, and bit slices of their quantised components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lows: np.ndarray, steps: np.ndarray, planes: np.ndarray):
        self.ids, self.vectors, self.lows, self.steps = ids, vectors, lows, steps
        words = (len(ids) + 63) // 64
        planes = planes.reshape(-1, words)
        self.planes = np.concatenate([planes, ~planes])
        self.valid = np.packbits(np.arange(64 * words) < len(ids), bitorder="little").view(np.uint64)
        # what quantising loses: the distance from a step's middle, and how far quantised values are from theirs
        levels = self.quantised(vectors, lows, steps)
        rest = vectors - lows - steps * levels - (steps - 1) / 2
        self.lost = float(np.sqrt((rest**2).sum(1).max(initial=0)))
        self.reach = float(np.sqrt(((levels - self.middle) ** 2).sum(1).max(initial=0)))

    middle = (2**BITS - 1) / 2

    @staticmethod
    def quantised(vectors: np.ndarray, lows: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return (vectors - lows) // steps

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Block:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        lows = vectors.min(0)
        steps = (vectors.max(0) - lows) // 2**BITS + 1
        levels = cls.quantised(vectors, lows, steps)
        words = (len(ids) + 63) // 64
        planes = np.zeros((vectors.shape[1] * BITS, 64 * words // 8), np.uint8)
        for j in range(BITS):
            bits = np.packbits(((levels >> j) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            planes[j::BITS, : bits.shape[1]] = bits
        return cls(ids, vectors, lows, steps, planes.view(np.uint64))

    def row(self) -> list[bytes]:
        half = len(self.planes) // 2
        return [x.tobytes() for x in (self.ids, self.vectors.astype(np.int32), self.lows, self.steps, self.planes[:half])]

    @classmethod
    def read(cls, dims: int, *columns: bytes) -> Block:
        ids, vectors, lows, steps, planes = (np.frombuffer(c, t) for c, t in zip(columns, (np.int64, np.int32, np.int64, np.int64, np.uint64), strict=True))
        return cls(ids, vectors.reshape(len(ids), dims).astype(np.int64), lows, steps, planes)

    def weights(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quantised weights of the slices per query, the unit of their sums, and the largest error of a sum, in units."""
        exact = queries * self.steps.astype(np.float64)
        unit = np.maximum(np.abs(exact).max(1, initial=0), 1e-9) / (2**WEIGHT_BITS - 1)
        weights = np.rint(exact / unit[:, None]).astype(np.int64)
        error = np.sqrt(((exact - unit[:, None] * weights) ** 2).sum(1)) * self.reach + np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * self.lost
        return weights, unit, error / unit * (1 + 1e-9) + 1e-6

    def zero(self, queries: np.ndarray, weights: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The score that belongs to a sum of 0, per query: what lows, middles and complements add."""
        base = queries.astype(np.float64) @ (self.lows + (self.steps - 1) / 2) + (queries * self.steps.astype(np.float64) - unit[:, None] * weights).sum(1) * self.middle
        return base - unit * np.where(weights < 0, -weights, 0).sum(1) * (2**BITS - 1)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """The slices, least significant first, of the weighted sum of every row's quantised components."""
        size, half = np.abs(weights), len(self.planes) // 2
        at = np.arange(len(weights)) * BITS + np.where(weights < 0, half, 0)
        places: list[list[np.ndarray]] = [[] for _ in range(WEIGHT_BITS + BITS + len(weights).bit_length())]
        for p in range(WEIGHT_BITS):
            found = at[(size >> p) & 1 == 1]
            for j in range(BITS) if len(found) else ():
                places[p + j].append(found + j)
        out, carried = [], []
        for wanted in places:
            layers = [self.planes[np.concatenate(wanted)], *carried] if wanted else carried
            if not layers:
                out.append(np.zeros(len(self.valid), np.uint64))
                continue
            now, carried = np.concatenate(layers), []
            while len(now) > 2:  # three bitmaps of one place make one of it and one of the next
                n = len(now) // 3
                a, b, c = now[:n], now[n : 2 * n], now[2 * n : 3 * n]
                half_sum = a ^ b
                carried.append((a & b) | (half_sum & c))
                now = np.concatenate([half_sum ^ c, now[3 * n :]])
            if len(now) == 2:
                carried.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
            out.append(now[0])
        return out

    def at_least(self, slices: list[np.ndarray], k: int, rows: np.ndarray, slack: float, floor: float) -> np.ndarray:
        """The rows of a bitmap whose sum is no more than slack below the k-th greatest, nor below floor."""
        kth, above, equal = 0, 0, rows
        for s in range(len(slices) - 1, -1, -1):
            ones = equal & slices[s]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                kth, equal = kth | 1 << s, ones
            else:
                above, equal = above + n, equal & ~slices[s]
        least = max(0, int(np.floor(max(kth - slack, min(floor, 2.0**62)))))
        if least >> len(slices):
            return np.zeros(0, np.int64)
        more, equal = np.zeros_like(rows), rows
        for s in range(len(slices) - 1, -1, -1):
            if least >> s & 1:
                equal = equal & slices[s]
            else:
                more |= equal & slices[s]
                equal = equal & ~slices[s]
        return np.flatnonzero(np.unpackbits((more | equal).view(np.uint8), bitorder="little"))

    def search(self, ids: np.ndarray, queries: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Merges the block's rows into the best (score, id) of each query."""
        width = self.vectors.shape[1]
        queries = queries[:, :width] if queries.shape[1] >= width else np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        weights, unit, error = self.weights(queries)
        zero = self.zero(queries, weights, unit)
        first, last = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, "right")
        for q in range(len(ids)):
            rows = self.valid
            if last[q] > first[q]:
                own = np.zeros(64 * len(rows), np.uint8)
                own[first[q] : last[q]] = 1
                rows = rows & ~np.packbits(own, bitorder="little").view(np.uint64)
            scores, found = best[q]
            floor = (scores[-1] - zero[q]) / unit[q] - error[q] - 1 if len(scores) == k else -np.inf
            at = self.at_least(self.sums(weights[q]), k, rows, 2 * error[q] + 1, floor)
            if not len(at):
                continue
            scores = np.concatenate([scores, self.vectors[at] @ queries[q]])
            found = np.concatenate([found, self.ids[at]])
            order = np.lexsort((found, -scores))[:k]
            best[q] = scores[order], found[order]


def _build(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows as blocks of the index; the rows of a block need not come in one batch."""

    def emit(ids: list[np.ndarray], lengths: list[np.ndarray], flat: list[np.ndarray]) -> pa.RecordBatch:
        made = Block.of(np.concatenate(ids), matrix(np.concatenate(lengths), np.concatenate(flat)))
        return pa.RecordBatch.from_arrays([pa.array([made.vectors.shape[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in made.row())], ["dims", "ids", "vectors", "lows", "steps", "planes"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        n = 0
        for batch in batches:
            good, lengths, flat = integers(batch["embedding"])
            ids, starts, at = batch["vec_id"].to_numpy()[good], np.concatenate([[0], np.cumsum(lengths)]), 0
            while at < len(ids):
                end = min(len(ids), at + block - n)
                for x, part in zip(held, (ids[at:end], lengths[at:end], flat[starts[at] : starts[end]]), strict=True):
                    x.append(part)
                n, at = n + end - at, end
                if n == block:
                    yield emit(*held)
                    held, n = ([], [], []), 0
        if n:
            yield emit(*held)

    return build


def index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per block of at most `block` vectors of rows (vec_id, embedding), in a stored table."""
    return stored(in_arrow(_named(rows), _build(block), INDEX))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())


def _integer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, lengths, flat = integers(batch["embedding"])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(batch["vec_id"].to_numpy()[good]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], ["vec_id", "vector"])


def _searcher(ids: np.ndarray, queries: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(ids)
        for batch in batches:
            for row in zip(*(batch[c] for c in ("dims", "ids", "vectors", "lows", "steps", "planes")), strict=True):
                Block.read(row[0].as_py(), *(x.as_buffer() for x in row[1:])).search(ids, queries, best, k)
        counts = [len(s) for s, _ in best]
        scores, found = (np.concatenate([none, *(b[i] for b in best)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int32), counts)), pa.array(found), pa.array(scores)], ["q", "vec_id", "score"])

    return search


def top_k(rows: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest inner product of each row that is_query holds for, ties to smaller ids.

    rows: vec_id, embedding.
    """
    spark = rows.sparkSession
    with scratch():
        blocks = index(rows, block)
        asked = stored(in_arrow(_named(rows).filter(is_query), _integer_rows, "vec_id bigint, vector array<int>"))
        passes = max(1, -(-asked.count() // query_block))
        asked = stored(asked.repartition(passes).withColumn("pass", F.spark_partition_id()))
        out = []
        for turn in range(passes):
            part = asked.filter(F.col("pass") == turn).select("vec_id", "vector").toArrow()  # query_block rows, give or take one per task
            ids = part["vec_id"].to_numpy()
            vector = part["vector"].combine_chunks()
            queries = matrix(np.asarray(vector.value_lengths(), np.int64), vector.flatten().to_numpy().astype(np.int64)) if len(ids) else np.zeros((0, 0), np.int64)
            found = in_arrow(blocks, _searcher(ids, queries, k), FOUND)
            rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")).alias("rank")
            found = found.select("q", rank, "vec_id", "score").filter(F.col("rank") <= k)
            names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids), dtype=np.int32)), "query_id": pa.array(ids, pa.int64())}))
            out.append(stored(found.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score"), lasting=True))
    return reduce(DataFrame.unionByName, out)


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
