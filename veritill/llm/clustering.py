"""Operator 13: centroid clustering with Elkan's bounds.

Vectors become integers; centroids are integers too, so that distances, sums and means are exact. Every vector
carries an upper bound of the distance to its centroid and a lower bound of that to each centroid, in sixteenths,
upper bounds rounded up and lower ones down. After centroids move, bounds are widened by the distance moved; a
centroid is skipped if the upper bound is strictly below its lower bound or below half its distance from the
vector's centroid, so that a tie is always computed and goes to the smaller number. What isn't skipped gets its
exact squared distance.

Each round is one pass over the vectors and their bounds, stored in the shared folder: the tasks assign rows and
add one row of exact sums per cluster to the same table, so that only these few rows are shuffled, whatever the
sizes of clusters. Centroids (k x dimensions) are all that the driver holds; the table of the round before is
deleted.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out; fewer
vectors than k make fewer centroids, none an empty result; ties of the hash order (repeated ids) go by components;
a null id is hashed as an empty text; equal centroids give ties to the smaller number, and the others stay as they
are, without rows; other columns are ignored. Integer components are held inside 2**24 either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import in_arrow, release, scratch, stored
from .vectors import integers

K = 40
ROUNDS = 5
DIMENSIONS = 64
SEED = 2
#: Parts of a unit of distance in which bounds are kept.
PARTS = 16
#: Rows that are compared with all centroids at once.
ROWS = 4_096

STATE = "vec_id bigint, vector array<int>, cluster int, distance bigint, upper bigint, lower array<bigint>, sums array<bigint>, rows bigint"


def squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from a centroid, or from one each."""
    d = vectors - centroid
    return np.einsum("ij,ij->i", d, d)


def rounded_up(squared: np.ndarray) -> np.ndarray:
    """Bounds in parts that are no less than the root of exact squares."""
    return np.ceil(PARTS * np.sqrt(squared.astype(np.float64)) * (1 + 1e-12)).astype(np.int64)


def rounded_down(squared: np.ndarray) -> np.ndarray:
    return np.floor(PARTS * np.sqrt(squared.astype(np.float64)) * (1 - 1e-12)).astype(np.int64)


class Assigner:
    """Assigns vectors to centroids by their bounds; counts how many distances it computes."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None = None):
        self.centroids = centroids
        #: how far each centroid went since the bounds were made, rounded up
        self.moved = np.zeros(len(centroids), np.int64) if moved is None else moved
        apart = np.array([rounded_down(squares(centroids, c)) for c in centroids])
        self.half = apart // 2  # bounds below half the distance between two centroids rule the farther one out
        np.fill_diagonal(self.half, np.iinfo(np.int64).max)
        self.nearest = self.half.min(1, initial=np.iinfo(np.int64).max)
        self.computed = 0

    def start(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bounds of vectors without bounds: all distances."""
        squared = np.stack([squares(vectors, c) for c in self.centroids], 1)
        self.computed += squared.size
        cluster = squared.argmin(1)
        return cluster, rounded_up(squared[np.arange(len(vectors)), cluster]), rounded_down(squared)

    def again(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cluster, upper, lower = cluster.copy(), upper + self.moved[cluster], np.maximum(lower - self.moved, 0)
        open_rows = np.flatnonzero(upper >= self.nearest[cluster])
        own = np.arange(len(self.centroids)) == cluster[open_rows, None]
        maybe = ~own & (upper[open_rows, None] >= lower[open_rows]) & (upper[open_rows, None] >= self.half[cluster[open_rows]])
        open_rows, maybe = open_rows[maybe.any(1)], maybe[maybe.any(1)]
        # the own distance exactly, which rules out most of what is left
        best = squares(vectors[open_rows], self.centroids[cluster[open_rows]])
        self.computed += len(best)
        upper[open_rows], lower[open_rows, cluster[open_rows]] = rounded_up(best), rounded_down(best)
        for c in range(len(self.centroids)):
            at = np.flatnonzero(maybe[:, c])
            rows = open_rows[at]
            keep = (upper[rows] >= lower[rows, c]) & (upper[rows] >= self.half[cluster[rows], c]) & (cluster[rows] != c)
            at, rows = at[keep], rows[keep]
            if not len(rows):
                continue
            squared = squares(vectors[rows], self.centroids[c])
            self.computed += len(rows)
            lower[rows, c] = rounded_down(squared)
            nearer = (squared < best[at]) | ((squared == best[at]) & (c < cluster[rows]))
            best[at[nearer]], cluster[rows[nearer]], upper[rows[nearer]] = squared[nearer], c, rounded_up(squared[nearer])
        return cluster, upper, lower


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1]), pa.array(values.reshape(-1), kind))


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    schema = [("vec_id", pa.int64()), ("vector", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.int64()), ("lower", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("rows", pa.int64())]
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in schema], [name for name, _ in schema])


def _round(centroids: np.ndarray, moved: np.ndarray | None, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass: the rows with their clusters and bounds, and at a task's end a row of sums per cluster; the last pass has exact distances instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(centroids, moved)
        k, width = centroids.shape
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                vectors = batch["vector"].flatten().to_numpy().reshape(n, width).astype(np.int64)
                if moved is None:
                    cluster, upper, lower = assign.start(vectors)
                else:
                    cluster, upper, lower = assign.again(vectors, batch["cluster"].to_numpy().astype(np.int64), batch["upper"].to_numpy(), batch["lower"].flatten().to_numpy().reshape(n, k))
                out = {"vec_id": batch["vec_id"], "cluster": pa.array(cluster, pa.int32())}
                if last:
                    yield _batch(out | {"distance": pa.array(squares(vectors, centroids[cluster]))}, n)
                    continue
                order = np.argsort(cluster, kind="stable")
                there, first = np.unique(cluster[order], return_index=True)
                sums[there] += np.add.reduceat(vectors[order], first, 0)
                counts += np.bincount(cluster, minlength=k)
                yield _batch(out | {"vector": batch["vector"], "upper": pa.array(upper), "lower": _lists(lower, pa.int64())}, n)
        some = np.flatnonzero(counts)
        if len(some):
            yield _batch({"cluster": pa.array(some, pa.int32()), "sums": _lists(sums[some], pa.int64()), "rows": pa.array(counts[some])}, len(some))

    return run


def _kept(dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, lengths, flat = integers(batch["embedding"])
            right = lengths == dimensions
            vectors = flat[np.repeat(right, lengths)].reshape(-1, dimensions)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(good)).filter(pa.array(right)), _lists(vectors, pa.int32())], ["vec_id", "vector"])

    return run


def kept(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, vector): the integer vectors that take part."""
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") == dimensions)
    return in_arrow(rows, _kept(dimensions), "vec_id bigint, vector array<int>")


def moved_to(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means of all rows; a centroid without rows stays."""
    part = table.filter(F.col("sums").isNotNull()).select("cluster", "rows", F.posexplode("sums").alias("d", "value"))
    out = centroids.copy()
    for r in part.groupBy("cluster", "d").agg(F.sum("value").alias("total"), F.sum("rows").alias("n")).collect():  # k x dimensions numbers
        out[r["cluster"], r["d"]] = r["total"] // r["n"]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Per vector of rows (vec_id, embedding) that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = rows.sparkSession
    with scratch():
        state = stored(kept(rows, dimensions))
        name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        first = state.orderBy(name, "vector").limit(k).select("vector").collect()
        centroids = np.array([r["vector"] for r in first], np.int64).reshape(len(first), dimensions)
        moved = None
        for turn in range(rounds + 1) if len(first) else ():
            last = turn == rounds
            before, state = state, stored(in_arrow(state if moved is None else state.filter(F.col("sums").isNull()), _round(centroids, moved, last), STATE), lasting=last)
            release(before)
            if not last:
                after = moved_to(state, centroids)
                moved, centroids = rounded_up(squares(after, centroids)), after
        if not len(first):
            return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        each = {r["cluster"]: r["total"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    # k rows at most, as literals
    values = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("cluster") + 1)
    inertia = values([each.get(c, 0) for c in range(len(centroids))]).cast("bigint")
    return state.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(each.values())).cast("bigint").alias("inertia"), values([digest(c) for c in centroids]).alias("centroid_sha256"))


def op13_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Every round as two tables: the nearest centroid of each vector, then the means."""
    steps = [
        """vectors AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM (SELECT * FROM vectors ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v LIMIT 40))",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT k, arg_min(c, d * 64 + c)::INTEGER AS c, min(d)::BIGINT AS d FROM (SELECT k, c, (list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, y.v) + list_inner_product(y.v, y.v))::BIGINT AS d FROM vectors x, c{n} y) GROUP BY k)")
        if n < ROUNDS:
            steps.append(f"""m{n} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM vectors JOIN a{n} USING (k)) GROUP BY c, i) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))""")
    final = f"""SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN vectors USING (k) JOIN c{ROUNDS} z USING (c)"""
    return "WITH " + ",\n".join(steps) + "\n" + final


SQL = _sql()
