"""Top-k search and clustering of vectors against plain loops."""

import hashlib
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same

from veritill.llm import clustering, queries, topk

SMALL = "/root/testdata/sf0.001"
ROWS = "vec_id bigint, embedding array<float>"


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(np.float32(x))) for x in v]


def vectors(seed, n, width, repeats=0):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(4, width))
    out = [(int(k), [float(np.float32(x)) for x in middles[k % 4] * 0.2 + r.normal(size=width) * 0.1]) for k in range(n)]
    return out + [(n + k, out[0][1]) for k in range(repeats)]


ODD = [(9000, None), (9050, []), (9001, [float("nan")] * 8), (None, [0.5] * 8), (9100, [1.0, None] + [0.0] * 6), (9002, [float("inf")] + [0.0] * 7), (9150, [0.3]), (9003, [0.1] * 8), (9003, [0.1] * 8)]


def plain_top(rows, k, every):
    v = [(i, whole(x)) for i, x in rows if i is not None and whole(x) is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for q, x in v:
        if q % every == 0:
            best = sorted((-dot(x, y), i) for i, y in v if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "query_block", "repeats"), [(16_384, 16_384, 0), (100, 4, 70)])
def test_top_k_against_a_plain_loop(spark, block, query_block, repeats):
    from pyspark.sql import functions as F

    rows = vectors(5, 400, 8, repeats) + ODD + [(50, [0.2] * 8)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).withColumns({"rank": F.lit(1), "score": F.lit("x"), "q": F.lit(2)}).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block, query_block)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top(rows, 5, 50)


def test_sums_of_slices_and_their_error():
    r = np.random.default_rng(2)
    data = np.floor(r.normal(size=(700, 24)) * 60).astype(np.int64)
    data[0, 3] = 9_000  # one wide component
    block, queries = topk.Block.of(r.permutation(700), data), data[:12]
    levels = topk.Block.quantised(block.vectors, block.lows, block.steps)
    weights, unit, error = block.weights(queries)
    zero = block.zero(queries, weights, unit)
    for q in range(12):
        slices = block.sums(weights[q])
        got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:700].astype(np.int64) << k for k, s in enumerate(slices))
        assert (got == np.where(weights[q] < 0, 2**topk.BITS - 1 - levels, levels) @ abs(weights[q])).all()
        assert (abs(unit[q] * got + zero[q] - block.vectors @ queries[q]) <= error[q] * unit[q]).all()
        kth = np.sort(got)[-5]
        assert sorted(block.at_least(slices, 5, block.valid, 3, -np.inf)) == sorted(np.flatnonzero(got >= kth - 3))


def test_bounds_leave_few_rows_to_resolve(monkeypatch):
    r = np.random.default_rng(3)
    data = r.normal(size=(8192, 64))
    data = np.floor(256 * data / np.linalg.norm(data, axis=1)[:, None]).astype(np.int64)
    seen, at_least = [], topk.Block.at_least
    monkeypatch.setattr(topk.Block, "at_least", lambda *a: (lambda x: (seen.append(len(x)), x)[1])(at_least(*a)))
    none = np.zeros(0, np.int64)
    topk.Block.of(np.arange(8192), data).search(np.arange(20), data[:20], [(none, none)] * 20, 5)
    assert np.mean(seen) < 0.05 * 8192


def test_no_vectors(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], ROWS)
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).collect() == []
    assert clustering.cluster(none).collect() == []
    assert topk.top_k(spark.createDataFrame([(50, [1.0])], ROWS), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("name", ["op12_topk_search", "op13_elkan_clusters"])
def test_query_equals_sql(spark, name):
    same(spark, SMALL, queries.QUERIES[name], queries.SQL[name])


def plain_clusters(rows, k, rounds, width, seed):
    v = [(i, w) for i, x in rows if (w := whole(x)) is not None and len(w) == width]
    first = sorted(v, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x: min((far(x, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in v]
        centroids = [[sum(col) // len(m) for col in zip(*m, strict=True)] if (m := [x for (_, x), o in zip(v, own, strict=True) if o == n]) else c for n, c in enumerate(centroids)]
    out = [(i, *near(x)[::-1]) for i, x in v]
    return sorted(((i, n, d, sum(r[2] for r in out if r[1] == n), sum(r[2] for r in out), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in out), key=repr)


@pytest.mark.parametrize(("k", "repeats"), [(7, 0), (12, 150), (1000, 3)])
def test_clusters_against_a_plain_loop(spark, k, repeats):
    from pyspark.sql import functions as F

    rows = vectors(6, 150, 8, repeats) + ODD
    df = spark.createDataFrame(rows, ROWS).withColumns({"cluster": F.lit("x"), "distance": F.lit(1), "sums": F.lit(0)}).repartition(3)
    got = clustering.cluster(df, k, 3, 8, 2).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows, k, 3, 8, 2)


def test_bounds_skip_distances_and_keep_ties():
    r = np.random.default_rng(4)
    middles = r.integers(-200, 200, (20, 16))
    data = middles[r.integers(0, 20, 3000)] + r.integers(-25, 26, (3000, 16))
    centroids = middles + r.integers(-9, 10, (20, 16))
    centroids[13] = centroids[5]  # every tie goes to 5
    first = clustering.Assigner(centroids)
    cluster, upper, lower = first.start(data)
    after = np.array([data[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(20)])
    after[2], after[9] = 2 * after[4] - after[7], after[7]
    again = clustering.Assigner(after, clustering.rounded_up(clustering.squares(after, centroids)))
    got, up, low = again.again(data, cluster, upper, lower)
    exact = np.stack([clustering.squares(data, c) for c in after], 1)
    assert (got == exact.argmin(1)).all() and again.computed < 0.5 * exact.size
    assert (up.astype(float) ** 2 >= 256 * exact[np.arange(3000), got] * (1 - 1e-9)).all() and (low.astype(float) ** 2 <= 256 * exact * (1 + 1e-9)).all()
