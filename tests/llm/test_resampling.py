"""Importance resampling against a plain loop, and its edge cases."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same

from veritill.llm import queries, resampling

SMALL = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def features(t, longest):
    w = words(t)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, buckets, longest, percent, least, seed):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in texts for f in features(x, longest)) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(buckets)]
    rows = []
    for k, text in docs:
        f = features(text, longest)
        w = sum(gain[place(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place_, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place_
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def texts(seed, n):
    r = random.Random(seed)
    pool = ["Été", "naïve", "ÀB", "x1", "10", "Größe", "日本", *(f"w{k}" for k in range(40))]
    return [(k, r.choice([" ", ", ", "\n"]).join(r.choices(pool, k=r.choice([0, 3, 19, 20, 21, 60])))) for k in range(n)]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 64, 35)])
def test_against_a_plain_loop(spark, longest, buckets, percent):
    docs = [*texts(1, 150), (7, "again " * 30), (7, "again " * 30), (None, "no id " * 20), (None, None), (500, ""), (501, " .-_\x00"), (502, "long " * 40_000)]
    target = [t for _, t in texts(2, 20)] + [None]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(d, t, buckets, longest, percent, 20, 2024)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == plain(docs, target, buckets, longest, percent, 20, 2024)


def test_query_equals_sql(spark):
    same(spark, SMALL, queries.QUERIES["op11_importance_resampling"], queries.SQL["op11_importance_resampling"])


def test_one_text_and_id_for_most_rows(spark):
    docs = spark.createDataFrame([(3, "same words " * 15)] * 300 + [(k, f"other words number {k} " * 8) for k in range(100)], "doc_id bigint, text string")
    got = resampling.resample(docs, docs.select("text"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 201))
    first = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert first == sorted(first, key=lambda r: (-r["score"], r["doc_id"]))


def test_no_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", 7)], "doc_id bigint, text string, score bigint, words string, buckets bigint")
    none = docs.filter("false")
    assert resampling.resample(none, none).collect() == []
    got = resampling.resample(docs, none).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in got] == [(1, 2, None)]
    assert resampling.resample(none, docs).count() == 0
