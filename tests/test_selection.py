"""Greedy selections and ranked cuts above the window's group limit, against plain loops; no task sorts a whole stratum."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veritill.operators import ordered, selection, windows


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    out = [(f"e{k}", f"g{r.randrange(9000)}", f"s{r.randrange(12_000)}" if k % 50 else None, f"e{r.randrange(14_000)}" if k % 3 == 0 else None, r.choice("abcdefghijkl") * r.choice([1, 2]), "big" if k % 10 else "small", r.randrange(10**6)) for k in range(14_000)]
    return spark.createDataFrame(out, "example_id string, group_id string, source_record_id string, parent_example_id string, fingerprint string, stratum string, x int").repartition(5).cache()


def by_key(rows, order):
    strata = {}
    for r in sorted(rows.collect(), key=order):
        strata.setdefault(r.stratum, []).append(r)
    return strata


@pytest.mark.parametrize(("n", "cap"), [(5, 2), (700, 2), (5000, 40)])
def test_diverse_take(rows, n, cap):
    want = set()
    for members in by_key(rows, lambda r: (r.x, r.example_id)).values():
        seen, prints, picked = [set(), set()], {}, []
        for capped in (True, False):
            for r in members:
                if len(picked) < n and r not in picked and r.group_id not in seen[0] and r.source_record_id not in seen[1] and not (capped and prints.get(r.fingerprint, 0) >= cap):
                    seen[0].add(r.group_id)
                    seen[1].add(r.source_record_id)
                    prints[r.fingerprint] = prints.get(r.fingerprint, 0) + 1
                    picked.append(r)
        want |= {r.example_id for r in picked}
    got = selection.diverse_take(rows, ["x", "example_id"], n, cap=cap, by="stratum", growth=2)
    assert got.columns == rows.columns and {r.example_id for r in got.collect()} == want


def test_choose_unblocked(rows):
    rows = rows.filter("source_record_id is not null")
    blocked = rows.filter("example_id in ('e1', 'e2', 'e3')")
    bad = blocked.collect()
    gone = ({r.example_id for r in bad}, {r.group_id for r in bad}, {r.source_record_id for r in bad})
    n, want = 3000, set()
    for members in by_key(rows, lambda r: (r.x, r.example_id)).values():
        held, parents, picked = (set(), set(), set()), set(), []
        for r in members:
            keys = (r.example_id, r.group_id, r.source_record_id)
            if any(v is not None and v in g for v, g in zip(keys, gone, strict=True)) or r.parent_example_id in gone[0]:
                continue
            if len(picked) >= n or any(v in h for v, h in zip(keys, held, strict=True)) or (r.parent_example_id and r.parent_example_id in held[0]) or r.example_id in parents:
                continue
            for v, h in zip(keys, held, strict=True):
                h.add(v)
            if r.parent_example_id:
                parents.add(r.parent_example_id)
            picked.append(r.example_id)
        want |= set(picked)
    got = selection.choose_unblocked(rows, ["x", "example_id"], n, blocked, "stratum", growth=2)
    assert got.columns and {r.example_id for r in got.collect()} == want


def test_round_robin_unique(rows):
    n, strata = 600, {}
    for r in rows.collect():
        own = strata.setdefault(r.stratum, {})
        mark = (sha("audit", r.example_id), r.example_id)
        own[r.group_id] = min(own.get(r.group_id, mark), mark)
    queues = {s: [(m[1], g) for g, m in sorted(own.items(), key=lambda kv: kv[1])] for s, own in strata.items()}
    used, want = set(), []
    while len(want) < n and any(queues.values()):
        for s in sorted(queues):
            while queues[s] and len(want) < n:
                e, g = queues[s].pop(0)
                if g not in used:
                    used.add(g)
                    want.append(e)
                    break
    assert {r.example_id for r in selection.round_robin_unique(rows, "stratum", "group_id", "example_id", n).collect()} == set(want)


def one_task_windows(df):
    """Windows whose partitions are no finer than a stratum."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [w for w in re.findall(r"Window \[row_number\(\)[^\n]*", plan) if "_range" not in w]


def test_ranked_cuts_above_the_group_limit(rows):
    marks = lambda space, r: (sha("2026", space, r.example_id), r.example_id)
    strata = {}
    for r in rows.collect():
        strata.setdefault(r.stratum, []).append(r)
    sample = windows.sample_per_stratum(rows, ["stratum"], "example_id", 5000)
    assert {r.example_id for r in sample.collect()} == {r.example_id for own in strata.values() for r in sorted(own, key=lambda r: marks("sample", r))[:5000]}
    slices = windows.disjoint_slices(rows, "stratum", "example_id", [("a", 1200), ("b", 900)])
    got = {(r.stratum, r.slice): set() for r in slices.collect()}
    for r in slices.collect():
        got[r.stratum, r.slice].add(r.example_id)
    for s, own in strata.items():
        line = [r.example_id for r in sorted(own, key=lambda r: marks("slices", r))]
        assert got[s, "a"] == set(line[:1200]) and (s, "b") not in got or got[s, "b"] == set(line[1200:2100])
    queue = windows.prioritised(rows, F.when(F.col("fingerprint") == "a", 0).otherwise(1), "stratum", "example_id", 4000)
    turns = []
    for s, own in strata.items():
        for p in (0, 1):
            turns += [(p, k, s, r.example_id) for k, r in enumerate(sorted((r for r in own if (r.fingerprint != "a") == p), key=lambda r: marks("queue", r)))]
    assert {r.example_id for r in queue.collect()} == {t[3] for t in sorted(turns)[:4000]}
    for df in (sample, slices, queue):
        assert one_task_windows(df) == []


def test_places_in_any_order_and_by_long_names(rows, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 300)
    d = rows.select("example_id", "stratum", "x", F.concat(F.lit("a very long common beginning "), "example_id").alias("name"))
    for got, key in ((ordered.named_places(d, "name", ["stratum"], "p"), lambda r: r.name), (ordered.places(d, [F.desc("x"), "name"], ["stratum"], "p"), lambda r: (-r.x, r.name)), (ordered.hashed_places(d, F.sha2("name", 256), "name", ["stratum"], "p"), lambda r: hashlib.sha256(r.name.encode()).hexdigest())):
        strata = {}
        for r in got.collect():
            strata.setdefault(r.stratum, []).append(r)
        for own in strata.values():
            assert [r.p for r in sorted(own, key=key)] == list(range(1, len(own) + 1))
    assert ordered.ranges_of(d) == 47


def test_groups_of_one_size_are_packed_by_hash(spark):
    names = [f"g{k}" for k in range(30)]
    df = spark.createDataFrame([(g, k) for g in names for k in range(1 + int(g[1:]) % 2)], "g string, k int")
    targets, left = {"x": 15, "y": 20, "z": 10}, {"x": 15, "y": 20, "z": 10}
    want = {}
    for g in sorted(names, key=lambda g: (-(1 + int(g[1:]) % 2), sha(2026, g))):
        size = 1 + int(g[1:]) % 2
        s = min((s for s in left if left[s] >= size), key=lambda s: (-left[s] / targets[s], sha(2026, g, s)))
        left[s] -= size
        want[g] = s
    got = {r.g: r.split for r in selection.pack_groups(df, "g", targets).collect()}
    assert got == want
    pinned = spark.createDataFrame([("g1", "z"), ("g3", "z"), ("g2", "x")], "g string, split string")
    got = {r.g: r.split for r in selection.pack_groups(df, "g", targets, pinned).collect()}
    assert (got["g1"], got["g3"], got["g2"]) == ("z", "z", "x") and sum(2 if int(g[1:]) % 2 else 1 for g, s in got.items() if s == "z") == 10
    with pytest.raises(ValueError, match="fixed group q is unknown"):
        selection.pack_groups(df, "g", targets, spark.createDataFrame([("q", "x")], "g string, split string"))
    with pytest.raises(ValueError, match="more than z takes"):
        selection.pack_groups(df, "g", {"x": 44, "z": 1}, spark.createDataFrame([("g1", "z")], "g string, split string"))


def test_walks_go_on_from_chunk_to_chunk(spark, monkeypatch):
    r = random.Random(7)
    sizes = {f"g{k}": r.choice([1, 1, 2, 3, 7]) for k in range(160)}
    strata = {g: r.choice("aaabbc") for g in sizes}
    df = spark.createDataFrame([(g, strata[g]) for g, n in sizes.items() for _ in range(n)], "g string, s string")
    order = sorted(sizes, key=lambda g: (sha(2026, g), g))
    total = sum(sizes.values())
    # roles: the first one looks at known groups first
    known = [g for g in order if g[-1] == "7"]
    targets, used, want = [("x", 41), ("y", 60), ("z", 77)], {}, {}
    for turn, (role, left) in enumerate(targets):
        for g in ([*known, *order] if turn == 0 else order):
            if g not in used and sizes[g] <= left:
                used[g] = role
                left -= sizes[g]
        assert left == 0
    # proportions: the stratum furthest behind gives its next group that fits
    queues = {s: [g for g in order if strata[g] == s] for s in "abc"}
    ideal = {s: 150 * sum(sizes[g] for g in q) / total for s, q in queues.items()}
    taken, left = dict.fromkeys(queues, 0), 150
    while left:
        heads = {s: next(g for g in q if sizes[g] <= left) for s, q in queues.items() if any(sizes[g] <= left for g in q)}
        s = min(heads, key=lambda s: (taken[s] / ideal[s], sha(2026, s)))
        queues[s].remove(heads[s])
        want[heads[s]] = s
        taken[s] += sizes[heads[s]]
        left -= sizes[heads[s]]
    packs = {"m": total // 2, "n": total - total // 2}
    once = {x.g: x.split for x in selection.pack_groups(df, "g", packs).collect()}
    monkeypatch.setattr(selection, "WALK", 37)
    assert {x.g: x.split for x in selection.pack_groups(df, "g", packs).collect()} == once
    first = spark.createDataFrame([(g,) for g in known], "g string")
    assert {x.g: x.role for x in selection.fill_roles(df, "g", targets, first).collect()} == used
    assert {x.g for x in selection.proportional_groups(df, "g", "s", 150).collect()} == set(want)
    with pytest.raises(ValueError, match="lacks"):
        selection.fill_roles(df, "g", [("x", total + 1)])


def test_roles_of_many_groups_are_met_to_the_row(spark):
    # more groups than a batch of rows that a task gets at a time, of one or two rows
    df = spark.range(60_000).select(F.concat(F.lit("g"), F.when(F.col("id") < 40_000, F.col("id") % 25_000).otherwise(F.col("id")).cast("string")).alias("g"), "id")
    targets = [("a", 17_001), ("b", 20_003), ("c", 9_000)]
    out = selection.fill_roles(df, "g", targets, df.filter("id < 3"))
    assert {r["role"]: r["n"] for r in out.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()} == dict(targets)
    assert out.groupBy("g").agg(F.count_distinct("role").alias("roles")).filter("roles > 1").isEmpty() and out.count() == out.select("id").distinct().count()
