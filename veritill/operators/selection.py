"""Greedy selections that carry state from pick to pick.

What a pick changes is what all later ones see, so picks come one after the other; but tasks see a stretch of the
order at a time, and what goes on from stretch to stretch is small: what is left of targets, or the picks themselves.
The order of picks is a hash order, so the outcome doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritill.functions.hashing import SEED, sha
from veritill.operators.ordered import first_by_hash, places
from veritill.sources import storage

#: Groups that a task walks through at a time; the walk goes on from what is left of the targets, a few numbers.
WALK = 200_000


def _walked(chunk: DataFrame, step, schema: str) -> DataFrame:
    """The rows that step(groups in order) makes of a chunk of at most WALK groups, stored."""

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come in batches, each numbered from 0; step tells rows by their index
        yield step(pd.concat(list(parts), ignore_index=True).sort_values("_place"))

    return storage.stored(chunk.repartition(1).mapInPandas(one, schema))


def pack_groups(df: DataFrame, group: str, targets: dict[str, int], fixed: DataFrame | None = None) -> DataFrame:
    """Rows with a split that meets exact row targets without dividing a group.

    Groups go by falling size, then hash; each takes the split with the greatest share of its target left that
    it fits into, equal shares going to the lowest hash of group and split. Groups of `fixed` (group, split) are
    placed first; one that is unknown, or more than its split takes, is refused. The groups are walked through in order,
    WALK at a time, each stretch by one task.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    left, parts = dict(targets), []
    if fixed is not None:
        pinned = storage.stored(fixed.select(group, "split").join(sizes, group, "left"))
        if (unknown := pinned.filter("size is null").first()) is not None:
            raise ValueError(f"fixed group {unknown[group]} is unknown")
        for r in pinned.groupBy("split").agg(F.sum("size").alias("n")).collect():
            left[r["split"]] = left.get(r["split"], -1) - r["n"]
            if left[r["split"]] < 0:
                raise ValueError(f"fixed groups are more than {r['split']} takes")
        parts.append(pinned.select(group, "split"))
        sizes = sizes.join(pinned, group, "left_anti")
    placed = storage.stored(places(sizes.withColumn("h", sha(SEED, F.col(group))), [F.desc("size"), "h", group], [], "_place"))
    seed, many = SEED, placed.count()
    for at in range(0, many, WALK):
        now = dict(left)

        def step(rows: pd.DataFrame, now: dict = now) -> pd.DataFrame:
            splits = []
            for name, size in zip(rows[group], rows["size"], strict=True):
                fits = [s for s in targets if now[s] >= size]
                pick = min(fits, key=lambda s: (-now[s] / max(targets[s], 1), sha256(f"{seed}:{name}:{s}".encode()).hexdigest()), default=None)
                if pick is not None:
                    now[pick] -= size
                splits.append(pick)
            return rows.assign(split=splits)[[group, "size", "split"]]

        part = _walked(placed.filter((F.col("_place") > at) & (F.col("_place") <= at + WALK)), step, f"`{group}` {df.schema[group].dataType.simpleString()}, size bigint, split string")
        if (none := part.filter("split is null").first()) is not None:
            raise ValueError(f"group {none[group]} fits no split")
        for r in part.groupBy("split").agg(F.sum("size").alias("n")).collect():
            left[r["split"]] -= r["n"]
        parts.append(part.select(group, "split"))
    if any(left.values()):
        raise ValueError(f"targets not met: {left}")
    return df.join(reduce(DataFrame.unionByName, parts), group) if parts else df.withColumn("split", F.lit(None).cast("string"))


def fill_roles(df: DataFrame, group: str, targets: list[tuple[str, int]], first: DataFrame | None = None) -> DataFrame:
    """Rows of the groups that fill roles in a fixed order, each role taking groups in hash order as they fit.

    The first role looks at the groups of `first` before the others. Each role walks through the groups that are not taken
    and still fit, WALK at a time, until it is full.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("h", sha(SEED, F.col(group)))
    known = first.select(group, F.lit(True).alias("known")).distinct() if first is not None else sizes.select(group, F.lit(True).alias("known")).limit(0)
    placed = storage.stored(places(sizes.join(known, group, "left"), ["h", group], [], "_place"))
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, size bigint, role string"
    taken, many = storage.stored(df.sparkSession.createDataFrame([], schema)), placed.count()
    for turn, (role, target) in enumerate(targets):
        left = target
        for part in ([F.col("known")] if turn == 0 and first is not None else []) + [F.lit(True)]:
            for at in range(0, many, WALK):
                if not left:
                    break

                def step(rows: pd.DataFrame, left: int = left, role: str = role) -> pd.DataFrame:
                    picked = []
                    for i, size in zip(rows.index, rows["size"], strict=True):
                        if size <= left:
                            picked.append(i)
                            left -= size
                    return rows.loc[picked].assign(role=role)[[group, "size", "role"]]

                chunk = placed.filter(part & (F.col("_place") > at) & (F.col("_place") <= at + WALK) & (F.col("size") <= left)).join(taken.select(group), group, "left_anti")
                if chunk.isEmpty():
                    continue
                new = _walked(chunk, step, schema)
                left -= new.agg(F.sum("size")).first()[0] or 0
                before, taken = taken, storage.stored(taken.unionByName(new))
                storage.release(before, new)
        if left:
            raise ValueError(f"role {role} lacks {left} rows")
    return df.join(taken.select(group, "role"), group)


def proportional_groups(df: DataFrame, group: str, stratum: str, target: int) -> DataFrame:
    """Rows of groups drawn so that strata keep their shares: the stratum furthest behind its ideal gives the next group that fits.

    Equal shares go to the lowest hash of the stratum, groups in hash order. A task gets the next groups of every stratum,
    WALK in all, and goes on until one of them runs out; what is carried on is a place and a number per stratum.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.min(stratum).cast("string").alias("stratum")).withColumn("stratum", F.coalesce("stratum", F.lit("")))
    placed = storage.stored(places(sizes.withColumn("h", sha(SEED, F.col(group))), ["h", group], ["stratum"], "_place"))
    strata = placed.groupBy("stratum").agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("groups"))
    # a row per stratum; there are as many as kinds of groups
    state = {r["stratum"]: [r["rows"], r["groups"], 0, 0] for r in strata.collect()}
    total = sum(r[0] for r in state.values())
    ideal = {s: max(target * r[0] / total, 1e-9) for s, r in state.items()}
    mark = {s: sha256(f"{SEED}:{s}".encode()).hexdigest() for s in state}
    left, parts, schema = target, [], f"`{group}` {df.schema[group].dataType.simpleString()}, size bigint, stratum string, `_end` bigint"
    while left and any(r[2] < r[1] for r in state.values()):
        each = max(1, WALK // max(1, len(state)))
        cursors = df.sparkSession.createDataFrame([(s, r[2]) for s, r in state.items() if r[2] < r[1]], "stratum string, _from bigint")
        chunk = placed.join(cursors, "stratum").filter((F.col("_place") > F.col("_from")) & (F.col("_place") <= F.col("_from") + each))
        now = {s: tuple(r) for s, r in state.items()}

        def step(rows: pd.DataFrame, now: dict = now, left: int = left) -> pd.DataFrame:
            queues = {s: list(zip(q[group], q["size"], q["_place"], strict=True)) for s, q in rows.groupby("stratum")}
            heads, taken, picked, ends = dict.fromkeys(queues, 0), {s: r[3] for s, r in now.items()}, [], {}
            heap = [(taken[s] / ideal[s], mark[s], s) for s in queues]
            heapify(heap)
            while heap and left:
                _, _, s = heappop(heap)
                queue, k = queues[s], heads[s]
                while k < len(queue) and queue[k][1] > left:
                    k += 1
                heads[s] = k
                if k == len(queue):
                    if now[s][2] + len(queue) < now[s][1]:
                        break  # its next groups are in the next chunk
                    continue
                name, size, _ = queue[k]
                picked.append((name, size, s, None))
                heads[s], left, taken[s] = k + 1, left - size, taken[s] + size
                heappush(heap, (taken[s] / ideal[s], mark[s], s))
            ends = [(None, 0, s, now[s][2] + k) for s, k in heads.items()]
            return pd.DataFrame(picked + ends, columns=[group, "size", "stratum", "_end"])

        part = _walked(chunk, step, schema)
        for r in part.groupBy("stratum").agg(F.sum("size").alias("n"), F.max("_end").alias("end")).collect():
            state[r["stratum"]][2], state[r["stratum"]][3], left = r["end"], state[r["stratum"]][3] + r["n"], left - r["n"]
        parts.append(part.filter("_end is null").select(group))
    if left:
        raise ValueError(f"{left} rows of the target can't be met")
    return df.join(reduce(DataFrame.unionByName, parts), group, "left_semi") if parts else df.limit(0)


def _in_rounds(df: DataFrame, order: list, n: int, by: str | None, growth: int, exact: bool, passes: int, open_rows, take) -> DataFrame:
    """The picks of each stratum, n at most, each depending on the ones before it; made in rounds over the rows in order.

    The rows are stored once with their place in the stratum. A round looks at the next stretch of places, growing from round
    to round, and leaves out by joins what earlier picks rule out: open_rows(rows, picks, turn) gives the rows of a stretch
    that may still be picked, take(rows in order, how many are wanted, turn) picks among those of one stratum. So a task
    holds what is still open in a stretch, and picks are all that is carried on. `passes` turns begin at the first row.
    """
    placed = storage.stored(places(df.withColumn("_key", F.col(by) if by else F.lit("")), order, ["_key"], "_place"))
    sizes = placed.groupBy("_key").agg(F.max("_place").alias("_size"))
    most = sizes.agg(F.max("_size")).first()[0] or 0
    picks = storage.stored(placed.withColumn("_turn", F.lit(0)).limit(0))

    def wanted() -> DataFrame:
        got = picks.groupBy("_key").agg(F.count(F.lit(1)).alias("_got"))
        return sizes.join(got, "_key", "left").select("_key", "_size", (F.lit(n) - F.coalesce("_got", F.lit(0))).alias("_wanted")).filter("_wanted > 0")

    for turn in range(passes):
        low, high = 0, max(n, 1) * growth
        while low < most and not wanted().filter(F.col("_size") > low).isEmpty():
            stretch = placed.filter((F.col("_place") > low) & (F.col("_place") <= high)).join(wanted().drop("_size"), "_key")
            rows = open_rows(stretch, picks, turn)

            new = rows.groupBy("_key").applyInPandas(_picker(take, turn, picks.columns), picks.schema)
            before, picks = picks, storage.stored(picks.unionByName(new))
            storage.release(before)
            low, high = high, high * growth
    if exact and not wanted().isEmpty():
        raise ValueError(f"a stratum has fewer than {n} rows that can be taken")
    return picks.select(*df.columns)


def _picker(take, turn: int, columns: list[str]):
    """What a task does with the open rows of a stratum."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place").reset_index(drop=True)
        return pdf.loc[take(pdf, int(pdf["_wanted"].iloc[0]), turn)].assign(_turn=turn)[columns]

    return one


def _without(rows: DataFrame, picks: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The rows of a stratum that share no value with its picks, for pairs of a column of rows and one of picks."""
    for own, theirs in pairs:
        used = picks.select("_key", F.col(theirs).alias(own)).filter(F.col(own).isNotNull()).distinct()
        rows = rows.join(used, ["_key", own], "left_anti")
    return rows


def diverse_take(df: DataFrame, order: list, n: int, unique: tuple[str, ...] = ("group_id", "source_record_id"), fingerprint: str = "fingerprint", cap: int = 2, by: str | None = None, growth: int = 8, exact: bool = False) -> DataFrame:
    """The first n rows in order whose keys are all new, at most `cap` per fingerprint at first, without the cap after.

    A null key is a value as any other. exact: fewer than n are an error.
    """
    # keys and fingerprints are compared as texts, a null as one of its own
    keys = {u: f"_u{k}" for k, u in enumerate(unique)}
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    d = df.withColumns({k: text(u) for u, k in keys.items()} | {"_print": text(fingerprint)})

    def open_rows(rows: DataFrame, picks: DataFrame, turn: int) -> DataFrame:
        rows = _without(rows, picks, [(k, k) for k in keys.values()])
        same = ["_key", *keys.values()]
        if turn == 0:
            held = picks.groupBy("_key", "_print").agg(F.count(F.lit(1)).alias("_held"))
            rows = rows.join(held, ["_key", "_print"], "left").fillna({"_held": 0}).filter(F.col("_held") < cap)
            same.append("_print")
        else:
            rows = rows.withColumn("_held", F.lit(0).cast("bigint"))
        # of rows that are ruled out by the same picks only the first can be one
        return rows.groupBy(*same).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in same)), "_place").alias("_row")).select(*same, "_row.*")

    def take(pdf: pd.DataFrame, wanted: int, turn: int) -> list:
        seen: list[set] = [set() for _ in keys]
        prints: dict = {}
        picked: list = []
        for i, values, f, held in zip(pdf.index, zip(*(pdf[k] for k in keys.values()), strict=True), pdf["_print"], pdf["_held"], strict=True):
            if len(picked) >= wanted:
                break
            if any(v in s for v, s in zip(values, seen, strict=True)) or turn == 0 and held + prints.get(f, 0) >= cap:
                continue
            for v, s in zip(values, seen, strict=True):
                s.add(v)
            prints[f] = prints.get(f, 0) + 1
            picked.append(i)
        return picked

    return _in_rounds(d, order, n, by, growth, exact, 2, open_rows, take).select(*df.columns)


def diverse_take_unique(df: DataFrame, order: list, n: int, fingerprint: str = "fingerprint", cap: int = 2, unique: tuple[str, ...] = ("group_id", "source_record_id")) -> DataFrame:
    """diverse_take where every row has a group and a source of its own, which is checked: two ranks and a limit, without a sequential pass."""
    for key in unique:
        if not df.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{key} isn't unique; use diverse_take")
    w = Window.partitionBy(fingerprint).orderBy(*order)
    d = df.withColumn("_late", (F.row_number().over(w) > cap).cast("int"))
    return d.orderBy("_late", *order).limit(n).drop("_late")


def choose_unblocked(df: DataFrame, order: list, n: int, blocked: DataFrame, by: str, growth: int = 8, exact: bool = False) -> DataFrame:
    """Per stratum the first n rows unrelated to blocked ones and to every earlier pick of the stratum, by example, group, source, parent and child.

    exact: fewer than n are an error.
    """
    from veritill.operators.joins import unrelated

    keys = ["example_id", "group_id", "source_record_id"]

    def open_rows(rows: DataFrame, picks: DataFrame, turn: int) -> DataFrame:
        return _without(rows, picks, [*((k, k) for k in keys), ("parent_example_id", "example_id"), ("example_id", "parent_example_id")])

    def take(pdf: pd.DataFrame, wanted: int, turn: int) -> list:
        held: tuple[set, set, set] = (set(), set(), set())
        parents: set = set()
        picked: list = []
        for i, values, p in zip(pdf.index, zip(*(pdf[k] for k in keys), strict=True), pdf["parent_example_id"], strict=True):
            if len(picked) >= wanted:
                break
            if any(v in k for v, k in zip(values, held, strict=True)) or (isinstance(p, str) and p in held[0]) or values[0] in parents:
                continue
            for v, k in zip(values, held, strict=True):
                k.add(v)
            if isinstance(p, str):
                parents.add(p)
            picked.append(i)
        return picked

    return _in_rounds(unrelated(df, blocked), order, n, by, growth, exact, 1, open_rows, take)


def round_robin_unique(df: DataFrame, stratum: str, group: str, key: str, n: int) -> DataFrame:
    """n rows dealt in turn from the strata, no two of one group: groups are reduced to their first row per stratum before the pass."""
    first = Window.partitionBy(stratum, group).orderBy(sha("audit", F.col(key)), key)
    d = df.withColumn("_f", F.row_number().over(first)).filter("_f = 1").drop("_f")
    ranked = first_by_hash(d, sha("audit", F.col(key)), key, [stratum], 2 * n, "_turn")

    def take(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values([stratum, "_turn"])
        queues = {s: list(zip(q.index, q[group], strict=True)) for s, q in pdf.reset_index(drop=True).groupby(stratum, sort=True)}
        pdf = pdf.reset_index(drop=True)
        used, picked = set(), []
        while len(picked) < n and any(queues.values()):
            for s in sorted(queues):
                while queues[s]:
                    i, g = queues[s].pop(0)
                    if g not in used:
                        used.add(g)
                        picked.append(i)
                        break
                if len(picked) >= n:
                    break
        yield pdf.loc[picked].drop(columns=["_turn"])

    # no more than 2 n rows of each stratum meet here, and a stratum has at most n - 1 groups that others used before its turn
    return ranked.repartition(1).mapInPandas(take, df.schema)

