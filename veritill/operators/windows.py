"""Ranked selections that come out the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritill.functions.hashing import order_key
from veritill.operators.ordered import first_by_hash, hashed_places, joined_on, named_places, scored_places


def sample_per_stratum(df: DataFrame, stratum: list[str], key: str, n: int | Column, namespace: str = "sample") -> DataFrame:
    """The first n of each stratum in hash order."""
    return first_by_hash(df, order_key(namespace, F.col(key)), key, stratum, n, "_r").drop("_r")


def round_robin(df: DataFrame, bucket: str, key: str, namespace: str = "diverse") -> DataFrame:
    """Rows with (turn, bucket_order): first rows of all buckets in the buckets' hash order, then second rows, and so on."""
    d = hashed_places(df, order_key(namespace, F.col(key)), key, [bucket], "turn")
    return d.withColumn("bucket_order", order_key(namespace, F.col(bucket)))


def score_strata(df: DataFrame, score: str, key: str, shares: tuple[int, ...] = (35, 30, 35), names: tuple[str, ...] = ("low", "middle", "high"), by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their stratum by score: floor counts from below, the last stratum taking the rest."""
    d = scored_places(df, score, order_key("strata", F.col(key)), key, list(by), "_rank")
    d = joined_on(d, df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")), list(by))
    out, bound, passed = F.lit(names[-1]), 0, []
    for s in shares[:-1]:
        bound += s
        passed.append(F.floor(F.col("_total") * bound / 100))
    for name, limit in reversed(list(zip(names, passed, strict=False))):
        out = F.when(F.col("_rank") <= limit, name).otherwise(out)
    return d.withColumn("stratum", out).drop("_rank", "_total")


def apportion(sizes: DataFrame, label: str, size: str, total: int) -> DataFrame:
    """(label, quota): shares of a total by size, the largest remainders taking what floors leave."""
    w = Window.partitionBy()
    exact = F.col(size) * F.lit(total) / F.sum(size).over(w)
    d = sizes.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    left = F.lit(total) - F.sum("_floor").over(w)
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), label))
    return d.select(label, (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("bigint").alias("quota"))


def cut(df: DataFrame, digest: Column, key: str, parts: list[tuple[str, int, int]], by: list[str]) -> DataFrame:
    """Rows with the part they fall into, by the order of a hex digest: each part takes total * numerator // denominator, the last one the rest."""
    d = hashed_places(df, digest, key, by, "_rank")
    d = joined_on(d, df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")), by)
    out, bounds, so_far = F.lit(parts[-1][0]), [], F.lit(0)
    for _, num, den in parts[:-1]:
        so_far = so_far + F.floor(F.col("_total") * num / den)
        bounds.append(so_far)
    for (name, _, _), limit in reversed(list(zip(parts, bounds, strict=False))):
        out = F.when(F.col("_rank") <= limit, name).otherwise(out)
    return d.withColumn("part", out).drop("_rank", "_total")


def cyclic(df: DataFrame, key: str, names: tuple[str, ...], by: list[str], name: str = "part") -> DataFrame:
    """Rows with names dealt in turn by the order of a key: names[(place - 1) % len(names)]."""
    d = named_places(df, key, by, "_place")
    return d.withColumn(name, F.element_at(F.array(*map(F.lit, names)), ((F.col("_place") - 1) % len(names) + 1).cast("int"))).drop("_place")


def prioritised(df: DataFrame, priority: Column, bucket: str, key: str, limit: int) -> DataFrame:
    """The first `limit` rows: by priority, then dealt in turn from the buckets, of which only so many can give any row."""
    d = first_by_hash(df.withColumn("_p", priority), order_key("queue", F.col(key)), key, ["_p", bucket], limit, "_turn")
    return d.orderBy("_p", "_turn", bucket).limit(limit).drop("_p", "_turn")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of a total order, merged from each task's own first k."""
    return df.orderBy(*order).limit(k)


def best(df: DataFrame, by: list[str], rank: Column) -> DataFrame:
    """The row of each group with the greatest rank struct; the struct settles ties."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*df.columns), rank).alias("row")).select("row.*")


def disjoint_slices(df: DataFrame, stratum: str, key: str, slices: list[tuple[str, int]]) -> DataFrame:
    """Slices of one hash order per stratum: as groups are unique, they share none."""
    every = sum(n for _, n in slices)
    d = first_by_hash(df, order_key("slices", F.col(key)), key, [stratum], every, "_r")
    out, done = F.lit(None).cast("string"), every
    for name, n in reversed(slices):
        out = F.when(F.col("_r") <= done, name).otherwise(out)
        done -= n
    return d.withColumn("slice", out).drop("_r")
