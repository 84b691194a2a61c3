"""Checks that return the violations they find, as rows or counts; an empty result or a zero passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations): how many rows break each predicate, in one pass; an unknown outcome breaks it."""
    one = df.agg(*(F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(k) for k, c in checks.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("violations")) for k in checks))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def split_leaks(df: DataFrame, group: str, role: str) -> DataFrame:
    """Groups with more than one role."""
    return df.groupBy(group).agg(F.count_distinct(role).alias("roles")).filter("roles > 1")


def role_leaks(df: DataFrame, role: str = "role", keys: tuple[str, ...] = ("example_id", "group_id", "source_record_id", "parent_example_id")) -> DataFrame:
    """(kind, leaks): keys that more than one role holds, and parents that live in another role than their child."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys))
    flat = df.select(role, F.explode(pairs).alias("p")).filter("p.key is not null").select(role, "p.kind", "p.key")
    own = flat.groupBy("kind", "key").agg(F.count_distinct(role).alias("roles")).groupBy("kind").agg(F.count(F.when(F.col("roles") > 1, 1)).alias("leaks"))
    child = df.filter(F.col("parent_example_id").isNotNull()).select(F.col("parent_example_id").alias("_p"), F.col(role).alias("_child"))
    cross = child.join(df.select(F.col("example_id").alias("_p"), F.col(role).alias("_parent")), "_p").filter("_child <> _parent").agg(F.count(F.lit(1)).alias("leaks")).select(F.lit("parent_in_other_role").alias("kind"), "leaks")
    return own.unionByName(cross)


def count_mismatches(df: DataFrame, dimension: str, expected: dict[str, int]) -> DataFrame:
    """(category, n, expected) wherever a literal table of counts isn't met."""
    table = df.sparkSession.createDataFrame(list(expected.items()), f"{dimension} string, expected bigint")
    got = df.groupBy(dimension).agg(F.count(F.lit(1)).alias("n"))
    both = got.join(table, dimension, "full").na.fill(0, ["n", "expected"])
    return both.filter("n <> expected").select(F.col(dimension).alias("category"), "n", "expected")


def coverage(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(missing, unexpected, repeated) of exact, duplicate-free coverage of keys."""
    g = got.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    e = expected.select(F.col(key).alias("key")).distinct().withColumn("wanted", F.lit(True))
    both = e.join(g, "key", "full")
    return both.agg(F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("wanted").isNull(), 1)).alias("unexpected"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"))


def predictions_sane(df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Checks of class scores: finite, in bounds, summing to one; and that they tell rows apart."""
    from veritill.functions.scalars import top_class

    c, n, e = F.col("contradiction"), F.col("neutral"), F.col("entailment")
    ok = ~F.isnan(c) & ~F.isnan(n) & ~F.isnan(e) & c.between(0, 1) & n.between(0, 1) & e.between(0, 1) & (F.abs(c + n + e - 1) <= tolerance)
    return df.agg(F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("bad"), (F.max(c) - F.min(c)).alias("spread"), F.count_distinct(top_class(c, n, e)).alias("classes"))


def json_fields(df: DataFrame, column: str, required: list[str], enums: dict[str, list[str]], longest: dict[str, int]) -> DataFrame:
    """Rows with `problems`: fields that lack or exceed the contract of a JSON answer, in a fixed order."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, required))
    field = lambda k: F.get_json_object(column, f"$.{k}")
    found = [F.transform(F.array_except(want, keys), lambda k: F.concat(F.lit("missing:"), k)), F.transform(F.array_except(keys, want), lambda k: F.concat(F.lit("unknown:"), k))]
    for k, values in enums.items():
        found.append(F.when(field(k).isNotNull() & ~field(k).isin(*values), F.array(F.lit(f"enum:{k}"))).otherwise(F.array().cast("array<string>")))
    for k, n in longest.items():
        found.append(F.when(F.length(field(k)) > n, F.array(F.lit(f"length:{k}"))).otherwise(F.array().cast("array<string>")))
    return df.withColumn("problems", F.concat(*found))


def drift_gate(distances: DataFrame, most: float) -> DataFrame:
    return distances.agg(F.max("distance").alias("worst"), F.sum("missing_categories").alias("missing_categories")).withColumn("passed", (F.col("worst") <= most) & (F.col("missing_categories") == 0))


def lineage_mismatches(used: DataFrame, produced: DataFrame) -> DataFrame:
    """Artifacts whose recorded hash or version isn't the produced one, or that nothing produced."""
    p = produced.select("artifact", F.col("digest").alias("_digest"), F.col("version").alias("_version"))
    d = used.join(p, "artifact", "left")
    return d.filter(~(F.col("digest").eqNullSafe(F.col("_digest")) & F.col("version").eqNullSafe(F.col("_version")))).select("artifact", "digest", "version")
