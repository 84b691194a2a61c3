"""Running totals and places over a whole table in two steps, so that no task holds more than a range of it.

Rows are dealt into ranges of their order; the ranges' totals, of which there are few per group, are summed in
order, and inside a range a window goes on from the total before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritill.sources import storage

#: Rows that a range should hold, and the most ranges of a numeric order; a range is sorted by one task, which spills.
RANGE_ROWS = 500_000
MOST_RANGES = 4_096
#: Rows up to which Spark itself passes on only the first rows of a window's groups.
GROUP_LIMIT = 1_000


def ranges_of(df: DataFrame, rows: int | None = None) -> int:
    """How many ranges the rows of a frame are dealt into, by their number; at least 16."""
    return max(16, min(MOST_RANGES, -(-df.count() // (rows or RANGE_ROWS))))


def joined_on(left: DataFrame, right: DataFrame, keys: tuple[str, ...] | list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls are equal; without keys, right has one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*(F.col(k).alias(f"_on_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys))
    return left.join(renamed, same, how).drop(*(f"_on_{k}" for k in keys))


def with_range(df: DataFrame, order: str, by: tuple[str, ...] | list[str] = (), ranges: int | None = None) -> DataFrame:
    """df with `_range`: how many of the approximate quantiles of its group are below the row's number."""
    ranges = ranges or ranges_of(df)
    cuts = df.groupBy(*by).agg(F.percentile_approx(order, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), 20_000).alias("_cuts"))
    return joined_on(df, cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")


def _before(df: DataFrame, sums: dict[str, Column], by: list[str], order: Column) -> DataFrame:
    """(by, _range, _before_name...): the totals of all ranges before each."""
    totals = df.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_range", *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums))


def running_totals(df: DataFrame, order: str, sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """df with the total of a column over all rows of the group up to each, for (name: column) of sums.

    order is a number that no two rows of a group share. The frame is stored, since ranges, totals and windows each read it.
    """
    df = storage.stored(df)
    turn = (lambda c: F.col(c).desc()) if descending else F.col
    d = with_range(df, order, by)
    before = _before(d, {n: F.col(c) for n, c in sums.items()}, list(by), turn("_range"))
    inside = Window.partitionBy(*by, "_range").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = joined_on(d.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}), before, [*by, "_range"])
    return d.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_range", *(f"_before_{n}" for n in sums))


def hashed_places(df: DataFrame, digest: Column, key: str, by: list[str], name: str) -> DataFrame:
    """df with the place, from 1, of each row of its group in the order of a hex digest and then the key; ranges are told by the first digits, as many as the number of rows asks for."""
    digits = next(k for k in range(1, 8) if 16**k >= ranges_of(df) or k == 7)
    d = df.withColumns({"_digest": digest, "_range": F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")})
    before = _before(d, {"rows": F.lit(1)}, by, F.col("_range"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_digest", key))
    return joined_on(d.withColumn(name, inside), before, [*by, "_range"]).withColumn(name, (F.col(name) + F.col("_before_rows")).cast("bigint")).drop("_digest", "_range", "_before_rows")


def scored_places(df: DataFrame, score: str, digest: Column, key: str, by: list[str], name: str) -> DataFrame:
    """df with the place, from 1, of each row of its group by a number, then a hex digest, then the key."""
    ties = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_ties"))
    below = running_totals(ties, score, {"_upto": "_ties"}, tuple(by)).select(*by, score, (F.col("_upto") - F.col("_ties")).alias("_below"))
    d = hashed_places(df, digest, key, [*by, score], name)
    return joined_on(d, below, [*by, score]).withColumn(name, F.col(name) + F.col("_below")).drop("_below")


def _below(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are below a name, found in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    count = lambda names: F.size(F.filter(names, lambda b: b < key))
    # the group that a name falls in is the last one whose first bound is below it
    group = count(F.array(*(F.lit(g[0]) for g in groups)))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.greatest(group, F.lit(1)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + count(inside))


def named_places(df: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """df with the place, from 1, of each row of its group in the order of a name; ranges are cut by quantiles of a sample of the names."""
    ranges, n = ranges_of(df), max(1, df.count())
    text = F.col(key).cast("string")
    # the sample settles how even the ranges are, not what comes out
    seen = sorted(r[0] for r in df.select(text).filter(text.isNotNull()).sample(False, min(1.0, 64 * ranges / n), 7).collect())
    bounds = sorted({seen[k * len(seen) // ranges] for k in range(1, ranges)}, key=lambda t: t.encode()) if seen else []
    d = df.withColumn("_range", F.coalesce(_below(text, bounds), F.lit(0)) if bounds else F.lit(0))
    before = _before(d, {"rows": F.lit(1)}, by, F.col("_range"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(text))
    return joined_on(d.withColumn(name, inside), before, [*by, "_range"]).withColumn(name, (F.col(name) + F.col("_before_rows")).cast("bigint")).drop("_range", "_before_rows")


def places(df: DataFrame, order: list, by: list[str], name: str) -> DataFrame:
    """df with the place, from 1, of each row of its group in any order, from a stored table that was dealt into ranges of that order."""
    ranged = storage.stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    before = _before(ranged, {"rows": F.lit(1)}, by, F.col("_range"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return joined_on(ranged.withColumn(name, inside), before, [*by, "_range"]).withColumn(name, (F.col(name) + F.col("_before_rows")).cast("bigint")).drop("_range", "_before_rows")


def first_by_hash(df: DataFrame, digest: Column, key: str, by: list[str], n: int | Column, name: str) -> DataFrame:
    """The rows of each group whose place in hash order is at most n, with their place: by a window that passes on n rows, or above its limit in two steps."""
    if isinstance(n, int) and n <= GROUP_LIMIT:
        d = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(digest, key)).cast("bigint"))
    else:
        d = hashed_places(df, digest, key, by, name)
    return d.filter(F.col(name) <= n)


def exact_percentiles(df: DataFrame, column: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, p0, p1, ...): percentiles by linear interpolation, from one row per distinct value; nulls are left out."""
    values = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    d = running_totals(values, column, {"_upto": "_n"}, by)
    d = joined_on(d, values.groupBy(*by).agg(F.sum("_n").alias("_all")), by)
    out = []
    for k, share in enumerate(shares):
        at = F.lit(share) * (F.col("_all") - 1)
        # the value at a place from 0 is the least one with more rows up to it
        low, high = (F.min(F.when(F.col("_upto") > f(at), F.col(column))) for f in (F.floor, F.ceil))
        rest = F.max(at - F.floor(at))
        out.append((low + (high - low) * rest).alias(f"p{k}"))
    return d.groupBy(*by).agg(*out)
