"""Histograms, profiles, distances and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritill.functions.scalars import ratio
from veritill.operators.ordered import joined_on


def histogram(df: DataFrame, column: str, missing: str = "UNREVIEWED") -> DataFrame:
    """(category, n), a null counting under its own name."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def histograms(df: DataFrame, columns: list[str], missing: str = "UNREVIEWED") -> DataFrame:
    """(dimension, category, n) of several columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("category")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.category").agg(F.count(F.lit(1)).alias("n"))


def prefixed_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key, n) with keys like split:train."""
    return histograms(df, columns).select(F.concat_ws(":", "dimension", "category").alias("key"), "n")


def total_variation(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Per dimension half the sum of differences of shares, and the categories that b lacks."""
    shares = []
    for df, side in ((a, "p"), (b, "q")):
        h = histograms(df, columns)
        total = F.sum("n").over(Window.partitionBy("dimension"))
        shares.append(h.select("dimension", "category", (F.col("n") / total).alias(side)))
    both = shares[0].join(shares[1], ["dimension", "category"], "full").na.fill(0.0, ["p", "q"])
    return both.groupBy("dimension").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("distance"), F.count(F.when(F.col("q") == 0, 1)).alias("missing_categories"))


def score_reduction(df: DataFrame, with_entailment: bool = False) -> DataFrame:
    """The strongest warnings of an example over its constraints, and the weakest entailment."""
    aggs = [F.max("contradiction").alias("semantic_contradiction"), F.max("neutral").alias("semantic_neutral")]
    return df.groupBy("example_id").agg(*aggs, *([F.min("entailment").alias("semantic_entailment")] if with_entailment else []))


def items_total(items: Column) -> Column:
    """Sum of amount times quantity."""
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, i: s + i["amount_minor"] * i["quantity"])


def first_by_hash(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the first in a hash order; only the order and the row travel."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(row, order).alias("row")).select("row.*")


def first_seen(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def key_digest(df: DataFrame, key: str) -> DataFrame:
    """Digest of the sorted distinct keys: leaves by hash prefix first, so no task holds them all."""
    leaf = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3)
    leaves = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), leaf.alias("leaf")).distinct().groupBy("leaf").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("d"))
    return leaves.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def small_key_digest(df: DataFrame, key: str) -> DataFrame:
    """sha256 of the sorted keys joined by line ends, for key sets that are known to be small."""
    return df.select(F.col(key).cast("string").alias("k")).distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("digest"))


def group_profile(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, rows, stratum): the sorted distinct tuples of a group as JSON."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.to_json(F.array_sort(F.collect_set(F.struct(*columns)))).alias("stratum"))


def transitions(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.concat_ws("->", a, b).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, a: str, b: str, dimensions: list[str]) -> DataFrame:
    """(dimension, category, transition, n, share) along each dimension apart, by grouping sets in one shuffle."""
    labelled = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category")) for d in dimensions))
    g = df.select(F.explode(labelled).alias("d"), F.concat_ws("->", a, b).alias("transition")).groupBy("d.dimension", "d.category", "transition").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension", "category")))


def resolve_reviews(reviews: DataFrame, adjudications: DataFrame, minimum: int = 2) -> DataFrame:
    """Per example: adjudicated, else resolved where enough reviews agree, else unresolved, with the mean confidence.

    Reviews are reduced to one row per example before they meet the adjudications.
    """
    signature = F.concat_ws("|", "deviation", "expected_treatment")
    r = reviews.groupBy("example_id").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_distinct(signature).alias("signatures"), F.min("deviation").alias("deviation"), F.min("expected_treatment").alias("expected_treatment"), F.avg("confidence").alias("confidence"),
    )
    a = adjudications.select("example_id", F.col("deviation").alias("final_deviation"), F.col("expected_treatment").alias("final_treatment"), F.col("confidence").alias("final_confidence"))
    both = r.join(a, "example_id", "full")
    settled = F.col("final_deviation").isNotNull()
    agreed = (F.col("reviews") >= minimum) & (F.col("signatures") == 1)
    pick = lambda final, own: F.when(settled, F.col(final)).when(agreed, F.col(own))
    return both.select(
        "example_id", F.coalesce("reviews", F.lit(0)).cast("bigint").alias("reviews"), F.when(settled, "adjudicated").when(agreed, "resolved").otherwise("unresolved").alias("state"),
        pick("final_deviation", "deviation").alias("deviation"), pick("final_treatment", "expected_treatment").alias("expected_treatment"), pick("final_confidence", "confidence").alias("confidence"),
    )


def group_weights(df: DataFrame, group: str, low: float = 0.5, high: float = 2.5) -> DataFrame:
    """Rows with a weight by the square root of inverse group size, clipped and brought to a mean of 1.

    Group sizes and the means come from one aggregate over groups; rows only join it.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    one = sizes.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_groups"))
    raw = joined_on(sizes, one, ()).withColumn("_raw", F.sqrt(F.col("_rows") / (F.col("_groups") * F.col("_n"))))
    raw = joined_on(raw, raw.agg((F.sum(F.col("_raw") * F.col("_n")) / F.sum("_n")).alias("_mean")), ())
    raw = raw.withColumn("_clipped", F.least(F.greatest(F.col("_raw") / F.col("_mean"), F.lit(low)), F.lit(high)))
    raw = joined_on(raw, raw.agg((F.sum(F.col("_clipped") * F.col("_n")) / F.sum("_n")).alias("_level")), ())
    return df.join(raw.withColumn("weight", F.col("_clipped") / F.col("_level")).select(group, "weight"), group)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) by inverse frequency."""
    w = Window.partitionBy()
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def conditional_shares(df: DataFrame, key: str, family: str, flag: Column) -> DataFrame:
    """Per key: rows, rate of the flag, its share among positives and negatives, and the mix of families as a map."""
    mix = df.groupBy(key, family).agg(F.count(F.lit(1)).alias("n"), F.sum(flag.cast("int")).alias("yes"))
    return mix.groupBy(key).agg(F.sum("n").alias("rows"), ratio(F.sum("yes"), F.sum("n")).alias("rate"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(family, "n")))).alias("families"))


def token_cost(df: DataFrame, model: str, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, cost) by a table of prices per million tokens in and out."""
    table = F.create_map(*(x for k, (i, o) in prices.items() for x in (F.lit(k), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")))))
    price = F.try_element_at(table, F.col(model))
    return df.groupBy(model).agg(F.sum((tokens_in * price["i"] + tokens_out * price["o"]) / 1e6).alias("cost"))


def trigger_rates(df: DataFrame, triggers: dict[str, Column]) -> DataFrame:
    """One row: the share of rows that each trigger fires on."""
    return df.agg(*(F.avg(c.cast("int")).alias(n) for n, c in triggers.items()))


def target_coverage(df: DataFrame, by: list[str], targets: dict[str, Column]) -> DataFrame:
    """(by, rows, ...): how many rows of each group have each kind of target."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *(F.count(F.when(c, 1)).alias(n) for n, c in targets.items()))


#: Tokens of a text up to which three packed counters of 21 bits hold their sums.
PACKED_TOKENS = 1 << 20


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket) per row: an 8-bit simhash of the [a-z0-9]+ tokens by count as two hex digits, `empty` without tokens.

    Tokens are hashed and summed inside their row, so nothing is exploded or shuffled. A byte's bits are added as three packed
    numbers, looked up in literal arrays; texts of more than a million tokens add them one bit at a time.
    """
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 63, 2), 16, 10).cast("int"))
    groups = [range(0, 3), range(3, 6), range(6, 8)]
    packed = [F.split(F.lit(",".join(str(sum(((h >> b) & 1) << (21 * (b - g[0])) for b in g)) for h in range(256))), ",").cast("array<bigint>") for g in groups]

    def bucket(h: Column) -> Column:
        n = F.size(h)
        sums = [_added(h, p) for p in packed]
        fast = [F.shiftright(sums[k], 21 * (b - g[0])).bitwiseAND(F.lit((1 << 21) - 1)) for k, g in enumerate(groups) for b in g]
        slow = [_added(F.transform(h, _bit(b)), None) for b in range(8)]
        # a bit is set if at least half of the tokens have it
        value = lambda counts: sum((F.when(2 * c >= n, 1 << b).otherwise(0) for b, c in enumerate(counts)), F.lit(0))
        code = F.when(n <= PACKED_TOKENS, value(fast)).otherwise(value(slow))
        return F.when(n == 0, "empty").otherwise(F.lower(F.lpad(F.hex(code), 2, "0")))

    # an array of one binds the hashes to a name, so that tokens are found once
    return df.select(key, F.element_at(F.transform(F.array(hashes), bucket), 1).alias("bucket"))


def _added(values: Column, table: Column | None) -> Column:
    """The sum of an array of numbers, or of what a table of 256 holds for them."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + (x if table is None else F.element_at(table, x + 1)))


def _bit(b: int):
    return lambda x: F.shiftright(x, b).bitwiseAND(F.lit(1))
