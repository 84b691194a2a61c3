"""Joins that carry a contract: completeness, exclusion, overlays and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def products_of(examples: DataFrame, products: DataFrame) -> DataFrame:
    """Judgements with their product, by id and locale."""
    return examples.join(products, ["product_id", "product_locale"])


def complete_sessions(sessions: DataFrame, products: DataFrame) -> DataFrame:
    """Sessions whose every listed product and next product are known, with the titles in order.

    sessions: session_id, previous (array), next. products: product_id, title. A session is exploded, joined
    once and gathered again, so a product that many sessions name is joined in parts by the adaptive plan. Unknown
    products leave with the join; a session that misses one is told by its count.
    """
    wanted = F.concat(F.transform("previous", lambda p: p), F.array("next"))
    # a length that may be null would be asked for twice, and the array be parsed for it
    flat = sessions.select("session_id", F.coalesce(F.size("previous"), F.lit(0)).alias("length"), F.posexplode(wanted).alias("place", "product_id"))
    found = flat.join(products.select("product_id", "title"), "product_id")
    g = found.groupBy("session_id", "length").agg(F.count("title").alias("known"), F.sort_array(F.collect_list(F.struct("place", "title"))).alias("all"))
    titles = F.col("all.title")
    return g.filter(F.col("known") == F.col("length") + 1).select("session_id", F.slice(titles, 1, F.col("length")).alias("previous_titles"), F.element_at(titles, -1).alias("next_title"))


def with_predictions(features: DataFrame, predictions: DataFrame, needs: Column, entailment: bool = False) -> DataFrame:
    """Rows with their semantic scores, defaults where none are needed, and a flag on those that miss needed ones."""
    names = ["semantic_contradiction", "semantic_neutral"] + (["semantic_entailment"] if entailment else [])
    df = features.join(predictions.select("example_id", *names, F.lit(True).alias("_scored")), "example_id", "left")
    df = df.withColumn("prediction_missing", needs & F.col("_scored").isNull())
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(1.0 if n.endswith("entailment") else 0.0)) for n in names}).drop("_scored")


RELATIONS = ("example_id", "group_id", "source_record_id")


def unrelated(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows that share no example, group or source with the excluded ones and aren't their children.

    A row without a parent matches nothing by it. Each key is an anti join on distinct keys.
    """
    for key in RELATIONS:
        df = df.join(excluded.select(key).distinct(), key, "left_anti")
    parents = excluded.select(F.col("example_id").alias("parent_example_id")).distinct()
    return df.join(parents, "parent_example_id", "left_anti")


def untainted_groups(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of groups that have no member related to the excluded ones."""
    clean = unrelated(df, excluded).select("example_id").distinct()
    tainted = df.join(clean, "example_id", "left_anti").select("group_id").distinct()
    return df.join(tainted, "group_id", "left_anti")


def audited(df: DataFrame, ledger: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows with the audited label of their group and family; the last ledger entry of a key counts."""
    keys = ["group_id", "attack_family"]
    last = Window.partitionBy(*keys).orderBy(*order)
    entries = ledger.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*keys, "audited_treatment")
    return df.join(entries, keys, "left")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): how many distinct keys are only on the left, only on the right, or on both sides."""
    x = a.select(F.col(key).alias("key")).distinct().withColumn("l", F.lit(1))
    y = b.select(F.col(key).alias("key")).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both")
    return x.join(y, "key", "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def all_keys(df: DataFrame, *columns: str) -> DataFrame:
    """(key): the distinct values of some columns together."""
    return df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("key")).distinct()


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key): the distinct keys that both sides have; roles that must be apart share none."""
    return a.select(F.col(key).alias("key")).intersect(b.select(F.col(key).alias("key")))


def missing_keys(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key): the distinct required keys that aren't there."""
    return required.select(F.col(key).alias("key")).subtract(present.select(F.col(key).alias("key")))


def overlay(base: DataFrame, better: DataFrame, key: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """The rows of base, with the columns of `better` where it has the key and `where` holds."""
    fresh = better.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_has"))
    use = F.col("_has").isNotNull() if where is None else F.col("_has").isNotNull() & where
    df = base.join(fresh, key, "left").withColumns({c: F.when(use, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns})
    return df.drop("_has", *(f"_new_{c}" for c in columns))


def completed(rows: DataFrame, predictions: DataFrame, key: str, infer) -> DataFrame:
    """All predictions: those that are there, and `infer` of the rows that lack one."""
    return predictions.unionByName(infer(rows.join(predictions.select(key), key, "left_anti")))


def cyclic_pairs(a: DataFrame, b: DataFrame, order_a: Column, order_b: Column, count_b: int) -> DataFrame:
    """Each row of a with row i % count_b of b, i being its place.

    Places come from ranks inside hash ranges plus the ranges' totals, so no task sorts the whole table.
    """
    x = with_place(a, order_a, "_i").withColumn("_k", F.col("_i") % count_b)
    y = with_place(b, order_b, "_k")
    return x.join(y, "_k").drop("_i", "_k")


def with_place(df: DataFrame, order: Column, name: str, buckets: int = 256) -> DataFrame:
    """Rows with their place from 0 in the order of a hex digest, in two steps."""
    d = df.withColumn("_o", order).withColumn("_b", F.conv(F.substring("_o", 1, 4), 16, 10).cast("int") * buckets / 65536)
    d = d.withColumn("_b", F.floor("_b"))
    sizes = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_s"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_o")) - 1
    return d.withColumn("_in", inside).join(F.broadcast(before), "_b").withColumn(name, (F.col("_in") + F.col("_before")).cast("bigint")).drop("_o", "_b", "_in", "_before")
