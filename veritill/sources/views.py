"""Mandates, carts, examples, predictions and reviews as views of the driver's commerce tables.

Every view is a select, join or aggregate; nothing is read twice that a query doesn't ask for, and columns
that a query drops are pruned down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritill.functions.hashing import hex_number, sha, split_name
from veritill.sources import storage

CURRENCIES = ("USD", "SGD", "EUR", "GBP", "JPY")
DOMAINS = {"AUTOMOBILE": "travel", "HOUSEHOLD": "retail", "FURNITURE": "retail", "MACHINERY": "procurement", "BUILDING": "dining"}
FAMILIES = ("none", "cumulative_overspend", "near_budget_match", "missing_required_evidence", "unrelated_add_on")
#: Relevance letter of a priority, and what it says about the cart.
RELEVANCE = {"1-URGENT": "I", "2-HIGH": "C", "3-MEDIUM": "S", "4-NOT SPECIFIED": "E", "5-LOW": "E"}
#: Orders whose examples are put together and sorted at once, which bounds the disk that shuffles take.
STRETCH = 2_000_000
CONSTRAINT = "struct<constraint_id:string,type:string,value_list:array<string>,value_map:map<string,string>,amount_minor:bigint,currency:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h8(*parts: Column | str) -> Column:
    return hex_number(sha(*parts), 8)


def pick(values: dict[str, str] | tuple[str, ...], by: Column) -> Column:
    """The value of a key, or the value at an index from 0."""
    if isinstance(values, dict):
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), by)
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_key, line_number, part_key, merchant_key, description, category, quantity, amount_minor, returned, per line."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("merchant_key"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.bround(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("bigint").alias("amount_minor"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )


def order_currency(order: Column, region: Column) -> Column:
    return F.when(order % 17 == 0, "USD").otherwise(pick(CURRENCIES, region))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cust_key, domain, region, locale per customer; the nation table is a small dimension."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    c = c.join(nation, c.c_nationkey == nation.n_nationkey)
    return c.select(F.col("c_custkey").alias("cust_key"), pick(DOMAINS, F.col("c_mktsegment")).alias("domain"), F.col("n_regionkey").alias("region"), F.when(F.col("n_regionkey") == 4, "jp").otherwise("us").alias("locale"))


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cart per order that has lines: its items in line order, total, merchant, category and evidence."""
    return line_items(spark, sf_dir).groupBy("order_key").agg(*_cart(F.col))


def _cart(of: Callable[[str], Column], there: Column | None = None) -> list[Column]:
    """What a cart has of the lines of its order; of: a line's column, there: whether a row has a line."""
    item = F.struct(*(of(c).alias(c) for c in ("line_number", "part_key", "merchant_key", "quantity", "amount_minor", "description", "category")))
    there = F.lit(True) if there is None else there
    rich = F.transform(
        F.array_sort(F.collect_list(F.when(there, item))),
        lambda i: F.struct(
            i["line_number"].alias("line_number"), i["part_key"].alias("part_key"), i["quantity"].alias("quantity"), i["amount_minor"].alias("amount_minor"), i["description"].alias("description"), i["category"].alias("category")
        ),
    )
    return [
        rich.alias("items"),
        _total(of).alias("total_amount_minor"),
        F.count(F.when(there, 1)).alias("line_item_count"),
        F.concat(F.lit("mer_"), F.min(of("merchant_key")).cast("string")).alias("merchant_id"),
        F.max(of("category")).alias("merchant_category"),
        F.when(F.max(of("returned").cast("int")) == 1, "ambiguous").otherwise("sufficient").alias("evidence_sufficiency"),
    ]


def _total(of: Callable[[str], Column]) -> Column:
    return F.sum(of("amount_minor") * of("quantity"))


def with_attributes(items: Column, order: Column, first: bool = False) -> Column:
    """The items with a map of attributes derived from their keys; with first, that of all but the first item is null."""

    def of(i: Column, n: Column) -> Column:
        p = i["part_key"]
        text = lambda prefix, k: F.concat(F.lit(prefix), (k % 3).cast("string"))
        pairs = (
            ("origin", F.when(order % 7 != 0, text("a", order))),
            ("destination", text("b", p)),
            ("outbound_date", text("2026-10-0", order)),
            ("return_date", F.when(order % 11 != 0, text("2026-11-0", p))),
            ("warranty", F.when(p % 4 == 0, "true").when(p % 4 == 1, "false")),
            ("cabin", F.when(p % 2 == 0, "economy")),
            ("stops", (p % 2).cast("string")),
        )
        entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull())
        attributes = F.when(n == 0, F.map_from_entries(entries)) if first else F.map_from_entries(entries)
        return F.struct(*(i[k].alias(k) for k in ("line_number", "part_key", "quantity", "amount_minor", "description", "category")), attributes.alias("attributes"))

    return F.transform(items, of)


def mandate_columns(cust: Column, region: Column, domain: Column) -> dict[str, Column]:
    """max_fulfillments and constraints of a customer's mandate."""
    h = h8("mandate", cust)
    none, no_map, no_list = F.lit(None), F.lit(None).cast("map<string,string>"), F.lit(None).cast("array<string>")

    def constraint(kind: str, values: Column | None = None, mapping: Column | None = None, amount: Column | None = None, currency: Column | None = None) -> Column:
        return F.struct(
            F.concat(F.lit(f"{kind}_"), cust.cast("string")).alias("constraint_id"),
            F.lit(kind).alias("type"),
            (values if values is not None else no_list).alias("value_list"),
            (mapping if mapping is not None else no_map).alias("value_map"),
            (amount if amount is not None else none).cast("bigint").alias("amount_minor"),
            (currency if currency is not None else none).cast("string").alias("currency"),
        ).cast(CONSTRAINT)

    maybe = lambda cond, c: F.when(cond, F.array(c)).otherwise(F.array().cast(f"array<{CONSTRAINT}>"))
    route = F.create_map(F.lit("origin"), F.concat(F.lit("A"), (cust % 3).cast("string")), F.lit("destination"), F.concat(F.lit("B"), (cust % 3).cast("string")))
    dates = F.create_map(F.lit("outbound_date"), F.concat(F.lit("2026-10-0"), (cust % 3).cast("string")), F.lit("return_date"), F.concat(F.lit("2026-11-0"), (cust % 3).cast("string")))
    allowed = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("mer_"), k.cast("string")))
    constraints = F.concat(
        F.array(constraint("total_budget", amount=5_000_000 + (h % 181) * 250_000, currency=pick(CURRENCIES, region))),
        maybe(cust % 3 == 0, constraint("prohibited_item", F.array(F.lit("Widget"), F.lit("old ring")))),
        maybe(cust % 4 == 0, constraint("prohibited_category", F.array(F.lit("promo")))),
        maybe(cust % 5 == 0, constraint("allowed_merchant", allowed)),
        maybe(domain == "travel", constraint("route", mapping=route)),
        maybe((domain == "travel") & (cust % 2 == 0), constraint("travel_dates", mapping=dates)),
        maybe(cust % 2 == 1, constraint("semantic_attribute", F.array(F.lit("warranty")))),
    )
    return {"max_fulfillments": (1 + h % 4).cast("int"), "constraints": constraints}


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What headers takes from the tables."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = customers(spark, sf_dir)
    return o.join(c, o.o_custkey == c.cust_key).select(
        F.col("o_orderkey").alias("order_key"), "cust_key", "domain", "region", "locale", F.col("o_orderdate").alias("occurred_at"), pick(RELEVANCE, F.col("o_orderpriority")).alias("relevance"),
        pick({"P": "weak_policy", "F": "llm_assisted", "O": "deterministic_policy"}, F.col("o_orderstatus")).alias("label_source"),
    )


def example_id(order: Column) -> Column:
    return F.concat(F.lit("ex_"), order.cast("string"))


def _named(df: DataFrame) -> DataFrame:
    """The rows of _headers, or more columns, with the names and labels that follow from their keys."""
    key, cust = F.col("order_key"), F.col("cust_key")
    text = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    return df.withColumns(
        {
            "example_id": example_id(key),
            "group_id": text("grp_", cust),
            "source_record_id": text("src_", (key * 7) % 5000),
            "parent_example_id": F.when(key % 6 == 5, example_id(key - 1)),
            "attack_family": pick(FAMILIES, key % 5),
            "split": F.when(cust.isNotNull(), split_name(text("grp_", cust))),
            "currency": order_currency(key, F.col("region")),
        }
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, labels and provenance, one row per order, before its cart is known."""
    return _named(_headers(spark, sf_dir)).select("order_key", "cust_key", "domain", "region", "locale", "example_id", "group_id", "source_record_id", "parent_example_id", "occurred_at", "relevance", "attack_family", "label_source", "split", "currency")


def scores(example_id: Column) -> dict[str, Column]:
    """Semantic class probabilities and a risk probability with ties, from hashes of the id."""
    parts = [h8(f"nli{k}", example_id) % 1000 + 1 for k in range(3)]
    total = parts[0] + parts[1] + parts[2]
    names = ("semantic_contradiction", "semantic_neutral", "semantic_entailment")
    return {n: p / total for n, p in zip(names, parts, strict=True)} | {"probability": (h8("risk", example_id) % 101) / 100}


def _with_mandates(df: DataFrame, for_rules: bool) -> DataFrame:
    """Headers with carts and what came before them, with mandate, state and attributes."""
    df = df.withColumns(mandate_columns(F.col("cust_key"), F.col("region"), F.col("domain")))
    spent = F.when(F.col("position") % 3 == 1, F.lit(0).cast("bigint")).otherwise(F.coalesce("previous_total", F.lit(0).cast("bigint")))
    return df.withColumns(
        {
            "fulfilled_amount_minor": spent,
            "fulfillment_count": ((F.col("position") - 1) % 4).cast("int"),
            "items": with_attributes(F.col("items"), F.col("order_key"), for_rules),
        }
    ).drop("previous_total")


def _with_previous(df: DataFrame) -> DataFrame:
    before = Window.partitionBy("cust_key").orderBy("occurred_at", "order_key")
    return df.withColumns({"position": F.row_number().over(before), "previous_total": F.lag("total_amount_minor").over(before)})


def examples(spark: SparkSession, sf_dir: str, for_rules: bool = False) -> DataFrame:
    """Canonical examples: header, mandate, cart and state of each order that has lines.

    For rules, which read the attributes of the first item alone, those of other items are null: making them costs as much as the rules.
    """
    return _with_mandates(_with_previous(headers(spark, sf_dir).join(carts(spark, sf_dir), "order_key")), for_rules)


def sorted_examples(spark: SparkSession, sf_dir: str, stretch: int = STRETCH) -> Iterator[DataFrame]:
    """The rows of examples in order of their ids, a stretch of some orders at a time; write one before the next is asked for, and all, as the end deletes what they read.

    Lines with their products, and headers with what came before them, are stored once, in a folder for each stretch. A stretch deals
    both out by ranges of the id in one shuffle and puts them together there, so no cart is shuffled; constraints, attributes and other
    names follow after the sort.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey").filter("o_orderkey is not null")
    n = orders.count()
    parts = max(1, -(-n // stretch))
    ids = example_id(F.col("o_orderkey"))
    # the sample settles how even the stretches are, not what comes out
    seen = sorted((r[0] for r in orders.select(ids).sample(False, min(1.0, 1_000 * parts / n), 7).collect()), key=str.encode) if parts > 1 else []
    bounds = sorted({seen[k * len(seen) // parts] for k in range(1, parts)}, key=str.encode) if seen else []
    placed = lambda df: df.withColumn("example_id", example_id(F.col("order_key"))).withColumn("stretch", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("example_id"))) if bounds else F.lit(0))
    lines = storage.stored(placed(line_items(spark, sf_dir).filter("order_key is not null")).drop("example_id"), by=("stretch",))
    totals = lines.groupBy("order_key").agg(_total(F.col).alias("total_amount_minor"))
    heads = storage.stored(placed(_with_previous(_headers(spark, sf_dir).join(totals, "order_key")).drop("total_amount_minor")).drop("example_id"), by=("stretch",))
    try:
        for k in range(len(bounds) + 1):
            line, head = (df.filter(F.col("stretch") == k).drop("stretch").select("order_key", F.struct("*").alias(name)) for df, name in ((lines, "line"), (heads, "head")))
            rows = line.unionByName(head, allowMissingColumns=True).withColumn("example_id", example_id(F.col("order_key")))
            df = rows.repartitionByRange("example_id").groupBy("order_key", "example_id").agg(*_cart(lambda c: F.col("line")[c], F.col("line").isNotNull()), F.collect_list("head").alias("heads"))
            df = df.filter("line_item_count > 0").withColumn("head", F.explode("heads")).drop("order_key", "heads").sortWithinPartitions("example_id")
            yield _with_mandates(_named(df.select("*", "head.*").drop("head")), False)
    finally:
        storage.release(lines, heads)


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evaluation reads per example: label, family, rule counts, semantic scores and a probability, all from its header."""
    h = headers(spark, sf_dir).select("example_id", "group_id", "split", "domain", "locale", "attack_family", "relevance", "label_source")
    expected = pick({"E": "APPROVE", "S": "APPROVE", "C": "STEP_UP", "I": "HOLD"}, F.col("relevance"))
    fails = h8("fail", F.col("example_id")) % 40
    return h.withColumns(
        scores(F.col("example_id"))
        | {
            "expected_treatment": expected,
            "label": (expected != "APPROVE").cast("int"),
            "hard_fail_count": F.when(fails == 0, 2).when(fails == 1, 1).otherwise(0),
            "critical_hold_count": F.when(fails == 0, 1).otherwise(0),
        }
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of examples: three reviewers, a verdict per event; the same reviewer may come again."""
    e = table(spark, sf_dir, "events")
    verdict = pick({"view": "MATCH", "click": "MATCH", "purchase": "MATCH", "signup": "AMBIGUOUS", "error": "VIOLATION"}, F.col("event_type"))
    return e.select(
        "event_id", F.col("ts").alias("created_at"), F.concat(F.lit("ex_"), (F.col("event_id") % 3000).cast("string")).alias("example_id"), F.concat(F.lit("rev_"), (F.col("user_id") % 3).cast("string")).alias("reviewer_id"),
        verdict.alias("deviation"), pick({"MATCH": "APPROVE", "AMBIGUOUS": "STEP_UP", "VIOLATION": "HOLD"}, verdict).alias("expected_treatment"), F.round(F.col("value") / 500, 4).alias("confidence"), "event_type", "user_id", "value",
    )


def adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final verdicts on some examples: the first error event of those whose number divides by 7."""
    r = reviews(spark, sf_dir).filter(F.substring("example_id", 4, 9).cast("int") % 7 == 0).filter("event_type = 'error'")
    first = Window.partitionBy("example_id").orderBy("created_at", "event_id")
    return r.withColumn("n", F.row_number().over(first)).filter("n = 1").select("example_id", "deviation", "expected_treatment", "confidence", F.col("reviewer_id").alias("adjudicator_id"))
