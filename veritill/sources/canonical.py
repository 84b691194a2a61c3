"""Canonical examples as JSON lines: one nested row each, constraint values and attributes being free JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritill.sources import files

VERSION = "2.0"
SCHEMA = """schema_version string,
identity struct<example_id:string,group_id:string,parent_example_id:string,sequence_id:string,sequence_position:int>,
provenance struct<source_dataset:string,source_version:string,source_record_id:string,source_url:string,source_license:string,evidence_origin:string,mandate_origin:string,transformation:string,generator_version:string,acquired_at:timestamp,source_sha256:string,field_origins:map<string,string>>,
context struct<domain:string,locale:string,market:string,occurred_at:timestamp>,
mandate struct<objective_text:string,valid_from:timestamp,expires_at:timestamp,max_fulfillments:int,constraints:array<struct<constraint_id:string,type:string,operator:string,value:variant,amount_minor:bigint,currency:string,currency_exponent:int,source_span:string>>>,
cart struct<cart_id:string,merchant_id:string,merchant_category:string,evidence_source:string,evidence_trust:string,evidence_sufficiency:string,currency:string,currency_exponent:int,total_amount_minor:bigint,line_items:array<struct<line_item_id:string,source_product_id:string,description:string,quantity:int,amount_minor:bigint,attributes:map<string,variant>,evidence_text:string>>>,
state struct<fulfilled_amount_minor:bigint,fulfillment_count:int,prior_transaction_ids:array<string>,history_available:boolean>,
labels struct<deviation:string,semantic:array<struct<constraint_id:string,label:string,confidence:double>>,violation_types:array<string>,expected_treatment:string,label_source:string,reviewer_confidence:double>,
split struct<name:string,grouping_keys:array<string>>"""
SECTIONS = ["schema_version", "identity", "provenance", "context", "mandate", "cart", "state", "labels", "split"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Canonical examples; a line that doesn't fit the schema fails, keys that the schema doesn't have are passed over (see files.with_unknown_keys)."""
    return files.read_lines(spark, path, SCHEMA)


def write(df: DataFrame, path: str, in_order: bool = False) -> None:
    """One example a line, in order of their ids over all files, which are compressed; refuses to overwrite. in_order: the rows are sorted already."""
    d = df.select(*SECTIONS)
    (d if in_order else d.orderBy("identity.example_id")).write.mode("errorifexists").option("compression", "gzip").json(path)


#: How a JSON value begins, and for a number what follows it; any other text would cost the parser an exception.
_JSON = r'^[^!-~]*($|[\[{"]|true|false|null|-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?([^!-~]|$))'


def free(text: Column) -> Column:
    """A text as the JSON value it spells, else as a text."""
    return F.coalesce(F.when(text.rlike(_JSON), F.try_parse_json(text)), text.cast("variant"))


def value_of(c: Column) -> Column:
    """The value of a typed constraint: its list, its map or its amount."""
    return F.when(c["value_list"].isNotNull(), F.parse_json(F.to_json(c["value_list"]))).when(c["value_map"].isNotNull(), F.parse_json(F.to_json(c["value_map"]))).otherwise(c["amount_minor"].cast("variant"))


def of_examples(examples: DataFrame) -> DataFrame:
    """The canonical form of the rows of views.examples."""
    none = lambda kind: F.lit(None).cast(kind)
    exponent = lambda currency: F.when(currency == "JPY", 0).otherwise(2)
    constraint = lambda c: F.struct(c["constraint_id"].alias("constraint_id"), c["type"].alias("type"), F.lit("matches").alias("operator"), value_of(c).alias("value"), c["amount_minor"].alias("amount_minor"), c["currency"].alias("currency"), exponent(c["currency"]).alias("currency_exponent"), none("string").alias("source_span"))
    item = lambda i: F.struct(
        F.concat_ws("_", F.lit("item"), i["line_number"].cast("string"), i["part_key"].cast("string")).alias("line_item_id"), i["part_key"].cast("string").alias("source_product_id"), i["description"].alias("description"), i["quantity"].alias("quantity"),
        i["amount_minor"].alias("amount_minor"), F.transform_values(i["attributes"], lambda _, v: free(v)).alias("attributes"), i["description"].alias("evidence_text"),
    )
    d = examples.select(
        F.lit(VERSION).alias("schema_version"),
        F.struct("example_id", "group_id", "parent_example_id", none("string").alias("sequence_id"), none("int").alias("sequence_position")).alias("identity"),
        F.struct(F.lit("orders").alias("source_dataset"), F.lit("1").alias("source_version"), "source_record_id", F.lit("").alias("source_url"), F.lit("").alias("source_license"), F.lit("real_public").alias("evidence_origin"), F.lit("synthetic").alias("mandate_origin"), F.col("attack_family").alias("transformation"), none("string").alias("generator_version"), none("timestamp").alias("acquired_at"), none("string").alias("source_sha256"), F.create_map(F.lit("mandate"), F.lit("synthetic")).alias("field_origins")).alias("provenance"),
        F.struct("domain", "locale", F.upper("locale").alias("market"), F.col("occurred_at").cast("timestamp").alias("occurred_at")).alias("context"),
        F.struct(F.lit("buy what the cart says").alias("objective_text"), none("timestamp").alias("valid_from"), none("timestamp").alias("expires_at"), "max_fulfillments", F.transform("constraints", constraint).alias("constraints")).alias("mandate"),
        F.struct(F.concat(F.lit("cart_"), "example_id").alias("cart_id"), "merchant_id", "merchant_category", F.lit("merchant").alias("evidence_source"), F.lit("trusted").alias("evidence_trust"), "evidence_sufficiency", "currency", exponent(F.col("currency")).alias("currency_exponent"), "total_amount_minor", F.transform("items", item).alias("line_items")).alias("cart"),
        F.struct("fulfilled_amount_minor", "fulfillment_count", F.array().cast("array<string>").alias("prior_transaction_ids"), F.lit(True).alias("history_available")).alias("state"),
        F.struct(none("string").alias("deviation"), F.array().cast("array<struct<constraint_id:string,label:string,confidence:double>>").alias("semantic"), F.array().cast("array<string>").alias("violation_types"), none("string").alias("expected_treatment"), "label_source", none("double").alias("reviewer_confidence")).alias("labels"),
        F.struct(F.col("split").alias("name"), F.array("group_id", "source_record_id").alias("grouping_keys")).alias("split"),
    )
    return d.select(*SECTIONS)


def kind(value: Column) -> Column:
    """list, map, number, flag, text or none: what a free value holds."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), "none").when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "map").when(name == "BOOLEAN", "flag").when(name == "STRING", "text").otherwise("number")
    )


def constraint_values(df: DataFrame) -> DataFrame:
    """(example_id, constraint_id, type, kind, texts, entries, number) per constraint: its free value as what it holds."""
    c = df.select(F.col("identity.example_id").alias("example_id"), F.explode("mandate.constraints").alias("c")).select("example_id", "c.constraint_id", "c.type", kind(F.col("c.value")).alias("kind"), F.col("c.value").alias("value"))
    only = lambda k, c: F.when(F.col("kind") == k, c)
    return c.select("example_id", "constraint_id", "type", "kind", only("list", F.try_variant_get("value", "$", "array<string>")).alias("texts"), only("map", F.try_variant_get("value", "$", "map<string,string>")).alias("entries"), only("number", F.try_variant_get("value", "$", "double")).alias("number"))
