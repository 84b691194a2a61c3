"""Queries over sources: canonical lines, archives of CSV files, first rows in file order, digests of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritill.functions import scalars
from veritill.operators import joins
from veritill.sources import archives, canonical, files, storage, views

from .oracle import sql
from .registry import query

_CONSTRAINTS = """SELECT example_id, 'total_budget_' || cust_key AS constraint_id, 'number' AS kind, NULL AS texts, NULL AS entries, budget::DOUBLE AS number FROM v_examples
    UNION ALL SELECT example_id, 'prohibited_item_' || cust_key, 'list', 'Widget,old ring', NULL, NULL FROM v_examples WHERE cust_key % 3 = 0
    UNION ALL SELECT example_id, 'prohibited_category_' || cust_key, 'list', 'promo', NULL, NULL FROM v_examples WHERE cust_key % 4 = 0
    UNION ALL SELECT example_id, 'allowed_merchant_' || cust_key, 'list', array_to_string(list_transform(range(10), lambda k: 'mer_' || k), ','), NULL, NULL FROM v_examples WHERE cust_key % 5 = 0
    UNION ALL SELECT example_id, 'route_' || cust_key, 'map', NULL, 'destination=B' || cust_key % 3 || ',origin=A' || cust_key % 3, NULL FROM v_examples WHERE domain = 'travel'
    UNION ALL SELECT example_id, 'travel_dates_' || cust_key, 'map', NULL, 'outbound_date=2026-10-0' || cust_key % 3 || ',return_date=2026-11-0' || cust_key % 3, NULL FROM v_examples WHERE domain = 'travel' AND cust_key % 2 = 0
    UNION ALL SELECT example_id, 'semantic_attribute_' || cust_key, 'list', 'warranty', NULL, NULL FROM v_examples WHERE cust_key % 2 = 1"""


def canonical_copy(spark, sf_dir, top: str):
    """The examples written as canonical lines, in a folder for each stretch, and read again."""
    with storage.brief_shuffles(spark):
        for k, examples in enumerate(views.sorted_examples(spark, sf_dir)):
            canonical.write(canonical.of_examples(examples), f"{top}/lines/{k:05}", in_order=True)
    return canonical.read(spark, f"{top}/lines/*")


@query("s4_canonical_constraints", sql(_CONSTRAINTS))
def s4_canonical_constraints(spark, sf_dir):
    """Free values of all constraints after a round trip through JSON lines: scalars, lists and maps."""
    top = f"{storage.checkpoint_dir(spark)}/canonical-{uuid.uuid4().hex}"
    values = canonical.constraint_values(canonical_copy(spark, sf_dir, top))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("entries")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    out = storage.stored(values.select("example_id", "constraint_id", "kind", F.array_join("texts", ",").alias("texts"), entries.alias("entries"), "number"))
    storage.delete(spark, top)
    return out


@query("s4_canonical_items", sql("""SELECT example_id, total_amount_minor, parent_example_id, items, stops, warranted, unwarranted, economy FROM v_examples JOIN (SELECT order_key, count(*) AS items, CAST(sum(part_key % 2) AS BIGINT) AS stops, count(*) FILTER (part_key % 4 = 0) AS warranted, count(*) FILTER (part_key % 4 = 1) AS unwarranted, count(*) FILTER (part_key % 2 = 0) AS economy FROM v_lines GROUP BY order_key) USING (order_key)"""))
def s4_canonical_items(spark, sf_dir):
    """Attributes of line items after the round trip: numbers, flags and texts, each read as what it is."""
    top = f"{storage.checkpoint_dir(spark)}/canonical-{uuid.uuid4().hex}"
    d = canonical_copy(spark, sf_dir, top).select("identity.*", "cart.*")
    read = lambda name, kind: lambda i: F.try_variant_get(i["attributes"].getItem(name), "$", kind)
    count = lambda found: F.size(F.filter("line_items", found)).cast("bigint")
    warranty, cabin, stops = read("warranty", "boolean"), read("cabin", "string"), read("stops", "bigint")
    out = d.select(
        "example_id", "total_amount_minor", "parent_example_id", F.size("line_items").cast("bigint").alias("items"),
        F.aggregate(F.transform("line_items", stops), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint"))).alias("stops"),
        count(warranty).alias("warranted"), count(lambda i: ~warranty(i)).alias("unwarranted"), count(lambda i: cabin(i) == "economy").alias("economy"),
    )
    out = storage.stored(out)
    storage.delete(spark, top)
    return out


def _lines(rows, key, kind: str, layout: tuple[int, int], header: str, *columns):
    """CSV lines of members, dealt by a key, each with the header in a case of its own."""
    several, members = layout
    placed = lambda k: (F.concat(F.lit(f"{kind}_"), F.pmod(k, F.lit(several)).cast("string")).alias("archive"), F.concat(F.lit("part_"), F.pmod(k, F.lit(members)).cast("string")).alias("member"))
    key = F.coalesce(key.cast("bigint"), F.lit(0))
    own = rows.select(*placed(key), key.alias("place"), F.to_csv(F.struct(*columns), {"escape": '"'}).alias("line"))
    heads = rows.sparkSession.range(members).select(*placed(F.col("id")), F.lit(None).cast("bigint").alias("place"), F.when(F.col("id") % 2 == 0, header.upper()).otherwise(header.title()).alias("line"))
    return own.unionByName(heads)


_SESSIONS = """WITH f AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS p FROM lineitem),
    t AS (SELECT k, n, i, p, p_name AS title FROM f JOIN part ON p = p_partkey WHERE n > 1)
    SELECT CAST(k AS VARCHAR) AS session_id, string_agg(title, ';' ORDER BY i) FILTER (i < n) AS previous_titles, max(title) FILTER (i = n) AS next_title FROM t GROUP BY k HAVING count(*) FILTER (p % 5 = 0) = 0"""


@query("s7_s9_archived_sessions", _SESSIONS)
def s7_s9_archived_sessions(spark, sf_dir):
    """Products and sessions as CSV members of archives, read in parallel with columns in any case; sessions parsed and joined whole."""
    top = f"{storage.checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    part, line = views.table(spark, sf_dir, "part"), views.table(spark, sf_dir, "lineitem")
    products = _lines(part.filter("p_partkey % 5 <> 0"), F.col("p_partkey"), "products", archives.layout(part.count(), 2, 2), "id,title", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"))
    bought = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("'p"), x["l_partkey"].cast("string"), F.lit("'"))).alias("p")).filter(F.size("p") > 1)
    key = F.col("l_orderkey")
    previous = F.concat(F.lit("["), F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "\n "), F.lit("]"))
    sessions = _lines(bought, key, "sessions", archives.layout(line.count(), 3, 3), "session_id,prev_items,next_item", key.alias("session_id"), previous.alias("prev_items"), F.replace(F.element_at("p", -1), F.lit("'"), F.lit("")).alias("next_item"))
    archives.write(products, f"{top}/products").count()
    archives.write(sessions, f"{top}/sessions").count()
    items = archives.read(spark, f"{top}/products").select(archives.field("id").alias("product_id"), archives.field("title").alias("title"))
    asked = archives.read(spark, f"{top}/sessions").select(archives.field("Session_ID").alias("session_id"), scalars.quoted_items(archives.field("prev_items")).alias("previous"), archives.field("next_item", "next").alias("next"))
    found = joins.complete_sessions(asked, items)
    out = storage.stored(found.select("session_id", F.array_join("previous_titles", ";").alias("previous_titles"), "next_title"))
    storage.delete(spark, top)
    return out


@query("l2_first_rows", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events WHERE event_type IN ('click', 'view')) WHERE place <= (SELECT count(*) // 7 FROM events)")
def l2_first_rows(spark, sf_dir):
    """The first clicks and views, a seventh of the table's rows in number, of a table of many files in source order."""
    top = f"{storage.checkpoint_dir(spark)}/first-{uuid.uuid4().hex}"
    events = views.table(spark, sf_dir, "events")
    events.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").write.parquet(f"{top}/rows")
    out = storage.stored(files.first_rows(spark, f"{top}/rows", events.count() // 7, "event_type in ('click', 'view')").select("event_id", "place"))
    storage.delete(spark, top)
    return out


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("v1_checksums")
def v1_checksums(spark, sf_dir):
    """(name, length, sha256) of every file of every table, and the digest of the whole tree."""
    return files.tree_checksums(spark, sf_dir, [f"{sf_dir}/{n}.parquet" for n in TABLES])
