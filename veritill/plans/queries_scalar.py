"""Queries over hashes, scalar functions, sources and adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritill.functions import hashing, scalars
from veritill.operators import aggregates, ordered, transforms
from veritill.sources import files, views

from .oracle import h, h8, split, sql
from .registry import query


@query("x1_split_buckets", sql("SELECT split, count(*) AS n, count(DISTINCT group_id) AS groups FROM v_headers GROUP BY split"))
def x1_split_buckets(spark, sf_dir):
    return views.headers(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"))


@query("x1_smoke_splits", f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN b < 60 THEN 'train' WHEN b < 75 THEN 'validation' WHEN b < 85 THEN 'test' ELSE 'golden' END AS split FROM (SELECT {h8('c_custkey')} % 100 AS b FROM customer)) GROUP BY split")
def x1_smoke_splits(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select("c_custkey")
    return c.groupBy(hashing.split_name(F.col("c_custkey"), None, hashing.SMOKE_SPLITS).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("x2_synthetic_budget", f"SELECT o_orderkey, 5000 + {h(12, 'o_orderkey')} % 181 * 250 AS budget, greatest(1, CAST(round_even((5000 + {h(12, 'o_orderkey')} % 181 * 250) * 0.8::DOUBLE, 0) AS BIGINT)) AS amount FROM orders")
def x2_synthetic_budget(spark, sf_dir):
    b = transforms.synthetic_budget(F.col("o_orderkey").cast("string"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", b.alias("budget"), transforms.budget_share(b).alias("amount"))


@query("x3_x4_folds", "SELECT o_orderkey, CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT % 7 AS INTEGER) AS fold64, CAST(list_sum(list_transform(string_split(sha256(CAST(o_orderkey AS VARCHAR)), ''), lambda d: ('0x' || d)::INTEGER)) % 5 AS INTEGER) AS fold5 FROM orders")
def x3_x4_folds(spark, sf_dir):
    d = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return views.table(spark, sf_dir, "orders").select("o_orderkey", hashing.fold64(d, 7).alias("fold64"), hashing.fold_of_five(d).alias("fold5"))


_SIM = " + ".join(f"CASE WHEN sum(CASE WHEN (b >> {k}) & 1 = 1 THEN n ELSE -n END) >= 0 THEN {1 << k} ELSE 0 END" for k in range(8))


@query(
    "x5_simhash",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n, ('0x' || substr(sha256(w), 63, 2))::INTEGER AS b FROM w GROUP BY ALL),
    s AS (SELECT doc_id, lower(printf('%02x', CAST({_SIM} AS INTEGER))) AS bucket FROM c GROUP BY doc_id) SELECT doc_id, coalesce(bucket, 'empty') AS bucket FROM documents LEFT JOIN s USING (doc_id)""",
)
def x5_simhash(spark, sf_dir):
    return aggregates.simhash(views.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("x6_fingerprint", "SELECT vec AS id, substr(sha256(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda w: w <> '')))[1:16], ' ')), 1, 12) AS fingerprint FROM (SELECT conv_id * 1000 + turn AS vec, text AS t FROM conversations)")
def x6_fingerprint(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), hashing.fingerprint(F.col("text"), 16, 12).alias("fingerprint"))


@query(
    "x7_x8_buckets",
    sql("""SELECT size_bucket, utilisation, count(*) AS n FROM (SELECT CASE WHEN line_item_count <= 1 THEN 'lte_1' WHEN line_item_count <= 2 THEN 'lte_2' WHEN line_item_count <= 4 THEN 'lte_4' ELSE 'gt_4' END AS size_bucket,
    CASE WHEN total_amount_minor / budget <= 0.5 THEN 'lte_50' WHEN total_amount_minor / budget <= 0.9 THEN 'lte_90' WHEN total_amount_minor / budget < 1 THEN 'lt_100' WHEN total_amount_minor = budget THEN 'eq_100' ELSE 'gt_100' END AS utilisation FROM v_examples) GROUP BY ALL"""),
)
def x7_x8_buckets(spark, sf_dir):
    budgets = F.transform(F.filter("constraints", lambda c: c["type"] == "total_budget"), lambda c: c["amount_minor"])
    df = views.examples(spark, sf_dir).select(scalars.count_bucket(F.col("line_item_count"), (1, 2, 4)).alias("size_bucket"), scalars.utilisation_bucket(F.col("total_amount_minor"), budgets).alias("utilisation"))
    return df.groupBy("size_bucket", "utilisation").agg(F.count(F.lit(1)).alias("n"))


@query("x7_text_buckets", "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN length(text) <= 256 THEN 'lte_256' WHEN length(text) <= 1024 THEN 'lte_1024' WHEN length(text) <= 4096 THEN 'lte_4096' ELSE 'gt_4096' END AS bucket FROM documents) GROUP BY bucket")
def x7_text_buckets(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").groupBy(scalars.count_bucket(F.length("text"), (256, 1024, 4096)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# three class scores from the whole vector: every third value, added up
_SOFT = f"list_transform([{', '.join(f'list_sum(list_transform(embedding[{k}:64:3], lambda x: x::DOUBLE))' for k in (1, 2, 3))}], lambda x: exp(x / 1.5))"


@query("x10_softmax", f"SELECT vec_id, round(p[1] / list_sum(p), 9) AS contradiction, round(p[2] / list_sum(p), 9) AS neutral, round(p[3] / list_sum(p), 9) AS entailment FROM (SELECT vec_id, {_SOFT} AS p FROM embeddings)")
def x10_softmax(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    p = scalars.softmax(scalars.folded(F.col("embedding"), 3), 1.5)
    return e.select("vec_id", p.alias("p")).select("vec_id", *(F.round(F.col("p")[k], 9).alias(n) for k, n in enumerate(scalars.CLASSES)))


@query("x12_x13_text_fields", """SELECT order_key, list_filter(['a' || order_key, 'b'], lambda x: true) AS items, CAST(order_key * 125 + 50 AS BIGINT) AS budget, CASE WHEN order_key % 2 = 0 THEN 'SIN' ELSE 'LON' END AS origin, CASE WHEN order_key % 3 = 0 THEN 'NYC' ELSE 'TYO' END AS destination FROM (SELECT o_orderkey AS order_key FROM orders)""")
def x12_x13_text_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("book flights from "), F.when(k % 2 == 0, "Singapore").otherwise("london"), F.lit(" to "), F.when(k % 3 == 0, "New York").otherwise("tokyo"), F.lit(" under SGD "), F.format_number(k * 1.25 + 0.5, 2))
    listed = F.concat(F.lit("['a"), k.cast("string"), F.lit("' \"b\"]"))
    route = scalars.text_route(text)
    return views.table(spark, sf_dir, "orders").select(k.alias("order_key"), scalars.quoted_items(listed).alias("items"), scalars.text_budget(text).alias("budget"), route["origin"].alias("origin"), route["destination"].alias("destination"))


_ENT = "(-(c * ln(c) + n * ln(n) + e * ln(e)) / ln(3))"


@query(
    "x14_x15_scores",
    sql(f"""SELECT example_id, round(2 * CAST(label = 1 AS INTEGER)::DOUBLE + 1 - 2 * abs(probability - 0.5) + {_ENT} + greatest(c, n), 9) AS hard, round(1 - 2 * abs(probability - 0.5) + {_ENT} + abs(probability - greatest(c, n)), 9) AS challenge,
    CASE WHEN c >= n AND c >= e THEN 'contradiction' WHEN n >= e THEN 'neutral' ELSE 'entailment' END AS top FROM (SELECT *, semantic_contradiction AS c, semantic_neutral AS n, semantic_entailment AS e FROM v_features)"""),
)
def x14_x15_scores(spark, sf_dir):
    s = [F.col(f"semantic_{k}") for k in scalars.CLASSES]
    p = F.col("probability")
    return views.feature_rows(spark, sf_dir).select("example_id", F.round(scalars.hard_score(F.col("label") == 1, p, *s), 9).alias("hard"), F.round(scalars.challenge_score(p, *s), 9).alias("challenge"), scalars.top_class(*s).alias("top"))


@query("x17_mentions", "SELECT doc_id, contains(lower(text), 'tion') OR contains(lower(text), 'sch') AS mentions FROM documents")
def x17_mentions(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", scalars.mentions(F.col("text"), F.array(F.lit("TION"), F.lit("sch"))).alias("mentions"))


@query("x18_json_hash", """SELECT o_orderkey, sha256('{"cust":' || o_custkey || ',"note":null,"priority":"' || o_orderpriority || '"}') AS payload_hash FROM orders""")
def x18_json_hash(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", hashing.json_hash(("priority", F.col("o_orderpriority")), ("cust", F.col("o_custkey")), ("note", F.lit(None).cast("string"))).alias("payload_hash"))


@query("x19_x20_labels", sql("""SELECT bucket, worst, joined, count(*) AS n FROM (SELECT CASE WHEN label_source LIKE 'llm%' THEN 'reviewed' WHEN contains(label_source, 'deterministic') THEN 'deterministic' ELSE 'weak' END AS bucket,
    CASE WHEN relevance IN ('C', 'I') THEN 'CONTRADICTION' WHEN relevance = 'S' THEN 'NEUTRAL' ELSE 'ENTAILMENT' END AS worst, CASE WHEN relevance = 'E' THEN 'ENTAILMENT' WHEN relevance = 'S' THEN 'ENTAILMENT+NEUTRAL' ELSE 'CONTRADICTION+ENTAILMENT' END AS joined FROM v_headers) GROUP BY ALL"""))
def x19_x20_labels(spark, sf_dir):
    labels = F.array(F.lit("ENTAILMENT"), views.pick({"E": "ENTAILMENT", "S": "NEUTRAL", "C": "CONTRADICTION", "I": "CONTRADICTION"}, F.col("relevance")))
    df = views.headers(spark, sf_dir).select(scalars.source_bucket(F.col("label_source")).alias("bucket"), scalars.worst_label(labels).alias("worst"), scalars.label_key(labels).alias("joined"))
    return df.groupBy("bucket", "worst", "joined").agg(F.count(F.lit(1)).alias("n"))


@query("x22_stable_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('2026:queue:' || c_custkey), c_custkey) AS place FROM customer")
def x22_stable_order(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return ordered.hashed_places(c, hashing.order_key("queue", F.col("c_custkey")), "c_custkey", ["c_mktsegment"], "place").select("c_custkey", "place")


def search_records(spark, sf_dir):
    """Orders and parts as joined search judgements."""
    lines = views.line_items(spark, sf_dir).select("order_key", "part_key", "description", "category").dropDuplicates(["order_key", "part_key"])
    h = views.headers(spark, sf_dir).select("order_key", "locale", "relevance")
    return lines.join(h, "order_key").select(
        F.col("order_key").alias("query_id"), F.col("part_key").alias("product_id"), F.col("locale").alias("product_locale"), F.col("relevance").alias("esci_label"), F.lit(1).alias("large_version"),
        F.concat(F.lit("  find "), F.col("category")).alias("query"), F.col("description").alias("product_title"), F.when(F.col("part_key") % 3 == 0, " ").otherwise(F.col("category")).alias("product_description"), F.lit(None).cast("string").alias("product_brand"),
    )


@query(
    "p1_p3_search_examples",
    sql(f"""SELECT example_id, group_id, objective, locale, currency_exponent, evidence_text, budget_minor, greatest(1, CAST(round_even(budget_minor * 0.8::DOUBLE, 0) AS BIGINT)) AS amount_minor, deviation, expected_treatment, violation, semantic_label, confidence FROM (
    SELECT *, 5000 + {h(12, 'example_id')} % 181 * 250 AS budget_minor FROM (
    SELECT 'ex_' || substr(sha256(order_key || ':' || part_key || ':' || locale), 1, 20) AS example_id, 'grp_' || substr(sha256(order_key || ':' || locale), 1, 20) AS group_id, 'find ' || category AS objective, CASE WHEN locale = 'jp' THEN 'ja-JP' ELSE 'en-US' END AS locale,
    CASE WHEN locale = 'jp' THEN 0 ELSE 2 END AS currency_exponent, description || CASE WHEN part_key % 3 = 0 THEN '' ELSE chr(10) || category END AS evidence_text, CASE relevance WHEN 'E' THEN 'MATCH' WHEN 'S' THEN 'AMBIGUOUS' ELSE 'VIOLATION' END AS deviation,
    CASE relevance WHEN 'E' THEN 'APPROVE' WHEN 'S' THEN 'STEP_UP' ELSE 'HOLD' END AS expected_treatment, CASE WHEN relevance IN ('C', 'I') THEN 'SEMANTIC_MISMATCH' END AS violation,
    CASE relevance WHEN 'E' THEN 'ENTAILMENT' WHEN 'S' THEN 'NEUTRAL' ELSE 'CONTRADICTION' END AS semantic_label, 0.7::DOUBLE AS confidence
    FROM (SELECT DISTINCT order_key, part_key, description, category FROM v_lines) JOIN (SELECT order_key, locale, relevance FROM v_headers) USING (order_key)))"""),
)
def p1_p3_search_examples(spark, sf_dir):
    return transforms.search_examples(search_records(spark, sf_dir))


@query(
    "p4_session_examples",
    """SELECT 'ex_' || substr(sha256('session:' || conv_id), 1, 20) AS example_id, array_to_string(titles[greatest(len(titles) - 4, 1):], '; ') AS objective, amount AS amount_minor, greatest(amount + 1, CAST(round_even(amount * 1.2::DOUBLE, 0) AS BIGINT)) AS budget_minor, trim(next_title, ' ') AS evidence_text FROM (
    SELECT conv_id, list(text ORDER BY turn) FILTER (turn < last) AS titles, any_value(text) FILTER (turn = last) AS next_title, CASE WHEN conv_id % 4 = 0 THEN 5000 ELSE greatest(1, CAST(round_even((conv_id % 90) * 1.01::DOUBLE * 100, 0) AS BIGINT)) END AS amount
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)) GROUP BY conv_id HAVING max(turn) > 0) WHERE titles IS NOT NULL""",
)
def p4_session_examples(spark, sf_dir):
    from pyspark.sql import Window

    c = views.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    g = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("last"), F.struct("turn", F.col("text").alias("t"))))).alias("p"), F.min(F.when(F.col("turn") == F.col("last"), F.col("text"))).alias("next_title"),
    ).filter(F.size("p") > 0)
    sessions = g.select(F.col("conv_id").alias("session_id"), F.lit("UK").alias("locale"), F.transform("p", lambda x: x["t"]).alias("previous_titles"), F.when(F.col("conv_id") % 4 != 0, (F.col("conv_id") % 90) * 1.01).alias("next_price"), "next_title", F.lit(None).cast("string").alias("next_description"))
    return transforms.session_examples(sessions)


@query("p5_p7_priced_examples", f"""SELECT kind, 'ex_' || substr(sha256(kind || ':' || order_key || ':' || part_key), 1, 20) AS example_id, amount AS amount_minor, greatest(amount + 1, CAST(round_even(amount * factor::DOUBLE, 0) AS BIGINT)) AS budget_minor FROM (
    SELECT *, greatest(1, CAST(round_even(p_retailprice::DOUBLE * 100, 0) AS BIGINT)) AS amount FROM (SELECT DISTINCT l_orderkey AS order_key, p_partkey AS part_key, p_retailprice, k.kind, k.factor FROM lineitem JOIN part ON l_partkey = p_partkey, (VALUES ('invoice', 1.1), ('itinerary', 1.15), ('award', 1.05)) k(kind, factor)))""")
def p5_p7_priced_examples(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), "p_retailprice")
    d = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key")).distinct().join(part, "part_key")
    out = None
    for kind, factor in (("invoice", 1.1), ("itinerary", 1.15), ("award", 1.05)):
        one = transforms.priced_examples(d, kind, ["order_key", "part_key"], F.col("p_retailprice"), factor).select(F.lit(kind).alias("kind"), "example_id", "amount_minor", "budget_minor")
        out = one if out is None else out.unionByName(one)
    return out


@query("p10_nli_pairs", sql("SELECT example_id, group_id, split, 'semantic_attribute_' || cust_key AS constraint_id, array_to_string(descriptions, chr(10)) AS premise, 'The purchase satisfies: warranty' AS hypothesis FROM v_examples WHERE cust_key % 2 = 1"))
def p10_nli_pairs(spark, sf_dir):
    return transforms.nli_pairs(views.examples(spark, sf_dir))


@query("p12_blinded_rows", sql("SELECT example_id, CAST(NULL AS VARCHAR) AS relevance, CAST(NULL AS VARCHAR) AS attack_family, split, 'blinded-v1' AS audit_context FROM v_headers"))
def p12_blinded_rows(spark, sf_dir):
    return transforms.blinded(views.headers(spark, sf_dir)).select("example_id", "relevance", "attack_family", "split", "audit_context")


@query("s17_generated_rows", """SELECT family, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT f.family, CASE WHEN f.family = 'amount_overspend' THEN floor((10000 + i * 137) * 1.2) ELSE floor((10000 + i * 137) * 0.8) END AS amount FROM (SELECT c_custkey AS i FROM customer), (VALUES ('control'), ('amount_overspend'), ('currency_mismatch'), ('cumulative_overspend'), ('category_mismatch'), ('evidence_missing')) f(family)) GROUP BY family""")
def s17_generated_rows(spark, sf_dir):
    """Six families of every customer's number as a seed."""
    seeds = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"))
    return files.generated_rows(seeds).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount"))


@query("f3_clean_invoices", """SELECT count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM (SELECT CASE WHEN l_orderkey % 10 = 3 THEN 'C' ELSE '' END || l_orderkey AS invoice, CAST(l_quantity AS INTEGER) - CASE WHEN l_partkey % 10 = 1 THEN 30 ELSE 0 END AS quantity FROM lineitem WHERE l_suppkey % 8 <> 1) WHERE invoice NOT LIKE 'C%' AND quantity > 0""")
def f3_clean_invoices(spark, sf_dir):
    line = views.table(spark, sf_dir, "lineitem")
    raw = line.select(
        F.concat(F.when(F.col("l_orderkey") % 10 == 3, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice"), F.col("l_partkey").cast("string").alias("stock_code"), F.lit("thing").alias("description"),
        (F.col("l_quantity").cast("int") - F.when(F.col("l_partkey") % 10 == 1, 30).otherwise(0)).cast("string").alias("quantity"), F.when(F.col("l_suppkey") % 8 == 1, "n/a").otherwise("1.25").alias("unit_price"),
    )
    return files.clean_invoices(raw).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("bigint").alias("quantity"))


@query("s15_shards", sql("SELECT domain, shard, count(*) AS n, min(example_id) AS first FROM (SELECT domain, example_id, CAST(floor((row_number() OVER (PARTITION BY domain ORDER BY example_id) - 1) / 500) AS INTEGER) AS shard FROM v_headers) GROUP BY ALL"))
def s15_shards(spark, sf_dir):
    return files.with_shard(views.headers(spark, sf_dir), "example_id", 500, ["domain"]).groupBy("domain", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("example_id").alias("first"))


@query("v10_unknown_keys", "SELECT event_type, count(*) AS n FROM events WHERE len(list_filter(json_keys(props), lambda k: k NOT IN ('z'))) > 0 GROUP BY event_type")
def v10_unknown_keys(spark, sf_dir):
    e = files.with_unknown_keys(views.table(spark, sf_dir, "events"), "props", ["z"])
    return e.filter(F.size("unknown_keys") > 0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
