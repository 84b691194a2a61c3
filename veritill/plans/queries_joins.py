"""Queries over joins, set operations, filters and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritill.functions.hashing import order_key
from veritill.operators import aggregates, joins, validate
from veritill.operators.rules import offline_policy
from veritill.sources import views

from .oracle import sql
from .registry import query


def predicted(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    return f.withColumn("predicted_treatment", offline_policy(F.col("probability"), 0.9))


@query(
    "j1_product_join",
    """SELECT product_locale, p_type AS category, count(*) AS n, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'us' ELSE 'jp' END AS product_locale FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE product_locale = 'us' OR p_partkey % 3 <> 0 GROUP BY ALL""",
)
def j1_product_join(spark, sf_dir):
    """Judgements and products by id and locale; some products are sold in one of two locales only."""
    judged = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.when(F.col("l_suppkey") % 2 == 0, "us").otherwise("jp").alias("product_locale"), F.col("l_quantity").cast("int").alias("quantity"))
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), F.explode(F.array(F.lit("us"), F.lit("jp"))).alias("product_locale"))
    sold = part.filter("product_locale = 'us' or product_id % 3 <> 0")
    return joins.products_of(judged, sold).groupBy("product_locale", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("j2_complete_sessions", """WITH s AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
    SELECT k AS session_id, array_to_string(list_transform(p[:-2], lambda x: 't' || x), ';') AS previous_titles, 't' || p[-1] AS next_title FROM s WHERE len(list_filter(p, lambda x: x % 5 = 0)) = 0""")
def j2_complete_sessions(spark, sf_dir):
    line = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("p")).filter(F.size("p") > 1)
    sessions = line.select("session_id", F.slice("p", F.lit(1), F.size("p") - 1).alias("previous"), F.element_at("p", -1).alias("next"))
    products = views.table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("title"))
    return joins.complete_sessions(sessions, products).select("session_id", F.array_join("previous_titles", ";").alias("previous_titles"), "next_title")


@query("j3_features_with_predictions", sql("SELECT h.example_id, coalesce(f.semantic_contradiction, 0) AS semantic_contradiction, coalesce(f.semantic_neutral, 0) AS semantic_neutral, f.example_id IS NULL AND h.relevance = 'S' AS prediction_missing FROM v_headers h LEFT JOIN (SELECT * FROM v_features WHERE label_source <> 'weak_policy') f ON h.example_id = f.example_id"))
def j3_features_with_predictions(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("example_id", "relevance", "label_source")
    p = h.filter("label_source <> 'weak_policy'").select("example_id").withColumns({k: v for k, v in views.scores(F.col("example_id")).items() if k != "probability"})
    return joins.with_predictions(h, p, F.col("relevance") == "S").select("example_id", "semantic_contradiction", "semantic_neutral", "prediction_missing")


_EXCLUDED = "SELECT example_id, group_id, source_record_id FROM v_headers WHERE split = 'golden' AND order_key % 3 = 0"


@query("j4_unrelated_rows", sql("SELECT example_id FROM v_headers WHERE example_id NOT IN (SELECT example_id FROM v_excluded) AND group_id NOT IN (SELECT group_id FROM v_excluded) AND source_record_id NOT IN (SELECT source_record_id FROM v_excluded) AND coalesce(parent_example_id, '') NOT IN (SELECT example_id FROM v_excluded)", v_excluded=_EXCLUDED))
def j4_unrelated_rows(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("order_key", "example_id", "group_id", "source_record_id", "parent_example_id", "split")
    return joins.unrelated(h, h.filter("split = 'golden' and order_key % 3 = 0")).select("example_id")


@query("j5_untainted_groups", sql("""SELECT group_id, count(*) AS n FROM v_headers WHERE group_id NOT IN (SELECT group_id FROM v_headers WHERE example_id IN (SELECT example_id FROM v_few) OR group_id IN (SELECT group_id FROM v_few) OR source_record_id IN (SELECT source_record_id FROM v_few) OR coalesce(parent_example_id, '') IN (SELECT example_id FROM v_few)) GROUP BY group_id""", v_few="SELECT example_id, group_id, source_record_id FROM v_headers WHERE order_key % 500 = 3"))
def j5_untainted_groups(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("order_key", "example_id", "group_id", "source_record_id", "parent_example_id")
    return joins.untainted_groups(h, h.filter("order_key % 500 = 3")).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@query("j6_audited_labels", sql("""SELECT h.example_id, a.treatment AS audited_treatment FROM v_headers h LEFT JOIN (SELECT group_id, attack_family, arg_max(expected_treatment, example_id) AS treatment FROM v_features WHERE label_source = 'llm_assisted' GROUP BY ALL) a ON h.group_id = a.group_id AND h.attack_family = a.attack_family"""))
def j6_audited_labels(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    ledger = f.filter("label_source = 'llm_assisted'").select("group_id", "attack_family", "example_id", F.col("expected_treatment").alias("audited_treatment"))
    return joins.audited(views.headers(spark, sf_dir).select("example_id", "group_id", "attack_family"), ledger, [F.col("example_id").desc()]).select("example_id", "audited_treatment")


@query("j7_j8_coverage", sql("SELECT side, count(*) AS n FROM (SELECT CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT DISTINCT example_id AS k FROM v_headers) l FULL JOIN (SELECT DISTINCT example_id AS k FROM v_reviews UNION SELECT 'ex_x' || event_id FROM events WHERE event_id % 100 = 0) r ON l.k = r.k) GROUP BY side"))
def j7_j8_coverage(spark, sf_dir):
    r = views.reviews(spark, sf_dir)
    extra = r.filter("event_id % 100 = 0").select(F.concat(F.lit("ex_x"), F.col("event_id").cast("string")).alias("example_id"))
    return joins.set_differences(views.headers(spark, sf_dir), r.select("example_id").union(extra), "example_id")


@query("j9_prediction_overlay", sql("SELECT example_id, CASE WHEN split = 'train' AND relevance = 'E' THEN semantic_neutral ELSE probability END AS p FROM v_features"))
def j9_prediction_overlay(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    base = f.select("example_id", "split", F.col("probability").alias("p"))
    better = f.filter("relevance = 'E'").select("example_id", F.col("semantic_neutral").alias("p"))
    return joins.overlay(base, better, "example_id", ["p"], F.col("split") == "train").select("example_id", "p")


@query("j10_completed_predictions", sql("SELECT example_id, CASE WHEN relevance = 'E' THEN 'given' ELSE 'inferred' END AS origin FROM v_features"))
def j10_completed_predictions(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir).select("example_id", "relevance")
    given = f.filter("relevance = 'E'").select("example_id", F.lit("given").alias("origin"))
    return joins.completed(f.select("example_id"), given, "example_id", lambda rows: rows.withColumn("origin", F.lit("inferred")))


@query("j12_j13_queue", sql("""SELECT e.example_id, coalesce(r.reviews, 0) AS reviews, coalesce(r.verdicts, 0) AS verdicts, a.example_id IS NOT NULL AS adjudicated,
    CASE WHEN a.example_id IS NOT NULL THEN 'adjudicated' WHEN r.reviews IS NULL THEN 'unreviewed' WHEN r.reviews = 1 THEN 'single_review' WHEN r.verdicts > 1 THEN 'needs_adjudication' ELSE 'agreed' END AS state
    FROM v_headers e LEFT JOIN (SELECT example_id, count(*) AS reviews, count(DISTINCT deviation) AS verdicts FROM v_latest GROUP BY 1) r USING (example_id) LEFT JOIN v_adjudications a USING (example_id)"""))
def j12_j13_queue(spark, sf_dir):
    from veritill.operators import reviews

    r = reviews.accepted(views.reviews(spark, sf_dir))
    return reviews.queue_state(views.headers(spark, sf_dir), r, views.adjudications(spark, sf_dir))


@query("j15_aligned_scores", sql("SELECT count(*) AS n, round(avg(abs(probability - semantic_neutral)), 9) AS gap FROM v_features"))
def j15_aligned_scores(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    both = f.select("example_id", "probability").join(f.select("example_id", "semantic_neutral"), "example_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("probability") - F.col("semantic_neutral"))), 9).alias("gap"))


@query("j16_cyclic_pairs", "SELECT a.c_custkey AS parent, b.s_suppkey AS extra FROM (SELECT c_custkey, row_number() OVER (ORDER BY sha256('2026:cycle:' || c_custkey)) - 1 AS i FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY sha256('2026:cycle:' || s_suppkey)) - 1 AS k FROM supplier) b ON a.i % (SELECT count(*) FROM supplier) = b.k")
def j16_cyclic_pairs(spark, sf_dir):
    a, b = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parent")), views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("extra"))
    return joins.cyclic_pairs(a, b, order_key("cycle", F.col("parent")), order_key("cycle", F.col("extra")), b.count())


@query("u_set_operations", sql("""SELECT 'train_validation' AS pair, count(*) AS shared FROM (SELECT source_record_id FROM v_headers WHERE split = 'train' INTERSECT SELECT source_record_id FROM v_headers WHERE split = 'validation')
    UNION ALL SELECT 'train_minus_rest', count(*) FROM (SELECT source_record_id FROM v_headers WHERE split = 'train' EXCEPT SELECT source_record_id FROM v_headers WHERE split <> 'train')
    UNION ALL SELECT 'keys', count(*) FROM (SELECT group_id FROM v_headers UNION SELECT source_record_id FROM v_headers)"""))
def u_set_operations(spark, sf_dir):
    h = views.headers(spark, sf_dir)
    of, key = h.filter, "source_record_id"
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("shared")).select(F.lit(name).alias("pair"), "shared")
    shared, rest = joins.shared_keys(of("split = 'train'"), of("split = 'validation'"), key), joins.missing_keys(of("split = 'train'"), of("split <> 'train'"), key)
    return one("train_validation", shared).union(one("train_minus_rest", rest)).union(one("keys", joins.all_keys(h, "group_id", key)))


@query("a1_a2_histograms", sql("SELECT 'split' AS dimension, split AS category, count(*) AS n FROM v_headers GROUP BY ALL UNION ALL SELECT 'locale', locale, count(*) FROM v_headers GROUP BY ALL UNION ALL SELECT 'parent', coalesce(CASE WHEN parent_example_id IS NOT NULL THEN 'child' END, 'UNREVIEWED'), count(*) FROM v_headers GROUP BY ALL"))
def a1_a2_histograms(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("split", "locale", F.when(F.col("parent_example_id").isNotNull(), "child").alias("parent"))
    return aggregates.histograms(h, ["split", "locale", "parent"])


@query("a3_prefixed_counts", sql("SELECT 'split:' || split AS key, count(*) AS n FROM v_headers GROUP BY ALL UNION ALL SELECT 'attack_family:' || attack_family, count(*) FROM v_headers GROUP BY ALL"))
def a3_prefixed_counts(spark, sf_dir):
    return aggregates.prefixed_counts(views.headers(spark, sf_dir), ["split", "attack_family"])


@query("a4_score_reduction", sql("SELECT group_id AS example_id, max(semantic_contradiction) AS semantic_contradiction, max(semantic_neutral) AS semantic_neutral, min(semantic_entailment) AS semantic_entailment FROM v_features GROUP BY group_id"))
def a4_score_reduction(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    return aggregates.score_reduction(f.select(F.col("group_id").alias("example_id"), *(F.col(f"semantic_{k}").alias(k) for k in ("contradiction", "neutral", "entailment"))), True)


@query("a5_cart_totals", sql("SELECT 'ex_' || order_key AS example_id, total_amount_minor, true AS consistent FROM v_carts JOIN v_headers USING (order_key)"))
def a5_cart_totals(spark, sf_dir):
    e = views.examples(spark, sf_dir)
    return e.select("example_id", "total_amount_minor", (aggregates.items_total(F.col("items")) == F.col("total_amount_minor")).alias("consistent"))


_RATES = """count(*) AS rows, count(*) FILTER (expected_treatment <> 'APPROVE') AS violation_rows, count(*) FILTER (expected_treatment = 'APPROVE') AS legitimate_rows, round(avg(CASE WHEN expected_treatment = predicted_treatment THEN 1.0 ELSE 0.0 END), 9) AS treatment_accuracy,
    round(coalesce(count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / nullif(count(*) FILTER (expected_treatment <> 'APPROVE'), 0), 0), 9) AS violation_recall,
    round(coalesce(count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'STEP_UP') / nullif(count(*) FILTER (expected_treatment = 'APPROVE'), 0), 0), 9) AS false_step_up_rate,
    round(coalesce(count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'HOLD') / nullif(count(*) FILTER (expected_treatment = 'APPROVE'), 0), 0), 9) AS false_decline_rate"""
RATE_COLUMNS = ["rows", "violation_rows", "legitimate_rows", "treatment_accuracy", "violation_recall", "false_step_up_rate", "false_decline_rate"]


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("a6_a13_family_metrics", sql(f"SELECT attack_family, {_RATES} FROM v_predicted GROUP BY attack_family"))
def a6_a13_family_metrics(spark, sf_dir):
    from veritill.operators import metrics

    return rounded(metrics.treatment_metrics(predicted(spark, sf_dir), "expected_treatment", "predicted_treatment", ("attack_family",)).select("attack_family", *RATE_COLUMNS), *RATE_COLUMNS[3:])


@query("a7_first_by_hash", sql("SELECT group_id, arg_min(example_id, sha256('2026:best:' || example_id)) AS example_id FROM v_headers GROUP BY group_id"))
def a7_first_by_hash(spark, sf_dir):
    return aggregates.first_by_hash(views.headers(spark, sf_dir).select("group_id", "example_id"), "group_id", order_key("best", F.col("example_id")))


@query("a8_first_seen", sql("SELECT example_id, reviewer_id, event_id FROM v_latest"))
def a8_first_seen(spark, sf_dir):
    return aggregates.first_seen(views.reviews(spark, sf_dir), ["example_id", "reviewer_id"], ["created_at", "event_id"]).select("example_id", "reviewer_id", "event_id")


@query("a9_a10_group_profiles", sql("""SELECT group_id, count(*) AS rows, '[' || array_to_string(list_sort(list_distinct(list('{"attack_family":"' || attack_family || '","relevance":"' || relevance || '"}'))), ',') || ']' AS stratum FROM v_headers GROUP BY group_id"""))
def a9_a10_group_profiles(spark, sf_dir):
    return aggregates.group_profile(views.headers(spark, sf_dir), "group_id", ["attack_family", "relevance"])


@query("a11_total_variation", sql("""SELECT dimension, round(sum(abs(p - q)) / 2, 9) AS distance, CAST(count(*) FILTER (q = 0) AS BIGINT) AS missing_categories FROM (SELECT dimension, category, coalesce(count(*) FILTER (split = 'train') / max(t), 0) AS p, coalesce(count(*) FILTER (split = 'golden') / max(g), 0) AS q FROM
    (SELECT 'domain' AS dimension, domain AS category, split FROM v_headers UNION ALL SELECT 'attack_family', attack_family, split FROM v_headers), (SELECT count(*) FILTER (split = 'train') AS t, count(*) FILTER (split = 'golden') AS g FROM v_headers) WHERE split IN ('train', 'golden') GROUP BY ALL) GROUP BY dimension"""))
def a11_total_variation(spark, sf_dir):
    h = views.headers(spark, sf_dir)
    return rounded(aggregates.total_variation(h.filter("split = 'train'"), h.filter("split = 'golden'"), ["domain", "attack_family"]), "distance")


@query("a12_key_digest", sql("""SELECT sha256(array_to_string(list(d ORDER BY leaf), chr(10))) AS digest FROM (SELECT substr(sha256(example_id), 1, 3) AS leaf, sha256(array_to_string(list(example_id ORDER BY example_id), chr(10))) AS d FROM v_headers GROUP BY 1)"""))
def a12_key_digest(spark, sf_dir):
    return aggregates.key_digest(views.headers(spark, sf_dir), "example_id")


@query("a14_transitions", sql("SELECT expected_treatment || '->' || predicted_treatment AS transition, count(*) AS n FROM v_predicted GROUP BY 1"))
def a14_transitions(spark, sf_dir):
    return aggregates.transitions(predicted(spark, sf_dir), "expected_treatment", "predicted_treatment")


@query("a15_agreement", sql("""SELECT dimension, category, transition, n, round(n / sum(n) OVER (PARTITION BY dimension, category), 9) AS share FROM (SELECT dimension, category, t AS transition, count(*) AS n FROM (SELECT 'attack_family' AS dimension, attack_family AS category, expected_treatment || '->' || predicted_treatment AS t FROM v_predicted
    UNION ALL SELECT 'label_source', label_source, expected_treatment || '->' || predicted_treatment FROM v_predicted) GROUP BY ALL)"""))
def a15_agreement(spark, sf_dir):
    return rounded(aggregates.agreement(predicted(spark, sf_dir), "expected_treatment", "predicted_treatment", ["attack_family", "label_source"]), "share")


@query("a16_trigger_rates", sql("SELECT round(avg(CAST(hard_fail_count > 0 AS INTEGER)), 9) AS rules, round(avg(CAST(semantic_contradiction >= 0.8 OR semantic_neutral >= 0.6 AS INTEGER)), 9) AS semantic, round(avg(CAST(probability >= 0.9 AS INTEGER)), 9) AS model FROM v_features"))
def a16_trigger_rates(spark, sf_dir):
    triggers = {"rules": F.col("hard_fail_count") > 0, "semantic": (F.col("semantic_contradiction") >= 0.8) | (F.col("semantic_neutral") >= 0.6), "model": F.col("probability") >= 0.9}
    return rounded(aggregates.trigger_rates(views.feature_rows(spark, sf_dir), triggers), *triggers)


@query("a17_shortcuts", sql("""SELECT line_item_count, CAST(sum(n) AS BIGINT) AS rows, round(sum(y) / sum(n), 9) AS rate, array_to_string(list(attack_family || '=' || n ORDER BY attack_family), ',') AS families FROM (SELECT line_item_count, attack_family, count(*) AS n, count(*) FILTER (relevance IN ('C', 'I')) AS y FROM v_examples GROUP BY ALL) GROUP BY 1"""))
def a17_shortcuts(spark, sf_dir):
    e = views.headers(spark, sf_dir).select("order_key", "attack_family", "relevance").join(views.carts(spark, sf_dir).select("order_key", "line_item_count"), "order_key")
    d = aggregates.conditional_shares(e, "line_item_count", "attack_family", F.col("relevance").isin("C", "I"))
    return d.select("line_item_count", "rows", F.round("rate", 9).alias("rate"), F.array_join(F.transform(F.map_entries("families"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("families"))


@query("a18_target_coverage", sql("SELECT split, count(*) AS rows, count(*) FILTER (relevance <> 'S') AS binary_rows, count(*) FILTER (label = 1) AS interventions FROM v_features GROUP BY split"))
def a18_target_coverage(spark, sf_dir):
    return aggregates.target_coverage(views.feature_rows(spark, sf_dir), ["split"], {"binary_rows": F.col("relevance") != "S", "interventions": F.col("label") == 1})


@query("a19_resolved_reviews", sql("""SELECT coalesce(r.example_id, a.example_id) AS example_id, coalesce(reviews, 0) AS reviews, CASE WHEN a.example_id IS NOT NULL THEN 'adjudicated' WHEN reviews >= 2 AND verdicts = 1 THEN 'resolved' ELSE 'unresolved' END AS state,
    CASE WHEN a.example_id IS NOT NULL THEN a.deviation WHEN reviews >= 2 AND verdicts = 1 THEN r.deviation END AS deviation, CASE WHEN a.example_id IS NOT NULL THEN a.expected_treatment WHEN reviews >= 2 AND verdicts = 1 THEN r.expected_treatment END AS expected_treatment,
    round(CASE WHEN a.example_id IS NOT NULL THEN a.confidence WHEN reviews >= 2 AND verdicts = 1 THEN r.confidence END, 9) AS confidence
    FROM (SELECT example_id, count(*) AS reviews, count(DISTINCT deviation) AS verdicts, min(deviation) AS deviation, min(expected_treatment) AS expected_treatment, avg(confidence) AS confidence FROM v_latest GROUP BY 1) r FULL JOIN v_adjudications a USING (example_id)"""))
def a19_resolved_reviews(spark, sf_dir):
    from veritill.operators import reviews

    return rounded(aggregates.resolve_reviews(reviews.accepted(views.reviews(spark, sf_dir)), views.adjudications(spark, sf_dir)), "confidence")


@query("a21_group_weights", sql("""SELECT example_id, round(c / (SELECT sum(c * n) / sum(n) FROM v_clip), 9) AS weight FROM v_headers JOIN v_clip USING (source_record_id)""", v_raw="SELECT source_record_id, count(*) AS n, sqrt(sum(count(*)) OVER () / (count(*) OVER () * count(*))) AS r FROM v_headers GROUP BY 1", v_clip="SELECT source_record_id, n, least(greatest(r / (sum(r * n) OVER () / sum(n) OVER ()), 0.5), 2.5) AS c FROM v_raw"))
def a21_group_weights(spark, sf_dir):
    return aggregates.group_weights(views.headers(spark, sf_dir).select("example_id", "source_record_id"), "source_record_id").select("example_id", F.round("weight", 9).alias("weight"))


@query("a22_class_weights", sql("SELECT relevance, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM v_headers GROUP BY relevance"))
def a22_class_weights(spark, sf_dir):
    return rounded(aggregates.class_weights(views.headers(spark, sf_dir), "relevance"), "weight")


@query("a23_error_weights", sql("SELECT transition, count(*) AS n, max(weight) AS weight FROM (SELECT expected_treatment || '->' || predicted_treatment AS transition, CASE WHEN expected_treatment = predicted_treatment THEN 1.0 WHEN expected_treatment <> 'APPROVE' THEN 3.0 ELSE 1.5 END::DOUBLE AS weight FROM v_predicted) GROUP BY transition"))
def a23_error_weights(spark, sf_dir):
    from veritill.operators.ml import error_weight

    d = predicted(spark, sf_dir).withColumn("weight", error_weight(F.col("expected_treatment"), F.col("predicted_treatment")))
    return d.groupBy(F.concat_ws("->", "expected_treatment", "predicted_treatment").alias("transition")).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


@query("a24_token_cost", "SELECT role AS model, round(sum(length(text) * CASE role WHEN 'user' THEN 1.0 ELSE 2.0 END + CASE role WHEN 'user' THEN 4.0 ELSE 8.0 END) / 1e6, 9) AS cost FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role")
def a24_token_cost(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')").select(F.col("role").alias("model"), "text")
    return rounded(aggregates.token_cost(c, "model", F.length("text"), F.lit(1), {"user": (1.0, 4.0), "assistant": (2.0, 8.0)}), "cost")


@query("a25_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, max(value) AS max FROM events GROUP BY event_type")
def a25_percentiles(spark, sf_dir):
    from veritill.operators import metrics

    return rounded(metrics.percentiles(views.table(spark, sf_dir, "events"), "value", ("event_type",)), "p50", "p95")


@query("a26_rater_agreement", sql("""SELECT count(*) AS pairs, CAST(sum(CAST(d[1] = d[2] AS INTEGER)) AS BIGINT) AS agreed, round(avg(CAST(d[1] = d[2] AS INTEGER)), 9) AS rate FROM (SELECT list(deviation ORDER BY reviewer_id) AS d FROM v_latest GROUP BY example_id HAVING count(*) >= 2)"""))
def a26_rater_agreement(spark, sf_dir):
    from veritill.operators import reviews

    return rounded(reviews.rater_agreement(reviews.accepted(views.reviews(spark, sf_dir))), "rate")


@query("v2_v3_leaks", sql("""SELECT kind, count(*) FILTER (roles > 1) AS leaks FROM (SELECT kind, key, count(DISTINCT role) AS roles FROM (SELECT 'example_id' AS kind, example_id AS key, split AS role FROM v_headers UNION ALL SELECT 'group_id', group_id, split FROM v_headers UNION ALL SELECT 'source_record_id', source_record_id, split FROM v_headers
    UNION ALL SELECT 'parent_example_id', parent_example_id, split FROM v_headers WHERE parent_example_id IS NOT NULL) GROUP BY ALL) GROUP BY kind UNION ALL SELECT 'parent_in_other_role', count(*) FROM v_headers c JOIN v_headers p ON c.parent_example_id = p.example_id WHERE c.split <> p.split"""))
def v2_v3_leaks(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("example_id", "group_id", "source_record_id", "parent_example_id", F.col("split").alias("role"))
    return validate.role_leaks(h)


@query("v5_coverage", sql("SELECT count(*) FILTER (g.n IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS unexpected, count(*) FILTER (g.n > 1) AS repeated FROM (SELECT DISTINCT example_id AS k FROM v_headers) e FULL JOIN (SELECT example_id AS k, count(*) AS n FROM v_reviews GROUP BY 1) g USING (k)"))
def v5_coverage(spark, sf_dir):
    return validate.coverage(views.headers(spark, sf_dir), views.reviews(spark, sf_dir), "example_id")


@query("v8_v9_checks", sql("""SELECT 'label' AS "check", count(*) FILTER (label NOT IN (0, 1)) AS violations FROM v_features UNION ALL SELECT 'probability', count(*) FILTER (NOT probability BETWEEN 0.05 AND 1) FROM v_features UNION ALL SELECT 'domain', count(*) FILTER (domain = '') FROM v_features"""))
def v8_v9_checks(spark, sf_dir):
    return validate.count_checks(views.feature_rows(spark, sf_dir), {"label": F.col("label").isin(0, 1), "probability": F.col("probability").between(0.05, 1), "domain": F.col("domain") != ""})


@query("v4_count_mismatches", sql("SELECT split AS category, count(*) AS n, 0::BIGINT AS expected FROM v_headers WHERE split = 'test' GROUP BY split UNION ALL SELECT 'none', 0, 5"))
def v4_count_mismatches(spark, sf_dir):
    h = views.headers(spark, sf_dir)
    counts = {r["split"]: r["count"] for r in h.groupBy("split").count().collect()}  # four rows
    return validate.count_mismatches(h, "split", {k: v for k, v in counts.items() if k != "test"} | {"none": 5})


@query("v11_drift_gate", sql("""SELECT max(distance) AS worst, CAST(sum(m) AS BIGINT) AS missing_categories, max(distance) <= 0.15 AND sum(m) = 0 AS passed FROM (SELECT round(sum(abs(p - q)) / 2, 9) AS distance, count(*) FILTER (q = 0) AS m FROM (SELECT domain, count(*) FILTER (split = 'train') / (SELECT count(*) FROM v_headers WHERE split = 'train') AS p, count(*) FILTER (split = 'test') / (SELECT count(*) FROM v_headers WHERE split = 'test') AS q FROM v_headers GROUP BY domain))"""))
def v11_drift_gate(spark, sf_dir):
    h = views.headers(spark, sf_dir)
    return validate.drift_gate(rounded(aggregates.total_variation(h.filter("split = 'train'"), h.filter("split = 'test'"), ["domain"]), "distance"), 0.15)


@query("v7_json_answers", "SELECT event_id, CASE WHEN CAST(props->>'$.k' AS INTEGER) > 9 THEN 'missing:verdict,length:k' ELSE 'missing:verdict' END AS problems FROM events")
def v7_json_answers(spark, sf_dir):
    d = validate.json_fields(views.table(spark, sf_dir, "events").select("event_id", "props"), "props", ["k", "verdict"], {"verdict": ["MATCH"]}, {"k": 1})
    return d.select("event_id", F.array_join("problems", ",").alias("problems"))
