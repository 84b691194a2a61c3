"""Queries over rules, treatments, features and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritill.operators import features, rules
from veritill.sources import views

from .oracle import h8, sql
from .registry import query


def treated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False)
    return df.withColumn("treatment", rules.signal_treatment(F.col("signals")))


@query("r2_treatment_by_domain", sql("SELECT domain, treatment, count(*) AS carts, CAST(sum(total_amount_minor) AS BIGINT) AS amount_minor FROM v_treated GROUP BY ALL"))
def r2_treatment_by_domain(spark, sf_dir):
    return treated(spark, sf_dir).groupBy("domain", "treatment").agg(F.count(F.lit(1)).alias("carts"), F.sum("total_amount_minor").alias("amount_minor"))


@query("r1_commercial_signals", sql("SELECT 'ex_' || order_key AS example_id, rule_id, status, severity, reason FROM v_signals"))
def r1_commercial_signals(spark, sf_dir):
    # the expression and not a column of it: from a column Spark infers a filter on its size, which works out items and signals once more
    s = F.explode(rules.commercial_signals(shown=False)).alias("s")
    return views.examples(spark, sf_dir, for_rules=True).select("example_id", s).select("example_id", "s.rule_id", "s.status", "s.severity", "s.reason")


@query("r1_outcome_codes", sql("SELECT example_id, fails AS failures, critical_fails AS critical, missing, array_to_string(reasons, ',') AS reasons FROM v_treated"))
def r1_outcome_codes(spark, sf_dir):
    df = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False)
    fails = rules.failed(F.col("signals"))
    return df.select(
        "example_id", F.size(fails).cast("bigint").alias("failures"), F.size(F.filter(fails, lambda s: s["severity"] == "critical")).cast("bigint").alias("critical"),
        F.size(F.filter("signals", lambda s: s["status"] == "NOT_EVALUABLE")).cast("bigint").alias("missing"), F.array_join(F.filter(F.transform("signals", lambda s: s["reason"]), lambda r: r.isNotNull()), ",").alias("reasons"),
    )


#: Online state of an order, from its keys.
ONLINE = {"signature_valid": "order_key % 97 <> 0", "mandate_status": "CASE WHEN cust_key % 31 = 0 THEN 'revoked' ELSE 'active' END", "evidence_trust": "CASE WHEN order_key % 13 = 0 THEN 'untrusted' ELSE 'trusted' END", "replayed": "order_key % 29 = 0", "late": "occurred_at > TIMESTAMP '2000-06-01 00:00:00'"}


def online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as a decision request sees them."""
    df = views.examples(spark, sf_dir, for_rules=True).withColumns(views.scores(F.col("example_id")))
    df = df.withColumns({k: F.expr(v) for k, v in ONLINE.items() if k not in ("replayed", "late")})
    df = df.withColumns(
        {
            "state_status": F.lit("active"), "evidence_source": F.lit("merchant_api"), "cart_id": F.concat(F.lit("cart_"), F.col("order_key").cast("string")),
            "valid_from": F.lit("1990-01-01 00:00:00").cast("timestamp"), "expires_at": F.lit("2000-06-01 00:00:00").cast("timestamp"),
        }
    )
    df = df.withColumn("prior_transaction_ids", F.when(F.expr(ONLINE["replayed"]), F.array("cart_id")).otherwise(F.array(F.lit("other"))))
    return df.withColumn("signals", F.concat(rules.pre_signals(F.col("occurred_at").cast("timestamp"), shown=False), rules.commercial_signals(shown=False)))


_ONLINE = f"""SELECT *, ({ONLINE['signature_valid']}) AS signature_valid, {ONLINE['mandate_status']} AS mandate_status, {ONLINE['evidence_trust']} AS evidence_trust, ({ONLINE['replayed']}) AS replayed, ({ONLINE['late']}) AS late,
  semantic_contradiction >= 0.8 AS contradicted, semantic_neutral >= 0.6 AS uncertain, probability >= 0.7 AS escalated
  FROM v_treated JOIN (SELECT example_id, semantic_contradiction, semantic_neutral, probability FROM v_features) USING (example_id)"""
_POLICY = """SELECT *, CASE WHEN hold OR NOT signature_valid OR mandate_status <> 'active' OR late OR replayed THEN 'HOLD' WHEN ask OR evidence_trust <> 'trusted' OR contradicted OR uncertain OR escalated THEN 'STEP_UP' ELSE 'APPROVE' END AS outcome,
  list_filter([CASE WHEN NOT signature_valid THEN 'MANDATE_AUTHORIZATION_INVALID' END, CASE WHEN mandate_status <> 'active' THEN 'MANDATE_NOT_ACTIVE' END, CASE WHEN late THEN 'MANDATE_EXPIRED_OR_NOT_YET_VALID' END,
    CASE WHEN evidence_trust <> 'trusted' THEN 'TRUSTED_CART_EVIDENCE_MISSING' END, CASE WHEN replayed THEN 'CART_REPLAY_DETECTED' END], lambda x: x IS NOT NULL) AS first_codes FROM v_online"""


@query(
    "r4_online_policy",
    sql(
        """SELECT example_id, outcome AS treatment, CASE outcome WHEN 'HOLD' THEN 0.99 WHEN 'STEP_UP' THEN greatest(probability, 0.55) ELSE probability END AS probability,
        CASE WHEN outcome = 'HOLD' THEN 'high' WHEN outcome = 'STEP_UP' OR probability >= 0.3 THEN 'moderate' ELSE 'low' END AS band,
        array_to_string(list_concat(list_concat(first_codes, reasons_once), list_filter([CASE WHEN contradicted THEN 'REQUIRED_ATTRIBUTE_CONTRADICTED' END, CASE WHEN uncertain THEN 'REQUIRED_ATTRIBUTE_EVIDENCE_MISSING' END,
          CASE WHEN escalated AND outcome <> 'HOLD' THEN 'MODEL_RISK_THRESHOLD_EXCEEDED' END], lambda x: x IS NOT NULL)), ',') AS reason_codes
        FROM (SELECT *, list_filter(reasons, lambda x, i: list_position(reasons, x) = i) AS reasons_once FROM v_policy)""",
        v_online=_ONLINE,
        v_policy=_POLICY,
    ),
)
def r4_online_policy(spark, sf_dir):
    df = online(spark, sf_dir)
    p = rules.online_policy(F.col("signals"), F.array("semantic_contradiction"), F.array("semantic_neutral"), F.col("probability"), 0.7)
    return df.select("example_id", p.alias("p")).select("example_id", "p.treatment", "p.probability", "p.band", F.array_join("p.reason_codes", ",").alias("reason_codes"))


@query("r3_online_signals", sql("SELECT outcome AS treatment, len(first_codes) AS pre_failures, count(*) AS n FROM v_policy GROUP BY ALL", v_online=_ONLINE, v_policy=_POLICY))
def r3_online_signals(spark, sf_dir):
    df = online(spark, sf_dir)
    p = rules.online_policy(F.col("signals"), F.array("semantic_contradiction"), F.array("semantic_neutral"), F.col("probability"), 0.7)
    pre = F.size(F.filter(F.slice("signals", 1, 5), lambda s: s["status"] != "PASS")).cast("bigint")
    return df.select(p["treatment"].alias("treatment"), pre.alias("pre_failures")).groupBy("treatment", "pre_failures").agg(F.count(F.lit(1)).alias("n"))


@query("r5_offline_policy", sql("SELECT expected_treatment, predicted_treatment, count(*) AS n FROM v_predicted GROUP BY ALL"))
def r5_offline_policy(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    return f.withColumn("predicted_treatment", rules.offline_policy(F.col("probability"), 0.9)).groupBy("expected_treatment", "predicted_treatment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r6_heuristic_nli",
    sql("""SELECT 'ex_' || order_key AS example_id, CASE WHEN bool_or(part_key % 4 = 1) THEN 0.97 WHEN bool_or(part_key % 4 = 0) THEN 0.01 ELSE 0.05 END AS contradiction,
    CASE WHEN bool_or(part_key % 4 = 1) THEN 0.02 WHEN bool_or(part_key % 4 = 0) THEN 0.02 ELSE 0.9 END AS neutral, CASE WHEN bool_or(part_key % 4 = 1) THEN 0.01 WHEN bool_or(part_key % 4 = 0) THEN 0.97 ELSE 0.05 END AS entailment
    FROM v_lines WHERE order_key IN (SELECT order_key FROM v_examples WHERE cust_key % 2 = 1) GROUP BY order_key"""),
)
def r6_heuristic_nli(spark, sf_dir):
    wanted = F.filter("constraints", lambda c: c["type"] == "semantic_attribute")
    df = views.examples(spark, sf_dir).select("example_id", "items", F.explode(wanted).alias("c"))
    s = rules.heuristic_nli(F.col("items"), F.col("c.value_list")[0])
    return df.select("example_id", s.alias("s")).select("example_id", "s.contradiction", "s.neutral", "s.entailment")


@query("r7_heuristic_risk", sql("SELECT example_id, round(least(0.99::DOUBLE, 0.04::DOUBLE + 0.35::DOUBLE * least(fails, 2) + 0.45::DOUBLE * semantic_contradiction + 0.18::DOUBLE * semantic_neutral), 9) AS risk FROM v_treated JOIN (SELECT example_id, semantic_contradiction, semantic_neutral FROM v_features) USING (example_id)"))
def r7_heuristic_risk(spark, sf_dir):
    df = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False).withColumns(views.scores(F.col("example_id")))
    return df.select("example_id", F.round(rules.heuristic_risk(F.size(rules.failed(F.col("signals"))), F.col("semantic_contradiction"), F.col("semantic_neutral")), 9).alias("risk"))


_LOGIT = "ln(greatest(least({0}, 1 - 1e-6), 1e-6) / (1 - greatest(least({0}, 1 - 1e-6), 1e-6)))"
_STACK = "1 / (1 + exp(-greatest(least({0}, 40), -40)))"


@query(
    "r8_fused_score",
    sql(f"""SELECT example_id, round({_STACK.format(f"({_LOGIT.format('stacked')} * 0.9 - 0.1)")}, 9) AS score FROM (
    SELECT example_id, {_STACK.format(f"({_LOGIT.format('probability')} - 0.5 + semantic_contradiction * 1.2 + semantic_neutral * 0.4 + hard_fail_count * 0.8)")} AS stacked FROM v_features)"""),
)
def r8_fused_score(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    weights = [(F.col("semantic_contradiction"), 1.2), (F.col("semantic_neutral"), 0.4), (F.col("hard_fail_count"), 0.8)]
    return f.select("example_id", F.round(features.fused_score(F.col("probability"), weights, -0.5, 0.9, -0.1), 9).alias("score"))


_TEMPLATES = "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in rules.TEMPLATES.items()) + "}"


@query(
    "x21_explanation",
    sql(f"""SELECT example_id, CASE WHEN len(codes) = 0 THEN 'The proposed purchase matches the confirmed mandate.' ELSE array_to_string(list_transform(codes[1:2], lambda c: t[c]), ' ') END AS card_member,
    CASE WHEN len(codes) = 0 THEN 'No blocking or uncertainty reason codes were produced.' ELSE array_to_string(list_transform(codes, lambda c: c || ': ' || t[c]), ' ') END AS reviewer
    FROM (SELECT example_id, list_filter(reasons, lambda x, i: list_position(reasons, x) = i) AS codes, {_TEMPLATES} AS t FROM v_treated)"""),
)
def x21_explanation(spark, sf_dir):
    df = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False)
    return df.select("example_id", rules.explanation(rules.reason_codes(F.col("signals"))).alias("e")).select("example_id", "e.card_member", "e.reviewer")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.canonical_rows(rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False).withColumns(views.scores(F.col("example_id"))))


_CANONICAL = """SELECT example_id, group_id, parent_example_id, split, locale, domain, budget AS budget_minor, total_amount_minor AS cart_amount_minor, fulfilled_amount_minor, fulfillment_count, max_fulfillments, line_item_count,
  CASE WHEN evidence_sufficiency <> 'sufficient' THEN 1 ELSE 0 END AS missing_evidence_count, semantic_contradiction, semantic_neutral, fails AS hard_fail_count, critical_fails AS critical_hold_count,
  CASE WHEN evidence_sufficiency <> 'sufficient' THEN 1 ELSE 0 END AS soft_warning_count, budget_currency AS currency, currency AS cart_currency, cust_key % 4 = 0 AND merchant_category = 'PROMO' AS category_mismatch,
  merchant_category, evidence_sufficiency, CASE WHEN relevance = 'E' THEN 0 WHEN relevance IN ('C', 'I') THEN 1 END AS label, attack_family, label_source
  FROM v_treated JOIN (SELECT example_id, semantic_contradiction, semantic_neutral, semantic_entailment FROM v_features) USING (example_id)"""


@query("e1_canonical_features", sql(_CANONICAL))
def e1_canonical_features(spark, sf_dir):
    return canonical(spark, sf_dir)


_VECTOR = """SELECT *, cart_amount_minor / greatest(budget_minor, 1) AS amount_ratio, (cart_amount_minor - greatest(budget_minor, 1)) / greatest(budget_minor, 1) AS amount_delta_ratio,
  (fulfilled_amount_minor + cart_amount_minor) / greatest(budget_minor, 1) AS cumulative_utilization, (fulfillment_count + 1) / greatest(max_fulfillments, 1) AS fulfillment_utilization,
  CAST(currency <> cart_currency AS INTEGER)::DOUBLE AS currency_mismatch, CAST(category_mismatch AS INTEGER)::DOUBLE AS category_double FROM v_canonical"""


@query(
    "e2_feature_vector",
    sql(
        """SELECT example_id, amount_ratio, amount_delta_ratio, cumulative_utilization, fulfillment_utilization, line_item_count::DOUBLE AS line_item_count, missing_evidence_count::DOUBLE AS missing_evidence_count,
        semantic_contradiction, semantic_neutral, hard_fail_count::DOUBLE AS hard_fail_count, soft_warning_count::DOUBLE AS soft_warning_count, currency_mismatch, category_double AS category_mismatch, domain, merchant_category, evidence_sufficiency FROM v_vector""",
        v_canonical=_CANONICAL,
        v_vector=_VECTOR,
    ),
)
def e2_feature_vector(spark, sf_dir):
    return features.profile(features.vector(canonical(spark, sf_dir)), "full-v2", "example_id")


@query(
    "e3_semantic_features",
    sql("""SELECT example_id, round(greatest(c, n), 9) AS semantic_risk, round(-(c * ln(c) + n * ln(n) + e * ln(e)) / ln(3), 9) AS semantic_entropy,
    round(list_sort([c, n, e])[3] - list_sort([c, n, e])[2], 9) AS semantic_top2_margin, round(c - e, 9) AS semantic_contradiction_entailment_margin
    FROM (SELECT example_id, semantic_contradiction AS c, semantic_neutral AS n, semantic_entailment AS e FROM v_features)"""),
)
def e3_semantic_features(spark, sf_dir):
    return features.semantic_values(views.feature_rows(spark, sf_dir)).select("example_id", *(F.round(n, 9).alias(n) for n in features.SEMANTIC[1:]))


@query(
    "e4_shortcut_safe_profile",
    sql(
        """SELECT example_id, amount_ratio, amount_delta_ratio, cumulative_utilization, fulfillment_utilization, missing_evidence_count::DOUBLE AS missing_evidence_count, hard_fail_count::DOUBLE AS hard_fail_count,
        soft_warning_count::DOUBLE AS soft_warning_count, currency_mismatch, category_double AS category_mismatch, domain, merchant_category, evidence_sufficiency FROM v_vector""",
        v_canonical=_CANONICAL,
        v_vector=_VECTOR,
    ),
)
def e4_shortcut_safe_profile(spark, sf_dir):
    return features.profile(features.vector(canonical(spark, sf_dir)), "shortcut-safe-no-semantic-v2", "example_id")


@query(
    "e5_runtime_parity",
    sql(
        """SELECT evidence, count(*) AS n, sum(missing) AS missing, avg(CASE WHEN missing > 0 THEN 1.0 ELSE 0 END) AS ambiguous FROM (SELECT evidence_sufficiency AS evidence, missing FROM v_treated) GROUP BY evidence""".replace("sum(missing)", "CAST(sum(missing) AS BIGINT)"),
    ),
)
def e5_runtime_parity(spark, sf_dir):
    df = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False).withColumns(views.scores(F.col("example_id")))
    rows = features.runtime_rows(df)
    rows = rows.join(df.select("example_id", F.col("evidence_sufficiency").alias("evidence")), "example_id")
    return rows.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"), F.sum("missing_evidence_count").alias("missing"), F.avg((F.col("evidence_sufficiency") == "ambiguous").cast("double")).alias("ambiguous"))
