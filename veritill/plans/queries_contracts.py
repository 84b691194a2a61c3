"""Queries over role extracts, gates, promotion, audits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritill.operators import contracts, metrics, rules, stateful, validate
from veritill.sources import storage, views

from .oracle import sql
from .queries_joins import predicted, rounded
from .registry import query

_ORIGIN = "CASE WHEN order_key % 4 = 0 THEN 'synthetic' ELSE 'real_public' END"


def with_origin(spark, sf_dir):
    return views.headers(spark, sf_dir).withColumn("evidence_origin", F.when(F.col("order_key") % 4 == 0, "synthetic").otherwise("real_public"))


@query("f4_eligible_semantic", sql(f"SELECT example_id FROM v_headers WHERE {_ORIGIN} = 'real_public' AND attack_family = 'none'"))
def f4_eligible_semantic(spark, sf_dir):
    return contracts.eligible_semantic(with_origin(spark, sf_dir)).select("example_id")


@query("f5_target_rows", sql("""SELECT mode, split, target, count(*) AS n FROM (SELECT 'policy_intervention' AS mode, split, CASE WHEN expected_treatment <> 'APPROVE' THEN 1 ELSE 0 END AS target FROM v_features WHERE domain <> 'dining'
    UNION ALL SELECT 'binary_deviation', split, label FROM v_features WHERE domain <> 'travel') WHERE split IN ('train', 'test') GROUP BY ALL"""))
def f5_target_rows(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir).select("split", "domain", "expected_treatment", "label")
    f = f.withColumns({"expected_treatment": F.when(F.col("domain") != "dining", F.col("expected_treatment")), "label": F.when(F.col("domain") != "travel", F.col("label")).otherwise(2)})
    parts = [contracts.target_rows(f, s, m).withColumn("mode", F.lit(m)) for m in ("policy_intervention", "binary_deviation") for s in ("train", "test")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("mode", "split", "target").agg(F.count(F.lit(1)).alias("n"))


@query("f6_unreviewed", sql("SELECT locale, count(*) AS n FROM v_headers WHERE label_source = 'weak_policy' GROUP BY locale"))
def f6_unreviewed(spark, sf_dir):
    h = views.headers(spark, sf_dir).withColumn("label_source", F.when(F.col("label_source") == "weak_policy", "unreviewed").otherwise(F.col("label_source")))
    both = contracts.unreviewed(h, "us").unionByName(contracts.unreviewed(h, "jp"))
    return both.groupBy("locale").agg(F.count(F.lit(1)).alias("n"))


@query("f7_role_counts", sql("""SELECT r.role, coalesce(n, 0) AS n, expected FROM (VALUES ('train', 100), ('validation', 100), ('golden', 1)) r(role, expected) LEFT JOIN (SELECT split AS role, count(*) AS n FROM v_headers GROUP BY 1) USING (role) WHERE coalesce(n, 0) <> expected
    UNION ALL SELECT 'extracted', count(*), -1 FROM v_headers WHERE split IN ('train', 'validation')"""))
def f7_role_counts(spark, sf_dir):
    rows, off = contracts.role_extract(views.headers(spark, sf_dir), {"train": 100, "validation": 100}, "golden", 1)
    return off.unionByName(rows.agg(F.lit("extracted").alias("role"), F.count(F.lit(1)).alias("n"), F.lit(-1).cast("bigint").alias("expected")))


@query("j11_retry_overlay", sql("SELECT order_key, CASE WHEN order_key % 9 = 0 THEN 'again' ELSE relevance END AS verdict, order_key % 9 = 0 AS retried FROM v_headers"))
def j11_retry_overlay(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("order_key", F.concat(F.lit("judge:"), "example_id").alias("custom_id"), F.col("relevance").alias("verdict"))
    again = h.filter("order_key % 9 = 0").select("custom_id", F.lit("again").alias("verdict"))
    return contracts.retry_overlay(h, again, "custom_id", "order_key", ["verdict"]).select("order_key", "verdict", "retried")


@query("j17_challenge_cohort", sql("SELECT count(*) AS violations, round(count(*) FILTER (predicted_treatment <> 'APPROVE') / count(*), 9) AS recall FROM v_predicted WHERE expected_treatment <> 'APPROVE' AND label_source = 'llm_assisted' AND domain = 'travel'"))
def j17_challenge_cohort(spark, sf_dir):
    p = predicted(spark, sf_dir)
    ledger = p.filter("label_source = 'llm_assisted'").select("example_id", F.when(F.col("domain") == "travel", "challenge").otherwise("plain").alias("cohort"))
    return rounded(contracts.cohort_recall(p, ledger, "challenge"), "recall")


_SPLIT_FIGURES = """SELECT split, count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / count(*) FILTER (expected_treatment <> 'APPROVE') AS violation_recall, count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'STEP_UP') / count(*) FILTER (expected_treatment = 'APPROVE') AS false_step_up_rate,
    count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'HOLD') / count(*) FILTER (expected_treatment = 'APPROVE') AS false_decline_rate FROM v_predicted GROUP BY split"""
_SPLIT_ECE = "SELECT split, sum(abs(y / n - p / n) * n) / sum(n) AS ece FROM (SELECT split, least(floor(probability * 10 + 1e-12), 9) AS b, count(*) AS n, sum(label) AS y, sum(probability) AS p FROM v_features GROUP BY 1, 2) GROUP BY split"
_SPLIT_FAMILY = "SELECT split, coalesce(min(r) FILTER (v >= {rows}), {none}) AS family_recall FROM (SELECT split, attack_family, count(*) FILTER (expected_treatment <> 'APPROVE') AS v, coalesce(count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / nullif(count(*) FILTER (expected_treatment <> 'APPROVE'), 0), 0) AS r FROM v_predicted GROUP BY 1, 2) GROUP BY split"
_SPLIT_AP = "SELECT split, sum(y * tp / seen) / sum(y) AS {name} FROM (SELECT split, y, sum(y) OVER w AS tp, sum(n) OVER w AS seen FROM (SELECT split, {score} AS s, sum(label) AS y, count(*) AS n FROM v_features GROUP BY 1, 2) WINDOW w AS (PARTITION BY split ORDER BY s DESC)) GROUP BY split"


def gated(spark, sf_dir, of):
    """What a function makes of the predicted rows, which all its figures read from one stored table; that is deleted again."""
    read = ("split", "attack_family", "label_source", "expected_treatment", "predicted_treatment", "label", "probability", "semantic_contradiction")
    with storage.scratch():
        return storage.stored(of(storage.stored(predicted(spark, sf_dir).select(*read))), lasting=True)


def split_figures(p):
    """Policy rates, calibration and ranking of each split of predicted rows."""
    out = metrics.treatment_metrics(p, "expected_treatment", "predicted_treatment", ("split",)).select("split", "violation_recall", "false_step_up_rate", "false_decline_rate")
    out = out.join(metrics.calibration_error(p, "label", "probability", by=("split",)).select("split", "ece"), "split")
    ap = lambda score, name: metrics.average_precision(p, "label", score, ("split",)).withColumnRenamed("average_precision", name)
    return out.join(ap("probability", "pr_auc"), "split").join(ap("semantic_contradiction", "baseline_pr_auc"), "split")


_FIGURES = {"v_rates": _SPLIT_FIGURES, "v_ece": _SPLIT_ECE, "v_ap": _SPLIT_AP.format(name="pr_auc", score="probability"), "v_base": _SPLIT_AP.format(name="baseline_pr_auc", score="semantic_contradiction")}


@query(
    "k2_development_gate",
    sql(
        """SELECT split, violation_recall >= 0.9 AS operational_recall, false_step_up_rate <= 0.1 AS false_step_up, false_decline_rate <= 0.02 AS false_decline, ece <= 0.08 AS calibration, family_recall >= 0.8 AS supported_families, none_recall >= 0.8 AS reviewed_none, pr_auc >= baseline_pr_auc - 0.01 AS pr_auc_regression
        FROM v_rates JOIN v_ece USING (split) JOIN v_ap USING (split) JOIN v_base USING (split) JOIN v_family USING (split) JOIN v_none USING (split)""",
        **_FIGURES, v_family=_SPLIT_FAMILY.format(rows=50, none=1.0),
        v_none="SELECT split, count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / greatest(count(*) FILTER (expected_treatment <> 'APPROVE'), 1) AS none_recall FROM v_predicted WHERE attack_family = 'none' AND label_source = 'llm_assisted' GROUP BY split",
    ),
)
def k2_development_gate(spark, sf_dir):
    names = ("operational_recall", "false_step_up", "false_decline", "calibration", "supported_families", "reviewed_none", "pr_auc_regression")

    def of(p):
        families = metrics.treatment_metrics(p, "expected_treatment", "predicted_treatment", ("split", "attack_family"))
        none = metrics.treatment_metrics(p.filter("attack_family = 'none' and label_source = 'llm_assisted'"), "expected_treatment", "predicted_treatment", ("split",)).select("split", F.col("violation_recall").alias("reviewed_none_recall"))
        f = split_figures(p).join(contracts.worst_family(families, contracts.DEVELOPMENT_LIMITS["family_rows"], 1.0, ["split"]), "split").join(none, "split")
        return contracts.development_gate(f, ["split"]).select("split", *(F.col("checks")[k]["passed"].alias(n) for k, n in enumerate(names)))

    return gated(spark, sf_dir, of)


_GOLDEN = " UNION ALL ".join(f"SELECT split, '{k}' AS criterion, {k}::DOUBLE AS actual, '{op}' AS operator, {v}::DOUBLE AS \"limit\", {k} {op} {v} AS passed FROM v_all" for k, (op, v) in contracts.GOLDEN_LIMITS.items())


@query(
    "k3_golden_gate",
    sql(
        """SELECT split, criterion, round(actual, 9) AS actual, operator, "limit", passed, CASE WHEN bool_and(passed) OVER (PARTITION BY split) THEN 'passed' ELSE 'failed_gate' END AS status FROM v_criteria""",
        **_FIGURES, v_family=_SPLIT_FAMILY.format(rows=25, none=1.0), v_all="SELECT *, pr_auc - baseline_pr_auc AS pr_auc_delta, violation_recall - family_recall AS fixed_rate_recall_delta FROM v_rates JOIN v_ece USING (split) JOIN v_ap USING (split) JOIN v_base USING (split) JOIN v_family USING (split)", v_criteria=_GOLDEN,
    ),
)
def k3_golden_gate(spark, sf_dir):
    def of(p):
        families = metrics.treatment_metrics(p, "expected_treatment", "predicted_treatment", ("split", "attack_family"))
        f = split_figures(p).join(contracts.worst_family(families, contracts.GOLDEN_FAMILY_ROWS, 1.0, ["split"]), "split")
        f = f.withColumns({"pr_auc_delta": F.col("pr_auc") - F.col("baseline_pr_auc"), "fixed_rate_recall_delta": F.col("violation_recall") - F.col("family_recall")})
        return rounded(contracts.golden_gate(f, ["split"]), "actual")

    return gated(spark, sf_dir, of)


@query(
    "k4_stage_gates",
    sql(
        """SELECT split, CASE WHEN violation_recall < 0.9 AND n >= 40 AND pr_auc >= 0.3 AND violation_recall >= 0.2 AND false_step_up_rate <= 0.4 THEN 'PROCEED' ELSE 'STOP' END AS diagnosis,
        CASE WHEN violation_recall >= 0.2 AND false_step_up_rate <= 0.4 AND false_decline_rate <= 0.05 AND violation_recall >= 0.25 - 0.02 AND ece <= 0.5 AND pr_auc >= baseline_pr_auc - 0.1 AND pr_auc >= baseline_pr_auc - 0.05 THEN 'PROCEED' ELSE 'STOP' END AS candidate
        FROM v_rates JOIN v_ece USING (split) JOIN v_ap USING (split) JOIN v_base USING (split) JOIN (SELECT split, count(*) FILTER (expected_treatment <> 'APPROVE') AS n FROM v_predicted GROUP BY 1) USING (split)""",
        **_FIGURES,
    ),
)
def k4_stage_gates(spark, sf_dir):
    def of(p):
        n = metrics.treatment_metrics(p, "expected_treatment", "predicted_treatment", ("split",)).select("split", F.col("violation_rows").alias("reviewed_violations"))
        f = split_figures(p).join(n, "split")
        c = F.col
        f = f.withColumns(
            {
                "reviewed_recall": c("violation_recall"), "oracle_semantic_recall": c("pr_auc"), "oracle_recall": c("violation_recall"), "oracle_false_step_up": c("false_step_up_rate"), "baseline_recall": F.lit(0.25), "macro_f1": c("pr_auc"), "baseline_macro_f1": c("baseline_pr_auc"),
                "minority_recall": c("pr_auc"), "baseline_minority_recall": c("baseline_pr_auc"),
            }
        )
        first = contracts.diagnosis_gate(f, ["split"], 0.9, 40, 0.3, 0.2, 0.4).select("split", F.col("status").alias("diagnosis"))
        second = contracts.regression_gate(f, ["split"], 0.2, 0.4, 0.05, 0.02, 0.5, 0.1, -0.05).select("split", F.col("status").alias("candidate"))
        return first.join(second, "split")

    return gated(spark, sf_dir, of)


@query(
    "k6_promotion",
    """SELECT s_suppkey AS artifact, array_to_string(list_filter([CASE WHEN k % 7 = 1 THEN 'not_passed' END, CASE WHEN k % 11 = 1 THEN 'split' END, CASE WHEN k % 6 = 1 OR k % 10 = 9 THEN 'criteria' END, CASE WHEN k % 5 = 2 THEN 'dataset' END, CASE WHEN k % 13 = 3 THEN 'binding' END, CASE WHEN k % 9 = 4 THEN 'profile' END,
      CASE WHEN k % 8 = 3 THEN 'target_mode' END, CASE WHEN k % 12 = 5 THEN 'model_hold' END, CASE WHEN k % 4 = 3 THEN 'synthetic' END, CASE WHEN k % 15 = 2 THEN 'semantic_versions' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT *, s_suppkey AS k FROM supplier)""",
)
def k6_promotion(spark, sf_dir):
    k = F.col("s_suppkey")
    s = views.table(spark, sf_dir, "supplier").select(k.alias("artifact"), "s_suppkey")
    profile = F.when(k % 9 == 4, "canonical-v2").otherwise("shortcut-safe-v2")
    manifests = s.select(
        "artifact", F.lit("m1").alias("model_version"), F.lit("d1").alias("dataset_sha256"), F.sha2(k.cast("string"), 256).alias("manifest_sha256"), profile.alias("feature_profile"), F.when(k % 8 == 3, "binary_deviation").otherwise("policy_intervention").alias("target_mode"),
        F.lit("complete-policy-validation-v1").alias("threshold_method"), (k % 12 == 5).alias("model_hold_enabled"), F.when(k % 4 == 3, "synthetic-1").otherwise("v3").alias("dataset_version"), F.when(k % 15 == 2, F.array(F.lit("unknown"))).otherwise(F.array(F.lit("nli-1"))).alias("semantic_versions"),
    )
    reports = s.select(
        "artifact", F.when(k % 7 == 1, "failed_gate").otherwise("passed").alias("status"), F.lit("golden-evaluation-v2").alias("schema_version"), F.when(k % 11 == 1, "test").otherwise("golden").alias("split"), F.when(k % 10 == 9, F.array().cast("array<boolean>")).otherwise(F.array(F.lit(True), k % 6 != 1)).alias("criteria"),
        F.lit("m1").alias("model_version"), F.when(k % 5 == 2, "d0").otherwise("d1").alias("dataset_sha256"), F.sha2((k + F.when(k % 13 == 3, 1).otherwise(0)).cast("string"), 256).alias("manifest_sha256"), profile.alias("feature_profile"),
    )
    return contracts.promotable(manifests, reports).select("artifact", F.array_join("problems", ",").alias("problems"))


_CANDIDATES = "SELECT domain, split || ':' || attack_family AS name, coalesce(count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / nullif(count(*) FILTER (expected_treatment <> 'APPROVE'), 0), 0) AS r, coalesce(count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'STEP_UP') / nullif(count(*) FILTER (expected_treatment = 'APPROVE'), 0), 0) AS f, coalesce(count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'HOLD') / nullif(count(*) FILTER (expected_treatment = 'APPROVE'), 0), 0) AS d FROM v_predicted GROUP BY 1, 2"


@query("t5_candidate_choice", sql("SELECT domain, name, round(r, 9) AS violation_recall FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY r DESC, f, d, name) AS k FROM v_candidates WHERE f <= 0.35 + 1e-12 AND d <= 0.05 + 1e-12) WHERE k = 1", v_candidates=_CANDIDATES))
def t5_candidate_choice(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("name", F.concat_ws(":", "split", "attack_family"))
    m = metrics.treatment_metrics(p, "expected_treatment", "predicted_treatment", ("domain", "name"))
    best = contracts.choose_candidate(contracts.eligible_candidates(m, 0.35, 0.05), ["domain"])
    return rounded(best.select("domain", "name", "violation_recall"), "violation_recall")


@query("c21_metric_mismatches", sql("SELECT split, 'false_decline_rate' AS metric, round(false_decline_rate + 0.001, 9) AS recorded, round(false_decline_rate, 9) AS recomputed FROM v_rates WHERE split IN ('test', 'golden')", v_rates=_SPLIT_FIGURES))
def c21_metric_mismatches(spark, sf_dir):
    names = ["violation_recall", "false_step_up_rate", "false_decline_rate"]
    m = metrics.treatment_metrics(predicted(spark, sf_dir), "expected_treatment", "predicted_treatment", ("split",)).select("split", *names)
    recorded = m.withColumn("false_decline_rate", F.col("false_decline_rate") + F.when(F.col("split").isin("test", "golden"), 0.001).otherwise(0.0))
    return rounded(contracts.metric_mismatches(recorded, m, "split", names), "recorded", "recomputed")


@query("c22_diagnosis", sql("""SELECT 'domain' AS dimension, domain AS category, count(*) AS rows, CAST(sum(CAST(a <> b AS INTEGER)) AS BIGINT) AS changed, CAST(sum(CAST(b > a AS INTEGER)) AS BIGINT) AS tightened, round(avg(CAST(a <> b AS INTEGER)), 9) AS change_rate FROM v_two GROUP BY 2
    UNION ALL SELECT 'attack_family', attack_family, count(*), CAST(sum(CAST(a <> b AS INTEGER)) AS BIGINT), CAST(sum(CAST(b > a AS INTEGER)) AS BIGINT), round(avg(CAST(a <> b AS INTEGER)), 9) FROM v_two GROUP BY 2""",
    v_two="SELECT domain, attack_family, CASE expected_treatment WHEN 'APPROVE' THEN 0 WHEN 'STEP_UP' THEN 1 ELSE 2 END AS a, CASE predicted_treatment WHEN 'APPROVE' THEN 0 WHEN 'STEP_UP' THEN 1 ELSE 2 END AS b FROM v_predicted"))
def c22_diagnosis(spark, sf_dir):
    return rounded(contracts.diagnosis(predicted(spark, sf_dir), "expected_treatment", "predicted_treatment", ["domain", "attack_family"]), "change_rate")


_LABELS = "CASE WHEN relevance IN ('C', 'I') THEN 'CONTRADICTION' WHEN relevance = 'S' THEN 'NEUTRAL' ELSE 'ENTAILMENT' END"


@query("r11_review_labels", sql(f"SELECT label_source, semantic_outcome, policy_intervention_target, count(*) AS n FROM (SELECT 'llm_assisted_v4' AS label_source, {_LABELS} AS semantic_outcome, CASE relevance WHEN 'E' THEN 'APPROVE' WHEN 'S' THEN 'STEP_UP' ELSE 'HOLD' END AS policy_intervention_target FROM v_headers WHERE label_source = 'llm_assisted') GROUP BY ALL"))
def r11_review_labels(spark, sf_dir):
    from veritill.operators.transforms import weak_labels

    h = views.headers(spark, sf_dir).filter("label_source = 'llm_assisted'")
    weak = weak_labels(F.col("relevance"))
    h = h.withColumns({"semantic_labels": F.array(F.lit("ENTAILMENT"), weak["semantic_label"]), "deviation": weak["deviation"], "expected_treatment": weak["expected_treatment"]})
    return contracts.review_labels(h).groupBy("label_source", "semantic_outcome", "policy_intervention_target").agg(F.count(F.lit(1)).alias("n"))


@query("r12_audit_treatment", sql("SELECT deterministic, expected, count(*) AS n, count(*) FILTER (expected = reviewed) AS agreed FROM (SELECT treatment AS deterministic, CASE WHEN treatment <> 'APPROVE' THEN treatment WHEN relevance = 'E' THEN 'APPROVE' ELSE 'STEP_UP' END AS expected, CASE relevance WHEN 'E' THEN 'APPROVE' WHEN 'S' THEN 'STEP_UP' ELSE 'HOLD' END AS reviewed FROM v_treated) GROUP BY ALL"))
def r12_audit_treatment(spark, sf_dir):
    from veritill.operators.transforms import weak_labels

    e = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False).withColumn("deterministic", rules.signal_treatment("signals"))
    weak = weak_labels(F.col("relevance"))
    none = F.when(weak["violation"].isNull(), F.array().cast("array<string>")).otherwise(F.array(weak["violation"]))
    e = e.withColumns({"expected": contracts.audit_treatment(F.col("deterministic"), weak["semantic_label"], weak["deviation"], none), "reviewed": weak["expected_treatment"]})
    return e.groupBy("deterministic", "expected").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("expected") == F.col("reviewed"), 1)).alias("agreed"))


def audit_queue(spark, sf_dir):
    """A blinded queue with some rows that leak, and its private ledger."""
    h = views.headers(spark, sf_dir)
    k, text = F.col("order_key"), lambda c: F.lit(c).cast("string")
    queue = h.filter("order_key % 50 <> 9").select(
        "order_key", "example_id", "group_id", F.when(k % 30 == 1, "MATCH").alias("deviation"), text(None).alias("expected_treatment"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("semantic_labels"), F.array().cast("array<string>").alias("violation_types"),
        F.when(k % 40 == 2, "reviewed").otherwise("unreviewed").alias("label_source"), F.when(k % 60 == 5, F.col("parent_example_id")).alias("parent_example_id"), text(None).alias("generator_version"), F.when(k % 70 == 3, "near_budget_match").otherwise("none").alias("transformation"),
    )
    return queue, h.filter("order_key % 50 <> 8").select("example_id")


@query("v12_blinding_leaks", sql("""SELECT 'labels' AS leak, count(*) FILTER (order_key % 30 = 1 OR order_key % 40 = 2) AS n FROM v_queue UNION ALL SELECT 'provenance', count(*) FILTER (order_key % 60 = 5 AND parent_example_id IS NOT NULL OR order_key % 70 = 3) FROM v_queue UNION ALL SELECT 'hidden_columns', 0
    UNION ALL SELECT 'unbound', count(*) FILTER (order_key % 50 = 8) FROM v_queue UNION ALL SELECT 'repeated_ids', 0 UNION ALL SELECT 'not_queued', count(*) FROM v_headers WHERE order_key % 50 = 9 UNION ALL SELECT 'repeated_groups', count(*) FROM (SELECT group_id FROM v_queue GROUP BY 1 HAVING count(*) > 1)""", v_queue="SELECT * FROM v_headers WHERE order_key % 50 <> 9"))
def v12_blinding_leaks(spark, sf_dir):
    return contracts.blinding_leaks(*audit_queue(spark, sf_dir))


@query("c1_review_queue", sql("""SELECT queue_role, example_id FROM (SELECT 'representative' AS queue_role, example_id FROM v_first UNION ALL SELECT 'hard', example_id FROM (SELECT example_id FROM v_features WHERE example_id NOT IN (SELECT example_id FROM v_first) ORDER BY abs(probability - 0.5), sha256('2026:review:' || example_id) LIMIT 80))""",
    v_first="SELECT example_id FROM (SELECT example_id, row_number() OVER (PARTITION BY domain, attack_family ORDER BY sha256('2026:review:' || example_id), example_id) AS r FROM v_features) WHERE r <= 5"))
def c1_review_queue(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir).select("example_id", "domain", "attack_family", (-F.abs(F.col("probability") - 0.5)).alias("hardness"))
    return contracts.review_queue(f, ["domain", "attack_family"], "hardness", 5, 80).select("queue_role", "example_id")


@query("c3_shares", "SELECT size, part, CAST(floor(size * p / 100) AS BIGINT) AS rows FROM (SELECT 10 * (2 + n_nationkey)::BIGINT AS size FROM nation), (VALUES ('single', 50), ('composite', 20), ('counterfactual', 20), ('review', 10)) v(part, p)")
def c3_shares(spark, sf_dir):
    sizes = views.table(spark, sf_dir, "nation").select((10 * (2 + F.col("n_nationkey"))).cast("bigint").alias("size"))
    return contracts.shares(sizes, "size", {"single": 50, "composite": 20, "counterfactual": 20, "review": 10})


@query("c5_one_annotation", sql("SELECT label, count(*) AS n FROM (SELECT " + _LABELS + " AS label FROM v_headers) GROUP BY label"))
def c5_one_annotation(spark, sf_dir):
    h = views.headers(spark, sf_dir).withColumn("annotations", F.array(views.pick({"E": "ENTAILMENT", "S": "NEUTRAL", "C": "CONTRADICTION", "I": "CONTRADICTION"}, F.col("relevance"))))
    return contracts.with_only(h, "annotations", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def profiled(spark, sf_dir):
    e = views.examples(spark, sf_dir)
    labels = F.array(views.pick({"E": "ENTAILMENT", "S": "NEUTRAL", "C": "CONTRADICTION", "I": "CONTRADICTION"}, F.col("relevance")))
    e = e.withColumns(
        {
            "semantic_labels": labels, "deviation": F.when(F.col("relevance") != "I", F.lit("MATCH")), "expected_treatment": F.lit(None).cast("string"), "transformation": F.col("attack_family"), "evidence_origin": F.when(F.col("order_key") % 4 == 0, "synthetic").otherwise("real_public"),
            "evidence_text": F.array_join(F.transform("items", lambda i: i["description"]), "\n"),
        }
    )
    return contracts.with_profile(e, F.transform(F.filter("constraints", lambda c: c["type"] == "total_budget"), lambda c: c["amount_minor"]))


_PROFILE = f"""SELECT *, label_source || '|' || CASE WHEN relevance = 'I' THEN 'UNLABELED' ELSE 'MATCH' END || '|' || {_LABELS} || '|' || attack_family || '|' || evidence_sufficiency || '|' || {_ORIGIN} || '|' || CASE WHEN length(t) <= 256 THEN 'lte_256' WHEN length(t) <= 1024 THEN 'lte_1024' WHEN length(t) <= 4096 THEN 'lte_4096' ELSE 'gt_4096' END AS stratum,
    CASE WHEN line_item_count <= 1 THEN 'lte_1' WHEN line_item_count <= 2 THEN 'lte_2' WHEN line_item_count <= 4 THEN 'lte_4' ELSE 'gt_4' END AS cart_size FROM (SELECT *, array_to_string(descriptions, chr(10)) AS t FROM v_examples)"""


@query("c7_row_profile", sql("SELECT stratum, cart_size, count(*) AS n FROM v_profile GROUP BY ALL", v_profile=_PROFILE))
def c7_row_profile(spark, sf_dir):
    p = profiled(spark, sf_dir)
    return p.groupBy(F.concat_ws("|", *(F.col(f"stratum.{k}") for k in contracts.STRATUM)).alias("stratum"), F.col("dim_cart_size").alias("cart_size")).agg(F.count(F.lit(1)).alias("n"))


@query("c8_audit_histograms", sql("""SELECT dimension, category, count(*) AS n FROM (SELECT unnest(['label_source', 'locale', 'domain', 'attack_family', 'treatment']) AS dimension, unnest([label_source, locale, domain, attack_family, treatment]) AS category FROM v_treated) GROUP BY ALL"""))
def c8_audit_histograms(spark, sf_dir):
    """The five histograms of an audit, its deterministic treatment among them, in one shuffle."""
    e = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False).withColumn("treatment", rules.signal_treatment("signals"))
    flat = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in ("label_source", "locale", "domain", "attack_family", "treatment")))
    return e.select(F.explode(flat).alias("x")).groupBy("x.dimension", "x.category").agg(F.count(F.lit(1)).alias("n"))


@query("c9_split_queue", sql("SELECT (SELECT count(*) FROM v_queue) AS rows, (SELECT count(DISTINCT example_id) FROM v_queue) AS contexts, (SELECT count(*) FROM v_queue WHERE order_key % 3 = 0) AS third", v_queue="SELECT * FROM v_headers WHERE order_key % 50 <> 9"))
def c9_split_queue(spark, sf_dir):
    queue, _ = audit_queue(spark, sf_dir)
    data, context = contracts.split_queue(queue.withColumn("audit_context", F.to_json(F.struct("order_key"))), ["audit_context", "order_key"])
    both = data.join(context, "example_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("example_id").alias("contexts"), F.count(F.when(F.get_json_object("audit_context", "$.order_key").cast("bigint") % 3 == 0, 1)).alias("third"))


@query("c15_batch_completion", sql("SELECT shard, requests, answers, failures, requests = answers AND failures = 0 AS complete FROM (SELECT order_key % 16 AS shard, count(*) AS requests, count(*) FILTER (order_key % 16 <> 3 OR order_key % 5 <> 0) AS answers, count(*) FILTER (order_key % 16 = 5 AND order_key % 7 = 0) AS failures FROM v_headers GROUP BY 1)"))
def c15_batch_completion(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("order_key", (F.col("order_key") % 16).alias("shard"))
    answers = h.filter("shard <> 3 or order_key % 5 <> 0").withColumn("failed", (F.col("shard") == 5) & (F.col("order_key") % 7 == 0))
    return contracts.batch_completion(h, answers)


def fold_rows(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    c = F.lit("semantic_attribute")
    return f.select("example_id", c.alias("constraint_id"), (F.crc32(F.col("example_id").cast("binary")) % 5).cast("int").alias("fold"), F.array("semantic_contradiction", "semantic_neutral", "semantic_entailment").alias("logits"), "split")


@query("c23_fold_problems", sql("""SELECT fold, count(*) FILTER (NOT lost) + count(*) FILTER (twice AND NOT lost) AS rows, CAST(coalesce(sum(CASE WHEN bad AND NOT lost THEN CASE WHEN twice THEN 2 ELSE 1 END END), 0) AS BIGINT) AS wrong_logits, count(*) FILTER (twice AND NOT lost) AS repeated, count(*) FILTER (lost) AS missing, 0::BIGINT AS unexpected,
    count(DISTINCT top) FILTER (NOT lost) AS classes FROM (SELECT *, CASE WHEN semantic_contradiction >= semantic_neutral AND semantic_contradiction >= semantic_entailment THEN 1 WHEN semantic_neutral >= semantic_entailment THEN 2 ELSE 3 END AS top, k % 20 = 1 AS bad, k % 30 = 2 AS twice, k % 25 = 3 AS lost, fold FROM (SELECT *, CAST(substr(example_id, 4) AS BIGINT) AS k, CAST(substr(example_id, 4) AS BIGINT) % 5 AS fold FROM v_features)) GROUP BY fold"""))
def c23_fold_problems(spark, sf_dir):
    k = F.substring("example_id", 4, 18).cast("bigint")
    f = fold_rows(spark, sf_dir).withColumns({"k": k, "fold": k % 5})
    got = f.filter("k % 25 <> 3").withColumn("logits", F.when(F.col("k") % 20 == 1, F.concat(F.col("logits"), F.array(F.lit(-1.0)))).otherwise(F.col("logits")))
    got = got.unionByName(got.filter("k % 30 = 2"))
    return contracts.fold_problems(got, f)


@query("c24_c25_c26_predictions", sql("SELECT prediction_origin, count(*) AS n, round(avg(e1 / s), 9) AS contradiction, round(avg(e2 / s), 9) AS neutral FROM (SELECT CASE WHEN split = 'train' THEN 'cross_fit' ELSE 'held_out' END AS prediction_origin, exp(semantic_contradiction / 0.7::DOUBLE) AS e1, exp(semantic_neutral / 0.7::DOUBLE) AS e2, e1 + e2 + exp(semantic_entailment / 0.7::DOUBLE) AS s FROM v_features) GROUP BY 1"))
def c24_c25_c26_predictions(spark, sf_dir):
    """Folds put together, their logits brought from a model's label order to the classes', and tagged by origin."""
    f = fold_rows(spark, sf_dir)
    f = f.withColumn("logits", contracts.canonical_order(F.array(F.col("logits")[2], F.col("logits")[1], F.col("logits")[0]), ["ENTAILMENT", "neutral", "Contradiction"]))
    whole = contracts.out_of_fold_union([f.filter(F.col("fold") == k) for k in range(5)], "example_id")
    t = contracts.tagged_predictions(whole, "logits", 0.7)
    return rounded(t.groupBy("prediction_origin").agg(F.count(F.lit(1)).alias("n"), F.avg("contradiction").alias("contradiction"), F.avg("neutral").alias("neutral")), "contradiction", "neutral")


@query("c27_weight_table", sql("SELECT count(*) AS n, count(DISTINCT pair_key) AS pairs, round(avg(weight), 9) AS mean FROM (SELECT example_id || chr(31) || 'semantic_attribute' AS pair_key, (CAST(substr(example_id, 4) AS BIGINT) % 3 + 1) / avg(CAST(substr(example_id, 4) AS BIGINT) % 3 + 1) OVER () AS weight FROM v_features)"))
def c27_weight_table(spark, sf_dir):
    from veritill.operators.ordered import joined_on

    f = fold_rows(spark, sf_dir).withColumn("raw", (F.substring("example_id", 4, 18).cast("bigint") % 3 + 1).cast("double"))
    f = joined_on(f, f.agg(F.avg("raw").alias("mean")), ()).withColumn("weight", F.col("raw") / F.col("mean"))
    return contracts.weight_table(f, "weight").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_key").alias("pairs"), F.round(F.avg("weight"), 9).alias("mean"))


@query("c29_fallback_scores", sql("SELECT example_id, 'semantic_attribute_' || cust_key AS constraint_id, 1.0::DOUBLE AS neutral, 'semantic-unavailable' AS semantic_version, 'STEP_UP' AS treatment FROM v_examples WHERE cust_key % 2 = 1"))
def c29_fallback_scores(spark, sf_dir):
    s = contracts.fallback_scores(views.examples(spark, sf_dir))
    s = s.withColumns({"semantic_contradiction": F.col("contradiction"), "semantic_neutral": F.col("neutral"), "hard_fail_count": F.lit(0), "critical_hold_count": F.lit(0)})
    return s.select("example_id", "constraint_id", "neutral", "semantic_version", rules.offline_policy(F.lit(0.0), 1.0).alias("treatment"))


@query("c33_evaluation_status", "SELECT status, count(*) AS n FROM (SELECT c_custkey, coalesce((SELECT arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey), 'not_run') AS status FROM customer) GROUP BY status")
def c33_evaluation_status(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model"))
    runs = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model"), F.struct("o_orderdate", "o_orderkey").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return contracts.with_summary(c, runs, "model").groupBy(F.col("evaluation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("c34_rejected_requests", "SELECT 'm_' || c_custkey AS mandate_id, 'CONFIRMATION_REQUIRED' AS code, 'Confirmation Required' AS message, 422 AS status FROM customer WHERE c_custkey % 10 = 7")
def c34_rejected_requests(spark, sf_dir):
    c = views.customers(spark, sf_dir)
    c = c.withColumns(views.mandate_columns(F.col("cust_key"), F.col("region"), F.col("domain"))).select(F.concat(F.lit("m_"), F.col("cust_key").cast("string")).alias("mandate_id"), (F.col("cust_key") % 10 != 7).alias("confirmed"), "constraints")
    return contracts.error_rows(stateful.confirmed(c)[1], "mandate_id")


@query("c35_value_lists", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' || c_custkey WHEN 2 THEN 'a;b' || c_custkey ELSE '' END AS items, CASE c_custkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n FROM customer")
def c35_value_lists(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.when(k % 4 == 1, F.concat(F.lit('"x'), k.cast("string"), F.lit('"'))).when(k % 4 == 2, F.concat(F.lit('["a", "b'), k.cast("string"), F.lit('"]'))).when(k % 4 == 3, "null")
    v = contracts.value_list(t)
    return views.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(v, ";").alias("items"), F.size(v).alias("n"))


@query("a12_sorted_digest", sql("SELECT sha256(string_agg(k, chr(10) ORDER BY k)) AS digest FROM (SELECT DISTINCT group_id AS k FROM v_headers)"))
def a12_sorted_digest(spark, sf_dir):
    from veritill.operators.aggregates import small_key_digest

    return small_key_digest(views.headers(spark, sf_dir), "group_id")


@query("j15_alignment", sql("SELECT count(*) FILTER (order_key % 11 = 4) AS missing, 0::BIGINT AS unexpected, 0::BIGINT AS repeated FROM v_headers"))
def j15_alignment(spark, sf_dir):
    """Scores that don't cover their rows."""
    f = views.feature_rows(spark, sf_dir).select("example_id", "probability")
    scored = f.filter(F.substring("example_id", 4, 18).cast("bigint") % 11 != 4)
    return validate.coverage(f, scored, "example_id")



@query("p5_p6_p7_constraints", f"""SELECT kind, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount_minor, CAST(sum(greatest(amount + 1, CAST(round_even(amount * factor::DOUBLE, 0) AS BIGINT))) AS BIGINT) AS budget_minor, count(DISTINCT detail) AS details FROM (
    SELECT *, greatest(1, CAST(round_even(price * 100, 0) AS BIGINT)) AS amount FROM (SELECT DISTINCT 'invoice' AS kind, 1.1 AS factor, p_partkey, (p_size - 10) * p_retailprice::DOUBLE AS price, '' AS detail FROM part WHERE p_size > 10
    UNION ALL SELECT 'itinerary', 1.15, p_partkey, p_retailprice::DOUBLE, 'A' || p_partkey % 3 || '>B' || p_partkey % 5 FROM part UNION ALL SELECT 'award', 1.05, p_partkey, p_retailprice::DOUBLE, 'r' || p_partkey % 7 FROM part)) GROUP BY kind""")
def p5_p6_p7_constraints(spark, sf_dir):
    from veritill.operators import transforms

    k = F.col("p_partkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    part = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 10).alias("quantity"), F.col("p_retailprice").cast("double").alias("price"), text("A", 3).alias("origin"), text("B", 5).alias("destination"), text("r", 7).alias("recipient"))
    names = ["kind", "amount_minor", "budget_minor", "detail"]
    invoices = transforms.invoice_examples(part, ["p_partkey"], "quantity", "price").withColumns({"kind": F.lit("invoice"), "detail": F.lit("")}).select(*names)
    trips = transforms.itinerary_examples(part, ["p_partkey"], F.col("price"), "origin", "destination").withColumns({"kind": F.lit("itinerary"), "detail": F.concat_ws(">", F.col("route")["origin"], F.col("route")["destination"])}).select(*names)
    awards = transforms.award_examples(part, ["p_partkey"], F.col("price"), "recipient").withColumns({"kind": F.lit("award"), "detail": F.col("allowed_merchants")[0]}).select(*names)
    every = invoices.unionByName(trips).unionByName(awards)
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor"), F.sum("budget_minor").alias("budget_minor"), F.count_distinct("detail").alias("details"))


_MONTHS = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"


@query("x13_text_dates", f"""SELECT order_key, make_date(2026, m1, d1) AS outbound, CASE WHEN m2 = 0 OR m1 = 0 THEN NULL WHEN make_date(2026, m2, d2) < make_date(2026, m1, d1) THEN make_date(2027, m2, d2) ELSE make_date(2026, m2, d2) END AS back FROM (
    SELECT o_orderkey AS order_key, o_orderkey % 28 + 1 AS d1, o_orderkey % 12 + 1 AS m1, o_orderkey % 25 + 1 AS d2, o_orderkey % 7 + 4 AS m2 FROM orders WHERE o_orderkey % 10 <> 3) UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 10 = 3""")
def x13_text_dates(spark, sf_dir):
    from veritill.functions import scalars

    k = F.col("o_orderkey")
    month = lambda n: F.element_at(F.array(*map(F.lit, scalars.MONTHS)), n.cast("int"))
    text = F.concat(F.lit("A trip Departing "), (k % 28 + 1).cast("string"), F.lit(" "), F.when(k % 10 == 3, "someday").otherwise(month(k % 12 + 1)), F.lit(" with a stay, returning "), (k % 25 + 1).cast("string"), F.lit(" "), F.initcap(month(k % 7 + 4)), F.lit("."))
    d = scalars.text_dates(text)
    return views.table(spark, sf_dir, "orders").select(k.alias("order_key"), d["outbound"].alias("outbound"), d["back"].alias("back"))


_DECISIONS = "SELECT event_id AS decision_id, CASE event_type WHEN 'view' THEN 'STEP_UP' WHEN 'click' THEN 'APPROVE' END AS outcome FROM events WHERE event_type IN ('view', 'click')"
_RESOLUTIONS = "SELECT CAST(floor(event_id / 4) * 2 AS BIGINT) AS decision_id, ts, event_id, CASE event_id % 3 WHEN 0 THEN 'approve_once' WHEN 1 THEN 'decline' ELSE 'modify' END AS action FROM events WHERE event_type IN ('purchase', 'error')"


@query("z4_resolutions", sql("""SELECT result, count(*) AS n, CAST(sum(CASE WHEN result IN ('fulfilled', 'superseded') THEN 1 ELSE 0 END) AS BIGINT) AS bumps FROM (SELECT CASE WHEN d.outcome IS NULL THEN 'DECISION_NOT_FOUND' WHEN d.outcome <> 'STEP_UP' THEN 'NOT_ESCALATED' WHEN row_number() OVER (PARTITION BY r.decision_id ORDER BY ts, event_id) > 1 THEN 'ALREADY_RESOLVED'
    WHEN action = 'approve_once' THEN 'fulfilled' WHEN action = 'modify' THEN 'superseded' ELSE 'declined' END AS result FROM v_resolutions r LEFT JOIN v_decisions d ON r.decision_id = d.decision_id) GROUP BY result""", v_decisions=_DECISIONS, v_resolutions=_RESOLUTIONS))
def z4_resolutions(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    decisions = e.filter("event_type in ('view', 'click')").select(F.col("event_id").alias("decision_id"), F.when(F.col("event_type") == "view", "STEP_UP").otherwise("APPROVE").alias("outcome"))
    k = F.col("event_id")
    acts = e.filter("event_type in ('purchase', 'error')").select((F.floor(k / 4) * 2).alias("decision_id"), "ts", "event_id", F.when(k % 3 == 0, "approve_once").when(k % 3 == 1, "decline").otherwise("modify").alias("action"))
    return stateful.resolved_once(decisions, acts, ["ts", "event_id"]).groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.sum("version_bump").alias("bumps"))


@query("z2_fulfilled_carts", "SELECT event_id, changed, CAST(sum(CAST(changed AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_version FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 6 ORDER BY ts, event_id) = 1 AS changed FROM events WHERE event_type = 'purchase')")
def z2_fulfilled_carts(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("mandate"), (F.col("event_id") % 6).alias("cart"), "ts", "event_id")
    return stateful.fulfilled_carts(e, ["ts", "event_id"]).select("event_id", "changed", "row_version")


@query("f2_candidate_pool", sql("SELECT example_id FROM v_headers WHERE split <> 'golden' AND label_source <> 'weak_policy' AND example_id NOT IN (SELECT example_id FROM v_used) AND group_id NOT IN (SELECT group_id FROM v_used) AND source_record_id NOT IN (SELECT source_record_id FROM v_used) AND coalesce(parent_example_id, '') NOT IN (SELECT example_id FROM v_used)", v_used="SELECT example_id, group_id, source_record_id FROM v_headers WHERE order_key % 400 = 7"))
def f2_candidate_pool(spark, sf_dir):
    from veritill.operators.joins import unrelated

    h = views.headers(spark, sf_dir).select("order_key", "example_id", "group_id", "source_record_id", "parent_example_id", "split", "label_source")
    pool = h.filter("split <> 'golden' and label_source <> 'weak_policy'")
    return unrelated(pool, h.filter("order_key % 400 = 7")).select("example_id")


@query("p15_role_rows", sql("SELECT 'policy_tuning' AS split, group_id || '+' || source_record_id AS keys, count(*) AS n FROM v_headers GROUP BY ALL"))
def p15_role_rows(spark, sf_dir):
    from veritill.operators.transforms import role_rows

    r = role_rows(views.headers(spark, sf_dir).withColumn("role", F.lit("policy_tuning")), "role")
    return r.groupBy("split", F.array_join("grouping_keys", "+").alias("keys")).agg(F.count(F.lit(1)).alias("n"))
