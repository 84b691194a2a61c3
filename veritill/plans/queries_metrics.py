"""Queries over metrics, thresholds and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritill.functions import scalars
from veritill.functions.hashing import hex_number, sha
from veritill.operators import metrics
from veritill.sources import views

from .oracle import h, sql
from .queries_joins import RATE_COLUMNS, predicted, rounded
from .registry import query


@query("m1_m5_calibration", sql("""SELECT round((SELECT sum(abs(y / n - p / n) * n) / sum(n) FROM (SELECT least(floor(probability * 10 + 1e-12), 9) AS b, count(*) AS n, sum(label) AS y, sum(probability) AS p FROM v_features GROUP BY 1)), 9) AS ece, round(avg((probability - label) * (probability - label)), 9) AS brier FROM v_features"""))
def m1_m5_calibration(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir).select("label", "probability")
    return rounded(metrics.calibration_error(f, "label", "probability").select("ece").crossJoin(metrics.brier(f, "label", "probability")), "ece", "brier")


@query("m3_average_precision", sql("""SELECT round(sum(y / t * tp / seen), 9) AS average_precision FROM (SELECT y, sum(y) OVER (ORDER BY probability DESC) AS tp, sum(n) OVER (ORDER BY probability DESC) AS seen, sum(y) OVER () AS t FROM (SELECT probability, sum(label) AS y, count(*) AS n FROM v_features GROUP BY 1))"""))
def m3_average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(views.feature_rows(spark, sf_dir), "label", "probability"), "average_precision")


@query("m4_roc_auc", sql("""SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) AS roc_auc FROM (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2 AS r FROM v_features)"""))
def m4_roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(views.feature_rows(spark, sf_dir), "label", "probability"), "roc_auc")


# three class scores from the whole vector: every third value, added up
_FOLDED = "SELECT vec_id, label, " + ", ".join(f"list_sum(list_transform(embedding[{k + 1}:64:3], lambda x: x::DOUBLE)) AS z{k}" for k in range(3)) + " FROM embeddings"
_SOFT3 = f"SELECT vec_id, ['contradiction', 'neutral', 'entailment'][label % 3 + 1] AS label, exp(z0) / s AS c, exp(z1) / s AS n, exp(z2) / s AS e FROM (SELECT *, exp(z0) + exp(z1) + exp(z2) AS s FROM ({_FOLDED}))"
_F1 = "coalesce(2.0 * count(*) FILTER (t = '{0}' AND label = '{0}') / nullif(count(*) FILTER (t = '{0}') + count(*) FILTER (label = '{0}'), 0), 0)"


def class_scores(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    p = scalars.softmax(scalars.folded(F.col("embedding"), 3))
    d = e.select("vec_id", views.pick(scalars.CLASSES, F.col("label") % 3).alias("label"), p.alias("p"))
    return d.select("vec_id", "label", *(F.col("p")[k].alias(n) for k, n in enumerate(scalars.CLASSES)))


@query(
    "m6_class_metrics",
    sql(
        f"""SELECT round(avg(CAST(t = label AS INTEGER)), 9) AS accuracy, round(avg(-ln(CASE label WHEN 'contradiction' THEN c WHEN 'neutral' THEN n ELSE e END)), 9) AS log_loss, round(({' + '.join(_F1.format(k) for k in scalars.CLASSES)}) / 3, 9) AS macro_f1
        FROM (SELECT *, CASE WHEN c >= n AND c >= e THEN 'contradiction' WHEN n >= e THEN 'neutral' ELSE 'entailment' END AS t FROM v_soft)""",
        v_soft=_SOFT3,
    ),
)
def m6_class_metrics(spark, sf_dir):
    return rounded(metrics.class_metrics(class_scores(spark, sf_dir), "label").select("accuracy", "log_loss", "macro_f1"), "accuracy", "log_loss", "macro_f1")


@query("m2_m7_policy_metrics", sql("""SELECT count(*) AS rows, count(*) FILTER (expected_treatment = 'APPROVE') AS legitimate_rows, count(*) FILTER (expected_treatment <> 'APPROVE') AS violation_rows, count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'STEP_UP') AS false_step_up_count,
    count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'HOLD') AS false_decline_count, round(count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / count(*) FILTER (predicted_treatment <> 'APPROVE'), 9) AS intervention_precision, round(avg(CAST(predicted_treatment <> 'APPROVE' AS INTEGER)), 9) AS intervention_rate FROM v_predicted"""))
def m2_m7_policy_metrics(spark, sf_dir):
    names = ["rows", "legitimate_rows", "violation_rows", "false_step_up_count", "false_decline_count", "intervention_precision", "intervention_rate"]
    return rounded(metrics.treatment_metrics(predicted(spark, sf_dir), "expected_treatment", "predicted_treatment").select(*names), *names[5:])


_RISK = f"(({h(12, chr(39) + 'fine' + chr(39), 'example_id')}) + label * 70368744177664) / 351843720888320.0::DOUBLE"


def fine_scores(spark, sf_dir):
    """Labels with scores that hardly two rows share, higher for label 1."""
    f = views.feature_rows(spark, sf_dir).select("example_id", "label")
    return f.select("label", ((hex_number(sha("fine", F.col("example_id")), 12) + F.col("label") * 70368744177664) / 351843720888320.0).alias("score"))


@query(
    "m3_m4_m8_continuous",
    sql(
        """SELECT (SELECT round(sum(y / t * tp / seen), 9) FROM v_run) AS average_precision, (SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM v_fine)) AS roc_auc, CAST(tp AS BIGINT) AS tp, CAST(seen - tp AS BIGINT) AS fp
        FROM v_run WHERE (seen - tp) / (a - t) <= 0.1 ORDER BY tp DESC, score DESC LIMIT 1""",
        v_fine=f"SELECT label, {_RISK} AS score FROM v_features",
        v_run="SELECT score, y, sum(y) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(y) OVER () AS t, sum(n) OVER () AS a FROM (SELECT score, sum(label) AS y, count(*) AS n FROM v_fine GROUP BY score)",
    ),
)
def m3_m4_m8_continuous(spark, sf_dir):
    """Ranking metrics on scores of as many values as rows, so that ranges and totals before them are put to use."""
    f = fine_scores(spark, sf_dir)
    point = metrics.operating_point(f, "label", "score", 0.1).select("tp", "fp")
    return rounded(metrics.average_precision(f, "label", "score").crossJoin(metrics.roc_auc(f, "label", "score")).crossJoin(point), "average_precision", "roc_auc")


@query("m8_operating_point", sql("""SELECT s AS threshold, CAST(tp AS BIGINT) AS tp, CAST(seen - tp AS BIGINT) AS fp, round(tp / p, 9) AS recall, round((seen - tp) / (a - p), 9) AS fpr, round(tp / seen, 9) AS precision FROM (SELECT probability AS s, sum(sum(label)) OVER (ORDER BY probability DESC) AS tp, sum(count(*)) OVER (ORDER BY probability DESC) AS seen, sum(sum(label)) OVER () AS p, sum(count(*)) OVER () AS a FROM v_features GROUP BY probability) WHERE (seen - tp) / (a - p) <= 0.1 ORDER BY tp DESC, s DESC LIMIT 1"""))
def m8_operating_point(spark, sf_dir):
    return rounded(metrics.operating_point(views.feature_rows(spark, sf_dir), "label", "probability", 0.1), "recall", "fpr", "precision")


@query("m9_score_deltas", sql("SELECT round(avg(d), 9) AS mean_delta, round(quantile_cont(d, 0.95), 9) AS p95_delta, round(max(d), 9) AS max_delta, round(avg(CAST((probability >= 0.6) <> (semantic_neutral >= 0.6) AS INTEGER)), 9) AS flip_rate FROM (SELECT *, abs(semantic_neutral - probability) AS d FROM v_features)"))
def m9_score_deltas(spark, sf_dir):
    return rounded(metrics.sensitivity(views.feature_rows(spark, sf_dir), "probability", "semantic_neutral", 0.6), "mean_delta", "p95_delta", "max_delta", "flip_rate")


@query("m10_reviewed_recall", sql("SELECT label_source, round(count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / count(*) FILTER (expected_treatment <> 'APPROVE'), 9) AS violation_recall FROM v_predicted WHERE label_source = 'llm_assisted' GROUP BY 1"))
def m10_reviewed_recall(spark, sf_dir):
    return rounded(metrics.treatment_metrics(predicted(spark, sf_dir).filter("label_source = 'llm_assisted'"), "expected_treatment", "predicted_treatment", ("label_source",)).select("label_source", "violation_recall"), "violation_recall")


def curve_sql(c: str, n: str) -> str:
    """Every candidate threshold of the policy counted anew, the brute-force way."""
    fixed = f"(critical_hold_count > 0 OR hard_fail_count > 0 OR semantic_contradiction >= {c} OR semantic_neutral >= {n})"
    return f"""SELECT t.threshold, count(*) FILTER (f.legit AND f.stepped OR f.legit AND NOT f.fixed AND f.probability >= t.threshold) AS fsu, count(*) FILTER (NOT f.legit AND (f.fixed OR f.probability >= t.threshold)) AS hit, count(*) FILTER (f.legit) AS legit, count(*) FILTER (NOT f.legit) AS bad
      FROM (SELECT probability, expected_treatment = 'APPROVE' AS legit, {fixed} AS fixed, critical_hold_count = 0 AND {fixed} AS stepped FROM v_features) f, (SELECT DISTINCT probability AS threshold FROM v_features UNION ALL SELECT 1.0000000000000002::DOUBLE) t GROUP BY t.threshold"""


@query("t1_threshold", sql("SELECT round(threshold, 9) AS threshold, round(hit / bad, 9) AS violation_recall, fsu AS false_step_up_count, CAST(floor(legit * 0.1) AS BIGINT) AS budget FROM v_curve WHERE fsu <= floor(legit * 0.1) ORDER BY hit DESC, fsu, threshold DESC LIMIT 1", v_curve=curve_sql("0.8", "0.95")))
def t1_threshold(spark, sf_dir):
    f = views.feature_rows(spark, sf_dir)
    best = metrics.select_threshold(metrics.threshold_curve(f, "expected_treatment", "probability", F.lit(0.8), F.lit(0.95)))
    return best.select(F.round("threshold", 9).alias("threshold"), F.round("violation_recall", 9).alias("violation_recall"), "false_step_up_count", F.col("budget").cast("bigint").alias("budget"))


_GRID = "\nUNION ALL ".join(f"SELECT {c} AS c, {n} AS n, * FROM ({curve_sql('1e9' if c == 'NULL::DOUBLE' else c, '1e9' if n == 'NULL::DOUBLE' else n)})" for c in ("NULL::DOUBLE", "0.95::DOUBLE", "0.9::DOUBLE", "0.85::DOUBLE", "0.8::DOUBLE") for n in ("NULL::DOUBLE", "0.9::DOUBLE", "0.8::DOUBLE", "0.7::DOUBLE", "0.6::DOUBLE"))


@query(
    "t2_configuration",
    sql(
        """SELECT c AS contradiction_at, n AS neutral_at, round(threshold, 9) AS threshold, round(hit / bad, 9) AS violation_recall, fsu AS false_step_up_count FROM v_grid WHERE fsu <= floor(legit * 0.1) ORDER BY hit DESC, fsu, threshold DESC, c IS NULL DESC, n IS NULL DESC, c DESC, n DESC LIMIT 1""",
        v_grid=_GRID,
    ),
)
def t2_configuration(spark, sf_dir):
    best = metrics.select_configuration(views.feature_rows(spark, sf_dir), "expected_treatment", "probability")
    return best.select("contradiction_at", "neutral_at", F.round("threshold", 9).alias("threshold"), F.round("violation_recall", 9).alias("violation_recall"), "false_step_up_count")


_LIMITS = ", ".join(f"({k}, {'NULL::DOUBLE' if v is None else f'{v}::DOUBLE'})" for k, v in enumerate(metrics.ORACLE_LIMITS))


@query(
    "t3_policy_oracle",
    sql(
        """SELECT score_threshold, c AS contradiction_at, n AS neutral_at, round(seen / t_seen, 9) AS semantic_recall, round(bad / t_bad, 9) AS operational_recall, round(legit / t_legit, 9) AS false_step_up_rate, count(*) OVER () AS feasible FROM v_points
        WHERE legit / t_legit <= 0.25 AND bad / t_bad >= 0.2 ORDER BY seen DESC, bad DESC, legit, score_threshold DESC, ci, ni LIMIT 1""",
        v_pairs=f"SELECT x.k AS ci, x.v AS c, y.k AS ni, y.v AS n FROM (VALUES {_LIMITS}) x(k, v), (VALUES {_LIMITS}) y(k, v)",
        v_cells="""SELECT ci, c, ni, n, CASE WHEN critical_hold_count > 0 OR hard_fail_count > 0 OR coalesce(semantic_contradiction >= c, false) OR coalesce(semantic_neutral >= n, false) THEN 9.0 ELSE probability END AS p,
          count(*) FILTER (expected_treatment = 'APPROVE') AS legit, count(*) FILTER (expected_treatment <> 'APPROVE') AS bad, count(*) FILTER (expected_treatment <> 'APPROVE' AND label_source = 'llm_assisted') AS seen FROM v_features, v_pairs GROUP BY ALL""",
        v_points="""SELECT ci, c, ni, n, k / 200 AS score_threshold, sum(legit) FILTER (p >= k / 200) AS legit, sum(bad) FILTER (p >= k / 200) AS bad, sum(seen) FILTER (p >= k / 200) AS seen, sum(legit) AS t_legit, sum(bad) AS t_bad, sum(seen) AS t_seen FROM v_cells, (SELECT k::DOUBLE AS k FROM range(201) t(k)) GROUP BY ci, c, ni, n, k""",
    ),
)
def t3_policy_oracle(spark, sf_dir):
    """The published grid; the bounds are wider than the published ones, which no policy on generated scores meets."""
    best = metrics.policy_oracle(views.feature_rows(spark, sf_dir), "expected_treatment", "probability", F.col("label_source") == "llm_assisted", 0.25, 0.2)
    return rounded(best, "semantic_recall", "operational_recall", "false_step_up_rate")


@query("t4_temperature", """SELECT temperature, round(loss, 9) AS loss FROM (SELECT round(0.5 + 0.05 * k, 10) AS temperature, avg(ln(exp(z0 / (0.5 + 0.05 * k)) + exp(z1 / (0.5 + 0.05 * k)) + exp(z2 / (0.5 + 0.05 * k))) - [z0, z1, z2][CAST(label % 3 + 1 AS INTEGER)] / (0.5 + 0.05 * k)) AS loss
    FROM (FOLDED), (SELECT k::DOUBLE AS k FROM range(51) t(k)) GROUP BY k) ORDER BY loss, temperature LIMIT 1""".replace("FOLDED", _FOLDED).replace("0.5 + 0.05 * k", "0.5::DOUBLE + 0.05::DOUBLE * k"))
def t4_temperature(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select(scalars.folded(F.col("embedding"), 3).alias("logits"), (F.col("label") % 3).cast("int").alias("label"))
    return rounded(metrics.best_temperature(e, "logits", "label"), "temperature", "loss")


@query("k1_k4_gates", sql("""SELECT gate, round(value, 9) AS value, "limit"::DOUBLE AS "limit", CASE WHEN gate = 'violation_recall' THEN value >= "limit" ELSE value <= "limit" END AS passed FROM (SELECT unnest(['violation_recall', 'false_step_up_rate', 'false_decline_rate']) AS gate, unnest([count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / count(*) FILTER (expected_treatment <> 'APPROVE'),
    count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'STEP_UP') / count(*) FILTER (expected_treatment = 'APPROVE'), count(*) FILTER (expected_treatment = 'APPROVE' AND predicted_treatment = 'HOLD') / count(*) FILTER (expected_treatment = 'APPROVE')]) AS value, unnest([0.9, 0.1, 0.02]) AS "limit" FROM v_predicted)"""))
def k1_k4_gates(spark, sf_dir):
    m = metrics.treatment_metrics(predicted(spark, sf_dir), "expected_treatment", "predicted_treatment").select(*RATE_COLUMNS)
    return rounded(metrics.gates(m, {"violation_recall": ("min", 0.9), "false_step_up_rate": ("max", 0.1), "false_decline_rate": ("max", 0.02)}), "value")


@query("k1_family_gate", sql("""SELECT count(*) FILTER (v >= 50) AS supported, round(coalesce(min(r) FILTER (v >= 50), 0), 9) AS worst_recall, coalesce(min(r) FILTER (v >= 50), 0) >= 0.2 AND count(*) FILTER (v >= 50) > 0 AS passed FROM (SELECT attack_family, count(*) FILTER (expected_treatment <> 'APPROVE') AS v, count(*) FILTER (expected_treatment <> 'APPROVE' AND predicted_treatment <> 'APPROVE') / nullif(count(*) FILTER (expected_treatment <> 'APPROVE'), 0) AS r FROM v_predicted GROUP BY 1)"""))
def k1_family_gate(spark, sf_dir):
    families = metrics.treatment_metrics(predicted(spark, sf_dir), "expected_treatment", "predicted_treatment", ("attack_family",))
    return rounded(metrics.family_gate(families, "attack_family", 50, 0.2), "worst_recall")


@query("k5_challenger", "SELECT label, c - a >= 0.005 AS lifted, e <= 0.05 AS calibrated, l <= 400 AS fast, c - a >= 0.005 AND e <= 0.05 AND l <= 400 AS include FROM (SELECT label, avg(embedding[1]) AS c, avg(embedding[2]) AS a, abs(avg(embedding[3])) AS e, count(*)::DOUBLE * 8 AS l FROM embeddings GROUP BY label)")
def k5_challenger(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0]).alias("challenger_pr_auc"), F.avg(F.col("embedding")[1]).alias("champion_pr_auc"), F.abs(F.avg(F.col("embedding")[2])).alias("challenger_ece"), (F.count(F.lit(1)) * 8.0).alias("latency_p95_ms"))
    return metrics.include_challenger(e.withColumn("champion_ece", F.lit(0.05)), 0.005, 400.0).select("label", "lifted", "calibrated", "fast", "include")


@query("c20_policy_report", sql("""SELECT f.attack_family, count(*) AS rows, round(coalesce(count(*) FILTER (f.expected_treatment <> 'APPROVE' AND f.p <> 'APPROVE') / nullif(count(*) FILTER (f.expected_treatment <> 'APPROVE'), 0), 0), 9) AS violation_recall FROM (SELECT v.*, CASE WHEN critical_hold_count > 0 THEN 'HOLD' WHEN hard_fail_count > 0 OR semantic_contradiction >= 0.8 OR semantic_neutral >= 0.95 OR probability >= t.threshold THEN 'STEP_UP' ELSE 'APPROVE' END AS p FROM v_features v, v_best t WHERE v.split = 'test') f GROUP BY 1""",
    v_curve=curve_sql("0.8", "0.95").replace("FROM v_features", "FROM (SELECT * FROM v_features WHERE split = 'validation')"), v_best="SELECT threshold FROM v_curve WHERE fsu <= floor(legit * 0.1) ORDER BY hit DESC, fsu, threshold DESC LIMIT 1"))
def c20_policy_report(spark, sf_dir):
    from veritill.operators.rules import offline_policy

    f = views.feature_rows(spark, sf_dir)
    best = metrics.select_threshold(metrics.threshold_curve(f.filter("split = 'validation'"), "expected_treatment", "probability", F.lit(0.8), F.lit(0.95)))
    rows = f.filter("split = 'test'").crossJoin(F.broadcast(best.select(F.col("threshold").alias("at"))))  # one row
    rows = rows.withColumn("p", offline_policy(F.col("probability"), F.col("at"), 0.8, 0.95))
    return rounded(metrics.treatment_metrics(rows, "expected_treatment", "p", ("attack_family",)).select("attack_family", "rows", "violation_recall"), "violation_recall")
