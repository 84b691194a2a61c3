"""Queries over two-reviewer audits: prepared requests, reports, labels written back, bindings and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritill.operators import audits, contracts, features, ordered, reviews, rules, windows
from veritill.sources import views

from .oracle import sql
from .queries_joins import rounded
from .registry import query

_SEMANTIC = "CASE deviation WHEN 'MATCH' THEN 'ENTAILMENT' WHEN 'AMBIGUOUS' THEN 'NEUTRAL' ELSE 'CONTRADICTION' END"
_LABELS = {"MATCH": "ENTAILMENT", "AMBIGUOUS": "NEUTRAL", "VIOLATION": "CONTRADICTION"}


def _with_semantic(df):
    return df.withColumn("semantic_label", views.pick(_LABELS, F.col("deviation")))


@query(
    "a26_audit_report",
    sql(
        """SELECT CASE grouping_id(family, role) WHEN 3 THEN 'all' WHEN 1 THEN 'family' ELSE 'role' END AS scope, CASE grouping_id(family, role) WHEN 3 THEN 'all' WHEN 1 THEN family ELSE role END AS name, count(*) AS rows, count(*) FILTER (agreed) AS agreements, round(count(*) FILTER (agreed) / count(*), 9) AS agreement_rate,
        count(*) FILTER (NOT agreed AND t IS NOT NULL) AS adjudicated, count(*) FILTER (t IS NULL) AS unresolved, count(*) FILTER (t = asked) AS policy_matches, round(count(*) FILTER (t = asked) / count(*), 9) AS policy_rate, count(*) FILTER (t = 'APPROVE') AS approve, count(*) FILTER (t = 'STEP_UP') AS step_up, count(*) FILTER (t = 'HOLD') AS hold
        FROM (SELECT *, CASE WHEN deterministic <> 'APPROVE' THEN deterministic WHEN d = 'MATCH' THEN 'APPROVE' ELSE 'STEP_UP' END AS asked FROM v_ledger LEFT JOIN v_settled USING (example_id)) GROUP BY GROUPING SETS ((), (family), (role))""",
        v_ledger="SELECT example_id, attack_family AS family, split AS role, CASE WHEN order_key % 10 = 0 THEN 'HOLD' WHEN order_key % 10 = 1 THEN 'STEP_UP' ELSE 'APPROVE' END AS deterministic FROM v_headers",
        v_settled="SELECT r.example_id, verdicts = 1 AS agreed, CASE WHEN verdicts = 1 THEN r.d ELSE a.deviation END AS d, CASE WHEN verdicts = 1 THEN r.t ELSE a.expected_treatment END AS t FROM (SELECT example_id, count(DISTINCT deviation) AS verdicts, min(deviation) AS d, min(expected_treatment) AS t FROM v_latest GROUP BY 1 HAVING count(DISTINCT reviewer_id) >= 2) r LEFT JOIN v_adjudications a USING (example_id)",
    ),
)
def a26_audit_report(spark, sf_dir):
    """Agreement, adjudication and policy contract of the whole audit, per family and per role, by grouping sets."""
    h = views.headers(spark, sf_dir)
    rules = F.when(F.col("order_key") % 10 == 0, "HOLD").when(F.col("order_key") % 10 == 1, "STEP_UP").otherwise("APPROVE")
    ledger = h.select("example_id", F.col("attack_family").alias("family"), F.col("split").alias("role"), rules.alias("deterministic"))
    report = audits.audit_report(ledger, _with_semantic(reviews.accepted(views.reviews(spark, sf_dir))), _with_semantic(views.adjudications(spark, sf_dir)))
    return rounded(report, "agreement_rate", "policy_rate")


@query(
    "c8_audit_preparation",
    sql(
        """SELECT 'queue' AS part, example_id AS key, '{"domain":"' || domain || '","locale":"' || locale || '","rules":{"treatment":"' || treatment || '"}}' AS value FROM v_sample UNION ALL SELECT 'ledger', example_id, treatment || ':' || attack_family || ':' || label_source FROM v_sample
        UNION ALL SELECT 'attack_family', attack_family, CAST(count(*) AS VARCHAR) FROM v_sample GROUP BY attack_family UNION ALL SELECT 'treatment', treatment, CAST(count(*) AS VARCHAR) FROM v_sample GROUP BY treatment UNION ALL SELECT 'gaps', 'all', '0'""",
        v_sample="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attack_family ORDER BY sha256('2026:audit:' || example_id), example_id) AS r FROM v_treated) WHERE r <= 40",
    ),
)
def c8_audit_preparation(spark, sf_dir):
    """Queue, ledger and histograms of one stratified sample with its rules' treatment, and what leaks from one to the other."""
    e = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False)
    sample = windows.sample_per_stratum(e, ["attack_family"], "example_id", 40, "audit").withColumn("treatment", rules.signal_treatment("signals"))
    hidden = ["attack_family", "label_source"]
    queue, ledger, counts = audits.prepared_audit(sample, F.col("treatment"), ["domain", "locale"], hidden, ["attack_family", "treatment"])
    part = lambda df, name, key, value: df.select(name.alias("part"), key.alias("key"), value.cast("string").alias("value"))
    gaps = audits.blinding_gaps(queue, ledger, hidden).agg(F.count(F.lit(1)).alias("n"))
    out = part(queue, F.lit("queue"), F.col("example_id"), F.col("payload")).unionByName(part(ledger, F.lit("ledger"), F.col("example_id"), F.concat_ws(":", "deterministic", *hidden)))
    return out.unionByName(part(counts, F.col("dimension"), F.col("category"), F.col("n"))).unionByName(part(gaps, F.lit("gaps"), F.lit("all"), F.col("n")))


SHARD = 64


@query(
    "c12_prepared_requests",
    sql(
        f"""SELECT role, shard, problem, count(*) AS n, min(line) AS first_line FROM (SELECT role, CAST((place - 1) // {SHARD} AS INTEGER) AS shard, (place - 1) % {SHARD} + 1 AS line,
          CASE WHEN role = 'b' AND place % 101 = 0 THEN 'reviewer' WHEN role = 'b' AND (place % 97 = 0 AND place < total OR place % 97 = 1 AND place > 1) THEN 'order' WHEN role = 'a' AND place % 89 = 0 THEN 'payload' END AS problem FROM v_asked, (SELECT unnest(['a', 'b']) AS role)) WHERE problem IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'a', CAST(max((place - 1) // {SHARD}) AS INTEGER), 'shard_count', CAST((max(place) - 1) % {SHARD} + 1 AS BIGINT), 0 FROM v_asked""",
        v_asked="SELECT *, row_number() OVER (ORDER BY order_key) AS place, count(*) OVER () AS total FROM v_headers",
    ),
)
def c12_prepared_requests(spark, sf_dir):
    """Two reviewers' requests in shards against the queue: swapped places, changed bodies, foreign ids and a wrong count, each by shard."""
    h = views.headers(spark, sf_dir).select("order_key", "example_id", "domain", "locale", F.lit(1).alias("one"))
    queue = ordered.running_totals(h, "order_key", {"place": "one"}).withColumn("total", F.lit(h.count())).drop("one")
    body = F.to_json(F.struct("domain", "example_id", "locale"))
    roles = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(f"judge-{r}").alias("reviewer_id")) for r in "ab")))
    asked = queue.select("*", roles.alias("r")).select("r.*", "place", "total", "example_id", body.alias("body"))
    place, other = F.col("place"), F.col("role") == "b"
    # the places after every 97th swap their requests with it, but for the last one
    moved = F.when(other & (place % 97 == 0) & (place < F.col("total")), place + 1).when(other & (place % 97 == 1) & (place > 1), place - 1).otherwise(place)
    name = F.when(other & (F.col("at") % 101 == 0), "judge-x").otherwise(F.col("reviewer_id"))
    sent = asked.withColumn("at", moved).select(
        "role", F.floor((F.col("at") - 1) / SHARD).cast("int").alias("shard"), ((F.col("at") - 1) % SHARD + 1).alias("line"), F.concat_ws(":", name, "example_id").alias("custom_id"), F.when(~other & (place % 89 == 0), F.upper("body")).otherwise(F.col("body")).alias("body")
    )
    sizes = sent.groupBy("role", "shard").agg(F.count(F.lit(1)).alias("requests"))
    last = F.col("shard") == F.lit((h.count() - 1) // SHARD)
    recorded = sizes.withColumn("requests", F.when((F.col("role") == "a") & last, F.col("requests") + 1).otherwise(F.col("requests")))
    return audits.prepared_problems(sent, asked, recorded)


@query("p13_blinded_inputs", sql("""SELECT example_id, '{"domain":"' || domain || '","locale":"' || locale || '","provenance":{' || CASE WHEN order_key % 2 = 0 THEN '"attack_family":"' || attack_family || '","label_source":"' || label_source || '",' ELSE '' END || '"split":"' || split || '"}}' AS input FROM v_headers"""))
def p13_blinded_inputs(spark, sf_dir):
    """Review inputs, of even orders with their whole provenance, of odd ones without what would tell the answer."""
    h = views.headers(spark, sf_dir)
    make = lambda df, blind: audits.review_inputs(df, ["domain", "locale"], ["split"], ["attack_family", "label_source"], blind)
    return make(h.filter("order_key % 2 = 0"), False).unionByName(make(h.filter("order_key % 2 <> 0"), True))


@query(
    "p14_rebuilt_annotations",
    sql("""SELECT example_id, array_to_string(list_transform(range(3), lambda k: 's' || k || CASE WHEN relevance = 'S' AND k = order_key % 3 THEN '=ENTAILMENT:1.0' ELSE '=NEUTRAL:0.5' END), ';') AS semantic FROM v_headers"""),
)
def p14_rebuilt_annotations(spark, sf_dir):
    """Three annotations of each example, one of which a review changes in some; order and the others stay."""
    h = views.headers(spark, sf_dir)
    own = F.array(*(F.struct(F.lit(f"s{k}").alias("constraint_id"), F.lit("NEUTRAL").alias("label"), F.lit(0.5).alias("confidence")) for k in range(3)))
    updates = h.filter("relevance = 'S'").select("example_id", F.concat(F.lit("s"), (F.col("order_key") % 3).cast("string")).alias("constraint_id"), F.lit("ENTAILMENT").alias("label"), F.lit(1.0).alias("confidence"))
    d = audits.updated_annotations(h.select("example_id", own.alias("semantic")), updates)
    return d.select("example_id", F.array_join(F.transform("semantic", lambda x: F.concat(x["constraint_id"], F.lit("="), x["label"], F.lit(":"), x["confidence"].cast("string"))), ";").alias("semantic"))


@query(
    "p14_exported_annotations",
    sql(
        f"""SELECT example_id, CASE WHEN use THEN d ELSE 'none' END AS deviation, CASE WHEN use THEN t ELSE 'none' END AS expected_treatment, CASE WHEN use THEN 'review' ELSE source END AS label_source, CASE WHEN use AND cust_key % 2 = 1 THEN 'semantic_attribute_' || cust_key || '=' || l ELSE '' END AS semantic
        FROM (SELECT h.*, CASE WHEN h.relevance = 'S' THEN 'unreviewed' ELSE 'kept' END AS source, s.d, s.t, s.l, h.relevance = 'S' AND s.d IS NOT NULL AS use FROM v_headers h JOIN (SELECT DISTINCT order_key FROM v_carts) USING (order_key) LEFT JOIN v_resolved s USING (example_id))""",
        v_resolved=f"SELECT example_id, deviation AS d, expected_treatment AS t, {_SEMANTIC} AS l FROM v_adjudications",
    ),
)
def p14_exported_annotations(spark, sf_dir):
    """Unreviewed examples take the adjudicated labels, their semantic annotations being built anew from the mandate's constraints."""
    e = views.examples(spark, sf_dir)
    labels = F.struct(F.lit("none").alias("deviation"), F.array().cast("array<struct<constraint_id:string,label:string,confidence:double>>").alias("semantic"), F.array().cast("array<string>").alias("violation_types"), F.lit("none").alias("expected_treatment"), F.when(F.col("relevance") == "S", "unreviewed").otherwise("kept").alias("label_source"), F.lit(None).cast("double").alias("reviewer_confidence"))
    resolved = _with_semantic(views.adjudications(spark, sf_dir)).select("example_id", "deviation", "semantic_label", F.array().cast("array<string>").alias("violation_types"), "expected_treatment", F.lit("review").alias("label_source"), "confidence")
    d = audits.exported_labels(e.select("example_id", "constraints", labels.alias("labels")), resolved)
    semantic = F.array_join(F.transform("labels.semantic", lambda x: F.concat_ws("=", x["constraint_id"], x["label"])), ",")
    return d.select("example_id", "labels.deviation", "labels.expected_treatment", "labels.label_source", semantic.alias("semantic"))


@query("c28_bindings", sql("SELECT split AS artifact, CASE split WHEN 'golden' THEN 'ids,rows' WHEN 'test' THEN 'version' END AS changed FROM v_headers WHERE split IN ('golden', 'test') GROUP BY split UNION ALL SELECT 'unknown', 'ids,rows,version'"))
def c28_bindings(spark, sf_dir):
    """What the recorded manifests of the splits say against the splits as they are: one lacks a row, one has another version, one is gone."""
    h = views.headers(spark, sf_dir).select("example_id", "split")

    def bound(df):
        by_name = lambda x: F.xxhash64("example_id") % 1_000_003 if x else F.xxhash64("example_id")
        return df.groupBy(F.col("split").alias("artifact")).agg(F.concat_ws("/", F.bit_xor(by_name(0)), F.sum(by_name(1))).alias("ids"), F.count(F.lit(1)).alias("rows"), F.lit("v1").alias("version"))

    gone = h.filter("split = 'golden'").agg(F.min("example_id").alias("example_id"))
    recorded = bound(h.unionByName(spark.createDataFrame([("ex_x", "unknown")], "example_id string, split string"))).withColumn("version", F.when(F.col("artifact") == "test", "v0").otherwise(F.col("version")))
    return audits.binding_problems(recorded, bound(h.join(gone, "example_id", "left_anti"))).select("artifact", F.array_join("changed", ",").alias("changed"))


@query(
    "k6_promotion_records",
    """SELECT s_suppkey AS artifact, 'passed' AS gate, s_suppkey % 5 AS day FROM supplier WHERE s_suppkey % 7 <> 1 AND s_suppkey % 3 <> 2 AND s_suppkey % 11 <> 4""",
)
def k6_promotion_records(spark, sf_dir):
    """Artifacts that may serve, with their promotion records: gates passed and feature names that are a safe profile's."""
    k = F.col("s_suppkey")
    s = views.table(spark, sf_dir, "supplier").select(k.alias("artifact"), "s_suppkey")
    safe, full = (F.array(*map(F.lit, features.PROFILES[p])) for p in ("shortcut-safe-v2", "full-v2"))
    manifests = s.select(
        "artifact", F.lit("m1").alias("model_version"), F.lit("d1").alias("dataset_sha256"), F.sha2(k.cast("string"), 256).alias("manifest_sha256"), F.lit("shortcut-safe-v2").alias("feature_profile"), F.when(k % 3 == 2, full).otherwise(safe).alias("feature_names"), F.lit("policy_intervention").alias("target_mode"),
        F.lit("complete-policy-validation-v1").alias("threshold_method"), F.lit(False).alias("model_hold_enabled"), F.lit("v3").alias("dataset_version"), F.array(F.lit("nli-1")).alias("semantic_versions"),
    )
    reports = s.select(
        "artifact", F.lit("passed").alias("status"), F.when(k % 7 == 1, "failed").otherwise("passed").alias("gate_status"), F.lit("golden-evaluation-v2").alias("schema_version"), F.lit("golden").alias("split"), F.array(F.lit(True), k % 11 != 4).alias("criteria"), F.lit("m1").alias("model_version"),
        F.lit("d1").alias("dataset_sha256"), F.sha2(k.cast("string"), 256).alias("manifest_sha256"), F.lit("shortcut-safe-v2").alias("feature_profile"),
    )
    done = contracts.promoted(manifests, reports, F.timestamp_seconds((F.col("artifact") % 5) * 86_400))
    ok = F.length("promotion.evaluation_report_sha256") == 64
    return done.filter(ok & F.col("serving_approved")).select("artifact", F.lit("passed").alias("gate"), (F.unix_seconds("promotion.promoted_at") / 86_400).cast("bigint").alias("day"))
