"""Queries over decision state, review workflow, counterfactuals, relabelling, fits and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritill.operators import aggregates, ml, models, reviews, rules, stateful, transforms, validate
from veritill.sources import files, storage, views
from veritill.streaming import decisions

from .oracle import CTES, h8, sql
from .registry import query


def purchase_events(spark, sf_dir):
    """Purchases and errors of users as decisions on a mandate each, in order of time."""
    e = views.table(spark, sf_dir, "events").filter("event_type in ('purchase', 'error', 'click')")
    mandate = F.concat(F.lit("m_"), F.col("user_id").cast("string"))
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "revoke").when(F.col("event_type") == "click", "resolve").otherwise("evaluate")
    amount = F.bround(F.col("value") * 100).cast("bigint")
    budget = 20_000 + views.h8("budget", F.col("user_id")) % 30_000
    return e.select(mandate.alias("mandate"), "ts", "event_id", kind.alias("kind"), amount.alias("amount"), budget.alias("budget"), (F.col("user_id") % 4 + 2).cast("int").alias("max_fulfillments"))


_STEPS = f"""SELECT 'm_' || user_id AS mandate, list({{'id': event_id, 'kind': CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'revoke' WHEN event_type = 'click' THEN 'resolve' ELSE 'evaluate' END, 'amount': CAST(round_even(value * 100, 0) AS BIGINT), 'outcome': '', 'spent': 0::BIGINT, 'fulfilled': 0, 'active': true}} ORDER BY ts, event_id) AS steps,
    20000 + ({h8("'budget'", 'user_id')}) % 30000 AS budget, CAST(user_id % 4 + 2 AS INTEGER) AS most FROM events WHERE event_type IN ('purchase', 'error', 'click') GROUP BY user_id"""
# a recursive walk, step by step, unlike the fold it checks
_WALK = """SELECT mandate, 1 AS k, CAST(NULL AS BIGINT) AS event_id, CAST('' AS VARCHAR) AS outcome, 0::BIGINT AS spent, 0 AS fulfilled, true AS active, steps, budget, most FROM v_steps
    UNION ALL SELECT mandate, k + 1, id, o, CASE WHEN o = 'APPROVE' THEN spent + amount ELSE spent END, CASE WHEN o = 'APPROVE' THEN fulfilled + 1 ELSE fulfilled END, active AND o <> 'REVOKED', steps, budget, most FROM (
    SELECT *, CASE WHEN kind = 'revoke' THEN 'REVOKED' WHEN NOT active OR fulfilled >= most OR (spent + amount > budget AND spent > 0) THEN 'HOLD' WHEN kind = 'evaluate' AND spent + amount > budget THEN 'STEP_UP' ELSE 'APPROVE' END AS o
    FROM (SELECT *, steps[k].id AS id, steps[k].kind AS kind, steps[k].amount AS amount FROM v_walk WHERE k <= len(steps)))"""
_Z1 = f"WITH RECURSIVE v_steps AS ({_STEPS}), v_walk AS ({_WALK}) SELECT mandate, event_id, outcome, spent FROM v_walk WHERE event_id IS NOT NULL"


@query("z1_decision_state", _Z1)
def z1_decision_state(spark, sf_dir):
    return stateful.fold_decisions(purchase_events(spark, sf_dir))


@query("z1_decision_stream", _Z1)
def z1_decision_stream(spark, sf_dir):
    """The same through Structured Streaming: the events are written once as a source, read as a stream and folded in its state."""
    top = f"{storage.checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = purchase_events(spark, sf_dir)
    events.write.parquet(f"{top}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{top}/in")
    job = decisions.decisions(stream).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    out = storage.stored(spark.read.schema(decisions.OUTPUT).parquet(f"{top}/out"))
    storage.delete(spark, top)
    return out


@query("z3_idempotency", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN p = first_value(p) OVER w THEN 'replay' ELSE 'conflict' END AS status FROM (SELECT *, event_type || ':' || (event_id % 2) AS p, user_id % 5 AS scope, event_id % 1500 AS k FROM events) WINDOW w AS (PARTITION BY scope, k ORDER BY ts, event_id)) GROUP BY status""")
def z3_idempotency(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("scope"), (F.col("event_id") % 1500).alias("k"), "ts", "event_id", "event_type")
    payload = F.concat_ws(":", "event_type", (F.col("event_id") % 2).cast("string"))
    return stateful.idempotent(e, "scope", "k", payload, ["ts", "event_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("z7_cart_conflicts", "SELECT event_id % 2500 AS cart, count(DISTINCT event_type) AS payloads, count(*) AS requests FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def z7_cart_conflicts(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select((F.col("event_id") % 2500).alias("cart"), "event_type")
    return stateful.conflicting_payloads(e, "cart", F.col("event_type"))


@query("c32_confirmed_mandates", "SELECT type, count(*) AS n FROM (SELECT unnest(list_filter(['total_budget', CASE WHEN c_custkey % 3 = 0 THEN 'prohibited_item' END, CASE WHEN c_custkey % 4 = 0 THEN 'prohibited_category' END, CASE WHEN c_custkey % 5 = 0 THEN 'allowed_merchant' END, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'route' END, CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 2 = 0 THEN 'travel_dates' END, CASE WHEN c_custkey % 2 = 1 THEN 'semantic_attribute' END], lambda x: x IS NOT NULL)) AS type FROM customer WHERE c_custkey % 10 <> 7) GROUP BY type")
def c32_confirmed_mandates(spark, sf_dir):
    c = views.customers(spark, sf_dir)
    c = c.withColumns(views.mandate_columns(F.col("cust_key"), F.col("region"), F.col("domain"))).select(F.concat(F.lit("m_"), F.col("cust_key").cast("string")).alias("mandate_id"), (F.col("cust_key") % 10 != 7).alias("confirmed"), "constraints")
    good, _ = stateful.confirmed(c)
    return good.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_STATE = """SELECT e.example_id, CASE WHEN a.example_id IS NOT NULL THEN 'adjudicated' WHEN r.reviews IS NULL THEN 'unreviewed' WHEN r.reviews = 1 THEN 'single_review' WHEN r.verdicts > 1 THEN 'needs_adjudication' ELSE 'agreed' END AS state
    FROM v_headers e LEFT JOIN (SELECT example_id, count(*) AS reviews, count(DISTINCT deviation) AS verdicts FROM v_latest GROUP BY 1) r USING (example_id) LEFT JOIN v_adjudications a USING (example_id)"""


def queue(spark, sf_dir):
    return reviews.queue_state(views.headers(spark, sf_dir), reviews.accepted(views.reviews(spark, sf_dir)), views.adjudications(spark, sf_dir))


@query("a20_z8_progress", sql("SELECT state, count(*) AS n FROM v_state GROUP BY state", v_state=_STATE))
def a20_z8_progress(spark, sf_dir):
    return reviews.progress(queue(spark, sf_dir))


@query("c10_completion", sql("SELECT count(*) AS total, count(*) FILTER (state IN ('adjudicated', 'agreed')) AS done, CASE WHEN count(*) FILTER (state IN ('adjudicated', 'agreed')) = count(*) THEN 'complete' WHEN count(*) FILTER (state IN ('adjudicated', 'agreed')) > 0 THEN 'in_progress' ELSE 'not_started' END AS status FROM v_state", v_state=_STATE))
def c10_completion(spark, sf_dir):
    return reviews.completion(queue(spark, sf_dir))


@query("c13_adjudication_queue", sql("""SELECT example_id, '[' || array_to_string(list('{"reviewer_id":"' || reviewer_id || '","deviation":"' || deviation || '","expected_treatment":"' || expected_treatment || '"}' ORDER BY reviewer_id), ',') || ']' AS prior_reviews FROM v_latest WHERE example_id NOT IN (SELECT example_id FROM v_adjudications) GROUP BY example_id HAVING count(DISTINCT deviation) > 1"""))
def c13_adjudication_queue(spark, sf_dir):
    return reviews.disagreements(reviews.accepted(views.reviews(spark, sf_dir)), views.adjudications(spark, sf_dir))


@query("c11_c12_requests", sql("""SELECT 'judge:' || example_id AS custom_id, CASE WHEN order_key % 100 = 1 THEN 'missing' ELSE 'changed' END AS problem FROM v_headers WHERE order_key % 100 IN (1, 2)"""))
def c11_c12_requests(spark, sf_dir):
    h = views.headers(spark, sf_dir)
    want = reviews.requests(h, "judge", ["example_id", "domain", "parent_example_id"])
    sent = h.filter("order_key % 100 <> 1").withColumn("domain", F.when(F.col("order_key") % 100 == 2, "other").otherwise(F.col("domain")))
    return reviews.request_problems(reviews.requests(sent, "judge", ["example_id", "domain", "parent_example_id"]), want)


@query("c14_retry_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN CAST(props->>'$.k' AS INTEGER) > 9 THEN ['missing:verdict', 'length:k'] ELSE ['missing:verdict'] END) AS reason FROM events) GROUP BY reason")
def c14_retry_reasons(spark, sf_dir):
    checked = validate.json_fields(views.table(spark, sf_dir, "events").select(F.col("event_id").alias("custom_id"), "props"), "props", ["k", "verdict"], {}, {"k": 1})
    return reviews.retry_set(checked)[1]


@query("c16_import_outcomes", sql("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN order_key % 2 = 0 THEN 'new' WHEN relevance = 'E' THEN 'conflict' ELSE 'same' END AS outcome FROM v_headers) GROUP BY outcome"))
def c16_import_outcomes(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("order_key", "example_id", F.col("relevance").alias("payload"))
    stored = h.filter("order_key % 2 = 1").withColumn("payload", F.when(F.col("payload") == "E", "S").otherwise(F.col("payload")))
    return reviews.import_outcome(h, stored, "example_id", "payload").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("c17_backed_adjudications", sql("SELECT count(*) AS adjudications, count(*) FILTER (v > 1) AS backed FROM v_adjudications LEFT JOIN (SELECT example_id, count(DISTINCT deviation) AS v FROM v_latest GROUP BY 1) USING (example_id)"))
def c17_backed_adjudications(spark, sf_dir):
    return reviews.backed_adjudications(reviews.accepted(views.reviews(spark, sf_dir)), views.adjudications(spark, sf_dir))


@query("c18_lineage", sql("SELECT 'split:' || split AS artifact FROM v_headers GROUP BY split HAVING count(*) % 2 = 1"))
def c18_lineage(spark, sf_dir):
    g = views.headers(spark, sf_dir).groupBy(F.concat(F.lit("split:"), F.col("split")).alias("artifact")).agg(F.count(F.lit(1)).alias("n"))
    made = g.select("artifact", F.sha2(F.col("n").cast("string"), 256).alias("digest"), F.lit("v1").alias("version"))
    used = g.select("artifact", F.sha2((F.col("n") - F.col("n") % 2).cast("string"), 256).alias("digest"), F.lit("v1").alias("version"))
    return validate.lineage_mismatches(used, made).select("artifact")


@query("p14_exported_labels", sql("""SELECT h.example_id, CASE WHEN h.relevance = 'S' AND s.state IS NOT NULL THEN 'reviewed' WHEN h.relevance = 'S' THEN 'unreviewed' ELSE 'kept' END AS label_source FROM v_headers h LEFT JOIN (SELECT example_id, 1 AS state FROM v_adjudications UNION SELECT example_id, 1 FROM v_latest GROUP BY example_id HAVING count(*) >= 2 AND count(DISTINCT deviation) = 1) s USING (example_id)"""))
def p14_exported_labels(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("example_id", F.when(F.col("relevance") == "S", "unreviewed").otherwise("kept").alias("label_source"), F.lit("MATCH").alias("deviation"), F.lit("APPROVE").alias("expected_treatment"))
    r = aggregates.resolve_reviews(reviews.accepted(views.reviews(spark, sf_dir)), views.adjudications(spark, sf_dir))
    return reviews.exported(h, r).select("example_id", "label_source")


@query("s16_review_store", sql("SELECT label_source, count(*) AS n FROM (SELECT CASE WHEN order_key % 3 = 0 THEN 'llm' WHEN order_key % 2 = 0 THEN 'imported' ELSE 'unreviewed' END AS label_source FROM v_headers WHERE order_key % 7 <> 0 OR order_key % 2 = 0 UNION ALL SELECT 'none' WHERE false) GROUP BY label_source"))
def s16_review_store(spark, sf_dir):
    h = views.headers(spark, sf_dir).select("order_key", "example_id")
    store = h.filter("order_key % 7 <> 0 or order_key % 3 = 0 and order_key % 2 = 0").select("example_id", F.when(F.col("order_key") % 3 == 0, "llm").otherwise("unreviewed").alias("label_source"))
    incoming = h.filter("order_key % 2 = 0").select("example_id", F.lit("imported").alias("label_source"), "order_key")
    return reviews.upsert_unreviewed(store, incoming, F.col("order_key")).groupBy("label_source").agg(F.count(F.lit(1)).alias("n"))


@query("r9_counterfactuals", sql("""SELECT attack_family, count(*) AS n, CAST(sum(total) AS BIGINT) AS total_amount_minor, CAST(sum(spent) AS BIGINT) AS fulfilled_amount_minor FROM (
    SELECT 'cumulative_overspend' AS attack_family, total_amount_minor AS total, budget - total_amount_minor + greatest(1, floor(budget / 100)) AS spent FROM v_examples WHERE budget > total_amount_minor
    UNION ALL SELECT 'near_budget_match', budget - 1, 0 FROM v_examples JOIN (SELECT order_key, sum(amount_minor * quantity) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY line_number, part_key, merchant_key, quantity, amount_minor) AS r FROM v_lines) WHERE r > 1 GROUP BY 1 UNION ALL SELECT order_key, 0 FROM v_carts WHERE line_item_count = 1) USING (order_key) WHERE rest < budget - 1
    UNION ALL SELECT 'missing_required_evidence', total_amount_minor, fulfilled_amount_minor FROM v_examples UNION ALL SELECT 'unrelated_add_on', total_amount_minor + 1500, fulfilled_amount_minor FROM v_examples) GROUP BY 1"""))
def r9_counterfactuals(spark, sf_dir):
    return transforms.counterfactuals(views.examples(spark, sf_dir, for_rules=True), changes=("total_amount_minor", "fulfilled_amount_minor")).groupBy("attack_family").agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount_minor").alias("total_amount_minor"), F.sum("fulfilled_amount_minor").alias("fulfilled_amount_minor"))


def _contract_sql() -> str:
    """The children of each family once more, with the rules of v_signals on each, and what they fail for."""
    keep = {"total_amount_minor": "total_amount_minor", "fulfilled_amount_minor": "fulfilled_amount_minor", "max_fulfillments": "max_fulfillments", "fulfillment_count": "fulfillment_count"}
    rest = "(SELECT order_key, sum(amount_minor * quantity) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY line_number, part_key, merchant_key, quantity, amount_minor) AS r FROM v_lines) WHERE r > 1 GROUP BY 1 UNION ALL SELECT order_key, 0 FROM v_carts WHERE line_item_count = 1)"
    families = {
        "cumulative_overspend": ({"fulfilled_amount_minor": "budget - total_amount_minor + greatest(1, floor(budget / 100))::BIGINT", "max_fulfillments": "greatest(max_fulfillments, greatest(fulfillment_count, 1) + 1)", "fulfillment_count": "greatest(fulfillment_count, 1)"}, "v_examples WHERE budget > total_amount_minor", "['CUMULATIVE_BUDGET_EXCEEDED']"),
        "near_budget_match": ({"total_amount_minor": "budget - 1", "fulfilled_amount_minor": "0"}, f"v_examples JOIN {rest} USING (order_key) WHERE rest < budget - 1", "[]"),
        "missing_required_evidence": ({}, "v_examples", "[]"),
        "unrelated_add_on": ({"total_amount_minor": "total_amount_minor + 1500"}, "v_examples", "[]"),
    }
    extra, parts = {}, []
    for k, (name, (changes, source, expected)) in enumerate(families.items()):
        columns = ", ".join(f"{v} AS {c}" for c, v in (keep | changes).items())
        extra[f"v_child{k}"] = f"SELECT * REPLACE ({columns}, budget_currency AS currency) FROM {source}"
        signals = CTES["v_signals"].replace("v_examples", f"v_child{k}")
        if name == "missing_required_evidence":  # no item has attributes left
            signals = signals.replace("order_key % 7 = 0", "true").replace("order_key % 11 = 0", "true")
        extra[f"v_signals{k}"] = signals
        parts.append(
            f"""SELECT '{name}' AS attack_family, CASE WHEN codes <> {expected}::VARCHAR[] THEN 'unexpected_failures' WHEN unexplained THEN 'unattributed_failures' ELSE 'none' END AS problem FROM (
            SELECT order_key, coalesce(list_sort(list(DISTINCT reason) FILTER (status = 'FAIL' AND reason IS NOT NULL)), []) AS codes, coalesce(bool_or(status = 'FAIL' AND reason IS NULL), false) AS unexplained FROM v_child{k} LEFT JOIN v_signals{k} USING (order_key) GROUP BY order_key)"""
        )
    return sql("SELECT attack_family, problem, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL", **extra)


@query("v6_counterfactual_contract", _contract_sql())
def v6_counterfactual_contract(spark, sf_dir):
    children = transforms.counterfactuals(views.examples(spark, sf_dir, for_rules=True).withColumn("currency", F.filter("constraints", lambda c: c["type"] == "total_budget")[0]["currency"]))
    return transforms.counterfactual_problems(children).groupBy("attack_family", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("r10_relabelled", sql("""SELECT label_source, expected_treatment, count(*) AS n FROM (SELECT CASE WHEN audited THEN 'llm_assisted_v3' WHEN treatment <> 'APPROVE' OR attack_family <> 'none' THEN 'deterministic_policy_v3' ELSE 'weak_policy_v3' END AS label_source,
    CASE WHEN treatment = 'APPROVE' AND (relevance IN ('C', 'I', 'S') OR attack_family IN ('missing_required_evidence', 'unrelated_add_on')) THEN 'STEP_UP' ELSE treatment END AS expected_treatment FROM (SELECT *, order_key % 10 = 0 AS audited FROM v_treated)) GROUP BY ALL"""))
def r10_relabelled(spark, sf_dir):
    e = rules.with_signals(views.examples(spark, sf_dir, for_rules=True), shown=False)
    e = e.withColumns(
        {
            "semantic_labels": F.array(views.pick({"E": "ENTAILMENT", "S": "NEUTRAL", "C": "CONTRADICTION", "I": "CONTRADICTION"}, F.col("relevance"))), "deviation": F.lit(None).cast("string"), "confidence": F.lit(0.7),
            "audited_confidence": F.when(F.col("order_key") % 10 == 0, 0.9),
        }
    )
    return transforms.relabel(e).groupBy("label_source", "expected_treatment").agg(F.count(F.lit(1)).alias("n"))


@query("s11_s14_round_trip", sql("SELECT count(*) AS rows, count(DISTINCT example_id) AS ids, 'written' AS first, 'skipped' AS second FROM v_headers"))
def s11_s14_round_trip(spark, sf_dir):
    """Writes a table once, is told that it is there the second time, writes it as JSON lines and reads those by their schema."""
    top = f"{storage.checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    h = views.headers(spark, sf_dir).select("example_id", "domain", "split")
    first, second = files.write_once(h, f"{top}/table"), files.write_once(h, f"{top}/table")
    files.write_sorted(files.read_parquet(spark, f"{top}/table", ["example_id", "domain"]), f"{top}/lines")
    back = files.read_lines(spark, f"{top}/lines", "example_id string, domain string")
    out = storage.stored(back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("example_id").alias("ids")).withColumns({"first": F.lit(first), "second": F.lit(second)}))
    storage.delete(spark, top)
    return out


_LEAVES = "SELECT sha256(string_agg(d, chr(10) ORDER BY leaf)) AS digest FROM (SELECT substr(sha256(example_id), 1, 3) AS leaf, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS d FROM v_headers GROUP BY 1)"


@query("s12_manifest", sql(f"SELECT 'examples' AS artifact, count(*) AS rows, array_to_string((SELECT list(domain || '=' || n ORDER BY domain) FROM (SELECT domain, count(*) AS n FROM v_headers GROUP BY 1)), ',') AS domains, ({_LEAVES}) AS digest FROM v_headers"))
def s12_manifest(spark, sf_dir):
    m = files.manifest(views.headers(spark, sf_dir).select("example_id", "domain"), "examples", ["domain"])
    return m.select("artifact", "rows", F.array_join(F.transform(F.map_entries("domain"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("domains"), "digest")


@query("ml_stacked_scores")
def ml_stacked_scores(spark, sf_dir):
    """Tree scores across five folds, a stacked logistic fitted on the training split and its calibration on the validation split, by split."""
    numeric = ["semantic_contradiction", "semantic_neutral", "probability", "hard_fail_count"]
    f = views.feature_rows(spark, sf_dir).withColumn("weight", ml.source_weight(F.col("label_source"), F.lit(1.0)))
    # features and scores are read by every fit that follows, so each is computed once
    with storage.scratch():
        f = storage.stored(ml.with_fold(f, "group_id").select(*numeric, "domain", "split", "label", "weight", "fold"))
        scored = storage.stored(ml.out_of_fold(ml.assembled(f, numeric, ["domain"]), lambda train, rows: ml.tree_scores(train, rows, weight="weight")).select("split", "label", "tree_score", "semantic_contradiction"))
        stacked = ml.stacked(scored.filter("split = 'train'"), scored, ["tree_score", "semantic_contradiction"])
        out = ml.calibrated(stacked.filter("split = 'validation'"), stacked)
        return storage.stored(out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("calibrated"), 4).alias("mean_score")), lasting=True)


SCORED = ["semantic_contradiction", "semantic_neutral", "hard_fail_count", "line_item_count"]


def cart_features(spark, sf_dir):
    """Labelled features with the number of lines of each order's cart."""
    lines = views.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("ex_"), F.col("l_orderkey").cast("string")).alias("example_id")).agg(F.count(F.lit(1)).alias("line_item_count"))
    f = views.feature_rows(spark, sf_dir).join(lines, "example_id")
    # carts of many lines are looked at more often, so that a fit has something to find
    seen = (F.col("label") == 1) | (F.col("line_item_count") + F.col("hard_fail_count") * 4 + F.col("semantic_contradiction") * 3 > 7)
    return f.withColumns({"label": seen.cast("int"), "weight": ml.source_weight(F.col("label_source"), F.lit(1.0))})


def scorer_rows(spark, sf_dir):
    """cart_features as far as a scorer reads them, stored, as each of a fit's steps and the scoring read them."""
    return storage.stored(cart_features(spark, sf_dir).select(*SCORED, "domain", "split", "group_id", "label", "weight"))


def stored_scorer(spark, rows, top: str) -> models.Scorer:
    """A scorer fitted on the training split of labelled features, written to a folder and loaded from there."""
    scorer, facts = models.fit(rows.filter("split = 'train'"), SCORED, ["domain"], "group_id", weight="weight", trees=20)
    models.save(spark, scorer, f"{top}/scorer", facts)
    return models.load(spark, f"{top}/scorer", SCORED, ["domain"])


@query("c31_stored_model")
def c31_stored_model(spark, sf_dir):
    """Scores by split of a model that was stored with its manifest and loaded again."""
    top = f"{storage.checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    with storage.scratch():
        rows = scorer_rows(spark, sf_dir)
        scored = stored_scorer(spark, rows, top).score(rows)
        out = storage.stored(scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg("label"), 4).alias("mean_label")), lasting=True)
    storage.delete(spark, top)
    return out


@query("m9_sensitivity")
def m9_sensitivity(spark, sf_dir):
    """What the held-out rows' scores and decisions change by if every cart had one line."""
    top = f"{storage.checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    with storage.scratch():
        rows = scorer_rows(spark, sf_dir)
        held_out = rows.filter("split <> 'train'")
        out = storage.stored(models.perturbed(stored_scorer(spark, rows, top), held_out, {"line_item_count": F.lit(1).cast("bigint")}, 0.5), lasting=True)
    storage.delete(spark, top)
    return out


@query("ml5_fold_weights", sql("SELECT fold, count(*) AS n, sum(weight) AS weight FROM (SELECT CAST(('0x' || substr(sha256('2026:' || group_id), 1, 16))::UBIGINT % 5 AS INTEGER) AS fold, CASE WHEN label_source LIKE 'weak%' THEN 0.5::DOUBLE ELSE 1 END AS weight FROM v_headers) GROUP BY fold"))
def ml5_fold_weights(spark, sf_dir):
    d = ml.with_fold(views.headers(spark, sf_dir), "group_id")
    return d.withColumn("weight", ml.source_weight(F.col("label_source"), F.lit(1.0))).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
