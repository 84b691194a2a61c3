"""Role extracts, gates, promotion and audit contracts: predicates over rows, or over one row of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritill.functions.scalars import CLASSES, worst_label
from veritill.operators.features import PROFILES
from veritill.operators.ordered import joined_on

TREATMENTS = ("APPROVE", "STEP_UP", "HOLD")
#: Limits of the gates (fixed values).
DEVELOPMENT_LIMITS = {"violation_recall": 0.90, "false_step_up_rate": 0.10, "false_decline_rate": 0.02, "ece": 0.08, "family_recall": 0.80, "family_rows": 50, "reviewed_none_recall": 0.80, "pr_auc_regression": 0.01}
GOLDEN_LIMITS = {
    "violation_recall": (">=", 0.90), "false_step_up_rate": ("<=", 0.10), "false_decline_rate": ("<=", 0.02), "pr_auc": (">=", 0.80), "ece": ("<=", 0.08), "family_recall": (">=", 0.80), "pr_auc_delta": (">=", -0.005), "fixed_rate_recall_delta": (">=", -0.02),
}
GOLDEN_FAMILY_ROWS = 25
#: Profiles without the shortcut feature, and the versions that a promotion asks for (fixed values).
SAFE_PROFILES = ("shortcut-safe-v2", "shortcut-safe-no-semantic-v2")


def eligible_semantic(df: DataFrame) -> DataFrame:
    """Rows of real public evidence that nothing transformed."""
    return df.filter((F.col("evidence_origin") == "real_public") & (F.col("attack_family") == "none"))


def target(df: DataFrame, mode: str) -> Column:
    """1 or 0 by the label, or by whether the treatment intervenes; null where there is neither; an unknown treatment fails the query."""
    if mode == "binary_deviation":
        return F.when(F.col("label").isin(0, 1), F.col("label")).cast("int")
    if mode != "policy_intervention":
        raise ValueError(f"no such target: {mode}")
    t = F.col("expected_treatment")
    return F.when(t.isNull(), F.lit(None).cast("int")).when(~t.isin(*TREATMENTS), F.raise_error(F.concat(F.lit("no such treatment: "), t)).cast("int")).otherwise((t != "APPROVE").cast("int"))


def target_rows(df: DataFrame, split: str, mode: str) -> DataFrame:
    """Rows of a split with a target."""
    return df.filter(F.col("split") == split).withColumn("target", target(df, mode)).filter(F.col("target").isNotNull())


def unreviewed(df: DataFrame, locale: str) -> DataFrame:
    return df.filter((F.col("label_source") == "unreviewed") & (F.col("locale") == locale))


def role_extract(df: DataFrame, roles: dict[str, int], held_back: str, held_rows: int, role: str = "split") -> tuple[DataFrame, DataFrame]:
    """Rows of the roles, without the one held back; and (role, n, expected) wherever a count, also that of the held back, is off."""
    table = df.sparkSession.createDataFrame([*roles.items(), (held_back, held_rows)], "_role string, expected bigint")
    got = df.filter(F.col(role).isin(*roles, held_back)).groupBy(F.col(role).alias("_role")).agg(F.count(F.lit(1)).alias("n"))
    off = table.join(got, "_role", "left").na.fill(0, ["n"]).filter("n <> expected").select(F.col("_role").alias("role"), "n", "expected")
    return df.filter(F.col(role).isin(*roles)), off


def shares(sizes: DataFrame, size: str, parts: dict[str, int], least: int = 20, divisor: int = 10) -> DataFrame:
    """(size, part, rows): whole percents of each size; a size that is too small or doesn't divide fails the query."""
    n = F.col(size)
    ok = F.when((n < least) | (n % divisor != 0), F.raise_error(F.concat(F.lit("size can't be shared: "), n.cast("string"))).cast("bigint")).otherwise(n)
    rows = F.array(*(F.struct(F.lit(k).alias("part"), F.floor(ok * p / 100).cast("bigint").alias("rows")) for k, p in parts.items()))
    return sizes.select(size, F.explode(rows).alias("x")).select(size, "x.part", "x.rows")


def with_only(df: DataFrame, values: str, name: str) -> DataFrame:
    """Rows with the one element of an array; another number of them fails the query."""
    n = F.coalesce(F.size(values), F.lit(-1))
    return df.withColumn(name, F.when(n == 1, F.get(values, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("elements instead of one: "), n.cast("string")))))


def _checks(df: DataFrame, keys: list[str], named: dict[str, Column]) -> DataFrame:
    """(keys, checks): one struct per check, with its verdict; an unknown one fails."""
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in named.items()))
    d = df.select(*keys, rows.alias("checks"))
    return d.withColumn("all_passed", F.forall("checks", lambda x: x["passed"]))


def worst_family(families: DataFrame, least_rows: int, none: float, by: list[str] | None = None) -> DataFrame:
    """(by, family_recall, supported): the least recall of families with enough violations, `none` without one."""
    enough = F.col("violation_rows") >= least_rows
    return families.groupBy(*(by or [])).agg(F.coalesce(F.min(F.when(enough, F.col("violation_recall"))), F.lit(none)).alias("family_recall"), F.count(F.when(enough, 1)).alias("supported"))


def development_gate(figures: DataFrame, keys: list[str], limits: dict[str, float] = DEVELOPMENT_LIMITS) -> DataFrame:
    """Seven checks per row of figures, among them reviewed rows without an attack and the ranking of a baseline."""
    at_least, at_most = (lambda k: F.col(k) >= limits[k]), (lambda k: F.col(k) <= limits[k])
    return _checks(
        figures, keys,
        {
            "operational_recall": at_least("violation_recall"), "false_step_up": at_most("false_step_up_rate"), "false_decline": at_most("false_decline_rate"), "calibration": at_most("ece"), "supported_families": at_least("family_recall"),
            "reviewed_none": at_least("reviewed_none_recall"), "pr_auc_regression": F.col("pr_auc") >= F.col("baseline_pr_auc") - limits["pr_auc_regression"],
        },
    )


def golden_gate(figures: DataFrame, keys: list[str], limits: dict[str, tuple[str, float]] = GOLDEN_LIMITS) -> DataFrame:
    """The eight criteria, one row each: actual, operator, limit and whether it passed, and the status of all."""
    rows = F.array(*(F.struct(F.lit(k).alias("criterion"), F.col(k).cast("double").alias("actual"), F.lit(op).alias("operator"), F.lit(v).alias("limit"), F.coalesce(F.col(k) >= v if op == ">=" else F.col(k) <= v, F.lit(False)).alias("passed")) for k, (op, v) in limits.items()))
    d = figures.select(*keys, rows.alias("x")).withColumn("status", F.when(F.forall("x", lambda c: c["passed"]), "passed").otherwise("failed_gate"))
    return d.select(*keys, "status", F.explode("x").alias("c")).select(*keys, "c.*", "status")


def diagnosis_gate(figures: DataFrame, keys: list[str], semantic_target: float, reviewed_rows: int, headroom: float, least_recall: float = 0.90, most_false: float = 0.10) -> DataFrame:
    """Whether a failed stage leaves enough to gain for another one: PROCEED or STOP."""
    d = _checks(
        figures, keys,
        {
            "below_target": F.col("reviewed_recall") < semantic_target, "reviewed_violations": F.col("reviewed_violations") >= reviewed_rows, "semantic_headroom": F.col("oracle_semantic_recall") >= headroom,
            "operational_recall": F.col("oracle_recall") >= least_recall, "false_step_up": F.col("oracle_false_step_up") <= most_false,
        },
    )
    return d.withColumn("status", F.when(F.col("all_passed"), "PROCEED").otherwise("STOP"))


def regression_gate(figures: DataFrame, keys: list[str], semantic_recall: float, most_false: float, most_declined: float, recall_loss: float, most_ece: float, f1_loss: float, minority_gain: float) -> DataFrame:
    """A candidate against its baseline: seven checks of recall, errors, calibration and class balance."""
    d = _checks(
        figures, keys,
        {
            "semantic_recall": F.col("reviewed_recall") >= semantic_recall, "false_step_up": F.col("false_step_up_rate") <= most_false, "false_decline": F.col("false_decline_rate") <= most_declined, "recall_kept": F.col("violation_recall") >= F.col("baseline_recall") - recall_loss,
            "calibration": F.col("ece") <= most_ece, "macro_f1_kept": F.col("macro_f1") >= F.col("baseline_macro_f1") - f1_loss, "minority_gain": F.col("minority_recall") >= F.col("baseline_minority_recall") + minority_gain,
        },
    )
    return d.withColumn("status", F.when(F.col("all_passed"), "PROCEED").otherwise("STOP"))


def promotable(manifests: DataFrame, reports: DataFrame, key: str = "artifact") -> DataFrame:
    """(artifact, problems): every reason against serving an artifact by its manifest and its evaluation report; none, and it may serve."""
    r = reports.select(F.col(key), *(F.col(c).alias(f"report_{c}") for c in reports.columns if c != key))
    d = manifests.join(r, key, "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    rules = {
        "not_passed": is_("report_status", "passed"), "report_schema": is_("report_schema_version", "golden-evaluation-v2"), "split": is_("report_split", "golden"),
        "criteria": (F.coalesce(F.size("report_criteria"), F.lit(0)) > 0) & F.forall(F.coalesce("report_criteria", F.array().cast("array<boolean>")), lambda x: F.coalesce(x, F.lit(False))),
        "model_version": same("report_model_version", "model_version"), "dataset": same("report_dataset_sha256", "dataset_sha256"), "binding": same("report_manifest_sha256", "manifest_sha256"), "profile": F.coalesce(F.col("feature_profile").isin(*SAFE_PROFILES), F.lit(False)),
        "report_profile": same("report_feature_profile", "feature_profile"), "target_mode": is_("target_mode", "policy_intervention"), "threshold_method": is_("threshold_method", "complete-policy-validation-v1"), "model_hold": ~F.coalesce(F.col("model_hold_enabled"), F.lit(False)),
        "synthetic": ~F.coalesce(F.col("dataset_version").startswith("synthetic"), F.lit(False)), "semantic_versions": (F.coalesce(F.size("semantic_versions"), F.lit(0)) > 0) & ~F.coalesce(F.array_contains("semantic_versions", "unknown"), F.lit(False)),
    }
    if "report_gate_status" in d.columns:
        rules["gate"] = is_("report_gate_status", "passed")
    if "feature_names" in d.columns:
        rules["feature_names"] = F.coalesce(profile_by_names(F.col("feature_names")) == F.col("feature_profile"), F.lit(False))
    found = F.array_compact(F.array(*(F.when(~ok, F.lit(k)) for k, ok in rules.items())))
    return d.select(key, found.alias("problems"), (F.size(found) == 0).alias("serving_approved"))


def profile_by_names(names: Column) -> Column:
    """The declared profile that has just these feature names in this order, null if none has or two do."""
    out = F.lit(None).cast("string")
    for name, own in PROFILES.items():
        if list(PROFILES.values()).count(own) > 1:
            continue
        out = F.when(names == F.array(*map(F.lit, own)), name).otherwise(out)
    return out


def promoted(manifests: DataFrame, reports: DataFrame, at: Column, key: str = "artifact") -> DataFrame:
    """The manifests that may serve, each with its promotion record: the digest of the report that it rests on, and the time."""
    passed = promotable(manifests, reports, key).filter("serving_approved").select(key, "serving_approved")
    digest = reports.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in reports.columns if c != key)), {"ignoreNullFields": "false"}), 256).alias("_report"))
    d = manifests.join(passed, key).join(digest, key)
    return d.withColumn("promotion", F.struct(F.col("_report").alias("evaluation_report_sha256"), at.alias("promoted_at"))).drop("_report")


def eligible_candidates(df: DataFrame, most_false: float, most_declined: float = 0.02, slack: float = 1e-12) -> DataFrame:
    return df.withColumn("eligible", (F.col("false_step_up_rate") <= most_false + slack) & (F.col("false_decline_rate") <= most_declined + slack))


def choose_candidate(df: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the eligible candidate of greatest recall, then fewer false step-ups, fewer declines and the earlier name; none, and the group is missing."""
    rank = F.struct(-F.col("violation_recall"), "false_step_up_rate", "false_decline_rate", "name")
    return df.filter("eligible").groupBy(*by).agg(F.min_by(F.struct(*(c for c in df.columns if c not in by)), rank).alias("b")).select(*by, "b.*")


def metric_mismatches(recorded: DataFrame, recomputed: DataFrame, key: str, metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(key, metric, recorded, recomputed) wherever a recorded figure isn't the recomputed one, or one side lacks it."""
    unpivot = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select(key, "x.metric", F.col("x.v").alias(name))
    d = unpivot(recorded, "recorded").join(unpivot(recomputed, "recomputed"), [key, "metric"], "full")
    return d.filter(~F.coalesce(F.abs(F.col("recorded") - F.col("recomputed")) <= tolerance, F.lit(False)))


def review_labels(df: DataFrame, source: str = "llm_assisted_v4") -> DataFrame:
    """Reviewed rows as labelled ones: the worst semantic label, the resolved targets; a row without them fails the query."""
    whole = F.col("expected_treatment").isNotNull() & F.col("deviation").isNotNull()
    need = lambda c: F.when(whole, F.col(c)).otherwise(F.raise_error(F.lit("a reviewed row lacks its targets")))
    return df.withColumns(
        {
            "semantic_outcome": worst_label(F.col("semantic_labels")), "policy_intervention_target": need("expected_treatment"), "binary_deviation": need("deviation"), "label_source": F.lit(source), "deterministic_outcome": F.array().cast("array<string>"),
        }
    )


def audit_treatment(deterministic: Column, semantic_label: Column, deviation: Column, violations: Column) -> Column:
    """What an audited row should get: the rules' treatment where they intervene, a question where the review found anything, else approval."""
    clean = (semantic_label == "ENTAILMENT") & (deviation == "MATCH") & (F.coalesce(F.size(violations), F.lit(0)) <= 0)
    return F.when(deterministic != "APPROVE", deterministic).when(F.coalesce(clean, F.lit(False)), "APPROVE").otherwise("STEP_UP")


def blinding_leaks(queue: DataFrame, ledger: DataFrame) -> DataFrame:
    """(leak, n): queue rows that tell a reviewer an answer, ids that don't bind to the private ledger, and groups that come twice."""
    said = lambda c: F.col(c).isNotNull()
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    labels = said("deviation") | said("expected_treatment") | said("confidence") | some("semantic_labels") | some("violation_types") | ~F.coalesce(F.col("label_source") == "unreviewed", F.lit(False))
    origin = said("parent_example_id") | said("generator_version") | ~F.coalesce(F.col("transformation") == "none", F.lit(False))
    hidden = [c for c in ("model_predictions", "attack_family") if c in queue.columns]
    n = lambda c: F.count(F.when(c, 1))
    own = queue.agg(n(labels).alias("labels"), n(origin).alias("provenance"), (F.count(F.lit(1)) * len(hidden)).alias("hidden_columns"))
    ids = queue.select("example_id").join(ledger.select("example_id").distinct().withColumn("_l", F.lit(1)), "example_id", "full").agg(F.count(F.when(F.col("_l").isNull(), 1)).alias("unbound"), (F.count(F.lit(1)) - F.count_distinct("example_id")).alias("repeated_ids"))
    missing = ledger.select("example_id").join(queue.select("example_id"), "example_id", "left_anti").agg(F.count(F.lit(1)).alias("not_queued"))
    groups = queue.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("repeated_groups"))
    one = joined_on(joined_on(joined_on(own, ids, ()), missing, ()), groups, ())
    rows = F.array(*(F.struct(F.lit(k).alias("leak"), F.col(k).cast("bigint").alias("n")) for k in ("labels", "provenance", "hidden_columns", "unbound", "repeated_ids", "not_queued", "repeated_groups")))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def profile_columns(budgets: Column) -> dict[str, Column]:
    """The ten dimensions by which rows are compared."""
    from veritill.functions.scalars import count_bucket, label_key, utilisation_bucket

    known = lambda c: F.coalesce(F.col(c), F.lit("UNLABELED"))
    return {
        "dim_label_source": F.col("label_source"), "dim_deviation": known("deviation"), "dim_semantic": label_key(F.col("semantic_labels")), "dim_expected_treatment": known("expected_treatment"), "dim_transformation": F.col("transformation"),
        "dim_evidence_origin": F.col("evidence_origin"), "dim_evidence_sufficiency": F.col("evidence_sufficiency"), "dim_cart_size": count_bucket(F.col("line_item_count"), (1, 2, 4)), "dim_budget_utilization": utilisation_bucket(F.col("total_amount_minor"), budgets),
        "dim_text_length": count_bucket(F.length("evidence_text"), (256, 1024, 4096)),
    }


STRATUM = ("label_source", "deviation", "semantic", "transformation", "evidence_sufficiency", "evidence_origin", "text_length")


def with_profile(df: DataFrame, budgets: Column) -> DataFrame:
    """Rows with ten dimensions and a stratum of seven of them."""
    return df.withColumns(profile_columns(budgets)).withColumn("stratum", F.struct(*(F.col(f"dim_{k}").alias(k) for k in STRATUM)))


def batch_completion(batches: DataFrame, results: DataFrame, key: str = "shard") -> DataFrame:
    """(shard, requests, answers, failures, complete): every request answered once, and none failed."""
    r = results.groupBy(key).agg(F.count(F.lit(1)).alias("answers"), F.count(F.when(F.col("failed"), 1)).alias("failures"))
    d = batches.groupBy(key).agg(F.count(F.lit(1)).alias("requests")).join(r, key, "full").na.fill(0, ["requests", "answers", "failures"])
    return d.withColumn("complete", (F.col("requests") == F.col("answers")) & (F.col("failures") == 0))


def retry_overlay(original: DataFrame, retries: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The original rows in their order, those that were tried again with the later answer; a retry without an original fails the query."""
    fresh = retries.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_again"))
    d = original.withColumn("_known", F.lit(True)).join(fresh, key, "full")
    d = d.withColumn(order, F.when(F.col("_known"), F.col(order)).otherwise(F.raise_error(F.concat(F.lit("a retry of nothing: "), F.col(key).cast("string"))).cast(original.schema[order].dataType)))
    d = d.withColumns({c: F.when(F.col("_again"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns} | {"retried": F.coalesce("_again", F.lit(False))})
    return d.select(*original.columns, "retried").orderBy(order)


def cohort_recall(df: DataFrame, ledger: DataFrame, cohort: str) -> DataFrame:
    """One row: violations of a ledger's cohort and the share that was stopped."""
    own = df.join(ledger.filter(F.col("cohort") == cohort).select("example_id").distinct(), "example_id", "left_semi").filter("expected_treatment <> 'APPROVE'")
    stopped = F.count(F.when(F.col("predicted_treatment") != "APPROVE", 1))
    return own.agg(F.count(F.lit(1)).alias("violations"), (stopped / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))


def fold_problems(df: DataFrame, expected: DataFrame) -> DataFrame:
    """(fold, rows, wrong_logits, repeated, missing, unexpected, classes): what is wrong with each fold's predictions.

    df: fold, example_id, constraint_id, logits. expected: fold and the same keys.
    """
    key = F.concat_ws("\u001f", "example_id", "constraint_id")
    logits = F.col("logits")
    fine = (F.size(logits) == 3) & F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    top = F.array_position(logits, F.array_max(logits))
    d = df.select("fold", key.alias("key"), F.coalesce(fine, F.lit(False)).alias("fine"), top.alias("top"))
    per_key = d.groupBy("fold", "key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("fine"), 1)).alias("bad"))
    both = per_key.join(expected.select("fold", key.alias("key")).distinct().withColumn("_wanted", F.lit(True)), ["fold", "key"], "full")
    g = both.groupBy("fold").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("wrong_logits"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_wanted").isNull(), 1)).alias("unexpected"),
    )
    return g.join(d.groupBy("fold").agg(F.count_distinct("top").alias("classes")), "fold", "left").na.fill(0, ["classes"])


def out_of_fold_union(folds: list[DataFrame], key: str) -> DataFrame:
    """The rows of all folds; a key that two of them hold fails the query."""
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    twice = out.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key, F.lit(True).alias("_twice"))
    guard = F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("two folds hold "), F.col(key).cast("string"))).cast(out.schema[key].dataType)).otherwise(F.col(key))
    return out.join(twice, key, "left").withColumn(key, guard).drop("_twice")


def tagged_predictions(df: DataFrame, logits: str, temperature: float) -> DataFrame:
    """Class scores at a temperature, and whether a row was scored across folds or held out."""
    from veritill.functions.scalars import softmax

    d = df.withColumn("_p", softmax(F.col(logits), temperature))
    return d.withColumns({n: F.col("_p")[k] for k, n in enumerate(CLASSES)} | {"prediction_origin": F.when(F.col("split") == "train", "cross_fit").otherwise("held_out")}).drop("_p")


def canonical_order(values: Column, names: list[str]) -> Column:
    """An array whose elements are named by a model's labels, in the order of the classes; a class that the model lacks is an error."""
    have = {n.lower(): k for k, n in enumerate(names)}
    if missing := [c for c in CLASSES if c not in have]:
        raise ValueError(f"the model lacks the classes {missing}")
    return F.array(*(values[have[c]] for c in CLASSES))


def weight_table(df: DataFrame, weight: str, tolerance: float = 1e-9) -> DataFrame:
    """(pair_key, weight) per pair; weights whose mean isn't 1 fail the query."""
    key = F.concat_ws("\u001f", "example_id", "constraint_id")
    mean = df.agg(F.avg(weight).alias("_mean"))
    ok = F.abs(F.col("_mean") - 1) <= tolerance
    return joined_on(df, mean, ()).select(key.alias("pair_key"), F.when(ok, F.col(weight)).otherwise(F.raise_error(F.lit("the weights' mean isn't 1")).cast("double")).alias("weight"))


def fallback_scores(df: DataFrame, version: str = "semantic-unavailable") -> DataFrame:
    """A row per semantic constraint with the scores of no scorer: neutral, so the policy asks."""
    wanted = F.filter("constraints", lambda c: c["type"] == "semantic_attribute")
    d = df.select("*", F.explode(wanted).alias("_c"))
    return d.withColumns({"constraint_id": F.col("_c.constraint_id"), "contradiction": F.lit(0.0), "neutral": F.lit(1.0), "entailment": F.lit(0.0), "semantic_version": F.lit(version)}).drop("_c")


def with_summary(df: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Rows with the status of their latest evaluation, `not_run` where there is none."""
    last = summaries.groupBy(key).agg(F.max_by("status", F.struct("created_at", "status")).alias("evaluation_status"))
    return df.join(last, key, "left").na.fill("not_run", ["evaluation_status"])


#: Error codes of rejected requests, with the status they are answered with.
ERRORS = {"CONFIRMATION_REQUIRED": 422, "DUPLICATE_MANDATE": 409, "MANDATE_NOT_FOUND": 404}


def error_rows(rejected: DataFrame, key: str, code: str = "error_code") -> DataFrame:
    """(key, code, message, status) of rejected rows; a code without an entry is a 500."""
    status = F.create_map(*(F.lit(x) for pair in ERRORS.items() for x in pair))
    c = F.col(code)
    return rejected.select(key, c.alias("code"), F.initcap(F.lower(F.regexp_replace(c, "_", " "))).alias("message"), F.coalesce(F.try_element_at(status, c), F.lit(500)).alias("status"))


def value_list(text: Column) -> Column:
    """A constraint's JSON value as a list: nothing for null, the elements of an array, or the value alone."""
    t = F.trim(text)
    array = F.transform(F.from_json(t, "array<string>"), lambda x: x)
    alone = F.regexp_replace(t, '^"(.*)"$', "$1")
    return F.when(t.isNull() | (t == "null"), F.array().cast("array<string>")).when(t.startswith("["), array).otherwise(F.array(alone))


def review_queue(df: DataFrame, stratum: list[str], hardness: str, sample: int, hard: int, key: str = "example_id") -> DataFrame:
    """Rows for review with their role: a sample of each stratum in hash order, and the hardest of what is left."""
    from veritill.functions.hashing import order_key
    from veritill.operators.windows import sample_per_stratum, top_k

    first = sample_per_stratum(df, stratum, key, sample, "review")
    rest = df.join(first.select(key), key, "left_anti")
    last = top_k(rest, hard, F.col(hardness).desc(), order_key("review", F.col(key)))
    return first.withColumn("queue_role", F.lit("representative")).unionByName(last.withColumn("queue_role", F.lit("hard")))


def split_queue(queue: DataFrame, context: list[str], key: str = "example_id") -> tuple[DataFrame, DataFrame]:
    """A blinded queue as the dataset that is reviewed and the context that belongs to it, bound by the key."""
    return queue.drop(*context), queue.select(key, *context)


def diagnosis(df: DataFrame, before: str, after: str, dimensions: list[str]) -> DataFrame:
    """(dimension, category, rows, changed, tightened, change_rate): how two policies differ along each dimension, in one shuffle."""
    level = lambda c: F.when(F.col(c) == "APPROVE", 0).when(F.col(c) == "STEP_UP", 1).otherwise(2)
    flat = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category")) for d in dimensions))
    d = df.select(F.explode(flat).alias("d"), (F.col(before) != F.col(after)).cast("int").alias("moved"), (level(after) > level(before)).cast("int").alias("up"))
    return d.groupBy("d.dimension", "d.category").agg(F.count(F.lit(1)).alias("rows"), F.sum("moved").alias("changed"), F.sum("up").alias("tightened"), F.avg("moved").alias("change_rate"))
