"""Audits by two reviewers: prepared requests, reports over families and roles, and labels written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritill.sources import storage


def settled(reviews: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(example_id, raters, agreed, adjudicated, deviation, semantic_label, expected_treatment): what two independent reviews of an example come to.

    reviews: example_id, reviewer_id, deviation, semantic_label, expected_treatment. If they agree, their common verdict
    counts, else the adjudication; without one the example has none. Reviews are one row per example before they are joined.
    """
    verdict = F.struct("deviation", "semantic_label", "expected_treatment")
    r = reviews.groupBy("example_id").agg(F.count_distinct("reviewer_id").alias("raters"), F.count_distinct(verdict).alias("_verdicts"), F.min(verdict).alias("_common"))
    a = adjudications.select("example_id", verdict.alias("_final"))
    d = r.join(a, "example_id", "left")
    agreed = F.col("_verdicts") == 1
    return d.select("example_id", "raters", agreed.alias("agreed"), (~agreed & F.col("_final").isNotNull()).alias("adjudicated"), F.when(agreed, F.col("_common")).otherwise(F.col("_final")).alias("v")).select("example_id", "raters", "agreed", "adjudicated", "v.*")


def contract_treatment(deterministic: Column) -> Column:
    """What the policy asks for: the rules' treatment unless they approve, then a step up for anything but a clean match."""
    clean = (F.col("semantic_label") == "ENTAILMENT") & (F.col("deviation") == "MATCH")
    return F.when(deterministic != "APPROVE", deterministic).when(clean, "APPROVE").otherwise("STEP_UP")


def audit_report(ledger: DataFrame, reviews: DataFrame, adjudications: DataFrame, dimensions: tuple[str, ...] = ("family", "role")) -> DataFrame:
    """(scope, name, rows, agreements, agreement_rate, adjudicated, unresolved, policy_matches, policy_rate, approve, step_up, hold): the whole audit and each value of each dimension.

    ledger: example_id, deterministic, and the dimensions. Examples with fewer than two reviewers are unresolved; rates are over
    all rows of the scope. All scopes come from one aggregate by grouping sets.
    """
    s = settled(reviews, adjudications).filter("raters >= 2")
    d = ledger.join(s, "example_id", "left")
    resolved = F.col("expected_treatment").isNotNull()
    d = d.withColumns({"_resolved": resolved, "_match": F.coalesce(F.col("expected_treatment") == contract_treatment(F.col("deterministic")), F.lit(False))})
    count = lambda c: F.count(F.when(c, 1))
    g = d.groupingSets([[], *([F.col(c)] for c in dimensions)], *(F.col(c) for c in dimensions)).agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("rows"), count(F.col("agreed")).alias("agreements"), count(F.col("adjudicated")).alias("adjudicated"), count(~F.col("_resolved")).alias("unresolved"), count(F.col("_match")).alias("policy_matches"),
        *(count(F.col("expected_treatment") == t).alias(t.lower()) for t in ("APPROVE", "STEP_UP", "HOLD")),
    )
    every = 2 ** len(dimensions) - 1
    level = lambda k: every - 2 ** (len(dimensions) - 1 - k)
    scope, name = F.lit("all"), F.lit("all")
    for k, c in enumerate(dimensions):
        scope, name = F.when(F.col("_level") == level(k), c).otherwise(scope), F.when(F.col("_level") == level(k), F.col(c).cast("string")).otherwise(name)
    out = ["rows", "agreements", (F.col("agreements") / F.col("rows")).alias("agreement_rate"), "adjudicated", "unresolved", "policy_matches", (F.col("policy_matches") / F.col("rows")).alias("policy_rate"), "approve", "step_up", "hold"]
    return g.select(scope.alias("scope"), name.alias("name"), *out)


def prepared_problems(requests: DataFrame, queue: DataFrame, shards: DataFrame) -> DataFrame:
    """(role, shard, problem, n, first_line): where prepared requests aren't what the queue asks for.

    requests: role, shard, line (from 1), custom_id, body. queue: role, reviewer_id, place (from 1), example_id, body (as
    recomputed). shards: role, shard, requests (as recorded). A shard's requests begin behind those that the shards
    before it hold; the request at a place must carry that place's example and body. Only numbers of shards are summed
    in order; requests meet the queue by role and place.
    """
    before = Window.partitionBy("role").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    held = requests.groupBy("role", "shard").agg(F.count(F.lit(1)).alias("_held"))
    held = held.withColumn("_offset", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    counts = shards.join(held, ["role", "shard"], "full").filter(~F.col("requests").eqNullSafe(F.col("_held")))
    counts = counts.select("role", "shard", F.lit("shard_count").alias("problem"), F.coalesce(F.col("_held"), F.lit(0)).alias("n"), F.lit(0).cast("bigint").alias("first_line"))
    placed = requests.join(held.drop("_held"), ["role", "shard"]).withColumn("place", F.col("_offset") + F.col("line"))
    asked = queue.select("role", "place", "reviewer_id", F.col("example_id").alias("_asked"), F.col("body").alias("_body"))
    d = placed.join(asked, ["role", "place"], "full")
    own = F.substring_index("custom_id", ":", 1)
    problem = (
        F.when(F.col("custom_id").isNull(), "missing").when(F.col("_asked").isNull(), "unexpected").when(own != F.col("reviewer_id"), "reviewer")
        .when(F.expr("substring(custom_id, length(reviewer_id) + 2)") != F.col("_asked"), "order").when(~F.col("body").eqNullSafe(F.col("_body")), "payload")
    )
    found = d.withColumn("problem", problem).filter(F.col("problem").isNotNull())
    found = found.groupBy("role", "shard", "problem").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("line"), F.min("place")).cast("bigint").alias("first_line"))
    return counts.unionByName(found)


def review_inputs(df: DataFrame, columns: list[str], provenance: list[str], private: list[str], blind: bool = False) -> DataFrame:
    """(example_id, input): what a reviewer gets of a row as JSON; blind inputs leave the private parts of its provenance out."""
    part = F.struct(*(F.col(c) for c in sorted([*provenance, *([] if blind else private)])))
    return df.select("example_id", F.to_json(F.struct(*sorted(columns), part.alias("provenance")), {"ignoreNullFields": "false"}).alias("input"))


def updated_annotations(df: DataFrame, updates: DataFrame, column: str = "semantic") -> DataFrame:
    """Rows whose array of (constraint_id, label, confidence) has the updates' entries in place of its own; order and the rest stay.

    updates: example_id, constraint_id, label, confidence, one per constraint. They are gathered to one map per row, joined once.
    """
    entry = F.struct("constraint_id", F.struct("label", F.col("confidence").cast("double").alias("confidence")).alias("new"))
    changes = updates.groupBy("example_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_changes"))
    new = lambda x: F.try_element_at(F.col("_changes"), x["constraint_id"])
    put = lambda x: F.when(new(x).isNotNull(), F.struct(x["constraint_id"].alias("constraint_id"), new(x)["label"].alias("label"), new(x)["confidence"].alias("confidence"))).otherwise(F.struct(x["constraint_id"].alias("constraint_id"), x["label"].alias("label"), x["confidence"].cast("double").alias("confidence")))
    return df.join(changes, "example_id", "left").withColumn(column, F.transform(column, put)).drop("_changes")


def exported_labels(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Canonical rows (example_id, constraints, labels) with resolved labels where theirs are unreviewed.

    The review's semantic label stands for every semantic constraint, in the order of the mandate, with confidence 1.
    resolved: example_id, deviation, semantic_label, violation_types, expected_treatment, label_source, confidence.
    """
    r = resolved.select("example_id", F.struct("deviation", "semantic_label", "violation_types", "expected_treatment", "label_source", "confidence").alias("_r"))
    d = df.join(r, "example_id", "left")
    asked = F.filter("constraints", lambda c: c["type"] == "semantic_attribute")
    semantic = F.transform(asked, lambda c: F.struct(c["constraint_id"].alias("constraint_id"), F.col("_r.semantic_label").alias("label"), F.lit(1.0).alias("confidence")))
    new = F.struct(F.col("_r.deviation").alias("deviation"), semantic.alias("semantic"), F.col("_r.violation_types").alias("violation_types"), F.col("_r.expected_treatment").alias("expected_treatment"), F.col("_r.label_source").alias("label_source"), F.col("_r.confidence").alias("reviewer_confidence"))
    use = (F.col("labels.label_source") == "unreviewed") & F.col("_r").isNotNull()
    return d.withColumn("labels", F.when(use, new).otherwise(F.col("labels"))).drop("_r")


def unique(df: DataFrame, key: str) -> DataFrame:
    """The frame itself, or an error that names its first repeated key."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(key).first()
    if twice is not None:
        raise ValueError(f"{key} {twice[0]} comes {twice['n']} times")
    return df


def binding_problems(recorded: DataFrame, current: DataFrame, key: str = "artifact") -> DataFrame:
    """(artifact, changed): what of a recorded binding (rows, digests, versions) isn't what is there now, null-safe; artifacts of one side alone have all."""
    fields = [c for c in recorded.columns if c != key]
    now = current.select(key, *(F.col(c).alias(f"_now_{c}") for c in fields), F.lit(True).alias("_there"))
    d = recorded.withColumn("_was", F.lit(True)).join(now, key, "full")
    both = F.col("_was").isNotNull() & F.col("_there").isNotNull()
    changed = F.array_compact(F.array(*(F.when(~both | ~F.col(c).eqNullSafe(F.col(f"_now_{c}")), F.lit(c)) for c in fields)))
    return d.select(key, changed.alias("changed")).filter(F.size("changed") > 0)


def prepared_audit(sample: DataFrame, deterministic: Column, shown: list[str], hidden: list[str], dimensions: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An audit's queue, ledger and histograms from one sample of examples, which is evaluated and stored once.

    The queue (example_id, payload) holds what reviewers see and the rules' results, the ledger (example_id, deterministic,
    the hidden columns) what they must not see, and (dimension, category, n) counts the sample along each dimension.
    """
    stored = storage.stored(sample.select("example_id", deterministic.alias("deterministic"), *dict.fromkeys([*shown, *hidden, *dimensions])))
    payload = F.to_json(F.struct(*sorted(shown), F.struct(F.col("deterministic").alias("treatment")).alias("rules")), {"ignoreNullFields": "false"})
    flat = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("UNREVIEWED")).alias("category")) for d in dimensions))
    counts = stored.select(F.explode(flat).alias("x")).groupBy("x.dimension", "x.category").agg(F.count(F.lit(1)).alias("n"))
    return stored.select("example_id", payload.alias("payload")), stored.select("example_id", "deterministic", *hidden), counts


def blinding_gaps(queue: DataFrame, ledger: DataFrame, hidden: list[str]) -> DataFrame:
    """(example_id, gap): queue rows without a ledger row, ledger rows without a queue row, and payloads that name a hidden column."""
    d = queue.withColumn("_q", F.lit(True)).join(ledger.select("example_id", F.lit(True).alias("_l")), "example_id", "full")
    told = F.size(F.array_intersect(F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>")), F.array(*map(F.lit, hidden)))) > 0
    gap = F.when(F.col("_l").isNull(), "no_ledger").when(F.col("_q").isNull(), "no_queue").when(told, "hidden_shown")
    return d.select("example_id", gap.alias("gap")).filter(F.col("gap").isNotNull())
