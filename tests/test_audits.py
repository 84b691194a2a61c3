"""Two-reviewer audits by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from veritill.operators import audits, contracts, features


def test_report_of_a_small_audit(spark):
    ledger = spark.createDataFrame([("e1", "f", "r1", "APPROVE"), ("e2", "f", "r2", "APPROVE"), ("e3", "g", "r1", "HOLD"), ("e4", None, "r1", "APPROVE"), ("e5", "g", "r2", "APPROVE")], "example_id string, family string, role string, deterministic string")
    v = lambda e, who, d, s, t: (e, who, d, s, t)
    reviews = spark.createDataFrame([
        v("e1", "a", "MATCH", "ENTAILMENT", "APPROVE"), v("e1", "b", "MATCH", "ENTAILMENT", "APPROVE"), v("e2", "a", "MATCH", "NEUTRAL", "APPROVE"), v("e2", "b", "VIOLATION", "CONTRADICTION", "HOLD"), v("e3", "a", "MATCH", "ENTAILMENT", "APPROVE"), v("e3", "b", "MATCH", "ENTAILMENT", "STEP_UP"),
        v("e4", "a", "MATCH", "ENTAILMENT", "APPROVE"), v("e5", "a", "MATCH", "NEUTRAL", "STEP_UP"), v("e5", "b", "MATCH", "NEUTRAL", "STEP_UP"), v("ex", "a", "MATCH", "NEUTRAL", "STEP_UP"),
    ], "example_id string, reviewer_id string, deviation string, semantic_label string, expected_treatment string")
    final = spark.createDataFrame([("e2", "VIOLATION", "CONTRADICTION", "HOLD"), ("e1", "VIOLATION", "CONTRADICTION", "HOLD")], "example_id string, deviation string, semantic_label string, expected_treatment string")
    got = {(r.scope, r.name): (r.rows, r.agreements, r.adjudicated, r.unresolved, r.policy_matches, r.approve, r.step_up, r.hold) for r in audits.audit_report(ledger, reviews, final).collect()}
    # e1 agrees and matches; e2 is adjudicated to HOLD where a step up is asked; e3 has no adjudication; e4 one review; e5 agrees and matches
    assert got[("all", "all")] == (5, 2, 1, 2, 2, 1, 1, 1)
    assert got[("family", "f")] == (2, 1, 1, 0, 1, 1, 0, 1) and got[("family", "g")] == (2, 1, 0, 1, 1, 0, 1, 0) and got[("family", None)] == (1, 0, 0, 1, 0, 0, 0, 0)
    assert got[("role", "r1")] == (3, 1, 0, 2, 1, 1, 0, 0) and got[("role", "r2")] == (2, 1, 1, 0, 1, 0, 1, 1) and len(got) == 6


def test_prepared_requests(spark):
    queue = [(r, f"judge-{r}", p, f"e{p}", f"b{p}") for r in "ab" for p in range(1, 8)]
    asked = spark.createDataFrame(queue, "role string, reviewer_id string, place bigint, example_id string, body string")
    sent = [(r, (p - 1) // 3, (p - 1) % 3 + 1, f"judge-{r}:e{p}", f"b{p}") for r in "ab" for p in range(1, 8)]
    shards = [(r, s, 3 if s < 2 else 1) for r in "ab" for s in range(3)]
    problems = lambda rows, counts=shards: sorted(map(tuple, audits.prepared_problems(spark.createDataFrame(rows, "role string, shard int, line bigint, custom_id string, body string"), asked, spark.createDataFrame(counts, "role string, shard int, requests bigint")).collect()), key=repr)
    assert problems(sent) == []
    assert problems([(*r[:4], "other") if r[:3] == ("a", 1, 2) else r for r in sent]) == [("a", 1, "payload", 1, 2)]
    assert problems([(*r[:3], "judge-x:e4", r[4]) if r[:3] == ("b", 1, 1) else r for r in sent]) == [("b", 1, "reviewer", 1, 1)]
    # a request that is missing moves all that come after it
    assert problems([r for r in sent if r[:3] != ("a", 1, 3)]) == [("a", 1, "shard_count", 2, 0), ("a", 2, "order", 1, 1), ("a", None, "missing", 1, 7)]
    assert problems([*sent, ("b", 2, 2, "judge-b:e9", "b9")]) == [("b", 2, "shard_count", 2, 0), ("b", 2, "unexpected", 1, 2)]
    assert problems(sent, shards[:-1]) == [("b", 2, "shard_count", 1, 0)]


def test_one_annotation_of_three_changes(spark):
    df = spark.createDataFrame([("e1", [("a", "N", 0.5), ("b", "N", 0.5), ("c", "N", None)]), ("e2", [("a", "N", 0.5)]), ("e3", None), ("e4", [])], "example_id string, semantic array<struct<constraint_id:string,label:string,confidence:double>>")
    updates = spark.createDataFrame([("e1", "b", "E", 1.0), ("e1", "zz", "E", 1.0), ("e4", "a", "E", 1.0)], "example_id string, constraint_id string, label string, confidence double")
    got = {r.example_id: None if r.semantic is None else [tuple(x) for x in r.semantic] for r in audits.updated_annotations(df, updates).collect()}
    assert got == {"e1": [("a", "N", 0.5), ("b", "E", 1.0), ("c", "N", None)], "e2": [("a", "N", 0.5)], "e3": None, "e4": []}


def test_repeated_ids_and_bindings(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "example_id string")
    with pytest.raises(ValueError, match="example_id b comes 2 times"):
        audits.unique(df, "example_id")
    assert audits.unique(df.distinct(), "example_id").count() == 2
    was = spark.createDataFrame([("x", 1, None), ("y", 2, "d"), ("z", 3, "d")], "artifact string, rows int, digest string")
    now = spark.createDataFrame([("x", 1, None), ("y", 2, None), ("w", 3, "d")], "artifact string, rows int, digest string")
    assert sorted((r.artifact, r.changed) for r in audits.binding_problems(was, now).collect()) == [("w", ["rows", "digest"]), ("y", ["digest"]), ("z", ["rows", "digest"])]


def test_profiles_by_names(spark):
    rows = [(list(v), k if list(features.PROFILES.values()).count(v) == 1 else None) for k, v in features.PROFILES.items()] + [(list(features.V2)[::-1], None), ([], None), (None, None)]
    df = spark.createDataFrame(rows, "names array<string>, want string").withColumn("got", contracts.profile_by_names(F.col("names")))
    assert all(r.got == r.want for r in df.collect())
