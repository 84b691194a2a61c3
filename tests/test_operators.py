"""Small hand-made cases of metrics, selections, checks and state."""

import pytest
from pyspark.sql import functions as F

from veritill.functions import hashing, scalars
from veritill.operators import aggregates, joins, metrics, reviews, selection, stateful, validate, windows
from veritill.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_perfect_treatments(spark):
    d = spark.createDataFrame([("APPROVE",) * 2, ("APPROVE",) * 2, ("HOLD",) * 2, ("HOLD",) * 2], "e string, p string")
    r = metrics.treatment_metrics(d, "e", "p").first()
    assert (r.violation_recall, r.false_step_up_rate, r.false_decline_rate, r.treatment_accuracy) == (1, 0, 0, 1)


def test_metrics_of_nothing_are_zero(spark):
    r = metrics.treatment_metrics(spark.createDataFrame([], "e string, p string"), "e", "p").first()
    assert r.rows == 0 and r.violation_recall == 0


def test_calibration_error_edges(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 1.0)], "y int, p double")
    assert metrics.calibration_error(d, "y", "p").first().ece == 0
    d = spark.createDataFrame([(1, 0.3), (0, 0.3)], "y int, p double")
    assert metrics.calibration_error(d, "y", "p").first().ece == pytest.approx(0.2)


def test_average_precision_and_auc_with_ties(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, p double")
    assert metrics.average_precision(d, "y", "p").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.roc_auc(d, "y", "p").first()[0] == pytest.approx(0.875)


def test_threshold_prefers_the_higher_of_equals(spark):
    rows = [("APPROVE", 0.2), ("APPROVE", 0.3), ("HOLD", 0.9), ("HOLD", 0.9)]
    d = spark.createDataFrame(rows, "e string, p double").withColumns({"semantic_contradiction": F.lit(0.0), "semantic_neutral": F.lit(0.0), "hard_fail_count": F.lit(0), "critical_hold_count": F.lit(0)})
    r = metrics.select_threshold(metrics.threshold_curve(d, "e", "p", F.lit(0.8), F.lit(0.6))).first()
    assert (r.threshold, r.violation_recall, r.false_step_up_count) == (0.9, 1.0, 0)


def test_hash_functions(spark):
    import hashlib

    d = hashlib.sha256(b"abc").hexdigest()
    r = one(spark, hashing.fold64(F.lit(d), 7).alias("a"), hashing.fold_of_five(F.lit(d)).alias("b"), hashing.hex_number(F.lit(d), 12).alias("c"))
    assert (r.a, r.b, r.c) == (int(d[:16], 16) % 7, int(d, 16) % 5, int(d[:12], 16))
    with pytest.raises(ValueError):
        hashing.hex_number(F.lit(d), 16)


def test_scalars(spark):
    r = one(
        spark, scalars.minor(F.lit(0.001)).alias("m"), scalars.entropy(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("e"), scalars.top_class(F.lit(0.5), F.lit(0.5), F.lit(0.0)).alias("t"),
        scalars.worst_label(F.array(F.lit("NEUTRAL"), F.lit("ENTAILMENT"))).alias("w"), scalars.quoted_items(F.lit("['B0A' \"B1\"]")).alias("q"), scalars.utilisation_bucket(F.lit(5), F.array().cast("array<int>")).alias("u"),
        scalars.text_budget(F.lit("at most $1,234.5")).alias("b"),
    )
    assert (r.m, r.e, r.t, r.w, r.q, r.u, r.b) == (1, 0.0, "contradiction", "NEUTRAL", ["B0A", "B1"], "missing", 123450)


def test_greedy_packing_is_exact_and_keeps_groups(spark):
    rows = [(f"g{k}", i) for k in range(30) for i in range(k % 4 + 1)]
    d = spark.createDataFrame(rows, "g string, i int")
    n = len(rows)
    out = selection.pack_groups(d, "g", {"train": n - 20, "test": 20})
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": n - 20, "test": 20}
    assert validate.split_leaks(out, "g", "split").isEmpty()
    with pytest.raises(ValueError):
        selection.pack_groups(d, "g", {"train": n + 1})


def test_roles_and_proportions(spark):
    d = spark.createDataFrame([(f"g{k}", i, "ab"[k % 2]) for k in range(40) for i in range(2)], "g string, i int, s string")
    roles = {r["role"]: r["count"] for r in selection.fill_roles(d, "g", [("x", 10), ("y", 6)]).groupBy("role").count().collect()}
    assert roles == {"x": 10, "y": 6}
    share = {r["s"]: r["count"] for r in selection.proportional_groups(d, "g", "s", 40).groupBy("s").count().collect()}
    assert share == {"a": 20, "b": 20}


def candidates(spark):
    rows = [(f"e{k}", f"g{k % 20}", f"s{k % 31}", f"e{k - 1}" if k % 3 == 1 else None, f"f{k % 4}", k) for k in range(60)]
    return spark.createDataFrame(rows, "example_id string, group_id string, source_record_id string, parent_example_id string, fingerprint string, k int")


def test_diverse_take_against_a_plain_loop(spark):
    d = candidates(spark)
    rows, got = sorted(d.collect(), key=lambda r: r.k), [r.example_id for r in selection.diverse_take(d, ["k"], 12).collect()]
    groups, sources, prints, want = set(), set(), {}, []
    for capped in (True, False):
        for r in rows:
            if len(want) < 12 and r.group_id not in groups and r.source_record_id not in sources and not (capped and prints.get(r.fingerprint, 0) >= 2):
                groups.add(r.group_id)
                sources.add(r.source_record_id)
                prints[r.fingerprint] = prints.get(r.fingerprint, 0) + 1
                want.append(r.example_id)
    assert sorted(got) == sorted(want)


def test_unblocked_choice_shares_no_key(spark):
    d = candidates(spark).withColumn("stratum", F.lit("all"))
    out = selection.choose_unblocked(d, ["k"], 8, d.filter("k = 0"), "stratum").collect()
    for field in ("example_id", "group_id", "source_record_id"):
        values = [r[field] for r in out]
        assert len(values) == len(set(values)) == 8
    ids = {r.example_id for r in out}
    assert not any(r.parent_example_id in ids for r in out) and "e0" not in ids


def test_round_robin_takes_no_group_twice(spark):
    out = selection.round_robin_unique(candidates(spark), "fingerprint", "group_id", "example_id", 9).collect()
    assert len({r.group_id for r in out}) == len(out) == 9


def test_unrelated_keeps_rows_without_parent(spark):
    d = candidates(spark)
    left = {r.example_id for r in joins.unrelated(d, d.filter("k = 0")).collect()}
    assert "e0" not in left and "e1" not in left and "e20" not in left and "e31" not in left and "e2" in left


def test_places_are_a_total_order(spark):
    d = joins.with_place(spark.range(500), F.sha2(F.col("id").cast("string"), 256), "place")
    assert sorted(r.place for r in d.collect()) == list(range(500))


def test_apportionment_meets_the_total(spark):
    d = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "l string, n int")
    assert sorted((r.l, r.quota) for r in windows.apportion(d, "l", "n", 10).collect()) == [("a", 4), ("b", 3), ("c", 3)]


def test_decisions_only_spend_what_is_approved(spark):
    rows = [("m", k, k, "evaluate", a, 900, 5) for k, a in enumerate([500, 500, 300])]
    d = spark.createDataFrame(rows, "mandate string, ts int, event_id bigint, kind string, amount bigint, budget bigint, max_fulfillments int")
    assert [(r.outcome, r.spent) for r in stateful.fold_decisions(d).orderBy("event_id").collect()] == [("APPROVE", 500), ("HOLD", 500), ("APPROVE", 800)]
    assert stateful.fold_decisions(d.limit(0)).count() == 0


def test_review_flow(spark):
    r = spark.createDataFrame([(1, "e1", "a", "MATCH", "APPROVE", 0.9), (2, "e1", "b", "MATCH", "APPROVE", 0.7), (3, "e2", "a", "MATCH", "APPROVE", 1.0), (4, "e2", "b", "VIOLATION", "HOLD", 1.0), (5, "e1", "a", "VIOLATION", "HOLD", 1.0)], "event_id bigint, example_id string, reviewer_id string, deviation string, expected_treatment string, confidence double").withColumn("created_at", F.col("event_id"))
    none = spark.createDataFrame([], "example_id string, deviation string, expected_treatment string, confidence double")
    ok = reviews.accepted(r)
    out = {x.example_id: x.state for x in aggregates.resolve_reviews(ok, none).collect()}
    assert out == {"e1": "resolved", "e2": "unresolved"}
    state = reviews.queue_state(spark.createDataFrame([("e1",), ("e2",), ("e3",)], "example_id string"), ok, none)
    assert {x.example_id: x.state for x in state.collect()} == {"e1": "agreed", "e2": "needs_adjudication", "e3": "unreviewed"}
    assert reviews.next_item(state, ok, "a").first().example_id == "e3"


def test_unknown_keys_and_required_columns(spark):
    d = files.with_unknown_keys(spark.createDataFrame([('{"a":1,"b":2}',), (None,)], "j string"), "j", ["a"])
    assert [x.unknown_keys for x in d.collect()] == [["b"], []]
    with pytest.raises(ValueError, match="missing required columns: z"):
        files.require(d, ["j", "z"])


def test_json_lines_keep_line_separators(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":"one line"}\n\n{"a":"two"}\n', encoding="utf-8")
    assert sorted(r.a for r in files.read_lines(spark, str(tmp_path), "a string").collect() if r.a) == ["one line", "two"]


def test_writes_refuse_to_overwrite(spark, tmp_path):
    d = spark.createDataFrame([("b",), ("a",)], "example_id string")
    files.write_sorted(d, str(tmp_path / "o"))
    with pytest.raises(Exception, match="exist"):
        files.write_sorted(d, str(tmp_path / "o"))
    assert files.write_once(d, str(tmp_path / "p")) == "written" and files.write_once(d, str(tmp_path / "p")) == "skipped"


def test_checksums_of_all_tables(spark):
    import hashlib
    from pathlib import Path

    from veritill.plans import registry

    got = {r.name: (r.length, r.sha256) for r in registry.QUERIES["v1_checksums"](spark, "/root/testdata/sf0.001").collect()}
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path("/root/testdata/sf0.001").glob("*.parquet") if p.name in got}
    assert len(want) == 14 and {k: v for k, (_, v) in got.items() if k != "."} == want
    assert got["."][1] == hashlib.sha256("".join(f"{k} {v}\n" for k, v in sorted(want.items())).encode()).hexdigest()


def test_picks_from_heads_equal_one_pass(spark):
    """Groups and sources that repeat so much that heads have to grow."""
    import random

    from veritill.operators import selection

    r = random.Random(4)
    rows = [(f"e{k:03}", f"g{r.randrange(40)}", f"s{r.randrange(50)}", f"f{r.randrange(3)}", f"e{r.randrange(300):03}" if k % 3 == 0 else None, "ab"[k % 2]) for k in range(300)]
    df = spark.createDataFrame(rows, "example_id string, group_id string, source_record_id string, fingerprint string, parent_example_id string, stratum string")
    for n in (3, 8, 60):
        want = set()
        for s in "ab":
            seen, count, picked = (set(), set()), {}, []
            for capped in (True, False):
                for e, g, c, f, _, own in rows:
                    if own != s or len(picked) >= n or g in seen[0] or c in seen[1] or capped and count.get(f, 0) >= 2:
                        continue
                    seen[0].add(g), seen[1].add(c), picked.append(e)
                    count[f] = count.get(f, 0) + 1
            want |= set(picked)
        got = selection.diverse_take(df, ["example_id"], n, by="stratum", growth=2)
        assert {x.example_id for x in got.collect()} == want
    with pytest.raises(ValueError, match="fewer"):
        selection.diverse_take(df, ["example_id"], 299, by="stratum", exact=True)
    with pytest.raises(ValueError, match="unique"):
        selection.diverse_take_unique(df, ["example_id"], 5)


def test_places_and_totals_against_plain_sorting(spark):
    import random

    from pyspark.sql import functions as F

    from veritill.operators import ordered

    r = random.Random(9)
    rows = [(k, r.choice(["x", "y", None]), r.random() if k % 3 else 0.5, f"name {r.randrange(10**6)}-{k}") for k in range(700)]
    df = spark.createDataFrame(rows, "k bigint, g string, v double, name string")
    groups = {g: [x for x in rows if x[1] == g] for g in ("x", "y", None)}
    named = {x.k: x.place for x in ordered.named_places(df, "name", ["g"], "place").collect()}
    assert named == {x[0]: n for own in groups.values() for n, x in enumerate(sorted(own, key=lambda x: x[3]), 1)}
    import hashlib

    digest = lambda x: hashlib.sha256(str(x[0]).encode()).hexdigest()
    scored = {x.k: x.place for x in ordered.scored_places(df, "v", F.sha2(F.col("k").cast("string"), 256), "k", ["g"], "place").collect()}
    assert scored == {x[0]: n for own in groups.values() for n, x in enumerate(sorted(own, key=lambda x: (x[2], digest(x))), 1)}
    single = df.filter("v <> 0.5")
    total = {x.k: x.t for x in ordered.running_totals(single, "v", {"t": "k"}, ("g",), descending=True).collect()}
    assert total == {x[0]: sum(y[0] for y in own if y[2] >= x[2] and y[2] != 0.5) for own in groups.values() for x in own if x[2] != 0.5}


def test_running_totals_work_their_frame_out_once(spark):
    from pyspark.sql import functions as F

    from veritill.operators import ordered

    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    d = spark.range(200).select(F.udf(look, "double")(F.col("id").cast("double")).alias("v"), F.lit(1).alias("n"))
    assert {r.v: r.upto for r in ordered.running_totals(d, "v", {"upto": "n"}).collect()} == {float(k): k + 1 for k in range(200)}
    assert seen.value == 200


def test_gates_read_the_tables_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veritill.plans.registry import queries_contracts

    small, seen, predicted = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), queries_contracts.predicted

    def look(v):
        seen.add(1)
        return v

    # a UDF that isn't deterministic is neither pruned nor moved
    counted = F.udf(look, "string").asNondeterministic()
    monkeypatch.setattr(queries_contracts, "predicted", lambda s, d: predicted(s, d).withColumn("split", counted("split")))
    assert len(queries_contracts.k2_development_gate(spark, small).collect()) == 4
    assert seen.value == spark.read.parquet(f"{small}/orders.parquet").count()


def test_broken_contracts_fail(spark):
    from veritill.operators import contracts

    bad = spark.createDataFrame([("train", "MAYBE", 1)], "split string, expected_treatment string, label int")
    with pytest.raises(Exception, match="no such treatment"):
        contracts.target_rows(bad, "train", "policy_intervention").collect()
    with pytest.raises(ValueError, match="no such target"):
        contracts.target_rows(bad, "train", "other")
    with pytest.raises(Exception, match="elements instead of one"):
        contracts.with_only(spark.createDataFrame([(["a", "b"],)], "x array<string>"), "x", "y").collect()
    original = spark.createDataFrame([("a", 2, "old"), ("b", 1, "old")], "id string, place int, verdict string")
    again = spark.createDataFrame([("a", "new")], "id string, verdict string")
    assert [(r.id, r.verdict, r.retried) for r in contracts.retry_overlay(original, again, "id", "place", ["verdict"]).collect()] == [("b", "old", False), ("a", "new", True)]
    with pytest.raises(Exception, match="a retry of nothing"):
        contracts.retry_overlay(original, spark.createDataFrame([("z", "new")], "id string, verdict string"), "id", "place", ["verdict"]).collect()
    with pytest.raises(Exception, match="two folds hold"):
        contracts.out_of_fold_union([original, original.limit(1)], "id").collect()
    with pytest.raises(Exception, match="mean isn't 1"):
        contracts.weight_table(spark.createDataFrame([("a", "c", 2.0)], "example_id string, constraint_id string, w double"), "w").collect()
    with pytest.raises(ValueError, match="lacks the classes"):
        contracts.canonical_order(F.col("x"), ["neutral", "entailment"])
    with pytest.raises(Exception, match="can't be shared"):
        contracts.shares(spark.createDataFrame([(25,)], "size int"), "size", {"a": 50}).collect()


def test_gates_by_hand(spark):
    from veritill.operators import contracts

    row = {"violation_recall": 0.9, "false_step_up_rate": 0.1, "false_decline_rate": 0.02, "ece": 0.08, "family_recall": 0.8, "reviewed_none_recall": 0.8, "pr_auc": 0.7, "baseline_pr_auc": 0.705}
    d = spark.createDataFrame([("edge", *row.values()), ("low", *(row | {"family_recall": 0.79}).values()), ("null", *(row | {"ece": None}).values())], "name string, " + ", ".join(f"{k} double" for k in row))
    assert {r.name: r.all_passed for r in contracts.development_gate(d, ["name"]).collect()} == {"edge": True, "low": False, "null": False}
    none = spark.createDataFrame([], "name string, eligible boolean, violation_recall double, false_step_up_rate double, false_decline_rate double, g string")
    assert contracts.choose_candidate(none, ["g"]).count() == 0
    families = spark.createDataFrame([("a", 60, 0.5), ("b", 10, 0.1)], "family string, violation_rows int, violation_recall double")
    assert tuple(contracts.worst_family(families, 50, 1.0).first()) == (0.5, 1) and contracts.worst_family(families, 100, 1.0).first().family_recall == 1.0


def test_an_error_inside_the_subpackage_is_not_hidden(tmp_path):
    """The entry tells a subpackage that isn't there from one that is broken."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    for name in ("veritill", "__spark_entry__.py"):
        (shutil.copytree if (top / name).is_dir() else shutil.copy)(top / name, tmp_path / name)
    shutil.rmtree(tmp_path / "veritill" / "llm", ignore_errors=True)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert int(run().stdout) > 150
    (tmp_path / "veritill" / "llm").mkdir()
    for name in ("veritill/llm/__init__.py", "veritill/llm/queries.py", "corpus_pipeline.py"):
        (tmp_path / name).write_text("import nowhere\n" if name.endswith("queries.py") else "")
    assert "nowhere" in run().stderr
