"""Boundary tables of the commercial rules and the treatment contract."""

import pytest
from pyspark.sql import functions as F

from veritill.operators import features, rules
from veritill.sources.views import CONSTRAINT

EXAMPLE = f"""example_id string, constraints array<{CONSTRAINT}>, max_fulfillments int, items array<struct<description:string,attributes:map<string,string>,amount_minor:bigint,quantity:int>>, currency string, total_amount_minor bigint,
merchant_id string, merchant_category string, fulfilled_amount_minor bigint, fulfillment_count int"""


def budget(amount, currency="USD"):
    return ("c1", "total_budget", None, None, amount, currency)


def example(spark, constraints, total=9000, fulfilled=0, count=0, most=2, items=None, currency="USD", merchant="m1", category="retail"):
    items = items or [("waterproof jacket", {}, total, 1)]
    return spark.createDataFrame([("e", constraints, most, items, currency, total, merchant, category, fulfilled, count)], EXAMPLE)


def signals(df):
    return rules.with_signals(df).select("signals", rules.signal_treatment(F.col("signals")).alias("t")).first()


@pytest.mark.parametrize("total,fulfilled,failures,critical", [(9000, 0, 0, 0), (10000, 0, 0, 0), (10001, 0, 2, 0), (9000, 1001, 1, 1)])
def test_budget_boundaries(spark, total, fulfilled, failures, critical):
    r = signals(example(spark, [budget(10000)], total, fulfilled))
    fails = [s for s in r.signals if s.status == "FAIL"]
    assert (len(fails), sum(s.severity == "critical" for s in fails)) == (failures, critical)
    assert r.t == ("HOLD" if critical else "STEP_UP" if failures else "APPROVE")


def test_fulfilment_limit_is_last(spark):
    r = signals(example(spark, [budget(10000)], count=2))
    assert r.signals[-1].rule_id == "fulfillment_limit" and r.signals[-1].reason == "FULFILLMENT_LIMIT_EXCEEDED" and r.t == "HOLD"


def test_currency_mismatch_skips_budgets(spark):
    r = signals(example(spark, [budget(1, "EUR")]))
    assert [s.rule_id for s in r.signals] == ["currency_match", "fulfillment_limit"] and r.t == "STEP_UP"


def test_prohibitions_and_merchants(spark):
    c = [("p", "prohibited_item", ["JACK"], None, None, None), ("k", "prohibited_category", ["Retail"], None, None, None), ("a", "allowed_merchant", ["M1"], None, None, None)]
    r = signals(example(spark, c))
    assert [s.status for s in r.signals] == ["FAIL", "FAIL", "FAIL", "PASS"] and r.t == "HOLD"
    assert [s.reason for s in r.signals][2] == "MERCHANT_NOT_AUTHORIZED"


@pytest.mark.parametrize("attributes,status", [({"origin": "sin", "destination": "tyo"}, "PASS"), ({"origin": "sin"}, "NOT_EVALUABLE"), ({"origin": "sin", "destination": "lon"}, "FAIL")])
def test_route_reads_the_first_item(spark, attributes, status):
    c = [("r", "route", None, {"origin": "SIN", "destination": "TYO"}, None, None)]
    r = signals(example(spark, c, items=[("flight", attributes, 9000, 1), ("bag", {"origin": "x", "destination": "y"}, 0, 1)]))
    assert r.signals[0].status == status


def test_null_terms_prohibit_nothing(spark):
    r = signals(example(spark, [("p", "prohibited_item", None, None, None, None)]))
    assert r.signals[0].status == "PASS"


@pytest.mark.parametrize("p,threshold,c,n,want", [(0.2, 0.7, [0.1], [0.1], "APPROVE"), (0.8, 0.7, [0.1], [0.1], "STEP_UP"), (0.2, 0.7, [0.9], [0.0], "STEP_UP"), (0.2, 0.7, [0.0], [0.7], "STEP_UP"), (None, None, [], [], "APPROVE")])
def test_online_policy(spark, p, threshold, c, n, want):
    d = rules.with_signals(example(spark, [budget(10000)]))
    num = lambda xs: F.array(*map(F.lit, xs)).cast("array<double>")
    out = d.select(rules.online_policy(F.col("signals"), num(c), num(n), F.lit(p).cast("double"), threshold).alias("o")).first().o
    assert out.treatment == want
    if want == "STEP_UP":
        assert out.probability >= 0.55 and out.band == "moderate"


def test_hold_has_fixed_probability(spark):
    d = rules.with_signals(example(spark, [budget(10000)], count=5))
    out = d.select(rules.online_policy(F.col("signals"), F.array().cast("array<double>"), F.array().cast("array<double>"), F.lit(0.99), 0.5).alias("o")).first().o
    assert (out.treatment, out.probability, out.band, out.reason_codes) == ("HOLD", 0.99, "high", ["FULFILLMENT_LIMIT_EXCEEDED"])


def test_profiles_are_contracts():
    assert features.profile_of(list(features.V2)) == "full-v2"
    with pytest.raises(ValueError):
        features.profile_of(["amount_ratio"])


def test_bad_semantic_probabilities_fail(spark):
    d = spark.createDataFrame([(0.5, 0.6, 0.1)], "semantic_contradiction double, semantic_neutral double, semantic_entailment double")
    with pytest.raises(Exception, match="sum to one"):
        features.semantic_values(d).select("semantic_entropy", "semantic_contradiction_entailment_margin").collect()


def test_signals_are_worked_out_once(spark):
    from veritill.plans import registry
    from veritill.sources import views

    small = "/root/testdata/sf0.001"
    plan = registry.QUERIES["r1_commercial_signals"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("fulfillment_limit") == 1 and "size(" not in "".join(x for x in plan.splitlines() if "Filter" in x)
    every, read = (rules.with_signals(views.examples(spark, small, for_rules=x), shown=not x) for x in (False, True))
    strip = F.transform("signals", lambda s: s.dropFields("observed", "expected"))
    assert every.select("example_id", strip).exceptAll(read.select("example_id", strip)).count() == 0
    assert read.filter(F.exists("signals", lambda s: s["observed"].isNotNull() | s["expected"].isNotNull())).count() == 0


def test_counterfactuals_leave_out_changes_that_arent_asked_for(spark):
    from veritill.operators import transforms
    from veritill.sources import views

    parents = views.examples(spark, "/root/testdata/sf0.001").filter("order_key % 20 = 0")
    children, few = transforms.counterfactuals(parents), transforms.counterfactuals(parents, changes=("total_amount_minor",))
    assert "items" not in few.columns and "fulfilled_amount_minor" not in few.columns
    assert few.select("example_id", "total_amount_minor").exceptAll(children.select("example_id", "total_amount_minor")).count() == 0 and few.count() == children.count()
