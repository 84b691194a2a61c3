"""Fitted scorers: held-out groups, storage with a manifest, rescoring, and stacked scores."""

import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veritill.operators import ml, models
from veritill.plans import registry

NUMERIC, CATEGORICAL = ["x", "lines"], ["kind"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    out = []
    for k in range(1200):
        x, lines, kind = r.random(), r.randrange(1, 8), r.choice(["a", "b", None])
        out.append((k, f"g{k % 90}", x, lines, kind, int(x + 0.1 * lines + (kind == "a") * 0.3 + r.gauss(0, 0.1) > 0.9)))
    return spark.createDataFrame(out, "id int, g string, x double, lines int, kind string, label int").withColumns({"probability": F.lit("own"), "features": F.lit(7)}).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return models.fit(rows, NUMERIC, CATEGORICAL, "g", trees=12)


def test_no_group_is_on_both_sides(rows, fitted):
    flags = models.with_validation(rows, "g").groupBy("g").agg(F.count_distinct("is_validation").alias("n"), F.first("is_validation").alias("v")).collect()
    assert all(f.n == 1 for f in flags)
    for f in flags:
        assert f.v == (int(hashlib.sha256(f"early-stop:{f.g}".encode()).hexdigest()[:8], 16) % 100 < 20)
    facts = fitted[1]
    assert facts["rows"] + facts["validation_rows"] == 1200 and facts["validation_rows"] > 0


def test_fit_stops_early(spark):
    r = random.Random(1)
    noise = spark.createDataFrame([(f"g{k % 60}", r.random(), r.randrange(2)) for k in range(600)], "g string, x double, label int")
    assert models.fit(noise, ["x"], [], "g", trees=25)[1]["trees"] < 25


def test_stored_scorer_is_bound_to_its_manifest(spark, rows, fitted, tmp_path):
    scorer, facts = fitted
    path = f"file://{tmp_path}/s"
    models.save(spark, scorer, path, facts)
    again = models.load(spark, path, NUMERIC, CATEGORICAL)
    a, b = ({r.id: r.score for r in s.score(rows).collect()} for s in (scorer, again))
    assert a == b and len(a) == 1200
    out = again.score(rows)
    assert out.columns == [*rows.columns, "score"] and out.filter("probability = 'own' and features = 7").count() == 1200
    right = out.filter((F.col("score") > 0.5) == (F.col("label") == 1)).count()
    assert right > 1000
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        models.save(spark, scorer, path, facts)
    with pytest.raises(ValueError, match="fitted on"):
        models.load(spark, path, ["lines", "x"], CATEGORICAL)
    with pytest.raises(ValueError, match="version"):
        models.load(spark, path, NUMERIC, CATEGORICAL, "trees-2")
    part = next(p for p in Path(tmp_path, "s", "model").rglob("part-*") if p.stat().st_size)
    part.with_name("part-99999-more").write_bytes(b"x")
    with pytest.raises(ValueError, match="files"):
        models.load(spark, path, NUMERIC, CATEGORICAL)


def test_rescoring_against_two_separate_scorings(rows, fitted):
    scorer, one = fitted[0], {"lines": F.lit(1)}
    before = {r.id: r.s for r in scorer.score(rows, "s").collect()}
    after = {r.id: r.s for r in scorer.score(rows.withColumn("lines", F.lit(1)), "s").collect()}
    got = scorer.rescored(rows, one)
    assert {r.id: (r.before, r.after) for r in got.collect()} == {k: (before[k], after[k]) for k in before}
    assert got.select(*rows.columns).exceptAll(rows).count() == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("InMemory", "")
    d = sorted(abs(after[k] - before[k]) for k in before)
    at = 0.95 * (len(d) - 1)
    p95 = d[int(at)] + (d[int(at) + 1] - d[int(at)]) * (at - int(at))
    r = models.perturbed(scorer, rows, one, 0.5).first()
    assert [r.mean_delta, r.p95_delta, r.max_delta, r.flip_rate] == pytest.approx([sum(d) / len(d), p95, d[-1], sum((before[k] >= 0.5) != (after[k] >= 0.5) for k in before) / len(d)])
    assert r.max_delta > 0


def test_out_of_fold_scores_never_see_their_fold(spark):
    df = ml.with_fold(spark.createDataFrame([(k, f"g{k % 40}") for k in range(200)], "id int, g string"), "g")
    seen = ml.out_of_fold(df, lambda train, rows: rows.crossJoin(train.agg(F.collect_set("g").alias("others"))))
    got = seen.collect()
    assert len(got) == 200 and all(r.g not in r.others for r in got)


def test_stacked_scores_query(spark):
    out = {r.split: r for r in registry.QUERIES["ml_stacked_scores"](spark, "/root/testdata/sf0.001").collect()}
    headers = {r.split: r.n for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("concat('grp_', o_custkey) g").selectExpr("conv(substring(sha2(concat('2026:', g), 256), 1, 8), 16, 10) % 100 b").selectExpr("case when b < 70 then 'train' when b < 80 then 'validation' when b < 90 then 'test' else 'golden' end split").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert {k: v.n for k, v in out.items()} == headers
    assert all(0 < v.mean_score < 1 for v in out.values())


@pytest.mark.parametrize("name", ["c31_stored_model", "m9_sensitivity"])
def test_model_queries(spark, name):
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and json.dumps([r.asDict() for r in rows])


def test_features_of_a_stored_model_are_computed_once(spark, monkeypatch):
    from pyspark.sql.functions import udf

    from veritill.sources import views

    seen, whole = spark.sparkContext.accumulator(0), views.feature_rows

    def counted(*args):
        def one(x):
            seen.add(1)
            return x

        d = whole(*args)
        return d.withColumn("hard_fail_count", udf(one, "int")("hard_fail_count"))

    monkeypatch.setattr(views, "feature_rows", counted)
    n = sum(r.n for r in registry.QUERIES["c31_stored_model"](spark, "/root/testdata/sf0.001").collect())
    assert 0 < n <= seen.value <= spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
