"""Evaluation: calibration, ranking and policy metrics, threshold selection and gates.

Everything that needs an order first shrinks to one row per distinct score; running sums over those go in two
steps (see ordered), so that continuous scores don't meet in one task. Grids multiply cells of equal rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritill.functions.scalars import CLASSES, ratio, top_class
from veritill.operators.ordered import exact_percentiles, joined_on, running_totals
from veritill.operators.rules import offline_policy

DISABLED = math.nextafter(1.0, math.inf)


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error over bins [k/bins, (k+1)/bins), the last one closed."""
    s = F.col(score)
    which = F.lit(bins - 1)
    for k in range(bins - 2, -1, -1):
        which = F.when(s < (k + 1) / bins, k).otherwise(which)
    parts = df.groupBy(*by, which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("y"), F.sum(score).alias("p"))
    error = F.sum(F.abs(F.col("y") / F.col("n") - F.col("p") / F.col("n")) * F.col("n")) / F.sum("n")
    return parts.groupBy(*by).agg(error.alias("ece"), F.sum("n").alias("rows"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def by_score(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(label).alias("positives"), F.count(F.lit(1)).alias("n"))


def average_precision(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Step-wise area under precision and recall: ties enter together."""
    d = running_totals(by_score(df, label, score, by), "score", {"tp": "positives", "seen": "n"}, by, descending=True)
    return d.groupBy(*by).agg(ratio(F.sum(F.col("positives") * F.col("tp") / F.col("seen")), F.sum("positives").cast("double")).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by mid-ranks."""
    d = running_totals(by_score(df, label, score, by), "score", {"seen": "n"}, by)
    rank = F.col("seen") - F.col("n") + (F.col("n") + 1) / 2
    g = d.groupBy(*by).agg(F.sum(F.col("positives") * rank).alias("ranks"), F.sum("positives").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return g.select(*by, ratio(F.col("ranks") - p * (p + 1) / 2, p * q).alias("roc_auc"))


def treatment_counts(expected: Column, predicted: Column) -> list[Column]:
    """Aggregates that all treatment metrics are made of."""
    legit, n = expected == "APPROVE", lambda c: F.count(F.when(c, 1))
    return [
        F.count(F.lit(1)).alias("rows"), n(~legit).alias("violation_rows"), n(legit).alias("legitimate_rows"), n(expected == predicted).alias("correct"), n(legit & (predicted == "STEP_UP")).alias("false_step_up_count"),
        n(legit & (predicted == "HOLD")).alias("false_decline_count"), n(~legit & (predicted != "APPROVE")).alias("recalled"), n(predicted != "APPROVE").alias("interventions"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    r = lambda a, b: ratio(F.col(a).cast("double"), F.col(b))
    return df.withColumns(
        {
            "treatment_accuracy": r("correct", "rows"), "violation_recall": r("recalled", "violation_rows"), "false_step_up_rate": r("false_step_up_count", "legitimate_rows"), "false_decline_rate": r("false_decline_count", "legitimate_rows"),
            "intervention_precision": r("recalled", "interventions"), "intervention_rate": r("interventions", "rows"),
        }
    )


def treatment_metrics(df: DataFrame, expected: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates over all rows or per cohort."""
    return with_rates(df.groupBy(*by).agg(*treatment_counts(F.col(expected), F.col(predicted))))


def class_metrics(df: DataFrame, label: str) -> DataFrame:
    """Accuracy, macro F1 and log loss of the three class scores."""
    c, n, e = (F.col(k) for k in CLASSES)
    d = df.withColumns({"_top": top_class(c, n, e), "_own": F.when(F.col(label) == CLASSES[0], c).when(F.col(label) == CLASSES[1], n).otherwise(e)})
    aggs = [F.avg((F.col("_top") == F.col(label)).cast("double")).alias("accuracy"), F.avg(-F.ln(F.greatest(F.col("_own"), F.lit(1e-15)))).alias("log_loss")]
    for k in CLASSES:
        hit, said, there = (F.count(F.when(x, 1)) for x in ((F.col("_top") == k) & (F.col(label) == k), F.col("_top") == k, F.col(label) == k))
        aggs += [ratio(hit.cast("double"), there).alias(f"recall_{k}"), ratio(2.0 * hit, said + there).alias(f"f1_{k}")]
    out = d.agg(*aggs)
    return out.withColumn("macro_f1", sum((F.col(f"f1_{k}") for k in CLASSES[1:]), F.col(f"f1_{CLASSES[0]}")) / 3)


def operating_point(df: DataFrame, label: str, score: str, most_false: float) -> DataFrame:
    """The threshold of greatest recall whose false positive rate stays within bounds; infinity takes nothing."""
    scores = by_score(df, label, score)
    d = running_totals(scores, "score", {"tp": "positives", "seen": "n"}, descending=True)
    d = joined_on(d, scores.agg(F.sum("positives").alias("p"), F.sum("n").alias("all")), ())
    none = d.groupBy().agg(F.lit(float("inf")).alias("score"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.max("p").alias("p"), F.max("all").alias("all"))
    some = d.select("score", "tp", (F.col("seen") - F.col("tp")).alias("fp"), "p", "all")
    both = some.union(none.select("score", "tp", "fp", "p", "all")).withColumns({"recall": ratio(F.col("tp").cast("double"), F.col("p")), "fpr": ratio(F.col("fp").cast("double"), F.col("all") - F.col("p")), "precision": ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))})
    return both.filter(F.col("fpr") <= most_false).orderBy(F.col("recall").desc(), F.col("score").desc()).limit(1).select(F.col("score").alias("threshold"), "tp", "fp", "recall", "fpr", "precision")


def threshold_curve(df: DataFrame, expected: str, score: str, contradiction_at: Column, neutral_at: Column, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Per candidate threshold: false step-ups, recalled violations and the totals under the whole policy.

    Rows that rules or semantics decide give a constant; the others enter with their score. weight: rows that each
    row stands for.
    """
    fixed = offline_policy(F.lit(0.0), F.lit(1.0), contradiction_at, neutral_at)
    legit = F.col(expected) == "APPROVE"
    many = F.col(weight) if weight else F.lit(1)
    n = lambda c: F.coalesce(F.sum(F.when(c, many)), F.lit(0))
    free = F.col("_fixed") == "APPROVE"
    d = df.withColumn("_fixed", fixed)
    g = d.groupBy(*by, F.col(score).alias("threshold")).agg(
        n(free & legit).alias("free_legit"), n(free & ~legit).alias("free_bad"), n(legit).alias("legit"), n(~legit).alias("bad"),
        n((F.col("_fixed") == "STEP_UP") & legit).alias("fixed_false"), n(~free & ~legit).alias("fixed_hit"), n((F.col("_fixed") == "HOLD") & legit).alias("declined"), F.sum(many).alias("rows"),
    )
    totals = g.groupBy(*by).agg(*(F.sum(k).alias(f"{k}_all") for k in ("legit", "bad", "fixed_false", "fixed_hit", "declined", "rows")))
    run = joined_on(running_totals(g, "threshold", {"stepped": "free_legit", "found": "free_bad"}, by, descending=True), totals, by)
    run = run.withColumns({"false_step_up_count": F.col("fixed_false_all") + F.col("stepped"), "recalled": F.col("fixed_hit_all") + F.col("found")})
    off = totals.withColumns({"threshold": F.lit(DISABLED), "false_step_up_count": F.col("fixed_false_all"), "recalled": F.col("fixed_hit_all")})
    names = [*by, "threshold", "false_step_up_count", "recalled", *(c for c in totals.columns if c not in by)]
    return run.select(*names).union(off.select(*names))


def select_threshold(curve: DataFrame, target: float = 0.10, by: tuple[str, ...] = ()) -> DataFrame:
    """The best threshold of each curve within the budget of false step-ups: recall, then fewer of them, then the higher one."""
    budget = F.floor(F.col("legit_all") * target)
    recall = ratio(F.col("recalled").cast("double"), F.col("bad_all"))
    d = curve.withColumns({"budget": budget, "violation_recall": recall}).filter(F.col("false_step_up_count") <= F.col("budget"))
    rank = F.struct("violation_recall", -F.col("false_step_up_count"), "threshold")
    best = d.groupBy(*by).agg(F.max_by(F.struct("threshold", "violation_recall", "false_step_up_count", "budget", "fixed_false_all", "legit_all", "bad_all", "rows_all"), rank).alias("b"), F.count(F.lit(1)).alias("feasible"))
    return best.select(*by, "b.*")


def grid(df: DataFrame, contradictions: tuple[float | None, ...], neutrals: tuple[float | None, ...]) -> DataFrame:
    """Rows times a small fixed grid of override thresholds, exploded from a literal, without a join."""
    points = F.array(*(F.struct(F.lit(c).cast("double").alias("contradiction_at"), F.lit(n).cast("double").alias("neutral_at")) for c in contradictions for n in neutrals))
    return df.select("*", F.explode(points).alias("_g")).select("*", "_g.contradiction_at", "_g.neutral_at").drop("_g")


def on_grid(value: Column, limits: tuple[float | None, ...]) -> Column:
    """The highest of the limits that a value reaches, -1 below all: what it decides against any of them is the same."""
    out = F.lit(-1.0)
    for limit in sorted(x for x in limits if x is not None):
        out = F.when(value >= limit, limit).otherwise(out)
    return out


def cells(df: DataFrame, columns: list[str], contradictions: tuple[float | None, ...], neutrals: tuple[float | None, ...]) -> DataFrame:
    """Rows that no setting tells apart, counted once (`weight`): the columns, and the policy's inputs brought to the grid."""
    d = df.withColumns(
        {
            "semantic_contradiction": on_grid(F.col("semantic_contradiction"), contradictions), "semantic_neutral": on_grid(F.col("semantic_neutral"), neutrals),
            "hard_fail_count": F.least("hard_fail_count", F.lit(1)), "critical_hold_count": F.least("critical_hold_count", F.lit(1)),
        }
    )
    return d.groupBy(*columns, "semantic_contradiction", "semantic_neutral", "hard_fail_count", "critical_hold_count").agg(F.count(F.lit(1)).alias("weight"))


def select_configuration(df: DataFrame, expected: str, score: str, contradictions: tuple[float | None, ...] = (None, 0.95, 0.9, 0.85, 0.8), neutrals: tuple[float | None, ...] = (None, 0.9, 0.8, 0.7, 0.6), target: float = 0.10) -> DataFrame:
    """The best threshold over all override settings; ties prefer the override that is off, then the higher one."""
    key = ("contradiction_at", "neutral_at")
    off = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    slim = cells(df, [expected, score], contradictions, neutrals)
    curve = threshold_curve(grid(slim, contradictions, neutrals), expected, score, off(key[0]), off(key[1]), key, "weight")
    every = select_threshold(curve, target, key)
    rank = F.struct("violation_recall", -F.col("false_step_up_count"), "threshold", F.col(key[0]).isNull(), F.col(key[1]).isNull(), off(key[0]), off(key[1]))
    return every.agg(F.max_by(F.struct(*every.columns), rank).alias("b"), F.count(F.lit(1)).alias("configurations")).select("b.*", "configurations")


def temperature_grid(df: DataFrame, logits: str, label: str, low: float = 0.5, high: float = 3.0, step: float = 0.05) -> DataFrame:
    """(temperature, loss): mean negative log likelihood for each temperature of a fixed grid, one sum each over one pass of the rows."""
    count = round((high - low) / step) + 1
    temps = [round(low + step * k, 10) for k in range(count)]
    x = F.col(logits)
    top = F.array_max(x)

    def loss(t: float) -> Column:
        log_sum = top / t + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp((v - top) / t)))
        return log_sum - F.get(x, F.col(label)) / t

    d = df.select(F.array(*(loss(t) for t in temps)).alias("losses"))
    sums = d.agg(*(F.avg(F.col("losses")[k]).alias(f"t{k}") for k in range(count)))
    rows = F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(f"t{k}").alias("loss")) for k, t in enumerate(temps)))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def best_temperature(df: DataFrame, logits: str, label: str) -> DataFrame:
    g = temperature_grid(df, logits, label)
    return g.agg(F.min(F.struct("loss", "temperature")).alias("b")).select("b.temperature", "b.loss")


def percentiles(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact p50 and p95 by linear interpolation, and the largest."""
    p = exact_percentiles(df, column, [0.5, 0.95], by)
    return joined_on(p, df.groupBy(*by).agg(F.max(column).alias("max")), by).select(*by, F.col("p0").alias("p50"), F.col("p1").alias("p95"), "max")


def sensitivity(df: DataFrame, before: str, after: str, threshold: float) -> DataFrame:
    """How a second scoring moves the first: mean, p95 and largest absolute change, and the share of flipped decisions."""
    delta = F.abs(F.col(after) - F.col(before))
    flip = ((F.col(before) >= threshold) != (F.col(after) >= threshold)).cast("double")
    d = df.select(delta.alias("delta"), flip.alias("flip"))
    one = d.agg(F.avg("delta").alias("mean_delta"), F.max("delta").alias("max_delta"), F.avg("flip").alias("flip_rate"))
    return joined_on(one, exact_percentiles(d, "delta", [0.95]), ()).select("mean_delta", F.col("p0").alias("p95_delta"), "max_delta", "flip_rate")


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, limit, passed) per metric of a one-row frame; directions are `min` and `max`."""
    rows = F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit"), ((F.col(k) >= v) if d == "min" else (F.col(k) <= v)).alias("passed")) for k, (d, v) in limits.items()))
    return metrics.select(F.explode(rows).alias("g")).select("g.*")


def family_gate(families: DataFrame, family: str, least_rows: int, recall: float) -> DataFrame:
    """Whether every family with enough violations reaches the recall, and how many there are."""
    supported = F.col("violation_rows") >= least_rows
    return families.agg(F.count(F.when(supported, 1)).alias("supported"), F.coalesce(F.min(F.when(supported, F.col("violation_recall"))), F.lit(0.0)).alias("worst_recall")).withColumn("passed", (F.col("supported") > 0) & (F.col("worst_recall") >= recall))


def include_challenger(df: DataFrame, lift: float = 0.005, latency_ms: float = 2000.0) -> DataFrame:
    """A challenger joins if it lifts enough, calibrates no worse and stays within the latency budget."""
    lifted, calibrated, fast = F.col("challenger_pr_auc") - F.col("champion_pr_auc") >= lift, F.col("challenger_ece") <= F.col("champion_ece"), F.col("latency_p95_ms") <= latency_ms
    return df.withColumns({"lifted": lifted, "calibrated": calibrated, "fast": fast, "include": lifted & calibrated & fast})


#: The published grid of the routing diagnosis (fixed values): score steps, and override limits with none first.
ORACLE_STEPS = 200
ORACLE_LIMITS = (None, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)


def score_step(score: Column, steps: int = ORACLE_STEPS) -> Column:
    """The highest k of k / steps that a score reaches, -1 below 0."""
    k = F.floor(score * steps)
    k = F.when((k + 1) / steps <= score, k + 1).when(k / steps > score, k - 1).otherwise(k)
    return F.greatest(F.least(k, F.lit(steps)), F.lit(-1)).cast("int")


def policy_oracle(df: DataFrame, expected: str, score: str, reviewed: Column, most_false: float = 0.10, least_recall: float = 0.90) -> DataFrame:
    """The best of a fixed grid of score, contradiction and neutral limits on rows that were looked at already; no row if none is within bounds.

    Best is the recall of reviewed violations, then that of all, then fewer false step-ups, then the higher score
    limit, then the lower override limits, none being the lowest. Rows become at most steps x limits x limits cells
    before the grid, so what the grid multiplies doesn't grow with them.
    """
    d = df.select(F.greatest(score_step(F.col(score)), F.lit(-1)).alias("step"), (F.col(expected) == "APPROVE").alias("legit"), reviewed.alias("reviewed"), "semantic_contradiction", "semantic_neutral", "hard_fail_count", "critical_hold_count")
    slim = cells(d, ["step", "legit", "reviewed"], ORACLE_LIMITS, ORACLE_LIMITS)
    every = grid(slim, ORACLE_LIMITS, ORACLE_LIMITS)
    off = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    fixed = offline_policy(F.lit(0.0), F.lit(1.0), off("contradiction_at"), off("neutral_at")) != "APPROVE"
    # a fixed row is stopped at every score limit
    at = F.when(fixed, ORACLE_STEPS).otherwise(F.col("step"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    legit, seen = F.col("legit"), F.col("reviewed")
    key = ("contradiction_at", "neutral_at")
    by_step = every.groupBy(*key, at.alias("step")).agg(n(legit).alias("legit"), n(~legit).alias("bad"), n(~legit & seen).alias("seen"))
    # every score limit takes the steps from it upwards: 201 limits per pair, whatever the rows
    limits = every.select(*key).distinct().withColumn("limit", F.explode(F.sequence(F.lit(0), F.lit(ORACLE_STEPS))))
    sums = joined_on(limits, by_step, key).groupBy(*key, "limit").agg(*(F.sum(F.when(F.col("step") >= F.col("limit"), F.col(c)).otherwise(0)).alias(c) for c in ("legit", "bad", "seen")))
    total = slim.agg(n(legit).alias("_legit"), n(~legit).alias("_bad"), n(~legit & seen).alias("_seen"))
    r = joined_on(sums, total, ()).select(
        (F.col("limit") / ORACLE_STEPS).alias("score_threshold"), *key, (F.col("seen") / F.col("_seen")).alias("semantic_recall"), (F.col("bad") / F.col("_bad")).alias("operational_recall"), (F.col("legit") / F.col("_legit")).alias("false_step_up_rate")
    )
    low = lambda c: -F.coalesce(F.col(c), F.lit(-1.0))
    rank = F.struct("semantic_recall", "operational_recall", -F.col("false_step_up_rate"), "score_threshold", low(key[0]), low(key[1]))
    fit = r.filter((F.col("false_step_up_rate") <= most_false) & (F.col("operational_recall") >= least_recall))
    return fit.agg(F.max_by(F.struct(*r.columns), rank).alias("b"), F.count(F.lit(1)).alias("feasible")).filter("feasible > 0").select("b.*", "feasible")
