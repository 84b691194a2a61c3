"""Feature rows and the versioned feature vectors that training and serving share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritill.functions.scalars import entropy
from veritill.operators.rules import failed

#: The order of the vector is part of its contract (fixed values).
NUMERIC = (
    "amount_ratio", "amount_delta_ratio", "cumulative_utilization", "fulfillment_utilization", "line_item_count", "missing_evidence_count",
    "semantic_contradiction", "semantic_neutral", "hard_fail_count", "soft_warning_count", "currency_mismatch", "category_mismatch",
)
CATEGORICAL = ("domain", "merchant_category", "evidence_sufficiency")
SEMANTIC = ("semantic_entailment", "semantic_risk", "semantic_entropy", "semantic_top2_margin", "semantic_contradiction_entailment_margin")
V2, V3 = (*NUMERIC, *CATEGORICAL), (*NUMERIC, *SEMANTIC, *CATEGORICAL)
PROFILES = {
    "full-v2": V2,
    "shortcut-safe-v2": tuple(n for n in V2 if n != "line_item_count"),
    "no-semantic-v2": tuple(n for n in V2 if not n.startswith("semantic_")),
    "shortcut-safe-no-semantic-v2": tuple(n for n in V2 if n != "line_item_count" and not n.startswith("semantic_")),
    "full-v3": V3,
    "shortcut-safe-v3": tuple(n for n in V3 if n != "line_item_count"),
    "no-semantic-v3": tuple(n for n in V3 if not n.startswith("semantic_")),
}


def profile(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The vector of a profile, in contract order, behind the key columns."""
    if name not in PROFILES:
        raise ValueError(f"no profile is called {name}")
    return df.select(*keys, *PROFILES[name])


def profile_of(names: list[str]) -> str:
    found = [p for p, own in PROFILES.items() if list(own) == names]
    if len(found) != 1:
        raise ValueError(f"{len(found)} profiles have these features in this order, not one")
    return found[0]


def first_budget(field: str) -> Column:
    """A field of the first total_budget constraint; later ones don't count."""
    budgets = F.filter("constraints", lambda c: c["type"] == "total_budget")
    return F.try_element_at(budgets, F.lit(1))[field]


def category_mismatch() -> Column:
    banned = F.transform(F.flatten(F.transform(F.filter("constraints", lambda c: c["type"] == "prohibited_category"), lambda c: c["value_list"])), F.upper)
    return F.array_contains(banned, F.upper("merchant_category"))


def canonical_rows(df: DataFrame, *more: Column) -> DataFrame:
    """The flat feature row of examples with signals, contradiction and neutral, and more columns of theirs."""
    missing = (F.col("evidence_sufficiency") != "sufficient").cast("int")
    fails = failed(F.col("signals"))
    return df.select(
        "example_id", "group_id", "parent_example_id", "split", "locale", "domain",
        F.coalesce(first_budget("amount_minor"), F.col("total_amount_minor")).alias("budget_minor"),
        F.col("total_amount_minor").alias("cart_amount_minor"), "fulfilled_amount_minor", "fulfillment_count", "max_fulfillments", "line_item_count",
        missing.alias("missing_evidence_count"), "semantic_contradiction", "semantic_neutral",
        F.size(fails).alias("hard_fail_count"), F.size(F.filter(fails, lambda s: s["severity"] == "critical")).alias("critical_hold_count"), missing.alias("soft_warning_count"),
        F.coalesce(first_budget("currency"), F.col("currency")).alias("currency"), F.col("currency").alias("cart_currency"), category_mismatch().alias("category_mismatch"),
        "merchant_category", "evidence_sufficiency",
        F.when(F.col("relevance") == "E", 0).when(F.col("relevance").isin("C", "I"), 1).alias("label"), F.col("attack_family"), "label_source", *more,
    )


def vector(rows: DataFrame) -> DataFrame:
    """The v2 vector's values beside the row's columns; budgets below 1 count as 1."""
    budget = F.greatest(F.col("budget_minor"), F.lit(1))
    d = lambda c: c.cast("double")
    return rows.withColumns(
        {
            "amount_ratio": F.col("cart_amount_minor") / budget,
            "amount_delta_ratio": (F.col("cart_amount_minor") - budget) / budget,
            "cumulative_utilization": (F.col("fulfilled_amount_minor") + F.col("cart_amount_minor")) / budget,
            "fulfillment_utilization": (F.col("fulfillment_count") + 1) / F.greatest(F.col("max_fulfillments"), F.lit(1)),
            "currency_mismatch": d(F.col("currency") != F.col("cart_currency")),
            "category_mismatch": d(F.col("category_mismatch")),
        }
        | {n: d(F.col(n)) for n in ("line_item_count", "missing_evidence_count", "hard_fail_count", "soft_warning_count", "semantic_contradiction", "semantic_neutral")}
    )


def semantic_values(rows: DataFrame, strict: bool = True) -> DataFrame:
    """The v3 additions; with strict, probabilities outside [0, 1] or that don't sum to one fail the query."""
    c, n, e = (F.col(f"semantic_{k}") for k in ("contradiction", "neutral", "entailment"))
    if strict:
        bad = ~(c.between(0, 1) & n.between(0, 1) & e.between(0, 1) & (F.abs(c + n + e - 1) <= 1e-5))
        c = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("semantic probabilities must be in [0, 1] and sum to one")).cast("double")).otherwise(c)
    order = F.sort_array(F.array(c, n, e), asc=False)
    return rows.withColumns({"semantic_risk": F.greatest(c, n), "semantic_entropy": entropy(c, n, e), "semantic_top2_margin": order[0] - order[1], "semantic_contradiction_entailment_margin": c - e})


def runtime_rows(df: DataFrame) -> DataFrame:
    """The same feature row from a decision's signals: missing evidence is the number of signals that can't be evaluated."""
    missing = F.size(F.filter("signals", lambda s: s["status"] == "NOT_EVALUABLE"))
    domain = F.when(F.col("merchant_category").isin("AIRLINE", "HOTEL"), "travel").when(F.col("merchant_category") == "RESTAURANT", "dining").otherwise("retail")
    rows = canonical_rows(df, missing.alias("missing"), domain.alias("runtime_domain"))
    return rows.withColumns({"missing_evidence_count": F.col("missing"), "soft_warning_count": F.col("missing"), "domain": F.col("runtime_domain"), "evidence_sufficiency": F.when(F.col("missing") > 0, "ambiguous").otherwise("sufficient")}).drop("missing", "runtime_domain")


def fused_score(tree: Column, coefficients: list[tuple[Column, float]], intercept: float, slope: float, offset: float) -> Column:
    """A tree score stacked with other columns by a logistic, then calibrated by another one on its logit."""
    from veritill.functions.scalars import logistic, logit

    z = logit(tree) * F.lit(1.0) + F.lit(intercept)
    for value, weight in coefficients:
        z = z + value * weight
    return logistic(logit(logistic(z)) * slope + offset)
