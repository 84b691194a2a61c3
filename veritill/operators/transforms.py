"""From source records to canonical rows, and from canonical rows to pairs, counterfactuals and relabelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritill.functions.hashing import hex_number, sha, stable_id
from veritill.functions.scalars import minor, worst_label
from veritill.operators import rules

GENERATOR = "counterfactual-v1"
#: Relevance letter: deviation, treatment, violation, class (fixed values).
WEAK = {"E": ("MATCH", "APPROVE", None, "ENTAILMENT"), "S": ("AMBIGUOUS", "STEP_UP", None, "NEUTRAL"), "C": ("VIOLATION", "HOLD", "SEMANTIC_MISMATCH", "CONTRADICTION"), "I": ("VIOLATION", "HOLD", "SEMANTIC_MISMATCH", "CONTRADICTION")}
#: The commercial failures that each transformation must show, and no others (fixed values).
EXPECTED_FAILURES = {"cumulative_overspend": ("CUMULATIVE_BUDGET_EXCEEDED",), "near_budget_match": (), "missing_required_evidence": (), "unrelated_add_on": ()}


def filled(*columns: Column) -> Column:
    """The parts that hold more than blanks, trimmed and joined by line ends."""
    return F.concat_ws("\n", *(F.nullif(F.trim(c), F.lit("")) for c in columns))


def synthetic_budget(example_id: Column, base: int = 5000) -> Column:
    """A budget in minor units that is fixed by the id."""
    return base + (hex_number(F.sha2(example_id, 256), 12) % 181) * 250


def budget_share(budget: Column, share: float = 0.8) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.bround(budget * share).cast("bigint"))


def weak_labels(relevance: Column) -> dict[str, Column]:
    """deviation, treatment, violation and class of a relevance letter; any other letter fails the query."""

    def at(k: int) -> Column:
        out = F.when(F.coalesce(~relevance.isin(*WEAK), F.lit(True)), F.raise_error(F.concat(F.lit("unknown relevance: "), F.coalesce(relevance, F.lit("null")))).cast("string"))
        for letter, values in WEAK.items():
            out = out.when(relevance == letter, F.lit(values[k]).cast("string"))
        return out

    return {"deviation": at(0), "expected_treatment": at(1), "violation": at(2), "semantic_label": at(3), "confidence": F.lit(0.7)}


def search_examples(df: DataFrame) -> DataFrame:
    """Joined search judgements as canonical columns."""
    example = stable_id("ex", F.col("query_id"), F.col("product_id"), F.col("product_locale"))
    budget = synthetic_budget(example)
    return df.filter((F.col("large_version") == 1) & F.col("product_locale").isin("us", "jp")).select(
        example.alias("example_id"), stable_id("grp", F.col("query_id"), F.col("product_locale")).alias("group_id"), F.trim("query").alias("objective"),
        F.when(F.col("product_locale") == "jp", "ja-JP").otherwise("en-US").alias("locale"), F.when(F.col("product_locale") == "jp", 0).otherwise(2).alias("currency_exponent"),
        filled(F.col("product_title"), F.col("product_description"), F.col("product_brand")).alias("evidence_text"), budget.alias("budget_minor"), budget_share(budget).alias("amount_minor"),
        *(c.alias(k) for k, c in weak_labels(F.col("esci_label")).items()),
    )


def session_examples(df: DataFrame) -> DataFrame:
    """Shopping sessions as canonical columns: the last five titles are the objective, the next product the cart."""
    amount = minor(F.coalesce("next_price", F.lit(50.0)))
    n = F.size("previous_titles")
    last = F.slice("previous_titles", F.greatest(n - 4, F.lit(1)), F.lit(5))
    return df.filter(F.col("locale") == "UK").select(
        stable_id("ex", F.lit("session"), F.col("session_id")).alias("example_id"), F.array_join(last, "; ").alias("objective"), amount.alias("amount_minor"),
        F.greatest(amount + 1, F.bround(amount * 1.2).cast("bigint")).alias("budget_minor"), filled(F.col("next_title"), F.col("next_description")).alias("evidence_text"),
    )


def priced_examples(df: DataFrame, kind: str, key: list[str], amount: Column, factor: float) -> DataFrame:
    """Invoice lines, itineraries or awards: amount in minor units and a budget by a factor above it."""
    cents = minor(amount)
    return df.withColumns({"example_id": stable_id("ex", F.lit(kind), *map(F.col, key)), "amount_minor": cents, "budget_minor": F.greatest(cents + 1, F.bround(cents * factor).cast("bigint"))})


def itinerary_examples(df: DataFrame, key: list[str], amount: Column, origin: str, destination: str) -> DataFrame:
    """Itineraries: priced, with the route that was asked for as a constraint."""
    route = F.create_map(F.lit("origin"), F.col(origin), F.lit("destination"), F.col(destination))
    return priced_examples(df, "itinerary", key, amount, 1.15).withColumn("route", route)


def award_examples(df: DataFrame, key: list[str], amount: Column, recipient: str) -> DataFrame:
    """Awards: priced, with their recipient as the only merchant that is allowed."""
    return priced_examples(df, "award", key, amount, 1.05).withColumn("allowed_merchants", F.array(F.col(recipient)))


def invoice_examples(df: DataFrame, key: list[str], quantity: str, price: str) -> DataFrame:
    """Invoice lines of positive quantity and price."""
    return priced_examples(df.filter((F.col(quantity) > 0) & (F.col(price) > 0)), "invoice", key, F.col(quantity) * F.col(price), 1.1)


def nli_pairs(df: DataFrame) -> DataFrame:
    """One row per semantic constraint: premise from the items, hypothesis from the constraint."""
    wanted = F.filter("constraints", lambda c: c["type"] == "semantic_attribute")
    premise = F.trim(F.array_join(F.transform("items", lambda i: i["description"]), "\n"))
    return df.select("example_id", "group_id", "split", premise.alias("premise"), F.explode(wanted).alias("c")).select("example_id", "group_id", "split", F.col("c.constraint_id").alias("constraint_id"), "premise", F.concat(F.lit("The purchase satisfies: "), F.array_join("c.value_list", ", ")).alias("hypothesis"))


def blinded(df: DataFrame, hidden: tuple[str, ...] = ("relevance", "attack_family", "parent_example_id", "label_source")) -> DataFrame:
    """The rows without what would tell a reviewer the answer; types stay."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden if c in df.columns}).withColumn("audit_context", F.lit("blinded-v1"))


def role_rows(df: DataFrame, role: str, group: str = "group_id", source: str = "source_record_id") -> DataFrame:
    return df.withColumns({"split": F.col(role), "grouping_keys": F.array(group, source)})


def child_id(example_id: Column, kind: Column) -> Column:
    return F.concat(F.lit("cf_"), F.substring(sha(example_id, kind, F.lit(GENERATOR)), 1, 16))


def budget_minor() -> Column:
    return F.try_element_at(F.filter("constraints", lambda c: c["type"] == "total_budget"), F.lit(1))["amount_minor"]


def _overspend(df: DataFrame) -> tuple[Column, dict[str, Column], tuple[str, str, str | None]]:
    """Parents below their budget, with prior spend that takes them just over it."""
    b = budget_minor()
    count = F.greatest("fulfillment_count", F.lit(1))
    spent = b - F.col("total_amount_minor") + F.greatest(F.lit(1).cast("bigint"), F.floor(b / 100))
    return b > F.col("total_amount_minor"), {"fulfilled_amount_minor": spent, "max_fulfillments": F.greatest("max_fulfillments", count + 1), "fulfillment_count": count}, ("VIOLATION", "HOLD", "CUMULATIVE_BUDGET_EXCEEDED")


def _near_budget(df: DataFrame) -> tuple[Column, dict[str, Column], tuple[str, str, str | None]]:
    """Parents with one dominant item, its amount set so that the cart is one unit below the budget."""
    amount = F.greatest(F.lit(1).cast("bigint"), budget_minor() - 1)
    rest = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda s, i: s + i["amount_minor"] * i["quantity"])
    first = F.col("items")[0].withField("quantity", F.lit(1)).withField("amount_minor", amount - rest)
    items = F.transform("items", lambda i, k: F.when(k == 0, first).otherwise(i))
    return (budget_minor() >= 1) & (rest < amount), {"items": items, "total_amount_minor": amount, "fulfilled_amount_minor": F.lit(0)}, ("MATCH", "APPROVE", None)


def _no_evidence(df: DataFrame) -> tuple[Column, dict[str, Column], tuple[str, str, str | None]]:
    none = F.create_map().cast("map<string,string>")
    return F.lit(True), {"items": F.transform("items", lambda i: i.withField("attributes", none)), "evidence_sufficiency": F.lit("ambiguous")}, ("AMBIGUOUS", "STEP_UP", "REQUIRED_ATTRIBUTE_EVIDENCE_MISSING")


def _add_on(df: DataFrame, description: str = "gift card subscription", amount: int = 1500) -> tuple[Column, dict[str, Column], tuple[str, str, str | None]]:
    extra = F.struct(F.lit(99).alias("line_number"), F.lit(-1).cast("bigint").alias("part_key"), F.lit(1).alias("quantity"), F.lit(amount).cast("bigint").alias("amount_minor"), F.lit(description).alias("description"), F.lit("ADD_ON").alias("category"), F.create_map().cast("map<string,string>").alias("attributes"))
    items = F.concat("items", F.array(extra).cast(df.schema["items"].dataType))
    return F.lit(True), {"items": items, "total_amount_minor": F.col("total_amount_minor") + amount, "line_item_count": F.col("line_item_count") + 1}, ("VIOLATION", "STEP_UP", "SEMANTIC_UNRELATED_ITEM")


COUNTERFACTUALS = {"cumulative_overspend": _overspend, "near_budget_match": _near_budget, "missing_required_evidence": _no_evidence, "unrelated_add_on": _add_on}


def counterfactuals(df: DataFrame, kinds: tuple[str, ...] = tuple(COUNTERFACTUALS), changes: tuple[str, ...] | None = None) -> DataFrame:
    """The children of the given kinds of every parent that allows them: an array of what changes, exploded, so that parents are read once.

    If `changes` names some of the columns that change, the others are left out of the result.
    """
    made = {k: COUNTERFACTUALS[k](df) for k in kinds}
    changed = sorted({c for _, columns, _ in made.values() for c in columns})
    left_out = [c for c in changed if changes is not None and c not in changes]
    changed = [c for c in changed if c not in left_out]
    variants = []
    for kind, (possible, columns, (deviation, treatment, violation)) in made.items():
        labels = {"attack_family": F.lit(kind), "deviation": F.lit(deviation), "expected_treatment": F.lit(treatment), "violation_types": F.array(F.lit(violation)) if violation else F.array().cast("array<string>")}
        # numbers are brought to one type; items differ in nothing but what may be null
        every = {c: v if c == "items" else v.cast(df.schema[c].dataType) for c, v in ((c, columns.get(c, F.col(c))) for c in changed)} | labels
        variants.append(F.when(possible, F.struct(*(v.alias(c) for c, v in every.items()))))
    names = [*changed, "attack_family", "deviation", "expected_treatment", "violation_types"]
    d = df.withColumn("_v", F.explode(F.array_compact(F.array(*variants)))).drop(*left_out).withColumn("parent_example_id", F.col("example_id"))
    d = d.withColumns({c: F.col(f"_v.{c}") for c in names}).drop("_v")
    return d.withColumns({"example_id": child_id(F.col("example_id"), F.col("attack_family")), "label_source": F.lit("deterministic_counterfactual"), "confidence": F.lit(1.0)})


def cumulative_overspend(df: DataFrame) -> DataFrame:
    return counterfactuals(df, ("cumulative_overspend",))


def near_budget_match(df: DataFrame) -> DataFrame:
    return counterfactuals(df, ("near_budget_match",))


def evidence_removal(df: DataFrame) -> DataFrame:
    return counterfactuals(df, ("missing_required_evidence",))


def unrelated_add_on(df: DataFrame) -> DataFrame:
    return counterfactuals(df, ("unrelated_add_on",))


def counterfactual_problems(df: DataFrame) -> DataFrame:
    """Children with what breaks their contract: other failures than expected, or failures without a reason."""
    d = rules.with_signals(df, shown=False)
    fails = rules.failed(F.col("signals"))
    codes = F.array_sort(F.array_distinct(F.filter(F.transform(fails, lambda s: s["reason"]), lambda r: r.isNotNull())))
    table = F.create_map(*(x for k, v in EXPECTED_FAILURES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    unknown = F.try_element_at(table, F.col("attack_family")).isNull()
    return d.select(
        "example_id", "attack_family",
        F.when(unknown, "unknown_transformation").when(~codes.eqNullSafe(F.try_element_at(table, F.col("attack_family"))), "unexpected_failures").when(F.exists(fails, lambda s: s["reason"].isNull()), "unattributed_failures")
        .when((F.col("attack_family") == "missing_required_evidence") & (F.col("evidence_sufficiency") == "sufficient"), "evidence_kept").alias("problem"),
    )


def relabel(df: DataFrame) -> DataFrame:
    """Labels by precedence: rules, then the semantic outcome, then the family; audited labels replace weak ones.

    Reads signals, semantic_labels (array), attack_family, deviation, confidence, audited_confidence (null if not audited).
    """
    semantic = worst_label(F.col("semantic_labels"))
    codes = F.array_sort(F.array_distinct(F.filter(F.transform(rules.failed(F.col("signals")), lambda s: s["reason"]), lambda r: r.isNotNull())))
    unexplained = F.exists("signals", lambda s: (s["status"] == "FAIL") & s["reason"].isNull())
    ruled = rules.treatment(codes, unexplained, F.exists("signals", lambda s: s["status"] == "NOT_EVALUABLE"))
    family = F.coalesce(F.nullif(F.nullif(F.col("attack_family"), F.lit("")), F.lit("none")), F.lit("none"))
    none = F.array().cast("array<string>")
    extra = (
        F.when(family == "missing_required_evidence", F.array(F.lit("REQUIRED_ATTRIBUTE_EVIDENCE_MISSING"))).when(family == "unrelated_add_on", F.array(F.lit("SEMANTIC_UNRELATED_ITEM")))
        .when(semantic == "CONTRADICTION", F.array(F.lit("REQUIRED_ATTRIBUTE_CONTRADICTED"))).otherwise(none)
    )
    escalated = F.coalesce(semantic.isin("CONTRADICTION", "NEUTRAL"), F.lit(False)) | family.isin("missing_required_evidence", "unrelated_add_on")
    treatment = F.when((ruled == "APPROVE") & escalated, "STEP_UP").otherwise(ruled)
    audited = F.col("audited_confidence").isNotNull()
    by_rule = (ruled != "APPROVE") | (family != "none")
    return df.withColumns(
        {
            "semantic_outcome": semantic, "deterministic_outcome": codes, "violation_types": F.array_sort(F.array_distinct(F.concat(codes, extra))), "expected_treatment": treatment,
            "label_source": F.when(audited, "llm_assisted_v3").when(by_rule, "deterministic_policy_v3").otherwise("weak_policy_v3"),
            "confidence": F.when(audited, F.col("audited_confidence")).when(by_rule, F.lit(1.0)).otherwise(F.col("confidence")),
            "deviation": F.coalesce("deviation", F.when(treatment == "APPROVE", "MATCH").otherwise("AMBIGUOUS")),
        }
    )


def review_label(semantic: Column, violations: Column) -> Column:
    """Deviation of a review by its worst semantic label and its violation types."""
    return F.when(semantic == "CONTRADICTION", "VIOLATION").when((semantic == "NEUTRAL") & (F.size(violations) == 0), "AMBIGUOUS").when(F.size(violations) > 0, "VIOLATION").otherwise("MATCH")
