"""Commercial rules, treatment contract and policies as column expressions.

A mandate's constraints are an array of structs (constraint_id, type, value_list, value_map, amount_minor,
currency); a cart's items an array of structs with a description and a map of attributes. All rules stay
higher-order functions over these arrays, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritill.functions.scalars import mentions

SIGNAL = "struct<rule_id:string,status:string,severity:string,observed:string,expected:string,reason:string>"

#: Reason codes that hold a purchase (fixed values).
CRITICAL = (
    "MANDATE_AUTHORIZATION_INVALID", "MANDATE_NOT_ACTIVE", "MANDATE_EXPIRED_OR_NOT_YET_VALID", "CART_REPLAY_DETECTED",
    "CUMULATIVE_BUDGET_EXCEEDED", "FULFILLMENT_LIMIT_EXCEEDED", "EXPLICIT_PROHIBITED_ITEM_OR_CATEGORY", "MERCHANT_NOT_AUTHORIZED",
)
#: Reason codes that ask the customer (fixed values).
STEP_UP = (
    "TRUSTED_CART_EVIDENCE_MISSING", "CURRENCY_MISMATCH", "SINGLE_CART_BUDGET_EXCEEDED", "ROUTE_EVIDENCE_MISSING", "ROUTE_MISMATCH",
    "TRAVEL_DATE_EVIDENCE_MISSING", "TRAVEL_DATE_MISMATCH", "REQUIRED_ATTRIBUTE_CONTRADICTED", "REQUIRED_ATTRIBUTE_EVIDENCE_MISSING",
    "SEMANTIC_UNRELATED_ITEM", "MODEL_RISK_THRESHOLD_EXCEEDED",
)
TRUSTED_SOURCES = ("merchant_api", "merchant_feed")

#: What a customer reads for each code (fixed values).
TEMPLATES = {
    "MANDATE_AUTHORIZATION_INVALID": "The mandate authorization could not be verified.",
    "MANDATE_NOT_ACTIVE": "This mandate is no longer active.",
    "MANDATE_EXPIRED_OR_NOT_YET_VALID": "This purchase is outside the mandate's valid time window.",
    "TRUSTED_CART_EVIDENCE_MISSING": "Trusted merchant evidence is not available for this cart.",
    "CART_REPLAY_DETECTED": "This cart has already been processed under the mandate.",
    "CURRENCY_MISMATCH": "The cart currency does not match the authorized currency.",
    "SINGLE_CART_BUDGET_EXCEEDED": "The proposed purchase exceeds the authorized transaction budget.",
    "CUMULATIVE_BUDGET_EXCEEDED": "This purchase would exceed the mandate's remaining total budget.",
    "EXPLICIT_PROHIBITED_ITEM_OR_CATEGORY": "The cart contains an item or category the mandate explicitly prohibits.",
    "SEMANTIC_UNRELATED_ITEM": "An item may be unrelated to the confirmed purchase objective.",
    "MERCHANT_NOT_AUTHORIZED": "The proposed merchant is not authorized by this mandate.",
    "ROUTE_EVIDENCE_MISSING": "The merchant evidence does not establish the required route.",
    "ROUTE_MISMATCH": "The itinerary route does not match the authorized route.",
    "TRAVEL_DATE_EVIDENCE_MISSING": "The merchant evidence does not establish the required travel dates.",
    "TRAVEL_DATE_MISMATCH": "The itinerary dates do not match the authorized travel dates.",
    "FULFILLMENT_LIMIT_EXCEEDED": "The mandate has already reached its fulfillment limit.",
    "REQUIRED_ATTRIBUTE_CONTRADICTED": "Trusted merchant evidence contradicts a required purchase attribute.",
    "REQUIRED_ATTRIBUTE_EVIDENCE_MISSING": "The cart does not provide enough evidence for a required attribute.",
    "MODEL_RISK_THRESHOLD_EXCEEDED": "The purchase needs confirmation because its combined risk signals exceed the reviewed threshold.",
}


def signal(rule: Column | str, ok: Column, severity: Column | str, observed: Column, expected: Column, reason: Column | str, missing: Column | None = None, missing_reason: str | None = None, shown: bool = True) -> Column:
    """One signal: PASS where ok, NOT_EVALUABLE where missing, else FAIL with its reason; what was observed and expected is null unless shown."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    status, code = F.when(ok, "PASS").otherwise("FAIL"), F.when(~ok, text(reason))
    if missing is not None:
        status, code = F.when(missing, "NOT_EVALUABLE").otherwise(status), F.when(missing, missing_reason).otherwise(code)
    observed, expected = (observed, expected) if shown else (F.lit(None), F.lit(None))
    parts = (("rule_id", text(rule)), ("status", status), ("severity", text(severity)), ("observed", text(observed)), ("expected", text(expected)), ("reason", code))
    return F.struct(*(v.cast("string").alias(k) for k, v in parts))


def _matching(attributes: Column, expected: Column, keys: tuple[str, str], fold: bool) -> tuple[Column, Column]:
    """Whether evidence for both keys is missing, and whether it agrees with what is expected."""
    case = F.upper if fold else lambda x: x
    found = [F.try_element_at(attributes, F.lit(k)) for k in keys]
    missing = F.coalesce(found[0], F.lit("")).eqNullSafe("") | F.coalesce(found[1], F.lit("")).eqNullSafe("")
    agree = F.lit(True)
    for k, v in zip(keys, found, strict=True):
        wanted = F.try_element_at(expected, F.lit(k))
        agree = agree & (~F.map_contains_key(expected, F.lit(k)) | case(v).eqNullSafe(case(wanted)))
    return missing, agree


def commercial_signals(shown: bool = True) -> Column:
    """The signals of every constraint in order, then the fulfilment limit.

    Reads constraints, max_fulfillments, items, currency, total_amount_minor, merchant_id, merchant_category,
    fulfilled_amount_minor and fulfillment_count. A currency mismatch skips both budget checks.
    What signals observed and expected, which is most of their work, is made only if it is shown.
    """
    total, spent = F.col("total_amount_minor"), F.col("fulfilled_amount_minor")
    attributes = F.coalesce(F.try_element_at("items", F.lit(1))["attributes"], F.create_map().cast("map<string,string>"))

    def of(c: Column) -> Column:
        budget = F.coalesce(c["amount_minor"], F.lit(0).cast("bigint"))
        after = spent + total
        breach = (after > budget) & (spent > 0)
        budgets = F.array(
            signal("single_cart_budget", total <= budget, "medium", total, budget, "SINGLE_CART_BUDGET_EXCEEDED", shown=shown),
            signal("cumulative_budget", after <= budget, F.when(breach, "critical").otherwise("medium"), after, budget, F.when(breach, "CUMULATIVE_BUDGET_EXCEEDED"), shown=shown),
        )
        currency = F.array(signal("currency_match", F.lit(False), "high", F.col("currency"), c["currency"], "CURRENCY_MISMATCH", shown=shown))
        terms = F.coalesce(c["value_list"], F.array().cast("array<string>"))
        found = F.filter(F.transform("items", lambda i: i["description"]), lambda d: mentions(d, terms))
        item = F.array(signal(F.concat(F.lit("prohibited_item:"), c["constraint_id"]), F.size(found) == 0, "critical", F.to_json(found), F.to_json(F.transform(terms, F.lower)), "EXPLICIT_PROHIBITED_ITEM_OR_CATEGORY", shown=shown))
        category = F.col("merchant_category")
        banned = F.transform(terms, F.upper)
        kind = F.array(signal(F.concat(F.lit("prohibited_category:"), c["constraint_id"]), ~F.array_contains(banned, F.upper(category)), "critical", category, F.to_json(F.array_sort(F.array_distinct(banned))), "EXPLICIT_PROHIBITED_ITEM_OR_CATEGORY", shown=shown))
        merchant = F.array(signal(F.concat(F.lit("allowed_merchant:"), c["constraint_id"]), F.array_contains(terms, F.col("merchant_id")), "critical", F.col("merchant_id"), F.to_json(F.array_sort(F.array_distinct(terms))), "MERCHANT_NOT_AUTHORIZED", shown=shown))
        wanted = F.coalesce(c["value_map"], F.create_map().cast("map<string,string>"))
        trips = []
        for rule, keys, fold, code in (("route_match", ("origin", "destination"), True, "ROUTE"), ("travel_date_match", ("outbound_date", "return_date"), False, "TRAVEL_DATE")):
            missing, agree = _matching(attributes, wanted, keys, fold)
            seen = F.to_json(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.try_element_at(attributes, F.lit(k)) for k in keys))))
            trips.append(F.array(signal(rule, agree, "high", seen, F.to_json(wanted), f"{code}_MISMATCH", missing, f"{code}_EVIDENCE_MISSING", shown=shown)))
        t = c["type"]
        return (
            F.when((t == "total_budget") & ~F.col("currency").eqNullSafe(c["currency"]), currency).when(t == "total_budget", budgets).when(t == "prohibited_item", item).when(t == "prohibited_category", kind)
            .when(t == "allowed_merchant", merchant).when(t == "route", trips[0]).when(t == "travel_dates", trips[1]).otherwise(F.array().cast(f"array<{SIGNAL}>"))
        )

    count, most = F.col("fulfillment_count"), F.col("max_fulfillments")
    limit = F.array(signal("fulfillment_limit", count < most, "critical", count + 1, most, "FULFILLMENT_LIMIT_EXCEEDED", shown=shown))
    return F.concat(F.flatten(F.transform("constraints", of)), limit)


def pre_signals(now: Column, shown: bool = True) -> Column:
    """The online checks before the commercial ones: signature, status, window, evidence and replay.

    Reads signature_valid, mandate_status, state_status, valid_from, expires_at, evidence_trust,
    evidence_source, cart_id and prior_transaction_ids.
    """
    active = (F.col("mandate_status") == "active") & (F.col("state_status") == "active")
    window = (F.col("valid_from") <= now) & (now <= F.col("expires_at"))
    trusted = (F.col("evidence_trust") == "trusted") & F.col("evidence_source").isin(*TRUSTED_SOURCES)
    replayed = F.array_contains("prior_transaction_ids", F.col("cart_id"))
    return F.array(
        signal("mandate_signature", F.col("signature_valid"), "critical", F.when(F.col("signature_valid"), "valid").otherwise("invalid"), F.lit("a signature that verifies"), "MANDATE_AUTHORIZATION_INVALID", shown=shown),
        signal("mandate_status", active, "critical", F.col("state_status"), F.lit("active"), "MANDATE_NOT_ACTIVE", shown=shown),
        signal("mandate_window", window, "critical", now, F.col("expires_at"), "MANDATE_EXPIRED_OR_NOT_YET_VALID", shown=shown),
        signal("trusted_evidence", trusted, "high", F.col("evidence_source"), F.lit(", ".join(TRUSTED_SOURCES)), "TRUSTED_CART_EVIDENCE_MISSING", ~trusted, "TRUSTED_CART_EVIDENCE_MISSING", shown=shown),
        signal("cart_replay", ~replayed, "critical", F.col("cart_id"), F.lit("a cart without an earlier transaction"), "CART_REPLAY_DETECTED", shown=shown),
    )


def with_signals(df: DataFrame, shown: bool = True) -> DataFrame:
    return df.withColumn("signals", commercial_signals(shown))


def failed(signals: Column) -> Column:
    return F.filter(signals, lambda s: s["status"] == "FAIL")


def reason_codes(signals: Column) -> Column:
    """The reasons in order, each once."""
    return F.array_distinct(F.filter(F.transform(signals, lambda s: s["reason"]), lambda r: r.isNotNull()))


def treatment(codes: Column, unclassified: Column, not_evaluable: Column, escalated: Column | None = None) -> Column:
    """HOLD for a critical code; STEP_UP for a declared one, an unexplained failure, missing evidence or the model; else APPROVE."""
    ask = F.arrays_overlap(codes, F.array(*map(F.lit, STEP_UP))) | unclassified | not_evaluable
    if escalated is not None:
        ask = ask | escalated
    return F.when(F.arrays_overlap(codes, F.array(*map(F.lit, CRITICAL))), "HOLD").when(ask, "STEP_UP").otherwise("APPROVE")


def signal_treatment(signals: Column) -> Column:
    """The treatment that the signals alone ask for."""
    unexplained = F.exists(signals, lambda s: (s["status"] == "FAIL") & s["reason"].isNull())
    return treatment(reason_codes(signals), unexplained, F.exists(signals, lambda s: s["status"] == "NOT_EVALUABLE"))


def online_policy(signals: Column, contradiction: Column, neutral: Column, probability: Column | None = None, threshold: float | None = None, contradiction_at: float | None = 0.8, neutral_at: float | None = 0.6) -> Column:
    """(treatment, probability, band, reason_codes) of a decision; contradiction and neutral are arrays over its semantic results."""
    over = lambda scores, at: F.exists(scores, lambda x: x >= at) if at is not None else F.lit(False)
    contradicted, uncertain = over(contradiction, contradiction_at), over(neutral, neutral_at)
    escalated = F.coalesce(probability >= threshold, F.lit(False)) if probability is not None and threshold is not None else F.lit(False)
    none = F.array().cast("array<string>")
    codes = F.array_distinct(F.concat(reason_codes(signals), F.when(contradicted, F.array(F.lit("REQUIRED_ATTRIBUTE_CONTRADICTED"))).otherwise(none), F.when(uncertain, F.array(F.lit("REQUIRED_ATTRIBUTE_EVIDENCE_MISSING"))).otherwise(none)))
    outcome = treatment(codes, (F.size(failed(signals)) > 0) | contradicted, F.exists(signals, lambda s: s["status"] == "NOT_EVALUABLE") | uncertain, escalated)
    codes = F.when((outcome != "HOLD") & escalated, F.concat(codes, F.array(F.lit("MODEL_RISK_THRESHOLD_EXCEEDED")))).otherwise(codes)
    p = probability if probability is not None else F.lit(None).cast("double")
    risk = F.when(outcome == "HOLD", F.lit(0.99)).when(outcome == "STEP_UP", F.greatest(F.coalesce(p, F.lit(0.55)), F.lit(0.55))).otherwise(F.coalesce(p, F.lit(0.05)))
    band = F.when(outcome == "HOLD", "high").when((outcome == "STEP_UP") | (risk >= 0.3), "moderate").otherwise("low")
    return F.struct(outcome.alias("treatment"), risk.alias("probability"), band.alias("band"), codes.alias("reason_codes"))


def offline_policy(probability: Column, threshold: float | Column, contradiction_at: float | Column | None = 0.8, neutral_at: float | Column | None = 0.6) -> Column:
    """The treatment of a feature row: critical holds, then failures, semantic overrides and the model."""
    over = lambda name, at: F.lit(False) if at is None else F.coalesce(F.col(name) >= at, F.lit(False))
    ask = (F.col("hard_fail_count") > 0) | over("semantic_contradiction", contradiction_at) | over("semantic_neutral", neutral_at) | (probability >= threshold)
    return F.when(F.col("critical_hold_count") > 0, "HOLD").when(ask, "STEP_UP").otherwise("APPROVE")


def heuristic_nli(items: Column, required: Column) -> Column:
    """(contradiction, neutral, entailment) of a required attribute by the items' attributes and descriptions."""
    name = F.lower(required)
    text = F.array_join(F.transform(items, lambda i: F.lower(i["description"])), " ")
    value = lambda key: F.filter(F.transform(items, lambda i: F.try_element_at(i["attributes"], key)), lambda v: v.isNotNull())
    own, cabin, stops = value(name), value(F.lit("cabin")), value(F.lit("stops"))
    own = (
        F.when((F.size(own) == 0) & (name == "economy"), F.transform(cabin, lambda v: (v == "economy").cast("string")))
        .when((F.size(own) == 0) & (name == "nonstop"), F.transform(stops, lambda v: (v == "0").cast("string")))
        .otherwise(own)
    )
    scores = lambda c, n, e: F.struct(F.lit(c).alias("contradiction"), F.lit(n).alias("neutral"), F.lit(e).alias("entailment"))
    against = F.exists(own, lambda v: v == "false") | F.contains(text, F.concat(F.lit("non-"), name))
    return F.when(against, scores(0.97, 0.02, 0.01)).when(F.exists(own, lambda v: v == "true") | F.contains(text, name), scores(0.01, 0.02, 0.97)).otherwise(scores(0.05, 0.90, 0.05))


def heuristic_risk(failures: Column, contradiction: Column, neutral: Column) -> Column:
    return F.least(F.lit(0.99), 0.04 + 0.35 * F.least(failures, F.lit(2)) + 0.45 * contradiction + 0.18 * neutral)


def explanation(codes: Column) -> Column:
    """(card_member, reviewer): the first two known messages, and every code with its message."""
    messages = F.create_map(*(F.lit(x) for pair in TEMPLATES.items() for x in pair))
    known = F.filter(F.transform(codes, lambda c: F.try_element_at(messages, c)), lambda m: m.isNotNull())
    card = F.when(F.size(codes) == 0, "The proposed purchase matches the confirmed mandate.").when(F.size(known) == 0, "The purchase needs additional review.").otherwise(F.array_join(F.slice(known, 1, 2), " "))
    every = F.transform(codes, lambda c: F.concat(c, F.lit(": "), F.coalesce(F.try_element_at(messages, c), F.lit("Review required."))))
    reviewer = F.when(F.size(codes) == 0, "No blocking or uncertainty reason codes were produced.").otherwise(F.array_join(every, " "))
    return F.struct(card.alias("card_member"), reviewer.alias("reviewer"))
