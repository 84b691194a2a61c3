"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("contradiction", "neutral", "entailment")
#: Airport codes by place name (fixed values).
AIRPORTS = {"singapore": "SIN", "tokyo": "TYO", "london": "LON", "paris": "PAR", "new york": "NYC", "sydney": "SYD"}


def minor(amount: Column) -> Column:
    """A price in minor units, halves to even, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround(amount * 100).cast("bigint"))


def count_bucket(n: Column, limits: Sequence[int]) -> Column:
    """lte_k of the first limit that holds n, else gt_k of the last."""
    out = F.lit(f"gt_{limits[-1]}")
    for k in reversed(limits):
        out = F.when(n <= k, f"lte_{k}").otherwise(out)
    return out


def utilisation_bucket(cart: Column, budgets: Column) -> Column:
    """The cart's share of the smallest positive budget as a bucket."""
    share = cart / F.array_min(F.filter(budgets, lambda b: b > 0))
    return F.when(share.isNull(), "missing").when(share <= 0.5, "lte_50").when(share <= 0.9, "lte_90").when(share < 1, "lt_100").when(share == 1, "eq_100").otherwise("gt_100")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def entropy(*probabilities: Column) -> Column:
    """Entropy of a distribution in units of its largest possible value."""
    total = F.lit(0.0)
    for p in probabilities:
        total = total - F.when(p > 0, p * F.ln(F.when(p > 0, p))).otherwise(0.0)
    return total / F.ln(F.lit(float(len(probabilities))))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Softmax of an array of logits."""
    scaled = F.transform(logits, lambda x: (x - F.array_max(logits)) / temperature)
    powers = F.transform(scaled, F.exp)
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def folded(vector: Column, parts: int) -> Column:
    """The sums of every `parts`-th value of a vector, from the first, the second and so on."""
    places = F.transform(vector, lambda v, k: F.struct(v.cast("double").alias("v"), (k % parts).alias("k")))
    return F.array(*(F.aggregate(F.filter(places, lambda x: x["k"] == p), F.lit(0.0), lambda s, x: s + x["v"]) for p in range(parts)))


def logit(p: Column, clamp: float = 1e-6) -> Column:
    held = F.least(F.greatest(p, F.lit(clamp)), F.lit(1 - clamp))
    return F.ln(held / (1 - held))


def logistic(x: Column, clamp: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-clamp)), F.lit(clamp))))


def quoted_items(text: Column) -> Column:
    """The quoted strings of an array literal in text form."""
    return F.regexp_extract_all(text, F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))


def text_budget(text: Column) -> Column:
    """The amount after a currency sign or code, in minor units."""
    found = F.regexp_extract(text, r"(?i)(?:sgd|usd|\$)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1)
    return F.when(found != "", F.bround(F.regexp_replace(found, ",", "").cast("decimal(20,2)") * 100).cast("bigint"))


def text_route(text: Column) -> Column:
    """(origin, destination) codes of "from A to B", null where a place isn't known."""
    places = "|".join(AIRPORTS)
    codes = F.create_map(*(F.lit(x) for pair in AIRPORTS.items() for x in pair))
    code = lambda k: F.try_element_at(codes, F.lower(F.regexp_extract(text, rf"(?i)from\s+({places})\s+to\s+({places})", k)))
    return F.struct(code(1).alias("origin"), code(2).alias("destination"))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def text_dates(text: Column, year: int = 2026) -> Column:
    """(outbound, back) of "departing 3 may ... returning 9 june"; a way back before the way out is in the year after; null where a month isn't one."""
    months = F.create_map(*(F.lit(x) for k, name in enumerate(MONTHS, 1) for x in (name, k)))
    part = lambda k: F.regexp_extract(F.lower(text), r"departing\s+(\d{1,2})\s+([a-z]+).*?returning\s+(\d{1,2})\s+([a-z]+)", k)
    day = lambda k: F.try_element_at(F.array(F.nullif(part(k), F.lit(""))), F.lit(1)).cast("int")
    at = lambda y, d, m: F.try_to_date(F.concat_ws("-", F.lit(y).cast("string"), F.lpad(F.try_element_at(months, part(m)).cast("string"), 2, "0"), F.lpad(day(d).cast("string"), 2, "0")))
    known = F.try_element_at(months, part(2)).isNotNull() & F.try_element_at(months, part(4)).isNotNull()
    out, back = F.when(known, at(year, 1, 2)), F.when(known, at(year, 3, 4))
    return F.struct(out.alias("outbound"), F.when(back < out, F.when(known, at(year + 1, 3, 4))).otherwise(back).alias("back"))


def hard_score(disagrees: Column, probability: Column, c: Column, n: Column, e: Column) -> Column:
    """How much a row would teach: disagreement, uncertainty, semantic entropy and the stronger warning."""
    return 2 * disagrees.cast("double") + (1 - 2 * F.abs(probability - 0.5)) + entropy(c, n, e) + F.greatest(c, n)


def challenge_score(probability: Column, c: Column, n: Column, e: Column) -> Column:
    """Uncertainty, semantic entropy and the gap between model and semantic risk."""
    return (1 - 2 * F.abs(probability - 0.5)) + entropy(c, n, e) + F.abs(probability - F.greatest(c, n))


def top_class(c: Column, n: Column, e: Column) -> Column:
    """The likeliest class, the first among equals."""
    return F.when((c >= n) & (c >= e), CLASSES[0]).when(n >= e, CLASSES[1]).otherwise(CLASSES[2])


def mentions(text: Column, terms: Column) -> Column:
    """Whether a text holds any of the terms, in any case, also inside words."""
    return F.exists(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def source_bucket(source: Column) -> Column:
    """Kind of a label's source."""
    s = F.lower(source)
    return F.when(s.startswith("llm") | s.contains("expert"), "reviewed").when(s.contains("deterministic"), "deterministic").when(s.contains("weak"), "weak").otherwise("other")


def worst_label(labels: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in ("ENTAILMENT", "NEUTRAL", "CONTRADICTION"):
        out = F.when(F.array_contains(labels, name), name).otherwise(out)
    return out


def label_key(labels: Column) -> Column:
    """Sorted distinct labels joined by +."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), "+")
