"""Per-mandate state: what each decision sees depends on what was approved before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritill.sources.shipping import ship

DECISIONS = "mandate string, event_id bigint, outcome string, spent bigint"


def decide(spent: int, fulfilled: int, active: bool, kind: str, amount: int, budget: int, most: int) -> tuple[str, int, int, bool]:
    """The outcome of one event, and the state after it: only an approval adds to what is spent."""
    after = spent + amount
    if kind == "revoke":
        return "REVOKED", spent, fulfilled, False
    if not active or fulfilled >= most or (after > budget and spent > 0):
        return "HOLD", spent, fulfilled, active
    if kind == "evaluate" and after > budget:
        return "STEP_UP", spent, fulfilled, active
    return "APPROVE", after, fulfilled + 1, active


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    mandate, state = None, (0, 0, True)
    for part in parts:
        rows = []
        for m, event, kind, amount, budget, most in zip(*(part[c] for c in ("mandate", "event_id", "kind", "amount", "budget", "max_fulfillments")), strict=True):
            if m != mandate:
                mandate, state = m, (0, 0, True)
            outcome, *after = decide(*state, kind, int(amount), int(budget), int(most))
            state = tuple(after)
            rows.append((m, int(event), outcome, state[0]))
        yield pd.DataFrame(rows, columns=["mandate", "event_id", "outcome", "spent"])


def fold_decisions(events: DataFrame) -> DataFrame:
    """(mandate, event_id, outcome, spent) per event in order of time and id.

    events: mandate, ts, event_id, kind (evaluate, revoke, resolve), amount, budget, max_fulfillments, none of them
    null. Each task reads its mandates one after the other in order, with one state at a time, so a long history
    takes time but no memory.
    """
    ship(events.sparkSession)
    ordered = events.select("mandate", "ts", "event_id", "kind", "amount", "budget", "max_fulfillments").repartition("mandate").sortWithinPartitions("mandate", "ts", "event_id")
    return ordered.mapInPandas(_fold, DECISIONS)


def resolved_once(decisions: DataFrame, resolutions: DataFrame, order: list[str]) -> DataFrame:
    """Resolutions with their result: only a question can be resolved, and only once; approving and modifying move the mandate's version on.

    decisions: decision_id, outcome. resolutions: decision_id, action (approve_once, decline, modify) and the columns of order.
    """
    turn = F.row_number().over(Window.partitionBy("decision_id").orderBy(*order))
    d = resolutions.withColumn("_turn", turn).join(decisions.select("decision_id", "outcome"), "decision_id", "left")
    result = (
        F.when(F.col("outcome").isNull(), "DECISION_NOT_FOUND").when(F.col("outcome") != "STEP_UP", "NOT_ESCALATED").when(F.col("_turn") > 1, "ALREADY_RESOLVED")
        .when(F.col("action") == "approve_once", "fulfilled").when(F.col("action") == "modify", "superseded").otherwise("declined")
    )
    return d.withColumn("result", result).withColumn("version_bump", F.col("result").isin("fulfilled", "superseded").cast("int")).drop("_turn", "outcome")


def fulfilled_carts(carts: DataFrame, order: list[str]) -> DataFrame:
    """Fulfilments of mandates: the first of each cart moves the state's version on, the same cart again is no change."""
    first = F.row_number().over(Window.partitionBy("mandate", "cart").orderBy(*order)) == 1
    d = carts.withColumn("changed", first)
    version = F.sum(F.col("changed").cast("int")).over(Window.partitionBy("mandate").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("row_version", version)


def idempotent(requests: DataFrame, scope: str, key: str, payload: Column, order: list[str]) -> DataFrame:
    """Requests as first, replay or conflict: a later one of the same key is answered from the first, or refused if it says something else."""
    w = Window.partitionBy(scope, key).orderBy(*order)
    d = requests.withColumn("_hash", F.sha2(payload, 256))
    d = d.withColumns({"_n": F.row_number().over(w), "_first": F.first("_hash").over(w)})
    return d.withColumn("status", F.when(F.col("_n") == 1, "first").when(F.col("_hash") == F.col("_first"), "replay").otherwise("conflict")).drop("_hash", "_n", "_first")


def conflicting_payloads(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """Keys that came with more than one payload."""
    return df.groupBy(key).agg(F.count_distinct(F.sha2(payload, 256)).alias("payloads"), F.count(F.lit(1)).alias("requests")).filter("payloads > 1")


def confirmed(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed proposals of unique ids, fanned out to one row per constraint; and the rejected ones with an error code."""
    n = F.count(F.lit(1)).over(Window.partitionBy("mandate_id"))
    d = proposals.withColumn("_n", n)
    code = F.when(~F.col("confirmed"), "CONFIRMATION_REQUIRED").when(F.col("_n") > 1, "DUPLICATE_MANDATE")
    d = d.withColumn("error_code", code).drop("_n")
    good = d.filter(F.col("error_code").isNull()).select("mandate_id", F.posexplode("constraints").alias("position", "c")).select("mandate_id", "position", F.col("c.type").alias("type"))
    return good, d.filter(F.col("error_code").isNotNull()).select("mandate_id", "error_code")
