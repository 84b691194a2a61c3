"""A mandate as one state machine: evaluations, fulfilments, resolutions and supersession change one state.

Events of a mandate, in order of time and id:

- `evaluate` decides on a cart. A cart id that came with another amount is refused; a mandate that is superseded,
  used up, or would overspend what was already spent, holds; a first cart above the budget, or one that the model
  asks about, steps up; the rest is approved, and an approval fulfils the cart.
- `resolve` acts on an earlier decision (`target`), which must be an open step-up: `approve_once` fulfils its cart
  whatever the budget, `modify` supersedes the mandate, `decline` changes nothing.

Fulfilling a cart again is no change; a fulfilment moves the state's version on.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from veritill.sources.shipping import ship

EVENTS = "mandate string, ts timestamp, event_id bigint, kind string, cart string, amount bigint, ask boolean, target bigint, action string, budget bigint, max_fulfillments int"
OUTCOMES = "mandate string, event_id bigint, outcome string, spent bigint, fulfillments int, version int, status string"
COLUMNS = [c.split()[0] for c in OUTCOMES.split(", ")]


class Account(NamedTuple):
    spent: int = 0
    fulfillments: int = 0
    version: int = 1
    status: str = "active"


class Event(NamedTuple):
    event_id: int
    kind: str
    cart: str | None
    amount: int | None
    ask: bool | None
    target: int | None
    action: str | None
    budget: int
    max_fulfillments: int


#: (amount, fulfilled) of a cart; (outcome, cart, amount, resolved) of a decision.
Carts = MutableMapping[str, tuple[int, bool]]
Decisions = MutableMapping[int, tuple[str, str, int, bool]]


def fulfil(account: Account, carts: Carts, cart: str, amount: int) -> Account:
    if carts[cart][1]:
        return account
    carts[cart] = carts[cart][0], True
    return account._replace(spent=account.spent + amount, fulfillments=account.fulfillments + 1, version=account.version + 1)


def step(account: Account, carts: Carts, decisions: Decisions, e: Event) -> tuple[str, Account]:
    """The outcome of one event and the account after it; carts and decisions are changed in place."""
    if e.kind == "resolve":
        there = decisions.get(e.target) if e.target is not None else None
        if there is None:
            return "DECISION_NOT_FOUND", account
        outcome, cart, amount, resolved = there
        if resolved:
            return "DECISION_ALREADY_RESOLVED", account
        if outcome != "STEP_UP":
            return "DECISION_NOT_RESOLVABLE", account
        decisions[e.target] = outcome, cart, amount, True
        if e.action == "approve_once":
            return "FULFILLED", fulfil(account, carts, cart, amount)
        return ("SUPERSEDED", account._replace(status="superseded")) if e.action == "modify" else ("DECLINED", account)
    known = carts.get(e.cart)
    if known is not None and known[0] != e.amount:
        return "CART_ID_CONFLICT", account
    if known is None:
        carts[e.cart] = e.amount, False
    after = account.spent + e.amount
    if account.status != "active" or account.fulfillments >= e.max_fulfillments or (after > e.budget and account.spent > 0):
        outcome = "HOLD"
    elif after > e.budget or e.ask:
        outcome = "STEP_UP"
    else:
        outcome, account = "APPROVE", fulfil(account, carts, e.cart, e.amount)
    decisions[e.event_id] = outcome, e.cart, e.amount, False
    return outcome, account


def events_of(rows: pd.DataFrame) -> Iterator[Event]:
    """Events of a frame with the columns of EVENTS, nulls as None."""
    number = lambda column: [None if pd.isna(x) else int(x) for x in column]
    text = lambda column: [x if isinstance(x, str) else None for x in column]
    columns = [number(rows["event_id"]), text(rows["kind"]), text(rows["cart"]), number(rows["amount"]), [bool(x) and not pd.isna(x) for x in rows["ask"]], number(rows["target"]), text(rows["action"]), number(rows["budget"]), number(rows["max_fulfillments"])]
    return (Event(*x) for x in zip(*columns, strict=True))


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    mandate, account, carts, decisions = None, Account(), {}, {}
    for part in parts:
        rows = []
        for m, e in zip(part["mandate"], events_of(part), strict=True):
            if m != mandate:
                mandate, account, carts, decisions = m, Account(), {}, {}
            outcome, account = step(account, carts, decisions, e)
            rows.append((m, e.event_id, outcome, *account))
        yield pd.DataFrame(rows, columns=COLUMNS)


def decided(events: DataFrame) -> DataFrame:
    """OUTCOMES per row of events (EVENTS): the machine run over each mandate's history, one state at a time in sorted partitions.

    Rows without a mandate are left out; an event that came twice is run once.
    """
    ship(events.sparkSession)
    rows = events.select(*(c.split()[0] for c in EVENTS.split(", "))).filter("mandate is not null").dropDuplicates(["mandate", "event_id"])
    return rows.repartition("mandate").sortWithinPartitions("mandate", "ts", "event_id").mapInPandas(_fold, OUTCOMES)
