"""The mandates' state machine as a stream, in order of event time however the events arrive.

Idempotent requests are answered by the same means. An event waits in its key's state until the watermark has passed it; then all that came before it are decided
first. Events behind the watermark that the batch before began with are dropped, and counted by Spark (numRowsDroppedByWatermark). A heartbeat, a row
without a key, moves the watermark of a quiet stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, MutableMapping
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veritill.operators import mandates
from veritill.sources.shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWERS = "scope string, key string, event_id bigint, status string, answered_by bigint"
#: Buckets that a map of a key's state is kept in, and rows that wait in one value of it: every value is a trip to the state store.
BUCKETS, ROWS = 4, 1_000
WAITING = "kind string, cart string, amount bigint, ask boolean, target bigint, action string, budget bigint, max_fulfillments int"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep typed state; a stream reads the setting when it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Kept(MutableMapping):
    """A map of the state whose pairs lie in buckets: those that a turn asks for are read once, those that it changes written once, by `keep`."""

    def __init__(self, state: MapState):
        self.state = state
        self.held: dict[int, dict] = {}
        self.changed: set[int] = set()
        self.empty: bool | None = None

    def _bucket(self, key: Any) -> tuple[int, dict]:
        k = zlib.crc32(str(key).encode()) % BUCKETS
        if k not in self.held:
            if self.empty is None:
                self.empty = not self.state.exists()
            there = not self.empty and self.state.containsKey((k,))
            self.held[k] = {row[0]: tuple(row[1:]) for row in self.state.getValue((k,))[0]} if there else {}
        return k, self.held[k]

    def keep(self) -> None:
        """Writes what was changed and forgets what was read: the next turn may be another key's."""
        for k in self.changed:
            self.state.updateValue((k,), ([(key, *value) for key, value in self.held[k].items()],))
        self.held, self.changed, self.empty = {}, set(), None

    def __getitem__(self, key: Any) -> tuple:
        return self._bucket(key)[1][key]

    def __setitem__(self, key: Any, value: tuple) -> None:
        k, rows = self._bucket(key)
        rows[key] = value
        self.changed.add(k)

    def __delitem__(self, key: Any) -> None:
        k, rows = self._bucket(key)
        del rows[key]
        self.changed.add(k)

    def __iter__(self) -> Iterator:
        raise TypeError("not iterated")

    def __len__(self) -> int:
        raise TypeError("not counted")


class InOrder(StatefulProcessor):
    """Rows (ts, event_id and others) of a key in order of time and id, each once, whatever order they come in."""

    waiting_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"rows array<struct<{', '.join(c.replace(' ', ': ', 1) for c in ('at bigint', 'event_id bigint', *self.waiting_schema.split(', ')))}>>")

    def values(self, rows: pd.DataFrame) -> Iterator[tuple[int, tuple]]:
        """(event_id, what the state keeps of a row until its turn)."""
        raise NotImplementedError

    def take(self, key: tuple, due: list[tuple[int, tuple]]) -> pd.DataFrame:
        """The output of some rows whose turn has come."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            came = [(at, event_id, *values) for at, (event_id, values) in zip(part["ts"].astype("datetime64[us]").astype("int64").tolist(), self.values(part), strict=True)]
            if came:
                self.waiting.appendList(self._chunks(came))
                first = min(came[0][0] if first is None else first, min(x[0] for x in came))
        if first is not None:
            self._wake(first)
        return iter(())

    @staticmethod
    def _chunks(rows: list[tuple]) -> list[tuple[list[tuple]]]:
        return [(rows[k : k + ROWS],) for k in range(0, len(rows), ROWS)]

    def _wake(self, at: int) -> None:
        """A timer for the first millisecond that is wholly behind an event."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # an event that came twice counts as it came last
        held = {(row[0], row[1]): tuple(row[2:]) for chunk in self.waiting.get() for row in chunk[0]}
        due = sorted(k for k in held if k[0] < passed)
        if due:
            rest = sorted(held.keys() - due)
            if rest:
                self.waiting.put(self._chunks([(*k, *held[k]) for k in rest]))
                self._wake(rest[0][0])
            else:
                self.waiting.clear()
            yield self.take(key, [(k[1], held[k]) for k in due])
        elif held:
            self._wake(min(held)[0])

    def close(self) -> None:
        pass


class Machine(InOrder):
    """The state of one mandate: its account, the carts it has seen and its decisions."""

    waiting_schema = WAITING

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.account = handle.getValueState("account", "spent bigint, fulfillments int, version int, status string")
        self.carts = Kept(handle.getMapState("carts", "bucket int", "rows array<struct<cart: string, amount: bigint, fulfilled: boolean>>"))
        self.decisions = Kept(handle.getMapState("decisions", "bucket int", "rows array<struct<event_id: bigint, outcome: string, cart: string, amount: bigint, resolved: boolean>>"))

    def values(self, rows: pd.DataFrame) -> Iterator[tuple[int, tuple]]:
        return ((e.event_id, tuple(e[1:])) for e in mandates.events_of(rows))

    def take(self, key: tuple, due: list[tuple[int, tuple]]) -> pd.DataFrame:
        account = mandates.Account(*self.account.get()) if self.account.exists() else mandates.Account()
        out = []
        for event_id, values in due:
            outcome, account = mandates.step(account, self.carts, self.decisions, mandates.Event(event_id, *values))
            out.append((key[0], event_id, outcome, *account))
        self.account.update(tuple(account))
        self.carts.keep()
        self.decisions.keep()
        return pd.DataFrame(out, columns=mandates.COLUMNS)


class Requests(InOrder):
    """The first request of one key: its payload's hash and what answers later ones."""

    waiting_schema = "payload string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getValueState("first", "payload string, event_id bigint")

    def values(self, rows: pd.DataFrame) -> Iterator[tuple[int, tuple]]:
        return ((int(k), (p,)) for k, p in zip(rows["event_id"], rows["payload"], strict=True))

    def take(self, key: tuple, due: list[tuple[int, tuple]]) -> pd.DataFrame:
        first = tuple(self.first.get()) if self.first.exists() else None
        out = []
        for event_id, (payload,) in due:
            status = "first" if first is None else "replay" if payload == first[0] else "conflict"
            if first is None:
                first = payload, event_id
                self.first.update(first)
            out.append((*key, event_id, status, first[1]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])


def outcomes(events: DataFrame, late: str) -> DataFrame:
    """A stream of OUTCOMES from a stream of EVENTS, each decided once the watermark, `late` behind the newest event, has passed it.

    Start it inside keyed_state.
    """
    ship(events.sparkSession)
    return _timed(events, late, "mandate").groupBy("mandate").transformWithStateInPandas(Machine(), mandates.OUTCOMES, "append", "eventTime")


def answers(requests: DataFrame, late: str) -> DataFrame:
    """A stream of ANSWERS from a stream of requests (scope, key, ts, event_id, payload): the first of a key, replays that it answers, and conflicts.

    Keys are kept as long as the checkpoint, each with a hash of its first payload. Start it inside keyed_state.
    """
    ship(requests.sparkSession)
    rows = _timed(requests, late, "key").select("scope", "key", "ts", "event_id", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload"))
    return rows.groupBy("scope", "key").transformWithStateInPandas(Requests(), ANSWERS, "append", "eventTime")


def _timed(rows: DataFrame, late: str, key: str) -> DataFrame:
    # the condition names the time, else it would be pushed below the watermark, which then wouldn't see heartbeats
    return rows.withWatermark("ts", late).filter(f"case when ts is not null then {key} is not null end")
