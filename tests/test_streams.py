"""The mandates' state machine, late and repeated events, and the audit log after failures."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from veritill.operators import mandates
from veritill.plans import queries_streams
from veritill.streaming import audit
from veritill.streaming import mandates as streams

EVALUATE = {"kind": "evaluate", "ask": False, "target": None, "action": None, "budget": 90_000, "max_fulfillments": 3}


def walk(*events):
    account, carts, decisions, out = mandates.Account(), {}, {}, []
    for k, e in enumerate(events, 1):
        e = EVALUATE | {"cart": None, "amount": None, "event_id": k} | e
        outcome, account = mandates.step(account, carts, decisions, mandates.Event(**e))
        out.append(outcome)
    return out, account


def test_machine():
    cart = lambda c, amount, **more: {"cart": c, "amount": amount} | more
    resolve = lambda target, action: {"kind": "resolve", "target": target, "action": action}
    assert walk(cart("a", 84_000)) == (["APPROVE"], (84_000, 1, 2, "active"))
    assert walk(cart("a", 96_000)) == (["STEP_UP"], (0, 0, 1, "active"))
    # the same cart again is decided by the state that holds it, and fulfilled once
    assert walk(cart("a", 30_000), cart("a", 30_000), cart("a", 30_001)) == (["APPROVE", "APPROVE", "CART_ID_CONFLICT"], (30_000, 1, 2, "active"))
    assert walk(cart("a", 50_000), cart("b", 50_000)) == (["APPROVE", "HOLD"], (50_000, 1, 2, "active"))
    # an approval by the customer fulfils beyond the budget, once
    assert walk(cart("a", 96_000), resolve(1, "approve_once"), resolve(1, "decline"), cart("b", 1)) == (["STEP_UP", "FULFILLED", "DECISION_ALREADY_RESOLVED", "HOLD"], (96_000, 1, 2, "active"))
    assert walk(cart("a", 5, ask=True), resolve(1, "decline"), cart("a", 5), resolve(3, "approve_once"), resolve(99, "decline"))[0] == ["STEP_UP", "DECLINED", "APPROVE", "DECISION_NOT_RESOLVABLE", "DECISION_NOT_FOUND"]
    # a modified mandate refuses what comes later
    assert walk(cart("a", 96_000), resolve(1, "modify"), cart("b", 10)) == (["STEP_UP", "SUPERSEDED", "HOLD"], (0, 0, 1, "superseded"))
    assert walk(*(cart(c, 10) for c in "abcd"))[0] == ["APPROVE", "APPROVE", "APPROVE", "HOLD"]


def test_events_that_come_late_are_decided_in_their_turn(spark, tmp_path):
    begin = datetime(2026, 1, 1)
    event = lambda k, minutes, cart, amount: ("m", begin + timedelta(minutes=minutes), k, "evaluate", cart, amount, False, None, None, 100, 9)
    beat = lambda hours: (None, begin + timedelta(hours=hours), *[None] * 9)
    batches = [[event(3, 30, "c", 60), event(1, 0, "a", 60)], [event(2, 10, "b", 30), event(3, 30, "c", 60)], [beat(9)], [beat(9)], [event(4, 20, "d", 1), event(5, 600, "e", 10)], [beat(20)]]
    for rows in batches:
        spark.createDataFrame(rows, mandates.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(mandates.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with streams.keyed_state(spark):
        queries_streams.run(spark, streams.outcomes(source, "1 hour"), str(tmp_path))
    got = spark.read.schema(mandates.OUTCOMES).parquet(f"{tmp_path}/out").orderBy("event_id").collect()
    # 2 comes after 3 but is decided before it; 3 comes twice and counts once; 4 is behind the watermark and dropped
    assert [(r.event_id, r.outcome, r.spent) for r in got] == [(1, "APPROVE", 60), (2, "APPROVE", 90), (3, "HOLD", 90), (5, "APPROVE", 100)]


def test_audit_log_is_written_once_and_shows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "SNAPSHOT", 2)
    log = audit.AuditLog(f"file://{tmp_path}/log")
    begin = datetime(2026, 1, 1)
    rows = [(f"s{k % 3}" if k % 7 else None, k, "seen", None if k % 5 == 0 else f"p{k}", begin + timedelta(minutes=k % 4)) for k in range(1, 60)]
    events = spark.createDataFrame(rows, "session string, event_id bigint, event_type string, payload string, created_at timestamp")
    for batch in (0, 1, 1, 2, 3, 3, 4, 5):  # some come again after a failure
        log.append(events.filter(F.col("event_id") % 6 == batch), batch)
    got = log.read(spark)
    want, heads = [], {}
    for batch in range(6):
        for s, k, kind, payload, _ in sorted((r for r in rows if r[0] and r[1] % 6 == batch), key=lambda r: (r[4], r[1])):
            seq, digest = heads.get(s, (0, ""))
            heads[s] = seq + 1, audit.chained(digest, k, kind, payload or "")
            want.append((s, k, *heads[s]))
    assert sorted((r.session, r.event_id, r.seq, r.digest) for r in got.collect()) == sorted(want)
    assert audit.broken(got).count() == 0
    changed = got.withColumn("payload", F.when(F.col("event_id") == 10, "other").otherwise(F.col("payload")))
    assert [tuple(r) for r in audit.broken(changed).collect()] == [tuple(r) for r in got.filter("event_id = 10").select("session", "seq").collect()]
    assert audit.broken(got.filter("event_id <> 10")).count() > 0
    log.delete(spark)


def test_batch_machine_ignores_repeats_and_rows_without_mandate(spark):
    begin = datetime(2026, 1, 1)
    row = ("m", begin, 1, "evaluate", "c", 5, False, None, None, 10, 2)
    df = spark.createDataFrame([row, row, (None, *row[1:])], mandates.EVENTS)
    assert [tuple(r) for r in mandates.decided(df).collect()] == [("m", 1, "APPROVE", 5, 1, 2, "active")]
    assert mandates.decided(df.filter("false")).count() == 0


class Trips:
    """A state of one key in a dict or list, whose reads and writes are counted."""

    def __init__(self):
        self.kept, self.n = {}, 0

    def exists(self):
        self.n += 1
        return bool(self.kept)

    def containsKey(self, key):
        self.n += 1
        return key in self.kept

    def getValue(self, key):
        self.n += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.n += 1
        self.kept[key] = value

    def appendList(self, values):
        self.n += 1
        self.kept.setdefault("list", []).extend(values)


def test_state_is_read_and_written_in_few_trips():
    state = Trips()
    kept, want = streams.Kept(state), {}
    for turn in range(3):
        before = state.n
        for k in range(500):
            assert kept.get(k) == want.get(k)
            kept[k] = want[k] = (turn, k)
        kept.keep()
        assert state.n - before <= 1 + 3 * streams.BUCKETS
    assert {row[0]: tuple(row[1:]) for (rows,) in state.kept.values() for row in rows} == want


def test_waiting_rows_are_kept_many_at_once():
    woken = []
    requests = streams.Requests()
    requests.waiting, requests.handle = Trips(), type("H", (), {"registerTimer": staticmethod(woken.append)})
    begin = datetime(2026, 1, 1)
    part = pd.DataFrame({"ts": [begin + timedelta(seconds=k) for k in range(2_500, 0, -1)], "event_id": range(2_500), "payload": ["p"] * 2_500})
    assert list(requests.handleInputRows(("s", "k"), iter([part]), None)) == []
    assert requests.waiting.n == 1 and sum(len(rows) for (rows,) in requests.waiting.kept["list"]) == 2_500
    assert woken == [int((begin - datetime(1970, 1, 1)).total_seconds() * 1000) + 1001]
