"""Queries over mandates' state machines, idempotent requests and the audit log, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritill.operators import mandates
from veritill.sources import storage, views
from veritill.streaming import audit
from veritill.streaming import mandates as mandate_streams

from .oracle import h8
from .registry import query

#: Micro-batches that the events of a stream query are shuffled into.
BATCHES = 3


def mandate_events(spark, sf_dir):
    """Evaluations of carts that come again, some with another amount, and resolutions of the decision before them."""
    e = views.table(spark, sf_dir, "events")
    user, number = F.col("user_id"), F.col("event_id")
    resolve = F.col("event_type") == "click"
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    target = F.last(F.when(~resolve, number), ignorenulls=True).over(before)
    amount = 1000 + views.h8("cart", user, number % 12) % 9000 + F.when((F.col("event_type") == "error") & (number % 4 == 0), 1).otherwise(0)
    action = F.when(number % 5 < 2, "approve_once").when(number % 5 < 4, "decline").otherwise("modify")
    unless = lambda c: F.when(~resolve, c)
    return e.select(
        F.concat(F.lit("m_"), user.cast("string")).alias("mandate"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(resolve, "resolve").otherwise("evaluate").alias("kind"),
        unless(F.concat(F.lit("c_"), (number % 12).cast("string"))).alias("cart"), unless(amount).cast("bigint").alias("amount"), unless(F.col("event_type") == "signup").alias("ask"),
        F.when(resolve, target).alias("target"), F.when(resolve, action).alias("action"), (20_000 + views.h8("budget", user) % 30_000).alias("budget"), (user % 4 + 2).cast("int").alias("max_fulfillments"),
    )


_AMOUNT = f"1000 + ({h8(chr(39) + 'cart' + chr(39), 'user_id', 'event_id % 12')}) % 9000 + CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 1 ELSE 0 END"
_EVENTS = f"""v_events AS (SELECT 'm_' || user_id AS mandate, ts, event_id AS id, event_type = 'click' AS resolves, 'c_' || event_id % 12 AS cart, {_AMOUNT} AS amount, event_type = 'signup' AS ask,
    last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target,
    CASE WHEN event_id % 5 < 2 THEN 'approve_once' WHEN event_id % 5 < 4 THEN 'decline' ELSE 'modify' END AS action, 20000 + ({h8("'budget'", 'user_id')}) % 30000 AS budget, CAST(user_id % 4 + 2 AS INTEGER) AS most,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""
# a walk step by step: what each event sees is looked up in the lists of carts, decisions and resolutions so far
_WALK = """v_walk AS (
  SELECT mandate, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS outcome, 0::BIGINT AS spent, 0 AS fulfillments, 1 AS version, 'active' AS status,
    []::STRUCT(cart VARCHAR, amount BIGINT)[] AS carts, []::VARCHAR[] AS filled, []::STRUCT(id BIGINT, outcome VARCHAR, cart VARCHAR, amount BIGINT)[] AS decisions, []::BIGINT[] AS resolved FROM (SELECT DISTINCT mandate FROM v_events)
  UNION ALL
  SELECT mandate, k, id, o, spent + CASE WHEN fills THEN sum_in ELSE 0 END, fulfillments + fills::INTEGER, version + fills::INTEGER, CASE WHEN o = 'SUPERSEDED' THEN 'superseded' ELSE status END,
    CASE WHEN resolves OR known IS NOT NULL THEN carts ELSE list_append(carts, {'cart': cart, 'amount': amount}) END, CASE WHEN fills THEN list_append(filled, cart_in) ELSE filled END,
    CASE WHEN resolves OR o = 'CART_ID_CONFLICT' THEN decisions ELSE list_append(decisions, {'id': id, 'outcome': o, 'cart': cart, 'amount': amount}) END,
    CASE WHEN o IN ('FULFILLED', 'DECLINED', 'SUPERSEDED') THEN list_append(resolved, target) ELSE resolved END
  FROM (SELECT *, CASE WHEN resolves THEN d.cart ELSE cart END AS cart_in, CASE WHEN resolves THEN d.amount ELSE amount END AS sum_in,
      o IN ('APPROVE', 'FULFILLED') AND NOT list_contains(filled, CASE WHEN resolves THEN d.cart ELSE cart END) AS fills
    FROM (SELECT *, CASE
        WHEN resolves AND d IS NULL THEN 'DECISION_NOT_FOUND' WHEN resolves AND list_contains(resolved, target) THEN 'DECISION_ALREADY_RESOLVED' WHEN resolves AND d.outcome <> 'STEP_UP' THEN 'DECISION_NOT_RESOLVABLE'
        WHEN resolves THEN CASE action WHEN 'approve_once' THEN 'FULFILLED' WHEN 'modify' THEN 'SUPERSEDED' ELSE 'DECLINED' END
        WHEN known.amount <> amount THEN 'CART_ID_CONFLICT' WHEN status <> 'active' OR fulfillments >= most OR (spent + amount > budget AND spent > 0) THEN 'HOLD'
        WHEN spent + amount > budget OR ask THEN 'STEP_UP' ELSE 'APPROVE' END AS o
      FROM (SELECT w.* EXCLUDE (k, event_id, outcome), e.* EXCLUDE (mandate), list_filter(w.carts, lambda x: x.cart = e.cart)[1] AS known, list_filter(w.decisions, lambda x: x.id = e.target)[1] AS d
        FROM v_walk w JOIN v_events e ON e.mandate = w.mandate AND e.k = w.k + 1))))"""
_MACHINE = f"WITH RECURSIVE {_EVENTS}, {_WALK} SELECT mandate, event_id, outcome, spent, fulfillments, version, status FROM v_walk WHERE event_id IS NOT NULL"


@query("z1_z2_z4_mandate_machine", _MACHINE)
def z1_z2_z4_mandate_machine(spark, sf_dir):
    """Every event's outcome and the state after it, by one fold per mandate."""
    return mandates.decided(mandate_events(spark, sf_dir))


def shuffled_batches(events: DataFrame, top: str, by: str) -> None:
    """The events as files of a source, dealt into micro-batches by a hash, so that each holds events of all times."""
    for k in range(BATCHES):
        events.filter(F.pmod(F.xxhash64(by), F.lit(BATCHES)) == k).coalesce(1).write.mode("append").parquet(top)


def run(spark: SparkSession, stream: DataFrame, top: str) -> None:
    """Runs a stream over all that its source holds into a table of parquet files."""
    stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def closed_source(spark: SparkSession, events: DataFrame, top: str) -> tuple[DataFrame, str]:
    """A stream over the events in shuffled micro-batches and a heartbeat behind them, and how late its events may be."""
    shuffled_batches(events, f"{top}/in", "event_id")
    span = events.agg((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("s"), F.unix_seconds(F.max("ts")).alias("newest")).first()
    late = (span["s"] or 0) + 60
    beat = spark.range(1).select(F.timestamp_seconds(F.lit((span["newest"] or 0) + 2 * late)).alias("ts"))
    spark.createDataFrame([], events.schema).unionByName(beat, allowMissingColumns=True).write.mode("append").parquet(f"{top}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"), f"{late} seconds"


def streamed(spark: SparkSession, events: DataFrame, stream_of, schema: str) -> DataFrame:
    """The stored rows of a keyed stream over the events; what the stream wrote itself is deleted."""
    top = f"{storage.checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = storage.stored(events)
    source, late = closed_source(spark, events, top)
    with mandate_streams.keyed_state(spark):
        run(spark, stream_of(source, late), top)
    out = storage.stored(spark.read.schema(schema).parquet(f"{top}/out"))
    storage.delete(spark, top)
    storage.release(events)
    return out


@query("z1_z2_z4_mandate_stream", _MACHINE)
def z1_z2_z4_mandate_stream(spark, sf_dir):
    """The same from events that arrive in shuffled micro-batches, in typed state with timers of event time."""
    return streamed(spark, mandate_events(spark, sf_dir), mandate_streams.outcomes, mandates.OUTCOMES)


_ANSWERS = """SELECT CAST(user_id % 5 AS VARCHAR) AS scope, CAST(event_id % 1500 AS VARCHAR) AS key, event_id, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN p = first_value(p) OVER w THEN 'replay' ELSE 'conflict' END AS status, first_value(event_id) OVER w AS answered_by
    FROM (SELECT *, event_type || ':' || (event_id % 2) AS p FROM events) WINDOW w AS (PARTITION BY user_id % 5, event_id % 1500 ORDER BY ts, event_id)"""


@query("z3_idempotent_stream", _ANSWERS)
def z3_idempotent_stream(spark, sf_dir):
    """Requests that arrive out of order: the first of each key, replays of it and conflicts with it."""
    e = views.table(spark, sf_dir, "events")
    payload = F.concat_ws(":", "event_type", (F.col("event_id") % 2).cast("string"))
    requests = e.select((F.col("user_id") % 5).cast("string").alias("scope"), (F.col("event_id") % 1500).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", payload.alias("payload"))
    return streamed(spark, requests, mandate_streams.answers, mandate_streams.ANSWERS)


_LOG = """WITH RECURSIVE v_log AS (SELECT 'm_' || user_id AS session, event_id, event_type, '{"value":' || CAST(event_id % 1000 AS VARCHAR) || '}' AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, ts, event_id) AS seq FROM events),
    v_chain AS (SELECT session, event_id, event_type, seq, sha256('|' || event_id || '|' || event_type || '|' || payload) AS digest FROM v_log WHERE seq = 1
      UNION ALL SELECT e.session, e.event_id, e.event_type, e.seq, sha256(c.digest || '|' || e.event_id || '|' || e.event_type || '|' || e.payload) FROM v_chain c JOIN v_log e ON e.session = c.session AND e.seq = c.seq + 1)
    SELECT session, seq AS step, event_id, event_type, digest FROM v_chain"""


@query("z6_audit_log", _LOG)
def z6_audit_log(spark, sf_dir):
    """Timelines read from the log that a stream wrote, whose second batch came twice."""
    top = f"{storage.checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    log = audit.AuditLog(f"{top}/log")
    e = views.table(spark, sf_dir, "events").select(F.concat(F.lit("m_"), F.col("user_id").cast("string")).alias("session"), "event_id", "event_type", F.format_string('{"value":%d}', F.col("event_id") % 1000).alias("payload"), F.col("ts").cast("timestamp").alias("created_at"))
    for k in range(BATCHES):
        e.filter(F.col("event_id") % BATCHES == k).coalesce(1).write.mode("append").parquet(f"{top}/in")
    schema = e.schema

    def append(batch: DataFrame, number: int) -> None:
        for _ in range(2 if number == 1 else 1):
            log.append(batch, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    out = storage.stored(audit.timeline(log.read(spark)).select("session", "step", "event_id", "event_type", "digest"))
    storage.delete(spark, top)
    return out
