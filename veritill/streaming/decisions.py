"""The decision state as a streaming job: one state per mandate, the same outcomes as the batch fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veritill.operators import stateful
from veritill.sources.shipping import ship

OUTPUT = "mandate string, event_id bigint, outcome string, spent bigint"
STATE = "spent bigint, fulfilled int, active boolean"


def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events of one mandate in a micro-batch, in order of time and id; an event that comes in a later batch is decided after all of this one."""
    spent, fulfilled, active = state.get if state.exists else (0, 0, True)
    rows = []
    for e in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples(index=False):
        outcome, spent, fulfilled, active = stateful.decide(spent, fulfilled, active, e.kind, int(e.amount), int(e.budget), int(e.max_fulfillments))
        rows.append((key[0], int(e.event_id), outcome, int(spent)))
    state.update((int(spent), int(fulfilled), bool(active)))
    yield pd.DataFrame(rows, columns=["mandate", "event_id", "outcome", "spent"])


def decisions(events: DataFrame) -> DataFrame:
    """A stream of decisions from a stream of events (see operators.stateful.fold_decisions for the columns)."""
    ship(events.sparkSession)
    return events.groupBy("mandate").applyInPandasWithState(decide, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def hourly_outcomes(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Outcomes per hour of event time, late rows within the watermark included."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
