"""An append-only audit log that a stream writes exactly once, its events chained by digests.

Every event of a session gets a place and a digest of the digest before it and its own payload, so that a changed,
missing or added event breaks the chain from there on. The log is a folder of batches: a batch that is written again
after a failure replaces its own folder and goes on from the heads of the batches before it, so it adds nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritill.sources import storage
from veritill.sources.shipping import ship

LOG = "session string, event_id bigint, event_type string, payload string, created_at timestamp, seq bigint, digest string"
HEADS = "session string, seq bigint, digest string"
#: Batches after which the heads of all sessions are written once more, so that a batch reads no more than so many.
SNAPSHOT = 64


def chained(before: str, event_id: int, event_type: str, payload: str) -> str:
    return hashlib.sha256(f"{before}|{event_id}|{event_type}|{payload}".encode()).hexdigest()


def _chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    session, seq, digest = None, 0, ""
    for part in parts:
        seqs, digests = [], []
        for s, head_seq, head, event_id, kind, payload in zip(*(part[c] for c in ("session", "head_seq", "head", "event_id", "event_type", "payload")), strict=True):
            if s != session:
                session, seq, digest = s, int(head_seq), head
            seq, digest = seq + 1, chained(digest, int(event_id), kind, payload)
            seqs.append(seq)
            digests.append(digest)
        yield part.drop(columns=["head_seq", "head"]).assign(seq=seqs, digest=digests)


class AuditLog:
    """The log in a folder; `append` is what a stream's foreachBatch calls."""

    def __init__(self, path: str):
        self.path = path

    def _heads(self, spark: SparkSession, batch: int) -> DataFrame:
        """The last place and digest of each session before a batch."""
        since = (batch - 1) // SNAPSHOT * SNAPSHOT
        if batch == 0:
            return spark.createDataFrame([], HEADS)
        heads = spark.read.schema(f"{HEADS}, batch int").parquet(f"{self.path}/heads").filter(F.col("batch").between(since, batch - 1))
        return heads.groupBy("session").agg(F.max_by(F.struct("seq", "digest"), "seq").alias("h")).select("session", "h.*")

    def append(self, events: DataFrame, batch: int) -> None:
        """Writes the events (session, event_id, event_type, payload, created_at) of a batch, in order of time and id in each session."""
        spark = events.sparkSession
        ship(spark)
        heads = self._heads(spark, batch)
        known = heads.select("session", F.col("seq").alias("head_seq"), F.col("digest").alias("head"))
        rows = events.select("session", "event_id", "event_type", F.coalesce("payload", F.lit("")).alias("payload"), "created_at").filter("session is not null")
        rows = rows.join(known, "session", "left").fillna({"head_seq": 0, "head": ""})
        rows = rows.repartition("session").sortWithinPartitions("session", "created_at", "event_id")
        rows.mapInPandas(_chain, LOG).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        new = spark.read.schema(LOG).parquet(f"{self.path}/log/batch={batch}").groupBy("session").agg(F.max_by(F.struct("seq", "digest"), "seq").alias("h")).select("session", "h.*")
        if batch % SNAPSHOT == 0 and batch:
            new = heads.join(new, "session", "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{self.path}/heads/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{LOG}, batch int").parquet(f"{self.path}/log")

    def delete(self, spark: SparkSession) -> None:
        storage.delete(spark, self.path)


def timeline(log: DataFrame) -> DataFrame:
    """The events of every session, numbered in the order they were logged in."""
    return log.select("session", F.col("seq").alias("step"), "event_id", "event_type", "created_at", "digest")


def broken(log: DataFrame) -> DataFrame:
    """(session, seq): the events whose place or digest doesn't follow from the one before."""
    w = Window.partitionBy("session").orderBy("seq", "event_id")
    text = F.concat_ws("|", F.coalesce(F.lag("digest").over(w), F.lit("")), F.col("event_id").cast("string"), "event_type", "payload")
    d = log.withColumns({"_right": F.sha2(text, 256), "_place": F.row_number().over(w)})
    return d.filter((F.col("_right") != F.col("digest")) | (F.col("_place") != F.col("seq"))).select("session", "seq")
