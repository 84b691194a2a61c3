"""Review queues: requests, progress, agreement, imports and adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritill.operators.aggregates import first_seen


def accepted(reviews: DataFrame, order: tuple[str, ...] = ("created_at", "event_id")) -> DataFrame:
    """The first review of each reviewer on an example; later ones are rejected."""
    return first_seen(reviews, ["example_id", "reviewer_id"], list(order))


def queue_state(examples: DataFrame, reviews: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Per example: reviews, distinct verdicts, whether adjudicated, and the queue state."""
    r = reviews.groupBy("example_id").agg(F.count(F.lit(1)).alias("reviews"), F.count_distinct("deviation", "expected_treatment").alias("verdicts"))
    a = adjudications.select("example_id", F.lit(True).alias("adjudicated")).distinct()
    d = examples.select("example_id").join(r, "example_id", "left").join(a, "example_id", "left").na.fill(0, ["reviews", "verdicts"]).na.fill(False, ["adjudicated"])
    n, v = F.col("reviews"), F.col("verdicts")
    return d.withColumn("state", F.when(F.col("adjudicated"), "adjudicated").when(n == 0, "unreviewed").when(n == 1, "single_review").when(v > 1, "needs_adjudication").otherwise("agreed"))


def progress(state: DataFrame) -> DataFrame:
    return state.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def completion(state: DataFrame) -> DataFrame:
    """One row: total, done, and complete / in_progress / not_started."""
    done = F.count(F.when(F.col("state").isin("adjudicated", "agreed"), 1))
    d = state.agg(F.count(F.lit(1)).alias("total"), done.alias("done"))
    return d.withColumn("status", F.when(F.col("done") == F.col("total"), "complete").when(F.col("done") > 0, "in_progress").otherwise("not_started"))


def next_item(state: DataFrame, reviews: DataFrame, reviewer: str) -> DataFrame:
    """The example a reviewer gets next: fewest reviews, then id; not theirs already, below two reviews, not adjudicated."""
    mine = reviews.filter(F.col("reviewer_id") == reviewer).select("example_id").distinct()
    return state.filter(~F.col("adjudicated") & (F.col("reviews") < 2)).join(mine, "example_id", "left_anti").orderBy("reviews", "example_id").limit(1)


def disagreements(reviews: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Unadjudicated examples whose reviewers differ, with their verdicts in reviewer order."""
    g = reviews.groupBy("example_id").agg(F.count_distinct("deviation", "expected_treatment").alias("verdicts"), F.array_sort(F.collect_list(F.struct("reviewer_id", "deviation", "expected_treatment"))).alias("prior"))
    open_ = g.filter(F.col("verdicts") > 1).join(adjudications.select("example_id").distinct(), "example_id", "left_anti")
    return open_.select("example_id", F.to_json("prior").alias("prior_reviews"))


def requests(queue: DataFrame, reviewer: str, columns: list[str]) -> DataFrame:
    """(custom_id, body): one request per queue row, nulls staying in the JSON."""
    return queue.select(F.concat(F.lit(f"{reviewer}:"), "example_id").alias("custom_id"), F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("body"))


def request_problems(prepared: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Requests whose body isn't the recomputed one, or that only one side has."""
    a, b = prepared.select("custom_id", F.col("body").alias("got")), recomputed.select("custom_id", F.col("body").alias("want"))
    d = a.join(b, "custom_id", "full")
    return d.filter(~F.col("got").eqNullSafe(F.col("want"))).select("custom_id", F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").otherwise("changed").alias("problem"))


def retry_set(checked: DataFrame, key: str = "custom_id") -> tuple[DataFrame, DataFrame]:
    """The rows that failed validation, and a histogram of their reasons."""
    bad = checked.filter(F.size("problems") > 0)
    return bad.select(key, "problems"), bad.select(F.explode("problems").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def import_outcome(incoming: DataFrame, stored: DataFrame, key: str, payload: str) -> DataFrame:
    """Incoming rows as new, same or conflict against what is stored."""
    s = stored.select(key, F.col(payload).alias("_stored"), F.lit(True).alias("_has"))
    d = incoming.join(s, key, "left")
    return d.withColumn("outcome", F.when(F.col("_has").isNull(), "new").when(F.col(payload).eqNullSafe(F.col("_stored")), "same").otherwise("conflict")).drop("_stored", "_has")


def exported(examples: DataFrame, resolved: DataFrame) -> DataFrame:
    """Examples with resolved labels where theirs were unreviewed; reviewed rows stay."""
    r = resolved.filter("state <> 'unresolved'").select("example_id", F.col("deviation").alias("_d"), F.col("expected_treatment").alias("_t"), F.lit(True).alias("_has"))
    d = examples.join(r, "example_id", "left")
    use = F.col("_has").isNotNull() & (F.col("label_source") == "unreviewed")
    return d.withColumns({"deviation": F.when(use, F.col("_d")).otherwise(F.col("deviation")), "expected_treatment": F.when(use, F.col("_t")).otherwise(F.col("expected_treatment")), "label_source": F.when(use, "reviewed").otherwise(F.col("label_source"))}).drop("_d", "_t", "_has")


def upsert_unreviewed(store: DataFrame, incoming: DataFrame, order: Column, key: str = "example_id") -> DataFrame:
    """The store with incoming rows put in: new keys, and keys whose stored row is unreviewed; the last of a key counts."""
    w = Window.partitionBy(key).orderBy(order.desc())
    last = incoming.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").select(*store.columns)
    replaceable = store.filter("label_source = 'unreviewed'").select(key)
    fixed = store.select(key).join(replaceable, key, "left_anti")
    fresh = last.join(fixed, key, "left_anti")
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def rater_agreement(reviews: DataFrame) -> DataFrame:
    """(pairs, agreed, rate) over the first two reviewers of each example."""
    g = reviews.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("reviewer_id", "deviation"))).alias("r")).filter(F.size("r") >= 2)
    same = (F.col("r")[0]["deviation"] == F.col("r")[1]["deviation"]).cast("bigint")
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.sum(same).alias("agreed"), F.avg(same.cast("double")).alias("rate"))


def backed_adjudications(reviews: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(adjudications, backed): how many final verdicts there are, and how many settle a disagreement of reviewers."""
    verdicts = reviews.groupBy("example_id").agg(F.count_distinct("deviation").alias("_v"))
    return adjudications.join(verdicts, "example_id", "left").agg(F.count(F.lit(1)).alias("adjudications"), F.count(F.when(F.col("_v") > 1, 1)).alias("backed"))


def ordered_audit(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The timeline of each key, ties settled by the last order column."""
    return events.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
