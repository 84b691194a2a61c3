"""Operator 4: mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their id and text. Every pass over a source puts one entry per document in
the queue, with a virtual finish time: its source's running word total, the entry included, over the source's
target; the document that a source's target falls in is queued in two parts. The queue of all sources is
range-sorted by virtual finish and truncated where its running total reaches the total budget; what a
document's entries hold before that point is taken.

Running totals come in two steps. Inside a source: totals of buckets of the shuffle key, then rows inside a
bucket, so that a source that holds a third of all rows is spread over many tasks. Over the queue: slices of
virtual time, in which each source is served at an even rate, so that equal slices hold about equal numbers of
words whatever the sources' sizes; their totals are summed over blocks of slices, then inside a block.

Edge cases: a null or empty text has size 0 and is taken 0 words; so is all of a source whose target is below one word; a null source is a source of its own, the
last; rows that share an id, or have none, are shuffled by their texts; repeated rows are shuffled side by side
and served one after the other, and which of them a tie serves first makes no difference; an empty table gives
an empty result; columns other than doc_id, source and text are ignored. The window that ranks sources runs
over one row per source, not per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import ROW_KEY, documents, in_arrow, row_key, scratch, stored, unused, word_slices

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
#: Bits of the shuffle key that make a bucket.
BUCKET_BITS = 14
#: Slices of virtual time in which a target is served, and slices that make a block.
SLICES, BLOCK = 16_384, 128


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, w in word_slices(batch["text"], lower=False):
            yield pa.RecordBatch.from_arrays([*(batch[k].slice(i, j - i) for k in ("doc_id", "row_key", "source", "place")), pa.array(w.counts, pa.int64())], ["doc_id", "row_key", "source", "place", "size"])


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, source, size, source_key, place, bucket) per row, in a stored table; place is the shuffled order."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    place = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint"), row_key(docs).alias("row_key"), F.col("source").cast("string"), place.alias("place"), F.col("text").cast("string"))
    rows = in_arrow(rows, _count, f"doc_id bigint, row_key {ROW_KEY}, source string, place bigint, size bigint")
    return stored(rows.withColumns({"source_key": F.xxhash64("source"), "bucket": F.shiftright("place", 60 - BUCKET_BITS)}))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(source_key, source_size, target) per source: shares by weight, held at `most` times the size, the excess reshared."""
    sources = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    # in the order in which sources fill up, a source is held if its share of what the earlier ones leave reaches its cap
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumns({"budget": share * F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "filled": F.coalesce(F.sum("cap").over(earlier), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(earlier), F.lit(0))})
    held = (F.col("budget") - F.col("filled")) * F.col("weight") >= F.col("cap").cast("double") * (F.col("all_weight") - F.col("gone"))
    ranked = ranked.withColumn("held", held)
    rest = ranked.withColumns({"held_cap": F.sum(F.when(F.col("held"), F.col("cap")).otherwise(0)).over(everything), "free_weight": F.sum(F.when(F.col("held"), 0).otherwise(F.col("weight"))).over(everything)})
    level = (F.col("budget") - F.col("held_cap")) * F.col("weight") / F.col("free_weight")
    return rest.select("source_key", "source_size", F.when(F.col("held"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def ordered(rows: DataFrame) -> DataFrame:
    """rows with `turn`, a number inside their source and bucket, and `start`, the words of their source before them."""
    inside = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size", "row_key")
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("total"))
    totals = totals.select("source_key", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumns({"turn": F.row_number().over(inside), "inside": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.join(totals, ["source_key", "bucket"]).withColumn("start", F.col("base") + F.col("inside") - F.col("size")).drop("base", "inside")


def queued(rows: DataFrame, most: int = MOST_PASSES) -> DataFrame:
    """The queue: (words, finish) per entry beside the columns of rows (start, size, source_size, limit), limit being the target in whole words.

    A source whose target is below a word has no entries.
    """
    rows = rows.filter("limit > 0")
    passes = F.explode(F.transform(F.array(*map(F.lit, range(most))), lambda k: F.col("start") + k * F.col("source_size"))).alias("from")
    entry = rows.select("*", passes).withColumn("cut", F.least(F.greatest(F.col("limit") - F.col("from"), F.lit(0)), "size"))
    # the part up to the target, then the part beyond it; most documents have only one of them
    parts = F.array(F.struct(F.col("cut").alias("words"), (F.col("from") + F.col("cut")).alias("end")), F.struct((F.col("size") - F.col("cut")).alias("words"), (F.col("from") + F.col("size")).alias("end")))
    entry = entry.select("*", F.explode(F.filter(parts, lambda x: x["words"] > 0)).alias("part"))
    return entry.select(*rows.columns, F.col("part.words").alias("words"), (F.col("part.end") / F.col("limit")).alias("finish"))


def served(queue: DataFrame, budget: Column) -> DataFrame:
    """The queue with `got`: the words of each entry before the running total, in order of finish, reaches the budget."""
    queue = queue.withColumn("slice", F.floor(F.col("finish") * SLICES)).withColumn("block", F.floor(F.col("slice") / BLOCK))
    slices = queue.groupBy("block", "slice").agg(F.sum("words").alias("total"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = slices.groupBy("block").agg(F.sum("total").alias("total")).select("block", F.coalesce(F.sum("total").over(earlier().orderBy("block")), F.lit(0)).alias("blocks_before"))
    slices = slices.select("block", "slice", F.coalesce(F.sum("total").over(earlier("block").orderBy("slice")), F.lit(0)).alias("slices_before")).join(blocks, "block")
    inside = Window.partitionBy("slice").orderBy("finish", "source_key", "bucket", "turn").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.drop("block").withColumn("inside", F.sum("words").over(inside)).join(slices.drop("block"), "slice")
    before = F.col("blocks_before") + F.col("slices_before") + F.col("inside") - F.col("words")
    return queue.withColumn("got", F.greatest(F.lit(0), F.least(F.col("words"), budget - before)))


def _queue(docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Per row of docs: doc_id, row_key, size, source_size, target, taken and virtual_finish (of the first pass)."""
    with scratch():
        sizes = sized(docs)
        goals = stored(targets(sizes, weights, share, most).withColumn("limit", F.floor("target")))
        budget = F.lit(goals.agg(F.sum("limit")).first()[0] or 0)
        rows = stored(ordered(sizes).join(goals, "source_key"), lasting=True)
    keys = ["source_key", "bucket", "turn"]
    got = served(queued(rows.select(*keys, "start", "size", "source_size", "limit"), most), budget).groupBy(*keys).agg(F.sum("got").alias("taken"))
    finish = F.when(F.col("limit") > 0, (F.col("start") + F.col("size")) / F.col("limit"))
    return rows.join(got, keys, "left").select("doc_id", "row_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), finish.alias("virtual_finish"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken and virtual_finish (of the first pass), in queue order."""
    queue = _queue(docs, weights, share, most).drop("row_key")
    return queue.orderBy(F.col("virtual_finish").asc_nulls_last(), "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it; a last part counts as one if at least half was taken.

    Rows of size 0 go; rows without an id and rows that share one are mixed apart; the copies of repeated rows are
    shared out evenly among them; extra columns pass through, whatever their names.
    """
    columns, (key, many, turn) = docs.columns, unused(docs, "key", "copies", "turn")
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0)
    taken = _queue(docs, WEIGHTS, SHARE, MOST_PASSES).groupBy(F.col("row_key").alias(key)).agg(F.struct(F.sum(copies).alias("all"), F.count(F.lit(1)).alias("rows")).alias(many)).filter(F.col(many)["all"] > 0)
    rows = docs.withColumn(key, row_key(docs)).join(taken, key).withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    # every one of the repeated rows has an even share, the first ones what is left over
    own = F.floor((F.col(many)["all"] + F.col(many)["rows"] - F.col(turn)) / F.col(many)["rows"]).cast("int")
    return rows.withColumn(turn, own).filter(F.col(turn) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(turn))).alias(turn)).select(*columns)


SQL_MIX = r"""
mix_rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS place FROM {docs}),
mix_sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM mix_rows GROUP BY source),
mix_ranked AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][CAST((rank - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM mix_sources)),
mix_filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER o, 0) AS filled, coalesce(sum(weight) OVER o, 0) AS gone
  FROM mix_ranked WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix_held AS (SELECT *, (budget - filled) * weight >= cap::DOUBLE * (all_weight - gone) AS held FROM mix_filled),
mix_targets AS (
  SELECT source, source_size, CASE WHEN held THEN cap::DOUBLE
    ELSE (budget - sum(CASE WHEN held THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN held THEN 0 ELSE weight END) OVER () END AS target FROM mix_held),
mix_queue AS (
  SELECT r.doc_id, r.source, r.place, r.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS lim,
    CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY place, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS finish
  FROM mix_rows r JOIN mix_targets t ON r.source IS NOT DISTINCT FROM t.source),
mix_passes AS (
  SELECT *, finish - size + k * source_size AS begin, least(greatest(lim - (finish - size + k * source_size), 0), size) AS cut FROM mix_queue, (VALUES (0), (1)) p(k) WHERE lim > 0),
mix_parts AS (
  SELECT doc_id, source, place, size, cut AS words, (begin + cut) / lim AS time FROM mix_passes WHERE cut > 0
  UNION ALL SELECT doc_id, source, place, size, size - cut, (begin + size) / lim FROM mix_passes WHERE size > cut),
mix_served AS (
  SELECT doc_id, source, place, size, words, sum(words) OVER (ORDER BY time, source NULLS LAST, place, doc_id ROWS UNBOUNDED PRECEDING) - words AS before FROM mix_parts),
mix_taken AS (
  SELECT doc_id, source, place, size, sum(greatest(0, least(words, (SELECT sum(floor(target)) FROM mix_targets) - before))) AS taken FROM mix_served GROUP BY ALL),
mixed AS (
  SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, CASE WHEN lim > 0 THEN finish / lim END AS virtual_finish
  FROM mix_queue q LEFT JOIN mix_taken t ON t.doc_id = q.doc_id AND t.place = q.place AND t.source IS NOT DISTINCT FROM q.source)
"""

SQL = f"WITH {SQL_MIX.format(docs='documents')} SELECT * FROM mixed"
