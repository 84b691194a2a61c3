"""Operator 11: importance resampling of documents towards a target distribution.

A document's features are its words (runs of up to `longest` of them), hashed into buckets. Higher-order
functions make each row's array of bucket numbers; the buckets' totals over all documents and over all target
texts give a gain per bucket, and a document's weight is the floored mean of its features' gains: an aggregate
over element_at of a literal array, so that scoring shuffles nothing. Only the totals are shuffled, one row per
bucket and task. A Gumbel noise from the id's hash makes the top of weight + noise a draw without replacement
whose odds follow the weights.

The draw counts scores in blocks of 256 values first; only rows from the block that the last place falls in
upwards are ranged by score and id and numbered, in two steps, so that no task holds more than a range of them.

Edge cases: a null or empty text, or one without words, has no features and weight 0; a null doc_id is hashed
as an empty text and comes last among equal scores; repeated rows are counted and ranked one by one; empty
tables give an empty result, or gains without a target; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import documents, scratch, stored

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Values of the score that are counted together before the cut.
BLOCK = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, small letters and characters beyond ASCII, A-Z being lowered and no other letter."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def features_of(words: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """A struct of n_words and buckets, the bucket of every run of 1 to `longest` words of an array."""
    place = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")

    def runs(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: place(F.array_join(F.slice(w, i, n), " ")))

    def both(w: Column) -> Column:
        found = [F.transform(w, place), *(runs(w, n) for n in range(2, longest + 1))]
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.concat(*found).alias("buckets"))

    # an array of one binds the words to a name, so that they are split once
    return F.element_at(F.transform(F.array(words), both), 1)


def bucketed(df: DataFrame, *keep: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """keep, n_words and the array of buckets of each row's text."""
    return df.select(*keep, F.inline(F.array(features_of(words_of(F.col("text")), buckets, longest))))


def totals(rows: DataFrame) -> dict[int, int]:
    """How often each bucket occurs; at most one number per bucket comes to the driver."""
    return {r["bucket"]: r["n"] for r in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed shares of the target and of the source."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def weight(buckets: Column, gain: list[int]) -> Column:
    """The floored mean gain of an array of buckets, 0 without any; the gains are one folded literal."""
    values = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(buckets, F.lit(0).cast("bigint"), lambda a, b: a + F.element_at(values, b + 1))
    n = F.size(buckets).cast("bigint")
    return F.when(n > 0, F.floor(total / n)).otherwise(0).cast("bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `rank`, their place from 1 in an order: ranges of it are stored with their number, counted and numbered inside."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), lasting=True)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("rank", inside).join(before, "_range").withColumn("rank", (F.col("rank") + F.col("_before")).cast("bigint")).drop("_range", "_before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score and rank (null if not drawn); target needs a column text."""
    with scratch():
        rows = stored(bucketed(docs, "doc_id", buckets=buckets, longest=longest))
        gain = gains(totals(rows), totals(bucketed(target, buckets=buckets, longest=longest)), buckets)
        scores = rows.select(F.col("doc_id").cast("bigint"), "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
        # the number of a stored row tells equal rows apart in the draw
        scores = stored(scores.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()}), lasting=True)
        able = F.col("n_words") >= least
        counts = scores.filter(able).groupBy(F.floor(F.col("score") / BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("block")).collect()
        left, cut = percent * sum(r["n"] for r in counts) // 100, None
        draw = left
        for r in counts:
            if left > 0:
                cut, left = r["block"] * BLOCK, left - r["n"]
        columns = ["doc_id", "n_features", "weight", "score"]
        if cut is None:
            return scores.select(*columns, F.lit(None).cast("bigint").alias("rank"))
        high = able & (F.col("score") >= cut)
        ranked = numbered(scores.filter(high), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    ranked = ranked.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return ranked.unionByName(scores.filter(~high).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# crc32 by a table of all bytes, once per distinct word
SQL = rf"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n) ORDER BY n) AS t FROM range(256) r(n)),
doc_words AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS words FROM documents),
bench_words AS (SELECT {_WORDS} AS words FROM benchmark),
source_counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM doc_words) GROUP BY word),
target_counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM bench_words) GROUP BY word),
places AS (
  SELECT word, xor(4294967295, list_reduce(range(length(hex(word)) // 2), lambda c, i: xor(c // 256, t[xor(c, ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT) % 256 + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT word FROM source_counts UNION SELECT word FROM target_counts), crc),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM source_counts JOIN places USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM target_counts JOIN places USING (word) GROUP BY bucket),
gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
weights AS (SELECT k, floor(sum(gain) / count(*))::BIGINT AS weight FROM (SELECT k, unnest(words) AS word FROM doc_words) JOIN places USING (word) JOIN gains USING (bucket) GROUP BY k),
scored AS (
  SELECT k, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (k)),
able AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (k)
"""
