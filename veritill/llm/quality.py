"""Operator 3: quality rules with cross-document line frequency.

Every line is normalised (A-Z lowered, words joined by one blank) and hashed. Per host (`source`) the
distinct documents that hold a line are counted: texts of equal words (A-Z lowered) count once, so that
copies of a document don't turn its own lines into boilerplate; near copies count one by one.
Lines above the limit are removed; a document that keeps too few of its words is rejected. A host has at most
distinct lines per document / MAX_SHARE frequent lines; they are broadcast if there are at most BROADCAST_LINES.

Edge cases: a null or empty text has no words and fails the base rules; a null source is a host of its
own; repeated rows each get the verdict of their text, and rows of one doc_id with other texts are judged
apart; an empty table gives an empty result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import LOWER, ROW_KEY, Words, documents, in_arrow, mix, powers, row_key, span_hashes, stored, unused, windows, word_slices

#: A line is boilerplate above both of these: documents of its host, and share of the host's documents.
MIN_DOCS = 20
MAX_SHARE = 0.01
#: A document is depleted if it keeps a smaller share of its words.
MIN_LEFT = 0.3
#: Most frequent lines (16 bytes each) that are broadcast; more are joined by shuffles, hot ones split by the adaptive plan.
BROADCAST_LINES = 1_000_000
#: The fixed rules: fewest words, and most percent of words in repeated three-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = (
    f"doc_id bigint, row_key {ROW_KEY}, host bigint, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, line_words array<bigint>"
)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _stats(w: Words) -> dict[str, np.ndarray | list]:
    n = len(w.counts)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    out: dict = {"n_words": w.counts}
    out["word_chars"] = _per_row(w.solid & ((w.data & 0xC0) != 0x80), w.offsets)
    out["n_symbols"] = _per_row(_SYMBOL[w.data], w.offsets)
    # words in three-word windows that occur twice
    covered = np.zeros(len(w.starts), bool)
    if len(w.starts) >= 3:
        at = np.flatnonzero(w.row[2:] == w.row[:-2])
        _, inverse, counts = np.unique(windows(w.hashes(), 3)[at] ^ salt[w.row[at]], return_inverse=True, return_counts=True)
        at = at[counts[inverse] > 1]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=n)
    # lines that have a word
    breaks = np.unique(np.concatenate([w.offsets[:-1], np.flatnonzero(w.data == 10) + 1]))
    of = np.searchsorted(breaks, w.starts, "right") - 1
    head = np.flatnonzero(np.diff(of, prepend=-1))
    words = np.diff(np.append(head, len(of)))
    line, row = of[head], w.row[head]
    ends = np.append(breaks, len(w.data))[line + 1]
    ends = ends - (w.data[ends - 1] == 10)
    exact = span_hashes(w.data, breaks[line], ends)
    _, first = np.unique(exact ^ salt[row], return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)
    # their normalised hashes, and that of the whole text
    lowered = span_hashes(LOWER[w.data], w.starts, w.ends)
    up, down = powers(len(lowered) + 1)
    sums = np.zeros(len(lowered) + 1, np.uint64)
    np.cumsum(lowered * up[: len(lowered)], out=sums[1:])
    h = mix((sums[head + words] - sums[head]) * down[head])
    out["text_key"] = mix((sums[w.first[1:]] - sums[w.first[:-1]]) * down[w.first[:-1]]).view(np.int64)
    _, first, inverse = np.unique(h ^ salt[row], return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=words).astype(np.int64)
    order = np.argsort(first)
    first = first[order]
    at = np.searchsorted(row[first], np.arange(n + 1))
    for name, v in (("lines", h[first].view(np.int64)), ("line_words", total[order])):
        out[name] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, w in word_slices(batch["text"], lower=False):
            out = _stats(w)
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": rows["doc_id"], "row_key": rows["row_key"], "host": rows["host"]} | {k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in out.items()}
                | {k: out[k] for k in ("lines", "line_words")}
            ).select([x.split()[0] for x in STATS.split(", ")])


def line_statistics(docs: DataFrame) -> DataFrame:
    """One row per document with its base figures and its distinct lines, in a stored table."""
    rows = docs.select(F.col("doc_id").cast("bigint"), row_key(docs).alias("row_key"), F.xxhash64("source").alias("host"), F.col("text").cast("string"))
    return stored(in_arrow(rows, _measure, STATS))


def frequent_lines(stats: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line) of the lines that more distinct documents of their host hold than the limits allow."""
    lines = stats.select("host", "text_key", F.explode("lines").alias("line"))
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    held = lines.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"))
    return held.filter(F.col("held") > min_docs).join(hosts, "host").filter(F.col("held") > max_share * F.col("docs")).select("host", "line")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Per row of docs: the base figures, removed_words, base_failed, depleted and kept; row_key joins it back (see textops)."""
    stats = line_statistics(docs)
    flagged = stored(frequent_lines(stats, min_docs, max_share))
    few = flagged.limit(broadcast_lines + 1).count() <= broadcast_lines
    own = stats.select("row_key", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row_key", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = own.join(F.broadcast(flagged) if few else flagged, ["host", "line"]).groupBy("row_key", "line").agg(F.max("words").alias("words")).groupBy("row_key").agg(F.sum("words").alias("removed_words"))
    out = stats.drop("lines", "line_words").join(removed, "row_key", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    out = out.withColumn("depleted", F.col("n_words") - F.col("removed_words") < min_left * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs whose verdict is kept, with or without a doc_id; rows that share an id are judged apart.

    Rows without text go; repeated rows stay or go together; extra columns pass through, whatever their names.
    """
    columns, (key,) = docs.columns, unused(docs, "key")
    good = judge(docs).filter("kept").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(docs)).join(good, key, "left_semi").select(*columns)


SQL_STATS = r"""
stats_docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM {docs}),
stats_words AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM stats_docs),
stats_grams AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS p FROM stats_words) WHERE ws[p + 2] IS NOT NULL),
stats_repeat AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM stats_grams) WHERE k > 1)
  GROUP BY doc_id),
stats_lines AS (
  SELECT doc_id, source, p, l, array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS line,
    len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS p FROM stats_docs)
  WHERE len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 0),
stats_dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM stats_lines GROUP BY doc_id),
stats_own AS (SELECT doc_id, source, line, sum(words) AS words FROM stats_lines GROUP BY doc_id, source, line),
stats_keys AS (SELECT doc_id, md5(translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS key FROM stats_words),
stats_hosts AS (SELECT source, count(*) AS docs FROM stats_docs GROUP BY source),
stats_frequent AS (
  SELECT o.source, line FROM (SELECT source, line, count(DISTINCT key) AS held FROM stats_own JOIN stats_keys USING (doc_id) GROUP BY source, line) o
  JOIN stats_hosts h ON o.source IS NOT DISTINCT FROM h.source WHERE held > 20 AND held > 0.01 * docs),
stats_removed AS (
  SELECT doc_id, sum(words) AS n FROM stats_own o JOIN stats_frequent f ON o.line = f.line AND o.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
stats_all AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    CAST(coalesce(m.n, 0) AS BIGINT) AS removed_words
  FROM stats_words w LEFT JOIN stats_dups d USING (doc_id) LEFT JOIN stats_repeat r USING (doc_id) LEFT JOIN stats_removed m USING (doc_id)),
stats AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats_all)
"""

SQL = f"WITH {SQL_STATS.format(docs='documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_words - removed_words < 0.3 * n_words) AS kept, removed_words FROM stats"
