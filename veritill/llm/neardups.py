"""Operator 1: near duplicates by MinHash with odd sketches.

Each text becomes its set of five-word shingles (64-bit hashes). 192 MinHash samples of the set make 32
band keys of six samples, and fold into an odd sketch: a 1,024-bit bitmap in which sample k flips the bit
that its value names. Texts with equal sets are one class from the start; classes that share a band are
candidates; the population count of the XOR of two sketches estimates how many samples differ, and only
pairs that may reach the threshold are confirmed on their full sets. Candidates inside a band are not all
paired: each class is first tried against one pivot of its band, and pairs inside a component that is
already linked are skipped, which loses no link between components. A pair at the threshold shares a band
with probability 1 - 3e-7 and passes the sketch with about the same.

Edge cases: a null or empty text, or one without words, has the empty set and is linked with nothing;
fewer than five words are one shingle; repeated rows share their class; rows of one doc_id with other texts
and rows without a doc_id are linked by their own sets; a component without any id is null, and the stage
still keeps one row of it; an empty table gives an empty result; columns other than doc_id, source and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import ROW_KEY, Words, documents, in_arrow, mix, row_key, scratch, stored, unused, windows, word_slices

WIDTH = 5
PERCENT = 85
BANDS, ROWS = 32, 6
SKETCH_BITS = 1024
#: Most differing samples that a candidate pair's sketches may show: 5 standard deviations above the mean at the threshold.
SKETCH_SLACK = 5.2
#: Bands of up to this many classes are paired at once; larger ones go through pivots first.
SMALL_BAND = 48
PIVOT_ROUNDS = 3

_K = BANDS * ROWS
_rng = np.random.default_rng(77)
_MULTIPLY = (_rng.integers(0, 2**31, _K, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FLIP = _rng.integers(0, 2**32, _K, dtype=np.uint32)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_SAMPLE_SALT = mix(np.arange(1001, 1001 + _K, dtype=np.uint64))

SIGNATURE = f"doc_id bigint, row_key {ROW_KEY}, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"
SETS = "doc_id bigint, shingles array<bigint>"


def shingle_sets(w: Words, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes = w.hashes()
    grams = windows(hashes, width)
    for n, a in zip(w.counts, w.first, strict=False):
        if n >= width:
            yield np.unique(grams[a : a + n - width + 1])
        elif n:
            yield windows(hashes[a : a + n], int(n))
        else:
            yield np.zeros(0, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    x = shingles.astype(np.uint32)[:, None]
    low = np.full(_K, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(low, ((x[k : k + 2048] ^ _FLIP) * _MULTIPLY).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = _BAND_SALT.copy()
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """The parity of the number of samples that fall on each bit."""
    at = mix(low.astype(np.uint64) ^ _SAMPLE_SALT) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def most_flips(percent: int = PERCENT) -> float:
    """The largest XOR population count that a pair at the threshold shows, but for rare chance."""
    q = 1 - percent / 100
    differ = 2 * (_K * q + SKETCH_SLACK * (_K * q * (1 - q)) ** 0.5)
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ)
    return mean + SKETCH_SLACK * (mean / 8) ** 0.5


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint64)
    for batch in batches:
        for i, j, w in word_slices(batch["text"], lower=True):
            sizes, a, b, bands, sketches = [], [], [], [], []
            for s in shingle_sets(w):
                low = samples(s) if len(s) else None
                sizes.append(len(s))
                a.append(int(np.add.reduce(mix(s), dtype=np.uint64)))
                b.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))) if len(s) else 0)
                bands.append(band_keys(low) if len(s) else none)
                sketches.append(odd_sketch(low) if len(s) else none)
            yield pa.RecordBatch.from_arrays(
                [*(batch[k].slice(i, j - i) for k in ("doc_id", "row_key", "text_key")), pa.array(sizes, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), _lists(bands), _lists(sketches)],
                [x.split()[0] for x in SIGNATURE.split(", ")],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, w in word_slices(batch["text"], lower=True):
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), _lists(list(shingle_sets(w)))], ["doc_id", "shingles"])


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: keys of row and text, set size, set fingerprint, band keys and odd sketch, in a stored table."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint"), row_key(docs).alias("row_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return stored(in_arrow(rows, _sign, SIGNATURE))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Alternates the large-star and small-star steps of distributed component finding, each an aggregate and
    a join, until the edges stay as they are.
    """
    star = stored(edges.select("a", "b").distinct())
    seen = None
    while True:
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        star = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        star = stored(star)
        now = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if now == seen:
            return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now


def _flips(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: by size, then by sketch, then exactly."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = pairs.filter(_flips("sketch_a", "sketch_b") <= most_flips(percent)).drop("sketch_a", "sketch_b")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return stored(pairs.filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"))


def _pair(x: Column | str, y: Column | str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _prefix_pairs(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs across components among classes (doc_id, component, low) that may reach the threshold; none that does is missing.

    Shingles are ordered from the rarest: two sets that reach the threshold share one of the first
    n - ceil(n * percent / 100) + 1 of either, and at the first that they share, what is left of both is enough. Near
    copies share most shingles with their pivot (low), so a set is told by what it has beyond the pivot and what it
    lacks of it, and only these are counted; a pivot's set is counted once, times the sets that go by it. A set with
    more shingles of its own than the threshold allows is linked with nothing and leaves first.
    """
    spare = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    pivots = stored(sets.join(classes.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("low"), F.col("shingles").alias("base")))
    own = classes.join(sets, "doc_id").join(pivots, "low")
    own = stored(own.select("doc_id", "component", "low", F.size("shingles").alias("n"), F.array_except("shingles", "base").alias("beyond"), F.array_except("base", "shingles").alias("lacking")))
    one, of = F.lit(1).cast("bigint"), lambda name, n: own.select(F.explode(name).alias("s"), n.alias("held"))
    base = pivots.select("low", F.explode("base").alias("s"))
    # a shingle that only one set has beyond its pivot, and no pivot has, is its own
    counted = own.select("doc_id", F.explode("beyond").alias("s")).unionByName(base.select(F.lit(None).cast("bigint").alias("doc_id"), "s")).groupBy("s").agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("doc_id"))
    single = counted.filter("held = 1 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("single"))
    own = stored(own.join(single, "doc_id", "left").filter(spare > F.coalesce("single", F.lit(0))).drop("single"))
    base = base.join(own.groupBy("low").agg(F.count(F.lit(1)).alias("members")), "low")
    held = of("beyond", one).unionByName(of("lacking", -one)).unionByName(base.select("s", F.col("members").alias("held"))).groupBy("s").agg(F.sum("held").alias("held")).filter("held > 0")
    entry = F.sort_array(F.collect_list(F.struct("held", "s")))
    held = stored(held)
    base = base.join(held, "s").groupBy("low").agg(entry.alias("base"))
    more = own.select("doc_id", F.explode("beyond").alias("s")).join(held, "s").groupBy("doc_id").agg(entry.alias("more"))
    ranked = own.join(base, "low", "left").join(more, "doc_id", "left")
    none = F.array().cast("array<struct<held:bigint,s:bigint>>")
    # the rarest of the pivot's shingles that the set has are among so many
    shared = F.filter(F.slice(F.coalesce("base", none), F.lit(1), spare + F.size("lacking")), lambda x: ~F.array_contains("lacking", x["s"]))
    prefix = F.slice(F.sort_array(F.concat(F.coalesce("more", none), shared)), F.lit(1), spare)
    ranked = ranked.select("doc_id", "component", "n", F.posexplode(prefix).alias("k", "x")).filter("x.held > 1")
    heads = stored(ranked.select(F.col("x.s").alias("s"), "doc_id", "component", "n", (F.col("n") - F.col("k")).alias("left")))
    x, y = (heads.select("s", F.col("doc_id").alias(d), F.col("component").alias(f"c{d}"), F.col("n").alias(f"n{d}"), F.col("left").alias(f"left{d}")) for d in "ab")
    enough = (100 + percent) * F.least("lefta", "leftb") >= percent * (F.col("na") + F.col("nb"))
    return x.join(y, "s").filter(F.col("a") < F.col("b")).filter(F.col("ca") != F.col("cb")).filter(enough).select("a", "b")


def link(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) over the classes (doc_id, n_shingles, bands, sketch) that are linked with another one.

    What is called doc_id from here on names one text each, as rows may share an id or have none.
    """
    keys = classes.select("doc_id", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = stored(keys.join(shared, "band"))
    # the first pivot of a band is the class that shares most bands with others, as the source of many near copies does
    popular = members.groupBy("doc_id").agg(F.sum("members").alias("popularity"))
    pivots = members.join(popular, "doc_id").groupBy("band").agg(F.min_by("doc_id", F.struct(-F.col("popularity"), "doc_id")).alias("low"))
    members = stored(members.join(pivots, "band"))
    first = members.filter("doc_id <> low").select(*_pair("doc_id", "low")).distinct()
    asked = members.select("doc_id").distinct()
    # a sort-merge join at every size: asked grows with the documents, and so the plan is the same on small tables
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(asked.hint("merge"), "doc_id", "left_semi")
    sets = stored(in_arrow(texts, _sets, SETS).dropDuplicates(["doc_id"]))
    edges = _confirmed(first, classes, sets, percent)
    for turn in range(PIVOT_ROUNDS + 1):
        found = components(edges)
        at = members.join(found, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", "members", "low", F.coalesce("component", "doc_id").alias("component"))
        split = at.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("band")
        at = stored(at.join(split, "band", "left_semi"))
        large = at.filter(F.col("members") > SMALL_BAND)
        if turn < PIVOT_ROUNDS and not large.isEmpty():
            rank = F.xxhash64("doc_id", F.lit(turn))
            pivots = large.groupBy("band").agg(F.min_by(F.struct("doc_id", "component"), rank).alias("pivot"))
            pairs = large.join(pivots, "band").filter("component <> pivot.component").select(*_pair("doc_id", "pivot.doc_id"))
        else:
            # what is left: pairs across components of one small band but those tried with the first pivot, and large bands by prefixes
            small = at.filter(F.col("members") <= SMALL_BAND)
            x, y = (small.select("band", "low", F.col("doc_id").alias(d), F.col("component").alias(c)) for d, c in (("a", "ca"), ("b", "cb")))
            pairs = x.join(y.drop("low"), "band").filter("a < b and ca <> cb and a <> low").select("a", "b")
            if not large.isEmpty():
                pairs = pairs.union(_prefix_pairs(large.groupBy("doc_id", "component").agg(F.max_by("low", F.struct("members", "low")).alias("low")), sets, percent))
        more = _confirmed(pairs.distinct(), classes, sets, percent)
        edges = stored(edges.union(more).union(found.filter("node <> component").select(*_pair("node", "component"))).distinct())
        if turn == PIVOT_ROUNDS or large.isEmpty():
            return components(edges)
    raise AssertionError("the last turn returns")


def _placed(docs: DataFrame, percent: int) -> DataFrame:
    """Per row of docs: doc_id, row_key, n_shingles, component (a key of its own), component_id, kept."""
    signed = signatures(docs)
    some = signed.filter("n_shingles > 0")
    same = ["set_a", "set_b", "n_shingles"]
    groups = stored(some.groupBy(*same).agg(F.min("text_key").alias("class_id"), F.min("doc_id").alias("low_id")))
    with scratch():
        classes = some.join(groups.select(*same, F.col("class_id").alias("text_key")), [*same, "text_key"]).dropDuplicates(["text_key"])
        classes = stored(classes.select(F.col("text_key").alias("doc_id"), "n_shingles", "bands", "sketch"))
        linked = stored(link(docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text"), classes, percent), lasting=True)
    groups = groups.join(linked, F.col("class_id") == F.col("node"), "left").select(*same, "low_id", F.coalesce("component", "class_id").alias("component"))
    # a component is named by its smallest id
    named = groups.groupBy("component").agg(F.min("low_id").alias("component_id"))
    out = signed.select("doc_id", "row_key", *same).join(groups.drop("low_id").join(named, "component"), same, "left")
    alone = F.col("n_shingles") == 0
    key = F.struct(F.col("component").alias("a"), F.lit(None).cast("bigint").alias("b"))
    out = out.withColumns({"component": F.when(alone, F.col("row_key")).otherwise(key), "component_id": F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))})
    return out.select("doc_id", "row_key", "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def classify(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    return _placed(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (one row, also where several have that id or none has one).

    Rows without words stay, one of each repeated row; extra columns pass through, whatever their names.
    """
    columns, (key,) = docs.columns, unused(docs, "key")
    kept = _placed(docs, PERCENT).filter("kept").groupBy("component").agg(F.min("row_key").alias(key)).select(key)
    return docs.withColumn(key, row_key(docs)).join(kept, key, "left_semi").dropDuplicates([key]).select(*columns)


SQL_LINKS = r"""
near_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
near_sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS s FROM near_words),
near_grams AS (SELECT doc_id, unnest(s) AS g FROM near_sets),
near_shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM near_grams x JOIN near_grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
near_links AS (
  SELECT a, b FROM near_shared JOIN near_sets x ON x.doc_id = a JOIN near_sets y ON y.doc_id = b WHERE 100 * k >= 85 * (len(x.s) + len(y.s) - k)),
near_both AS (SELECT a, b FROM near_links UNION SELECT b, a FROM near_links),
near_reach AS (
  SELECT a, b FROM near_both UNION SELECT r.a, e.b FROM near_reach r JOIN near_both e ON r.b = e.a),
near AS (
  SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
  FROM near_sets s LEFT JOIN (SELECT a, min(b) AS low FROM near_reach GROUP BY a) m ON m.a = s.doc_id)
"""

SQL = f"WITH RECURSIVE {SQL_LINKS.format(docs='documents')} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near"
