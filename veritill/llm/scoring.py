"""Operator 2: language-model scores by a probabilistic suffix tree, beside a unigram base.

The tree reads a text as bytes: its lowered words joined by one blank, then an end. Spark counts every n-gram
of up to DEPTH bytes before a symbol in all training documents (each task sums its own first). A context
stays in the tree if it was seen LEAST times and its next-symbol distribution diverges from that of its
suffix by DIVERGENCE nats per log of its count, or if a longer context that stays ends in it. A retained
context's distribution is smoothed by its suffix's, p = (n + kinds * p_suffix) / (total + kinds), down to even
odds of all symbols, and each symbol of a text is scored in the state of the longest retained suffix. The tree
grows with the corpus. Up to MOST_CELLS cells and MOST_ENTRIES counts it is broadcast as tables of 64-bit
logarithms; a larger one is cut by the two symbols before the one to score into slices of that size, and the
documents are read once for each slice, which scores the symbols that are its own. If the contexts of one such
pair don't fit a slice, the distinct n-grams of the documents are joined with the tree in 64 bits, which takes
disk of some twenty times the documents. Scores of the three ways agree to 1e-12 of their size.

The base needs the count of every word. Words above the share HEAVY of all tokens, of which there can be
1/HEAVY at most (64 MB), are broadcast; the others are joined, and being rare, none of them is a hot key.

Edge cases: a null or empty text has one token, its end; a row without a doc_id trains and isn't held out;
repeated rows give equal rows; without training documents every count is 0, and symbols have even odds; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contexts as C
from .textops import ROW_KEY, Words, buffers, crc_mod, documents, in_arrow, scratch, slices, stored

DEPTH = 5
LEAST = 48
DIVERGENCE = 2.0
FOLDS = 10
HEAVY = 2.5e-7
#: Bounds of a tree, or of a slice of it, that is broadcast as tables of 64-bit numbers (96 MB).
MOST_CELLS, MOST_ENTRIES = 12_000_000, 6_000_000
SYMBOLS = 257
#: Keys a task gathers before it sums them up, and passes them on if that leaves more than half.
GATHER = 1_000_000
#: Bytes of text worked on at once.
PIECE = 1 << 20


def symbols(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """START, the words joined by one blank and END of each row; the offsets of the rows, and a mask of START."""
    keep = w.solid.copy()
    last = np.zeros(len(w.starts), bool)
    last[w.first[1:][w.counts > 0] - 1] = True
    gaps = w.ends[~last]
    keep[gaps] = True
    data = w.data.copy()
    data[gaps] = 32
    sums = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    return C.sequence(data[keep], sums[w.offsets], end=True)


class _Sums:
    """Distinct keys with summed counts, compacted now and then."""

    def __init__(self):
        self.keys, self.counts, self.loose = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        self.put(*np.unique(keys, return_counts=True))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.loose += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = C.summed(np.concatenate([*self.keys, np.zeros(0, np.uint64)]), np.concatenate([*self.counts, np.zeros(0, np.int64)]))
        self.__init__()
        return keys, counts


def _counts(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(counts[k : k + 100_000])], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts = (_Sums(), _Sums()), 0
        for batch in batches:
            data, offsets = buffers(batch["text"])
            texts += batch.num_rows
            for i, j in slices(offsets, PIECE):
                w = Words(data, offsets[i : j + 1], lower=True)
                s, _, start = symbols(w)
                for own, keys in zip(sums, (w.hashes(), C.grams(s, start, depth)), strict=True):
                    own.add(keys)
                for kind, own in enumerate(sums):
                    if own.loose > GATHER:
                        keys, counts = own.take()
                        if len(keys) > GATHER // 2:
                            yield from rows(kind, keys, counts)
                        else:
                            own.put(keys, counts)
        for kind, own in enumerate(sums):
            yield from rows(kind, *own.take())
        yield from rows(2, np.zeros(1, np.uint64), np.array([texts]))

    return run


def statistics(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n) over all training rows, stored: 0 word hashes, 1 n-grams, 2 the number of texts."""
    training = rows.filter(~F.col("held_out")).select("text")
    found = in_arrow(training, _counts(depth), "kind int, key bigint, n bigint")
    return stored(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), lasting=True)


def _cut(key: Column | str, depth: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.bitwiseAND(F.lit((1 << (C.BITS * (depth + 1))) - 1))


def _upper(key: Column | str, depth: int) -> Column:
    """Whether an n-gram reaches `depth` symbols back."""
    return F.shiftright(key, C.BITS * depth) > 0


def _context(key: Column | str) -> Column:
    return F.shiftright(key, C.BITS)


def suffix_tree(grams: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE) -> tuple[DataFrame, DataFrame]:
    """The retained contexts (ctx, total, kinds) and their next symbols (key, n), stored, from (key, n) of full depth."""
    every = grams.select("n", F.explode(F.array(*(F.when(_upper("key", d), _cut("key", d)) if d else _cut("key", 0) for d in range(depth + 1)))).alias("key")).filter("key is not null")
    every = stored(every.groupBy("key").agg(F.sum("n").alias("n")).withColumn("ctx", _context("key")))
    totals = stored(every.groupBy("ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))
    # the parent of an n-gram lacks its oldest symbol
    parent = F.lit(None).cast("bigint")
    for d in range(1, depth + 1):
        parent = F.when(_upper("key", d), _cut("key", d - 1)).otherwise(parent)
    known = every.join(totals.filter(F.col("total") >= least), "ctx")
    suffix = every.join(totals.select("ctx", F.col("total").alias("suffix_total")), "ctx").select(F.col("key").alias("parent"), F.col("n").alias("suffix_n"), "suffix_total")
    held = known.filter("ctx > 0").withColumn("parent", parent).join(suffix, "parent")
    real = lambda c: F.col(c).cast("double")  # noqa: E731  products of two counts exceed 64 bits on large tables
    gain = F.sum(F.col("n") * F.log(real("n") * real("suffix_total") / (real("total") * real("suffix_n"))))
    own = held.groupBy("ctx", "total").agg(gain.alias("gain")).filter(F.col("gain") >= divergence * F.log("total"))
    own = own.select(F.explode(F.array(F.lit(0).cast("bigint"), *(F.when(_upper("ctx", d), _cut("ctx", d)) if d else _cut("ctx", 0) for d in range(depth)))).alias("ctx")).filter("ctx is not null").distinct()
    nodes = stored(totals.join(own.union(grams.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("ctx"))).distinct(), "ctx", "left_semi"))
    return nodes, stored(every.join(nodes, "ctx", "left_semi").select("key", "n"))


class Table:
    """The tree, or a slice of it, as tables: for each node and symbol code the log10 of its probability."""

    def __init__(self, nodes: tuple[np.ndarray, ...], entries: tuple[np.ndarray, ...], pairs: Callable[[np.ndarray], np.ndarray] | None = None):
        """pairs: which pairs of the last two symbols, packed like contexts, a slice has; without, all."""
        ctx, total, kinds = nodes
        key, n = entries
        own = (key & np.uint64((1 << C.BITS) - 1)).astype(np.int64)
        self.tree = C.Tree(ctx, np.unique(np.append(own - 1, C.START)))
        at = self.tree.find(ctx)
        size, many = np.zeros(len(self.tree.keys)), np.zeros(len(self.tree.keys))
        size[at], many[at] = total, kinds
        node, code = self.tree.find(key >> np.uint64(C.BITS)), self.tree.code[own]
        p = np.empty((len(self.tree.keys), self.tree.size))
        for d in range(self.tree.most + 1):
            level = self.tree.depths == d
            rows = np.flatnonzero(level)
            up = p[self.tree.parent[rows]] if d else np.full((1, self.tree.size), 1 / SYMBOLS)
            share = many[rows] / np.maximum(size[rows] + many[rows], 1)
            p[rows] = np.where(size[rows] > 0, share, 1.0)[:, None] * up
            e = np.flatnonzero(level[node])
            p[node[e], code[e]] += n[e] / (size[node[e]] + many[node[e]])
        self.logs = np.log10(p, out=p).reshape(-1)
        self.own = None
        if pairs is not None:
            self.own = np.zeros((self.tree.size, self.tree.size), bool)
            fields = np.append(0, np.flatnonzero(self.tree.code))  # 0: any symbol that isn't told apart
            last, older = np.meshgrid(fields, fields, indexing="ij")
            self.own[self.tree.code[last], self.tree.code[older]] = pairs((older << C.BITS | last).astype(np.uint64))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where the last two symbols before one belong to this slice; what stands before START doesn't count."""
        older = np.append(np.int32(0), codes[:-2])
        older[codes[:-1] == self.tree.code[C.START + 1]] = 0
        return np.flatnonzero(self.own[codes[:-1], older]).astype(np.int32) + np.int32(1)

    def score(self, s: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
        codes = self.tree.code[s + 1]
        if self.own is None:
            logs = self.logs[self.tree.walk(codes) * np.int64(self.tree.size) + codes]
        else:
            logs, at = np.zeros(len(codes)), self.places(codes)
            logs[at] = self.logs[self.tree.walk(codes, at)[at] * np.int64(self.tree.size) + codes[at]]
        logs[start] = 0
        return np.add.reduceat(logs, offsets[:-1], dtype=np.float64) if len(offsets) > 1 else np.zeros(0)


def _columns(df: DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    t = df.select(*names).toArrow()
    return tuple(t[c].to_numpy().view(np.uint64) if c in ("ctx", "key") else t[c].to_numpy() for c in names)


ROUGH = f"row bigint, text_key {ROW_KEY}, doc_id bigint, held_out boolean, n_tokens bigint, heavy_known bigint, heavy_score double, score double, rare array<bigint>"


def _rough(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, logs = shared.value
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, j in slices(offsets, PIECE):
                w = Words(data, offsets[i : j + 1], lower=True)
                h = w.hashes()
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                heavy = words[at] == h if len(words) else np.zeros(len(h), bool)
                n = len(w.counts)
                known = np.bincount(w.row[heavy], minlength=n)
                base = np.bincount(w.row[heavy], logs[at[heavy]], n).astype(float)  # without a heavy word it would be of integers
                score = table.score(*symbols(w)) if table is not None else np.zeros(n)
                first = np.concatenate([[0], np.cumsum(w.counts - known)])
                rare = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h[~heavy].view(np.int64)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part["row"], part["text_key"], part["doc_id"], part["held_out"], pa.array(w.counts + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), rare],
                    [x.split()[0] for x in ROUGH.split(", ")],
                )

    return run


def slices_of_tree(nodes: DataFrame, entries: DataFrame, alphabet: int, most_cells: int, most_entries: int) -> list[np.ndarray] | None:
    """For each slice the pairs of last two symbols that it has; the first also has all pairs that aren't named. None, if a pair is too large.

    Contexts of up to one symbol are in every slice.
    """
    pair = _cut("ctx", 1)
    many = nodes.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("nodes")).join(entries.select(_context("key").alias("ctx")).groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("entries")), "pair", "left")
    pairs, of_nodes, of_entries = (x.astype(np.int64) for x in _columns(many.fillna(0), "pair", "nodes", "entries"))
    common = pairs < 1 << C.BITS
    room = most_cells - of_nodes[common].sum() * alphabet, most_entries - of_entries[common].sum()
    pairs, of_nodes, of_entries = pairs[~common], of_nodes[~common], of_entries[~common]
    if min(room) <= 0:
        return None
    share = np.maximum(of_nodes * alphabet / room[0], of_entries / room[1])
    if not len(share) or share.max() > 1:
        return None
    order, parts = np.lexsort((pairs, -share)), max(2, int(np.ceil(share.sum())))
    while True:  # the largest pairs first, each to the emptiest slice
        full, at = np.zeros(parts), np.zeros(len(pairs), np.int64)
        for k in order:
            at[k] = full.argmin()
            full[at[k]] += share[k]
        if full.max() <= 1:
            return [pairs[at == k].astype(np.uint64) for k in range(parts)]
        parts += 1


def _slice(nodes: DataFrame, entries: DataFrame, parts: list[np.ndarray], k: int) -> Table:
    """A slice of the tree as tables."""
    spark = nodes.sparkSession
    pairs = F.broadcast(spark.createDataFrame(pa.table({"pair": parts[k].view(np.int64)})))
    here = lambda df, ctx: df.withColumn("pair", _cut(ctx, 1)).join(pairs, "pair", "left_semi").unionByName(df.withColumn("pair", _cut(ctx, 1)).filter(F.col("pair") < 1 << C.BITS))
    others = np.concatenate(parts[1:])
    own = (lambda p: np.isin(p, parts[k])) if k else (lambda p: ~np.isin(p, others))
    return Table(_columns(here(nodes, F.col("ctx")), "ctx", "total", "kinds"), _columns(here(entries, _context("key")), "key", "n"), own)


def _part_scores(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, j in slices(offsets, PIECE):
                part = table.score(*symbols(Words(data, offsets[i : j + 1], lower=True)))
                yield pa.RecordBatch.from_arrays([batch["text_key"].slice(i, j - i), pa.array(part)], ["text_key", "part"])

    return run


def sliced_scores(rows: DataFrame, nodes: DataFrame, entries: DataFrame, parts: list[np.ndarray]) -> DataFrame:
    """(text_key, every) by all slices but the first, one after the other, each with one pass over the texts; a text's copies have equal parts."""
    found = []
    for k in range(1, len(parts)):
        shared = rows.sparkSession.sparkContext.broadcast(_slice(nodes, entries, parts, k))
        own = in_arrow(rows.select("text_key", "text"), _part_scores(shared), f"text_key {ROW_KEY}, part double")
        found.append(stored(own.withColumn("slice", F.lit(k))))
        shared.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy("text_key").agg(*(F.max(F.when(F.col("slice") == k, F.col("part"))).alias(f"part{k}") for k in range(1, len(parts))))
    return every.select("text_key", reduce(Column.__add__, (F.col(f"part{k}") for k in range(1, len(parts)))).alias("every"))


def _document_grams(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, j in slices(offsets, PIECE):
                w = Words(data, offsets[i : j + 1], lower=True)
                s, new, start = symbols(w)
                keys = C.grams(s, start, depth)
                ends = new - np.arange(len(new))  # START has no n-gram
                for k in range(len(w.counts)):
                    own, n = np.unique(keys[ends[k] : ends[k + 1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([batch["text_key"].slice(i + k, 1).take(pa.array(np.zeros(len(own), np.int64))), pa.array(own.view(np.int64)), pa.array(n)], ["text_key", "key", "n"])

    return run


def joined_scores(rows: DataFrame, nodes: DataFrame, entries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(text_key, every) by joins, for a tree that is too large to be broadcast: the scores of all rows of a text together."""
    own = stored(in_arrow(rows.select("text_key", "text"), _document_grams(depth), f"text_key {ROW_KEY}, key bigint, n bigint"))
    keys = own.select("key").distinct().withColumn("p", F.lit(1 / SYMBOLS))
    for d in range(depth + 1):
        at = keys.withColumns({"ctx": F.when(_upper("key", d), _context(_cut("key", d))), "own": _cut("key", d)}) if d else keys.withColumns({"ctx": F.lit(0).cast("bigint"), "own": _cut("key", 0)})
        at = at.join(nodes, "ctx", "left").join(entries.select(F.col("key").alias("own"), F.col("n").alias("seen")), "own", "left")
        p = F.when(F.col("total").isNotNull(), (F.coalesce("seen", F.lit(0)) + F.col("kinds") * F.col("p")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("p"))
        keys = at.select("key", p.alias("p"))
    return own.join(keys, "key").groupBy("text_key").agg(F.sum(F.col("n") * F.log10("p")).alias("every"))


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, heavy: float = HEAVY, most_cells: int = MOST_CELLS) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select(F.monotonically_increasing_id().alias("row"), F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias("text_key"), "doc_id", held, "text")
    with scratch():  # what the result reads is lasting
        counted = statistics(rows, depth)
        words = counted.filter("kind = 0").select("key", "n")
        size = counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
        total = {r["kind"]: r for r in size}
        texts = total[2]["n"] if 2 in total else 0
        tokens = texts + (total[0]["n"] if 0 in total else 0)
        distinct = (texts > 0) + (total[0]["kinds"] if 0 in total else 0)
        scale = log10(tokens + 0.1 * (distinct + 1))

        nodes, entries = suffix_tree(counted.filter("kind = 1").select("key", "n"), depth, least, divergence)
        alphabet = 2 + entries.select(_cut("key", 0)).distinct().count()
        small = nodes.count() * alphabet <= most_cells and entries.count() <= MOST_ENTRIES
        parts = None if small else slices_of_tree(nodes, entries, alphabet, most_cells, MOST_ENTRIES)
        table = Table(_columns(nodes, "ctx", "total", "kinds"), _columns(entries, "key", "n")) if small else _slice(nodes, entries, parts, 0) if parts else None
        often, counts = _columns(words.filter(F.col("n") >= heavy * max(tokens, 1)), "key", "n")
        order = np.argsort(often)
        shared = spark.sparkContext.broadcast((table, often[order], np.log10(counts[order] + 0.1) - scale))
        rough = stored(in_arrow(rows, _rough(shared), ROUGH), lasting=True)
        shared.destroy()
        if parts:
            of_texts = stored(sliced_scores(rows, nodes, entries, parts), lasting=True)
        elif not small:
            copies = rough.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
            of_texts = joined_scores(rows, nodes, entries, depth).join(copies, "text_key")
            of_texts = stored(of_texts.select("text_key", (F.col("every") / F.col("copies")).alias("every")), lasting=True)

    log_of = lambda n: F.log10(n + F.lit(0.1)) - F.lit(scale)
    rare = rough.select("row", F.explode("rare").alias("key")).join(words, "key", "left").groupBy("row").agg(F.count("n").alias("rare_known"), F.sum(log_of(F.coalesce("n", F.lit(0)))).alias("rare_score"))
    out = rough.drop("rare").join(rare, "row", "left")
    if not small:
        out = out.join(of_texts, "text_key").withColumn("score", F.col("score") + F.col("every"))
    known = F.col("heavy_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if texts else 0)
    base = F.col("heavy_score") + F.coalesce("rare_score", F.lit(0.0)) + log_of(F.lit(texts))
    return out.select("doc_id", "held_out", "n_tokens", known.cast("bigint").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
