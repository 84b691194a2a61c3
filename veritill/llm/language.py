"""Operator 10: language identification by prediction by partial matching.

For each language a context tree of bytes up to order 4 is counted on a bounded sample of its documents
(the TRAINING_DOCS of each language that come first by a hash of their ids), each of them read whole. A text's
code length under the frozen counts is exact: in the longest context that was seen, a byte that followed it
costs -log2(c/(n+d)), any other byte the escape -log2(d/(n+d)) plus its cost one byte shorter, down to even
odds of all bytes. The trees share one set of nodes, whose costs per byte and language are tabled once, so
scoring is a walk to each byte's context and one table row. The language with the shortest code is predicted.

Edge cases: a null text, or one without a letter, is `und` with score 0; with no document to learn from,
every text is `und`; a text of any length is read whole, in slices; languages whose codes tie go by the order
of their names; repeated rows give equal rows, and several texts under one id are scored apart (for training,
the least of them per language); an empty table gives an empty result; columns other than doc_id, text and
lang are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import contexts as C
from .textops import LOWER, buffers, crc_mod, documents, in_arrow, scratch, slices, stored

ORDER = 4
TRAINING_DOCS = 250
#: Most chosen documents whose ids are broadcast; more (of over 4,000 languages) are joined by a shuffle.
BROADCAST_DOCS = 1_000_000
FOLDS = 5
#: Bits of code length weigh this much in the score.
TEMPER = 0.2
UNKNOWN = "und"


@dataclass
class Model:
    names: list[str]
    tree: C.Tree
    costs: np.ndarray  # (node * size + code, language), bits


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 letters."""
    out = LOWER[data]
    if len(data) > 1:
        after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[after] += 0x20
    return out


def train(texts: list[tuple[str, bytes]], order: int = ORDER) -> Model:
    names = sorted({lang for lang, _ in texts})
    counted = []
    for name in names:
        own = [t for lang, t in texts if lang == name]
        data = lowered(np.frombuffer(b"".join(own), np.uint8))
        symbols, _, start = C.sequence(data, np.concatenate([[0], np.cumsum([len(t) for t in own])]), end=False)
        counted.append(np.unique(C.grams(symbols, start, order), return_counts=True))
    every = np.concatenate([k for k, _ in counted]) if counted else np.zeros(0, np.uint64)
    shift = np.uint64(C.BITS)
    nodes = [np.zeros(0, np.uint64)]
    for d in range(1, order + 1):
        keys = np.unique(C.cut(every, d) >> shift)
        nodes.append(keys[(keys >> np.uint64(C.BITS * (d - 1))) > 0])
    alphabet = np.unique((every & np.uint64((1 << C.BITS) - 1)).astype(np.int64)) - 1
    tree = C.Tree(np.concatenate(nodes), np.unique(np.append(alphabet, C.START)))
    size = tree.size
    costs = np.zeros((len(tree.keys), size, len(names)), np.float32)
    for m, (keys, n) in enumerate(counted):
        escape = np.zeros(len(tree.keys))
        entries = []
        for d in range(order + 1):
            own, k = C.summed(C.cut(keys, d), n)
            context = own >> shift
            full = (context >> np.uint64(C.BITS * (d - 1))) > 0 if d else np.ones(len(own), bool)
            node = tree.find(context)
            at = np.flatnonzero(full & (node >= 0))
            node, k = node[at], k[at]
            code = tree.code[(own[at] & np.uint64((1 << C.BITS) - 1)).astype(np.int64)]
            total, kinds = np.bincount(node, k, len(tree.keys)), np.bincount(node, minlength=len(tree.keys))
            seen = kinds > 0
            escape[seen] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
            entries.append((node, code, -np.log2(k / (total[node] + kinds[node]))))
        for d in range(tree.most + 1):
            at = np.flatnonzero(tree.depths == d)
            costs[at, :, m] = (8.0 if d == 0 else costs[tree.parent[at], :, m]) + escape[at, None]
            node, code, cost = entries[d]
            costs[node, code, m] = cost
    return Model(names, tree, costs.reshape(len(tree.keys) * size, len(names)))


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(row, language): the bits that each text takes."""
    out = np.zeros((len(offsets) - 1, len(model.names)))
    for i, j in slices(offsets):
        symbols, new, start = C.sequence(lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1], end=False)
        codes = model.tree.code[symbols + 1]
        rows = model.costs[model.tree.walk(codes) * np.int64(model.tree.size) + codes]
        rows[start] = 0
        sums = np.zeros((len(rows) + 1, len(model.names)))
        np.cumsum(rows, axis=0, out=sums[1:])
        out[i:j] = sums[new[1:]] - sums[new[:-1]]
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122), out=plain[1:])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double"


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = buffers(batch["text"])
            known = has_letter(data, offsets) & bool(model.names)
            bits = code_lengths(model, data, offsets)
            name, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if model.names:
                best = bits.argmin(axis=1)
                weight = 2.0 ** np.maximum(TEMPER * (bits.min(axis=1, keepdims=True) - bits), -1000)
                name[known] = np.array(model.names, object)[best][known]
                score[known] = (1 / weight.sum(axis=1))[known]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(name, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def learn(docs: DataFrame, per_language: int = TRAINING_DOCS) -> Model:
    """Trains on whole documents outside the held-out fold, at most per_language of each language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod(F.col("doc_id"), FOLDS), F.lit(0)) != 0))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    # the first by hash within each of 64 slices of a language, then of all, so that no task sorts a whole language
    h = F.xxhash64("doc_id")
    part = rows.select("doc_id", "lang", h.alias("h"), F.pmod(h, F.lit(64)).alias("part")).distinct()
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))).filter(F.col("r") <= per_language)
    with scratch():
        chosen = stored(part.withColumn("r", turn).filter(F.col("r") <= per_language).select("doc_id", "lang"))
        few = chosen.count() <= BROADCAST_DOCS
        texts = rows.join(F.broadcast(chosen) if few else chosen, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min(F.col("text").cast("binary")).alias("text"))
        found = [(r["lang"], bytes(r["text"])) for r in texts.select("lang", "text").collect()]
    return train(sorted(found))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *([F.col("lang").cast("string")] if model is None else []))
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(rows))
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out")
    return in_arrow(rows.select("doc_id", held, "text"), _predict(shared), RESULT)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
