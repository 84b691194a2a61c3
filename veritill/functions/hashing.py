"""Deterministic hash arithmetic: splits, folds, ids and orders that come out equal on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "2026"
#: Upper bounds of the first 8 hex digits modulo 100, in order.
SPLITS = ((70, "train"), (80, "validation"), (90, "test"), (100, "golden"))
SMOKE_SPLITS = ((60, "train"), (75, "validation"), (85, "test"), (100, "golden"))


def sha(*parts: Column | str, separator: str = ":") -> Column:
    """Hex sha256 of the parts joined by the separator; strings are literals."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(separator, *cols), 256)


def hex_number(digest: Column, digits: int) -> Column:
    """The first digits of a hex digest as a bigint; 15 at most, as 16 need an unsigned type."""
    if not 1 <= digits <= 15:
        raise ValueError("a bigint holds at most 15 hex digits")
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def split_name(group: Column, seed: str | None = SEED, bounds: tuple[tuple[int, str], ...] = SPLITS) -> Column:
    """The split of a group by its hash bucket."""
    bucket = hex_number(sha(seed, group) if seed is not None else sha(group), 8) % 100
    out = F.lit(bounds[-1][1])
    for below, name in reversed(bounds[:-1]):
        out = F.when(bucket < below, name).otherwise(out)
    return out


def fold64(digest: Column, folds: int) -> Column:
    """The first 16 hex digits, unsigned, modulo the number of folds."""
    value = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (value % F.lit(folds).cast("decimal(20,0)")).cast("int")


def fold_of_five(digest: Column) -> Column:
    """The whole 256-bit digest modulo 5: as 16 is 1 modulo 5, that of the sum of its digits."""
    digits = F.split(digest, "")
    value = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda s, d: s + F.conv(d, 16, 10).cast("int"))
    return (value % 5).cast("int")


def stable_id(prefix: str, *values: Column) -> Column:
    """prefix_ and 20 hex digits of the hash of the values, a null being the text None."""
    joined = F.concat_ws(":", *(F.coalesce(v.cast("string"), F.lit("None")) for v in values))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 20))


def order_key(namespace: str, value: Column, seed: str = SEED) -> Column:
    """A stable shuffled order for values of a namespace."""
    return sha(seed, namespace, value)


def fingerprint(text: Column, tokens: int, digits: int) -> Column:
    """Hash of the first distinct tokens of a text in sorted order."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.substring(F.sha2(F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, tokens), " "), 256), 1, digits)


def json_hash(*fields: tuple[str, Column]) -> Column:
    """sha256 of compact JSON with sorted keys; nulls stay in it."""
    ordered = F.struct(*(c.alias(n) for n, c in sorted(fields)))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def tree_digest(ids: Column) -> Column:
    """Digest of an array of ids that doesn't depend on their order."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)
