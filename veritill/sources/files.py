"""Readers and writers with the checks that a reproducible corpus needs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritill.sources import streams
from veritill.sources.shipping import ship


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, or an error that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the required columns, all of which must be there."""
    return require(spark.read.parquet(path), columns).select(*columns)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by a fixed schema; a line ends at \\n alone, so U+2028 inside strings stays; a bad line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def with_unknown_keys(df: DataFrame, json_column: str, allowed: list[str]) -> DataFrame:
    """The rows with the keys of a JSON object that the schema doesn't allow."""
    keys = F.json_object_keys(json_column)
    return df.withColumn("unknown_keys", F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def first_filled(*columns: str) -> Column:
    """The first column that holds more than blanks."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def any_case(df: DataFrame, *names: str) -> Column:
    """The first filled one of some columns, found in any case of their names."""
    own = {c.lower(): c for c in df.columns}
    found = [own[n.lower()] for n in names if n.lower() in own]
    return first_filled(*found) if found else F.lit(None).cast("string")


def clean_invoices(df: DataFrame) -> DataFrame:
    """Invoice lines with keys, positive castable quantity and price, and no cancellation."""
    quantity, price = F.expr("try_cast(quantity AS int)"), F.expr("try_cast(unit_price AS double)")
    df = df.withColumns({"quantity": quantity, "unit_price": price})
    filled = F.col("invoice").isNotNull() & F.col("stock_code").isNotNull() & (F.trim("description") != "")
    return df.filter(filled & ~F.col("invoice").rlike("^[Cc]") & (F.col("quantity") > 0) & (F.col("unit_price") > 0))


def write_sorted(df: DataFrame, path: str, key: str = "example_id", mode: str = "errorifexists") -> None:
    """JSON lines in the order of the key over all files; refuses to overwrite."""
    df.orderBy(key).write.mode(mode).json(path)


def write_once(df: DataFrame, path: str) -> str:
    """Writes through a staging folder and a rename, so a reader never sees half a table; `skipped` if it is there already."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staging")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        return "skipped"
    df.write.mode("overwrite").parquet(f"{path}.staging")
    if not fs.rename(staging, target):
        raise OSError(f"could not rename {path}.staging")
    return "written"


def with_shard(df: DataFrame, key: str, size: int, by: list[str]) -> DataFrame:
    """The shard of fixed size that each row of a queue falls into, in the order of the key."""
    from veritill.operators.ordered import named_places

    return named_places(df, key, by, "shard").withColumn("shard", F.floor((F.col("shard") - 1) / size).cast("int"))


def write_shards(df: DataFrame, path: str) -> None:
    df.repartition("shard").write.mode("errorifexists").partitionBy("shard").parquet(path)


def manifest(df: DataFrame, name: str, dimensions: list[str], key: str = "example_id") -> DataFrame:
    """One row of counts, histograms and an order-free digest of the keys of a table."""
    from veritill.operators.aggregates import histogram, key_digest

    out = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("artifact", F.lit(name)).crossJoin(key_digest(df, key))
    for d in dimensions:
        entries = histogram(df, d).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias(d))
        out = out.crossJoin(entries)
    return out


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for path in part["path"]:
            digest = hashlib.sha256()
            for piece in streams.chunks(path):
                digest.update(piece)
            out.append(digest.hexdigest())
        yield part.assign(sha256=out)


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length) of files, also below folders and of those without content."""
    context, out = spark.sparkContext, []
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(at, True)
        while found.hasNext():
            status = found.next()
            out.append((status.getPath().toString(), status.getLen()))
    return spark.createDataFrame(out, "path string, length bigint")


def checksums(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, sha256) of files of any length, also below folders, read in pieces, one task per file."""
    ship(spark)
    files = listed(spark, *paths)
    return files.repartitionByRange(max(1, files.count()), "path").mapInPandas(_digests, "path string, length bigint, sha256 string")


def tree_checksums(spark: SparkSession, top: str, paths: list[str]) -> DataFrame:
    """(name, length, sha256) per file by its name below `top`, and the digest of all names and checksums in order, as `.`."""
    d = checksums(spark, *paths)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    at = len(re.sub("^file:/+", "/", top).rstrip("/")) + 2
    d = d.withColumn("name", F.substring(plain(F.col("path")), at, 10_000)).select("name", "length", "sha256")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat(x["name"], F.lit(" "), x["sha256"], F.lit("\n")))
    whole = d.agg(F.lit(".").alias("name"), F.sum("length").alias("length"), F.sha2(F.array_join(lines, ""), 256).alias("sha256"))
    return d.unionByName(whole)


#: Rows of a file that are counted together before the cut.
STRIDE = 65_536


def first_rows(spark: SparkSession, path: str, n: int, condition: str = "true") -> DataFrame:
    """The first n rows for which a condition holds, in the order of file names and of rows in them, with their place.

    Files are counted in growing groups until they hold n, so those behind aren't read; in the last file the rows are
    counted by stretches, and only the one in which the n-th falls is numbered.
    """
    table = spark.read.parquet(path)
    names, starts, held, step = sorted(table.inputFiles()), [], 0, 1
    while names and held < n:
        group, names = names[:step], names[step:]
        counts = spark.read.schema(table.schema).parquet(*group).filter(condition).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {r["f"]: r["n"] for r in counts}
        for f in group:
            if held < n:
                starts.append((f, held))
                held += counts.get(f, 0)
        step *= 2
    if not starts:
        return table.limit(0).withColumn("place", F.lit(0).cast("bigint"))
    rows = spark.read.schema(table.schema).parquet(*(f for f, _ in starts)).select("*", F.input_file_name().alias("_file"), F.col("_metadata.row_index").alias("_row")).filter(condition)
    rows = rows.withColumn("_stretch", F.floor(F.col("_row") / STRIDE))
    earlier = Window.partitionBy("_file").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy("_file", "_stretch").agg(F.count(F.lit(1)).alias("_rows")).select("_file", "_stretch", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_inside"))
    before = counted.join(spark.createDataFrame(starts, "_file string, _start bigint"), "_file").select("_file", "_stretch", (F.col("_start") + F.col("_inside")).alias("_before")).filter(F.col("_before") < n)
    inside = F.row_number().over(Window.partitionBy("_file", "_stretch").orderBy("_row"))
    d = rows.join(before, ["_file", "_stretch"]).withColumn("place", (F.col("_before") + inside).cast("bigint"))
    return d.filter(F.col("place") <= n).select(*table.columns, "place")


def generated_rows(seeds: DataFrame) -> DataFrame:
    """Each seed (a number) in six families, with the change that its family makes."""
    families = ("control", "amount_overspend", "currency_mismatch", "cumulative_overspend", "category_mismatch", "evidence_missing")
    df = seeds.select("seed", F.posexplode(F.array(*map(F.lit, families))).alias("place", "family"))
    budget = 10_000 + F.col("seed") * 137
    return df.select(
        F.format_string("seed_%03d", "seed").alias("seed_id"), F.format_string("seed_%03d_%d", "seed", "place").alias("example_id"), "family", budget.alias("budget_minor"),
        F.when(F.col("family") == "amount_overspend", F.floor(budget * 1.2)).otherwise(F.floor(budget * 0.8)).cast("bigint").alias("amount_minor"),
        F.when(F.col("family") == "currency_mismatch", "EUR").otherwise("USD").alias("currency"),
        F.when(F.col("family") == "cumulative_overspend", F.floor(budget * 0.5)).otherwise(0).cast("bigint").alias("fulfilled_minor"),
        F.when(F.col("family") == "category_mismatch", "gambling").otherwise("retail").alias("category"),
        F.when(F.col("family") == "evidence_missing", "ambiguous").otherwise("sufficient").alias("evidence_sufficiency"),
    )
