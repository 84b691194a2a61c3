"""CSV files inside zip archives: a data source with one partition per member, read as a stream.

    spark.dataSource.register(archives.ArchivedCsv)
    rows = spark.read.format("archived_csv").load("/data/archives")
    rows.select(archives.field("ItinID", "itinerary_id"))

A row is (archive, member, line, fields), fields being a map from the header's names, trimmed and in lower case, to
texts; blank lines are skipped, missing cells are absent, undecodable bytes are replaced. A member is the unit of
reading, since a deflated stream can't be entered in the middle, and an archive that of writing, so a writer takes as
many of both as `layout` tells from the number of rows.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritill.sources import streams
from veritill.sources.shipping import ship

ROWS = "archive string, member string, line bigint, fields map<string,string>"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])
BATCH = 4_096
#: Rows that a written member should hold.
MEMBER_ROWS = 500_000


def layout(rows: int, archives: int, each: int) -> tuple[int, int]:
    """How many archives and members, `each` of them per archive, hold a number of rows; at least `archives`."""
    archives = max(archives, -(-rows // (MEMBER_ROWS * each)))
    return archives, archives * each


class Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


class ArchivedCsvReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Member]:
        out = []
        for archive in streams.below(self.path, ".zip"):
            fs, at = streams.file_system(archive)
            with fs.open_input_file(at) as file, zipfile.ZipFile(file) as z:
                out += [Member(archive, n) for n in z.namelist() if n.lower().endswith(".csv")]
        if not out:
            raise ValueError(f"no archive with a CSV member under {self.path}")
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        fs, at = streams.file_system(partition.archive)
        with fs.open_input_file(at) as file, zipfile.ZipFile(file) as z, z.open(partition.member) as raw:
            lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=""))
            names = [n.strip().lower() for n in next(lines, [])]
            filled, first = filter(None, lines), 1
            while held := list(islice(filled, BATCH)):
                yield self._batch(partition, first, names, held)
                first += len(held)

    @staticmethod
    def _batch(partition: Member, first: int, names: list[str], held: list[list[str]]) -> pa.RecordBatch:
        n = len(held)
        if len(set(names)) == len(names):
            cells, own = [row[: len(names)] for row in held], [names[: len(row)] for row in held]
        else:  # of columns with the same name the last one that the row has counts
            found = [dict(zip(names, row, strict=False)) for row in held]
            cells, own = [list(d.values()) for d in found], [list(d) for d in found]
        ends = pa.array(accumulate(map(len, cells), initial=0), pa.int32())
        fields = pa.MapArray.from_arrays(ends, pa.array(chain.from_iterable(own), pa.string()), pa.array(chain.from_iterable(cells), pa.string()))
        return pa.RecordBatch.from_arrays([pa.repeat(partition.archive, n), pa.repeat(partition.member, n), pa.array(range(first, first + n), pa.int64()), fields], schema=_ARROW)


class ArchivedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archived_csv"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ArchivedCsvReader:
        return ArchivedCsvReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all CSV members of the archives under a folder."""
    ship(spark)
    spark.dataSource.register(ArchivedCsv)
    return spark.read.format("archived_csv").load(path)


def field(*names: str) -> Column:
    """The first of some fields, found in any case, that holds more than blanks."""
    return F.coalesce(*(F.nullif(F.trim(F.col("fields").getItem(n.lower())), F.lit("")) for n in names))


def _zip(path: str):
    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, archive, member, out, file, into = [], None, None, None, None, None
        for part in parts:
            begins = part["archive"].ne(part["archive"].shift()) | part["member"].ne(part["member"].shift())
            for _, run in part.groupby(begins.cumsum(), sort=False):
                a, m = run["archive"].iat[0], run["member"].iat[0]
                if (a, m) != (archive, member):
                    into and into.close()
                    if a != archive:
                        out and (out.close(), file.close())
                        fs, at = streams.file_system(f"{path}/{a}.zip")
                        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                        file = fs.open_output_stream(at)
                        out = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                    archive, member = a, m
                    into = out.open(f"{m}.csv", "w", force_zip64=True)
                    done.append((a, m))
                into.write("".join(f"{line}\r\n" for line in run["line"]).encode())
        into and (into.close(), out.close(), file.close())
        yield pd.DataFrame(done, columns=["archive", "member"])

    return write


def write(lines: DataFrame, path: str) -> DataFrame:
    """(archive, member) of the archives that were written from lines (archive, member, place, line), a task writing whole archives as streams."""
    ship(lines.sparkSession)
    rows = lines.select("archive", "member", "place", "line").repartition("archive").sortWithinPartitions("archive", "member", "place")
    return rows.mapInPandas(_zip(path), "archive string, member string")
