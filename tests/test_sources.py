"""Archives, canonical lines, digests of files and first rows, by small files made by hand."""

import gzip
import hashlib
import io
import json
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veritill.plans import queries_sources
from veritill.sources import archives, canonical, files, storage, streams, views

SMALL = "/root/testdata/sf0.001"


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_archived_csv(spark, tmp_path):
    zipped(tmp_path / "a.zip", {"one.csv": "﻿ItinID, MktFare ,Origin\r\n1,10.5,SIN\r\n\r\n2,,\"T\r\nYO\"\r\n3\r\n".encode(), "two.CSV": b"itinid,marketfare\n4,7\n5, \n", "notes.txt": b"no"})
    (tmp_path / "deep").mkdir()
    zipped(tmp_path / "deep" / "b.ZIP", {"x/three.csv": b"ORIGIN,ITINID\nca\xff,6\n", "empty.csv": b""})
    df = archives.read(spark, f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 4
    got = df.select("member", "line", archives.field("ItinID"), archives.field("MktFare", "MarketFare"), archives.field("origin", "Origin")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == [("one.csv", 1, "1", "10.5", "SIN"), ("one.csv", 2, "2", None, "T\r\nYO"), ("one.csv", 3, "3", None, None), ("two.CSV", 1, "4", "7", None), ("two.CSV", 2, "5", None, None), ("x/three.csv", 1, "6", None, "ca�")]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no archive"):
        archives.read(spark, f"{tmp_path}/none").count()


def test_written_archives_are_read_again(spark, tmp_path):
    lines = spark.createDataFrame([(f"a{k % 2}", f"m{k % 3}", k, f"{k},x{k}") for k in range(50)] + [(f"a{a}", f"m{m}", -1, "k,x") for a in range(2) for m in range(3)], "archive string, member string, place bigint, line string")
    assert archives.write(lines, f"file://{tmp_path}/out").count() == 6
    got = archives.read(spark, f"file://{tmp_path}/out").select(archives.field("K").cast("int"), archives.field("x")).collect()
    assert sorted(map(tuple, got)) == [(k, f"x{k}") for k in range(50)]


def test_archives_of_sessions_grow_with_the_lines(spark, monkeypatch):
    kept = {r.session_id: (r.previous_titles, r.next_title) for r in queries_sources.s7_s9_archived_sessions(spark, SMALL).collect()}
    monkeypatch.setattr(archives, "MEMBER_ROWS", 500, raising=False)
    members, write = [], archives.write
    monkeypatch.setattr(archives, "write", lambda lines, path: (lambda d: members.append(d.collect()) or d)(write(lines, path)))
    got = {r.session_id: (r.previous_titles, r.next_title) for r in queries_sources.s7_s9_archived_sessions(spark, SMALL).collect()}
    assert got == kept and kept
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert len(members[1]) >= lines / 500 and len({m.archive for m in members[1]}) >= lines / 1500


def test_cells_of_ragged_lines_and_repeated_names(spark, tmp_path):
    zipped(tmp_path / "a.zip", {"plain.csv": b"A,B,C\n1\n2,x,y,z\n3,,\n", "twice.csv": b"k,v,K\n1,a\n2,b,9\n"})
    got = {(r.member, r.line): r.fields for r in archives.read(spark, f"file://{tmp_path}").collect()}
    assert got == {("plain.csv", 1): {"a": "1"}, ("plain.csv", 2): {"a": "2", "b": "x", "c": "y"}, ("plain.csv", 3): {"a": "3", "b": "", "c": ""}, ("twice.csv", 1): {"k": "1", "v": "a"}, ("twice.csv", 2): {"k": "9", "v": "b"}}


def test_canonical_values(spark, tmp_path):
    row = '{"schema_version":"2.0","identity":{"example_id":"%s"},"mandate":{"constraints":[{"constraint_id":"a","type":"t","value":%s}]},"cart":{"line_items":[{"attributes":{"n":3,"f":true,"s":"x y","m":{"k":[1]}}}]}}'
    values = {"e1": '["x","y"]', "e2": '{"o":"A","d":"B"}', "e3": "12.5", "e4": "true", "e5": '"text"', "e6": "null", "e7": "[]"}
    (tmp_path / "in.json").write_text("\n".join(row % kv for kv in values.items()) + "\n", encoding="utf-8")
    df = canonical.read(spark, f"file://{tmp_path}/in.json")
    canonical.write(df, f"file://{tmp_path}/out")
    got = {r.example_id: (r.kind, r.texts, r.entries, r.number) for r in canonical.constraint_values(canonical.read(spark, f"file://{tmp_path}/out")).collect()}
    assert got == {"e1": ("list", ["x", "y"], None, None), "e2": ("map", None, {"o": "A", "d": "B"}, None), "e3": ("number", None, None, 12.5), "e4": ("flag", None, None, None), "e5": ("text", None, None, None), "e6": ("none", None, None, None), "e7": ("list", [], None, None)}
    item = canonical.read(spark, f"file://{tmp_path}/out").select(F.explode("cart.line_items.attributes").alias("a"))
    assert item.filter(F.try_variant_get(F.col("a")["s"], "$", "string") == "x y").count() == 7 and item.filter(F.try_variant_get(F.col("a")["m"], "$.k[0]", "int") == 1).count() == 7
    (tmp_path / "bad.json").write_text('{"schema_version":"2.0"}\n{"identity":', encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|Malformed"):
        canonical.read(spark, f"file://{tmp_path}/bad.json").collect()


def test_free_texts_are_what_the_parser_makes_of_them(spark):
    texts = ["a1", "2026-10-00", "12", " 12 ", "-3.5e2", "1.", "01", "+1", ".5", "1 2", "1,2", "true", "truex", "true x", "nul", "null", "NaN", "", " ", "{", '{"a": 1}', "[1, ", "[1] x", '"x"', '"x', "economy", "\u00a012", "\ufeff12", "-", "12é", "\t[2]", "1/2", "0x1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.coalesce(F.try_parse_json("t"), F.col("t").cast("variant"))
    for r in df.select("t", *(f(c).alias(f"{n}{k}") for k, c in enumerate((canonical.free(F.col("t")), old)) for n, f in (("kind", F.schema_of_variant), ("text", F.to_json)))).collect():
        assert (r.kind0, r.text0) == (r.kind1, r.text1), r.t


def test_canonical_files_are_compressed_and_in_order(spark, tmp_path):
    e = spark.createDataFrame([(f"e{k % 997:03}",) for k in range(4000)], "example_id string")
    d = e.select(F.struct("example_id").alias("identity"), *(F.lit("x").alias(c) for c in canonical.SECTIONS if c != "identity"))
    canonical.write(d, f"file://{tmp_path}/a")
    canonical.write(d.orderBy("identity.example_id"), f"file://{tmp_path}/b", in_order=True)
    for top in (tmp_path / "a", tmp_path / "b"):
        names = sorted(p for p in top.iterdir() if p.name.startswith("part-"))
        assert names and all(p.suffix == ".gz" for p in names)
        ids = [json.loads(line)["identity"]["example_id"] for p in names for line in gzip.open(p, "rt")]
        assert len(ids) == 4000 and ids == sorted(ids)


def test_stretches_of_examples(spark, tmp_path):
    """In order of ids over all stretches, each with one shuffle and nothing kept; repeated orders, lines without a product and null keys included."""
    for name in ("nation", "customer", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "orders":
            df = df.unionByName(df.filter("o_orderkey % 97 = 1")).unionByName(df.limit(3).withColumn("o_orderkey", F.lit(None).cast("bigint")))
        if name == "lineitem":
            df = df.withColumns({"l_partkey": F.when(F.col("l_orderkey") % 50 != 3, F.col("l_partkey")), "l_orderkey": F.when(F.col("l_orderkey") % 89 != 5, F.col("l_orderkey"))})
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    whole, found, before = views.examples(spark, f"file://{tmp_path}"), [], dict(storage._paths)
    for df in views.sorted_examples(spark, f"file://{tmp_path}", stretch=400):
        assert df.columns and set(df.columns) == set(whole.columns) and df._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
        found.append([r.asDict(True) for r in df.select(*whole.columns).collect()])
    assert not set(dict(storage._paths).values()) - set(before.values())  # what they read is deleted
    ids = [r["example_id"] for rows in found for r in rows]
    assert len(found) > 2 and min(map(len, found)) > 50 and ids == sorted(ids) and len(set(ids)) < len(ids)
    text = lambda r: json.dumps(r, default=str, sort_keys=True)
    assert sorted(text(r) for rows in found for r in rows) == sorted(text(r.asDict(True)) for r in whole.collect())


def test_shuffles_go_with_their_job(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    top = Path(spark.conf.get("spark.local.dir"))
    shuffles = lambda: {p.name for p in top.rglob("shuffle_*")}
    df = spark.range(5000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.collect_list("id").alias("x"))
    before, setting = shuffles(), spark.conf.get(name, None)
    with storage.brief_shuffles(spark):
        df.write.parquet(f"{tmp_path}/a")
        for _ in range(50):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        assert not shuffles() - before
    assert spark.conf.get(name, None) == setting
    assert df.count() == 7 and spark.read.parquet(f"{tmp_path}/a").count() == 7


def test_digests_of_files(spark, tmp_path):
    top = tmp_path / "odd+name [1]"
    (top / "sub").mkdir(parents=True)
    data = {"a.bin": b"x" * 9_000_001, "sub/b.bin": b"", "sub/c.bin": b"abc"}
    for name, content in data.items():
        (top / name).write_bytes(content)
    got = {r["name"]: (r["length"], r["sha256"]) for r in files.tree_checksums(spark, str(top), [str(top)]).collect()}
    want = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
    tree = "".join(f"{n} {want[n][1]}\n" for n in sorted(want))
    assert got == want | {".": (9_000_004, hashlib.sha256(tree.encode()).hexdigest())}
    assert b"".join(streams.chunks(str(top / "a.bin"), 1 << 20)) == data["a.bin"]


def test_first_rows_read_no_later_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "STRIDE", 16)
    for k in range(8):
        spark.range(k * 100, k * 100 + 100, 1, 1).withColumn("x", F.col("id") % 3).write.mode("append").parquet(f"{tmp_path}/part{k}")
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / f"f{k}.parquet")
    path = f"file://{tmp_path}/f*.parquet"
    want = [k for k in range(800) if k % 3 == 1]
    for n in (0, 1, 33, 34, 70, 150, 10_000):
        df = files.first_rows(spark, path, n, "x = 1")
        assert [(r.id, r.place) for r in df.orderBy("place").collect()] == [(k, p) for p, k in enumerate(want[:n], 1)]
        if n == 70:
            assert len(df.inputFiles()) == 3
