"""The record codec, the SQLite source and sink, bucketed updates, functions for SQL."""

import itertools
import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, Not, StringStartsWith

from addrspark.functions import sql
from addrspark.functions.geometry import geodesic, geodesic_column
from addrspark.functions.matching import match_length
from addrspark.functions.normalize import MIDDLE, numbered
from addrspark.functions.numbers import read_number
from addrspark.operators.codes import local_authority_code, notes_of
from addrspark.operators.index import optional_variants
from addrspark.sources import sqlite, store
from addrspark.sources.records import RecordCodec
from addrspark.sources.sqlite import Rows, SqliteReader


def test_codec(spark):
    codec = RecordCodec({"id": 0, "name": "?", "at": [0.0], "more": {"k": 1, "tags": ["x"]}, "ok": True, "none": None})
    rows = spark.createDataFrame([(1, "a", [1.5, None], (7, ["é", "/"])), (2, None, None, None)], "id bigint, NAME string, at array<double>, more struct<k:bigint,tags:array<string>>").withColumn("extra", F.lit(1))
    flat = codec.encode(rows)
    assert flat.columns == [*codec.example] and dict(flat.dtypes)["at"] == dict(flat.dtypes)["more"] == "string"
    got = sorted(map(tuple, flat.collect()))
    assert got[0] == (1, "a", "[1.5,null]", '{"k":7,"tags":["é","/"]}', True, None) and got[1] == (2, "?", "[0.0]", '{"k":1,"tags":["x"]}', True, None)
    back = codec.decode(flat).orderBy("id").collect()
    assert back[0].asDict(True) == {"id": 1, "name": "a", "at": [1.5, None], "more": {"k": 7, "tags": ["é", "/"]}, "ok": True, "none": None}
    assert back[1].asDict(True)["more"] == {"k": 1, "tags": ["x"]}
    assert codec.decode(flat.limit(0)).count() == 0 and codec.decode(flat.withColumn("more", F.lit("no json"))).first()["more"]["k"] is None
    assert json.loads(RecordCodec({"d": {}}).encode(spark.range(1)).first()["d"]) == {}
    with pytest.raises(ValueError):
        RecordCodec({})


def table(path, n=100):
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER, name TEXT, x REAL, ok BOOLEAN)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(k, f"n{k}" if k % 7 else None, k / 2, k % 2) for k in range(n)])


def test_filters_go_into_the_statement(spark, tmp_path):
    path = str(tmp_path / "t.db")
    table(path)
    sqlite.register(spark)
    source = spark.read.format("gaz_sqlite").option("path", path).option("table", "t").option("partitions", 3).load()
    reader = SqliteReader(source.schema, {"path": path, "table": "t"})
    asked = [GreaterThan(("id",), 40), In(("name",), ("n41", "n42")), StringStartsWith(("name",), "n'4"), IsNotNull(("x",)), Not(EqualTo(("id",), 3)), EqualTo(("a", "b"), 1)]
    assert [type(f) for f in reader.pushFilters(asked)] == [Not, EqualTo]
    statement, bound = reader.statement(Rows(1, 9))
    assert statement == 'SELECT "id", "name", "x", "ok" FROM "t" WHERE rowid BETWEEN ? AND ? AND "id" > ? AND "name" IN (?, ?) AND substr("name", 1, 3) = ? AND "x" IS NOT NULL' and bound == [1, 9, 40, "n41", "n42", "n'4"]
    for where in ("id > 40 and ok", "name in ('n41', 'n5')", "name like 'n4%'", "name is null", "x >= 10.5 and x < 20 and id <> 30", "ok = false and name = 'n8'"):
        fresh = spark.read.format("gaz_sqlite").option("path", path).option("table", "t").load()
        want = sorted(r["id"] for r in spark.createDataFrame(source.collect(), source.schema).where(where).collect())
        assert sorted(r["id"] for r in fresh.where(where).select("id").collect()) == want and want
    narrow = spark.read.schema("name string").format("gaz_sqlite").option("path", path).option("table", "t").load()
    assert narrow.columns == ["name"] and narrow.where("name is not null").count() == 85


def test_sink(spark, tmp_path):
    path = str(tmp_path / "out.db")
    table(path, 3)
    sqlite.register(spark)
    rows = spark.range(0, 50, 1, 4).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("name"), (F.col("id") / 4).alias("x"), (F.col("id") % 3 == 0).alias("ok"))
    writer = rows.write.format("gaz_sqlite").option("path", path).option("table", "w")
    writer.mode("append").save()
    back = lambda: spark.read.format("gaz_sqlite").option("path", path).option("table", "w").load()
    assert back().schema.simpleString() == rows.schema.simpleString() and [r["id"] for r in back().collect()] == [*range(50)]
    writer.mode("append").save()
    assert back().count() == 100
    writer.mode("overwrite").save()
    assert sorted(map(tuple, back().collect())) == sorted(map(tuple, rows.collect())) and sqlite.tables(path) == ["t", "w"]
    bad = rows.withColumn("x", F.when(F.col("id") == 45, F.raise_error(F.lit("no"))).otherwise(F.col("x")).cast("double"))
    with pytest.raises(Exception):
        bad.write.format("gaz_sqlite").option("path", path).option("table", "w").mode("append").save()
    assert back().count() == 50 and [p.name for p in tmp_path.iterdir()] == ["out.db"]
    with pytest.raises(Exception):
        spark.range(1).select(F.array("id").alias("a")).write.format("gaz_sqlite").option("path", path).option("table", "w").mode("append").save()


def test_an_update_writes_its_buckets_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 100)
    s = store.Store(spark, str(tmp_path))
    s.create("t", spark.range(1000).select("id", F.lit("old").alias("v")), "id")
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    s.update("t", spark.createDataFrame([(5, "a"), (99, None), (730, "b"), (5000, "c"), (None, "d")], "pos bigint, v string"))
    after = files()
    kept = before.keys() & after.keys()
    assert {p.split("__bucket=")[1].split("/")[0] for p in before.keys() - after.keys()} == {"0", "7"} and all(before[p] == after[p] for p in kept)
    assert {r["pos"]: r["v"] for r in s.read("t").where("v <> 'old'").collect()} == {5: "a", 730: "b"} and s.count("t") == 1000
    s.update("t", spark.createDataFrame([], "pos bigint, v string"))
    assert s.count("t") == 1000 and s.get("t", 99)["v"] == "old"
    s.delete("t")
    assert not (tmp_path / "t").exists()


def recursive(text, optional, at=0):
    return {text}.union(*[recursive(text.replace(optional[k], ""), optional, k + 1) for k in range(at, len(optional)) if optional[k] in text])


def test_variants(spark):
    texts = ["", "一", "大字ケノケ", "字大字小字", "ツッヶガノ字" * 2, None, *["".join(p) for p in itertools.product(["大", "字", "ケ", "x"], repeat=4)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", optional_variants(F.col("t")).alias("v")).collect()
    for r in rows:
        assert len(r["v"]) == len({*r["v"]}) and {*r["v"]} == (set() if r["t"] is None else recursive(r["t"], MIDDLE))


def test_functions_in_sql(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(1, r"a:b/c:d\/e:f/x\:y:z/k"), (2, None), (3, "//")], "id int, note string")
    rows.createOrReplaceTempView("noted")
    want = {(r["id"], r["k"], r["v"]) for r in rows.select("id", F.explode(notes_of()).alias("n")).select("id", "n.*").collect()}
    assert {tuple(r) for r in spark.sql("SELECT id, k, v FROM noted, LATERAL address_notes(note)").collect()} == want and len(want) == 4
    assert {r[0] for r in spark.sql("SELECT variant FROM LATERAL address_variants('大字ケ字ノ')").collect()} == recursive("大字ケ字ノ", MIDDLE)
    codes = spark.createDataFrame([("13224",), ("01100",), ("",), (None,), ("47999",)], "c string")
    codes.createOrReplaceTempView("coded")
    assert all(r[0] == r[1] for r in spark.sql("SELECT *, address_authority_code(c) AS a FROM coded").select("a", local_authority_code("c")).collect())
    got = spark.sql("SELECT address_match_length('1-2', '1.') AS n, address_match_length(NULL, 'a') AS z, address_geodesic(139, 35, 140.5, 36) AS g, address_numbered('二丁目') AS s").first()
    assert (got["n"], got["z"], got["s"]) == (match_length("1-2", "1."), 0, "2.丁目") and abs(got["g"] - geodesic(139, 35, 140.5, 36)) < 1e-6


def test_geodesic_column(spark):
    pairs = [(139.7, 35.6, 135.5, 34.7), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.5, 0.0), (0.0, -90.0, 0.0, 90.0), (179.9, 1.0, -179.9, 1.0), (-70.0, 80.0, 100.0, 10.0), (None, 1.0, 1.0, 1.0)]
    got = spark.createDataFrame(pairs, "a double, b double, c double, d double").select(geodesic_column(*map(F.col, "abcd"))).collect()
    assert got[-1][0] is None and all(abs(g[0] - float(geodesic(*p))) < 1e-5 for g, p in zip(got, pairs[:-1], strict=False))


def test_long_numerals_take_no_squares():
    for text in ("1" * 400_000, "０" * 200_000 + "7", "x" + "9" * 300_000 + ".y"):
        assert numbered(text).count(".") == 1
    assert numbered("００12.") == "12." and numbered("12万") == "120000." and numbered("1２三") == "12.3." and numbered("0") == "0." and numbered("十二3") == "12.3."
    for text in ("12", "０７", "3十", "5万2", "一二", "十"):
        value, n = read_number(text)
        assert numbered(text).startswith(f"{value}.")
