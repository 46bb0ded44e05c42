"""Extendible hashing against splitting one bucket at a time."""

import random

import pytest
from pyspark.sql import functions as F

from addrspark.llm import sharding


def split(rows, limit, prefix=""):
    if sum(n for _, n in rows) <= limit or len(prefix) == 64:
        return {prefix: rows} if rows else {}
    at = len(prefix)
    out = {}
    for bit in "01":
        out |= split([r for r in rows if r[0][at] == bit], limit, prefix + bit)
    return out


@pytest.mark.parametrize(("limit", "bits"), [(400, 14), (60, 5)])
def test_shards(spark, limit, bits):
    rng = random.Random(1)
    rows = [(k, "é" * rng.randint(0, 40), "x") for k in range(150)] + [(7, "same" * 10, "y")] * 30 + [(None, None, "z"), (None, "q" * 2000, "z"), (500, None, "z")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, shard string, `a.b` int")
    hashed = docs.select(F.lpad(F.conv(F.hex(F.xxhash64("doc_id", "text")), 16, 2), 64, "0").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = {p: sorted((r[0], r[1]) for r in rs) for p, rs in split([(r["h"], r["n"]) for r in hashed], limit).items()}
    got = sharding.assign_shards(docs, ["doc_id", "text", "shard", "a.b"], limit=limit, bits=bits).collect()
    assert len(got) == len(rows)
    assert {(r["shard"], r["shard_rows"], r["shard_bytes"], r["fits"]) for r in got} == {(p, len(rs), sum(n for _, n in rs), sum(n for _, n in rs) <= limit) for p, rs in want.items()}
    assert all(len(r["shard"]) == r["local_depth"] for r in got)
    of = {(r["doc_id"], r["text"] or ""): r["shard"] for r in got}
    assert all(r["h"].startswith(of[r["doc_id"], r["text"]]) for r in hashed)


def test_empty_and_written(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * k) for k in range(40)], "doc_id bigint, text string")
    assert sharding.assign_shards(docs.limit(0), ["doc_id"]).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"), limit=100)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 40
