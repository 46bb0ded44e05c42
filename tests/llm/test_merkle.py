"""Merkle manifests against hashing one level after another in plain Python."""

import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from addrspark.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, root string, `a.b` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def steps(tree, at):
    out = []
    for level in tree[:-1]:
        first = at // 8 * 8
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 8])))
        at //= 8
    return out


def plain(rows):
    """(doc_id, lang, leaf, subroot, root, steps) of each row."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf(r, r[4])))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    trees = {x: levels([d for _, d in by[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    return [(i, x, d, trees[x][-1][0], top[-1][0], steps(trees[x], k) + steps(top, at)) for at, x in enumerate(langs) for k, (i, d) in enumerate(by[x])]


def made(spark, rows):
    got = merkle.merkle_manifest(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)).collect()
    return sorted(((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["proof"]]) for r in got), key=repr)


@pytest.mark.parametrize("n", [1, 2, 9, 600])
def test_against_plain(spark, n):
    rng = random.Random(n)
    langs = [None, "", "en", "ü", "z", "𠮷"]
    rows = [(k * 7 % n, rng.choice(["s", None]), rng.choice(langs[-2:] if k % 3 else langs), rng.choice([None, k]), rng.choice(["Abc", "é ", "", None, "long " * 5000])) for k in range(n)]
    assert made(spark, rows) == sorted(plain(rows), key=repr)


def test_ties_nulls_and_repeats(spark):
    rows = [(1, "s", "en", 1, "a")] * 20 + [(1, "s", "en", 1, "b"), (None, None, None, None, None), (None, None, "en", None, "x")]
    assert made(spark, rows) == sorted(plain(rows), key=repr)


def test_empty(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_nodes_may_come_in_any_order_and_from_many_tasks():
    digests = [h(str(k)) for k in range(700)]
    events = [(b"t", 700, 0, k, d) for k, d in enumerate(digests)]
    random.Random(1).shuffle(events)
    want = {(lv, k): d for lv, level in enumerate(levels(digests)) for k, d in enumerate(level) if lv}
    nodes, waiting = {}, []
    for part in range(7):
        for _, _, level, idx, d, run, is_open in merkle.climb(events[part::7]):
            (waiting.append((b"t", 700, level, idx, d)) if is_open else nodes.update({(level, idx): d}))
    assert waiting
    nodes |= {(r[2], r[3]): r[4] for r in merkle.climb(waiting)}
    assert nodes == want


def test_a_frontier_is_short():
    digests = [h(str(k)) for k in range(5000)]
    rows = [*merkle.climb((b"t", 5000, 0, k, d) for k, d in list(enumerate(digests))[1003:3010])]
    assert sum(r[6] for r in rows) <= 14 * 5


def test_tampering_shows(spark):
    rows = [(k, "s", "en", 1, f"Text {k}") for k in range(30)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    changed = merkle.leaf_of(*[F.when(F.col("doc_id") == 5, F.lower("text")).otherwise(F.col("text")) if f == "text" else F.col(f) for f in merkle.FIELDS])
    got = merkle.merkle_manifest(docs, extra={"changed": changed}).withColumn("to", merkle.folded(F.col("changed"), F.col("proof")))
    assert [r["doc_id"] for r in got.where("to <> root").collect()] == [5]


def test_query_on_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    of = {(i, d): (sub, root, path) for i, _, d, sub, root, path in plain(rows)}
    texts = {r[0]: r for r in rows}
    got = merkle.op12_merkle(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        sub, root, path = of[r["doc_id"], r["leaf"]]
        assert (r["subroot"], r["root"], r["proof_sha256"]) == (sub, root, h(*[x for p in path for x in p]))
        row = texts[r["doc_id"]]
        own = leaf(row, row[4].translate({c: c + 32 for c in range(65, 91)}) if row[4] and crc32(str(r["doc_id"]).encode()) % 3 == 0 else row[4])
        for left, right in path:
            own = h(left, own, right)
        assert (r["folded_root"], r["verified"]) == (own, own == root)
