"""Tables that are kept beside the nodes: answers, parts read, and other nodes noticed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrspark.errors import StoreError
from addrspark.functions.geometry import geodesic, in_triangle
from addrspark.operators.reverse import items, nearest, reverse_geocode
from addrspark.operators.search import Gazetteer, gazetteer_from_paths, geocode
from addrspark.operators.spatial import SpatialIndex, curve, fingerprint

# Places in three prefectures, one path a line with its level and point.
PLACES = [(f"p{p}/c{p}/o{p}{o}/b{p}{o}{b}" + (f"/h{p}{o}{b}{h}" if h >= 0 else ""), 8 if h >= 0 else 7, 130.5 + 4 * p + o / 50 + b / 900 + (h + 1) / 9000, 33.2 + p + b / 500 + (h % 2) / 7000) for p in range(3) for o in range(5) for b in range(8) for h in range(-1, 4)]


@pytest.fixture(scope="module")
def nodes(spark):
    above = {"/".join(path.split("/")[:k]): (3, 1, 3, 5)[k] for path, *_ in PLACES for k in (1, 2, 3)}
    rows = [(path, level, 130.0 + k, 33.0, 1, "") for k, (path, level) in enumerate(above.items())]
    rows += [(path, level, x, y, 1, "") for path, level, x, y in PLACES]
    made = gazetteer_from_paths(spark, spark.createDataFrame(rows, "path string, level int, x double, y double, priority int, note string"))
    from addrspark.plans.staging import staged

    return staged(made, "nodes")


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    metrics = leaf.metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def test_spatial_index(spark, nodes, tmp_path):
    with pytest.raises(StoreError):
        SpatialIndex.open(nodes, str(tmp_path / "s"))
    SpatialIndex.build(nodes, str(tmp_path / "s"))
    index = SpatialIndex.open(nodes, str(tmp_path / "s"))
    rng = random.Random(2)
    points = [(k, 130.5 + 4 * rng.randrange(3) + rng.random() / 8, 33.2 + rng.randrange(3) + rng.random() / 60) for k in range(8)] + [(8, 0.0, -89.9), (8, 179.9, 89.9), (9, None, 3.0)]
    frame = spark.createDataFrame(points, "qid bigint, x double, y double")
    want = sorted(map(tuple, reverse_geocode(nodes, frame, 7).collect()))
    assert sorted(map(tuple, index.reverse(frame, 7).collect())) == want and len(want) > 9
    one = index.near([points[0][1:]])
    every = index.items
    assert files_read(one)[0] < files_read(every)[0] and files_read(one)[1] < files_read(every)[1]
    many = frame.crossJoin(spark.range(12)).select((F.col("qid") * 100 + F.col("id")).alias("qid"), (F.col("x") + F.col("id") / 9000).alias("x"), "y")
    assert sorted(map(tuple, index.reverse(many, 7).collect())) == sorted(map(tuple, reverse_geocode(nodes, many, 7).collect()))
    moved = nodes.withColumn("x", F.when(F.col("id") == 9, F.col("x") + 0.001).otherwise(F.col("x")))
    with pytest.raises(StoreError):
        SpatialIndex.open(moved, str(tmp_path / "s"))


def test_answers_are_the_nearest_leaves_of_the_nearest_items(spark, nodes):
    """Brute force over all items, and of their leaves the nearest at least."""
    boxes = [tuple(r) for r in items(nodes).collect()]
    leaves = {r["id"]: (r["x"], r["y"], r["path_ids"]) for r in nodes.where("sibling_id = id + 1 and x <= 180").collect()}
    rng = random.Random(5)
    points = [(k, 130.5 + 4 * rng.randrange(3) + rng.random() / 8, 33.2 + rng.randrange(3) + rng.random() / 60) for k in range(30)]
    frame = spark.createDataFrame(points, "qid bigint, x double, y double")
    got = {}
    for r in reverse_geocode(nodes, frame, 8).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["node_id"], r["dist"], r["candidate_dist"]))
    for qid, x, y in points:
        d2 = sorted((max(x0 - x, 0, x - x1) ** 2 + max(y0 - y, 0, y - y1) ** 2, item) for item, x0, y0, x1, y1 in boxes)
        near = {item for d, item in d2 if d <= d2[19][0]}
        mine = {i: float(geodesic(x, y, [px], [py])[0]) for i, (px, py, path) in leaves.items() if near & {*path}}
        answers = sorted(got[qid])
        assert len(answers) <= 3 and all(abs(mine[n] - d) < 1e-6 and abs(d - c) < 1e-6 for _, n, d, c in answers)
        nearest_one = answers[0][1] == min(mine, key=lambda i: (round(mine[i], 6), i))
        assert nearest_one or in_triangle((x, y), *(leaves[n][:2] for _, n, _, _ in answers))


def test_repeated_points(spark, nodes):
    points = [(1, 130.6, 33.2), (1, 134.6, 34.2), (None, 138.6, 35.2), (1, 130.6, 33.2)]
    frame = spark.createDataFrame(points, "qid bigint, x double, y double")
    got = reverse_geocode(nodes, frame, 8).collect()
    alone = [len(reverse_geocode(nodes, spark.createDataFrame([(7, *p[1:])], "qid bigint, x double, y double"), 8).collect()) for p in points]
    assert len(got) == sum(alone) and sum(r["qid"] is None for r in got) == alone[2]
    assert nearest(frame, items(nodes)).where("qid = 1").count() >= 60


def test_search_tables(spark, nodes, tmp_path):
    made = Gazetteer(nodes)
    made.save(str(tmp_path / "g"), nodes)
    kept = Gazetteer.open(str(tmp_path / "g"), nodes)
    queries = spark.createDataFrame([(1, "p1c1o12b123h1230"), (1, "c2o20b201"), (None, "c0o04"), (2, "")], "qid bigint, query string")
    want = sorted(map(str, geocode(made, queries).collect()))
    assert sorted(map(str, geocode(kept, queries).collect())) == want and len(want) == 3
    rows = kept.index.where("key = 'C1O1.'").select("key", "node_id")
    assert rows.count() and "EqualTo(key" in rows._jdf.queryExecution().toString()  # a table of this size has one row group
    with pytest.raises(StoreError):
        Gazetteer.open(str(tmp_path / "g"), nodes.where("id > 1"))
    with pytest.raises(StoreError):
        Gazetteer.open(str(tmp_path / "none"), nodes)


def test_a_key_of_the_kept_index(spark, nodes, tmp_path):
    Gazetteer(nodes).save(str(tmp_path / "g"), nodes)
    kept = Gazetteer.open(str(tmp_path / "g"), nodes)
    rows = kept.index.where("key = 'C1.O11.'").select("key", "node_id")
    assert rows.count() == 1 and "EqualTo(key" in rows._jdf.queryExecution().toString()
    with pytest.raises(StoreError):
        Gazetteer.open(str(tmp_path / "g"), nodes.where("id > 1"))
    with pytest.raises(StoreError):
        Gazetteer.open(str(tmp_path / "none"), nodes)

def test_fingerprints_and_curve(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert fingerprint(a) == fingerprint(a.select("b", "a").orderBy(F.desc("a"))) != fingerprint(a.where("a = 1"))
    assert fingerprint(a, None) != fingerprint(a)
    rng = np.random.default_rng(1)
    cells = [(int(i), int(j)) for i, j in rng.integers(0, 1 << 20, (50, 2))]
    frame = spark.createDataFrame([(-180 + (i + 0.5) * 0.00025, -90 + (j + 0.5) * 0.00025) for i, j in cells], "x double, y double")
    got = [r[0] for r in frame.select(curve(F.col("x"), F.col("y"))).collect()]
    assert got == [sum((i >> k & 1) << 2 * k | (j >> k & 1) << 2 * k + 1 for k in range(21)) for i, j in cells]
