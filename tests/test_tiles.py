"""Nearest neighbours by tiles, and the choice of leaves for many points at once."""

import random

import numpy as np

from addrspark.functions.geometry import geodesic, surrounding, surrounding_rows
from addrspark.operators import reverse


def test_surrounding_rows():
    rng = np.random.default_rng(3)
    for kind in range(9):
        width = int(rng.integers(1, 30))
        n = rng.integers(1, width + 1, 40)
        xs, ys = (rng.integers(0, 30, (40, width)) / (1 if kind % 3 else 1000.0) if kind % 2 else rng.normal(size=(40, width)) for _ in "xy")
        px, py = np.full(40, xs.mean() + 0.0003), np.full(40, ys.mean() + 0.0004)
        for i in range(40):
            order = np.argsort((xs[i, : n[i]] - px[i]) ** 2 + (ys[i, : n[i]] - py[i]) ** 2, kind="stable")
            xs[i, : n[i]], ys[i, : n[i]] = xs[i, order], ys[i, order]
        got = surrounding_rows(px, py, xs, ys, n)
        for i in range(40):
            assert [k for k in got[i] if k >= 0] == surrounding((px[i], py[i]), [*zip(xs[i, : n[i]], ys[i, : n[i]], strict=True)])


def test_distances_do_not_depend_on_other_pairs():
    lon, lat = np.array([139.0, 139.0001, -40.7]), np.array([35.0, 35.0002, -34.9])
    assert [float(geodesic(139.2, 35.1, lon[k], lat[k])) for k in range(3)] == geodesic(139.2, 35.1, lon, lat).tolist()


def test_equal_points_are_looked_for_once(spark):
    points = spark.createDataFrame([(k, 139.0 + k % 2, 35.0) for k in range(40)] + [(None, 139.0, 35.0), (3, None, 1.0)], "qid int, x double, y double")
    given, places = reverse.numbered_points(points)
    assert given.count() == 41 and places.count() == 2
    boxes = spark.createDataFrame([(k, 139.0 + k, 35.0, 139.0 + k, 35.1) for k in range(4)], "item int, x0 double, y0 double, x1 double, y1 double")
    assert reverse.nearest_of(places, boxes, 2).count() == 2
    got = reverse.nearest(points, boxes, 2)
    assert got.count() == 20 * 3 + 21 * 2 and got.where("qid is null").count() == 2  # two items tie beside the eastern place


def test_tiles_and_parts(spark, monkeypatch):
    monkeypatch.setattr(reverse, "CROWD", 40)
    monkeypatch.setattr(reverse, "PART", 25)
    rng = random.Random(4)
    boxes = [(k, x, y, x + w, y + w) for k in range(700) for x, y, w in [(rng.choice([139 + rng.random() / 50, 139.5 + rng.random() / 3]), 35 + rng.random() / 50, rng.choice([0, 0, 0.0009]))]]
    b = spark.createDataFrame(boxes, "item int, x0 double, y0 double, x1 double, y1 double")
    over = [(r["j"], r["tx"], r["ty"]) for r in reverse.tiles(b, 40).collect()]
    held = [sum(((x0 + x1) / 2 // reverse.FINE) // 4**j == tx and ((y0 + y1) / 2 // reverse.FINE) // 4**j == ty for _, x0, y0, x1, y1 in boxes) for j, tx, ty in over]
    assert sum(held) == len(boxes) and max(held) <= 40 and len({j for j, _, _ in over}) > 1
    points = [(k, rng.choice([139 + rng.random() / 50, 139.5 + rng.random() / 3]), 35 + rng.random() / 50) for k in range(300)] + [(300, float("nan"), 35.0), (301, 20.0, -70.0)]
    got = {(r["qid"], r["item"]) for r in reverse.nearest(spark.createDataFrame(points, "qid int, x double, y double"), b, 5).where("qid <> 300").collect()}
    want = set()
    for q, x, y in points[:300] + points[301:]:
        d = sorted((max(x0 - x, 0, x - x1) ** 2 + max(y0 - y, 0, y - y1) ** 2, i) for i, x0, y0, x1, y1 in boxes)
        want |= {(q, i) for v, i in d if v <= d[4][0]}
    assert got == want


def test_paths_of_rows_without_a_parent(spark):
    from addrspark.operators.tree import build_tree

    keys = [["a"], ["a", "b", "c"], ["a", "b", "d"], ["e", "f"], ["e", "f", "g", "h"], ["a", "z"]]
    rows = spark.createDataFrame([(k, k[-1], len(k)) for k in keys], "path_key array<string>, name string, level int")
    got = {r["name"]: (r["id"], r["parent_id"], r["sibling_id"], r["path_ids"], r["path_names"], r["path_levels"]) for r in build_tree(rows).collect()}
    assert got == {
        "a": (1, 0, 5, [1], ["a"], [1]), "c": (2, 1, 3, [1, 2], ["a", "c"], [1, 3]), "d": (3, 1, 4, [1, 3], ["a", "d"], [1, 3]), "z": (4, 1, 5, [1, 4], ["a", "z"], [1, 2]),
        "f": (5, 0, 7, [5], ["f"], [2]), "h": (6, 5, 7, [5, 6], ["f", "h"], [2, 4]),
    }


def test_expanded_rows_read_only_what_they_need(spark):
    from addrspark.functions.rows import expand_rows

    df = spark.createDataFrame([(k, "x" * k, [k]) for k in range(4)], "k bigint, t string, l array<int>")
    got = expand_rows(df, lambda t: [(j,) for j in range(len(t))], ["t"], ["k", "l"], "j int")
    assert got.columns == ["k", "l", "j"] and sorted((r["k"], r["l"], r["j"]) for r in got.collect()) == [(k, [k], j) for k in range(4) for j in range(k)]


def test_prefixes_of_the_lengths_that_keys_have(spark):
    from addrspark.operators.index import common_prefixes

    texts, keys = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,)], "text string"), spark.createDataFrame([("ab", 1), ("abcd", 2), ("b", 3)], "key string, node_id bigint")
    want = sorted(map(tuple, common_prefixes(texts, keys).collect()))
    assert sorted(map(tuple, common_prefixes(texts, keys, lengths=[1, 2, 4]).collect())) == want and len(want) == 3


def test_letters_and_keys_in_one_pass():
    from addrspark.operators.descent import _keys

    assert sorted(_keys("A12.3", 0, False, ["A", "B"])) == [(0, "A"), (0, "A\0" + "1"), (0, "A\0" + "12")]
    assert [*_keys("A1", 2, False, None)] == []


def test_leaves_hang_on_what_may_be_an_item(spark):
    rows = [(1, 1, 999.9, 9, [1], [1]), (2, 7, 1.0, 5, [1, 2], [1, 7]), (3, 8, 1.1, 4, [1, 2, 3], [1, 7, 8]), (4, 8, 1.2, 5, [1, 2, 4], [1, 7, 8]), (5, 7, 1.3, 6, [1, 5], [1, 7]), (6, 6, 1.4, 7, [1, 6], [1, 6])]
    nodes = spark.createDataFrame([(i, level, x, 2.0, after, ids, levels) for i, level, x, after, ids, levels in rows], "id bigint, level int, x double, y double, sibling_id bigint, path_ids array<bigint>, path_levels array<int>")
    got = sorted((r["item"], r["node_id"]) for r in reverse.leaf_points(nodes).collect())
    assert got == [(2, 3), (2, 4), (3, 3), (4, 4), (5, 5), (6, 6)]  # none by the region
