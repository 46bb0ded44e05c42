"""Reverse geocoding: up to three address nodes around each point.

Equal points are answered once. Points and items meet by tiles: squares that hold a bounded number of items, small where these
are dense, wide where they are few. An item goes to each tile that it comes near to, a tile's points are dealt over several
tasks if there are many, and within a task points that lie together are compared with the items that may be near any of
them. Points whose twentieth neighbour may lie beyond the tile's margin go on with larger tiles. Those left after that,
far from everything or between dense and empty places, descend a pyramid of cells with the number and the bounds of the items
in each: from the numbers follows how far the neighbours can be at most, and cells beyond that are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import geodesic, surrounding_rows
from ..plans.staging import discard, staged
from .tree import has_coordinates, is_leaf, on_path, with_path_levels

NEAREST, WARD, AZA, BLOCK = 20, 4, 6, 7
#: Side in degrees of the first window around a few points.
CELL = 0.001
#: Items that a tile holds, but for those in one of the smallest cells, how many more it holds in the next step, and the steps.
CROWD, MORE, STEPS = 2048, 16, 2
#: Two tiles of one kind make a side of WIDER of the next; there are so many kinds, from cells of FINE degrees up to the globe.
WIDER, TILES = 4, 11
#: What a tile is wider by on each side to see its neighbours, as a part of its own, and the widest item in it, in tiles.
MARGIN, WIDEST = 0.25, 16
#: Points of a tile in one task, points that are compared at once, and numbers that such a comparison holds.
PART, TOGETHER, NUMBERS = 4096, 128, 4_000_000
#: Side of the pyramid's smallest cells, how much wider each next level is, and how many levels cover the globe.
FINE, FACTOR, LEVELS = 0.00025, 8, 8
#: Side in degrees of the places whose points get their leaves together, if no tile does it, and how many one task takes.
PLACE, PLACE_POINTS = 0.016, 1000


def block_boxes(nodes: DataFrame) -> DataFrame:
    """(item, x0, y0, x1, y1): each block with parts, as the box of its own point and those of all nodes below."""
    blocks = nodes.where((F.col("level") == BLOCK) & ~is_leaf()).select(F.col("id").alias("item"))
    inside = nodes.where(has_coordinates()).select(F.explode("path_ids").alias("item"), "x", "y").join(blocks, "item")
    return inside.groupBy("item").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def distinct_points(nodes: DataFrame, some: DataFrame) -> DataFrame:
    """(item, ward, x, y): of some nodes the first of equal points under one ward; ward is the lowest node down to that level."""
    wards = nodes.where(F.col("level") <= WARD).select(F.col("id").alias("ward"))
    ward = some.select("id", F.explode("path_ids").alias("ward")).join(wards, "ward").groupBy("id").agg(F.max("ward").alias("ward"))
    return some.join(ward, "id", "left").groupBy("ward", "x", "y").agg(F.min("id").alias("item"))


def items(nodes: DataFrame) -> DataFrame:
    """(item, x0, y0, x1, y1): what the spatial index holds.

    A block with parts is the box of its own point and those of all nodes below; any other leaf is its point, the first
    of equal points under one ward. Only nodes below the ward level count.
    """
    boxes = block_boxes(nodes)
    leaves = nodes.where(has_coordinates() & (F.col("level") > WARD) & is_leaf())
    covered = leaves.select("id", F.explode("path_ids").alias("item")).join(boxes.select("item"), "item").select("id")
    points = distinct_points(nodes, leaves.join(covered.distinct(), "id", "left_anti"))
    return boxes.unionByName(points.select("item", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")))


def box_distance() -> Column:
    """Squared distance in degrees of (x, y) to the box."""
    dx = F.greatest(F.col("x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("y1"))
    return dx * dx + dy * dy


def pyramid(boxes: DataFrame) -> list[DataFrame]:
    """For each level from the finest: cx, cy, px, py (the cell above), n and the bounds of the n items whose middle is in it."""
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / FINE)
    bounds = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    above = [F.floor(F.col("cx") / FACTOR).alias("px"), F.floor(F.col("cy") / FACTOR).alias("py")]
    levels = [staged(boxes.groupBy(cell("x0", "x1").alias("cx"), cell("y0", "y1").alias("cy")).agg(F.count("*").alias("n"), *bounds).select("*", *above), "cells")]
    for _ in range(LEVELS - 1):
        up = levels[-1].groupBy(F.col("px").alias("cx"), F.col("py").alias("cy")).agg(F.sum("n").alias("n"), *bounds)
        levels.append(staged(up.select("*", *above), "cells"))
    return levels


def descended(points: DataFrame, boxes: DataFrame, k: int) -> DataFrame:
    """nearest of points by way of the pyramid.

    At each level a point meets the cells below those it has kept. The k nearest items are no farther than the far ends of
    cells that hold k items together; cells that begin beyond that are dropped. A point keeps a few cells for each of its k.
    """
    levels = pyramid(boxes)
    far = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1")))
    # two by two cells above the top ones cover the globe
    both = F.explode(F.array(F.lit(-1), F.lit(0)).cast("array<bigint>"))
    kept = points.select("qid", "x", "y", both.alias("px")).select("*", both.alias("py"))
    for cells in reversed(levels):
        met = kept.join(cells, ["px", "py"]).drop("px", "py")
        met = met.withColumns({"least": box_distance(), "most": far("x") * far("x") + far("y") * far("y")})
        whole = F.sum("n").over(Window.partitionBy("qid").orderBy("most"))
        met = met.withColumn("reach", F.when(whole >= k, F.col("most"))).withColumn("reach", F.min("reach").over(Window.partitionBy("qid")))
        met = met.where(F.col("reach").isNull() | (F.col("least") <= F.col("reach")))
        kept = staged(met.select("qid", "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py")), "kept")
    placed = boxes.select("*", F.floor((F.col("x0") + F.col("x1")) / 2 / FINE).alias("px"), F.floor((F.col("y0") + F.col("y1")) / 2 / FINE).alias("py"))
    near = kept.join(placed, ["px", "py"]).select("qid", "x", "y", "item", box_distance().alias("d2"))
    near = near.withColumn("r", F.rank().over(Window.partitionBy("qid").orderBy("d2"))).where(F.col("r") <= k).drop("r")
    near = staged(near, "near")
    discard(*levels, kept)
    return near


def numbered_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, x, y) of the points with coordinates, asked being their qid; and (qid, x, y) of the different ones among them."""
    given = staged(points.select(F.col("qid").alias("asked"), "x", "y").where("x is not null and y is not null"), "points")
    return given, staged(given.select("x", "y").distinct().select(F.monotonically_increasing_id().alias("qid"), "x", "y"), "places")


def nearest(points: DataFrame, boxes: DataFrame, k: int = NEAREST) -> DataFrame:
    """(qid, x, y, item): the k nearest items of every point, with all that tie with the last.

    Rows are answered each for itself, also where a qid repeats or is null; points without coordinates give none.
    """
    given, places = numbered_points(points)
    found = nearest_of(places, boxes, k).select("x", "y", "near")
    return given.join(found, ["x", "y"]).select(F.col("asked").alias("qid"), "x", "y", F.explode("near").alias("item"))


def _shift(c: Column, kind: int) -> Column:
    return F.shiftright(c, kind * (WIDER.bit_length() - 1))


def _cell(c: Column) -> Column:
    return F.floor(c / FINE).cast("bigint")


def tiles(boxes: DataFrame, most: int) -> DataFrame:
    """(j, tx, ty): the widest squares that hold most items each, by their middle; those of the smallest kind may hold more."""
    cells = boxes.groupBy(_cell((F.col("x0") + F.col("x1")) / 2).alias("cx"), _cell((F.col("y0") + F.col("y1")) / 2).alias("cy")).agg(F.count("*").alias("n"))
    kinds = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _shift(F.col("cx"), j).alias("tx"), _shift(F.col("cy"), j).alias("ty")) for j in range(TILES)])).alias("t")
    counts = staged(cells.select(kinds, "n").groupBy("t.j", "t.tx", "t.ty").agg(F.sum("n").alias("n")), "counts")
    split = counts.where(F.col("n") > most).select((F.col("j") - 1).alias("j"), F.col("tx").alias("ux"), F.col("ty").alias("uy"))
    whole = counts.where((F.col("n") <= most) | (F.col("j") == 0)).select("j", "tx", "ty", _shift(F.col("tx"), 1).alias("ux"), _shift(F.col("ty"), 1).alias("uy"))
    below = whole.join(split, ["j", "ux", "uy"], "left_semi")
    out = staged(below.unionByName(whole.where(F.col("j") == TILES - 1)).select("j", "tx", "ty"), "tiles")
    discard(counts)
    return out


def _in_tile(k: int, tell: bool):
    """For the points and boxes of one tile: rows of _MET."""

    def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
        return [table.column(n).to_numpy() for n in names]

    def work(key: tuple, points: pa.Table, boxes: pa.Table) -> pa.Table:
        kind, tx, ty, part = (v.as_py() for v in key)
        qid, x, y = numbers(points, "qid", "x", "y")
        item, x0, y0, x1, y1 = numbers(boxes, "item", "x0", "y0", "x1", "y1")
        side = FINE * WIDER**kind
        # by squares with some points each, so that those compared at once lie together
        across = max(1, int(np.sqrt(len(qid) / 32)))
        span = max([float(np.ptp(v)) for v in (x, y) if len(v)], default=0.0) or 1.0
        square = [np.minimum((v - v.min(initial=np.inf)) / span * across, across - 1).astype(int) for v in (x, y)]
        square = square[0] * across + square[1]
        order = np.lexsort((x, y, square))
        qid, x, y, square = qid[order], x[order], y[order], square[order]
        edge = side * MARGIN
        room = np.minimum(np.minimum(x - (tx * side - edge), (tx + 1) * side + edge - x), np.minimum(y - (ty * side - edge), (ty + 1) * side + edge - y)) - 1e-9
        sure, sizes, items, apart = np.zeros(len(qid), bool), np.zeros(len(qid), np.int64), [], []
        ends = [*np.flatnonzero(np.diff(square)) + 1, len(qid)] if len(qid) else []
        start = 0
        for end in ends:
            while start < end and len(item) >= k:
                px, py = x[start : min(end, start + TOGETHER)], y[start : min(end, start + TOGETHER)]
                # k items are nowhere farther than reach from any of these points: those beyond it are none's neighbours
                least = np.maximum(np.maximum(x0 - px.max(), 0.0), px.min() - x1) ** 2 + np.maximum(np.maximum(y0 - py.max(), 0.0), py.min() - y1) ** 2
                most = np.maximum(np.maximum(x0 - px.min(), 0.0), px.max() - x1) ** 2 + np.maximum(np.maximum(y0 - py.min(), 0.0), py.max() - y1) ** 2
                some = np.flatnonzero(least <= np.partition(most, k - 1)[k - 1])
                at = slice(start, start + max(1, min(len(px), NUMBERS // len(some))))
                px, py = x[at, None], y[at, None]
                dx, dy = np.maximum(np.maximum(x0[some] - px, 0.0), px - x1[some]), np.maximum(np.maximum(y0[some] - py, 0.0), py - y1[some])
                d2 = dx * dx + dy * dy
                last = np.partition(d2, k - 1, 1)[:, k - 1]
                sure[at] = (room[at] > 0) & (last < room[at] ** 2)
                kept = (d2 <= last[:, None]) & sure[at, None]
                sizes[at] = kept.sum(1)
                items.append(item[some[np.nonzero(kept)[1]]])
                if tell:
                    apart.append(d2[kept])
                start += len(px)
            start = end
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        listed = lambda some, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, kind), *some]).astype(kind)))
        far = listed(apart, float) if tell else pa.nulls(len(qid), pa.list_(pa.float64()))
        same = [pa.array(np.full(len(qid), v), kind) for v, kind in ((kind, pa.int32()), (tx, pa.int64()), (ty, pa.int64()), (part, pa.int64()))]
        return pa.Table.from_arrays([pa.array(qid), pa.array(x), pa.array(y), listed(items, np.int64), far, pa.array(sure), *same], names=[c.split()[0] for c in _MET.split(", ")])

    return work


_MET = "qid bigint, x double, y double, near array<bigint>, d2s array<double>, sure boolean, j int, tx bigint, ty bigint, part bigint"
_NEAR = ["qid", "x", "y", "near", "d2s", "place", "part"]


def _by_tiles(points: DataFrame, boxes: DataFrame, over: DataFrame, kinds: list[int], k: int, tell: bool) -> DataFrame:
    """_NEAR and sure of the points in the tiles over, which are of these kinds; only where it is sure near holds the k nearest."""
    spark, tile = points.sparkSession, ["j", "tx", "ty"]
    here = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _shift(_cell(F.col("x")), j).alias("tx"), _shift(_cell(F.col("y")), j).alias("ty")) for j in kinds])).alias("t")
    placed = staged(points.where(~F.isnan("x") & ~F.isnan("y")).select("qid", "x", "y", here).select("qid", "x", "y", "t.*").join(over, tile), "placed")
    parts = staged(placed.groupBy(*tile).agg(F.ceil(F.count("*") / PART).alias("parts")), "parts")
    dealt = placed.join(parts, tile).withColumn("part", F.pmod(F.xxhash64("qid"), "parts"))
    edge = lambda c, j, sign: _shift(_cell(F.col(c) + sign * MARGIN * FINE * WIDER**j), j)
    spans = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), *[F.sequence(edge(f"{c}0", j, -1), edge(f"{c}1", j, 1)).alias(f"t{c}") for c in "xy"]) for j in kinds])).alias("t")
    box = ["item", "x0", "y0", "x1", "y1"]
    spread = boxes.select(*box, spans).select(*box, "t.j", F.explode("t.tx").alias("tx"), "t.ty").select(*box, "j", "tx", F.explode("ty").alias("ty"))
    spread = spread.join(parts, tile).select(*box, *tile, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    n, key = int(spark.conf.get("spark.sql.shuffle.partitions")), [*tile, "part"]
    met = dealt.select("qid", "x", "y", *key).repartition(n, *key).groupBy(*key).cogroup(spread.repartition(n, *key).groupBy(*key)).applyInArrow(_in_tile(k, tell), _MET)
    out = staged(met.withColumn("place", F.xxhash64(*tile)).select(*_NEAR, "sure"), "near")
    discard(placed, parts)
    return out


def nearest_of(places: DataFrame, boxes: DataFrame, k: int = NEAREST) -> DataFrame:
    """_NEAR of places (qid, x, y) in a table, whose qid tells them apart: near has the k nearest items and all that tie with
    the last; a place and part are points that are dealt together.

    Boxes that are much wider than the tiles are found by way of the pyramid, for all points.
    """
    boxes = boxes.withColumn("item", F.col("item").cast("bigint"))
    left, out, small, large = places.select("qid", "x", "y"), [], boxes, None
    for step in range(STEPS):
        over = tiles(small, CROWD * MORE**step)
        kinds = sorted(r["j"] for r in over.select("j").distinct().collect())  # TILES at most
        if not kinds:
            break
        if large is None:
            side = WIDEST * FINE * WIDER ** kinds[0]
            wide = (F.col("x1") - F.col("x0") > side) | (F.col("y1") - F.col("y0") > side)
            small, large = boxes.where(~wide), boxes.where(wide)
            tell = not large.isEmpty()
        met = _by_tiles(left, small, over, kinds, k, tell)
        out.append(met.where("sure").select(*_NEAR))
        left = staged(left.join(out[-1].select("qid"), "qid", "left_anti"), "points")
        discard(over)
        if kinds == [TILES - 1] or left.isEmpty():
            break
    found = out[0] if out else None
    for more in out[1:]:
        found = found.unionByName(more)
    if out and tell:
        wider = descended(found.select("qid", "x", "y"), staged(large, "large"), k)
        both = found.select("qid", "x", "y", F.explode(F.arrays_zip(F.col("near").alias("item"), F.col("d2s").alias("d2"))).alias("n")).select("qid", "x", "y", "n.*").unionByName(wider)
        both = both.withColumn("r", F.rank().over(Window.partitionBy("qid").orderBy("d2"))).where(F.col("r") <= k)
        found = staged(_gathered(both), "near")
    if left.isEmpty():
        return found if out else _gathered(descended(left, boxes, k))
    rest = staged(_gathered(descended(left, boxes, k)), "near")
    return rest if found is None else found.unionByName(rest)


def _gathered(near: DataFrame) -> DataFrame:
    """_NEAR of rows (qid, x, y, item), by places of their own."""
    one = near.groupBy("qid", "x", "y").agg(F.collect_list("item").alias("near"))
    place = F.xxhash64(F.floor(F.col("x") / PLACE), F.floor(F.col("y") / PLACE)).alias("place")
    one = staged(one.select("qid", "x", "y", "near", F.lit(None).cast("array<double>").alias("d2s"), place), "gathered")
    parts = one.groupBy("place").agg(F.ceil(F.count("*") / PLACE_POINTS).alias("parts"))
    return one.join(parts, "place").withColumn("part", F.pmod(F.xxhash64("qid"), "parts")).select(*_NEAR)


def leaf_points(nodes: DataFrame) -> DataFrame:
    """(item, node_id, nx, ny): for each block the leaves with coordinates below it, and for each leaf itself; no other node is an item."""
    leaves = with_path_levels(nodes).where(has_coordinates() & is_leaf())
    over = F.array_union(F.transform(on_path("path_ids", [BLOCK]), lambda s: s["v"]), F.array("id"))
    return leaves.select(F.explode(over).alias("item"), F.col("id").alias("node_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))


def choose(px: np.ndarray, py: np.ndarray, ids: np.ndarray, xs: np.ndarray, ys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest three of its leaves, or those around it: their ids, -1 where there are fewer, and distances.

    ids, xs, ys: a row for each of the points px, py, whose first n are its leaves; equally near ones go by id.
    """
    none = np.arange(ids.shape[1]) >= n[:, None]
    d = np.where(none, np.inf, geodesic(px[:, None], py[:, None], xs, ys))
    ids = np.where(none, np.iinfo(np.int64).max, ids)
    order = np.lexsort((ids, d))
    ids, xs, ys, d = (np.take_along_axis(v, order, 1) for v in (ids, xs, ys, d))
    at = np.arange(ids.shape[1])
    again = (ids[:, 1:] == ids[:, :-1]) & (at[1:] < n[:, None])  # a leaf below two items
    if again.any():
        order = np.argsort(np.pad(again, ((0, 0), (1, 0))), axis=1, kind="stable")
        ids, xs, ys, d = (np.take_along_axis(v, order, 1) for v in (ids, xs, ys, d))
        n = n - again.sum(1)
    chosen = np.where(np.arange(3) < n[:, None], np.arange(3), -1)
    far = np.flatnonzero((n > 3) & (d[:, 0] >= 0.01))
    chosen[far] = surrounding_rows(px[far], py[far], xs[far], ys[far], n[far])
    some = np.maximum(chosen, 0)
    some = np.minimum(some, ids.shape[1] - 1)
    return np.where(chosen < 0, -1, np.take_along_axis(ids, some, 1)), np.take_along_axis(d, some, 1)


def _in_place(_: tuple, points: pa.Table, leaves: pa.Table) -> pa.Table:
    """Rows of _CHOSEN of one place's points, with their items, and the leaves of these."""
    item, node, nx, ny = (leaves.column(c).to_numpy() for c in ("item", "node_id", "nx", "ny"))
    order = np.argsort(item, kind="stable")
    item, node, nx, ny = item[order], node[order], nx[order], ny[order]
    qid, x, y = (points.column(c).to_numpy() for c in ("qid", "x", "y"))
    near = points.column("near").combine_chunks()
    wanted, sizes = near.flatten().to_numpy(), near.value_lengths().to_numpy().astype(np.int64)
    first = np.searchsorted(item, wanted)
    counts = np.searchsorted(item, wanted, "right") - first
    items_at = np.concatenate([[0], np.cumsum(sizes)])
    before = np.concatenate([[0], np.cumsum(counts)])
    n = before[items_at[1:]] - before[items_at[:-1]]
    made, start = [], 0
    while start < len(qid):
        end, widest = start, 1
        while end < len(qid) and (end == start or (end + 1 - start) * max(widest, n[end]) <= NUMBERS // 32):
            widest, end = max(widest, n[end]), end + 1
        of = slice(items_at[start], items_at[end])
        flat = np.repeat(first[of] - (before[of] - before[items_at[start]]), counts[of]) + np.arange(counts[of].sum())
        here = np.arange(widest) < n[start:end, None]
        at = np.zeros(here.shape, np.int64)
        at[here] = flat
        if len(item):
            ids, dist = choose(x[start:end], y[start:end], node[at], nx[at], ny[at], n[start:end])
            r, c = np.nonzero(ids >= 0)
            made.append((qid[start:end][r], x[start:end][r], y[start:end][r], c.astype(np.int32), ids[r, c], dist[r, c]))
        start = end
    names = [c.split()[0] for c in _CHOSEN.split(", ")]
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.float64()]
    columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


_CHOSEN = "qid bigint, x double, y double, rank int, leaf bigint, dist double"


def _picked(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """_CHOSEN of near (_NEAR), with the leaves that its items stand for (leaf_points).

    Points of one place are near the same items: the leaves of these come to the place once, not to each point.
    """
    n, place = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["place", "part"]
    wanted = near.select(F.col("place").alias("by"), F.col("part").alias("share"), F.explode("near").alias("item")).distinct()
    leaves = wanted.join(pairs, "item").select("by", "share", "item", "node_id", "nx", "ny").repartition(n, "by", "share")
    points = near.select(*place, "qid", "x", "y", "near").repartition(n, *place)
    return points.groupBy(*place).cogroup(leaves.groupBy("by", "share")).applyInArrow(_in_place, _CHOSEN)


def reverse_geocode(nodes: DataFrame, points: DataFrame, level: int = AZA, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """points (qid, x, y) with up to three answers: qid, rank, node_id, dist, candidate_dist.

    Each is the nearest node up to level on the path of a leaf; dist is the leaf's distance in metres, candidate_dist
    that of the node itself. Points without coordinates, and an empty gazetteer, give no row; rows are answered each for
    itself, also where a qid repeats or is null. index: items and leaf_points, if they are kept.
    """
    boxes, pairs = index or (staged(items(nodes), "items"), leaf_points(nodes))
    given, places = numbered_points(points)
    picked = staged(_picked(nearest_of(places, boxes), pairs), "picked")
    above = F.filter(on_path("path_ids"), lambda s: s["l"] <= level)
    up = with_path_levels(nodes).select(F.col("id").alias("leaf"), F.get(above, F.size(above) - 1)["v"].alias("node_id"))
    high = nodes.select(F.col("id").alias("node_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    lifted = picked.join(up, "leaf").join(high, "node_id")
    first = lifted.withColumn("r", F.row_number().over(Window.partitionBy("qid", "node_id").orderBy("rank"))).where("r = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["candidate_dist"] = geodesic(b["x"], b["y"], b["nx"], b["ny"])
            yield b[["x", "y", "rank", "node_id", "dist", "candidate_dist"]]

    made = ranked.select("x", "y", "rank", "node_id", "nx", "ny", "dist").mapInPandas(measure, "x double, y double, rank int, node_id bigint, dist double, candidate_dist double")
    return given.join(made, ["x", "y"]).select(F.col("asked").alias("qid"), "rank", "node_id", "dist", "candidate_dist")
