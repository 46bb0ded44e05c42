"""The gazetteer tree: preorder ids, nested sets and paths, built and navigated by equi-joins.

A node's subtree is the half-open id range [id, sibling_id). Joins never use that range: every node carries the ids and
names of its path, so an ancestor is an array element, and containment is membership.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import discard, staged

#: Levels of address elements, and their Japanese names.
LEVELS = {"UNDEFINED": -1, "PREF": 1, "COUNTY": 2, "CITY": 3, "WARD": 4, "OAZA": 5, "AZA": 6, "BLOCK": 7, "BLD": 8}
LEVEL_NAMES = {-1: "未定義", 1: "都道府県", 2: "郡", 3: "市町村・特別区", 4: "政令市の区", 5: "町域・大字", 6: "丁目・小字", 7: "街区・道路・地番", 8: "建物・枝番"}
UNKNOWN_LEVEL = "不明"
#: The name of an element without one, and the coordinate that stands for none.
NONAME, NO_COORDINATE = ".", 999.9


def dense_positions(df: DataFrame, *order: str | Column, name: str = "pos", first: int = 0) -> DataFrame:
    """df with its rank in the order as a dense number, from first on. A range-partitioned sort; no task sees all rows."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    placed = staged(placed, "positions")
    part, row = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one a partition
    starts, at = [], first
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    offsets = df.sparkSession.createDataFrame(starts or [(0, first)], "__p bigint, __at bigint")
    return placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__at") + row).drop("__p", "__at", "__m")


def build_tree(rows: DataFrame) -> DataFrame:
    """nodes of rows with path_key: one sort key a path element, in which siblings order by code point.

    Adds id (preorder, from 1), parent_id (0 under the root), sibling_id, path_ids, path_names and path_levels (from the
    top; levels if rows have any). A row whose parent is missing hangs on its nearest ancestor. The root itself is not a
    row; see with_root.
    """
    level = F.col("level") if "level" in rows.columns else F.lit(None).cast("int")
    placed = dense_positions(rows, "path_key", name="id", first=1)
    ids = staged(placed, "ids")
    discard(placed)
    # what lies above is looked for once for all rows of one parent, and only among rows that may have others below
    deepest = ids.agg(F.max(F.size("path_key"))).first()[0] or 0
    above = F.slice("path_key", F.lit(1), F.size("path_key") - 1)
    heads = ids.where(F.size("path_key") > 1).groupBy(above.alias("of")).agg(F.count("*").alias("n"))
    prefixes = heads.select("of", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("of")), lambda k: F.struct(k.alias("depth"), F.slice("of", F.lit(1), k).alias("key")))).alias("p")).select("of", "n", "p.*")
    named = ids.where(F.size("path_key") < deepest).select(F.col("path_key").alias("key"), F.col("id").alias("a_id"), F.col("name").alias("a_name"), level.alias("a_level"))
    paths = staged(prefixes.join(named, "key").select("of", "n", "depth", "a_id", "a_name", "a_level"), "paths")
    up = paths.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("depth", "a_id", "a_name", "a_level"))).alias("p"))
    down = paths.groupBy("a_id").agg(F.sum("n").alias("below"))
    nodes = ids.withColumn("__of", above).join(up, F.col("__of") == F.col("of"), "left").join(down, F.col("id") == F.col("a_id"), "left")

    def path(of: str, own: Column) -> Column:
        return F.concat(F.coalesce(F.col(f"p.{of}"), F.array().cast(f"array<{dict(paths.dtypes)[of]}>")), F.array(own))

    return nodes.select(
        *[c for c in rows.columns if c != "path_key"],
        "id",
        F.coalesce(F.element_at("p", -1)["a_id"], F.lit(0)).alias("parent_id"),
        (F.col("id") + F.coalesce("below", F.lit(0)) + 1).alias("sibling_id"),
        path("a_id", F.col("id")).alias("path_ids"),
        path("a_name", F.col("name")).alias("path_names"),
        path("a_level", level).alias("path_levels"),
    )


def with_path_levels(nodes: DataFrame) -> DataFrame:
    """nodes with path_levels, which tables of other builders lack: the levels of the path, from the top.

    Where nodes have it, what the path says of a node is read off its own row, without a join on ancestors, of which a
    prefecture's has millions of nodes.
    """
    if "path_levels" in nodes.columns:
        return nodes
    pairs = descendants(nodes).join(nodes.select(F.col("id").alias("ancestor_id"), F.col("level").alias("l")), "ancestor_id")
    levels = pairs.groupBy(F.col("id").alias("__of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ancestor_id", "l"))), lambda s: s["l"]).alias("path_levels"))
    return nodes.join(levels, F.col("id") == F.col("__of")).drop("__of")


def on_path(column: str, levels: list[int] | None = None) -> Column:
    """(level, value) of the path's elements, from the top: those on the given levels, or all."""
    every = F.transform(F.arrays_zip(F.col("path_levels").alias("l"), F.col(column).alias("v")), lambda s: F.struct(s["l"].alias("l"), s["v"].alias("v")))
    return every if levels is None else F.filter(every, lambda s: s["l"].isin(levels))


def last_on_path(column: str, levels: list[int]) -> Column:
    """The value of the lowest element of the path on one of the levels; null if there is none."""
    found = on_path(column, levels)
    return F.get(found, F.size(found) - 1)["v"]


def with_root(nodes: DataFrame) -> DataFrame:
    """nodes and the root: id 0, level -1, no name, no coordinates, all ids below it."""
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__n")).select(*[{"id": F.lit(0), "name": F.lit(""), "name_index": F.lit(""), "level": F.lit(-1), "parent_id": F.lit(-1), "sibling_id": F.col("__n") + 1, "x": F.lit(NO_COORDINATE), "y": F.lit(NO_COORDINATE), "priority": F.lit(0), "note": F.lit("")}.get(c, F.lit(None)).cast(t).alias(c) for c, t in nodes.dtypes])
    return nodes.unionByName(top)


def has_coordinates(x: str = "x", y: str = "y") -> Column:
    return F.col(x).between(-180, 180) & F.col(y).between(-90, 90)


def is_leaf() -> Column:
    return F.col("sibling_id") == F.col("id") + 1


def shown_name(alt: str = "", name: str = "name") -> Column:
    return F.when(F.col(name) == NONAME, alt).otherwise(F.col(name))


def fullname(delimiter: str = "", alt: str = "") -> Column:
    return F.array_join(F.transform("path_names", lambda n: F.when(n == NONAME, alt).otherwise(n)), delimiter)


def level_name(level: str | Column = "level") -> Column:
    names = F.create_map(*[F.lit(v) for pair in LEVEL_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, (F.col(level) if isinstance(level, str) else level).cast("int")), F.lit(UNKNOWN_LEVEL))


def parents(nodes: DataFrame) -> DataFrame:
    """Each node with its parent's columns as p_*; null under the root."""
    p = nodes.select(*[F.col(c).alias(f"p_{c}") for c in ("id", "name", "level")])
    return nodes.join(p, F.col("parent_id") == F.col("p_id"), "left")


def children(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(of, child columns) of every id in ids."""
    return nodes.join(ids.select(F.col("id").alias("of")), F.col("parent_id") == F.col("of"))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, id): every pair on a path, the node itself included."""
    return nodes.select(F.explode("path_ids").alias("ancestor_id"), "id")


def without_children(nodes: DataFrame) -> DataFrame:
    """The nodes that are no other's parent."""
    return nodes.join(nodes.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")


def subtree(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.array_contains("path_ids", F.lit(node_id).cast("bigint")))


def child_by_name(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (parent_id, name_index) with the child of that name; an equi-join."""
    return wanted.join(nodes, ["parent_id", "name_index"])


def by_names(nodes: DataFrame, names: list[str]) -> DataFrame:
    """The deepest node whose path is a prefix of names."""
    prefixes = [names[:k] for k in range(1, len(names) + 1)]
    at = nodes.where(F.col("path_names").isin([F.array(*[F.lit(n) for n in p]) for p in prefixes]) if prefixes else F.lit(False))
    return at.orderBy(F.size("path_names").desc(), "id").limit(1)


def upper_node(nodes: DataFrame, levels: list[int]) -> DataFrame:
    """(id, upper_id): the nearest of the node and its ancestors whose level is among levels; null if none."""
    return with_path_levels(nodes).select("id", last_on_path("path_ids", levels).alias("upper_id"))


def nodes_by_level(nodes: DataFrame) -> DataFrame:
    """(id, levels): for each level up to the node's own, the names on its path at that level, as an array of arrays."""
    named = with_path_levels(nodes).select("id", "level", on_path("path_names").alias("p"))
    per = F.transform(F.sequence(F.lit(0), F.col("level")), lambda k: F.transform(F.filter("p", lambda s: s["l"] == k), lambda s: s["v"]))
    return named.select("id", per.alias("levels"))


def dummy_coordinates(nodes: DataFrame) -> DataFrame:
    """nodes with fx, fy: the node's own coordinates, or those of its first child that has some, else none."""
    first = nodes.where(has_coordinates()).groupBy(F.col("parent_id").alias("__of")).agg(F.min_by(F.struct("x", "y"), "id").alias("__c"))
    joined = nodes.join(first, F.col("id") == F.col("__of"), "left")
    own = has_coordinates()
    return joined.select(*nodes.columns, F.when(own, F.col("x")).otherwise(F.coalesce("__c.x", "x")).alias("fx"), F.when(own, F.col("y")).otherwise(F.coalesce("__c.y", "y")).alias("fy"))


def as_dict_columns(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", "x", "y", "level", "priority", "note", "parent_id", "sibling_id", F.col("path_names").alias("fullname"))


def geojson(nodes: DataFrame) -> DataFrame:
    """(id, geojson): a Feature of each node."""
    props = F.struct("id", "name", "level", "priority", "note", F.col("path_names").alias("fullname"))
    return nodes.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("geojson"))


def map_links() -> tuple[Column, Column]:
    """Links to the two public map services that the address level and coordinates lead to."""
    gsi = F.format_string("https://maps.gsi.go.jp/#%d/%.6f/%.6f/", F.col("level") + 9, F.col("y"), F.col("x"))
    google = F.format_string("https://maps.google.com/maps?q=%.6f,%.6f&z=%d", F.col("y"), F.col("x"), F.col("level") + 9)
    return gsi, google


def guessed_level(name: str = "name", parent_name: str = "parent_name", parent_level: str = "parent_level", trigger_level: str = "trigger_level") -> Column:
    """The level that a new element of that name has below its parent (0 or less: the root), as its name suggests.

    Null where a part of a block would need a parent that cannot have one.
    """
    n, p = F.col(name), F.col(parent_level)
    last = F.right(n, F.lit(1))
    return (
        F.when(p < 1, 1)
        .when((p == 1) & ((last == "郡") | n.endswith("支庁") | n.endswith("振興局")), 2)
        .when(last.isin("市", "町", "村") & (p < 3), 3)
        .when(last.isin("市", "町", "村") & p.isin(3, 5), p + 1)
        .when((last == "区") & (p == 3), 4)
        .when((last == "区") & (F.col(parent_name) == "東京都"), 3)
        .when(p < 5, 5)
        .when(p == 5, 6)
        .when((p == 6) & (F.col(trigger_level) <= 7), 6)
        .when(p == 6, 7)
    )
