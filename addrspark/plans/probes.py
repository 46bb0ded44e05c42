"""Every operator of the engine as a query over the star gazetteer, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import codes, tree
from .star import STAR_SQL, star_nodes

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def probe(names: str, sql: str | None = None, star: bool = True):
    """Register a query under its names; sql follows the star gazetteer's WITH unless star is false."""

    def register(f):
        for name in names.split():
            _queries[name] = (lambda spark, sf_dir: f(star_nodes(spark, sf_dir))) if star else f
            if sql is not None:
                _sql[name] = STAR_SQL + sql if star else sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- construction, scans and counts

probe("nodes_build", "SELECT id, parent_id, sibling_id, level, name, name_index, round(x, 6) AS x, round(y, 6) AS y, priority, note FROM nodes")(
    lambda n: n.select("id", "parent_id", "sibling_id", "level", "name", "name_index", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "priority", "note")
)
probe("node_count", "SELECT count(*) AS n FROM nodes")(lambda n: n.agg(F.count("*").alias("n")))
probe("level_counts", "SELECT level, count(*) AS n FROM nodes GROUP BY level")(lambda n: n.groupBy("level").agg(F.count("*").alias("n")))
probe("leaf_flag", "SELECT id, sibling_id = id + 1 AS is_leaf FROM nodes")(lambda n: n.select("id", tree.is_leaf().alias("is_leaf")))
probe("root_node", "SELECT CAST(0 AS BIGINT) AS id, '' AS name, -1 AS level, max(id) + 1 AS sibling_id FROM nodes")(
    lambda n: tree.with_root(n).where("id = 0").select("id", "name", "level", "sibling_id")
)
probe("id_point_lookup", "SELECT id, name FROM nodes WHERE id IN (1, 17, 400)")(lambda n: n.where(F.col("id").isin(1, 17, 400)).select("id", "name"))
probe("id_range_scan", "SELECT id, name, level FROM nodes WHERE id >= 100 AND id < 160")(lambda n: n.where("id >= 100 AND id < 160").select("id", "name", "level"))
probe("offset_limit", "SELECT id, name FROM nodes WHERE level = 7 ORDER BY id LIMIT 20 OFFSET 15")(lambda n: n.where("level = 7").orderBy("id").offset(15).limit(20).select("id", "name"))
probe("filtered_scan_params", "SELECT id, name FROM nodes WHERE level <= 7 AND name_index >= 'CUSTOMER#000000100' AND name_index < 'CUSTOMER#000000200'")(
    lambda n: n.sparkSession.sql("SELECT id, name FROM {n} WHERE level <= :m AND name_index >= :a AND name_index < :b", args={"m": 7, "a": "CUSTOMER#000000100", "b": "CUSTOMER#000000200"}, n=n)
)
probe("strided_slice", "SELECT id, name FROM nodes WHERE id >= 10 AND id < 500 AND (id - 10) % 7 = 0")(lambda n: n.where("id >= 10 AND id < 500 AND (id - 10) % 7 = 0").select("id", "name"))


@probe("append_positions", "SELECT name, row_number() OVER (ORDER BY id) + 9 AS pos FROM nodes")
def _append_all(n: DataFrame) -> DataFrame:
    return tree.dense_positions(n.select("id", "name"), "id", name="pos", first=10).select("name", "pos")


@probe("update_merge", "SELECT id, CASE WHEN id % 5 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 10 = 0 THEN 9 ELSE priority END AS priority FROM nodes")
def _update(n: DataFrame) -> DataFrame:
    from ..sources.store import merge_updates

    changes = n.where("id % 5 = 0").select("id", F.lit("renamed").alias("name"), F.when(F.col("id") % 10 == 0, 9).alias("priority"))
    return merge_updates(n.select("id", "name", "priority"), changes, "id")


# --- joins along the tree

probe("parent_join", "SELECT a.id, p.name AS parent_name FROM nodes a LEFT JOIN nodes p ON p.id = a.parent_id")(lambda n: tree.parents(n).select("id", F.col("p_name").alias("parent_name")))
probe("children_list", "SELECT p.id, string_agg(c.name, '/' ORDER BY c.id) AS children FROM nodes p JOIN nodes c ON c.parent_id = p.id GROUP BY p.id")(
    lambda n: tree.children(n, n).groupBy(F.col("of").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda s: s["name"]), "/").alias("children"))
)
probe("child_by_name", "SELECT q.parent_id, q.name_index, c.id FROM nodes q JOIN nodes c ON c.parent_id = q.parent_id AND c.name_index = q.name_index")(
    lambda n: tree.child_by_name(n, n.select("parent_id", "name_index")).select("parent_id", "name_index", "id")
)
probe(
    "fullname",
    ", RECURSIVE_UP AS (SELECT 1) SELECT a.id, concat_ws('/', r.name, t.name, k.name, CASE WHEN a.level = 8 THEN a.name END) AS fullname FROM nodes a LEFT JOIN nodes r ON r.level = 1 AND r.r = a.r LEFT JOIN nodes t ON t.level = 3 AND t.n = a.n LEFT JOIN nodes k ON k.level = 7 AND k.c = a.c",
)(lambda n: n.select("id", tree.fullname("/").alias("fullname")))
probe("parent_list", "SELECT a.id, string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id) AS path FROM nodes a JOIN nodes p ON p.id <= a.id AND a.id < p.sibling_id GROUP BY a.id")(
    lambda n: tree.descendants(n).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("ancestor_id")).cast("array<string>"), ",").alias("path"))
)
probe("nodes_by_level", "SELECT a.id, len(list_filter([1, 3, 7, 8], lambda v: v <= a.level)) AS levels, a.level + 1 AS slots FROM nodes a")(
    lambda n: tree.nodes_by_level(n).select("id", F.size(F.filter("levels", lambda x: F.size(x) > 0)).cast("bigint").alias("levels"), F.size("levels").alias("slots"))
)
probe("upper_node", "SELECT a.id, p.id AS upper_id FROM nodes a LEFT JOIN nodes p ON p.level = 3 AND p.n = a.n AND a.n IS NOT NULL")(lambda n: tree.upper_node(n, [3, 4]))
probe("subtree_containment", "SELECT c.id AS city_id, d.id FROM nodes c JOIN nodes d ON c.id <= d.id AND d.id < c.sibling_id WHERE c.level = 3 AND c.n IN (3, 8)")(
    lambda n: tree.descendants(n).join(n.where("level = 3 AND name IN ('NATION_3', 'NATION_8')").select(F.col("id").alias("ancestor_id")), "ancestor_id").select(F.col("ancestor_id").alias("city_id"), "id")
)
probe("descendant_count", "SELECT id, sibling_id - id - 1 AS below FROM nodes")(lambda n: tree.descendants(n).groupBy(F.col("ancestor_id").alias("id")).agg((F.count("*") - 1).alias("below")))
probe("search_by_tree", "SELECT id FROM nodes WHERE level = 3 AND n = 3")(lambda n: _by_tree(n))


def _by_tree(n: DataFrame) -> DataFrame:
    names = n.where("name = 'NATION_3'").select("path_names").first()["path_names"]
    return tree.by_names(n, [*names, "nobody"]).select("id")


@probe("rollup_by_level", "SELECT p.level, p.id, count(*) AS n, min(d.x) AS min_x FROM nodes p JOIN nodes d ON p.id <= d.id AND d.id < p.sibling_id WHERE p.level <= 3 AND d.level = 8 GROUP BY p.level, p.id")
def _rollup(n: DataFrame) -> DataFrame:
    pairs = tree.descendants(n).join(n.where("level = 8").select("id", "x"), "id").groupBy("ancestor_id").agg(F.count("*").alias("n"), F.min("x").alias("min_x"))
    return pairs.join(n.where("level <= 3").select("id", "level"), F.col("ancestor_id") == F.col("id")).select("level", "id", "n", "min_x")


# --- projections and predicates

probe("valid_coords", "SELECT id, x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 AS valid FROM nodes")(lambda n: n.select("id", tree.has_coordinates().alias("valid")))
probe("level_name", "SELECT id, CASE level WHEN 1 THEN '都道府県' WHEN 3 THEN '市町村・特別区' WHEN 7 THEN '街区・道路・地番' WHEN 8 THEN '建物・枝番' ELSE '不明' END AS level_name FROM nodes")(
    lambda n: n.select("id", tree.level_name().alias("level_name"))
)
probe("map_links", "SELECT id, printf('https://maps.gsi.go.jp/#%d/%.6f/%.6f/', level + 9, y, x) AS gsi, printf('https://maps.google.com/maps?q=%.6f,%.6f&z=%d', y, x, level + 9) AS google FROM nodes")(
    lambda n: n.select("id", tree.map_links()[0].alias("gsi"), tree.map_links()[1].alias("google"))
)
probe("shown_name", "SELECT id, CASE WHEN name = '.' THEN '-' ELSE name END AS shown FROM nodes")(lambda n: n.select("id", tree.shown_name("-").alias("shown")))
probe("geojson", "SELECT id, 'Feature' AS type, name, level, round(x, 6) AS x, round(y, 6) AS y FROM nodes")(
    lambda n: tree.geojson(n).select(
        "id",
        F.get_json_object("geojson", "$.type").alias("type"),
        F.get_json_object("geojson", "$.properties.name").alias("name"),
        F.get_json_object("geojson", "$.properties.level").cast("int").alias("level"),
        *[F.round(F.get_json_object("geojson", f"$.geometry.coordinates[{k}]").cast("double"), 6).alias(c) for k, c in enumerate("xy")],
    )
)
probe("dummy_coords", "SELECT a.id, round(CASE WHEN a.x <= 180 THEN a.x ELSE coalesce((SELECT arg_min(k.x, k.id) FROM nodes k WHERE k.parent_id = a.id AND k.x <= 180), a.x) END, 6) AS fx FROM nodes a")(
    lambda n: tree.dummy_coordinates(n).select("id", F.round("fx", 6).alias("fx"))
)
_CODED = ", coded AS (SELECT *, lpad(CAST(r + 1 AS VARCHAR), 2, '0') AS pref, CASE WHEN n IS NULL THEN '' ELSE lpad(CAST(r + 1 AS VARCHAR), 2, '0') || lpad(CAST(n AS VARCHAR), 3, '0') END AS city FROM nodes) "
probe("path_codes", _CODED + "SELECT id, pref AS pref_code, city AS city_code, CASE WHEN c IS NULL THEN '' ELSE lpad(CAST(c % 10000000 AS VARCHAR), 7, '0') END AS aza_id FROM coded")(lambda n: codes.with_codes(n).select("id", "pref_code", "city_code", "aza_id"))
probe("aza_code", _CODED + "SELECT id, CASE WHEN c IS NULL THEN '' ELSE city || lpad(CAST(c % 10000000 AS VARCHAR), 7, '0') END AS aza_code FROM coded")(lambda n: codes.with_codes(n).select("id", codes.aza_code().alias("aza_code")))
probe("area_predicate", _CODED + "SELECT id, CASE WHEN city = '01005' THEN 1 WHEN city <> '' THEN 0 WHEN pref <> '01' THEN 0 ELSE -1 END AS by_city, CASE WHEN pref = '02' THEN 1 ELSE 0 END AS by_pref, CASE WHEN n = 3 THEN 1 ELSE 0 END AS by_name FROM coded")(
    lambda n: codes.with_codes(n).select("id", codes.inside("01005", "01005").alias("by_city"), codes.inside("02", "02").alias("by_pref"), codes.inside("NATION_3", "NATION_3").alias("by_name"))
)

_UP = " FROM nodes a JOIN nodes p ON p.level = 1 AND p.r = a.r LEFT JOIN nodes t ON t.level = 3 AND t.n = a.n LEFT JOIN nodes k ON k.level = 7 AND k.c = a.c"
probe("area_names", "SELECT a.id, p.name AS pref_name, coalesce(t.name, '') AS city_name" + _UP)(lambda n: codes.with_area_names(n).select("id", "pref_name", "city_name"))


@probe("aza_names", "SELECT a.id, concat_ws('/', p.name, CASE WHEN a.level > 3 OR a.n > 0 THEN t.name END, k.name) AS names" + _UP)
def _aza_names(n: DataFrame) -> DataFrame:
    """The registry's names; the code of the first city of a region stands for the region."""
    found = codes.aza_names(codes.with_codes(n), _registry(n))
    return found.select("id", F.array_join(F.transform("names", lambda s: s["name"]), "/").alias("names"))


# --- notes and codes

probe("notes_split", "SELECT id, split_part(p, ':', 1) AS k, split_part(p, ':', 2) AS v FROM (SELECT id, unnest(string_split(note, '/')) AS p FROM nodes WHERE note <> '')")(
    lambda n: n.select("id", F.explode(codes.notes_of()).alias("s")).select("id", "s.k", "s.v")
)
probe("notes_join", "SELECT id, note AS joined FROM nodes")(lambda n: n.withColumn("notes", codes.notes_of()).select("id", codes.joined_notes().alias("joined")))
probe("code_index", "SELECT split_part(p, ':', 1) AS category, count(DISTINCT split_part(p, ':', 2)) AS n_values, count(*) AS n_nodes FROM (SELECT id, unnest(string_split(note, '/')) AS p FROM nodes WHERE note <> '') GROUP BY 1")(
    lambda n: codes.code_index(n).groupBy("category").agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n_nodes"))
)


def _wanted(n: DataFrame, *values: str) -> DataFrame:
    return n.sparkSession.createDataFrame([(v,) for v in values], "code string")


probe("postcode_lookup", "SELECT v AS code, id AS node_id FROM nodes JOIN (VALUES ('0000070'), ('0100500')) t(v) ON note LIKE '%postcode:' || v")(lambda n: codes.search_by_code(codes.code_index(n), _wanted(n, "0000070", "0100500", "123"), "postcode"))
probe("pref_lookup", "SELECT v AS code, id AS node_id FROM nodes JOIN (VALUES ('01'), ('020000')) t(v) ON note LIKE '%jisx0401:' || substr(v, 1, 2)")(lambda n: codes.search_by_code(codes.code_index(n), _wanted(n, "01", "020000", "9"), "prefcode"))
probe("city_lookup", "SELECT v AS code, id AS node_id FROM nodes JOIN (VALUES ('01005'), ('010105')) t(v) ON note LIKE 'jisx0402:' || substr(v, 1, 5) || '%'")(lambda n: codes.search_by_code(codes.code_index(n), _wanted(n, "01005", "010105", "9"), "citycode"))


@probe(
    "machiaza_lookup",
    _CODED + ", b AS (SELECT id, city, lpad(CAST(c % 10000000 AS VARCHAR), 7, '0') AS aza FROM coded WHERE level = 7) SELECT city || aza AS code, id AS node_id FROM b UNION ALL SELECT aza, id FROM b",
)
def _machiaza_all(n: DataFrame) -> DataFrame:
    coded = codes.with_codes(n.where("level <= 7")).where("level = 7")
    wanted = coded.select(codes.aza_code().alias("code")).unionByName(coded.select(F.col("aza_id").alias("code"))).distinct()
    return codes.search_by_machiaza(codes.code_index(n), n, wanted)


probe("clean_code", "SELECT id, regexp_replace(name, '[^0-9]', '', 'g') AS digits FROM nodes")(lambda n: n.select("id", codes.clean_code("name").alias("digits")))
probe(
    "local_authority_code",
    _CODED + ", t AS (SELECT id, city, CAST(substr(city, 1, 1) AS INT) * 6 + CAST(substr(city, 2, 1) AS INT) * 5 + CAST(substr(city, 3, 1) AS INT) * 4 + CAST(substr(city, 4, 1) AS INT) * 3 + CAST(substr(city, 5, 1) AS INT) * 2 AS s FROM coded WHERE level = 3) SELECT id, city || CAST(CASE WHEN s < 11 THEN 11 - s ELSE (11 - s % 11) % 10 END AS VARCHAR) AS lg_code FROM t",
)(lambda n: codes.with_codes(n).where("level = 3").select("id", codes.local_authority_code("city_code").alias("lg_code")))


def _registry(n: DataFrame) -> DataFrame:
    coded = codes.with_codes(n.where("level <= 7")).where("level = 7")
    names = F.transform(F.arrays_zip(F.array(F.lit(1), F.lit(3), F.lit(7)), "path_names"), lambda s: F.struct(s["0"].alias("level"), s["path_names"].alias("name")))
    return coded.select(codes.aza_code().alias("code"), names.alias("names"), F.lit(3).alias("aza_class"), "postcode")


@probe(
    "code_to_registry",
    _CODED + ", reg AS (SELECT k.city || lpad(CAST(k.c % 10000000 AS VARCHAR), 7, '0') AS code, k.city, k.pref, k.n, p.name AS r_name, t.name AS n_name, k.name, lpad(CAST(k.c % 1000 * 7 AS VARCHAR), 7, '0') AS postcode FROM coded k JOIN coded t ON t.level = 3 AND t.n = k.n JOIN coded p ON p.level = 1 AND p.r = k.r WHERE k.level = 7) SELECT code, code AS aza_code, r_name || '/' || n_name || '/' || name AS names, postcode FROM reg UNION ALL SELECT DISTINCT city, CASE WHEN n = 0 THEN pref ELSE city END, CASE WHEN n = 0 THEN r_name ELSE r_name || '/' || n_name END, NULL FROM reg UNION ALL SELECT DISTINCT pref, pref, r_name, NULL FROM reg",
)
def _to_registry_all(n: DataFrame) -> DataFrame:
    reg = _registry(n)
    wanted = reg.select(F.explode(F.array("code", F.substring("code", 1, 5), F.substring("code", 1, 2))).alias("code")).distinct()
    return codes.search_registry(reg, wanted).select("code", "aza_code", F.array_join(F.transform("names", lambda s: s["name"]), "/").alias("names"), "postcode")


probe(
    "code_lower_bound",
    _CODED + ", reg AS (SELECT city || lpad(CAST(c AS VARCHAR), 7, '0') AS code FROM coded WHERE level = 7 AND c % 3 = 0), q AS (SELECT city || lpad(CAST(c AS VARCHAR), 7, '0') AS code FROM coded WHERE level = 7 UNION SELECT '00' UNION SELECT '99') SELECT q.code, (SELECT max(reg.code) FROM reg WHERE reg.code <= q.code) AS bound FROM q",
)(lambda n: codes.lower_bound(_registry(n).where("try_cast(substring(code, 6) AS int) % 3 = 0"), _registry(n).select("code").unionByName(_wanted(n, "00", "99"))))

# --- prefix joins over notations


def _keys(n: DataFrame) -> DataFrame:
    from ..operators.index import notation_index

    return notation_index(n.where("level <= 3"))


probe("exact_key", "SELECT name_index AS key, id AS node_id FROM nodes WHERE level = 3")(lambda n: _keys(n).join(n.where("level = 3").select(F.col("name_index").alias("key"), F.col("id").alias("node_id")), ["key", "node_id"]).select("key", "node_id"))
_QUERIES = ", keys AS (SELECT a.name_index AS key, a.id AS node_id FROM nodes a WHERE a.level IN (1, 3) UNION SELECT p.name_index || a.name_index, a.id FROM nodes a JOIN nodes p ON p.id = a.parent_id WHERE a.level = 3), q AS (SELECT a.id AS qid, CASE WHEN a.id % 2 = 0 THEN p.name_index || t.name_index || a.name_index ELSE t.name_index || a.name_index END AS text FROM nodes a JOIN nodes t ON t.id = a.parent_id JOIN nodes p ON p.id = t.parent_id WHERE a.level = 7 UNION ALL SELECT a.id, CASE WHEN a.id % 2 = 0 THEN p.name_index || t.name_index || k.name_index || a.name_index ELSE t.name_index || k.name_index || a.name_index END FROM nodes a JOIN nodes k ON k.id = a.parent_id JOIN nodes t ON t.id = k.parent_id JOIN nodes p ON p.id = t.parent_id WHERE a.level = 8) "


def _texts(n: DataFrame) -> DataFrame:
    """Of every node below the cities its path, every second one without its first element."""
    up = F.transform("path_names", lambda x: F.upper(x))
    return n.where("level >= 7").select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, F.array_join(up, "")).otherwise(F.array_join(F.slice(up, F.lit(2), F.size(up) - 1), "")).alias("text"))


def _prefixes(n: DataFrame) -> DataFrame:
    from ..operators.index import common_prefixes

    return common_prefixes(_texts(n), _keys(n))


probe("common_prefixes", _QUERIES + "SELECT qid, key, node_id FROM q JOIN keys ON starts_with(text, key)")(lambda n: _prefixes(n).select("qid", "key", "node_id"))
probe("predict_prefixes", _QUERIES + "SELECT v AS prefix, key, node_id FROM keys JOIN (VALUES ('NATION_1'), ('A'), ('ZZ')) t(v) ON starts_with(key, v)")(lambda n: _predict(n))
@probe("longest_match_best", _QUERIES + "SELECT qid, key, node_id FROM q JOIN keys ON starts_with(text, key) QUALIFY length(key) = max(length(key)) OVER (PARTITION BY qid)")
def _longest(n: DataFrame) -> DataFrame:
    from ..operators.search import longest

    return longest(_prefixes(n), F.length("key")).select("qid", "key", "node_id")


@probe("matched_groups", _QUERIES + "SELECT qid, key AS matched, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS nodes FROM q JOIN keys ON starts_with(text, key) GROUP BY qid, key")
def _groups(n: DataFrame) -> DataFrame:
    from ..operators.search import grouped

    found = grouped(_prefixes(n).withColumnRenamed("key", "matched"), ["node_id"])
    return found.select("qid", "matched", F.array_join(F.transform("candidates", lambda c: c["node_id"].cast("string")), ",").alias("nodes"))


@probe("drop_ancestors", _QUERIES + ", hits AS (SELECT DISTINCT qid, node_id FROM q JOIN keys ON starts_with(text, key)) SELECT h.qid, h.node_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits d JOIN nodes k ON k.id = d.node_id WHERE d.qid = h.qid AND k.parent_id = h.node_id)")
def _drop_ancestors(n: DataFrame) -> DataFrame:
    from ..operators.search import without_ancestors

    hits = _prefixes(n).select("qid", "node_id").distinct()
    return without_ancestors(hits.join(n.select(F.col("id").alias("node_id"), "path_ids"), "node_id")).select("qid", "node_id")


def _predict(n: DataFrame) -> DataFrame:
    from ..operators.index import predict_prefixes

    return predict_prefixes(_keys(n), n.sparkSession.createDataFrame([("NATION_1",), ("A",), ("ZZ",)], "prefix string"))


# --- sets, dimension joins, distinct coordinates

probe("anti_join", "SELECT id FROM nodes WHERE sibling_id = id + 1")(lambda n: tree.without_children(n).select("id"))
probe("union_dedup", "SELECT id FROM nodes WHERE level = 3 UNION SELECT parent_id FROM nodes WHERE level = 7")(lambda n: n.where("level = 3").select("id").union(n.where("level = 7").select("parent_id")).distinct())
probe("except_ids", "SELECT id FROM nodes EXCEPT SELECT parent_id FROM nodes")(lambda n: n.select("id").subtract(n.select(F.col("parent_id").alias("id"))))


@probe("dataset_join", "SELECT id, t.title FROM nodes LEFT JOIN (VALUES (1, 'areas'), (3, 'parcels')) t(did, title) ON did = priority")
def _datasets(n: DataFrame) -> DataFrame:
    from ..sources.registry import datasets, with_dataset

    return with_dataset(n, datasets(n.sparkSession, [(1, "areas", "http://a/"), (3, "parcels", "http://p/")])).select("id", "title")


@probe("distinct_coords", "SELECT min(id) AS id, n, round(x, 6) AS x, round(y, 6) AS y FROM nodes WHERE level >= 7 GROUP BY n, x, y")
def _distinct(n: DataFrame) -> DataFrame:
    from ..operators.reverse import distinct_points

    number = n.where("level = 3").select(F.col("id").alias("ward"), F.substring("name", 8, 9).cast("int").alias("n"))
    return distinct_points(n, n.where("level >= 7")).join(number, "ward").select(F.col("item").alias("id"), "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@probe("block_bbox", "SELECT k.id AS block_id, round(least(min(d.x), k.x), 6) AS x0, round(least(min(d.y), k.y), 6) AS y0, round(greatest(max(d.x), k.x), 6) AS x1, round(greatest(max(d.y), k.y), 6) AS y1 FROM nodes k JOIN nodes d ON d.parent_id = k.id WHERE k.level = 7 GROUP BY k.id, k.x, k.y")
def _boxes(n: DataFrame) -> DataFrame:
    from ..operators.reverse import block_boxes

    return block_boxes(n).select(F.col("item").alias("block_id"), *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


# --- space

_ITEMS = """, boxes AS (SELECT k.id AS item, least(min(d.x), k.x) AS x0, least(min(d.y), k.y) AS y0, greatest(max(d.x), k.x) AS x1, greatest(max(d.y), k.y) AS y1 FROM nodes k JOIN nodes d ON d.parent_id = k.id WHERE k.level = 7 GROUP BY k.id, k.x, k.y
  UNION ALL SELECT min(id), x, y, x, y FROM nodes WHERE level = 7 AND sibling_id = id + 1 GROUP BY n, x, y),
pts AS (SELECT id AS qid, x + 0.0004 AS x, y + 0.0003 AS y FROM nodes WHERE x <= 180) """


def _all_points(n: DataFrame) -> DataFrame:
    """A point beside every node that has coordinates, of all levels."""
    return n.where(tree.has_coordinates()).select(F.col("id").alias("qid"), (F.col("x") + 0.0004).alias("x"), (F.col("y") + 0.0003).alias("y"))


@probe("spatial_items", _ITEMS + "SELECT item, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM boxes")
def _items(n: DataFrame) -> DataFrame:
    from ..operators.reverse import items

    return items(n).select("item", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@probe("knn20", _ITEMS + ", d AS (SELECT qid, item, greatest(x0 - x, 0.0, x - x1) AS dx, greatest(y0 - y, 0.0, y - y1) AS dy FROM pts CROSS JOIN boxes), e AS (SELECT qid, item, dx * dx + dy * dy AS d2 FROM d) SELECT qid, item FROM (SELECT qid, item, rank() OVER (PARTITION BY qid ORDER BY d2) AS k FROM e) WHERE k <= 20")
def _knn_all(n: DataFrame) -> DataFrame:
    from ..operators.reverse import items, nearest
    from .staging import staged

    return nearest(_all_points(n), staged(items(n), "items")).select("qid", "item")


@probe("reverse_full")
def _reverse(n: DataFrame) -> DataFrame:
    from ..operators.reverse import reverse_geocode

    return reverse_geocode(n, _all_points(n), 7)


def _corners():
    return [F.lit(v) for v in (135.2, 35.1, 135.9, 35.2, 135.5, 35.7)]


@probe("point_in_triangle", ", s AS (SELECT id, (135.9 - 135.2) * (y - 35.1) - (35.2 - 35.1) * (x - 135.2) AS a, (135.5 - 135.9) * (y - 35.2) - (35.7 - 35.2) * (x - 135.9) AS b, (135.2 - 135.5) * (y - 35.7) - (35.1 - 35.7) * (x - 135.5) AS c FROM nodes) SELECT id, (a > 0 AND b > 0 AND c > 0) OR (a < 0 AND b < 0 AND c < 0) AS inside FROM s")
def _triangle_all(n: DataFrame) -> DataFrame:
    from ..functions.geometry import in_triangle_column

    return n.select("id", in_triangle_column(F.col("x"), F.col("y"), *_corners()).alias("inside"))


@probe("circumcircle", ", p AS (SELECT id, x AS ax, y AS ay, 135.2 - x AS bx, 35.1 - y AS b, 135.9 - x AS cx, 35.2 - y AS c FROM nodes WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90), d AS (SELECT *, 2 * (bx * c - b * cx) AS d FROM p), u AS (SELECT id, ax, ay, (c * (bx * bx + b * b) - b * (cx * cx + c * c)) / d AS ux, (bx * (cx * cx + c * c) - cx * (bx * bx + b * b)) / d AS uy FROM d WHERE abs(d) > 0.01) SELECT id, round(ax + ux, 6) AS x, round(ay + uy, 6) AS y, round(ux * ux + uy * uy, 6) AS r2 FROM u")
def _circle_all(n: DataFrame) -> DataFrame:
    from ..functions.geometry import circumcircle_columns, cross_column

    b = [F.lit(v) for v in (135.2, 35.1, 135.9, 35.2)]
    far = F.abs(2 * cross_column(F.col("x"), F.col("y"), *b)) > 0.01
    x, y, r2 = circumcircle_columns(F.col("x"), F.col("y"), *b)
    return n.where(tree.has_coordinates()).where(far).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(r2, 6).alias("r2"))


def _geodesic_sql(lon: float, lat: float, rounds: int = 8) -> str:
    """Vincenty's inverse formula between every node and one point, each round of it a table of its own."""
    f, a = "(1 / 298.257223563)", "6378137.0"
    of = "(SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS sin_s, s1 * s2 + c1 * c2 * cos(lam) AS cos_s FROM {})"
    of = f"(SELECT *, CASE WHEN sin_s > 0 THEN c1 * c2 * sin(lam) / sin_s ELSE 0 END AS sin_a, atan2(sin_s, cos_s) AS sigma FROM {of})"
    of = f"(SELECT *, 1 - sin_a * sin_a AS cos2 FROM {of})"
    of = f"(SELECT *, CASE WHEN cos2 > 0 THEN cos_s - 2 * s1 * s2 / cos2 ELSE 0 END AS mid, {f} / 16 * cos2 * (4 + {f} * (4 - 3 * cos2)) AS c FROM {of})"
    out = f", u AS (SELECT id, radians({lon}) - radians(x) AS gap, atan((1 - {f}) * tan(radians(y))) AS u1, atan((1 - {f}) * tan(radians({lat}))) AS u2 FROM nodes WHERE x BETWEEN -180 AND 180)"
    out += ", g0 AS (SELECT id, gap, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, gap AS lam FROM u)"
    for k in range(rounds):
        out += f", g{k + 1} AS (SELECT id, gap, s1, c1, s2, c2, gap + (1 - c) * {f} * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1))) AS lam FROM {of.format(f'g{k}')})"
    b = f"({a} * (1 - {f}))"
    k2 = f"(SELECT *, cos2 * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS k FROM {of.format(f'g{rounds}')})"
    ab = f"(SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS ba, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS bb FROM {k2})"
    delta = f"(SELECT *, bb * sin_s * (mid + bb / 4 * (cos_s * (2 * mid * mid - 1) - bb / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3))) AS d FROM {ab})"
    return out + f" SELECT n.id, round({b} * ba * (sigma - d), 3) AS metres FROM nodes n LEFT JOIN {delta} m ON m.id = n.id"


@probe("geodesic", _geodesic_sql(135.5, 35.4))
def _geodesic(n: DataFrame) -> DataFrame:
    from ..functions.geometry import geodesic_column

    metres = geodesic_column(F.col("x"), F.col("y"), 135.5, 35.4)
    return n.select("id", F.when(tree.has_coordinates(), F.round(metres, 3)).alias("metres"))


# --- text

_DOCS = "SELECT doc_id, "


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sql_translate(text: str, pairs: dict[str, str]) -> str:
    """DuckDB's translate() of text; it keeps the first of equal characters, as Spark's does."""
    quoted = ["".join(x).replace("'", "''") for x in (pairs.keys(), pairs.values())]
    return f"translate({text}, '{quoted[0]}', '{quoted[1]}')"


def _std_sql() -> str:
    """plain_column over the whole texts; DuckDB's upper() leaves ß, which is SS in capitals."""
    from ..functions.normalize import HYPHENS, Standard, _ASCII, _KATAKANA

    c = _sql_translate("regexp_replace(coalesce(text, ''), '^(?:大字|小字|字)', '')", Standard().map)
    c = "upper(replace(" + _sql_translate(c, {chr(k): chr(v) for k, v in _ASCII.items()}) + ", 'ß', 'SS'))"
    c = _sql_translate(c, {chr(k): chr(v) for k, v in _KATAKANA.items()})
    return _sql_translate(f"replace({c}, '通リ', '通')", dict.fromkeys(HYPHENS, "-"))


@probe("std_native", _DOCS + _std_sql() + " AS std FROM documents", star=False)
def _std_native_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.normalize import Standard

    return _docs(spark, sf_dir).select("doc_id", Standard().plain_column("text").alias("std"))


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


_TALK = "SELECT conv_id, turn, "
#: Numerals of the standard text; the given texts have ASCII digits alone.
_FULL_SQL = r"regexp_replace(" + _std_sql() + r", '0*([0-9]+)\.?', '\1.', 'g') AS std"
_NUMBER_SQL = "CASE WHEN regexp_extract(coalesce(text, ''), '^[0-9]+') = '' THEN 0 ELSE TRY_CAST(regexp_extract(text, '^[0-9]+') AS BIGINT) END AS n, CAST(length(regexp_extract(coalesce(text, ''), '^[0-9]+')) AS BIGINT) AS i"


def _standard(df: DataFrame, *keys: str) -> DataFrame:
    from ..functions.normalize import Standard

    return df.select(*keys, Standard().column("text").alias("std"))


def _number(df: DataFrame, *keys: str) -> DataFrame:
    from ..functions.normalize import number_udf

    return df.select(*keys, number_udf("text").alias("r")).select(*keys, "r.n", F.col("r.i").cast("bigint").alias("i"))


probe("std_full", _TALK + _FULL_SQL + " FROM conversations", star=False)(lambda spark, sf_dir: _standard(_talk(spark, sf_dir), "conv_id", "turn"))
probe("std_full_text", _DOCS + _FULL_SQL + " FROM documents", star=False)(lambda spark, sf_dir: _standard(_docs(spark, sf_dir), "doc_id"))
probe("get_number", _TALK + _NUMBER_SQL + " FROM conversations", star=False)(lambda spark, sf_dir: _number(_talk(spark, sf_dir), "conv_id", "turn"))
probe("get_number_text", _DOCS + _NUMBER_SQL + " FROM documents", star=False)(lambda spark, sf_dir: _number(_docs(spark, sf_dir), "doc_id"))


@probe("char_class", "SELECT event_id, CASE WHEN regexp_matches(substr(props, 1 + event_id % 6, 1), '[a-zA-Z]') THEN 2 WHEN regexp_matches(substr(props, 1 + event_id % 6, 1), '[!-~]') THEN 4 ELSE -1 END AS kind FROM events", star=False)
def _char_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numbers import char_type_column

    one = F.substr(F.col("props"), (1 + F.col("event_id") % 6).cast("int"), F.lit(1))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", char_type_column(one).alias("kind"))


@probe("match_len", "SELECT id, length(name) AS n FROM nodes")
def _match_len(n: DataFrame) -> DataFrame:
    import pandas as pd
    from pyspark.sql import types as T

    from ..functions.matching import match_length
    from ..functions.normalize import Standard

    s = Standard()
    length = F.pandas_udf(lambda a, b: pd.Series([match_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int64"), T.LongType())
    return n.select("id", length(s.plain_column("name"), s.column("name")).alias("n"))


@probe("geocode_full", "SELECT id AS qid, id AS node_id, length(name) + CASE WHEN level = 8 THEN 1 ELSE 0 END AS tail FROM nodes WHERE level > 1")
def _geocode(n: DataFrame) -> DataFrame:
    """Every node asked for by its own path; those of the first level have no coordinates, nor have their first children."""
    from ..functions.normalize import Standard
    from ..operators.search import Gazetteer, geocode

    g = Gazetteer(n.withColumn("name_index", Standard().column("name")))
    head = F.array_join(F.slice("path_names", 1, F.size("path_names") - 1), "")
    queries = n.select(F.col("id").alias("qid"), F.concat(head, F.when(F.col("level") == 8, "-").otherwise(""), "name", F.lit(" and more")).alias("query"))
    up = n.select(F.col("id").alias("node_id"), F.length(head).alias("head"))
    return geocode(g, queries).join(up, "node_id").select("qid", "node_id", (F.length("matched") - F.col("head")).cast("bigint").alias("tail"))


@probe(
    "level_guess",
    "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 < 1 THEN 1 WHEN n_nationkey % 7 = 1 AND n_nationkey % 5 = 0 THEN 2 WHEN n_nationkey % 5 = 1 AND n_nationkey % 7 < 3 THEN 3 WHEN n_nationkey % 5 = 1 AND n_nationkey % 7 IN (3, 5) THEN n_nationkey % 7 + 1 WHEN n_nationkey % 5 = 2 AND n_nationkey % 7 = 3 THEN 4 WHEN n_nationkey % 7 < 5 THEN 5 WHEN n_nationkey % 7 = 5 THEN 6 WHEN n_nationkey % 2 = 0 THEN 6 ELSE 7 END AS level FROM nation",
    star=False,
)
def _guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    ends = F.element_at(F.array(*[F.lit(x) for x in ("x郡", "x町", "x区", "x", "y")]), k % 5 + 1)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("k"), ends.alias("name"), F.lit("p").alias("parent_name"), (k % 7).alias("parent_level"), F.when(k % 2 == 0, 7).otherwise(8).alias("trigger_level"))
    return rows.select("k", tree.guessed_level().alias("level"))


@probe("variant_table", "SELECT ch AS variant, min(n_name) AS representative FROM (SELECT n_name, unnest(string_split(lower(n_name), '')) AS ch FROM nation) WHERE ch <> '' GROUP BY ch", star=False)
def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.variants import representative_rows, variant_rows

    table = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("representative"), F.lower("n_name").alias("variants"))
    back = representative_rows(variant_rows(table))
    return variant_rows(back).groupBy("variant").agg(F.min("representative").alias("representative"))


# --- what is kept, and the SQL surface


@probe("kept_items", _ITEMS + "SELECT item, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM boxes")
def _kept_items(n: DataFrame) -> DataFrame:
    """The items of a spatial index that is written, and opened again."""
    from ..operators.spatial import SpatialIndex
    from .staging import shared_path

    folder = shared_path(n.sparkSession, "spatial")
    SpatialIndex.build(n, folder)
    return SpatialIndex.open(n, folder).items.select("item", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_STAND = ", stood AS (SELECT k.id AS item, d.id AS node_id, d.x AS nx, d.y AS ny FROM nodes k JOIN nodes d ON d.parent_id = k.id WHERE k.level = 7 UNION ALL SELECT min(id), min(id), x, y FROM nodes WHERE level = 7 AND sibling_id = id + 1 GROUP BY n, x, y) "


@probe("kept_leaves", _STAND + "SELECT item, node_id, round(nx, 6) AS nx, round(ny, 6) AS ny FROM stood")
def _kept_leaves(n: DataFrame) -> DataFrame:
    """The leaves that each item of an index stands for."""
    from ..operators.spatial import SpatialIndex
    from .staging import shared_path

    return SpatialIndex.build(n, shared_path(n.sparkSession, "spatial")).leaves.select("item", "node_id", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"))


@probe("kept_notations", _QUERIES + "SELECT qid, key, node_id FROM q JOIN keys ON starts_with(text, key)")
def _kept_notations(n: DataFrame) -> DataFrame:
    """common_prefixes over a notation index that is kept, sorted by key, and found to be of these nodes."""
    from ..operators.index import common_prefixes
    from ..operators.search import Gazetteer
    from .staging import shared_path

    folder, upper = shared_path(n.sparkSession, "prepared"), n.where("level <= 3")
    Gazetteer(upper).save(folder, upper)
    return common_prefixes(_texts(n), Gazetteer.open(folder, upper).index).select("qid", "key", "node_id")


_WRITTEN = "translate(name, '1234567', '字ケノツヶッ大')"
_OPTIONAL_SQL = "[t]"
for _s in ("大字", "小字", "字", "ケ", "ヶ", "ガ", "ツ", "ッ", "ノ"):
    _OPTIONAL_SQL = f"list_distinct(flatten(list_transform({_OPTIONAL_SQL}, lambda x: [x, replace(x, '{_s}', '')])))"


@probe("optional_letters", f", w AS (SELECT id, {_WRITTEN} AS t FROM nodes) SELECT id, unnest({_OPTIONAL_SQL}) AS variant FROM w")
def _optional(n: DataFrame) -> DataFrame:
    from ..operators.index import optional_variants

    written = F.translate("name", "1234567", "字ケノツヶッ大")
    return n.select("id", F.explode(optional_variants(written)).alias("variant"))


@probe("sql_lateral_notes", "SELECT id, split_part(p, ':', 1) AS k, split_part(p, ':', 2) AS v, length(split_part(p, ':', 2)) = 5 AS five FROM (SELECT id, unnest(string_split(note, '/')) AS p FROM nodes WHERE note <> '')")
def _lateral(n: DataFrame) -> DataFrame:
    """Notes and check digits in SQL text, by the registered functions."""
    from ..functions.sql import register

    register(n.sparkSession)
    return n.sparkSession.sql("SELECT id, k, v, address_authority_code(v) <> '' AS five FROM {n} AS n, LATERAL address_notes(n.note)", n=n)


@probe("record_round_trip", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS props FROM events", star=False)
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records with an object, and back to flat rows."""
    from ..sources.records import RecordCodec

    codec = RecordCodec({"event_id": 0, "event_type": "", "props": {"k": 0}})
    back = codec.decode(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return codec.encode(back).join(back.select("event_id", F.col("props.k").alias("k")), "event_id").select("event_id", "event_type", "k", "props")


@probe("sqlite_round_trip", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey >= 5 AND starts_with(c_name, 'Customer')", star=False)
def _sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written through the SQLite sink, and read back with their filters in the statement.

    SQLite needs files: where the shared folder is none of a file system, it raises.
    """
    from ..sources import sqlite
    from .staging import shared_path

    sqlite.register(spark)
    path = shared_path(spark, "customers").removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError("spark.checkpoint.dir is no folder of a file system")
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))
    rows.write.format("gaz_sqlite").option("path", path).option("table", "customer").mode("append").save()
    return spark.read.format("gaz_sqlite").option("path", path).option("table", "customer").load().where("c_nationkey >= 5 and c_name like 'Customer%'")
