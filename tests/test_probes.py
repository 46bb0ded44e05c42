"""The queries cover their whole tables, on the smallest ones."""

from pyspark.sql import functions as F

from addrspark.operators import reverse, tree
from addrspark.plans import probes
from addrspark.plans.star import star_nodes

SMALL = "/root/testdata/sf0.001"


def ids(df, column="id"):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_every_point_is_asked(spark):
    nodes = star_nodes(spark, SMALL)
    placed = ids(nodes.where(tree.has_coordinates()))
    assert ids(nodes.where("level = 8")) <= placed
    points = nodes.where(tree.has_coordinates()).select(F.col("id").alias("qid"), (F.col("x") + 0.0004).alias("x"), (F.col("y") + 0.0003).alias("y"))
    pairs = points.crossJoin(reverse.items(nodes)).select("qid", "item", reverse.box_distance().alias("d2"))
    want = {tuple(r) for r in pairs.selectExpr("qid", "item", "rank() over (partition by qid order by d2) as k").where("k <= 20").select("qid", "item").collect()}
    assert {tuple(r) for r in probes.queries()["knn20"](spark, SMALL).collect()} == want
    assert ids(probes.queries()["reverse_full"](spark, SMALL), "qid") == placed


def test_every_child_and_code_is_asked(spark):
    nodes, queries = star_nodes(spark, SMALL), probes.queries()
    assert ids(queries["child_by_name"](spark, SMALL)) == ids(nodes)
    blocks = ids(nodes.where("level = 7"))
    found = queries["machiaza_lookup"](spark, SMALL).selectExpr("node_id", "length(code) as n")
    for n in (7, 12):
        assert ids(found.where(f"n = {n}"), "node_id") == blocks
    lengths = {r["n"]: r["count"] for r in queries["code_to_registry"](spark, SMALL).groupBy(F.length("code").alias("n")).count().collect()}
    assert lengths == {12: len(blocks), 5: len(ids(nodes.where("level = 7"), "parent_id")), 2: 5}


TEXTS = [None, "", "12番地と３４号\n二千四十五万 and 7 more", "字Ａｂ―ｃ\nßtraße １２", "9" * 30 + " x", "0" * 3 + "8" * 6000, "abc 12 " * 40_000, "通り１条"]


def test_whole_texts(spark, tmp_path):
    from addrspark.functions.normalize import Standard
    from addrspark.functions.numbers import read_number

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: {r["doc_id"]: r for r in probes.queries()[name](spark, str(tmp_path)).collect()} for name in ("std_native", "std_full_text", "get_number_text")}
    s = Standard()
    for k, t in enumerate(TEXTS):
        assert got["std_native"][k]["std"] == s.plain(t)
        assert got["std_full_text"][k]["std"] == s(t)
    assert [got["std_full_text"][k]["std"] for k in (2, 3, 4)] == ["12.番地ト34.号\n20450000. AND 7. MORE", "AB-C\nSSTRASSE 12.", "9" * 30 + ". X"]
    assert got["std_full_text"][5]["std"] == "8" * 6000 + "."
    assert [(got["get_number_text"][k]["n"], got["get_number_text"][k]["i"]) for k in (0, 2, 4)] == [(0, 0), (12, 2), (None, 30)]
    assert all(got["get_number_text"][k]["i"] == read_number(t or "")[1] for k, t in enumerate(TEXTS))


def test_documents_are_read_whole(spark):
    from addrspark.functions.normalize import Standard

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    s = Standard()
    for name, of in (("std_native", s.plain), ("std_full_text", s)):
        assert {r["doc_id"]: r["std"] for r in probes.queries()[name](spark, SMALL).collect()} == {k: of(t) for k, t in docs.items()}


def test_every_level_is_asked(spark):
    nodes, queries = star_nodes(spark, SMALL), probes.queries()
    every, placed = ids(nodes), ids(nodes.where(tree.has_coordinates()))
    for name in ("geodesic", "match_len", "parent_list", "map_links", "geojson", "point_in_triangle"):
        assert ids(queries[name](spark, SMALL)) == every, name
    assert ids(queries["geodesic"](spark, SMALL).where("metres is not null and not isnan(metres)")) == placed
    assert ids(queries["children_list"](spark, SMALL)) == ids(nodes.where("parent_id > 0"), "parent_id")
    assert ids(queries["append_positions"](spark, SMALL), "pos") == {*range(10, 10 + len(every))}
    assert {r[0] for r in queries["circumcircle"](spark, SMALL).join(nodes.select("id", "level"), "id").select("level").distinct().collect()} == {7, 8}


def test_whole_variant_table(spark):
    from addrspark.functions.normalize import VARIANTS, Standard, aza_name_column

    s = Standard()
    pairs = [(c, rep) for rep, chars in VARIANTS.items() for c in chars]
    assert len(pairs) == 739 and len(VARIANTS) == 656
    assert [c for c, rep in pairs if s.map.get(c, c) != rep] == []
    assert s("亞鰺壓驛") == "亜鯵圧駅"
    frame = spark.createDataFrame([("亞鰺壓驛",)], "t string")
    got = frame.select(s.column("t").alias("a"), aza_name_column(F.array("t")).alias("b"), aza_name_column(F.array("t"), Standard({})).alias("c")).first()
    assert tuple(got) == ("亜鯵圧駅", "亜鯵圧駅", "亞鰺壓驛")


def test_registry_by_prefixes_of_any_length(spark):
    from addrspark.operators import codes

    names = lambda *of: [(level, name) for level, name in of]
    rows = [("131040023002", names((1, "p"), (3, "c"), (5, "o"), (6, "a")), 2, ["1"]), ("131040023003", names((1, "p"), (3, "c"), (5, "o"), (6, "b")), 2, ["2"])]
    registry = spark.createDataFrame(rows, "code string, names array<struct<level:int,name:string>>, aza_class int, postcode array<string>")
    asked = ["131", "131040023", "13104002300", "131040023003", "13104", "13", "1310410023003", "999", "", None]
    got = {r["code"]: r for r in codes.search_registry(registry, spark.createDataFrame([(c,) for c in asked], "code string")).collect()}
    first, second = rows[0][0], rows[1][0]
    assert {c: (r["aza_code"], len(r["names"]), r["postcode"]) for c, r in got.items()} == {
        "131": (first, 4, ["1"]), "131040023": (first, 4, ["1"]), "13104002300": (first, 4, ["1"]), "131040023003": (second, 4, ["2"]),
        "13104": ("13104", 2, None), "13": ("13", 1, None), "1310410023003": (second, 4, ["2"]),
    }
    assert codes.search_registry(registry, spark.createDataFrame([], "code string")).count() == 0
