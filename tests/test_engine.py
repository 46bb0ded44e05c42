"""Tree, store, sources, settings, geometry and the spatial join."""

import math
import random
import sqlite3
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from addrspark import config
from addrspark.errors import AddressError, ReadOnlyError, RemoteError, StoreError
from addrspark.functions import geometry
from addrspark.functions.matching import Settings
from addrspark.operators import codes, reverse, tree
from addrspark.sources import dictionary, registry, sqlite
from addrspark.sources.store import Store

PATHS = ["a", "a/b", "a/b/c", "a/d", "e", "e/f/g", "a/b/b"]


def nodes_of(spark, paths=PATHS):
    rows = [(p.split("/"), p.split("/")[-1], p.split("/")[-1].upper(), 0.1 * k, 0.2 * k, p.count("/") + 1, 1, f"k:{k}/ref:x") for k, p in enumerate(paths)]
    return tree.build_tree(spark.createDataFrame(rows, "path_key array<string>, name string, name_index string, x double, y double, level int, priority int, note string"))


def test_nested_sets(spark):
    nodes = {r["id"]: r for r in nodes_of(spark).collect()}
    assert [nodes[k]["path_names"] for k in sorted(nodes)] == [["a"], ["a", "b"], ["a", "b", "b"], ["a", "b", "c"], ["a", "d"], ["e"], ["e", "g"]]
    for r in nodes.values():
        below = {k for k, n in nodes.items() if r["id"] in n["path_ids"]}
        assert below == {*range(r["id"], r["sibling_id"])}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("t", spark.createDataFrame([(k, f"n{k}") for k in range(20)], "k int, name string"), "k")
    store.append("t", spark.createDataFrame([(100, "x"), (101, "y")], "k int, name string"), "k")
    assert store.count("t") == 22 and store.get("t", 21)["name"] == "y"
    assert [r["pos"] for r in store.slice("t", 3, 10, 3).collect()] == [3, 6, 9]
    assert [r["k"] for r in store.retrieve("t", "k >= :low", {"low": 15}, limit=2, offset=1).collect()] == [16, 17]
    store.update("t", spark.createDataFrame([(0, "new")], "pos bigint, name string"))
    assert store.get("t", 0) == {"k": 0, "name": "new", "pos": 0}
    with pytest.raises(ValueError):
        store.get("t", 99)
    with pytest.raises(ValueError):
        store.update("t", spark.createDataFrame([(0, 1)], "pos bigint, other int"))
    assert store.at("t", -1)["name"] == "y" and [r["k"] for r in store.at("t", [-1, 0, 5])] == [101, 0, 5]
    assert [r["pos"] for r in store.at("t", slice(-4, None)).collect()] == [18, 19, 20, 21] and store.at("t", slice(0, 3)).count() == 3
    for bad in (22, -23, [1, 40], slice(30, 40), slice(0, 40)):
        with pytest.raises(IndexError):
            store.at("t", bad)
    store.create_index("t", "name", lambda c: F.array(F.upper(c)), F.col("k") != 3)
    values = spark.createDataFrame([("N1",), ("N3",), ("n1",), ("N12",)], "value string")
    assert {(r["value"], r["k"]) for r in store.search_on("t", "name", values).collect()} == {("N1", 1), ("N12", 12)}
    assert {(r["value"], r["k"]) for r in store.search_on("t", "name", values, "prefixes").collect()} == {("N1", 1), ("N12", 1), ("N12", 12)}
    assert {r["k"] for r in store.search_on("t", "name", values.where("value = 'N1'"), "keys").collect()} == {1, *range(10, 20)}
    store.drop_index("t", "name")
    with pytest.raises(StoreError):
        store.index("t", "name")
    arrived = spark.createDataFrame([(k,) for k in (5, 3, 9, 1)], "k int").coalesce(1)
    store.create("u", arrived)
    store.append("u", arrived)
    assert [r["k"] for r in store.slice("u", 0, 8).collect()] == [5, 3, 9, 1] * 2
    assert store.count("u") == 8
    reader = Store(spark, str(tmp_path), mode="r")
    assert reader.count("t") == 22
    for change in (lambda: reader.create("v", arrived), lambda: reader.append("t", arrived), lambda: reader.update("t", arrived), lambda: reader.delete("t"), lambda: reader.set_config(a=1), lambda: reader.create_index("t", "name")):
        with pytest.raises(ReadOnlyError):
            change()
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "nothing"), mode="r")
    store.set_config(a=1)
    store.set_config(b=[2])
    assert store.get_config() == {"a": 1, "b": [2]}
    store.delete("t")
    assert not (tmp_path / "t").exists()


def test_dictionary(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE address_node (id INTEGER, name TEXT, nameIndex TEXT, x REAL, y REAL, level INTEGER, priority INTEGER, note TEXT, parentId INTEGER, siblingId INTEGER)")
        c.executemany("INSERT INTO address_node VALUES (?, ?, ?, 0.0, 1.5, ?, 1, '', ?, ?)", [(0, "", "", -1, -1, 4), (1, "p", "P", 1, 0, 4), (2, "q", "Q", 3, 1, 4), (3, "r", "R", 5, 2, 4)])
    sqlite.register(spark)
    assert dictionary.install(spark, path, str(tmp_path / "nodes"), partitions=2) == 3
    got = {r["id"]: r["path_names"] for r in spark.read.parquet(str(tmp_path / "nodes")).collect()}
    assert got == {1: ["p"], 2: ["p", "q"], 3: ["p", "q", "r"]}


def packed(tmp_path):
    """A packed dictionary of three nodes, a registry row and two data sets."""
    (tmp_path / "d").mkdir()
    with sqlite3.connect(tmp_path / "d/address.db") as c:
        c.execute("CREATE TABLE address_node (id INTEGER, name TEXT, nameIndex TEXT, x REAL, y REAL, level INTEGER, priority INTEGER, note TEXT, parentId INTEGER, siblingId INTEGER)")
        c.executemany("INSERT INTO address_node VALUES (?, ?, ?, 139.0, 35.0, ?, 1, ?, ?, ?)", [(0, "", "", -1, "", -1, 4), (1, "東京都", "東京都", 1, "lasdec:130001/jisx0401:13", 0, 4), (2, "多摩市", "多摩市", 3, "jisx0402:13224/postcode:2060000", 1, 4), (3, "落合", "落合", 5, "aza_id:0010000", 2, 4)])
        c.execute("CREATE TABLE aza_master (code TEXT, names TEXT, namesIndex TEXT, azaClass INTEGER, isJukyo BOOLEAN, startCountType INTEGER, postcode TEXT)")
        c.execute("INSERT INTO aza_master VALUES ('132240010000', '[[1, \"東京都\", \"ト\", \"T\", \"13\"], [3, \"多摩市\", \"タ\", \"Tama\", \"13224\"], [5, \"落合\", \"オ\", \"O\", \"132240010\"]]', '東京都多摩市落合', 1, 1, 1, '2060033')")
    with sqlite3.connect(tmp_path / "d/sets.sqlite") as c:
        c.execute("CREATE TABLE dataset (id INTEGER, title TEXT, url TEXT)")
        c.executemany("INSERT INTO dataset VALUES (?, ?, ?)", [(3, "b", "http://b"), (1, "a", "http://a")])
    (tmp_path / "d/metadata.txt").write_text("v9\n")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        for f in (tmp_path / "d").iterdir():
            z.write(f, f"../up/{f.name}")
    return str(tmp_path / "d.zip")


def test_session_over_a_packed_dictionary(spark, tmp_path):
    from addrspark import session
    from addrspark.__main__ import parser, run

    path, folder = packed(tmp_path), str(tmp_path / "db")
    assert session.locate(environ={session.FOLDER: folder}) is None
    given = parser().parse_args(["install-dictionary", "-y", "--db-dir", folder, path])
    assert run(spark, given) == {"nodes": 3, "registry": 1, "datasets": 2}
    assert not (tmp_path / "up").exists() and session.locate(environ={session.FOLDER: folder}) == folder
    with pytest.raises(AddressError):
        session.current()
    g = session.init(spark, environ={session.FOLDER: folder}, aza_skip="off")
    assert session.is_initialized() and session.current() is g and g.settings.aza_skip is False
    assert g.search("東京都多摩市落合")["candidates"][0]["fullname"] == "東京都/多摩市/落合"
    assert g.configure(target_area="14") and g.search("多摩市落合") == {"matched": "", "candidates": []}
    with pytest.raises(ValueError):
        g.configure(target_area="どこか")
    assert [r["node_id"] for r in g.reverse(139.001, 35.0, 5)] == [3]
    assert [r["id"] for r in g.by_code("2060000", "postcode").collect()] == [2] and [r["id"] for r in g.by_code("132240010000", "machiaza").collect()] == [3]
    assert [n["kanji"] for n in g.registry_row("13224")["names"]] == ["東京都", "多摩市"] and g.registry_row("99") is None
    assert [*g.datasets()] == [1, 3] and g.version() == "v9" and g.readme().startswith("(no")
    coded = codes.with_codes(codes.with_area_names(g.nodes))
    assert {r["id"]: (r["pref_name"], r["city_name"]) for r in coded.collect()} == {1: ("東京都", ""), 2: ("東京都", "多摩市"), 3: ("東京都", "多摩市")}
    assert {r["id"]: [n["kanji"] for n in r["names"]] for r in codes.aza_names(coded, g.registry).collect()} == {1: ["東京都"], 2: ["東京都", "多摩市"], 3: ["東京都", "多摩市", "落合"]}
    session.free()
    assert not session.is_initialized()
    for bad in ({"folder": str(tmp_path / "no")}, {"environ": {}}, {"environ": {session.FOLDER: "http://x"}}):
        with pytest.raises(StoreError):
            session.connect(spark, **bad)
    with pytest.raises(ReadOnlyError):
        session.connect(spark, url="http://x", mode="w", environ={})
    assert run(spark, parser().parse_args(["list-datasets", "--db-dir", folder]))[3]["title"] == "b"
    assert run(spark, parser().parse_args(["search", "--db-dir", folder, "--area", "13", "多摩市 落合"]))["matched"] == "多摩市落合"
    run(spark, parser().parse_args(["uninstall-dictionary", "--db-dir", folder]))
    assert not (tmp_path / "db").exists()
    with pytest.raises(StoreError):
        dictionary.install_archive(spark, str(tmp_path / "d/metadata.txt"), folder)
    with pytest.raises(StoreError):
        dictionary.download("http://127.0.0.1:9/d.zip", str(tmp_path))


def test_predict_prefixes_without_any(spark):
    from addrspark.operators.index import predict_prefixes

    keys = spark.createDataFrame([("ab", 1), ("b", 2)], "key string, node_id bigint")
    for wanted, n in (([], 0), ([("",)], 0), ([("",), ("a",), ("b",), ("x",)], 2)):
        got = predict_prefixes(keys, spark.createDataFrame(wanted, "prefix string"))
        assert got.columns == ["prefix", "key", "node_id"] and got.count() == n


def test_registry(spark):
    columns = "lg_code machiaza_id machiaza_type rsdt_addr_flg wake_num_flg post_code pref county city ward oaza_cho chome chome_number koaza".split()
    rows = spark.createDataFrame([("131041", "0023002", "2", "1", "1", "1600023;1600024", "東京都", "", "新宿区", "", "西新宿", "二丁目", "2", ""), ("011011", "0001000", "3", "0", None, "", "北海道", "", "札幌市", "中央区", "大字旭ケ丘", "", "", "")], ", ".join(f"{c} string" for c in columns))
    for c in ("pref", "county", "city", "ward", "oaza_cho", "chome", "koaza"):
        rows = rows.withColumn(f"{c}_kana", F.lit("k")).withColumn(f"{c}_roma", F.lit("r"))
    made = registry.registry_from_rows(rows)
    got = {r["code"]: r for r in made.collect()}
    assert [(n["level"], n["kanji"], n["code"]) for n in got["131040023002"]["names"]] == [(1, "東京都", "13"), (3, "新宿区", "13104"), (5, "西新宿", "131040023"), (6, "二丁目", "131040023002")]
    assert got["131040023002"]["postcode"] == ["1600023", "1600024"] and got["131040023002"]["is_jukyo"]
    assert [n["code"] for n in got["011010001000"]["names"]] == ["01", "011", "01101", "011010001"]
    found = registry.by_names(made, spark.createDataFrame([(["北海道", "札幌市", "中央区", "旭ヶ丘"],)], "names array<string>"))
    assert [r["code"] for r in found.collect()] == ["011010001000"]


def test_notes_and_codes(spark):
    one = spark.createDataFrame([(r"a:1/b\/c:x\:y/d:", ), ("",), (None,)], "note string")
    got = [[tuple(n) for n in r["n"]] for r in one.select(codes.notes_of().alias("n")).collect()]
    assert got == [[("a", "1"), ("b/c", "x:y"), ("d", "")], [], []]
    back = one.where("note <> ''").withColumn("notes", codes.notes_of()).select(codes.joined_notes()).first()[0]
    assert back == r"a:1/b\/c:x\:y/d:"
    check = spark.createDataFrame([("13104",), ("01000",), ("20000",), ("13000",), ("42201",), ("",)], "c string").select(codes.local_authority_code("c").alias("l"))
    assert [r["l"] for r in check.collect()] == ["131041", "010006", "200000", "130001", "422011", ""]


def test_settings():
    assert config.configure(aza_skip="off", best_only="yes", target_area="13,多摩市") == Settings(aza_skip=False, target_area=("13", "多摩市"))
    assert config.from_environment({"ADDRSPARK_OPT_AZA_SKIP": "auto", "OTHER": "1"}) == Settings()
    for bad in ({"aza_skip": "maybe"}, {"nothing": 1}, {"best_only": 1.5}):
        with pytest.raises(config.SettingError):
            config.configure(**bad)


@pytest.mark.parametrize(("a", "b", "metres"), [((139.691772, 35.689628), (139.6917724609375, 35.68962860107422), 0.07866663127258333), ((139.691772, 35.689628), (139.692138671875, 35.688079833984375), 174.95110253904488), ((139.691772, 35.689628), (139.689697265625, 35.687679290771484), 286.38673495897797), ((139.6917, 35.6896), (139.6917724609375, 35.68962860107422), 7.286211365075872)])
def test_geodesic(a, b, metres):
    assert abs(geometry.geodesic(*a, *b) - metres) < 1e-6
    assert geometry.geodesic(*a, *a) == 0


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=4, max_size=25, unique=True))
def test_surrounding(points):
    p = (0.3, 0.4)
    points = sorted(points, key=lambda q: math.dist(p, q))
    chosen = geometry.surrounding(p, points)
    if len(chosen) == 3:
        assert geometry.in_triangle(p, *(points[k] for k in chosen))
    else:
        assert chosen == [0, 1]


def test_nearest_against_brute_force(spark):
    rng = random.Random(6)
    boxes = []
    for k in range(150):
        x, y, w = (rng.gauss(139, 0.02), rng.gauss(35, 0.02), rng.choice([0, 0, 0.003])) if k % 3 else (rng.uniform(120, 150), rng.uniform(20, 45), 0)
        boxes.append((k, x, y, x + w, y + w))
    points = [(k, rng.gauss(139, 0.05), rng.gauss(35, 0.05)) for k in range(15)] + [(20, -100.0, -50.0), (21, None, 1.0)]
    got = reverse.nearest(spark.createDataFrame(points, "qid int, x double, y double"), spark.createDataFrame(boxes, "item int, x0 double, y0 double, x1 double, y1 double"), 5)
    want = set()
    for q, x, y in points[:-1]:
        d = sorted((max(b[1] - x, 0, x - b[3]) ** 2 + max(b[2] - y, 0, y - b[4]) ** 2, b[0]) for b in boxes)
        want |= {(q, k) for v, k in d if v <= d[4][0]}
    assert {(r["qid"], r["item"]) for r in got.select("qid", "item").collect()} == want


def plain_nearest(points, boxes, k):
    want = set()
    for q, x, y in points:
        d = sorted((max(b[1] - x, 0, x - b[3]) ** 2 + max(b[2] - y, 0, y - b[4]) ** 2, b[0]) for b in boxes)
        want |= {(q, i) for v, i in d if v <= d[min(k, len(d)) - 1][0]}
    return want


def test_nearest_in_dense_and_empty_places(spark, monkeypatch):
    """Points far from all items, and in a cell of many, by way of the pyramid; what they meet is counted."""
    monkeypatch.setattr(reverse, "CROWD", 8)
    rng = random.Random(8)
    boxes = [(k, 139 + rng.random() / 1000, 35 + rng.random() / 1000, 0, 0) for k in range(400)]
    boxes += [(k, rng.uniform(-170, 170), rng.uniform(-80, 80), 0, 0) for k in range(400, 600)] + [(k, 10.0, 10.0, 0, 0) for k in range(600, 630)]
    boxes = [(k, x, y, x, y) for k, x, y, _, _ in boxes] + [(700, -20.0, -20.0, 30.0, 12.0)]
    points = [(k, 139 + rng.random() / 1000, 35 + rng.random() / 1000) for k in range(12)] + [(k, rng.uniform(-180, 180), rng.uniform(-90, 90)) for k in range(12, 30)] + [(30, 10.0, 10.0), (31, 179.99, 89.99)]
    b = spark.createDataFrame(boxes, "item int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "qid int, x double, y double")
    want = plain_nearest(points, boxes, 5)
    assert {(r["qid"], r["item"]) for r in reverse.nearest(p, b, 5).select("qid", "item").collect()} == want
    assert {(r["qid"], r["item"]) for r in reverse.descended(p, b, 5).select("qid", "item").collect()} == want
    assert reverse.descended(p, b.limit(3), 5).count() == 3 * len(points)
    assert reverse.nearest(p, b.limit(0), 5).count() == 0


def test_variants_and_guess(spark):
    from addrspark.sources import variants

    table = spark.createDataFrame([("竜", "龍竜"), ("沢", "澤")], "representative string, variants string")
    pairs = variants.variant_rows(table)
    assert {tuple(r) for r in pairs.collect()} == {("龍", "竜"), ("澤", "沢")}
    assert {tuple(r) for r in variants.representative_rows(pairs).collect()} == {("竜", "龍"), ("沢", "澤")}
    nodes = spark.createDataFrame([(1, "龍澤"), (2, "龍"), (3, "竜")], "id int, name string")
    assert {tuple(r) for r in variants.occurrences(nodes, pairs).collect()} == {("龍", "竜", 1, 2), ("澤", "沢", 1, 1)}
    rows = spark.createDataFrame([("東京都", "", 0, 1), ("x郡", "p", 1, 1), ("新宿区", "東京都", 1, 3), ("x町", "p", 5, 7), ("九線", "p", 6, 7), ("1番", "p", 6, 8)], "name string, parent_name string, parent_level int, trigger_level int")
    assert [r[0] for r in rows.select(tree.guessed_level()).collect()] == [1, 2, 3, 6, 6, 7]


def test_remote(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from addrspark import session
    from addrspark.sources import remote

    asked_for, signature = [], ["one"]
    node = {"id": 7, "name": "n", "x": 1, "y": 2, "level": 3, "priority": 1, "note": "", "parentId": 2, "siblingId": 8}

    def answer(method, params):
        asked_for.append(method)
        if method == "svc.searchNode":
            q = params["query"]
            return None if q == "bad" else [{"node": node, "matched": q}] if q else []
        return {
            "svc.server_signature": signature[0],
            "svc.reverse": [{"candidate": node | {"fullname": ["a", "n"]}, "dist": 5}],
            "svc.installed_dictionary_version": "v1",
            "svc.installed_dictionary_readme": "read",
            "node.get_record": node,
            "node.count_records": 12,
            "node.search_records_on": [node] if isinstance(params, dict) and params.get("value") == "postcode:1" else [],
            "aza_master.search_by_codes": {"code": "1"},
            "dataset.get_all": {"3": {"id": 3, "title": "t", "url": "u"}, "1": {"id": 1, "title": "s", "url": "v"}},
        }[method]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got = answer(asked["method"], asked["params"])
            data = json.dumps({"error": "no"} if got is None else {"result": got}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    got = remote.geocode_remote(spark.createDataFrame([(1, "a"), (2, ""), (3, "a")], "qid bigint, query string").coalesce(1), url, "svc").collect()
    assert sorted((r["qid"], r["rank"], r["node_id"], r["matched"]) for r in got) == [(1, 1, 7, "a"), (3, 1, 7, "a")]
    assert asked_for.count("svc.searchNode") == 2
    points = spark.createDataFrame([(1, 139.0, 35.0), (2, None, 1.0)], "qid bigint, x double, y double")
    assert [tuple(r) for r in remote.reverse_remote(points, url, "svc").collect()] == [(1, 1, 7, "a/n", 5.0)]
    found = remote.nodes_by_code_remote(spark.createDataFrame([("1",), ("2",)], "code string"), url, "svc", "postcode").collect()
    assert [(r["code"], r["node_id"], r["parent_id"]) for r in found] == [("1", 7, 2)]
    assert {r["id"]: r["title"] for r in remote.datasets_remote(spark, url, "svc").collect()} == {3: "t", 1: "s"}
    s = remote.Session(url, "svc", cached=2)
    assert s.signature() == "one" and s.node(7) == s.node(7) == node and s.count() == 12 and s.registry("1") == {"code": "1"}
    asked_for.clear()
    s.node(7)
    assert asked_for == []
    signature[0] = "two"
    s.signature()
    s.node(7)
    assert asked_for == ["svc.server_signature", "node.get_record"]
    for bad in (lambda: s.node(-1), lambda: s.nodes_on("note", "x", "what"), lambda: remote.call(url, "svc.searchNode", {"query": "bad"})):
        with pytest.raises(RemoteError):
            bad()
    signature[0] = 5
    with pytest.raises(RemoteError):
        s.signature()
    signature[0] = "three"
    g = session.connect(spark, url=url, namespace="svc", environ={})
    assert g.search("a")[0]["node_id"] == 7 and g.reverse(1, 2)[0]["dist"] == 5 and [*g.datasets()] == [1, 3]
    assert (g.version(), g.readme(), g.registry_row("1")) == ("v1", "read", {"code": "1"})
    server.shutdown()


def test_dictionary_notes(spark, tmp_path):
    assert dictionary.version(spark, str(tmp_path)) == "(Unknown)" and dictionary.readme(spark, str(tmp_path)).startswith("(no")
    (tmp_path / "metadata.txt").write_text("v7\nmore")
    assert dictionary.version(spark, str(tmp_path)) == "v7"
    dictionary.uninstall(spark, str(tmp_path))
    assert not tmp_path.exists()
