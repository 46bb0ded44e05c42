"""Address goldens on a hand-written gazetteer."""

import itertools
from pathlib import Path

import pytest

from addrspark.functions.matching import Settings, match_length, skippable
from addrspark.functions.normalize import Standard
from addrspark.functions.numbers import read_number
from addrspark.operators.search import Gazetteer, gazetteer_from_paths, geocode, search

# Queries and what they match.
GOLDENS = [
    ("多摩市落合1-15多摩センタートーセイビル", "東京都/多摩市/落合/一丁目/15番地", "多摩市落合1-15"),
    ("多摩市落合1-15-2", "東京都/多摩市/落合/一丁目/15番地/2", "多摩市落合1-15-2"),
    ("札幌市中央区北3西1-7", "北海道/札幌市/中央区/北三条/西一丁目/7番地", "札幌市中央区北3西1-7"),
    ("新宿区西新宿二ノ８", "東京都/新宿区/西新宿/二丁目/8番", "新宿区西新宿二ノ８"),
    ("京都市上京区下立売通新町西入薮ノ内町", "京都府/京都市/上京区/藪之内町", "京都市上京区下立売通新町西入薮ノ内町"),
    ("東京都西多摩郡瑞穂町大字箱根ケ崎2335番地", "東京都/西多摩郡/瑞穂町/大字箱根ケ崎/2335番地", "東京都西多摩郡瑞穂町大字箱根ケ崎2335番地"),
    ("竜ヶ崎市3751番地", "茨城県/龍ケ崎市//3751番地", "竜ヶ崎市3751番地"),
    ("長野県小谷村", "長野県/北安曇郡/小谷村", "長野県小谷村"),
    ("愛知県清須市助七１", "愛知県/清須市/助七/一丁目", "愛知県清須市助七１"),
    ("鳥取県米子市古豊千6", "鳥取県/米子市/古豊千/6番地", "鳥取県米子市古豊千6"),
    ("石川県羽咋市一ノ宮町ケ２８", "石川県/羽咋市/一ノ宮町/ケ/28番地", "石川県羽咋市一ノ宮町ケ２８"),
    ("相模原市田名2178", "神奈川県/相模原市/中央区/田名/2178番地", "相模原市田名2178"),
    ("多摩市長沼１－２－３", "東京都/多摩市", "多摩市"),
]

# Places by name and level, one path a line; and queries with the path found, what is matched (None: not looked
# at) and whether areas may be skipped. A path may go on below the one that is stated.
PLACES = """
秋田県1/秋田市3/山王5/四丁目6/1番地7/1:8
京都府1/京都市3/東山区4/大和大路5/一丁目6/535番地7
大分県1/宇佐市3/安心院町古川5
岡山県1/新見市3/哲多町大野5
徳島県1/阿南市3/那賀川町三栗5
徳島県1/阿南市3/富岡町5/トノ町6/65番地7
熊本県1/阿蘇市3/波野5/大字小地野6
静岡県1/静岡市3/葵区4/与一5/四丁目6/1番7
北海道1/札幌市3/中央区4/北十一条5/西十三丁目6/1番7
山形県1/山形市3/大字十文字5/1番地7
鳥取県1/米子市3/福万5/619番地7
埼玉県1/大里郡2/寄居町3/大字鷹ノ巣5
群馬県1/伊勢崎市3/国定町5/二丁目6/甲6/1994番地7
兵庫県1/宍粟市3/山崎町上ノ5/1502番地7
石川県1/小松市3/軽海町5/ノ6/14番地7/1:8
香川県1/高松市3/林町5
富山県1/富山市3/水橋開発5/字文化6
富山県1/富山市3/水橋開発町5
大阪府1/大阪市3/中央区4/上町5/A番7/6号8
北海道1/紋別郡2/滝上町3/字滝ノ上市街地一条通5
愛知県1/春日井市3/上条町5/一丁目6
愛知県1/春日井市3/上ノ町5/一丁目6
宮城県1/仙台市3/宮城野区4/福室5/久保野二番6
宮城県1/仙台市3/青葉区4/芋沢5/大竹新田下6/19番地7
宮城県1/仙台市3/青葉区4/芋沢5/字田尻6/66番地7
宮城県1/仙台市3/青葉区4/芋沢5/66番地7
宮城県1/遠田郡2/涌谷町3/涌谷5/八方谷一6/16番地7
宮城県1/石巻市3/渡波5/字転石山6/1番地7/6:8
香川県1/綾歌郡2/宇多津町3/浜二番丁5/12番7
青森県1/十和田市3/東十六番町5/48番7
青森県1/八戸市3/大字鮫町5/字骨沢6/1番地7
青森県1/八戸市3/一番町5
石川県1/白山市3/鹿島町5/一号6
北海道1/北見市3/留辺蘂町温根湯温泉5/一区6
北海道1/上川郡2/新得町3/字新得5/1番地7
北海道1/上川郡2/新得町3/字新得基線5/1番地7
千葉県1/八街市3/八街ろ5/97番地7
長野県1/千曲市3/大字磯部5/1137番地7
佐賀県1/嬉野市3/嬉野町4/大字下野5/丙6
佐賀県1/鹿島市3/大字納富分5/藤津甲6
佐賀県1/鹿島市3/大字納富分5/甲6/2番地7
高知県1/高岡郡2/佐川町3/甲5/485番地7
広島県1/府中市3/鵜飼町5/甲6/124番地7
愛媛県1/松山市3/平林5
山形県1/酒田市3/京田5/二丁目6/1番地7/11:8
岩手県1/奥州市3/水沢佐倉河5/字中半入川原6/1番地7
岩手県1/奥州市3/水沢佐倉河5/中ノ町6
鹿児島県1/霧島市3/霧島永水5/4962番地7
長野県1/北安曇郡2/小谷村3/大字中小谷5
福島県1/いわき市3/平上高久5/塚田6/97番7/乙地7
神奈川県1/相模原市3/緑区4/田名5/2179番地7
徳島県1/阿波市3/市場町市場5/字上野段6/385番地7/1:8
徳島県1/三好市3/池田町中西5/ナガウチ6/274番地7
徳島県1/美馬市3/脇町大字猪尻5/字西上野6/61番地7/1:8
東京都1/小金井市3
三重県1/津市3/広明町5/13番地7
"""
#: Nodes whose addresses have moved, and where to.
MOVED = {"神奈川県/相模原市/田名": "神奈川県相模原市中央区田名|神奈川県相模原市緑区田名", "徳島県1/阿波郡2/市場町3/大字市場5/字上野段6": "徳島県阿波市上野段", "徳島県1/阿波市3/上野段5": "徳島県阿波市市場町市場字上野段"}
MORE = [
    ("秋田市山王4-1-1", "秋田県/秋田市/山王/四丁目/1番地/1", "秋田市山王4-1-1", None),
    ("東山区大和大路通正面下る大和大路1-535", "京都府/京都市/東山区/大和大路/一丁目/535番地", "東山区大和大路通正面下る大和大路1-535", None),
    ("大分県宇佐市安心院町大字古川字長坂", "大分県/宇佐市/安心院町古川", "大分県宇佐市安心院町大字古川", None),
    ("岡山県新見市哲多町大字大野", "岡山県/新見市/哲多町大野", None, None),
    ("徳島県阿南市那賀川町大字三栗字堤下", "徳島県/阿南市/那賀川町三栗", None, None),
    ("熊本県阿蘇市波野小地野", "熊本県/阿蘇市/波野/大字小地野", None, None),
    ("静岡県静岡市葵区与一四－１", "静岡県/静岡市/葵区/与一/四丁目/1番", None, None),
    ("札幌市中央区北一一西一三－１", "北海道/札幌市/中央区/北十一条/西十三丁目/1番", None, None),
    ("山形市大字十文字１", "山形県/山形市/大字十文字/1番地", None, None),
    ("鳥取県米子市福万619", "鳥取県/米子市/福万", None, None),
    ("徳島県阿南市富岡町トノ町６５－６", "徳島県/阿南市/富岡町/トノ町/65番地", "徳島県阿南市富岡町トノ町６５－", None),
    ("埼玉県大里郡寄居町大字鷹巣", "埼玉県/大里郡/寄居町/大字鷹ノ巣", "埼玉県大里郡寄居町大字鷹巣", None),
    ("群馬県伊勢崎市国定町２の甲１９９４", "群馬県/伊勢崎市/国定町/二丁目/甲/1994番地", "群馬県伊勢崎市国定町２の甲１９９４", None),
    ("兵庫県宍粟市山崎町上ノ１５０２", "兵庫県/宍粟市/山崎町上ノ/1502番地", "兵庫県宍粟市山崎町上ノ１５０２", None),
    ("石川県小松市軽海町ノ１４－１", "石川県/小松市/軽海町/ノ/14番地", None, None),
    ("石川県小松市軽海町ノ－１４－１", "石川県/小松市/軽海町/ノ/14番地", None, None),
    ("香川県高松市林町字１４８", "香川県/高松市/林町", "香川県高松市林町", None),
    ("富山市水橋開発字文化", "富山県/富山市/水橋開発", None, None),
    ("富山市水橋開発町", "富山県/富山市/水橋開発町", None, None),
    ("大阪府大阪市中央区上町a-6", "大阪府/大阪市/中央区/上町/A番", None, None),
    ("滝上町字滝上市街地１条通り", "北海道/紋別郡/滝上町/字滝ノ上市街地一条通", "滝上町字滝上市街地１条通り", None),
    ("愛知県春日井市上条町１", "愛知県/春日井市/上条町/一丁目", None, None),
    ("愛知県春日井市上町１", "愛知県/春日井市/上ノ町/一丁目", None, None),
    ("宮城県仙台市宮城野区福室字久保野２", "宮城県/仙台市/宮城野区/福室/久保野二番", None, None),
    ("香川県綾歌郡宇多津町浜２の１２", "香川県/綾歌郡/宇多津町/浜二番丁/12番", None, None),
    ("青森県十和田市東１６－４８", "青森県/十和田市/東十六番町/48番", None, None),
    ("石川県白山市鹿島町１", "石川県/白山市/鹿島町/一号", None, None),
    ("北海道北見市留辺蘂町温根湯温泉１", "北海道/北見市/留辺蘂町温根湯温泉/一区", None, None),
    ("涌谷町涌谷八方谷１の16", "宮城県/遠田郡/涌谷町/涌谷/八方谷一/16番地", None, None),
    ("千葉県八街市八街字七本松ろ９７－１", "千葉県/八街市/八街ろ/97番地", "千葉県八街市八街字七本松ろ９７－", False),
    ("長野県千曲市礒部字下河原１１３７", "長野県/千曲市/大字磯部", "長野県千曲市礒部", False),
    ("長野県千曲市礒部字下河原１１３７", "長野県/千曲市/大字磯部/1137番地", "長野県千曲市礒部字下河原１１３７", True),
    ("佐賀県嬉野市嬉野町大字下野字長波須ハ丙１２２４", "佐賀県/嬉野市/嬉野町/大字下野", "佐賀県嬉野市嬉野町大字下野", False),
    ("佐賀県嬉野市嬉野町大字下野字長波須ハ丙１２２４", "佐賀県/嬉野市/嬉野町/大字下野/丙", "佐賀県嬉野市嬉野町大字下野字長波須ハ丙", True),
    ("青森県八戸市鮫町骨沢１", "青森県/八戸市/大字鮫町/字骨沢/1番地", None, None),
    ("宮城県石巻市渡波字転石山１－６", "宮城県/石巻市/渡波/字転石山/1番地", None, None),
    ("北海道上川郡新得町字新得基線１", "北海道/上川郡/新得町/字新得基線/1番地", "北海道上川郡新得町字新得基線１", None),
    ("高知県高岡郡佐川町字若枝甲４８５", "高知県/高岡郡/佐川町/甲/485番地", "高知県高岡郡佐川町字若枝甲４８５", True),
    ("広島県府中市鵜飼町十輪谷甲１２４－１", "広島県/府中市/鵜飼町/甲/124番地", "広島県府中市鵜飼町十輪谷甲１２４－", True),
    ("愛媛県松山市平林乙２－３", "愛媛県/松山市/平林", "愛媛県松山市平林", None),
    ("山形県酒田市京田２－１－１１", "山形県/酒田市/京田/二丁目/1番地", None, None),
    ("宮城県仙台市青葉区芋沢字田尻６６", "宮城県/仙台市/青葉区/芋沢/字田尻/66番地", "宮城県仙台市青葉区芋沢字田尻６６", None),
    ("宮城県仙台市青葉区芋沢６６", "宮城県/仙台市/青葉区/芋沢/66番地", "宮城県仙台市青葉区芋沢６６", None),
    ("奥州市水沢佐倉河字中半入川原１", "岩手県/奥州市/水沢佐倉河/字中半入川原", None, None),
    ("鹿児島県霧島市霧島大字永水４９６２", "鹿児島県/霧島市/霧島永水/4962番地", "鹿児島県霧島市霧島大字永水４９６２", None),
    ("長野県小谷村大字中小谷丙１３１", "長野県/北安曇郡/小谷村/大字中小谷", "長野県小谷村大字中小谷", None),
    ("佐賀県鹿島市納富分字藤津甲２", "佐賀県/鹿島市/大字納富分/藤津甲", "佐賀県鹿島市納富分字藤津甲", None),
    ("福島県いわき市平上高久塚田97乙", "福島県/いわき市/平上高久/塚田/97番/乙地", None, None),
    ("相模原市田名2179", "神奈川県/相模原市/緑区/田名/2179番地", None, None),
    ("徳島県阿波郡市場町大字市場字上野段385-1", "徳島県/阿波市/市場町市場/字上野段/385番地/1", None, None),
    ("阿波市上野段385-1", "徳島県/阿波市/市場町市場/字上野段/385番地/1", None, None),
    ("仙台市青葉区芋沢字大竹新田下１９", "宮城県/仙台市/青葉区/芋沢/大竹新田下", None, False),
    ("徳島県三好市池田町中西ナガウチ２７４－１", "徳島県/三好市/池田町中西/ナガウチ/274番地", None, None),
    ("脇町猪尻西上野61-1", "徳島県/美馬市/脇町大字猪尻/字西上野/61番地/1", None, None),
    ("東京都小金井市の住宅街", "東京都/小金井市", "東京都小金井市", None),
    ("三重県津市広明町13番地", "三重県/津市/広明町/13番地", "三重県津市広明町13番地", None),
]


def places():
    """Rows of PLACES and MOVED: each beginning of a path once; cities have a code of their own."""
    rows, codes = {}, itertools.count(50001)
    for line in [*PLACES.split(), *[x for x in MOVED if x[3].isdigit()]]:
        path = []
        for part in line.split("/"):
            name, level = part[:-1].removesuffix(":"), int(part[-1])
            path.append(name)
            note = f"jisx0402:{next(codes)}" if level == 3 else ""
            rows.setdefault("/".join(path), [level, 130 + len(rows) / 100, 35.0, 2, note])
        if line in MOVED:
            rows["/".join(path)][4] = f"ref:{MOVED[line]}"
    return rows


@pytest.fixture(scope="module")
def gazetteer(spark):
    rows = []
    for line in (Path(__file__).parent / "gazetteer.csv").read_text().splitlines():
        path, level, x, y, priority, note = line.split(",", 5)
        note = f"ref:{MOVED[path]}" if path in MOVED else note
        rows.append((path, int(level), float(x) if x else None, float(y) if y else None, int(priority), note))
    known = {r[0] for r in rows}
    rows += [(path, *rest) for path, rest in places().items() if path not in known]
    nodes = gazetteer_from_paths(spark, spark.createDataFrame(rows, "path string, level int, x double, y double, priority int, note string"))
    registry = spark.createDataFrame([("223440010000", [("静岡県",), ("駿東郡",), ("小山町",), ("竹之下",)], 1, 1)], "code string, names array<struct<kanji:string>>, aza_class int, start_count_type int")
    return Gazetteer(nodes, registry)


def test_goldens(spark, gazetteer):
    queries = spark.createDataFrame([(k, q) for k, (q, _, _) in enumerate(GOLDENS)] + [(90, ""), (91, None), (92, "nowhere")], "qid bigint, query string")
    got = {r["qid"]: r for r in geocode(gazetteer, queries).where("rank = 1").collect()}
    for k, (query, full, matched) in enumerate(GOLDENS):
        assert k in got, query
        assert (got[k]["fullname"], got[k]["matched"]) == (full, matched), query
    assert not {90, 91, 92} & set(got)


@pytest.mark.parametrize("skip", [None, False, True])
def test_more_goldens(spark, gazetteer, skip):
    asked = [(q, full, matched) for q, full, matched, s in MORE if s is skip]
    queries = spark.createDataFrame([(k, q) for k, (q, _, _) in enumerate(asked)], "qid bigint, query string")
    got = {r["qid"]: r for r in geocode(gazetteer, queries, Settings(aza_skip=skip)).where("rank = 1").collect()}
    wrong = []
    for k, (query, full, matched) in enumerate(asked):
        r = got.get(k)
        if r is None or not f"{r['fullname']}/".startswith(f"{full}/") or matched not in (None, r["matched"]):
            wrong.append((query, full, matched, r and (r["fullname"], r["matched"])))
    assert not wrong


def test_settings(gazetteer):
    assert search(gazetteer, "落合1-15-2", Settings(target_area=("多摩市",)))["candidates"][0]["fullname"] == "東京都/多摩市/落合/一丁目/15番地/2"
    assert search(gazetteer, "落合1-15-2", Settings(target_area=("14",))) == {"matched": "", "candidates": []}
    text = "静岡県駿東郡小山町竹之下字上ノ原５５４"
    assert search(gazetteer, text, Settings(aza_skip=False))["candidates"][0]["fullname"] == "静岡県/駿東郡/小山町/竹之下"
    assert search(gazetteer, text, Settings(aza_skip=None))["candidates"][0]["fullname"] == "静岡県/駿東郡/小山町/竹之下/554番地"
    groups = search(gazetteer, "多摩市落合1-15", Settings(best_only=False))
    assert groups[0]["matched"] == "多摩市落合1-15"


@pytest.mark.parametrize(("text", "expected", "want"), [("２-", 0, (2, 1)), ("1234a", 0, (1234, 4)), ("12345", 12, (12345, 5)), ("0015", 0, (15, 4)), ("一三五", 0, (135, 3)), ("二千四十五万円", 0, (20450000, 6)), ("二千四十五万円", 2004, (2004, 3)), ("四十二１０１", 0, (42, 3)), ("4千2百", 0, (4200, 4)), ("こんにちは", 0, (0, 0)), ("０線", 0, (0, 1))])
def test_numbers(text, expected, want):
    assert read_number(text, expected) == want


def test_standard(spark):
    s = Standard()
    pairs = [("１０１番地", "101.番地"), ("二十四号", "24.号"), ("あ二五四線", "ア254.線"), ("２の１", "2.ノ1."), ("井の頭公園駅", "井ノ頭公園駅"), ("竜ヶ崎市", "竜ガ崎市"), ("つつじが丘", "ツツジガ丘"), ("龍崎市", "竜崎市"), ("籠原駅", "篭原駅"), ("大字道仏通り", "道仏通"), ("ａ−ー1.", "A--1.")]
    assert [s(a) for a, _ in pairs] == [b for _, b in pairs]
    frame = spark.createDataFrame([(a,) for a, _ in pairs] + [(None,)], "t string").select(s.column("t").alias("s"))
    assert [r["s"] for r in frame.collect()] == [b for _, b in pairs] + [""]
    assert match_length("東京都多摩市落合", "東京都多摩市落合") == 8
    assert match_length(s("千代田区一ツ橋２-１", True), "1000.代田区1.ッ橋2.-1.") == 10
    assert match_length(s("福島県浪江町高瀬丈六十二", True), "福島県波江町高瀬丈六十二") == 12
    assert match_length("滝沢字小林60番地113", "滝ノ沢平") == 0
    assert [skippable(t) for t in ("字小坂145番地", "字一ノ瀬甲2048番地先", "一丁目15番地")] == [3, 4, 0]


def test_areas_omissible_children_and_stream(spark, gazetteer, tmp_path):
    from addrspark.operators.search import check_areas, omissible_children
    from addrspark.streaming.geocode import geocode_stream

    check_areas(gazetteer, ["13", "13224", "多摩市"])
    with pytest.raises(ValueError):
        check_areas(gazetteer, ["どこか"])
    named = {r["id"]: r["name"] for r in gazetteer.nodes.select("id", "name").collect()}
    got = {(named[r["parent_id"]], named[r["id"]]) for r in omissible_children(gazetteer).collect()}
    assert ("小山町", "竹之下") not in got and ("多摩市", "落合") in got
    spark.createDataFrame([(1, "多摩市落合1-15"), (2, "長野県小谷村")], "qid bigint, query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid bigint, query string").parquet(str(tmp_path / "in"))
    query = geocode_stream(gazetteer, stream, lambda found, k: found.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}")), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert {r["fullname"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"東京都/多摩市/落合/一丁目/15番地", "長野県/北安曇郡/小谷村"}


def test_geojson(spark, gazetteer):
    import json

    from addrspark.operators.search import results_geojson

    found = geocode(gazetteer, spark.createDataFrame([(1, "多摩市落合1-15")], "qid bigint, query string"))
    one = json.loads(results_geojson(found).first()["geojson"])
    assert one["geometry"] == {"type": "Point", "coordinates": [139.428, 35.625]}
    assert one["properties"]["matched"] == "多摩市落合1-15"
