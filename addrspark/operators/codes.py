"""Codes and notes: splitting, joining, the code index, lookups by code, and the registry of town blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import last_on_path, with_path_levels

#: Keys of notes that no index holds.
UNINDEXED = ("ref", "geoshape_city_id")
#: Patterns of notes: what parts two of them, the key and the value of one, and an escaped character.
NOTE_END, NOTE_KEY, NOTE_VALUE, ESCAPED = r"(?<!\\)/", r"^((?:[^:\\]|\\.)*)", r"^(?:[^:\\]|\\.)*:(.*)$", r"\\([/:\\])"


def notes_of(note: str = "note") -> Column:
    """The notes as an array of (k, v); / parts them and the first : of each parts key and value, unless escaped."""
    parts = F.filter(F.split(F.coalesce(F.col(note), F.lit("")), NOTE_END), lambda x: x != "")

    def plain(x: Column) -> Column:
        return F.regexp_replace(x, ESCAPED, "$1")

    return F.transform(parts, lambda x: F.struct(plain(F.regexp_extract(x, NOTE_KEY, 1)).alias("k"), plain(F.regexp_extract(x, NOTE_VALUE, 1)).alias("v")))


def joined_notes(notes: str = "notes") -> Column:
    def safe(x: Column) -> Column:
        return F.regexp_replace(x, r"([/:\\])", r"\\$1")

    return F.array_join(F.transform(notes, lambda n: F.concat(safe(n["k"]), F.lit(":"), safe(n["v"]))), "/")


def note_value(key: str, pattern: str = ".*", notes: Column | None = None) -> Column:
    """The first value of key that the whole pattern fits; an empty string if there is none."""
    found = F.filter(notes_of() if notes is None else notes, lambda n: (n["k"] == key) & n["v"].rlike(f"^(?:{pattern})$"))
    return F.coalesce(F.get(found, F.lit(0))["v"], F.lit(""))


def code_index(nodes: DataFrame, max_level: int | None = None) -> DataFrame:
    """(category, value, node_id) of every indexed note; of nodes up to max_level."""
    of = nodes if max_level is None else nodes.where(F.col("level") <= max_level)
    rows = of.select(F.col("id").alias("node_id"), F.explode(notes_of()).alias("n"))
    return rows.where(~F.col("n.k").isin(*UNINDEXED)).select(F.col("n.k").alias("category"), F.col("n.v").alias("value"), "node_id").distinct()


def name_index_table(nodes: DataFrame, max_level: int | None = None) -> DataFrame:
    of = nodes if max_level is None else nodes.where(F.col("level") <= max_level)
    return of.select("name_index", F.col("id").alias("node_id"))


def clean_code(code: str | Column) -> Column:
    """Full-width digits become ASCII ones; all else goes."""
    c = F.col(code) if isinstance(code, str) else code
    return F.regexp_replace(F.translate(c, "０１２３４５６７８９", "0123456789"), "[^0-9]", "")


def local_authority_code(code: str | Column) -> Column:
    """Five digits with their check digit; an empty string for an empty code."""
    c = F.col(code) if isinstance(code, str) else code
    total = sum((F.substring(c, k + 1, 1).try_cast("int") * (6 - k) for k in range(1, 5)), F.substring(c, 1, 1).try_cast("int") * 6)
    digit = F.when(total < 11, 11 - total).otherwise((11 - total % 11) % 10)
    return F.when(F.length(c) == 5, F.concat(c, digit.cast("string"))).otherwise("")


def with_codes(nodes: DataFrame) -> DataFrame:
    """nodes with pref_code, city_code, aza_id and postcode: each of the nearest on the path that has it."""
    n = notes_of()
    own = nodes.select(F.col("id").alias("ancestor_id"), note_value("jisx0401", r"\d{2}", n).alias("pref"), note_value("jisx0402", r"\d{5}", n).alias("city"), note_value("aza_id", r"\d{7}", n).alias("aza"), note_value("postcode", r"\d{7}", n).alias("post"))
    own = own.where("pref <> '' or city <> '' or aza <> '' or post <> ''")
    on_path = nodes.select("id", F.explode("path_ids").alias("ancestor_id")).join(own, "ancestor_id")
    nearest = on_path.groupBy("id").agg(*[F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("ancestor_id"))).alias(c) for c in ("pref", "city", "aza", "post")])
    joined = nodes.join(nearest, "id", "left")
    return joined.select(*nodes.columns, *[F.coalesce(c, F.lit("")).alias(to) for c, to in (("pref", "pref_code"), ("city", "city_code"), ("aza", "aza_id"), ("post", "postcode"))])


def aza_code() -> Column:
    return F.when((F.col("city_code") != "") & (F.col("aza_id") != ""), F.concat("city_code", "aza_id")).otherwise("")


def with_area_names(nodes: DataFrame) -> DataFrame:
    """nodes with pref_name and city_name: those of the nearest prefecture, and city or ward, on the path; empty if none."""
    named = with_path_levels(nodes).withColumns({"pref_name": F.coalesce(last_on_path("path_names", [1]), F.lit("")), "city_name": F.coalesce(last_on_path("path_names", [3, 4]), F.lit(""))})
    return named.select(*nodes.columns, "pref_name", "city_name")


def aza_names(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, names): the registry's names down to each node of with_codes; nodes that it does not hold are left out.

    The code of the small area counts from the area level on, else the city's from the city level on, else the prefecture's.
    """
    small, city = F.when(F.col("level") >= 5, aza_code()).otherwise(""), F.when(F.col("level") >= 3, F.col("city_code")).otherwise("")
    of = nodes.select("id", F.coalesce(F.nullif(small, F.lit("")), F.nullif(city, F.lit("")), F.col("pref_code")).alias("code")).where("code <> ''")
    return of.join(search_registry(registry, of.select("code").distinct()).select("code", "names"), "code").select("id", "names")


#: Length of a code -> (category, first digits of the code that count), by kind of search.
KINDS = {"postcode": {7: ("postcode", 7)}, "prefcode": {2: ("jisx0401", 2), 6: ("jisx0401", 2)}, "citycode": {5: ("jisx0402", 5), 6: ("jisx0402", 5)}}


def search_by_code(index: DataFrame, codes: DataFrame, kind: str) -> DataFrame:
    """codes (code) with node_id of every node that has it; codes of other lengths find nothing."""
    c = clean_code("code")
    category, value = F.lit(None), F.lit(None)
    for length, (name, n) in KINDS[kind].items():
        category, value = F.when(F.length(c) == length, name).otherwise(category), F.when(F.length(c) == length, F.substring(c, 1, n)).otherwise(value)
    wanted = codes.select("code", category.cast("string").alias("category"), value.cast("string").alias("value"))
    return wanted.join(index, ["category", "value"]).select("code", "node_id")


def search_by_machiaza(index: DataFrame, nodes: DataFrame, codes: DataFrame) -> DataFrame:
    """codes (code) with node_id by town-block id: 12 or 13 digits name a city too, other lengths do not.

    The city bounds the answer to its subtree; membership in the path stands for the id range.
    """
    c = clean_code("code")
    wanted = codes.select("code", F.when(F.length(c).isin(12, 13), F.substring(c, 1, 5)).alias("city"), F.when(F.length(c) == 12, F.substr(c, F.lit(6))).when(F.length(c) == 13, F.substr(c, F.lit(7))).otherwise(c).alias("aza"))
    found = wanted.join(index.where("category = 'aza_id'").select(F.col("value").alias("aza"), "node_id"), "aza")
    first = index.where("category = 'jisx0402'").groupBy(F.col("value").alias("city")).agg(F.min("node_id").alias("city_id"))
    placed = found.join(first, "city", "left").join(nodes.select(F.col("id").alias("node_id"), "path_ids"), "node_id")
    return placed.where(F.col("city").isNull() | F.array_contains("path_ids", F.col("city_id"))).select("code", "node_id")


def registry_key(code: str | Column) -> Column:
    """The digits by which the registry is searched: 13 to 12, 6 to 5, and five that end in 000 to two."""
    c = F.col(code) if isinstance(code, str) else code
    c = F.when(F.length(c) == 13, F.concat(F.substring(c, 1, 5), F.substr(c, F.lit(7)))).when(F.length(c) == 6, F.substring(c, 1, 5)).otherwise(c)
    return F.when((F.length(c) == 5) & c.endswith("000"), F.substring(c, 1, 2)).otherwise(c)


def search_registry(registry: DataFrame, codes: DataFrame) -> DataFrame:
    """codes (code) with the first registry row, by code, that the code's digits begin; none gives no row.

    Two digits answer with the prefecture alone and five with the names down to the ward, all other fields empty; any
    other number of digits with the whole row.
    """
    wanted = codes.select("code", registry_key("code").alias("__key"))
    lengths = [r[0] for r in wanted.select(F.length("__key")).distinct().collect()]  # one a length
    keyed = None
    for n in sorted(x for x in lengths if x) or [12]:
        part = registry.groupBy(F.substring("code", 1, n).alias("__key")).agg(F.min_by(F.struct(*[F.col(c) for c in registry.columns]), "code").alias("r")).where(F.length("__key") == n)
        keyed = part if keyed is None else keyed.unionByName(part)
    hit = wanted.join(keyed, "__key")
    most = F.when(F.length("__key") == 2, 1).when(F.length("__key") == 5, 4).otherwise(99)
    names = F.filter("r.names", lambda x: x["level"] <= most)
    part = F.length("__key").isin(2, 5)
    return hit.select("code", F.when(part, F.col("__key")).otherwise(F.col("r.code")).alias("aza_code"), names.alias("names"), F.when(~part, F.col("r.aza_class")).alias("aza_class"), F.when(~part, F.col("r.postcode")).alias("postcode"))


def lower_bound(registry: DataFrame, codes: DataFrame) -> DataFrame:
    """codes (code) with bound: the greatest registry code that is not above it; null if there is none.

    An as-of join without a join: both sides in one order, the last registry code carried forward. Rows are dealt by
    their first digits, and the carry across deals is the greatest code before them, found from one maximum a deal.
    """
    lead = lambda c: F.substring(c, 1, 5)
    both = registry.select(F.col("code").alias("k"), F.lit(0).alias("side")).unionByName(codes.select(F.col("code").alias("k"), F.lit(1).alias("side")).distinct())
    both = both.withColumn("g", lead(F.col("k")))
    tops = registry.groupBy(lead(F.col("code")).alias("g")).agg(F.max("code").alias("top"))
    from pyspark.sql import Window

    groups = both.select("g").distinct().join(tops, "g", "left")
    carried = groups.withColumn("before", F.max("top").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)))  # one row a deal
    within = F.last(F.when(F.col("side") == 0, F.col("k")), True).over(Window.partitionBy("g").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("in", within).join(carried.select("g", "before"), "g").where("side = 1").select(F.col("k").alias("code"), F.coalesce("in", "before").alias("bound"))


def inside(area: str, area_index: str) -> Column:
    """1 if the node lies in the area, 0 if not, -1 if this node cannot tell. area_index: the area's standardized name."""
    named = F.when(F.array_contains("path_names", area_index), 1).otherwise(0)
    out = named
    if area[:5].isdigit() and len(area) >= 5:
        out = F.when(F.col("city_code") == area, 1).when(F.col("city_code") != "", 0).when(F.col("pref_code") != area[:2], 0).otherwise(-1)
    if area[:2].isdigit():
        out = F.when(F.col("pref_code") == area, 1).otherwise(out)
    return out
