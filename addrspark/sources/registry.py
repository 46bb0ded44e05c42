"""The registry of town blocks from its CSV, and the data sets behind a gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import aza_name_column

#: Level, columns of name, kana and roma, and digits of the code that name it; the city's depend on whether a ward follows.
_PARTS = ((1, "pref", 2), (2, "county", 3), (3, "city", None), (4, "ward", 5), (5, "oaza_cho", 9), (6, "chome", 12), (6, "koaza", 12))


def registry_from_rows(rows: DataFrame) -> DataFrame:
    """code, names, names_index, aza_class, is_jukyo, start_count_type, postcode of the registry's CSV rows."""
    code = F.concat(F.substring("lg_code", 1, 5), F.col("machiaza_id"))
    c = lambda name: F.col(name) if name in rows.columns else F.lit("")
    full = lambda x: F.coalesce(x, F.lit("")) != ""

    def part(level: int, name: str, digits: int | None) -> Column:
        n = F.when(full(c("ward")), 3).otherwise(5) if digits is None else F.lit(digits)
        roma = F.concat(c("chome_number"), F.lit("chome")) if name == "chome" else c(f"{name}_roma")
        return F.when(full(c(name)), F.struct(F.lit(level).alias("level"), c(name).alias("kanji"), c(f"{name}_kana").alias("kana"), roma.alias("roma"), F.substr(code, F.lit(1), n).alias("code")))

    names = F.filter(F.array(*[part(*p) for p in _PARTS]), lambda x: x.isNotNull())
    out = rows.select(code.alias("code"), names.alias("names"), c("machiaza_type").try_cast("int").alias("aza_class"), (F.coalesce(c("rsdt_addr_flg"), F.lit("")) == "1").alias("is_jukyo"), c("wake_num_flg").try_cast("int").alias("start_count_type"), F.when(full(c("post_code")), F.split(c("post_code"), ";")).otherwise(F.array().cast("array<string>")).alias("postcode"))
    return out.withColumn("names_index", aza_name_column(F.transform("names", lambda x: x["kanji"])))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_from_rows(spark.read.option("header", True).csv(path))


def by_names(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (names array<string>) with the first code of that sequence of names, in standard notation."""
    first = registry.groupBy("names_index").agg(F.min("code").alias("code"))
    return wanted.withColumn("names_index", aza_name_column(F.col("names"))).join(first, "names_index").drop("names_index")


def datasets(spark: SparkSession, rows: list[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "id int, title string, url string")


def with_dataset(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes with the title and url of the data set that their priority names. Data sets are a few dozen rows."""
    return nodes.join(F.broadcast(sets.select(F.col("id").alias("__d"), "title", "url")), F.col("priority") == F.col("__d"), "left").drop("__d")
