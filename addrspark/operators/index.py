"""The notation index, and prefix joins over it as equi-joins.

Keys are runs of consecutive elements of a node's path, from any start, with the name in the middle optional where it is a
county; keys of elements with an optional postfix exist without it, and those with an optional letter without that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import POSTFIXES
from ..functions.normalize import MIDDLE

COUNTY, LAST_LEVEL = 2, 5


def without_postfix(key: Column, level: int) -> Column:
    """key without what an element of that level may lose at its end."""
    head, _, tail = POSTFIXES[level].partition("(")
    return F.regexp_replace(key, f"({head})({tail}", "$1")


def optional_variants(text: Column, optional: tuple[str, ...] = MIDDLE) -> Column:
    """The text and all that it can become without some of the optional strings, as a distinct array; null has none.

    Strings are left out throughout or not at all, one after another in the given order: at most a power of two of their
    number, in practice of those that the text holds.
    """
    made = F.when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))

    def without(s: str) -> Callable[[Column], Column]:
        return lambda x: F.array(x, F.replace(x, F.lit(s), F.lit("")))

    for s in optional:
        made = F.array_distinct(F.flatten(F.transform(made, without(s))))
    return made


def _steps(nodes: DataFrame) -> DataFrame:
    on_path = nodes.select("id", "level", F.posexplode("path_ids").alias("at", "ancestor_id"))
    named = nodes.select(F.col("id").alias("ancestor_id"), F.col("name_index").alias("n"), F.col("level").alias("l"))
    joined = on_path.join(named, "ancestor_id").groupBy("id", "level").agg(F.sort_array(F.collect_list(F.struct("at", "n", "l"))).alias("p"))
    return joined


def notation_index(nodes: DataFrame, *, variants: bool = False, postfixes: bool = False) -> DataFrame:
    """(key, node_id, level) of nodes down to LAST_LEVEL."""
    steps = _steps(nodes.where(F.col("level") <= LAST_LEVEL))
    starts = steps.select("id", "level", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("start"))
    run = starts.select("id", "level", F.slice("p", F.col("start"), F.size("p")).alias("p"))
    last = F.element_at("p", -1)
    body = F.slice("p", F.lit(1), F.size("p") - 1)

    def key(kept: Column) -> Column:
        return F.concat(F.array_join(F.transform(kept, lambda s: s["n"]), ""), last["n"])

    keys = run.select("id", "level", F.explode(F.array_distinct(F.array(key(body), key(F.filter(body, lambda s: s["l"] != COUNTY))))).alias("key"))
    if postfixes:
        short = F.col("key")
        for level in (x for x in POSTFIXES if x <= LAST_LEVEL):
            short = F.when(F.col("level") == level, without_postfix(F.col("key"), level)).otherwise(short)
        keys = keys.select("id", "level", F.explode(F.array_distinct(F.array(F.col("key"), short))).alias("key"))
    if variants:
        keys = keys.select("id", "level", F.explode(optional_variants(F.col("key"))).alias("key"))
    return keys.where("key not in ('', '.')").select("key", F.col("id").alias("node_id"), "level").distinct()


def common_prefixes(texts: DataFrame, keys: DataFrame, text: str = "text", longest: int | None = None, lengths: list[int] | None = None) -> DataFrame:
    """texts with every key that its text starts with: all prefixes of the text, joined by equality.

    longest: the length of the longest key, if known; else it is looked up, so that no useless prefix is made. lengths: all
    lengths of keys, if these are known.
    """
    if lengths:
        made = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(text))
        return texts.where(F.length(text) > 0).select("*", F.explode(F.transform(made, lambda k: F.substr(F.col(text), F.lit(1), k))).alias("key")).join(keys, "key")
    if longest is None:
        longest = keys.agg(F.max(F.length("key"))).first()[0] or 0
    n = F.least(F.length(text), F.lit(longest))
    prefixes = texts.where(F.length(text) > 0).select("*", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(F.col(text), F.lit(1), k))).alias("key"))
    return prefixes.join(keys, "key")


def predict_prefixes(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (prefix) with the keys that start with it: one equality join for each length that occurs. Empty prefixes find nothing."""
    lengths = [r[0] for r in wanted.select(F.length("prefix")).distinct().collect()]  # one a length
    out = wanted.where("false").join(keys, F.lit(False)).select("prefix", "key", "node_id")
    for n in sorted(x for x in lengths if x):
        part = wanted.where(F.length("prefix") == n).join(keys.withColumn("prefix", F.substring("key", 1, n)).where(F.length("prefix") == n), "prefix")
        out = out.unionByName(part.select("prefix", "key", "node_id"))
    return out
