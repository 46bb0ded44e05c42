"""Tools for the table of kanji variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variant_rows(table: DataFrame) -> DataFrame:
    """(variant, representative) of rows (representative, variants: a string of characters)."""
    return table.select(F.explode(F.split("variants", "")).alias("variant"), "representative").where("variant <> '' and variant <> representative").distinct()


def representative_rows(pairs: DataFrame) -> DataFrame:
    """The inverse: (representative, variants), the characters in code point order."""
    return pairs.groupBy("representative").agg(F.array_join(F.sort_array(F.collect_set("variant")), "").alias("variants"))


def occurrences(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(variant, representative, first_id, n): where variants stand in node names; the first node that holds each."""
    letters = nodes.select("id", F.explode(F.array_distinct(F.split("name", ""))).alias("variant"))
    return letters.join(F.broadcast(pairs), "variant").groupBy("variant", "representative").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
