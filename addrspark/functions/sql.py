"""The engine's functions for SQL text.

Scalar ones: address_standard (before numerals), address_numbered, address_number, address_match_length, address_geodesic,
address_authority_code. Table ones, for LATERAL: address_notes(note) with k and v, address_variants(text) with variant.
Those that columns can express are SQL functions, which the optimizer sees through; nulls go in as elsewhere.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.codes import ESCAPED, NOTE_END, NOTE_KEY, NOTE_VALUE
from .matching import match_length
from .normalize import MIDDLE, numbered_udf, number_udf


@F.pandas_udf(T.LongType())
def match_length_udf(text: pd.Series, name: pd.Series) -> pd.Series:
    """How many characters of a standard text a name in standard notation takes; null is empty."""
    return pd.Series([match_length(a or "", b or "") for a, b in zip(text, name, strict=True)], dtype="int64")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _notes_sql() -> str:
    raw = lambda pattern: f"r'{pattern}'"
    plain = lambda x: f"regexp_replace({x}, {raw(ESCAPED)}, '$1')"
    key, value = (plain(f"regexp_extract(p, {raw(pattern)}, 1)") for pattern in (NOTE_KEY, NOTE_VALUE))
    return f"SELECT {key} AS k, {value} AS v FROM (SELECT explode(split(coalesce(note, ''), {raw(NOTE_END)})) AS p) WHERE p <> ''"


def _variants_sql() -> str:
    made = "array(t)"
    for s in MIDDLE:
        made = f"array_distinct(flatten(transform({made}, x -> array(x, replace(x, {_quoted(s)}, '')))))"
    return f"SELECT explode({made}) AS variant WHERE t IS NOT NULL"


def register(spark: SparkSession) -> None:
    spark.udf.register("address_numbered", numbered_udf)
    spark.udf.register("address_number", number_udf)
    spark.udf.register("address_match_length", match_length_udf)
    total = "try_cast(substr(c, 1, 1) AS INT) * 6 + try_cast(substr(c, 2, 1) AS INT) * 5 + try_cast(substr(c, 3, 1) AS INT) * 4 + try_cast(substr(c, 4, 1) AS INT) * 3 + try_cast(substr(c, 5, 1) AS INT) * 2"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION address_authority_code(c STRING) RETURNS STRING RETURN CASE WHEN length(c) = 5 THEN c || CAST(CASE WHEN {total} < 11 THEN 11 - ({total}) ELSE (11 - ({total}) % 11) % 10 END AS STRING) ELSE '' END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION address_notes(note STRING) RETURNS TABLE (k STRING, v STRING) RETURN {_notes_sql()}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION address_variants(t STRING) RETURNS TABLE (variant STRING) RETURN {_variants_sql()}")
    spark.udf.register("address_geodesic", geodesic_udf)


@F.pandas_udf(T.DoubleType())
def geodesic_udf(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Metres between two points, also such that are nearly opposite each other; null where a coordinate is null."""
    from .geometry import geodesic

    given = [c.astype(float) for c in (lon1, lat1, lon2, lat2)]  # literals in SQL are decimals
    return pd.Series(geodesic(*given)) + sum(given) * 0
