"""Standard notation of Japanese address text, as Spark columns and for single strings.

Only the number step leaves the JVM; Spark would evaluate it for rows without a numeral too, whatever the condition.
"""

from __future__ import annotations

import hashlib
import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import HYPHENS, NUMERIC, plain_number, read_number
from .variant_table import VARIANTS

PREFIXES = ("字", "大字", "小字")
_ASCII = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_KATAKANA = {c: c + 0x60 for c in range(0x3041, 0x3097)}
_PREFIX = re.compile("^(?:大字|小字|字)")
_NUMERAL = "[" + "".join(NUMERIC) + "]"
_RUN = re.compile(_NUMERAL + "+")


def load_variants(spark: SparkSession, path: str) -> dict[str, str]:
    """A variant table from a JSON object: representative -> its variants, by any path Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def variant_map(variants: dict[str, str]) -> dict[str, str]:
    """Character -> representative."""
    return {c: rep for rep, chars in variants.items() for c in chars if c != rep}


class Standard:
    """The standardizer with one variant table."""

    def __init__(self, variants: dict[str, str] | None = None):
        self.map = variant_map(VARIANTS if variants is None else variants)
        self._table = str.maketrans(self.map)

    def digest(self) -> str:
        """Tells tables apart that were made with other variants."""
        return hashlib.sha256(json.dumps(self.map, sort_keys=True).encode()).hexdigest()

    def plain(self, text: str | None) -> str:
        """All steps before numbers, hyphens included."""
        if not text:
            return ""
        text = _PREFIX.sub("", text, count=1).translate(self._table).translate(_ASCII).upper().translate(_KATAKANA)
        return "".join("-" if c in HYPHENS else c for c in text.replace("通リ", "通"))

    def __call__(self, text: str | None, keep_numbers: bool = False) -> str:
        text = self.plain(text)
        return text if keep_numbers else numbered(text)

    def plain_column(self, text: Column | str) -> Column:
        c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
        c = F.regexp_replace(c, "^(?:大字|小字|字)", "")
        c = F.translate(c, "".join(self.map), "".join(self.map.values()))
        c = F.upper(F.translate(c, "".join(map(chr, _ASCII)), "".join(map(chr, _ASCII.values()))))
        c = F.translate(c, "".join(map(chr, _KATAKANA)), "".join(map(chr, _KATAKANA.values())))
        return F.translate(F.regexp_replace(c, "通リ", "通"), HYPHENS, "-" * len(HYPHENS))

    def column(self, text: Column | str) -> Column:
        return numbered_udf(self.plain_column(text))


def numbered(text: str) -> str:
    """Every numeral as its value and a period; a period that follows it already is not doubled."""
    out, at = [], 0
    while run := _RUN.search(text, at):
        start = run.start()
        out.append(text[at:start])
        value, n = plain_number(text, start) or read_number(run[0])
        out.append(f"{value}." if isinstance(value, str) else f"{Decimal(value):f}.")  # int's own digits end at 4,300
        at = start + n + (text[start + n : start + n + 1] == ".")
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def numbered_udf(text: pd.Series) -> pd.Series:
    return text.map(numbered, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("i", T.IntegerType())]))
def number_udf(text: pd.Series) -> pd.DataFrame:
    """The number at the head of a text; n is null if a bigint does not hold it."""
    read = [read_number(t or "") for t in text]
    return pd.DataFrame({"n": pd.array([n if n < 1 << 63 else None for n, _ in read], dtype="Int64"), "i": [i for _, i in read]})


# What may be missing from a name or stand in one without need, throughout; in this order.
MIDDLE = ("大字", "小字", "字", "ケ", "ヶ", "ガ", "ツ", "ッ", "ノ")


def aza_name_column(names: Column, standard: Standard | None = None) -> Column:
    """Registry names in one standard string: each without a prefix, and without optional letters inside its body."""
    standard = standard or Standard()

    def one(x: Column) -> Column:
        s = standard.plain_column(x)
        body = F.regexp_replace(F.substr(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0))), "[ケヶガツッノ]", "")
        return F.when(F.length(s) < 3, s).otherwise(F.concat(F.substring(s, 1, 1), body, F.right(s, F.lit(1))))

    return F.array_join(F.transform(names, one), "")
