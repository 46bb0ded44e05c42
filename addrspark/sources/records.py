"""Records as flat rows: a schema from an example record, defaults for what is missing, JSON for lists and objects."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of an example's plain values.
_PLAIN = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def json_type(value) -> str:
    """The Spark type of a JSON value; of a list that of its first element, strings if it has none; null is a string."""
    if isinstance(value, dict):
        return "struct<" + ",".join(f"`{k}`:{json_type(v)}" for k, v in value.items()) + ">" if value else "map<string,string>"
    if isinstance(value, list):
        return f"array<{json_type(value[0]) if value else 'string'}>"
    return _PLAIN.get(type(value), "string")


class RecordCodec:
    """Between records and flat rows, by an example record whose values are the defaults.

    encode: columns of the example in its order; a missing or null one becomes its default (a null default stays null),
    lists and objects become JSON text. decode: the other way; text that is no JSON of the type gives null. Columns that the
    example does not have are left out of either; names are matched as the session does. An empty table gives an empty one.
    """

    def __init__(self, example: dict):
        if not example:
            raise ValueError("an example record needs a field")
        self.example = example
        self.nested = {k for k, v in example.items() if isinstance(v, dict | list)}

    @property
    def schema(self) -> str:
        """Of decoded rows."""
        return ", ".join(f"`{k}` {json_type(v)}" for k, v in self.example.items())

    def _default(self, name: str) -> Column:
        value = self.example[name]
        kind = json_type(value)
        if name in self.nested:
            return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)
        return F.lit(value).cast(kind)

    def _given(self, df: DataFrame, name: str, kind: str) -> Column:
        there = name in df.columns or (df.sparkSession.conf.get("spark.sql.caseSensitive") != "true" and name.lower() in map(str.lower, df.columns))
        return F.col(f"`{name}`").cast(kind) if there else F.lit(None).cast(kind)

    def encode(self, df: DataFrame) -> DataFrame:
        made = []
        for name, value in self.example.items():
            whole = F.coalesce(self._given(df, name, json_type(value)), self._default(name))
            made.append((F.to_json(whole) if name in self.nested else whole).alias(name))
        return df.select(*made)

    def decode(self, df: DataFrame) -> DataFrame:
        made = []
        for name, value in self.example.items():
            kind = json_type(value)
            flat = F.from_json(self._given(df, name, "string"), kind) if name in self.nested else self._given(df, name, kind)
            made.append(flat.alias(name))
        return df.select(*made)

