"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.staging import discard, shared_path, staged

#: Rows that Python code holds as Python objects at once.
SLICE_ROWS = 256

__all__ = ["Narrow", "discard", "map_slices", "position", "same_rule", "shared_path", "staged", "table", "text_of", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One whose files give fewer tasks than there are cores is small, and is dealt over all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def same_rule(spark: SparkSession) -> Callable[[str], str]:
    """What two names must agree in to name the same column in this session."""
    return str if spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true" else str.lower


def position(df: DataFrame, name: str) -> int:
    """Where the column of that name stands; among names that differ in case only, the one written alike, else the first."""
    rule = same_rule(df.sparkSession)
    found = [k for k, c in enumerate(df.columns) if rule(c) == rule(name)]
    if not found:
        raise ValueError(f"no column {name} among {df.columns}")
    return next((k for k in found if df.columns[k] == name), found[0])


def text_of(c: Column) -> Column:
    """A text, with null as the empty one."""
    return F.coalesce(c.cast("string"), F.lit(""))


def text_bytes(c: Column) -> Column:
    """A text's UTF-8 bytes, with null as none."""
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


class Narrow:
    """The kept columns of a table as k0, k1, ..., beside the inputs of an operator under the operator's own names.

    So no name of the user's, with dots, back-quotes or clashes, meets one of the operator's. A kept column gives way to
    a result column of the same name, by the session's case rule; keep may be docs.columns itself, repeats included.
    """

    def __init__(self, docs: DataFrame, keep: list[str], made: Iterable[str] = (), **inputs: tuple[str, Callable[[Column], Column]]):
        rule = same_rule(docs.sparkSession)
        taken = {rule(m) for m in made}
        every = range(len(docs.columns)) if list(keep) == docs.columns else [position(docs, c) for c in keep]
        places = [k for k in every if rule(docs.columns[k]) not in taken]
        plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
        self.names = [docs.columns[k] for k in places]
        self.kept = [f"k{k}" for k in range(len(places))]
        self.df = plain.select(*[F.col(f"c{p}").alias(k) for k, p in zip(self.kept, places, strict=True)], *[f(F.col(f"c{position(docs, c)}")).alias(n) for n, (c, f) in inputs.items()])

    def named(self, df: DataFrame, *made: str) -> DataFrame:
        """df, whose columns are the kept ones and then made, under the users' names."""
        return df.toDF(*self.names, *made)

    def map(self, work: Callable[[dict[str, list]], tuple[dict[str, list], list[int] | None]], made: dict[str, str]) -> DataFrame:
        """The kept columns and made (name -> type), as work makes them of the inputs of a slice of rows.

        work returns the made columns and which rows of the slice they belong to (None: each in turn).
        """
        return self.named(map_slices(self.df, work, made, len(self.kept)), *made)


def map_slices(df: DataFrame, work: Callable[[dict[str, list]], tuple[dict[str, list], list[int] | None]], made: dict[str, str], n_kept: int = 0) -> DataFrame:
    """Apply work to slices of at most SLICE_ROWS rows in Arrow batches. The first n_kept columns pass it by as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in made.items()) or "x int")
    kinds = [f.type for f in to_arrow_schema(new)][: len(made)]
    names = [*df.columns[:n_kept], *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got, rows = work({name: part.column(k + n_kept).to_pylist() for k, name in enumerate(part.schema.names[n_kept:])})
                held = [part.column(k) for k in range(n_kept)]
                if rows is not None:
                    held = [c.take(pa.array(rows, pa.int64())) for c in held]
                yield pa.RecordBatch.from_arrays([*held, *[pa.array(got[n], t) for n, t in zip(made, kinds, strict=True)]], names=names)

    schema = StructType([*df.schema.fields[:n_kept], *new.fields[: len(made)]])
    return df.mapInArrow(run, schema)
