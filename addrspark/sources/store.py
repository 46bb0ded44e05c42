"""Tables of the gazetteer as folders of Parquet, with a sidecar of their settings."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReadOnlyError, StoreError
from ..operators.index import common_prefixes, predict_prefixes
from ..operators.tree import dense_positions
from ..plans.staging import discard, staged

#: Positions of a bucket, which is rewritten whole, and the column that names it in the folders.
BUCKET_ROWS, BUCKET = 1 << 20, "__bucket"


def merge_updates(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the fields that changes gives for a key; a null there leaves the old value. Unknown fields fail."""
    unknown = [c for c in changes.columns if c not in table.columns]
    if unknown:
        raise ValueError(f"no such fields: {', '.join(unknown)}")
    fields = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in fields])
    joined = table.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


class Store:
    """A folder of tables whose rows have a dense position. mode: r to read, a to change too, w to begin with none."""

    def __init__(self, spark: SparkSession, path: str, position: str = "pos", mode: str = "a"):
        if mode not in ("r", "a", "w"):
            raise StoreError(f"no such mode: {mode}")
        self.spark, self.path, self.position, self.mode = spark, path.rstrip("/"), position, mode
        fs, p = self._fs(self.path)
        if mode == "r" and not fs.exists(p):
            raise StoreError(f"there is no store at {path}")
        if mode == "w":
            fs.delete(p, True)

    def _changing(self) -> None:
        if self.mode == "r":
            raise ReadOnlyError(f"{self.path} is open for reading")

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _placed(self, rows: DataFrame, order: tuple[str, ...], first: int = 0) -> DataFrame:
        if self.position in rows.columns:
            raise ValueError(f"{self.position} is kept for positions")
        if order:
            return dense_positions(rows, *order, name=self.position, first=first)
        return dense_positions(rows.withColumn("__arrival", F.monotonically_increasing_id()), "__arrival", name=self.position, first=first).drop("__arrival")

    def create(self, name: str, rows: DataFrame, *order: str) -> None:
        """Write rows with positions from 0, in the order given, else as they come."""
        self._changing()
        self._write(self._placed(rows, order), name, "overwrite")

    def _write(self, rows: DataFrame, name: str, mode: str, **options: str) -> None:
        """Rows by buckets of positions, each a folder of its own."""
        placed = rows.withColumn(BUCKET, F.floor(F.col(self.position) / BUCKET_ROWS))
        placed.write.mode(mode).options(**options).partitionBy(BUCKET).parquet(self._folder(name))

    def append(self, name: str, rows: DataFrame, *order: str) -> None:
        self._changing()
        start = self.count(name)
        self._write(self._placed(rows, order, start).select(self.read(name).columns), name, "append")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(name)).drop(BUCKET)

    def read_buckets(self, name: str, buckets: list[int]) -> DataFrame:
        """The rows of some buckets alone; no other folder is read."""
        return self.spark.read.parquet(self._folder(name)).where(F.col(BUCKET).isin(buckets)).drop(BUCKET)

    def count(self, name: str) -> int:
        return self.read(name).count()

    def get(self, name: str, position: int) -> dict:
        found = self.read(name).where(F.col(self.position) == position).limit(1).collect()
        if not found:
            raise ValueError(f"{name} has no position {position}")
        return found[0].asDict(recursive=True)

    def at(self, name: str, where: int | list[int] | slice) -> dict | list[dict] | DataFrame:
        """A row by its position, rows by a list of them, or a DataFrame by a slice; negative ones count from the end.

        Positions that do not exist raise IndexError, as do a slice's first and last.
        """
        n = self.count(name)

        def real(x: int) -> int:
            if not -n <= x < n:
                raise IndexError(f"{name} has no position {x}")
            return x + n if x < 0 else x

        if isinstance(where, slice):
            start, stop = real(where.start or 0), n if where.stop is None else real(where.stop - 1) + 1
            return self.slice(name, start, stop, where.step or 1)
        if isinstance(where, int):
            return self.get(name, real(where))
        wanted = [real(x) for x in where]
        found = {r[self.position]: r.asDict(recursive=True) for r in self.read(name).where(F.col(self.position).isin(wanted)).collect()}
        return [found[x] for x in wanted]

    def slice(self, name: str, start: int, stop: int, step: int = 1) -> DataFrame:
        p = F.col(self.position)
        return self.read(name).where((p >= start) & (p < stop) & ((p - start) % step == 0)).orderBy(p)

    def retrieve(self, name: str, condition: str = "true", args: dict | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows that meet a SQL condition with bound parameters, by position."""
        rows = self.spark.sql(f"SELECT * FROM {{t}} WHERE {condition} ORDER BY {self.position}", args=args or {}, t=self.read(name))
        rows = rows.offset(offset) if offset else rows
        return rows if limit is None else rows.limit(limit)

    def update(self, name: str, changes: DataFrame) -> None:
        """Give rows the new fields of changes, which has their position; a null there leaves the old value.

        Only the buckets of BUCKET_ROWS positions in which rows change are written anew, and each takes the old one's
        place when all are written. Positions that the table does not have change nothing. The driver gets the numbers of
        the changed buckets.
        """
        self._changing()
        changes = staged(changes, "changes")
        touched = [int(r[0]) for r in changes.where(F.col(self.position).isNotNull()).select(F.floor(F.col(self.position) / BUCKET_ROWS)).distinct().collect()]
        new = staged(merge_updates(self.read_buckets(name, touched), changes, self.position), "changed")
        if not new.isEmpty():
            self._write(new, name, "overwrite", partitionOverwriteMode="dynamic")
        discard(changes, new)

    # --- indexes

    def create_index(self, name: str, attribute: str, key: Callable[[Column], Column] = lambda c: F.array(c), where: Column | None = None) -> None:
        """Write an index of an attribute: the values that key makes of it (an array), of the rows that meet where."""
        self._changing()
        rows = self.read(name) if where is None else self.read(name).where(where)
        keyed = rows.select(F.explode(key(F.col(attribute))).alias("key"), self.position).where("key is not null and key <> ''").distinct()
        keyed.write.mode("overwrite").parquet(self._folder(f"{name}.{attribute}.index"))

    def index(self, name: str, attribute: str) -> DataFrame:
        fs, p = self._fs(self._folder(f"{name}.{attribute}.index"))
        if not fs.exists(p):
            raise StoreError(f"{name} has no index of {attribute}")
        return self.spark.read.parquet(p.toString())

    def search_on(self, name: str, attribute: str, values: DataFrame, how: str = "get") -> DataFrame:
        """values (value) with the rows found by an index: get, those with the value; prefixes, those whose key begins it; keys, those whose key it begins."""
        keys = self.index(name, attribute)
        if how == "get":
            found = values.join(keys.withColumnRenamed("key", "value"), "value")
        elif how == "prefixes":
            found = common_prefixes(values, keys, "value").drop("key")
        elif how == "keys":
            ids = keys.withColumnRenamed(self.position, "node_id")
            found = predict_prefixes(ids, values.withColumnRenamed("value", "prefix")).select(F.col("prefix").alias("value"), F.col("node_id").alias(self.position))
        else:
            raise StoreError(f"no such search: {how}")
        return found.distinct().join(self.read(name), self.position)

    def drop_index(self, name: str, attribute: str) -> None:
        self.delete(f"{name}.{attribute}.index")

    # --- the folder

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def delete(self, name: str) -> None:
        self._changing()
        fs, p = self._fs(self._folder(name))
        fs.delete(p, True)

    def set_config(self, **values) -> None:
        self._changing()
        now = self.get_config() | values
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/settings")

    def get_config(self) -> dict:
        path = f"{self.path}/settings"
        fs, p = self._fs(path)
        return json.loads(self.spark.read.text(path).first()[0]) if fs.exists(p) else {}
