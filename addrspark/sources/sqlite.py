"""A batch data source for the tables of SQLite files: spark.read.format("gaz_sqlite"), and as a sink df.write of it.

Options: path, the file, which must be on every worker (SparkContext.addFile, or a mounted folder); table; partitions.
Rows are read by ranges of the row id, so that a large table is read by many tasks. A schema that is given names the columns
that are read; filters go into the statement, for which register sets spark.sql.python.filterPushdown.enabled.

Each task writes a file of its own beside the target, in a folder that all share; the job's end puts them together, in the
order of the tasks, and then takes the target's place, so that a failed write leaves the target as it was and nothing else.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from glob import escape, glob
from itertools import islice

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"INTEGER": LongType(), "REAL": DoubleType(), "TEXT": StringType(), "BOOLEAN": BooleanType()}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    """The names of a file's tables."""
    with closing(_connect(path)) as c:
        return [name for (name,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f: Filter, names: list[str]) -> tuple[str, list] | None:
    """The SQL of a filter and what is bound in it; None of one that is left to Spark."""
    name = getattr(f, "attribute", ())
    if len(name) != 1 or name[0] not in names:
        return None
    column, plain = _quoted(name[0]), (bool, int, float, str)
    if type(f) in _COMPARED and isinstance(f.value, plain):
        return f"{column} {_COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, In) and f.value and all(isinstance(v, plain) for v in f.value) and len(f.value) <= 500:
        return f"{column} IN ({', '.join('?' * len(f.value))})", [*f.value]
    if isinstance(f, StringStartsWith):
        return f"substr({column}, 1, {len(f.value)}) = ?", [f.value]
    if isinstance(f, IsNull | IsNotNull):
        return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    return None


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names, self.options = schema.fieldNames(), options
        self.where: list[tuple[str, list]] = []
        self.truths = [k for k, f in enumerate(schema.fields) if isinstance(f.dataType, BooleanType)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            made = condition(f, self.names)
            if made is None:
                yield f
            else:
                self.where.append(made)

    def statement(self, partition: Rows) -> tuple[str, list]:
        """What is sent for a partition, and what is bound in it."""
        columns = ", ".join(map(_quoted, self.names)) or "1"
        where = "".join(f" AND {sql}" for sql, _ in self.where)
        return f"SELECT {columns} FROM {_quoted(self.options['table'])} WHERE rowid BETWEEN ? AND ?{where}", [partition.first, partition.last, *[v for _, some in self.where for v in some]]

    def partitions(self) -> list[Rows]:
        with closing(_connect(self.options["path"])) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
        if low is None:
            return []
        n = max(1, int(self.options.get("partitions", 8)))
        step = -(-(high - low + 1) // n)
        return [Rows(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with closing(_connect(self.options["path"])) as c:
            for row in c.execute(*self.statement(partition)):
                # SQLite has numbers for truth values
                yield tuple(v if v is None or k not in self.truths else bool(v) for k, v in enumerate(row)) if self.truths else row


@dataclass
class Written(WriterCommitMessage):
    task: int
    path: str


class SqliteWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options, overwrite: bool):
        kinds = {v: k for k, v in _TYPES.items()}
        self.path, self.table, self.overwrite, self.job = options["path"], options["table"], overwrite, uuid.uuid4().hex
        unknown = [f.name for f in schema.fields if f.dataType not in kinds]
        if unknown:
            raise ValueError(f"SQLite has no such type: {', '.join(unknown)}")
        self.create = f"CREATE TABLE IF NOT EXISTS {_quoted(self.table)} ({', '.join(f'{_quoted(f.name)} {kinds[f.dataType]}' for f in schema.fields)})"
        self.insert = f"INSERT INTO {_quoted(self.table)} ({', '.join(_quoted(f.name) for f in schema.fields)}) VALUES ({', '.join('?' * len(schema.fields))})"

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        part = f"{self.path}.part-{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        with closing(sqlite3.connect(part)) as c, c:
            c.execute(self.create)
            while some := [*islice(iterator, 10_000)]:
                c.executemany(self.insert, [tuple(r) for r in some])
        return Written(context.partitionId(), part)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        new = f"{self.path}.next-{uuid.uuid4().hex}"
        try:
            if os.path.exists(self.path):  # other tables of the file stay
                shutil.copyfile(self.path, new)
            with closing(sqlite3.connect(new)) as c:
                if self.overwrite:
                    c.execute(f"DROP TABLE IF EXISTS {_quoted(self.table)}")
                c.execute(self.create)
                for m in done:
                    c.execute("ATTACH ? AS part", (m.path,))
                    c.execute(f"INSERT INTO main.{_quoted(self.table)} SELECT * FROM part.{_quoted(self.table)} ORDER BY rowid")
                    c.commit()
                    c.execute("DETACH part")
            os.replace(new, self.path)
        finally:
            _remove(new)
            self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Delete the files of all tasks, also of those that failed or ran twice."""
        _remove(*glob(f"{escape(self.path)}.part-{self.job}-*"))


def _remove(*paths: str) -> None:
    for path in paths:
        for name in (path, f"{path}-journal"):
            if os.path.exists(name):
                os.remove(name)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gaz_sqlite"

    def schema(self) -> StructType:
        with closing(_connect(self.options["path"])) as c:
            found = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(name, _TYPES.get(kind.upper(), StringType())) for _, name, kind, *_ in found])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, self.options, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
