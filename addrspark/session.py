"""A session over one gazetteer: a folder of tables, or a server, found by name, address or environment."""

from __future__ import annotations

import os
import site
import sys
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import configure, from_environment
from .errors import AddressError, ReadOnlyError, StoreError
from .functions.matching import Settings
from .operators import codes
from .operators.reverse import reverse_geocode
from .operators.search import Gazetteer, check_areas, geocode, search
from .operators.spatial import SpatialIndex, fingerprint
from .sources import dictionary, remote

#: Where a store is looked for: by this variable, then below the interpreter's and the user's own folder.
FOLDER, SERVER, BELOW = "ADDRSPARK_DIR", "ADDRSPARK_SERVER", "addrspark/dictionary"


def locate(mode: str = "r", environ: Mapping[str, str] = os.environ) -> str | None:
    """The folder of the dictionary. To read, the first that has nodes, or None; to write, the first that can be written."""
    if mode not in ("r", "a", "w"):
        raise StoreError(f"no such mode: {mode}")
    named = environ.get(FOLDER, "")
    if named.lower().startswith("http"):
        raise StoreError(f"{FOLDER} holds an address of a server")
    if "://" in named:
        return named
    for folder in [*[Path(named)] * bool(named), Path(sys.prefix) / BELOW, *[Path(site.USER_BASE) / BELOW] * isinstance(site.USER_BASE, str)]:
        if (folder / "nodes").exists():
            return str(folder)
        if mode != "r":
            try:
                folder.mkdir(parents=True, exist_ok=True)
            except OSError:
                continue
            if os.access(folder, os.W_OK):
                return str(folder)
    if mode == "r":
        return None
    raise StoreError("no folder for a dictionary can be written")


class Local:
    """A gazetteer in a folder: nodes, and if there are such, registry and datasets."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings()
        self.nodes = self._table("nodes")
        if self.nodes is None:
            raise StoreError(f"{folder} has no nodes")
        self.registry = self._table("registry")
        self._gazetteer: Gazetteer | None = None
        self._spatial: SpatialIndex | bool | None = None
        self._codes: DataFrame | None = None

    def _table(self, name: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.folder}/{name}") if there else None

    @property
    def gazetteer(self) -> Gazetteer:
        """The prepared tables: those kept in the folder, if they are of its nodes, else made at the first search."""
        if self._gazetteer is None:
            try:
                self._gazetteer = Gazetteer.open(f"{self.folder}/prepared", self.nodes, self.registry)
            except StoreError:
                self._gazetteer = Gazetteer(self.nodes, self.registry)
        return self._gazetteer

    @property
    def spatial(self) -> SpatialIndex | None:
        """The spatial index kept in the folder, if it is of its nodes."""
        if self._spatial is None:
            try:
                self._spatial = SpatialIndex.open(self.nodes, f"{self.folder}/spatial")
            except StoreError:
                self._spatial = False
        return self._spatial or None

    @property
    def code_index(self) -> DataFrame:
        """The codes of all nodes: the table kept in the folder with the prepared ones, else made at each look-up."""
        if self._codes is None:
            kept, mark = self._table("codes"), self._table("codes_mark")
            whole = kept is not None and mark is not None and mark.first()[0] == fingerprint(self.nodes)
            self._codes = kept if whole else codes.code_index(self.nodes)
        return self._codes

    def prepare(self) -> None:
        """Keep in the folder what searches, reverse searches and look-ups by code need, so that no session makes it again."""
        Gazetteer(self.nodes, self.registry).save(f"{self.folder}/prepared", self.nodes)
        SpatialIndex.build(self.nodes, f"{self.folder}/spatial")
        made = codes.code_index(self.nodes)
        made.repartitionByRange(*made.columns).sortWithinPartitions(*made.columns).write.mode("overwrite").parquet(f"{self.folder}/codes")
        self.spark.createDataFrame([(fingerprint(self.nodes),)], "nodes string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/codes_mark")
        self._gazetteer = self._spatial = self._codes = None

    def configure(self, **values) -> Settings:
        settings = configure(self.settings, **values)
        if settings.target_area:
            check_areas(self.gazetteer, list(settings.target_area))
        self.settings = settings
        return settings

    def search(self, query: str) -> dict | list[dict]:
        return search(self.gazetteer, query, self.settings)

    def geocode(self, queries: DataFrame) -> DataFrame:
        return geocode(self.gazetteer, queries, self.settings)

    def reverse(self, x: float, y: float, level: int = 6) -> list[dict]:
        point = self.spark.createDataFrame([(1, float(x), float(y))], "qid bigint, x double, y double")
        found = self.spatial.reverse(point, level) if self.spatial else reverse_geocode(self.nodes, point, level)
        return [r.asDict() for r in found.orderBy("rank").collect()]

    def by_code(self, code: str, kind: str) -> DataFrame:
        """The nodes of a code; kind: postcode, prefcode, citycode or machiaza."""
        wanted, index = self.spark.createDataFrame([(code,)], "code string"), self.code_index
        found = codes.search_by_machiaza(index, self.nodes, wanted) if kind == "machiaza" else codes.search_by_code(index, wanted, kind)
        return self.nodes.join(found.select(F.col("node_id").alias("id")), "id").orderBy("id")

    def registry_row(self, code: str) -> dict | None:
        if self.registry is None:
            raise StoreError(f"{self.folder} has no registry")
        row = codes.search_registry(self.registry, self.spark.createDataFrame([(code,)], "code string")).first()
        return row and row.asDict(recursive=True)

    def datasets(self) -> dict[int, dict]:
        """The data sets by number, in order: some dozens."""
        sets = self._table("datasets")
        return {} if sets is None else {r["id"]: r.asDict() for r in sets.orderBy("id").collect()}

    def version(self) -> str:
        return dictionary.version(self.spark, self.folder)

    def readme(self) -> str:
        return dictionary.readme(self.spark, self.folder)


class Remote:
    """A gazetteer behind a server, which can be read only."""

    def __init__(self, spark: SparkSession, url: str, namespace: str, settings: Settings | None = None):
        self.spark, self.url, self.namespace, self.settings = spark, url, namespace, settings or Settings()
        self.session = remote.Session(url, namespace)

    def configure(self, **values) -> Settings:
        self.settings = configure(self.settings, **values)
        return self.settings

    def geocode(self, queries: DataFrame) -> DataFrame:
        return remote.geocode_remote(queries, self.url, self.namespace, self.settings)

    def search(self, query: str) -> list[dict]:
        rows = self.geocode(self.spark.createDataFrame([(1, query)], "qid bigint, query string")).orderBy("rank").collect()
        return [r.asDict() for r in rows]

    def reverse(self, x: float, y: float, level: int = 6) -> list[dict]:
        point = self.spark.createDataFrame([(1, float(x), float(y))], "qid bigint, x double, y double")
        return [r.asDict() for r in remote.reverse_remote(point, self.url, self.namespace, level).orderBy("rank").collect()]

    def registry_row(self, code: str) -> dict | None:
        return self.session.registry(code)

    def datasets(self) -> dict[int, dict]:
        return dict(sorted(self.session.datasets().items()))

    def version(self) -> str:
        return self.session.version()

    def readme(self) -> str:
        return self.session.readme()


_current: Local | Remote | None = None


def connect(spark: SparkSession, folder: str | None = None, url: str | None = None, *, namespace: str = "", mode: str = "r", environ: Mapping[str, str] = os.environ, **values) -> Local | Remote:
    """A gazetteer by folder, else by a server's url, else by the environment, else from the usual folders."""
    settings = configure(from_environment(environ), **{k: v for k, v in values.items() if k != "target_area"})
    if folder is None and not url:
        folder, url = (environ.get(FOLDER) and locate(mode, environ)), environ.get(SERVER)
        folder = folder or (None if url else locate(mode, environ))
    if folder is not None:
        made: Local | Remote = Local(spark, folder, settings)
    elif not url:
        raise StoreError("neither a folder nor a server is known")
    elif mode != "r":
        raise ReadOnlyError("a server can be read only")
    else:
        made = Remote(spark, url, namespace, settings)
    if "target_area" in values:
        made.configure(target_area=values["target_area"])
    return made


def init(spark: SparkSession, folder: str | None = None, url: str | None = None, **values) -> Local | Remote:
    """connect, and make it the module's gazetteer."""
    global _current
    _current = connect(spark, folder, url, **values)
    return _current


def free() -> None:
    global _current
    _current = None


def is_initialized() -> bool:
    return _current is not None


def current() -> Local | Remote:
    if _current is None:
        raise AddressError("no gazetteer is open")
    return _current
