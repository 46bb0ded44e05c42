"""Installing a dictionary: its node table from SQLite, with paths, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..plans.staging import staged
from . import sqlite

#: Column of a dictionary's node table -> ours.
COLUMNS = {"id": "id", "name": "name", "nameIndex": "name_index", "x": "x", "y": "y", "level": "level", "priority": "priority", "note": "note", "parentId": "parent_id", "siblingId": "sibling_id"}

NOTES = ("metadata.txt", "README.md")


def with_paths(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """nodes (id, parent_id, name, ...) with path_ids, path_names and path_levels: one join with the parents for each level of depth."""
    done, front = None, staged(nodes.where("parent_id <= 0 AND id > 0").withColumn("path_ids", F.array("id")).withColumn("path_names", F.array("name")).withColumn("path_levels", F.array("level")), "paths")
    for _ in range(max_depth):
        done = front if done is None else done.unionByName(front)
        up = front.select(F.col("id").alias("__p"), F.col("path_ids").alias("__ids"), F.col("path_names").alias("__names"), F.col("path_levels").alias("__levels"))
        front = staged(nodes.join(up, F.col("parent_id") == F.col("__p")).select(*nodes.columns, F.concat("__ids", F.array("id")).alias("path_ids"), F.concat("__names", F.array("name")).alias("path_names"), F.concat("__levels", F.array("level")).alias("path_levels")), "paths")
        if front.isEmpty():
            return done
    raise ValueError(f"the tree is deeper than {max_depth}")


def install(spark: SparkSession, path: str, target: str, table: str = "address_node", partitions: int = 64) -> int:
    """Write the nodes to target and return their number. Levels and priorities become ints; 0.0 is a valid coordinate."""
    sqlite.register(spark)
    raw = spark.read.format("gaz_sqlite").option("path", path).option("table", table).option("partitions", partitions).load()
    nodes = raw.select(*[F.col(a).alias(b) for a, b in COLUMNS.items()]).withColumns({"level": F.col("level").cast("int"), "priority": F.col("priority").cast("int")})
    # by id, so that few ids are read from few row groups
    with_paths(staged(nodes, "raw")).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _registry(raw: DataFrame) -> DataFrame:
    """The registry's table, whose names are JSON lists of level, kanji, kana, roma and code."""
    names = F.from_json("names", "array<array<string>>")
    part = F.transform(names, lambda n: F.struct(n[0].cast("int").alias("level"), n[1].alias("kanji"), n[2].alias("kana"), n[3].alias("roma"), n[4].alias("code")))
    codes = F.filter(F.split(F.coalesce("postcode", F.lit("")), "[;,]"), lambda x: x != "")
    return raw.select("code", part.alias("names"), F.col("azaClass").cast("int").alias("aza_class"), F.col("isJukyo").cast("boolean").alias("is_jukyo"), F.col("startCountType").cast("int").alias("start_count_type"), codes.alias("postcode"), F.col("namesIndex").alias("names_index"))


def download(url: str, folder: str) -> str:
    """Fetch a packed dictionary into a local folder; its path. An address that cannot be read raises StoreError."""
    import shutil
    import urllib.request
    from pathlib import Path

    target = Path(folder) / url.rstrip("/").rsplit("/", 1)[-1]
    try:
        with urllib.request.urlopen(url) as source, open(target, "wb") as out:  # noqa: S310
            shutil.copyfileobj(source, out)
    except (OSError, ValueError) as e:
        target.unlink(missing_ok=True)
        raise StoreError(f"{url} cannot be fetched") from e
    return str(target)


def install_archive(spark: SparkSession, path: str, folder: str) -> dict[str, int]:
    """Unpack a zipped dictionary, and write its tables to folder; the number of rows of each.

    The archive holds SQLite files, each with one or more of the tables address_node, aza_master and dataset, and the notes
    metadata.txt and README.md. They are unpacked next to it, for SQLite needs files that every worker can open: the
    archive lies in a folder that all share. What folder held before is gone only when all tables are written.
    """
    import shutil
    import zipfile
    from pathlib import Path

    if not zipfile.is_zipfile(path):
        raise StoreError(f"{path} is no packed dictionary")
    inside, made, next_folder = Path(f"{path}.unpacked"), {}, f"{folder.rstrip('/')}.next"
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():  # by their own names alone, so that nothing is written elsewhere
            name = Path(info.filename).name
            if not info.is_dir() and (name.endswith((".db", ".sqlite")) or name in NOTES):
                inside.mkdir(exist_ok=True)
                with z.open(info) as source, open(inside / name, "wb") as out:
                    shutil.copyfileobj(source, out)
    sqlite.register(spark)
    files = sorted(inside.glob("*.db")) + sorted(inside.glob("*.sqlite")) if inside.exists() else []
    for file in files:
        for name in sqlite.tables(str(file)):
            if name == "address_node":
                made["nodes"] = install(spark, str(file), f"{next_folder}/nodes")
            elif name in ("aza_master", "dataset"):
                raw = spark.read.format("gaz_sqlite").option("path", str(file)).option("table", name).load()
                to, rows = ("registry", _registry(raw)) if name == "aza_master" else ("datasets", raw.select(F.col("id").cast("int").alias("id"), "title", "url"))
                rows.write.mode("overwrite").parquet(f"{next_folder}/{to}")
                made[to] = spark.read.parquet(f"{next_folder}/{to}").count()
    if "nodes" not in made:
        raise StoreError(f"{path} has no table of nodes")
    fs, to = _fs(spark, folder)
    for note in NOTES:
        if (inside / note).exists():
            fs.copyFromLocalFile(_fs(spark, f"file://{(inside / note).resolve()}")[1], _fs(spark, f"{next_folder}/{note}")[1])
    fs.delete(to, True)
    fs.rename(_fs(spark, next_folder)[1], to)
    shutil.rmtree(inside)
    return made


def version(spark: SparkSession, folder: str) -> str:
    """The first line of metadata.txt, else the day README.md was written, else (Unknown)."""
    import datetime

    path = lambda name: _fs(spark, f"{folder}/{name}")[1]
    fs = _fs(spark, folder)[0]
    if fs.exists(path("metadata.txt")):
        return spark.read.text(f"{folder}/metadata.txt").first()[0].rstrip()
    if fs.exists(path("README.md")):
        return datetime.datetime.fromtimestamp(fs.getFileStatus(path("README.md")).getModificationTime() / 1000, datetime.UTC).strftime("%Y%m%d")
    return "(Unknown)"


def readme(spark: SparkSession, folder: str) -> str:
    fs, path = _fs(spark, f"{folder}/README.md")
    if fs.exists(path):
        return spark.read.text(f"{folder}/README.md", wholetext=True).first()[0]
    return "(no README information)"


def uninstall(spark: SparkSession, folder: str) -> None:
    fs, path = _fs(spark, folder)
    fs.delete(path, True)
