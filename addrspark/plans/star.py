"""A gazetteer out of the star schema: region, nation, customer and order as levels 1, 3, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tree import NO_COORDINATE, build_tree
from .staging import discard, memo, staged

_made: dict[tuple[str, str], DataFrame] = memo()


def star_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a node, with the path_key that build_tree orders by."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = read("customer").select("c_custkey", "c_name", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read("orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    region = nation.select("n_regionkey").distinct().join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def rows(df: DataFrame, keys: list[str], name, level: int, priority: int, note, x=None, y=None) -> DataFrame:
        key = F.array(*[F.lpad(F.col(k).cast("string"), 12, "0") for k in keys])
        none = F.lit(NO_COORDINATE)
        return df.select(key.alias("path_key"), name.cast("string").alias("name"), F.upper(name.cast("string")).alias("name_index"), (none if x is None else x).cast("double").alias("x"), (none if y is None else y).cast("double").alias("y"), F.lit(level).alias("level"), F.lit(priority).alias("priority"), note.alias("note"))

    two = F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0")
    five = F.concat(two, F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    digits = lambda c: F.lpad((c % 10_000_000).cast("string"), 7, "0")
    x, y = 135 + (F.col("c_custkey") % 1000) / 1000.0, 35 + (F.col("c_custkey") % 777) / 1000.0
    return (
        rows(region, ["n_regionkey"], F.col("r_name"), 1, 1, F.concat(F.lit("lasdec:"), two, F.lit("0000/jisx0401:"), two))
        .unionByName(rows(nation, ["n_regionkey", "n_nationkey"], F.col("n_name"), 3, 1, F.concat(F.lit("jisx0402:"), five, F.lit("/postcode:"), five, F.lit("00"))))
        .unionByName(rows(customer, ["n_regionkey", "n_nationkey", "c_custkey"], F.col("c_name"), 7, 3, F.concat(F.lit("aza_id:"), digits(F.col("c_custkey")), F.lit("/postcode:"), digits(F.col("c_custkey") % 1000 * 7)), x, y))
        .unionByName(rows(orders, ["n_regionkey", "n_nationkey", "c_custkey", "o_orderkey"], F.col("o_orderkey"), 8, 7, F.lit(""), x, y + (F.col("o_orderkey") % 10) / 10000.0))
    )


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes without the root; built once a session and folder, and kept as a table in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        tree = build_tree(star_rows(spark, sf_dir))
        _made[key] = staged(tree, "star")
        discard(tree)
    return _made[key]


#: The same nodes for DuckDB: id, parent_id, sibling_id, level, name, name_index, x, y, priority, note, r, n, c, o.
STAR_SQL = """WITH cust AS (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS c, c_name, 135 + (c_custkey % 1000) / 1000.0 AS x, 35 + (c_custkey % 777) / 1000.0 AS y
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
base AS (
  SELECT n_regionkey AS r, CAST(NULL AS INT) AS n, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS o, 1 AS level, 1 AS priority, min(r_name) AS name, CAST(999.9 AS DOUBLE) AS x, CAST(999.9 AS DOUBLE) AS y,
         'lasdec:' || lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || '0000/jisx0401:' || lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') AS note
    FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey
  UNION ALL SELECT n_regionkey, n_nationkey, NULL, NULL, 3, 1, n_name, CAST(999.9 AS DOUBLE), CAST(999.9 AS DOUBLE),
         'jisx0402:' || lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '/postcode:' || lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '00' FROM nation
  UNION ALL SELECT r, n, c, NULL, 7, 3, c_name, CAST(x AS DOUBLE), CAST(y AS DOUBLE),
         'aza_id:' || lpad(CAST(c % 10000000 AS VARCHAR), 7, '0') || '/postcode:' || lpad(CAST(c % 1000 * 7 % 10000000 AS VARCHAR), 7, '0') FROM cust
  UNION ALL SELECT r, n, c, o_orderkey, 8, 7, CAST(o_orderkey AS VARCHAR), CAST(x AS DOUBLE), CAST(y + (o_orderkey % 10) / 10000.0 AS DOUBLE), '' FROM orders JOIN cust ON c = o_custkey),
ids AS (SELECT *, upper(name) AS name_index, row_number() OVER (ORDER BY r, n NULLS FIRST, c NULLS FIRST, o NULLS FIRST) AS id FROM base),
nodes AS (SELECT a.*, CAST(coalesce(p.id, 0) AS BIGINT) AS parent_id,
    CAST(a.id + CASE a.level WHEN 8 THEN 1 WHEN 7 THEN count(*) OVER (PARTITION BY a.r, a.n, a.c) WHEN 3 THEN count(*) OVER (PARTITION BY a.r, a.n) ELSE count(*) OVER (PARTITION BY a.r) END AS BIGINT) AS sibling_id
  FROM ids a LEFT JOIN ids p ON p.r = a.r AND ((a.level = 8 AND p.level = 7 AND p.c = a.c) OR (a.level = 7 AND p.level = 3 AND p.n = a.n) OR (a.level = 3 AND p.level = 1)))
"""
