"""Shards by extendible hashing: a directory over hash prefixes in which only oversized buckets split.

Rows are hashed to 64 bits. A bucket is a prefix of the hash; one that holds more than its byte limit splits on the next
bit, again and again, until every shard fits. The bytes of all prefixes are found from one histogram of the first
FINE_BITS bits: a prefix's bytes are the sum of the finer ones below it, so no pass over the rows is needed for each
split. Where a bucket of FINE_BITS bits is still too large, its rows alone are counted again FINE_BITS bits further on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Narrow, staged, table, text_of

#: Bits of the hash that one histogram looks at: at most 2 ** 14 buckets of it go through one task or a broadcast.
FINE_BITS = 14
HASH_BITS = 64
#: Bytes of text in a shard of the query.
SHARD_BYTES = 8 << 20


def _bits(h: Column, first: int, n: int) -> Column:
    """Bits first .. first + n - 1 of h, from the top, as a number."""
    return F.shiftrightunsigned(h, HASH_BITS - first - n).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def _leaves(sums: DataFrame, limit: int, bits: int) -> DataFrame:
    """(stem, fine, depth, bytes, rows): of each bucket of all bits, the shallowest prefix that fits; else the bucket itself.

    sums: stem, fine, bytes, rows. The sums of all prefixes come from one aggregation.
    """
    above = sums.select("stem", "fine", "bytes", "rows", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(fine, {bits} - depth)"))
    held = above.groupBy("stem", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).where((F.col("bytes") <= limit) | (F.col("depth") == bits))
    held = staged(held, "held")  # a table of its own, so that the short prefixes, which all buckets share, can be split in the join
    return above.select("stem", "fine", "depth", "prefix").join(held.hint("merge"), ["stem", "depth", "prefix"]).groupBy("stem", "fine").agg(F.min(F.struct("depth", "bytes", "rows")).alias("m")).select("stem", "fine", "m.*")


def _bounded(level: DataFrame, first: int) -> DataFrame:
    """A level of the directory, for a join: the first has at most 2 ** FINE_BITS rows and is broadcast, others are not."""
    return F.broadcast(level) if first == 0 else level.hint("merge")


def directory(rows: DataFrame, limit: int, bits: int = FINE_BITS) -> DataFrame:
    """(first, fine, stem, shard, local_depth, shard_bytes, shard_rows): how the hash bits from first on lead to a shard.

    rows: h, n. stem is the hash before bit first; shard is the bits of the shard's prefix as text. A bucket whose rows
    all have the same 64 bits cannot split and stays larger than the limit.
    """
    found, left, first = None, rows.select("h", "n", F.lit("").alias("stem")), 0
    while first < HASH_BITS:
        n = min(bits, HASH_BITS - first)
        sums = staged(left.groupBy("stem", _bits(F.col("h"), first, n).alias("fine")).agg(F.sum("n").alias("bytes"), F.count("*").alias("rows")), "sums")
        leaves = staged(_leaves(sums, limit, n), "leaves")
        named = F.concat("stem", F.substr(F.lpad(F.conv(F.col("fine").cast("string"), 10, 2), n, "0"), F.lit(1), F.col("depth")))
        over = (F.col("bytes") > limit) & F.lit(first + n < HASH_BITS)
        part = leaves.where(~over).select(F.lit(first).alias("first"), "fine", "stem", named.alias("shard"), (F.col("depth") + first).alias("local_depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
        found = part if found is None else found.unionByName(part)
        more = leaves.where(over).select(F.col("stem").alias("of"), F.col("fine").alias("f"), named.alias("next"))
        if more.isEmpty():
            break
        here = left.withColumn("b", _bits(F.col("h"), first, n))
        left = here.join(_bounded(more, first), (F.col("stem") == F.col("of")) & (F.col("b") == F.col("f"))).select("h", "n", F.col("next").alias("stem"))
        first += n
    return staged(found, "directory")


def assign_shards(docs: DataFrame, keep: list[str], *, limit: int = SHARD_BYTES, bits: int = FINE_BITS) -> DataFrame:
    """The keep columns of every row with shard, local_depth, shard_bytes, shard_rows and fits.

    The hash is over doc_id and text, so copies under other ids spread. Bytes are those of the text; null counts none.
    fits is false only for a shard of rows that are all alike, or of one row, larger than the limit. A null doc_id
    hashes like any value; repeated rows share a shard; an empty table has no shard. A result column replaces a kept
    column of its name.
    """
    made = ["shard", "local_depth", "shard_bytes", "shard_rows", "fits"]
    given = Narrow(docs, keep, made, id=("doc_id", lambda c: c), text=("text", lambda c: c))
    rows = given.df.select(*given.kept, F.xxhash64("id", "text").alias("h"), F.octet_length(text_of(F.col("text"))).cast("bigint").alias("n"))
    led = directory(rows.select("h", "n"), limit, bits)
    out, firsts = None, [r["first"] for r in led.select("first").distinct().collect()]  # at most HASH_BITS / bits
    for first in sorted(firsts):
        n = min(bits, HASH_BITS - first)
        level = led.where(F.col("first") == first).select(F.col("fine").alias("f"), F.col("stem").alias("of"), *made[:-1])
        stem = F.substr(F.lpad(F.conv(F.hex("h"), 16, 2), HASH_BITS, "0"), F.lit(1), F.lit(first))
        keyed = rows.withColumn("b", _bits(F.col("h"), first, n)).withColumn("stem", stem)
        part = keyed.join(_bounded(level, first), (F.col("b") == F.col("f")) & (F.col("stem") == F.col("of"))).select(*given.kept, *made[:-1], (F.col("shard_bytes") <= limit).alias("fits"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        none = {"shard": F.lit(""), "local_depth": F.lit(0), "shard_bytes": F.lit(0).cast("bigint"), "shard_rows": F.lit(0).cast("bigint"), "fits": F.lit(True)}
        out = rows.select(*given.kept, *[v.alias(k) for k, v in none.items()])
    return given.named(out, *made)


def write_shards(docs: DataFrame, path: str, *, limit: int = SHARD_BYTES) -> None:
    """Write docs as Parquet, one folder a shard; an executor writes a few whole shards, not a piece of each."""
    assign_shards(docs, docs.columns, limit=limit).drop("local_depth", "shard_bytes", "shard_rows", "fits").repartition("shard").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), ["doc_id"])
