"""SimHash near-duplicates through an inverted index on fingerprint bytes with count filtering.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share at
least four positional bytes. Posting lists of one positional byte hold a 256th of all fingerprints, and tallying all
pairs in them is quadratic; the index is therefore keyed by KEY_BYTES positional bytes at once. With three there are 56
lists for each fingerprint, of which a pair that shares s bytes meets in s over three: meetings are tallied for each
pair, pairs that meet less often than four shared bytes guarantee are dropped, and the bits of the others are verified.

A list holds a 2 ** 24th of all fingerprints, and more only where they are near copies of each other. The pairs of such a
list grow with its square, so in lists of more than MAX_LIST members no pairs are made: their members are dealt, once
each, to the 2,081 values at two bits or fewer from them. Two fingerprints differ in at most four bits if and only if they
share such a value, and each value links its members to the least of them. So every pair meets in short lists alone and
is tallied there, or shares a long list and is linked through a value; the groups are those of all links.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Narrow, discard, map_slices, position, staged, table, text_bytes

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Bytes in a key of the index. With more than some 10 ** 9 fingerprints four make shorter lists, of which there are 70.
KEY_BYTES = 3
#: Posting lists up to this length are joined with themselves.
MAX_LIST = 64
#: Rows that may be broadcast as the ones to drop; beyond that they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Each byte value spread over eight byte lanes, so that up to 255 of them can be added without carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(256)


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text's bytes as an unsigned integer; zero if it has no word."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = len(words) - size + 1
    starts, stops = (ends - lengths)[:n].tolist(), ends[size - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n).astype("<u8")
    octets = hashes.view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255):
        ones += np.add.reduce(LANES[octets[at : at + 255]], axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(rows: DataFrame, n_kept: int) -> DataFrame:
    """rows (n_kept columns, then data, the text's bytes) with fp instead of data: the fingerprint's bits, signed."""
    return map_slices(rows, lambda cols: ({"fp": [_signed(fingerprint(x)) for x in cols["data"]]}, None), {"fp": "bigint"}, n_kept)


#: The changes of up to two bits: one, 64 and 2,016.
FLIPS = [0, *(_signed(1 << i) for i in range(64)), *(_signed((1 << i) | (1 << j)) for i, j in combinations(range(64), 2))]


def postings(distinct: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """fp in its lists: (mask, part, fp), a list for each choice of key_bytes positions."""
    masks = F.array(*[F.lit(_signed(sum(255 << (8 * p) for p in c))).cast("bigint") for c in combinations(range(8), key_bytes)])
    return distinct.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")


def links(distinct: DataFrame, max_list: int = MAX_LIST, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Links (a, b), a < b, of MAX_BITS bits or fewer between fingerprints, with the groups of all such links.

    Of pairs that meet in lists of up to max_list members alone all are returned; of others those through shared values.
    """
    # dealt by number, which is not merged: the few bytes of a fingerprint become 56 rows
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    lists = staged(postings(dealt, key_bytes).groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    members = staged(postings(dealt, key_bytes).join(lists.hint("merge"), ["mask", "part"]), "members")
    short = members.where(F.col("n") <= max_list)
    met = short.alias("l").join(short.alias("r"), (F.col("l.mask") == F.col("r.mask")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.fp") < F.col("r.fp")))
    tally = met.groupBy(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).agg(F.count("*").alias("met"))
    likely = tally.where(F.col("met") >= comb(8 - MAX_BITS, key_bytes))
    near = staged(likely.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b"), "near")
    dense = staged(members.where(F.col("n") > max_list).select("fp").distinct(), "dense")
    discard(lists, members)
    values = F.transform(F.array(*[F.lit(x).cast("bigint") for x in FLIPS]), lambda x: x.bitwiseXOR(F.col("fp")))
    spread = dense.repartition(int(dense.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    shared = staged(spread.select("fp", F.explode(values).alias("value")), "values")
    least = staged(shared.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    far = staged(shared.join(least, "value").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b")).distinct(), "far")
    discard(dense, shared, least)
    return near.unionByName(far).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex of edges (a, b): root is the least vertex of its component.

    Alternating large-star and small-star steps; every step is a table in the shared folder, and a vertex's links are
    never gathered in one row. The rounds needed grow with the logarithm of a component's size; after max_rounds that have
    not settled it raises RuntimeError rather than give wrong groups.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.select(F.col("v").alias("u"), F.col("root").alias("w")).unionByName(edges.select(F.col("root").alias("u"), F.col("v").alias("w")))
        least = staged(both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        large = staged(both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("root")).distinct(), "large")
        low = staged(large.groupBy("v").agg(F.min("root").alias("m")), "star")
        pairs = large.join(low, "v")
        small = staged(pairs.select(F.explode(F.array(F.struct("v", F.col("m").alias("root")), F.struct(F.col("root").alias("v"), F.col("m").alias("root")))).alias("e")).select("e.v", "e.root").where("v <> root").distinct(), "edges")
        now = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first())
        discard(edges, least, large, low)
        edges = small
        if now == state:
            return edges
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grouped(seen: DataFrame, max_list: int = MAX_LIST, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(fp, component_id, root) of the distinct fp in seen (id, fp): the least id, and the least fp, that can be reached."""
    firsts = staged(seen.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp"), max_list, key_bytes))
    of = roots.select(F.col("v").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    of = staged(of.join(firsts, "fp"), "grouped")
    smallest = staged(of.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    linked = of.join(smallest, "root").select("fp", "component_id", "root")
    named = firsts.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    discard(firsts, roots, of, smallest)
    return named


def simhash_groups(docs: DataFrame, key: str = "doc_id", max_list: int = MAX_LIST, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    fingerprint: 16 hex digits. component_id: the smallest doc_id that can be reached over links of MAX_BITS bits or
    fewer. Null and wordless texts have the fingerprint zero and are linked as any other. Rows with a null doc_id keep
    it and never name a component, which is null if it has no other. Repeated rows give repeated rows; an empty table
    gives an empty one. Columns other than the key and text are not looked at, whatever their names.
    """
    rows = Narrow(docs, [], id=(key, lambda c: c), data=("text", text_bytes)).df
    seen = staged(fingerprints(rows, 1), "fingerprints")
    named = grouped(seen, max_list, key_bytes)
    return seen.join(named.drop("root"), "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id, as it is.

    Rows with a null doc_id stay. A doc_id that repeats with other texts is another document each time. Which rows go is
    found without their texts, from doc_id and a hash of the text; the texts stay where they are, unless more than
    BROADCAST_ROWS rows go and must be joined by shuffle. Columns of any name pass as they are.
    """
    at, text = position(docs, key), position(docs, "text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    mark = F.xxhash64(text_bytes(F.col(f"c{text}")))
    rows = plain.where(F.col(f"c{at}").isNotNull()).select(F.col(f"c{at}").alias("id"), mark.alias("mark"), text_bytes(F.col(f"c{text}")).alias("data"))
    seen = staged(fingerprints(rows, 2), "fingerprints")
    named = grouped(seen.select("id", "fp"))
    each = staged(seen.groupBy("fp", "id", "mark").agg(F.count("*").alias("n")), "each")
    # of each component, by its root, the least id, and of that the least mark: ids, and so components' names, can repeat
    best = each.join(named, "fp").groupBy("root").agg(F.min(F.struct("id", "mark")).alias("best")).select("best.*")
    best = staged(best.distinct(), "best")
    gone = staged(each.select("id", "mark").distinct().join(best, ["id", "mark"], "left_anti"), "gone")
    again = staged(each.where("n > 1").select("id", "mark").join(best, ["id", "mark"], "left_semi").distinct(), "again")
    discard(seen, named, each, best)

    def matched(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        few = listed.count() <= BROADCAST_ROWS
        return rows.join((F.broadcast if few else lambda x: x)(listed), (rows["__id"] == listed["id"]) & (rows["__mark"] == listed["mark"]), how)

    marked = plain.withColumns({"__id": F.col(f"c{at}"), "__mark": mark})
    kept = matched(marked, gone, "left_anti")
    if not again.isEmpty():
        kept = matched(kept, again, "left_anti").unionByName(matched(kept, again, "left_semi").dropDuplicates(["__id", "__mark"]))
    return kept.drop("__id", "__mark").toDF(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
