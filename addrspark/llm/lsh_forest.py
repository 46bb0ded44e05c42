"""MinHash near-duplicates by an LSH forest: signatures in several sorted orders, whose neighbours are candidates.

A document's set of shingles has VALUES MinHash values. Each of TREES orders sorts all distinct sets by the values from
another place on. Sets that agree in many values stand side by side there: a set's NEAR neighbours on either side, as far as
they share the first HEAD values, are those with the longest common prefixes, however deep these are where many sets are
alike, and however shallow where few are. So a region of a few sets is compared whole, and a dense one at greater depth.
The sorts are range-partitioned; a region that holds a third of all sets is spread over tasks like any other stretch.

Candidates pass a sketch of their signatures and are then confirmed on the texts' whole sets of shingles, the likeliest two
of each set first; later rounds leave aside what is connected already. Sets with region mates further off than NEAR are
held, where they are not connected yet, against the best-linked member of each of their regions and then against the
likely ones of WIDE neighbours on either side: thousands of near copies are joined by links to a few of them, without their
pairs.

What all this has left apart is gone through exactly. In one order of all shingles, roughly by frequency, similar sets have
one of their first shingles in common, the front, which holds a fifth of a set. Rows of fronts meet by shingle where their
sets are in different components; bounds by place, size and a bitmap, which no similar pair fails, leave the pairs to confirm.
So neither the neighbours looked at nor the sketches decide what is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Narrow, discard, map_slices, staged, table, text_bytes
from .simhash import LOWER, components

SHINGLE, SHARE = 2, 80
TREES, HEAD, TAIL = 32, 4, 12
VALUES = TREES * HEAD
NEAR = 5
#: Neighbours on either side that sets in dense regions are held against at last, if they are not connected by then.
WIDE = 128
#: Of the sketches of such pairs those bits may differ: about as many as differ at the threshold, as mates are many.
WIDE_BITS = 13
#: Of the VALUES bits of two sketches those that may differ: pairs at the threshold differ in a tenth, here far more.
SKETCH_BITS = 29
#: Shingles of texts that a task keeps, as many pairs have a text in common.
CACHED = 400_000
#: One text in so many gives the counts that the order of shingles goes by, and the cells with the greatest counts that are
#: kept, by hash. They decide how long the last pass takes, not what it finds.
ORDER_EVERY, CELL_BITS, KEPT_CELLS = 8, 23, 1 << 20
#: The least bits of a set's bitmap, which has two or more for each shingle.
PARITIES = 512
#: Best candidates of a set that the first round confirms; the second takes all that are not connected by then.
FIRST = 2
_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Where each tree's values behind the first HEAD are in the signature.
_TAILS = (np.arange(TREES)[:, None] * HEAD + HEAD + np.arange(TAIL)) % VALUES


def shingles(data: bytes, size: int = SHINGLE) -> set[bytes]:
    """The distinct shingles of a text's bytes: one of fewer words gives all of them as one; none without words."""
    words = data.translate(LOWER).split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return {joined[a:b] for a, b in zip((ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)}


def signature(hashes: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits; equal ones of different sets agree by chance once in 65,536 times."""
    least = np.full(VALUES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[None, at : at + 256] * _FACTORS[:, None]).min(axis=1), out=least)
    mixed = (least ^ (least >> np.uint64(32))) * _MIX
    return (mixed >> np.uint64(48)).astype("<u2")


def _hashes(some: set[bytes]) -> np.ndarray:
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, len(some)))


def frequencies(rows: DataFrame) -> np.ndarray:
    """By the first CELL_BITS bits of a shingle's hash a level from 0 to 255: the more frequent, the higher.

    rows has mark and data. Counts over one text in ORDER_EVERY; beyond KEPT_CELLS cells, or counted once only, level 0.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                each = [_hashes(shingles(x)) >> np.uint64(64 - CELL_BITS) for x in batch.column(0).slice(at, 64).to_pylist()]
                cell, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    some = rows.where(F.pmod("mark", F.lit(ORDER_EVERY)) == 0).select("data").mapInArrow(cells, "cell int, n bigint")
    counted = staged(some.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select("cell", F.least(F.lit(255), F.floor(16 * F.log2("n"))).cast("int").alias("level")), "cells")
    least, held = 1, 0
    for level, n in sorted(counted.groupBy("level").count().collect(), reverse=True):  # 255 rows at most
        held += n
        if held > KEPT_CELLS:
            least = level + 1
            break
    got = counted.where(F.col("level") >= least).toArrow()
    discard(counted)
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[got["cell"].to_numpy()] = got["level"].to_numpy()
    return levels


def front(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first, as numbers of 32 bits: so many that any similar set has one of them in
    its own front. Shingles whose numbers are alike only bring more sets together."""
    keys = np.sort((levels[hashes >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(56)) | (hashes & np.uint64((1 << 56) - 1)))
    n = len(keys)
    return ((keys[: n - (SHARE * n + 99) // 100 + 1] * _MIX) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each residue by a power of two: whether an odd number of the hashes has it."""
    size = max(PARITIES, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parted(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the longer one folded to the other's length: in no more than sets in members."""
    a, b = (np.frombuffer(z, np.uint64) for z in (x, y))
    least = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, least), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def signed(docs: DataFrame, key: str) -> DataFrame:
    """(id, mark, n, digest, sig, bits, front) of every row: a hash of the text, the size of its set, the set's digest,
    signature, bitmap and front."""
    rows = Narrow(docs, [], id=(key, lambda c: c), mark=("text", lambda c: F.xxhash64(text_bytes(c))), data=("text", text_bytes)).df
    levels = docs.sparkSession.sparkContext.broadcast(frequencies(rows.select("mark", "data")).tobytes())

    def work(cols: dict[str, list]):
        out: dict[str, list] = {"n": [], "digest": [], "sig": [], "bits": [], "front": []}
        by_cell = np.frombuffer(levels.value, np.uint8)
        for data in cols["data"]:
            hashes = _hashes(shingles(data))
            out["n"].append(len(hashes))
            some = len(hashes) > 0
            out["digest"].append(xxhash.xxh3_128_digest(hashes.tobytes()) if some else b"")
            out["sig"].append(signature(hashes).tobytes() if some else b"")
            out["bits"].append(parities(hashes) if some else b"")
            out["front"].append(front(hashes, by_cell) if some else [])
        return out, None

    return map_slices(rows, work, {"n": "bigint", "digest": "binary", "sig": "binary", "bits": "binary", "front": "array<int>"}, 2)


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each value, as two numbers of 64 bits a row of sig."""
    return np.packbits((sig & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ; of signed numbers numpy would count those of the absolute value."""
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int32)


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree of rows (cls, root, sig): the first values, the next ones as sort key, and the sketch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            n = part.num_rows
            sig = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(n, VALUES)
            bits = sketch(sig)
            tails = np.ascontiguousarray(sig[:, _TAILS]).reshape(n * TREES, TAIL)
            tail = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * TAIL), n * TREES, [None, pa.py_buffer(tails)]).cast(pa.binary())
            more = [pa.array(np.repeat(x, TREES)) for x in (part.column(0).to_numpy(), part.column(1).to_numpy(), bits[:, 0], bits[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(np.ascontiguousarray(sig).view("<i8").reshape(-1)), tail, *more], names=["tree", "head", "tail", *_SEEN])


#: Of a row in an order: its class, what that is connected to already, and its sketch.
_SEEN = ("cls", "root", "s0", "s1")
_ROW = ("tree", "head", *_SEEN)


def _neighbours(rows: dict[str, np.ndarray], new: int, near: int, bits: int = SKETCH_BITS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Index pairs of likely and unconnected neighbours among the last new rows and near rows before each, and the indices
    of those that have mates beyond."""
    pairs = []
    n = len(rows["tree"])
    for step in range(1, near + 2):
        now = np.arange(max(n - new, step), n)
        old = now - step
        same = (rows["tree"][now] == rows["tree"][old]) & (rows["head"][now] == rows["head"][old])
        now, old = now[same], old[same]
        if step > near:
            return pairs, np.concatenate([now, old])
        if not len(now):
            continue
        apart = differing(rows["s0"][now], rows["s0"][old]) + differing(rows["s1"][now], rows["s1"][old])
        close = (apart <= bits) & (rows["root"][now] != rows["root"][old])
        pairs.append((now[close], old[close]))
    return pairs, np.zeros(0, np.int64)


def _apart_of(rows: dict[str, np.ndarray], now: np.ndarray, old: np.ndarray) -> dict[str, np.ndarray]:
    a, b = rows["cls"][now], rows["cls"][old]
    return {"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": differing(rows["s0"][now], rows["s0"][old]) + differing(rows["s1"][now], rows["s1"][old])}


_MET = {"kind": "int", "a": "bigint", "b": "bigint", "apart": "int", "part": "int", "place": "bigint", "tree": "int", "head": "bigint", "cls": "bigint", "root": "bigint", "s0": "bigint", "s1": "bigint"}


def _compared(batches: Iterator[pa.RecordBatch], near: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: pairs (a, b, apart). Kind 1: rows (tree, head, cls) with mates beyond near. Kind 2: the first and the last
    near + 1 rows of the task, by their place in it, for the pairs across tasks; some may come twice."""
    part, seen, tail = TaskContext.get().partitionId(), 0, None

    def made(kind: int, n: int, **given) -> pa.RecordBatch:
        kinds = {c: np.int32 if t == "int" else np.int64 for c, t in _MET.items()}
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(given.get(c, np.full(n, kind if c == "kind" else 0)), t)) for c, t in kinds.items()], names=[*kinds])

    for batch in batches:
        now = {c: batch.column(c).to_numpy() for c in _ROW}
        if seen <= near:
            first = {c: x[: near + 1 - seen] for c, x in now.items()}
            n = len(first["tree"])
            yield made(2, n, **first, part=np.full(n, part), place=np.arange(seen, seen + n))
        held = now if tail is None else {c: np.concatenate([tail[c], x]) for c, x in now.items()}
        pairs, far = _neighbours(held, batch.num_rows, near, bits)
        for new, old in pairs:
            yield made(0, len(new), **_apart_of(held, new, old))
        yield made(1, len(far), **{c: held[c][far] for c in ("tree", "head", "cls")})
        seen += batch.num_rows
        tail = {c: x[-near - 1 :] for c, x in held.items()}
    if tail is not None:
        n = len(tail["tree"])
        yield made(2, n, **tail, part=np.full(n, part), place=np.arange(seen - n, seen))


def _across(ends: pa.Table, near: int, bits: int = SKETCH_BITS) -> tuple[pa.Table, pa.Table]:
    """(pairs, far) of rows in different tasks, as _compared gives those within one, from its rows of kind 2."""
    rows = {c: ends[c].to_numpy() for c in ("part", "place", *_ROW)}
    if len(rows["part"]):
        order = np.lexsort((rows["place"], rows["part"]))
        order = order[np.concatenate([[True], (np.diff(rows["part"][order]) != 0) | (np.diff(rows["place"][order]) != 0)])]
        rows = {c: x[order] for c, x in rows.items()}
        # where rows of a task are left out between its first and its last, near + 1 rows of no tree stand for them
        gaps = np.flatnonzero((np.diff(rows["part"]) == 0) & (np.diff(rows["place"]) > 1)) + 1
        rows = {c: np.insert(x, np.repeat(gaps, near + 1), -1) for c, x in rows.items()}
    pairs, far = _neighbours(rows, len(rows["part"]), near, bits)
    now, old = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in pairs]]) for k in (0, 1))
    real = rows["part"][now] != rows["part"][old]
    real &= rows["tree"][now] >= 0
    far = far[rows["tree"][far] >= 0]
    return pa.table(_apart_of(rows, now[real], old[real])), pa.table({c: rows[c][far] for c in ("tree", "head", "cls")})


def candidates(classes: DataFrame, near: int, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, apart), far (tree, head, cls)) of classes (cls, root, sig): neighbours of different roots in some order,
    and rows with more mates than near on a side. The driver gets 2 * near + 2 rows of each task, for its neighbour tasks."""
    spark = classes.sparkSession
    rows = classes.select("cls", "root", "sig").mapInArrow(_planted, "tree int, head bigint, tail binary, cls bigint, root bigint, s0 bigint, s1 bigint")
    order = ["tree", "head", "tail", "cls"]
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    met = staged(placed.mapInArrow(lambda b: _compared(b, near, bits), ", ".join(f"{c} {t}" for c, t in _MET.items())), "met")
    pairs, far = (spark.createDataFrame(t) for t in _across(met.where("kind = 2").toArrow(), near, bits))
    pairs = met.where("kind = 0").select("a", "b", "apart").unionByName(pairs.select("a", "b", F.col("apart").cast("int").alias("apart")))
    far = met.where("kind = 1").select("tree", "head", "cls").unionByName(far.select(F.col("tree").cast("int").alias("tree"), "head", "cls"))
    out = staged(pairs.groupBy("a", "b").agg(F.min("apart").alias("apart")), "pairs"), staged(far.distinct(), "far")
    discard(met)
    return out


def similar(a: set, b: set, share: int = SHARE) -> bool:
    both = len(a & b)
    return 100 * both >= share * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingles are similar; texts has cls and data."""
    # dealt by number, which is not merged: a pair is little to move and much to compare
    dealt = pairs.select("a", "b").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    rows = dealt.join(texts.select(F.col("cls").alias("a"), F.col("data").alias("left")), "a").join(texts.select(F.col("cls").alias("b"), F.col("data").alias("right")), "b").select("a", "b", "left", "right")
    kept: dict[bytes, set] = {}
    held = 0

    def of(data: bytes) -> set:
        nonlocal held
        if data not in kept:
            if held > CACHED:
                kept.clear()
                held = 0
            kept[data] = some = shingles(data)
            held += len(some)
        return kept[data]

    def work(cols: dict[str, list]):
        return {}, [k for k, (x, y) in enumerate(zip(cols["left"], cols["right"], strict=True)) if similar(of(x), of(y))]

    return map_slices(rows, work, {}, 2)


def ends(pairs: DataFrame) -> DataFrame:
    """(cls): the classes of pairs (a, b), each as often as it is in one. The columns are read apart, so no row is doubled."""
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))


def _texts(docs: DataFrame, key: str, classes: DataFrame, involved: DataFrame) -> DataFrame:
    """(cls, data): one text of each class in involved (cls), which may repeat."""
    wanted = classes.join(involved.distinct(), "cls").select("cls", F.col("rep.id").alias("i"), F.col("rep.mark").alias("m"))
    rows = Narrow(docs, [], id=(key, lambda c: c), data=("text", text_bytes)).df.withColumn("mark", F.xxhash64("data"))
    met = rows.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).select("cls", "data")
    return staged(met.dropDuplicates(["cls"]), "texts")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs whose ends have no common root in roots (v, root) yet."""
    for side in ("a", "b"):
        of = roots.select(F.col("v").alias(side), F.col("root").alias(f"r_{side}"))
        pairs = pairs.join(of, side, "left").withColumn(f"r_{side}", F.coalesce(f"r_{side}", side))
    return pairs.where("r_a <> r_b").drop("r_a", "r_b")


def _hubs(far: DataFrame, links: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in dense regions with the member of the region that has most links, where they are unconnected."""
    degree = ends(links).groupBy("cls").agg(F.count("*").alias("links"))
    rooted = staged(far.join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "rooted")
    ranked = rooted.join(degree, "cls").groupBy("tree", "head").agg(F.max(F.struct("links", "cls", "root")).alias("hub")).select(F.col("tree").alias("t"), F.col("head").alias("h"), "hub.cls", "hub.root").toDF("t", "h", "hub", "of")
    # written first: joined in the stage that finds them, a region's rows would all be one task's, with no way to split them
    ranked = staged(ranked, "best")
    # one row for each set outside its region's largest component
    met = rooted.join(ranked, (F.col("tree") == F.col("t")) & (F.col("head") == F.col("h")) & (F.col("root") != F.col("of")))
    met = staged(met.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct(), "hubs")
    discard(rooted, ranked)
    sig = classes.select("cls", "sig")
    both = met.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("cls").alias("b"), F.col("sig").alias("y")), "b")

    def work(cols: dict[str, list]):
        x, y = (sketch(np.frombuffer(b"".join(cols[c]), "<u2").reshape(-1, VALUES)) for c in ("x", "y"))
        return {}, np.flatnonzero(differing(x, y).sum(axis=1) <= SKETCH_BITS).tolist()

    return map_slices(both.select("a", "b", "x", "y"), work, {}, 2)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (v, root) after further links (a, b); only the components that these join are gone through."""
    ends = links.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(roots.select(F.col("v").alias(side), F.col("root").alias(f"r_{side}")), side, "left").withColumn(f"r_{side}", F.coalesce(f"r_{side}", side))
    joined = components(ends.select(F.col("r_a").alias("a"), F.col("r_b").alias("b")))
    moved = roots.join(joined.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return staged(moved.unionByName(joined), "roots")


def unmet(seen: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different roots in roots (v, root), with all similar ones among them.

    A pair meets by each number that both fronts have. At their first common one both sets still hold all that they have in
    common, which bounds it from above; similar pairs pass there. What they do not have in common is bounded from below by
    the bits in which their bitmaps differ. In each place only rows outside its largest component are paired with the others.
    """
    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).select(F.col("root").alias("r"), "size")
    named = classes.join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(sizes, F.col("root") == F.col("r"), "left").select("cls", "root", F.coalesce("size", F.lit(0)).alias("size"), F.col("rep.id").alias("i"), F.col("rep.mark").alias("m"))
    fronts = seen.where("n > 0").select("id", "mark", "n", "front").join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
    rows = fronts.select("cls", "root", "size", F.col("n").cast("int").alias("n"), F.posexplode("front").alias("place", "number"))
    at = Window.partitionBy("number")
    main = F.max(F.struct("size", "root")).over(at)["root"]
    mixed = rows.withColumns({"lo": F.min("root").over(at), "hi": F.max("root").over(at), "main": main}).where("lo <> hi")
    mixed = staged(mixed.select("number", "cls", "root", (F.col("root") == F.col("main")).alias("in_main"), "n", (F.col("n") - F.col("place")).alias("rest")), "mixed")
    left, right = (mixed.toDF(*[f"{side}_{c}" for c in mixed.columns]) for side in "xy")
    common = F.least("x_rest", "y_rest").cast("bigint") * (100 + SHARE) >= F.lit(SHARE) * (F.col("x_n") + F.col("y_n"))
    once = F.col("y_in_main") | (F.col("x_cls") < F.col("y_cls"))
    met = left.where("not x_in_main").join(right, (F.col("x_number") == F.col("y_number")) & (F.col("x_root") != F.col("y_root")) & once & common)
    met = staged(met.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct(), "unmet")
    of = classes.select("cls", "n", "bits")
    both = met.join(of.toDF("a", "n_a", "x"), "a").join(of.toDF("b", "n_b", "y"), "b")

    def work(cols: dict[str, list]):
        apart = np.array([parted(x, y) for x, y in zip(cols["x"], cols["y"], strict=True)], np.int64)
        return {}, np.flatnonzero(apart * (100 + SHARE) <= (100 - SHARE) * (np.array(cols["n_a"]) + np.array(cols["n_b"]))).tolist()

    out = staged(map_slices(both.select("a", "b", "n_a", "n_b", "x", "y"), work, {}, 2), "pairs")
    discard(mixed, met)
    return out


def linked(docs: DataFrame, key: str, seen: DataFrame, classes: DataFrame, near: int = NEAR, wide: int = WIDE) -> DataFrame:
    """(v, root) of the classes (cls, n, sig, bits, rep; none of empty sets), made of seen, that are linked with others."""
    pairs, far = candidates(classes.withColumn("root", F.col("cls")), near)
    texts = _texts(docs, key, classes, ends(pairs).union(far.select("cls")))
    ranked = staged(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))), "ranked")
    links = staged(confirmed(ranked.where(F.col("rank") <= FIRST), texts), "links")
    roots = components(links)

    def follow(more: DataFrame, texts: DataFrame = texts) -> bool:
        """Take the links among more, pairs of sets that are not connected yet; whether there are any."""
        nonlocal links, roots
        tried = staged(more.select("a", "b").distinct(), "tried")
        found = staged(confirmed(tried, texts), "links")
        discard(tried)
        if found.isEmpty():
            return False
        links, roots = links.unionByName(found), _merged(roots, found)
        return True

    more = _apart(ranked.where(F.col("rank") > FIRST).select("a", "b"), roots)
    if far.isEmpty():
        follow(more)
    else:
        follow(more.unionByName(_hubs(far, links, roots, classes)))
        dense = classes.join(far.select("cls").distinct(), "cls").join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        if follow(candidates(dense, wide, WIDE_BITS)[0]):
            while follow(_hubs(far, links, roots, classes)):
                pass
    discard(pairs, far, texts, ranked)
    rest = unmet(seen, classes, roots)
    if not rest.isEmpty():
        follow(rest, _texts(docs, key, classes, ends(rest)))
    return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", near: int = NEAR, wide: int = WIDE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Texts with equal sets of shingles, known by a digest of 128 bits of the shingles' 64-bit hashes, are one class; classes
    are linked whose sets have SHARE hundredths or more in common, compared shingle by shingle. component_id: the smallest
    doc_id that can be reached. Null, empty and wordless texts have an empty set and are linked with nothing. Rows with a
    null doc_id keep it, never name a component and are not kept; a doc_id that repeats with other texts is another
    document each time. Repeated rows give repeated rows; an empty table an empty one. Other columns are not looked at.

    Most links are found among neighbours in the orders. What more than NEAR or WIDE others, or chance, keep apart there is
    found by the fronts, so near and wide, and the sample that the order of shingles comes from, change the time alone.
    """
    seen = staged(signed(docs, key), "signed")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("rep")
    grouped = seen.where("n > 0").groupBy("digest").agg(F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("bits").alias("bits"), F.min("id").alias("first"), rep)
    classes = staged(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    roots = linked(docs, key, seen, classes, near, wide)
    of = roots.select(F.col("v").alias("cls"), "root").unionByName(roots.select(F.col("root").alias("cls"), "root").distinct())
    named = classes.select("cls", "digest", "first").join(of, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = staged(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select(F.col("digest").alias("d"), "component_id")
    out = seen.join(named, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
