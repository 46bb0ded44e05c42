"""Collocations by vertical bitmaps: SPAM over words, shard by shard.

A shard is some documents of one language, written once as compressed bitmaps: for each word the blocks of eight positions
in which it stands, and a mask of its places in each. Pieces are apart by a position that belongs to no word. A phrase's
bitmap, of the places of its last word, is shifted by one position and met with the bitmaps of all words that stand in the
same blocks: AND gives the bitmaps of the phrases one word longer, popcount how often they occur in the shard. So phrases
grow depth-first, a batch of them at a time, and their popcounts are summed over shards.

Counts of words, then popcounts of pairs are first summed by hash alone, and then those of all phrases by their words. What
has been counted prunes what comes next: a sieve, a bitmap of bounded size that says which words, then which pairs, may be
frequent anywhere. It never says no wrongly, and the sums by words are compared with the threshold after it, so results
depend on neither its size nor on hashes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Narrow, discard, staged, table, text_bytes

LEAST, LONGEST, TOP, UNKNOWN = 30, 4, 2000, "und"
#: Positions of a shard, and bytes of a text that are split into words at once.
SHARD, CHUNK = 1 << 20, 1 << 22
#: Entries of bitmaps that are extended at once.
BATCH = 1 << 17
#: Bits of a sieve: sixteen for each phrase in it, within these bounds; the larger is 8 MB.
SIEVE_BITS = 1 << 16, 1 << 26
#: Candidates of a language that meet in one task to be ranked, before the best of each such part meet.
RANKED = 100_000
#: A-Z lower-cased, tabs as blanks, and the marks that end a piece as line feeds.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if 10 <= c <= 13 or c in b".,;:!?" else c for c in range(256))
_SHARD = "lang string, words array<string>, counts array<bigint>, bitmaps binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a pair's hash: fewer to move, and pairs that share one only pass the sieve together.
_PAIR_BITS = np.uint64((1 << 48) - 1)


def _planes(a: np.ndarray) -> bytes:
    """An array of 32-bit numbers, all lowest bytes first; the highest ones are mostly zero."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, n).T).view("<u4").reshape(n).astype(np.int64)


class Builder:
    """Texts of one language on their way to a shard."""

    def __init__(self):
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids[b"\n"]  # the gap between pieces is 0
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, piece: bytes) -> None:
        words = [w for w in piece.replace(b"\n", b" \n ").split(b" ") if w]
        self.parts += [np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        self.n += len(words) + 1

    def row(self) -> tuple[list[bytes], np.ndarray, bytes]:
        """(words, how often each occurs, bitmaps)."""
        at = np.concatenate(self.parts)
        places = np.flatnonzero(at)
        word = at[places] - 1
        order = np.argsort(word, kind="stable")
        word, places = word[order], places[order]
        block, bit = places >> 3, np.uint8(1) << (places & 7).astype(np.uint8)
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])]))
        mask = np.bitwise_or.reduceat(bit, first)
        word, block = word[first], block[first]
        apart = np.diff(block, prepend=0)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        apart[new] = block[new]
        names = [*self.ids][1:]
        sizes = np.bincount(word, minlength=len(names))
        counts = np.bincount(at[at > 0] - 1, minlength=len(names))
        return names, counts, zlib.compress(b"".join([len(block).to_bytes(8, "little"), _planes(sizes), _planes(apart), mask.tobytes()]), 1)


def _shard_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    builders: dict[str, Builder] = {}

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        builder = builders.pop(lang)
        if len(builder.ids) > 1:
            names, counts, bitmaps = builder.row()
            words = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(names, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), words, pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(counts)), pa.array([bitmaps])], names=["lang", "words", "counts", "bitmaps"])

    for batch in batches:
        for k in range(batch.num_rows):
            lang, data = (batch.column(c)[k].as_py() for c in (0, 1))
            data, start = data.translate(FOLD), 0
            while start < len(data):
                stop = len(data)
                if stop - start > CHUNK:  # up to the last end of a piece in the chunk, or the next one behind it
                    stop = data.rfind(b"\n", start, start + CHUNK) + 1 or data.find(b"\n", start + CHUNK) + 1 or stop
                builder = builders.setdefault(lang, Builder())
                builder.add(data[start:stop])
                start = stop
                if builder.n >= size:
                    yield from flush(lang)
            if sum(b.n for b in builders.values()) >= 4 * size:
                for each in [*builders]:
                    yield from flush(each)
    for each in [*builders]:
        yield from flush(each)


def shards(docs: DataFrame, lang: str = "lang", size: int = SHARD) -> DataFrame:
    """The documents as rows of _SHARD, each of about size positions of one language; null languages are UNKNOWN."""
    rows = Narrow(docs, [], lang=(lang, lambda c: F.coalesce(c.cast("string"), F.lit(UNKNOWN))), data=("text", text_bytes)).df
    return rows.mapInArrow(lambda batches: _shard_rows(batches, size), _SHARD)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """The same as xxhash64(lang, word) in Spark."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * _MIX + right) * _MIX
    return (h ^ (h >> np.uint64(29))) & _PAIR_BITS


class Sieve:
    """Which hashes may be those of frequent phrases."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sieve(frequent: DataFrame, bounds: tuple[int, int] = SIEVE_BITS) -> Sieve:
    """Of hashes (h); Spark makes the words of the bitmap, of which the driver gets as many as it has at most."""
    n = min(bounds[1], max(bounds[0], 1 << (16 * frequent.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(n - 1))
    bit = F.expr("shiftleft(1L, int(h & 31))")
    made = frequent.groupBy(F.shiftright(at, 5).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(n // 32, "<u4")
    out[made["slot"].to_numpy()] = made["bits"].to_numpy().astype(np.uint32)
    return Sieve(out.view(np.uint8))


class Vertical:
    """A shard's bitmaps, of the words that the sieve lets through, by block."""

    def __init__(self, lang: str, words: list[bytes], bitmaps: bytes, known: Sieve | None):
        data = zlib.decompress(bitmaps)
        n, v = int.from_bytes(data[:8], "little"), len(words)
        sizes, apart = _numbers(data[8 : 8 + 4 * v], v), _numbers(data[8 + 4 * v : 8 + 4 * (v + n)], n)
        mask = np.frombuffer(data, np.uint8, n, 8 + 4 * (v + n))
        total = np.cumsum(apart)
        ends = np.cumsum(sizes)
        before = np.concatenate([[0], total[ends[:-1] - 1]])
        block = total - np.repeat(before, sizes)
        word = np.repeat(np.arange(v), sizes)
        self.lang, self.h = lang, word_hashes(lang, words)
        may = np.ones(v, bool) if known is None else known.has(self.h)
        keep = np.flatnonzero(may[word])
        #: Entries by word, where phrases begin.
        self.by_word = word[keep], block[keep], mask[keep]
        order = keep[np.argsort(block[keep], kind="stable")]
        self.word, self.mask = word[order], mask[order]
        self.starts = np.searchsorted(block[order], np.arange((int(block.max()) if n else 0) + 3))
        self.v = v

    def step(self, pid: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pid, word) of the phrases one word longer, how often they occur, and their (number, block, mask) entries."""
        wide = mask.astype(np.uint16) << 1
        low, high = (wide & 255).astype(np.uint8), (wide >> 8).astype(np.uint8)
        stay, over = np.flatnonzero(low), np.flatnonzero(high)
        pid, block, mask = np.concatenate([pid[stay], pid[over]]), np.concatenate([block[stay], block[over] + 1]), np.concatenate([low[stay], high[over]])
        first = self.starts[block]
        size = self.starts[block + 1] - first
        of = np.repeat(np.arange(len(block)), size)
        entry = np.arange(len(of)) - np.repeat(np.cumsum(size) - size - first, size)
        both = mask[of] & self.mask[entry]
        met = np.flatnonzero(both)
        of, both = of[met], both[met]
        key = pid[of] * self.v + self.word[entry[met]]
        order = np.argsort(key, kind="stable")
        key, of, both = key[order], of[order], both[order]
        if not len(key):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none, np.zeros(0, np.uint8)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        n = np.add.reduceat(np.bitwise_count(both), starts, dtype=np.int64)
        return key[starts] // self.v, key[starts] % self.v, n, np.cumsum(new) - 1, block[of], both

    def grow(self, phrases: np.ndarray, pid: np.ndarray, block: np.ndarray, mask: np.ndarray, longest: int, pairs: Sieve | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases, how often) of all that phrases (a row of words each) grow to, depth first; a phrase may come in parts."""
        for at in range(0, len(pid), BATCH):
            part = slice(at, at + BATCH)
            parent, word, n, child, where, bits = self.step(pid[part], block[part], mask[part])
            if pairs is not None and len(n):
                may = pairs.has(pair_hashes(self.h[phrases[parent, -1]], self.h[word]))
                number = np.cumsum(may) - 1
                keep = may[child]
                parent, word, n, child, where, bits = parent[may], word[may], n[may], number[child[keep]], where[keep], bits[keep]
            if len(n):
                longer = np.column_stack([phrases[parent], word])
                yield longer, n
                if longer.shape[1] < longest:
                    yield from self.grow(longer, child, where, bits, longest, pairs)


def _pair_rows(batches: Iterator[pa.RecordBatch], words: Sieve) -> Iterator[pa.RecordBatch]:
    """How often the pairs of a shard's words occur, by hash."""
    for each, _ in _verticals(batches, words):
        for pairs, n in each.grow(np.arange(each.v)[:, None], *each.by_word, 2, None):
            yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(each.h[pairs[:, 0]], each.h[pairs[:, 1]]).view(np.int64)), pa.array(n)], names=["h", "n"])


def _phrase_rows(batches: Iterator[pa.RecordBatch], longest: int, words: Sieve, pairs: Sieve) -> Iterator[pa.RecordBatch]:
    """How often the phrases of a shard occur all of whose words and pairs the sieves let through."""
    for each, names in _verticals(batches, words):
        alone = np.arange(each.v)[:, None]
        kept, n = np.unique(each.by_word[0], return_inverse=True)
        single = np.bincount(n, np.bitwise_count(each.by_word[2]), len(kept)).astype(np.int64)
        for phrases, n in chain([(kept[:, None], single)] * bool(len(kept)), each.grow(alone, *each.by_word, longest, pairs)):
            text = pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in phrases.T], " ")
            yield pa.RecordBatch.from_arrays([pa.array([each.lang] * len(n)), text, pa.array(n)], names=["lang", "phrase", "n"])


def _verticals(batches: Iterator[pa.RecordBatch], words: Sieve) -> Iterator[tuple[Vertical, pa.Array]]:
    for batch in batches:
        for k in range(batch.num_rows):
            names = batch.column(1)[k].values
            yield Vertical(batch.column(0)[k].as_py(), names.cast(pa.binary()).to_pylist(), batch.column(2)[k].as_py(), words), names


def counted(rows: DataFrame, least: int, *by: str) -> DataFrame:
    """(by, n) of popcounts summed over shards, where they reach least."""
    return rows.groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_phrases(made: DataFrame, least: int = LEAST, longest: int = LONGEST, bounds: tuple[int, int] = SIEVE_BITS) -> DataFrame:
    """(lang, phrase, n) of all words and phrases of up to longest words, two or more, in the shards made that occur least times."""
    context = made.sparkSession.sparkContext
    each = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select(F.xxhash64("lang", "e.words").alias("h"), F.col("e.counts").alias("n"))
    words = staged(counted(each, least, "h").select("h"), "words")
    narrow = made.select("lang", "words", "bitmaps")
    one = context.broadcast(sieve(words, bounds))
    pairs = staged(counted(narrow.mapInArrow(lambda b: _pair_rows(b, one.value), "h bigint, n bigint"), least, "h").select("h"), "pairs")
    two = context.broadcast(sieve(pairs, bounds))
    out = staged(counted(narrow.mapInArrow(lambda b: _phrase_rows(b, longest, one.value, two.value), "lang string, phrase string, n bigint"), least, "lang", "phrase"), "frequent")
    discard(words, pairs)
    return out


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of two words or more in frequent, by its lowest-scoring cut.

    Both sides of a cut occur as often as the phrase at least, so they are in frequent too.
    """
    given = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    cuts = given.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("words"), F.col("k") + 1, F.size("words")).alias("right"))
    left, right = (frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)) for side, n in (("left", "l"), ("right", "r")))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    cuts = cuts.withColumns({"x": F.lit(2_000_000).cast("decimal(7,0)") * _exact(F.col("a")), "y": _exact(F.col("l")) + _exact(F.col("r"))}).withColumn("score", F.expr("x div y"))
    return cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def swallowed(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, within): how often the most frequent longer phrase occurs in which a phrase of two words or more lies."""
    words = F.col("words")
    given = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda at: _joined(words, at, k))))
    return given.select("lang", "n", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("within"))


def best(rows: DataFrame, top: int = TOP, ranked: int = RANKED) -> DataFrame:
    """The first top rows of each language by score, count and phrase, with their rank.

    A language's rows are ranked in parts of some ranked rows first; only the first top of each part meet.
    """
    parts = max(1, -(-rows.count() // ranked))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = SHARD, bounds: tuple[int, int] = SIEVE_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to longest words of each language of docs.

    Null texts are empty, and texts without a word add nothing; a null lang is UNKNOWN, as is that very name; repeated
    rows count each time; ties fall to the more frequent phrase, then to the first by bytes. Texts of any length are taken
    whole, a piece of them at a time, and only a piece without an end makes a shard larger. An empty table gives no rows.
    Columns other than lang and text are not looked at.
    """
    made = staged(shards(docs, size=size), "shards")
    frequent = frequent_phrases(made, least, longest, bounds)
    lost = F.lit(100).cast("decimal(3,0)") * _exact(F.col("within")) >= F.lit(80).cast("decimal(3,0)") * _exact(F.col("a"))
    kept = staged(scored(frequent).join(swallowed(frequent), ["lang", "phrase"], "left").where(F.col("within").isNull() | ~lost).drop("within"), "kept")
    n = made.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n"))
    n = staged(n, "totals")
    discard(made, frequent)
    return best(kept, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i+{k - 1}], ' '))) AS phrase FROM pieces WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))
OP13_SQL = rf"""
WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS n FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, a, j, l.n AS l, r.n AS r, CAST((2000000::HUGEINT * a) // (l.n + r.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[j+1:], ' ')),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))))) AS phrase FROM c WHERE k > 2) GROUP BY ALL),
ranked AS (SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
