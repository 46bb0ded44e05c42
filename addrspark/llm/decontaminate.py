"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over every document window.

A text is its folded words, joined by one blank. Windows of words are pieces of these bytes, and all of a text are hashed
at once from sums over its bytes. The benchmark is broadcast as plain arrays: the bytes of its items and, for each of their
windows, hash, place and item, 24 bytes a window beside the text. A window whose hash is among them is compared byte by
byte before it counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Narrow, discard, map_slices, position, shared_path, staged, table, text_bytes, text_of

WINDOW = 10
#: Bytes that one broadcast block of the benchmark may take, all its arrays counted; a larger benchmark comes in several.
BLOCK_BYTES = 64 << 20
#: Blocks that one pass over the documents holds.
MAX_BLOCKS = 4
#: Bits of the table that tells most windows apart from all of the benchmark's.
SIEVE_BITS = 24
SIEVE_BYTES = 1 << SIEVE_BITS - 3
#: A-Z lower-cased; every other ASCII byte but digits and a-z separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64; kept per process."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_BASE, _INVERSE))
    return _powers


class Folded:
    """The folded words of a text: their bytes joined by blanks, and where each starts and stops."""

    def __init__(self, words: list[bytes]):
        self.bytes = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.stops = np.cumsum(lengths + 1) - 1
        self.starts = self.stops - lengths
        up, _ = powers(len(self.bytes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.frombuffer(self.bytes, np.uint8) * up[: len(self.bytes)], dtype=np.uint64)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, stops) of every n consecutive words."""
        starts, stops = self.starts[: len(self.starts) - n + 1], self.stops[n - 1 :]
        h = (self.sums[stops] - self.sums[starts]) * powers(len(self.bytes) + 1)[1][starts]
        return h ^ (h >> np.uint64(32)), starts, stops


class Grams:
    """The distinct windows of a block of items, by length: arrays sorted by hash, and the items' bytes behind them.

    A window is kept once, with the number of the set of items that it occurs in; sets that are equal are kept once too.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        """items: name and folded words, joined by blanks."""
        self.names = [name for name, _ in items]
        self.bytes = b"".join(text for _, text in items)
        parts: dict[int, list[tuple]] = {}
        at = 0
        for k, (_, text) in enumerate(items):
            folded = Folded(text.split())
            n = min(window, len(folded.starts))
            if n:
                h, starts, stops = folded.windows(n)
                parts.setdefault(n, []).append((h, starts + at, (stops - starts).astype(np.int32), np.full(len(h), k, np.int32)))
            at += len(text)
        self.tables = {}
        sets: dict[bytes, int] = {}
        for n, some in sorted(parts.items()):
            h, starts, sizes, owners = (np.concatenate(x) for x in zip(*some, strict=True))
            kept, numbers = self._distinct(h, starts, sizes, owners, sets)
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[h[kept] & np.uint64((1 << SIEVE_BITS) - 1)] = True
            self.tables[n] = h[kept], starts[kept], sizes[kept], numbers, np.packbits(sieve)
        self.owners = [np.frombuffer(o, np.int32) for o in sets]

    def _distinct(self, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, sets: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Of windows that are equal the first, by hash, and for each the number in sets of the items that it occurs in."""
        order = np.lexsort((owners, h))
        runs = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        sizes_of = np.diff(np.append(runs, len(order)))
        alone = order[runs[sizes_of == 1]]
        single = np.unique(owners[alone])
        number = np.fromiter((sets.setdefault(k.tobytes(), len(sets)) for k in single), np.int32, len(single))
        kept, numbers = [], []
        for a, n in zip(runs[sizes_of > 1].tolist(), sizes_of[sizes_of > 1].tolist(), strict=True):
            by: dict[bytes, list[int]] = {}
            for k in order[a : a + n].tolist():
                by.setdefault(self.bytes[starts[k] : starts[k] + sizes[k]], []).append(k)
            for some in by.values():
                kept.append(some[0])
                numbers.append(sets.setdefault(np.unique(owners[some]).tobytes(), len(sets)))
        kept = np.concatenate([alone, np.array(kept, np.int64)])
        numbers = np.concatenate([number[np.searchsorted(single, owners[alone])], np.array(numbers, np.int32)])
        again = np.argsort(h[kept], kind="stable")
        return kept[again], numbers[again]

    def __getstate__(self):
        return self.names, self.bytes, self.tables, self.owners

    def __setstate__(self, state):
        self.names, self.bytes, self.tables, self.owners = state

    def size(self) -> int:
        """Bytes held."""
        return len(self.bytes) + sum(a.nbytes for t in self.tables.values() for a in t) + sum(len(n) + 60 for n in self.names) + sum(o.nbytes + 100 for o in self.owners)

    def scan(self, text: Folded) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence, and the names of the items that occur."""
        edges, found = np.zeros(len(text.starts) + 1, np.int64), set()
        for n, (hashes, starts, sizes, numbers, sieve) in self.tables.items():
            if len(text.starts) < n:
                continue
            h, first, last = text.windows(n)
            low = (h & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)
            at = np.flatnonzero(sieve[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
            if not len(at):
                continue
            place = np.searchsorted(hashes, h[at])
            same = place < len(hashes)
            same[same] = hashes[place[same]] == h[at[same]]
            hits = []
            for s, p in zip(at[same].tolist(), place[same].tolist(), strict=True):
                piece = text.bytes[first[s] : last[s]]
                while p < len(hashes) and hashes[p] == h[s]:  # more than one only if different windows have one hash
                    if self.bytes[starts[p] : starts[p] + sizes[p]] == piece:
                        hits.append(s)
                        found.add(int(numbers[p]))
                        break
                    p += 1
            np.add.at(edges, hits, 1)
            np.subtract.at(edges, np.array(hits, np.int64) + n, 1)
        return np.cumsum(edges[:-1]) > 0, {self.names[k] for number in found for k in self.owners[number]}


def _folded_items(benchmark: DataFrame) -> DataFrame:
    """(name, data, n): the benchmark's items with their n folded words, joined by blanks; wordless ones are left out."""
    rows = Narrow(benchmark, [], name=("item_id", text_of), text=("text", text_bytes)).df

    def fold(cols: dict[str, list]):
        words = [words_of(x) for x in cols["text"]]
        return {"data": [b" ".join(w) for w in words], "n": [len(w) for w in words]}, None

    return map_slices(rows, fold, {"data": "binary", "n": "bigint"}, 1).where("n > 0").distinct()


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Grams]:
    """The items in blocks of at most block_bytes, arrays and all, or of one item; the driver holds one at a time.

    Spark folds the items and deals them by a hash into folders, as many as their bytes and windows ask for, of which each
    is read once. What a block really takes is seen before it is given away: one that is too large is halved.
    """
    items = staged(_folded_items(benchmark), "items")
    need = items.agg(F.sum(F.octet_length("data") + 24 * F.col("n") + F.octet_length("name") + 60)).first()[0] or 0
    n = -(-need // max(1, block_bytes // 2))
    path = shared_path(items.sparkSession, "blocks")
    items.withColumn("block", F.pmod(F.xxhash64("name", "data"), F.lit(max(1, n)))).repartition("block").write.partitionBy("block").parquet(path)
    dealt = items.sparkSession.read.schema("name string, data binary, block bigint").parquet(path)
    for k in range(n):
        rows = dealt.where(F.col("block") == k).select("name", "data").toArrow()
        waiting = [sorted(zip(rows["name"].to_pylist(), rows["data"].to_pylist(), strict=True))]
        while waiting:
            held = waiting.pop()
            block = Grams(held, window)
            if block.size() > block_bytes + SIEVE_BYTES * len(block.tables) and len(held) > 1:
                waiting += [held[: len(held) // 2], held[len(held) // 2 :]]
            elif held:
                yield block


def _groups(blocks, size: int):
    """(blocks, whether more follow) in groups of up to size; always one, if empty."""
    held: list = []
    for block in blocks:
        if len(held) == size:
            yield held, True
            held = []
        held.append(block)
    yield held, False


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], *, window: int = WINDOW, mode: str = "flag", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find benchmark windows in every whole text.

    mode "flag": the keep columns with n_words, n_hit, n_items, items_sha256, contaminated.
    mode "documents": the input rows, unchanged, without contaminated ones.
    mode "spans": the input rows; hit words, with the separators between adjacent ones, are cut from text.

    Null texts have no words and stay as they are. A null item_id counts as the empty string; items of equal id count
    once. The benchmark is broadcast in blocks of block_bytes at most (or one item), all their arrays but a sieve of fixed
    size counted, and a task holds MAX_BLOCKS of them; a larger benchmark takes several passes, over a table of the rows
    that is written once: each pass writes its hits alone. A window that repeats in a text or in items is compared once for
    each place in the text. Repeated rows give repeated rows; empty tables give empty or unflagged results; a result column
    replaces a kept column of its name.
    """
    made = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"} if mode == "flag" else {}
    given = Narrow(docs, keep if mode == "flag" else docs.columns, made, data=("text", text_bytes))
    rows, n_kept = given.df, len(given.kept)
    changed = position(docs, "text") if mode == "spans" else None
    if changed is not None:  # the text is made anew, behind the others
        rows = rows.select(*[c for k, c in enumerate(given.kept) if k != changed], F.col(given.kept[changed]).isNull().alias("none"), "data")
        n_kept -= 1
    passes = []
    for group, more in _groups(_blocks(benchmark, window, block_bytes), MAX_BLOCKS):
        blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in group]
        if more and not passes:
            rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        if more:
            passes.append(staged(map_slices(rows.select("row", "data"), _pass(blocks, {}, "hits"), {"hit": "binary", "names": "array<string>"}, 1), "hits"))
    if passes:
        hits = passes[0]
        for some in passes[1:]:
            hits = hits.unionByName(some)
        # one row for each pass at most
        hits = staged(hits.groupBy(F.col("row").alias("at")).agg(F.collect_list("hit").alias("hit"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")), "hits")
        rows = rows.join(hits, F.col("row") == F.col("at"), "left").drop("row", "at")
        discard(*passes)
    out = map_slices(rows, _pass(blocks, made, mode), {"text": "string"} if mode == "spans" else made, n_kept)
    if changed is not None:
        order = [c for k, c in enumerate(given.kept) if k != changed]
        out = out.select(*order[:changed], "text", *order[changed:])
    return given.named(out, *made)


def _pass(blocks, made: dict[str, str], mode: str):
    """The work of one pass: the hits of these blocks, with those of earlier ones, and what the mode makes of them.

    Mode "hits" is that of a pass that others follow: the rows with hits, and these.
    """

    def work(cols: dict[str, list]):
        out: dict[str, list] = {c: [] for c in [*made, *["text"] * (mode == "spans"), *["hit", "names"] * (mode == "hits")]}
        rows = []
        for k, data in enumerate(cols["data"]):
            text = Folded(words_of(data))
            hit, names = np.zeros(len(text.starts), bool), set()
            for bits in (cols["hit"][k] or ()) if "hit" in cols else ():
                hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(hit)).astype(bool)
            names.update((cols["names"][k] or ()) if "names" in cols else ())
            for block in blocks:
                new, found = block.value.scan(text)
                hit |= new
                names |= found
            n = int(hit.sum())
            if mode == "documents":
                rows += [k] * (n == 0)
            elif mode == "spans":
                out["text"].append(None if cols["none"][k] else cut(data, hit) if n else data.decode())
            elif mode == "hits":
                if n:
                    rows.append(k)
                    out["hit"].append(np.packbits(hit).tobytes())
                    out["names"].append(sorted(names))
            else:
                for c, v in zip(made, (len(hit), n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0), strict=True):
                    out[c].append(v)
        return out, rows if mode in ("documents", "hits") else None

    return work


def cut(data: bytes, hit: np.ndarray) -> str:
    """data without the hit words, and without what stands between two adjacent ones."""
    spans = [m.span() for m in WORD.finditer(data)]
    out, at, k = [], 0, 0
    while k < len(spans):
        if hit[k]:
            start = spans[k][0]
            while k + 1 < len(spans) and hit[k + 1]:
                k += 1
            out.append(data[at:start])
            at = spans[k][1]
        k += 1
    return b"".join([*out, data[at:]]).decode()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.k, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hits AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT k, coalesce(CAST(item_id AS VARCHAR), '') AS x FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.k = d.k LEFT JOIN items ON items.k = d.k
"""
