"""Byte-level BPE, decontamination and SimHash against plain versions."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from addrspark.llm import bpe, decontaminate, simhash

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEXTS = [None, "", " ", "\n\n", "Hello  world's\n\n 12 34", "é" * 50, "x" * 3000, "ab c. " * 30000, "  lead\ttab", "𠮷 漢字 ok"]


def docs(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "s", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens string")


def each_match(enc, text):
    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in enc._encode_single_piece(m)]


def test_pieces_change_no_ids():
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    for words in (["ab", " ", "  ", "\n", "\n\n", "é", "1", "'s", "!", ".", "\t", "漢"], [" ", "\n", "\t", "\u3000"], ["漢", "字", "。", "1"], ["x"]):
        for _ in range(40):
            text = "".join(rng.choice(words) for _ in range(300))
            assert codec.encode(text, 20) == each_match(codec.enc, text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_200_000 + "a", "x" * 1_000_000, "漢字。" * 400_000, " \n" * 600_000 + "b", "a b " * 50_000 + " " * 900_000 + "cd " * 50_000, "1" * 1_000_000])
def test_very_long_runs(text):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert ids == each_match(codec.enc, text) and codec.enc.decode_bytes(ids) == text.encode()


def test_bpe_each_match_and_round_trip(spark):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    texts = [*TEXTS, "\u2003" * 1_000_000]
    got = {r["doc_id"]: r for r in bpe.bpe_encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN, ["doc_id", "n_tokens"], ids=True).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        ids = each_match(codec.enc, t)
        assert got[k]["token_ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.bpe_decode(spark.createDataFrame([(1, got[9]["token_ids"]), (2, None), (3, [])], "id int, token_ids array<int>"), RANKS, public_tokenizers.PATTERN)
    assert {r["id"]: r["data"] and bytes(r["data"]) for r in back.collect()} == {1: TEXTS[9].encode(), 2: None, 3: b""}
    assert bpe.bpe_encode(docs(spark, TEXTS).limit(0), RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def plain_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    mine, hit, names = words(text), set(), set()
    for name, t in items:
        w = words(t)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            for s in range(len(mine) - n + 1):
                if mine[s : s + n] == w[at : at + n]:
                    hit |= {*range(s, s + n)}
                    names.add(str(name))
    return len(mine), len(hit), sorted(names)


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_decontamination(spark, block):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B1", "ç", "dé", "e"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 12, 15, 10, 1, 30, 9])] + [(20, "zz"), (21, None), (22, "--"), (None, "qq"), (3, "ww vv")]
    texts = [None, "", "ZZ", "qq", "ww, vv.", *[" ".join(word() for _ in range(40)) for _ in range(8)], "x " + items[1][1].upper().replace("Ç", "ç").replace("É", "é") + " y", "n " * 50000 + "zz"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    items = [("" if n is None else n, t) for n, t in items if n is not None or t]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, texts), bench, ["doc_id"], block_bytes=block).collect()}
    for k, t in enumerate(texts[:-1]):
        n, h, names = plain_hits(t, items)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, h, len(names), h > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert got[len(texts) - 1]["n_hit"] == 1
    clean = decontaminate.decontaminate(docs(spark, ["k zz! m", "k", None]), spark.createDataFrame([(1, "ZZ")], "item_id int, text string"), [], mode="documents")
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2]
    spans = decontaminate.decontaminate(docs(spark, ["k zz, zz! m", None]), spark.createDataFrame([(1, "ZZ")], "item_id int, text string"), [], mode="spans")
    assert {r["doc_id"]: r["text"] for r in spans.collect()} == {0: "k ! m", 1: None}
    assert decontaminate.decontaminate(docs(spark, texts), bench.limit(0), ["doc_id"]).where("contaminated").count() == 0


def test_a_block_takes_what_it_says():
    rng = random.Random(7)
    words = [("%x" % rng.getrandbits(24)).encode() for _ in range(5000)]
    items = [(str(k), b" ".join(rng.choice(words) for _ in range(100))) for k in range(2000)]
    grams = decontaminate.Grams(items)
    assert grams.size() <= sum(len(t) + 24 * 100 + len(n) + 60 for n, t in items) + (1 << decontaminate.SIEVE_BITS) // 8
    text = decontaminate.Folded(items[7][1].split()[30:60] + [b"zz"] * 5 + items[9][1].split()[:10])
    hit, names = grams.scan(text)
    assert hit.tolist() == [True] * 30 + [False] * 5 + [True] * 10 and names == {"7", "9"}


def test_repeats_take_no_squares():
    same = b" ".join([b"ab"] * 200_000)
    began = time.time()
    grams = decontaminate.Grams([("x", same)])
    hit, names = grams.scan(decontaminate.Folded(same.split()))
    assert hit.all() and names == {"x"} and len(grams.tables[10][0]) == 1
    shared = b" ".join(b"w%d" % k for k in range(10))
    many = decontaminate.Grams([(str(k), shared) for k in range(100_000)])
    hit, names = many.scan(decontaminate.Folded(shared.split() * 50))
    assert hit.all() and len(names) == 100_000 and len(many.owners) == 1
    assert time.time() - began < 30


def test_a_block_beyond_its_bound_is_halved(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(200))) for k in range(40)]
    sizes = [b.size() - sum(t[4].nbytes for t in b.tables.values()) for b in decontaminate._blocks(spark.createDataFrame(items, "item_id bigint, text string"), 10, 30_000)]
    assert max(sizes) <= 30_000 and len(sizes) >= 40 * 200 * 24 // 30_000


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(decontaminate.Folded, "windows", lambda self, n: (np.zeros(len(self.starts) - n + 1, np.uint64), self.starts[: len(self.starts) - n + 1], self.stops[n - 1 :]))
    grams = decontaminate.Grams([("a", b"one two"), ("b", b"two one"), ("c", b"one two")])
    hit, names = grams.scan(decontaminate.Folded([b"x", b"one", b"two", b"two"]))
    assert hit.tolist() == [False, True, True, False] and names == {"a", "c"}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(fps, pairs=None):
    """Of each fingerprint the first in its group, by all near pairs, or by the given ones."""
    root = list(range(len(fps)))

    pairs = pairs and {*pairs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 if pairs is None else {(fps[i], fps[j]), (fps[j], fps[i])} & pairs:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize(("max_list", "key_bytes"), [(64, 3), (2, 4)])
def test_simhash(spark, max_list, key_bytes):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(5)]
    texts = [None, "", " \t", "A b", "a B", "one two three four", *base]
    for _ in range(60):
        w = rng.choice(base).split(" ")
        w[rng.randrange(len(w))] = rng.choice("xyz")
        texts.append(" ".join(w))
    texts.append("Long " * 20000)
    fps = [plain_fingerprint(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs(spark, texts), max_list=max_list, key_bytes=key_bytes).collect()}
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[k]["component_id"] for k in range(len(texts))] == plain_groups(fps)


def test_simhash_links_at_every_distance(spark):
    rng = random.Random(4)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        fps.append(x)
        for d in (1, 2, 3, 4, 5, 6):
            fps.append(x ^ sum(1 << b for b in rng.sample(range(64), d)))
        fps.append(x ^ sum(1 << rng.randrange(8 * p, 8 * p + 8) for p in rng.sample(range(8), 4)))  # a bit in each of four bytes
    fps = [*dict.fromkeys(fps)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if apart(a, b) <= 4}
    assert {(r["a"], r["b"]) for r in simhash.links(frame).collect()} == want
    dense = [(r["a"], r["b"]) for r in simhash.links(frame, 1).collect()]
    assert all(apart(a, b) <= 4 for a, b in dense)
    assert plain_groups(fps, [(fps[signed.index(a)], fps[signed.index(b)]) for a, b in dense]) == plain_groups(fps)


def test_one_row_of_each_component_stays(spark):
    d = spark.createDataFrame([(1, "q w e r t"), (1, "z z z z"), (2, "z z z z"), (2, "q w e r t"), (3, "u"), (3, "u"), (None, "u")], "doc_id bigint, `te.xt` string").toDF("doc_id", "TEXT").selectExpr("doc_id", "TEXT", "1 AS `a.b`", "2 AS __id", "3 AS fp")
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [(1, "q w e r t", 1, 2, 3), (1, "z z z z", 1, 2, 3), (3, "u", 1, 2, 3), (None, "u", 1, 2, 3)]))


def test_simhash_ties_nulls_and_empty(spark):
    d = docs(spark, ["q w e r t", "q w e r t", "q w e r t", None, "z z z z"], ids=[7, 7, None, None, 9])
    got = sorted(simhash.simhash_groups(d).select("doc_id", "component_id").collect(), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None), (9, 9)], key=str)
    assert sorted(map(str, (r["doc_id"] for r in simhash.drop_near_duplicates(d).collect()))) == ["7", "9", "None", "None"]
    assert simhash.simhash_groups(d.limit(0)).count() == 0
    assert simhash.components(spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")).agg(F.max("root")).first()[0] == 0
