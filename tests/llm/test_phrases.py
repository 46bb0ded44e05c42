"""Collocations against counting in dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrspark.llm import phrases

SCHEMA = "lang string, text string, phrase string, n int"


def plain_counts(rows):
    """(lang, words) -> occurrences, and lang -> words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, least, top):
    f, n = plain_counts(rows)
    cand = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    by = {}
    for (lang, w), a in cand.items():
        inside = any(len(x) > len(w) and lg == lang and 100 * b >= 80 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (lg, x), b in cand.items())
        if not inside:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, some in by.items() for r, (s, a, p, left, right) in enumerate(sorted(some)[:top])}


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "A", "b", "c", "é", "𠮷", "new", "york", "\x00", "x\x1fy"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "?!"]
    made = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return [*made, ("en", None), (None, ""), ("en", " .\n"), ("en", "a " * 300), ("fr", "a b c é " * 40), ("fr", "a b c é " * 40)]


@pytest.mark.parametrize(("size", "bounds"), [(1 << 20, phrases.SIEVE_BITS), (50, (32, 32)), (50, (1 << 12, 1 << 12))])
def test_against_plain(spark, monkeypatch, size, bounds):
    monkeypatch.setattr(phrases, "BATCH", 7 if size == 50 else 1 << 17)
    rows = texts(size)
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    got = phrases.collocations(docs, least=5, top=25, size=size, bounds=bounds).collect()
    assert {tuple(r) for r in got} == plain(rows, 5, 25) and len(got) > 40


def test_ranked_in_parts(spark):
    rows = spark.range(500).select(F.lit("en").alias("lang"), F.concat(F.lit("p"), (F.col("id") * 7 % 500).cast("string")).alias("phrase"), (F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("score"))
    one = {(r["phrase"], r["rank"]) for r in phrases.best(rows, 30).collect()}
    assert one == {(r["phrase"], r["rank"]) for r in phrases.best(rows, 30, 20).collect()} and len(one) == 30


def test_bitmaps_shift_over_blocks():
    builder = phrases.Builder()
    words = [b"a", b"b"] * 20
    builder.add(b" ".join(words) + b"\nb a")
    names, counts, bitmaps = builder.row()
    assert names == [b"a", b"b"] and counts.tolist() == [21, 21]
    v = phrases.Vertical("en", names, bitmaps, None)
    word, block, mask = v.by_word
    grown = {(tuple(p), n) for phrase, count in v.grow(np.arange(2)[:, None], word, block, mask, 3, None) for p, n in zip(phrase.tolist(), count.tolist(), strict=True)}
    assert grown == {((0, 1), 20), ((1, 0), 20), ((0, 1, 0), 19), ((1, 0, 1), 19)}


def test_long_texts_go_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 20)
    rows = [("en", "one two three. " * 30 + "an end that never comes and goes on " * 9 + ".x y"), ("en", "q " * 200)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=4, top=500, size=16).collect()
    assert {tuple(r) for r in got} == plain(rows, 4, 500)


def test_empty_and_products_beyond_64_bits(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None, "", 0)], SCHEMA)).collect() == []
    big = 1 << 61
    f = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big), ("en", "a b", big - 1)], "lang string, phrase string, n bigint")
    assert phrases.scored(f).first()["score"] == 2000000 * (big - 1) // (2 * big + 1)


def test_query_on_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()]
    assert {tuple(r) for r in phrases.op13_phrases(spark, "/root/testdata/sf0.001").collect()} == plain(rows, 30, 2000)
