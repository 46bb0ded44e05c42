"""Quality rules as a ledger: every rule once, one bit each, with its measurements; policies are masks over the bits.

All of it is DataFrame expressions. Windows of three words are found twice or more in a text as follows: each window's
hash, cut short, is packed with its place into one number; the numbers are sorted; windows whose short hash has a
neighbour are candidates, and only these are sorted again by their full hash. Nothing is exploded or shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Narrow, position, staged, table, text_of

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
PLACE_BITS = 31
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"]


def measured(rows: DataFrame, words: bool = False) -> DataFrame:
    """rows (text, not null, among others of the operator's own naming) with the measurements of each whole text, and its words."""
    kept = rows.columns
    df = rows.withColumn("words", F.array_remove(F.split("text", f"{BLANK}+"), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        *kept,
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.regexp_count("text", F.lit("!")).cast("bigint").alias("n_marks"),
    )
    w = F.col("words")
    hashed = F.xxhash64
    packed = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: hashed(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(-(1 << PLACE_BITS)).cast("bigint")).bitwiseOR(i.cast("bigint")),
    )
    df = df.withColumn("packed", F.sort_array(packed))
    p, short = F.col("packed"), lambda x: F.shiftright(x, PLACE_BITS)
    near = lambda x, i: short(x).eqNullSafe(short(F.get(p, i + 1))) | short(x).eqNullSafe(short(F.get(p, i - 1)))
    df = df.withColumn("likely", F.filter(p, near))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("bigint")).cast("int")
    full = F.transform("likely", lambda x: F.struct(hashed(F.get(w, place(x)), F.get(w, place(x) + 1), F.get(w, place(x) + 2)).alias("h"), place(x).alias("i")))
    df = df.withColumn("full", F.sort_array(full))
    f = F.col("full")
    twice = F.filter(f, lambda x, i: x["h"].eqNullSafe(F.get(f, i + 1)["h"]) | x["h"].eqNullSafe(F.get(f, i - 1)["h"]))
    df = df.withColumn("again", F.sort_array(F.transform(twice, lambda x: x["i"])))
    r = F.col("again")
    steps = F.transform(r, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x))
    # as a generator's output, so that a later filter is not pushed below and made to evaluate all this once more
    made = F.explode(F.array(F.struct(*[F.col(c) for c in MEASURES]))).alias("made")
    kept = [*kept, *["words"] * words]
    return df.select(*kept, made).select(*kept, "made.*")


#: Name of each bit's rule. A rule keeps its bit for good; new ones are appended.
RULES = ["too_short", "repeats", "symbols", "duplicate_lines", "shouting", "short_words", "long_words", "repeats_some"]


def rules() -> list[tuple[str, Column]]:
    """(name, whether the row fails) by bit."""
    c = F.col
    failed = [
        c("n_words") < 50,
        100 * c("n_repeat_words") > 50 * c("n_words"),
        4 * c("n_symbols") > c("n_words"),
        2 * c("n_dup_lines") > c("n_lines"),
        2 * c("n_marks") > c("n_words"),
        c("word_chars") < 2 * c("n_words"),
        c("word_chars") > 15 * c("n_words"),
        100 * c("n_repeat_words") > 30 * c("n_words"),
    ]
    return [*zip(RULES, failed, strict=True)]


BASE_MASK = 0b11
#: The bits that each version of the policy enforces.
POLICIES = {"v1": 0b00000011, "v2": 0b01111111, "v3": 0b11111111}
CURRENT = "v2"


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The keep columns of every row (None: all) with the measurements and fail_mask, a bigint with the bit of every rule that the row fails.

    A null text counts as empty: all measurements are 0, and the rules on few words fail. Repeated rows give repeated rows;
    an empty table gives an empty one; a result column replaces a kept column of its name. Written as a table, the ledger
    serves every policy and ablation without another look at the texts.
    """
    given = Narrow(docs, docs.columns if keep is None else keep, [*MEASURES, "fail_mask"], text=("text", text_of))
    bits = [F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, (_, failed) in enumerate(rules())]
    rows = measured(given.df).withColumn("fail_mask", reduce(lambda a, b: a.bitwiseOR(b), bits))
    return given.named(rows.select(*given.kept, *MEASURES, "fail_mask"), *MEASURES, "fail_mask")


def kept(policy: str = CURRENT) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """For each policy and each rule that it enforces: rows, kept, fails (of the rule), only (rows dropped for nothing else).

    Reads the ledger's masks alone; its rows are first counted by mask, so at most 2^rules of them are looked at.
    """
    pairs = [(v, mask, name, 1 << k) for v, mask in policies.items() for k, (name, _) in enumerate(rules()) if mask >> k & 1]
    options = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).cast("bigint").alias("mask"), F.lit(n).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for v, m, n, b in pairs]))
    one = rows.groupBy("fail_mask").agg(F.count("*").alias("n")).select("fail_mask", "n", options.alias("o")).select("fail_mask", "n", "o.*")
    enforced = F.col("fail_mask").bitwiseAND(F.col("mask"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return one.groupBy("policy", "rule").agg(
        F.sum("n").alias("rows"),
        total(enforced == 0).alias("kept"),
        total(F.col("fail_mask").bitwiseAND(F.col("bit")) != 0).alias("fails"),
        total(enforced == F.col("bit")).alias("only"),
    )


def verdicts(rows: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """For each version of the policy and each mask of the ledger: policy, fail_mask, rows, kept. Reads the masks alone."""
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).cast("bigint").alias("mask")) for v, m in policies.items()]))
    counted = rows.groupBy("fail_mask").agg(F.count("*").alias("rows")).select("fail_mask", "rows", versions.alias("v"))
    return counted.select("v.policy", "fail_mask", "rows", (F.col("fail_mask").bitwiseAND(F.col("v.mask")) == 0).alias("kept"))


def drop_failing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs, with its columns as they are, that the policy keeps."""
    packed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    packed = packed.select(F.struct(*packed.columns).alias("row"), F.col(f"c{position(docs, 'text')}").alias("text"))
    return ledger(packed, ["row"]).where(kept(policy)).select("row.*").toDF(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_mask").bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"), kept().alias("kept"), "fail_mask")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version drops, out of one ledger that is written once."""
    return ablations(staged(ledger(table(spark, sf_dir, "documents"), ["doc_id"]), "ledger"))


_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_marks
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
                + (CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
                + (CASE WHEN 2 * n_marks > n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
                + (CASE WHEN word_chars > 15 * n_words THEN 64 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 128 ELSE 0 END)
                AS BIGINT) AS fail_mask FROM m)
"""
OP5_SQL = (
    _LEDGER
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask % 4 <> 0 AS base_failed,
       fail_mask % 128 = 0 AS kept, fail_mask FROM f
"""
)
ABLATIONS_SQL = (
    _LEDGER
    + f""", p AS (SELECT * FROM (VALUES {", ".join(f"('{v}', {m})" for v, m in POLICIES.items())}) t(policy, mask)),
b AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {1 << k})" for k, n in enumerate(RULES))}) t(rule, bit))
SELECT policy, rule, count(*) AS rows, count(*) FILTER ((fail_mask & mask) = 0) AS kept, count(*) FILTER ((fail_mask & bit) > 0) AS fails,
       count(*) FILTER ((fail_mask & mask) = bit) AS only FROM f, p, b WHERE (mask & bit) > 0 GROUP BY policy, rule
"""
)
