"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document; every fault is one that two or more of them
see. Expectation-maximisation over the counts of all vote patterns estimates how each labeller votes on good and on bad
documents, that is its accuracy on either, and with it the chance that a pattern means good. These posteriors are the
labels of a linear scorer over hashed words and word shapes, fitted to a bounded sample, that then scores every whole
text.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Narrow, staged, table, text_of
from .quality_rules import measured

#: Rows of the training sample by hash of doc_id, and the longest text in it.
TRAIN_ROWS, TRAIN_CHARS = 3000, 20_000
BUCKETS = 1 << 16
ROUNDS, EPOCHS, RATE = 60, 15, 0.5
CACHE_WORDS = 300_000
#: For bad and good rows: the believed chance of a good vote, and how many rows that belief is worth, whatever their number.
BELIEFS = ((0.5, 2.0), (0.95, 2.0))
THRESHOLD = 0.5
_WORD = re.compile(r"\S+")
_SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: ("A" if m[0].isupper() and len(m[0]) > 1 else "a" if m[0].islower() else "Aa")), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"([^\w\s])\1+"), lambda m: m[1] + "+")]


def labellers() -> dict[str, Column]:
    """Name -> vote: 1 good, -1 bad, 0 nothing. At most a dozen, so that all patterns fit the driver."""
    c = F.col

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(c("n_words") >= 50, c("n_words") < 3),
        "symbols": vote(50 * c("n_symbols") <= c("n_words"), 4 * c("n_symbols") > c("n_words")),
        "runs": vote(50 * c("n_runs") <= c("n_words"), 5 * c("n_runs") > c("n_words")),
        "odd": vote(100 * c("n_odd") <= 6 * c("word_chars"), 100 * c("n_odd") > 9 * c("word_chars")),
        "marks": vote(10 * c("n_marks") <= c("n_words"), 2 * c("n_marks") > c("n_words")),
        "capitals": vote(5 * c("n_capitals") <= c("word_chars"), 2 * c("n_capitals") > c("word_chars")),
        "lines": vote((c("n_lines") >= 3) & (10 * c("n_dup_lines") <= c("n_lines")), 2 * c("n_dup_lines") > c("n_lines")),
        "repeats": vote(10 * c("n_repeat_words") <= c("n_words"), 2 * c("n_repeat_words") > c("n_words")),
        "neighbours": vote(20 * c("n_neighbours") <= c("n_words"), 4 * c("n_neighbours") > c("n_words")),
        "kinds": vote(100 * c("n_kinds") >= 45 * c("n_words"), 100 * c("n_kinds") < 35 * c("n_words")),
        "word_length": vote(c("word_chars").between(3 * c("n_words"), 9 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
    }


def voted(rows: DataFrame) -> DataFrame:
    """rows (text, not null, among others of the operator's own naming) with the array votes."""
    w = F.col("words")
    more = {
        "n_odd": F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s]")),
        "n_runs": F.regexp_count("text", F.lit(r"([^\p{L}\p{N}\s])\1")),
        "n_capitals": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "n_kinds": F.size(F.array_distinct("words")),
        "n_neighbours": F.size(F.filter("words", lambda x, i: x.eqNullSafe(F.get(w, i + 1)))),
    }
    return measured(rows, words=True).withColumns(more).select(*rows.columns, F.array(*labellers().values()).alias("votes"))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """(share of good rows, P(good vote | class, any vote) as [labeller, class], pattern -> P(good)) by EM over the counts.

    A labeller's accuracy is the second number on good rows and one less the first on bad ones. Silence says nothing.
    It starts from one bad vote meaning bad. BELIEFS are priors worth two rows each, which only keep chances off 0 and 1.
    """
    if not patterns:
        return 0.5, np.zeros((0, 2)), {}
    votes, n = np.array([*patterns]), np.array([*patterns.values()], float)
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    good = np.where(down.any(axis=1), 0.05, 0.95)
    share, chance = 0.5, np.zeros((votes.shape[1], 2))
    for _ in range(rounds):
        share = (good @ n + 1) / (n.sum() + 2)
        for c, w in enumerate((1 - good, good)):
            believed, weight = BELIEFS[c]
            chance[:, c] = ((n * w) @ up + weight * believed) / ((n * w) @ (up + down) + weight)
        fit = up @ np.log(chance) + down @ np.log1p(-chance) + np.log([1 - share, share])
        good = 1 / (1 + np.exp(np.clip(fit[:, 0] - fit[:, 1], -40, 40)))
    return float(share), chance, dict(zip(patterns, good.tolist(), strict=True))


def shape(word: str) -> str:
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word


def buckets(word: str) -> tuple[int, int]:
    return crc32(word.lower().encode()) % BUCKETS, crc32(b"shape " + shape(word).encode()) % BUCKETS


class Scorer(dict):
    """Word -> weight; the weights of repeats and the bias apart."""

    def __init__(self, weights: np.ndarray, bias: float, again: float):
        super().__init__()
        self.weights, self.bias, self.again = weights, bias, again

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        a, b = buckets(word)
        self[word] = w = float(self.weights[a] + self.weights[b])
        return w

    def score(self, text: str) -> float:
        words = text.split()
        n = max(1, len(words))
        same = sum(map(str.__eq__, words, words[1:]))
        z = self.bias + (sum(map(self.__getitem__, words)) + self.again * same) / n
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[str, float]]) -> Scorer:
    """A logistic scorer of (text, P(good)) rows by stochastic gradient steps with decreasing size."""
    w, bias, again = np.zeros(BUCKETS), 0.0, 0.0
    made = []
    for text, y in rows:
        words = text.split()
        at, n = np.unique([k for x in words for k in buckets(x)], return_counts=True)
        made.append((at.astype(int), n / max(1, len(words)), sum(map(str.__eq__, words, words[1:])) / max(1, len(words)), y))
    g2, b2, a2 = np.full(BUCKETS, 1e-2), 1e-2, 1e-2
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(made)):
            at, x, same, y = made[k]
            d = 1 / (1 + np.exp(-np.clip(bias + w[at] @ x + again * same, -30, 30))) - y
            g = d * x
            g2[at] += g * g
            w[at] -= RATE * g / np.sqrt(g2[at])
            b2, a2 = b2 + d * d, a2 + (d * same) ** 2
            bias -= RATE * d / np.sqrt(b2)
            again -= RATE * d * same / np.sqrt(a2)
    return Scorer(w, float(bias), float(again))


def vote_counts(votes: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each pattern occurs in votes: at most 3 to the number of labellers."""
    return {tuple(r["votes"]): r["n"] for r in votes.groupBy("votes").agg(F.count("*").alias("n")).collect()}


def training_texts(rows: DataFrame) -> DataFrame:
    """(id, text): of TRAIN_ROWS ids in the order of a hash the least text each, if of up to TRAIN_CHARS characters."""
    picked = rows.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    return rows.join(F.broadcast(picked), "id").where(F.length("text") <= TRAIN_CHARS).groupBy("id").agg(F.min("text").alias("text"))


def trained(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, np.ndarray, dict[tuple[int, ...], float], Scorer]:
    """(votes, accuracies, posteriors, scorer) of docs.

    votes: a table of id, a hash of the text, and votes, of every row. accuracies: on bad and on good rows, by labeller.
    """
    rows = Narrow(docs, [], id=(key, lambda c: c), text=("text", text_of)).df
    votes = staged(voted(rows).select("id", F.xxhash64("text").alias("mark"), "votes"), "votes")
    _, chance, good = estimate(vote_counts(votes))
    sample = voted(training_texts(rows)).collect()  # TRAIN_ROWS at most
    scorer = fit([(r["text"], good[tuple(r["votes"])]) for r in sorted(sample, key=lambda r: r["id"])])
    return votes, np.abs(chance - [1, 0]), good, scorer


def classify(docs: DataFrame, keep: list[str], scorer: Scorer | None = None) -> DataFrame:
    """The keep columns of every row with score (0 to 1, higher is better) and kept.

    Vote patterns are counted over all rows. Null texts count as empty; repeated rows count each time and give repeated
    rows, but an id is sampled once; an empty table gives an empty one; a result column replaces a kept column of its name.
    """
    if scorer is None:  # one that has met no word yet is empty, and so false
        scorer = trained(docs)[3]
    shared = docs.sparkSession.sparkContext.broadcast((scorer.weights.astype(np.float32), scorer.bias, scorer.again))
    made = {"score": "double", "kept": "boolean"}
    mine: list[Scorer] = []

    def work(cols: dict[str, list]):
        if not mine:
            mine.append(Scorer(*shared.value))
        got = [mine[0].score(x) for x in cols["text"]]
        return {"score": got, "kept": [s >= THRESHOLD for s in got]}, None

    return Narrow(docs, keep, made, text=("text", text_of)).map(work, made)


def posteriors(votes: DataFrame, good: dict[tuple[int, ...], float]) -> DataFrame:
    """(id, mark, votes, posterior) of every distinct row of votes; there are at most 3 ** labellers posteriors."""
    known = votes.sparkSession.createDataFrame([(list(v), p) for v, p in good.items()], "votes array<int>, posterior double")
    return votes.distinct().join(F.broadcast(known), "votes").select("id", "mark", "votes", "posterior")


def op7_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, kept and the estimate's own posterior with the votes that it stands on."""
    docs = table(spark, sf_dir, "documents")
    votes, _, good, scorer = trained(docs)
    scored = classify(docs.select("doc_id", F.xxhash64(text_of(F.col("text"))).alias("mark"), "text"), ["doc_id", "mark"], scorer)
    by = posteriors(votes, good).select(F.col("id").alias("i"), F.col("mark").alias("m"), "votes", "posterior")
    return scored.join(by, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).select("doc_id", "score", "kept", "posterior", "votes")


def weak_label_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labeller, on_bad, on_good: the estimated accuracies."""
    _, accuracy, _, _ = trained(table(spark, sf_dir, "documents"))
    rows = [(name, *map(float, pair)) for name, pair in zip(labellers(), accuracy, strict=False)]
    return spark.createDataFrame(rows, "labeller string, on_bad double, on_good double")
