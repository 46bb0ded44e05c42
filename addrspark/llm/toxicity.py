"""Toxic spans by a linear-chain conditional random field.

Documents carry one label each, so token labels are induced first: words and word beginnings that occur in documents
labelled toxic and next to never in others are anchors, and the tokens of toxic documents that hold one are labelled 1.
A chain of two states over each sentence is fitted to them: emissions from the word, its beginnings and endings and its
two neighbours, plus transitions, by the exact gradient of the likelihood (forward-backward marginals). A document's
score is a logistic function, fitted on the same rows, of its largest marginal and its expected number of toxic tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Narrow, table, text_of

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
#: Rows of each label in the training sample, by the order of a hash of doc_id, and the longest text in it.
TRAIN_ROWS = {1: 800, 0: 1600}
TRAIN_CHARS = 20_000
#: Sentences without an anchor that the chain is fitted to.
TRAIN_SENTENCES = 4_000
#: An anchor occurs in this share of the toxic rows at least, and at most at this share of that rate in others.
ANCHOR_SHARE, ANCHOR_LEAK = 0.012, 0.02
#: It would occur in toxic rows alone with less than this chance if it had nothing to do with the label.
ANCHOR_CHANCE = 1e-5
STEPS, L2 = 60, 0.02
THRESHOLD = 0.7
#: Words whose weights a worker keeps.
CACHE_WORDS = 400_000
#: With fewer sentences left than this, they are gone through one by one.
FEW = 8


def own_features(word: str) -> list[str]:
    """The word itself and its beginnings of four to six letters."""
    return ["w=" + word, *("p=" + word[:n] for n in (4, 5, 6) if len(word) > n)]


def unlike(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without near copies of earlier ones: those that agree in two of six least hashes of word triples."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in rows:
        words = text.lower().split()
        h = np.array([crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))], np.uint64)
        sketch = {(k, int(((h * np.uint64(2 * m + 1)) % np.uint64(4294967291)).min())) for k, m in enumerate((1, 40503, 2654435, 97911, 7919, 523987))}
        if len(sketch & seen) < 2:
            out.append((text, y))
        seen |= sketch
    return out


def _ordered(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sentences, longest first."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def _steps(lengths: np.ndarray) -> np.ndarray:
    """How many sentences are longer than k, for each k in turn, as long as they are FEW or more."""
    longer = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths.max(initial=0)), side="right")
    return longer[: np.searchsorted(-longer, -FEW, side="right")]


def forward_odds(odds: np.ndarray, inside: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds of state 1 at every position by all that stands before it and itself: the forward messages.

    All sentences take a step at once while there are many; what then is left of the few longest goes one by one.
    """
    starts, lengths = _ordered(inside)
    out = np.zeros(len(odds))
    if not len(starts):
        return out
    (a00, a01), (a10, a11) = t.tolist()
    a = out[starts] = odds[starts]
    active = _steps(lengths)
    for k in range(1, len(active)):
        a = odds[starts[: active[k]] + k] * (a01 + a11 * a[: active[k]]) / (a00 + a10 * a[: active[k]])
        out[starts[: active[k]] + k] = a
    done = max(1, len(active))
    for start, stop in zip(starts[lengths > done].tolist(), (starts + lengths)[lengths > done].tolist(), strict=True):
        x, held = float(out[start + done - 1]), []
        for e in odds[start + done : stop].tolist():
            x = e * (a01 + a11 * x) / (a00 + a10 * x)
            held.append(x)
        out[start + done : stop] = held
    return out


def backward_odds(odds: np.ndarray, inside: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds of state 1 at every position by all that follows it in its sentence: the backward messages."""
    starts, lengths = _ordered(inside)
    stops = starts + lengths
    out = np.ones(len(odds))
    (a00, a01), (a10, a11) = t.tolist()
    b = np.ones(len(starts))
    active = _steps(lengths)
    for k in range(1, len(active)):
        at = stops[: active[k]] - k
        v = odds[at] * b[: active[k]]
        b = out[at - 1] = (a10 + a11 * v) / (a00 + a01 * v)
    done = max(1, len(active))
    for start, stop in zip(starts[lengths > done].tolist(), stops[lengths > done].tolist(), strict=True):
        y, held = float(out[stop - done]), []
        for e in odds[start + 1 : stop - done + 1][::-1].tolist():
            v = e * y
            y = (a10 + a11 * v) / (a00 + a01 * v)
            held.append(y)
        out[start : stop - done] = held[::-1]
    return out


def marginal_odds(odds: np.ndarray, inside: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds of state 1 at every position: forward times backward messages, as odds.

    odds: emission odds. inside: whether a position belongs to a sentence; others part sentences. t: 2 x 2 factors.
    """
    return forward_odds(odds, inside, t) * backward_odds(odds, inside, t)


def likelihood(e: np.ndarray, inside: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the chain's negative log-likelihood of the states y: by each position's emission, and by theta.

    e: emissions, the log of odds. theta: log of the 2 x 2 factors. The first is the marginal less the state, the second
    the expected number of each pair of neighbours less that in y.
    """
    odds, t = np.exp(np.clip(e, -30, 30)), np.exp(theta)
    before, after = forward_odds(odds, inside, t), backward_odds(odds, inside, t)
    marginal = before * after
    follows = np.flatnonzero(inside[1:] & inside[:-1])
    pairs = np.array([[np.sum((y[follows] == a) & (y[follows + 1] == b)) for b in (0, 1)] for a in (0, 1)], float)
    # the share of each of four ways through two neighbours, with all that lies beyond them
    left, right = before[follows], odds[follows + 1] * after[follows + 1]
    way = np.stack([t[0, 0] + 0 * left, t[0, 1] * right, t[1, 0] * left, t[1, 1] * left * right])
    expect = (way / way.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return np.where(inside, marginal / (1 + marginal) - y, 0.0), expect - pairs


class Model:
    """Weights by feature, transition factors, and the two-feature logistic on top; plain data, sent to the workers."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray, top: np.ndarray):
        self.weights, self.transitions, self.top = weights, transitions, top

    def tagger(self) -> Tagger:
        return Tagger(self)


class Tagger(dict):
    """Token -> row of its weights; row 0 parts sentences."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((4096, 3))
        self.reset()

    def reset(self) -> None:
        self.clear()
        get = self.model.weights.get
        self.bias = get("bias", 0.0)
        self.rows[0] = 0, get("l=", 0), get("r=", 0)
        self.update(dict.fromkeys(ENDS, 0))
        self.n = 1

    def __missing__(self, token: str) -> int:
        get, word = self.model.weights.get, token.lower()
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        own = self.bias + get("w=" + word, 0.0)
        for n in (4, 5, 6):
            if len(word) > n:
                own += get("p=" + word[:n], 0.0)
        self.rows[self.n] = own, get("l=" + word, 0.0), get("r=" + word, 0.0)
        self[token] = self.n
        self.n += 1
        return self.n - 1

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the probability of each token; 0 at sentence ends. The last entry is no token."""
        if self.n > CACHE_WORDS:
            self.reset()
        get = self.__getitem__
        parts = [[*map(get, TOKEN.findall(x)), 0] for x in texts]
        ids = np.fromiter(chain.from_iterable(parts), np.int64)
        e = self.rows[ids, 0]
        e[1:] += self.rows[ids[:-1], 1]
        e[:-1] += self.rows[ids[1:], 2]
        if len(e):
            e[0] += self.rows[0, 1]
        odds = marginal_odds(np.exp(np.clip(e, -30, 30)), ids != 0, self.model.transitions)
        return np.split(odds / (1 + odds), np.cumsum([len(p) for p in parts])[:-1])

    def score(self, p: np.ndarray) -> float:
        z = float(self.model.top @ evidence(p))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(p: np.ndarray) -> np.ndarray:
    most = min(max(float(p.max(initial=0)), 1e-5), 1 - 1e-5)
    return np.array([1, np.log(most / (1 - most)), np.log1p(float(p[p >= 0.5].sum()))])


def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Code point offsets of the runs of tokens whose marginal is 0.5 or more."""
    out = []
    last = False
    for m, x in zip(TOKEN.finditer(text), p >= 0.5, strict=False):
        if x:
            out.append((out.pop()[0] if last else m.start(), m.end()))
        last = bool(x)
    return out


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """The model of (text, label) rows; None if a label is missing or no anchor is found."""
    rows = unlike(rows)
    tokens = [([x if x in ENDS else x.lower() for x in TOKEN.findall(text)], y) for text, y in rows]
    total = Counter(y for _, y in tokens)
    if not total[0] or not total[1]:
        return None
    seen = {0: Counter(), 1: Counter()}
    for words, y in tokens:
        seen[y].update({f for w in {*words} - ENDS for f in own_features(w)})
    least = max(ANCHOR_SHARE * total[1], np.log(ANCHOR_CHANCE) / np.log(total[1] / len(rows)))
    anchors = {f for f, n in seen[1].items() if n >= least and seen[0][f] / total[0] <= ANCHOR_LEAK * n / total[1]}
    if not anchors:
        return None
    sentences: list[tuple[list[str], list[int]]] = []
    plain: list[tuple[list[str], list[int]]] = []
    for words, y in tokens:
        held: list[str] = []
        for w in [*words, "\n"]:
            if w not in ENDS:
                held.append(w)
            elif held:
                marks = [int(y == 1 and any(f in anchors for f in own_features(w))) for w in held]
                (sentences if any(marks) else plain).append((held, marks))
                held = []
    sentences += plain[:: max(1, len(plain) // TRAIN_SENTENCES)]
    index: dict[str, int] = {"bias": 0}
    count = Counter(f for words, _ in sentences for w in words for f in own_features(w))
    flat, owner, y, inside = [], [], [], []
    for words, marks in sentences:
        for k, w in enumerate(words):
            near = ("l=" + (words[k - 1] if k else ""), "r=" + (words[k + 1] if k + 1 < len(words) else ""))
            mine = ["bias", *(f for f in own_features(w) if count[f] > 1), *(f for f in near if count["w=" + f[2:]] != 1)]
            flat += [index.setdefault(f, len(index)) for f in mine]
            owner += [len(y)] * len(mine)
            y.append(marks[k])
            inside.append(True)
        y.append(0)
        inside.append(False)
    flat, owner, y, inside = np.array(flat), np.array(owner), np.array(y, float), np.array(inside)
    w, theta = np.zeros(len(index)), np.zeros((2, 2))
    w[0] = -4
    m = [np.zeros_like(w), np.zeros_like(theta)]
    v = [np.zeros_like(w), np.zeros_like(theta)]
    n = max(1.0, y.sum())
    for step in range(1, STEPS + 1):
        by_place, by_pair = likelihood(np.bincount(owner, w[flat], len(y)), inside, y, theta)
        gradients = np.bincount(flat, by_place[owner], len(w)) / n + L2 * w / n, by_pair / n + L2 * theta / n
        for k, (x, grad) in enumerate(zip((w, theta), gradients, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            x -= 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    model = Model({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-4}, np.exp(theta), np.zeros(3))
    tagger = model.tagger()
    x = np.array([evidence(p) for at in range(0, len(rows), 64) for p in tagger.marginals([text for text, _ in rows[at : at + 64]])])
    label = np.array([y for _, y in rows], float)
    weight = np.where(label == 1, 0.5 / total[1], 0.5 / total[0])
    top = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ top, -30, 30)))
        ridge = np.diag([1e-6, 1e-3, 1e-3])
        top -= np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (weight * (q - label)) + ridge @ top)
    model.top = top
    return model


def in_training(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 3 != 1


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample: TRAIN_ROWS doc_ids of each label, by hash, and of each the least text of up to TRAIN_CHARS characters.

    docs: doc_id, text. labels: doc_id, toxic. A document with several labels is toxic if one says so, before any is chosen.
    """
    known = labels.where(in_training()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in TRAIN_ROWS.items()]
    chosen = F.broadcast(sample[0].unionByName(sample[1]))  # at most the sum of TRAIN_ROWS
    found = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.length("text") <= TRAIN_CHARS).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(r["text"], r["toxic"]) for r in sorted(found.collect(), key=lambda r: r["doc_id"])]


def tag_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], *, with_spans: bool = True, drop: bool = False) -> DataFrame:
    """The keep columns of every row, with score, predicted, n_spans and the spans of its whole text.

    spans: code point offsets of runs of tokens that are toxic by the chain's marginals. drop: only the rows with predicted
    0, and no further columns. Null texts count as empty and get the score of no evidence. Without labels of both kinds, or
    without any anchor, every score is 0. Labels whose crc32(doc_id) mod 3 is 1 are never read; a document with several
    labels counts as toxic if one says so. Repeated rows give repeated rows; an empty table gives an empty one; a result
    column replaces a kept column of its name.
    """
    made = {} if drop else {"score": "double", "predicted": "int", "n_spans": "bigint"} | ({"spans": "array<struct<start:int,stop:int>>"} if with_spans else {})
    known = Narrow(labels, [], doc_id=("doc_id", lambda c: c), toxic=("toxic", lambda c: c)).df
    texts = Narrow(docs, [], doc_id=("doc_id", lambda c: c), text=("text", text_of)).df
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_rows(texts, known)))
    mine: list[Tagger] = []

    def work(cols: dict[str, list]):
        if not mine and shared.value is not None:
            mine.append(shared.value.tagger())
        out, rows = {c: [] for c in made}, []
        texts = cols["text"]
        for at in range(0, len(texts), 128):
            some = texts[at : at + 128]
            for k, p in enumerate(mine[0].marginals(some) if mine else [np.zeros(1)] * len(some), at):
                score = mine[0].score(p) if mine else 0.0
                if drop:
                    rows += [k] * int(score < THRESHOLD)
                    continue
                found = spans(texts[k], p) if p.max() >= 0.5 else []
                got = {"score": float(score), "predicted": int(score >= THRESHOLD), "n_spans": len(found), "spans": [{"start": a, "stop": b} for a, b in found]}
                for c in made:
                    out[c].append(got[c])
        return out, rows if drop else None

    return Narrow(docs, keep, made, text=("text", text_of)).map(work, made)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tag_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return tagged.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", "predicted", "n_spans", "spans")
