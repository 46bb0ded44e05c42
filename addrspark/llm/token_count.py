"""Token counts of a unigram vocabulary without the tokens: Aho-Corasick matches, and a Viterbi pass that keeps, for each
end, the best score, where its last piece starts and how many pieces lead there.

Rules of the tokenizer: blanks become the mark, which starts each text and each part; parts are scored apart. Of two
ways with the same score the one whose last piece starts first stays. A character that is no piece of its own may
be taken at ten less than the lowest score, and counts as many tokens as it has bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import Narrow, table, text_of

MARK = "▁"
BLANK = re.compile(f"[ {MARK}]")
#: Texts longer than this are parted one part at a time.
LONG_CHARS = 1 << 20
UNKNOWN_PENALTY = 10.0
#: So many scores beside those that pieces reach back to are kept at most.
KEPT_ENDS = 1 << 12
#: Parts whose counts a worker keeps, and the longest of them.
CACHE_PARTS, CACHE_CHARS = 300_000, 64
#: Vocabulary entries that may be sent to every worker.
MAX_PIECES = 2_000_000


def read_pieces(path: str) -> tuple[tuple[str, float], ...]:
    """The ordinary pieces of a sentencepiece model file with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.get_piece_size() > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))


class Counter:
    """Counts pieces; one a worker process."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.reach = max((len(p) for p, _ in pieces), default=0) + 1
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[float, int]] = {}

    def part(self, text: str) -> tuple[float, int]:
        """Best score and number of tokens of one part.

        Matches come in the order of their ends and reach back no farther than the longest piece, so of the scores only
        the last are kept, and the memory does not grow with the text.
        """
        score, count, unknown = [0.0], [0], self.unknown
        matches = iter(self.matches.iter(text))
        match = next(matches, None)
        for at, letter in enumerate(text):
            k = len(score)
            best, size, step, single = None, 0, 0, False
            while match is not None and match[0] == at:
                length, s = match[1]
                single |= length == 1
                now = score[k - length] + s
                if best is None or now > best or now == best and length > size:
                    best, size, step = now, length, 1
                match = next(matches, None)
            if not single:
                now = score[k - 1] + unknown
                if best is None or now > best:
                    best, size, step = now, 1, len(letter.encode())
            score.append(best)
            count.append(count[k - size] + step)
            if k >= KEPT_ENDS + self.reach:
                del score[:KEPT_ENDS], count[:KEPT_ENDS]
        return score[-1], count[-1]

    def parts(self, text: str) -> Iterator[str]:
        """What stands between blanks, one after the other; a blank at the head parts nothing."""
        at = int(text[:1] in (" ", MARK))
        while at <= len(text):
            m = BLANK.search(text, at)
            stop = m.start() if m else len(text)
            yield text[at:stop]
            at = stop + 1

    def text(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        score, count, known = 0.0, 0, self.known
        for p in self.parts(text) if len(text) > LONG_CHARS else text.replace(MARK, " ").removeprefix(" ").split(" "):
            got = known.get(p)
            if got is None:
                got = self.part(MARK + p)
                if len(p) <= CACHE_CHARS:
                    if len(known) >= CACHE_PARTS:
                        known.clear()
                    known[p] = got
            score += got[0]
            count += got[1]
        return score, count


@lru_cache(maxsize=2)
def counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(pieces)


def count_tokens(docs: DataFrame, pieces: tuple[tuple[str, float], ...], keep: list[str]) -> DataFrame:
    """The keep columns of every row with n_tokens and score of its whole text.

    A null text counts as empty: no tokens, score 0. Of ways with equal scores the tokenizer's own stays (above). Repeated
    rows give repeated rows; an empty table gives an empty one; a result column replaces a kept column of its name.
    """
    made = {"n_tokens": "bigint", "score": "double"}
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def work(cols: dict[str, list]):
        count = counter(shared.value).text
        got = [count(x) for x in cols["text"]]
        return {"n_tokens": [n for _, n in got], "score": [s for s, _ in got]}, None

    return Narrow(docs, keep, made, text=("text", text_of)).map(work, made)


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")), ["doc_id"])
