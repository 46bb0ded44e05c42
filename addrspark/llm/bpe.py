"""Byte-level BPE: encoding with the tiktoken library, and decoding to raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import Narrow, table, text_of

#: Texts longer than this many characters are encoded in pieces.
PIECE_CHARS = 65_536
#: How many pieces' lengths a safe boundary is looked for; the library's splitting overflows its stack at some 13 of them.
REACH = 4
#: A match of a pre-splitting pattern of this family never runs from a letter or digit into a following blank, and no
#: pattern looks behind, so a text may be cut there without a change of its ids.
SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?À-ɏ])(?=[ \n])")
#: Bytes of a rank file that may be sent to every worker.
MAX_RANK_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} holds more than {MAX_RANK_BYTES} bytes")
    return data


class Codec:
    """One a worker process: the library's encoding, the pattern for texts it cannot split, and ids as decimal text."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern).finditer
        self.decimal = [b"%d" % i for i in range(max(ranks.values()) + 1)]
        self.match = lru_cache(100_000)(lambda m: tuple(self.enc._encode_single_piece(m)))

    def encode(self, text: str, size: int = PIECE_CHARS) -> list[int]:
        """The ids of a whole text.

        A long text is cut at safe boundaries into pieces of about size characters. Where none is near, as in a run of
        blanks or in a script without them, the pattern's matches are found one by one and encoded apart: after a match
        the rest of the text is split as if it stood alone, so the next piece may start there.
        """
        whole, start, ids = self.enc.encode_ordinary, 0, []
        while len(text) - start > size:
            cut = SAFE.search(text, start + size, start + REACH * size)
            if cut:
                ids += whole(text[start : cut.start()])
                start = cut.start()
                continue
            goal = start + size
            for m in self.matches(text, start):
                word = m[0]
                ids += self.match(word) if len(word) < 64 else self.enc._encode_single_piece(word)
                start = m.end()
                if start >= goal:
                    break
        return ids + whole(text[start:])


@lru_cache(maxsize=2)
def codec(data: bytes, pattern: str) -> Codec:
    return Codec(data, pattern)


def bpe_encode(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str], *, ids: bool = False) -> DataFrame:
    """The keep columns of every row, with n_tokens, ids_sha256 and decoded_sha256 of its text, and token_ids if ids.

    A null text counts as empty: no tokens, and the digests of empty strings. Texts of any length and script are encoded
    whole. Repeated rows give repeated rows; a result column replaces a kept column of its name; an empty table gives an
    empty table.
    """
    made = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<int>"} if ids else {})
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(cols: dict[str, list]):
        c = codec(shared.value, pattern)
        out = {m: [] for m in made}
        for text in cols["text"]:
            got = c.encode(text)
            out["n_tokens"].append(len(got))
            out["ids_sha256"].append(hashlib.sha256(b" ".join([c.decimal[i] for i in got])).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.enc.decode_bytes(got)).hexdigest())
            if ids:
                out["token_ids"].append(got)
        return out, None

    return Narrow(docs, keep, made, text=("text", text_of)).map(work, made)


def bpe_decode(tokens: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """tokens with a binary column data: the raw bytes of token_ids (null: null). They need not be valid UTF-8."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def work(cols: dict[str, list]):
        enc = codec(shared.value, pattern).enc
        return {"data": [None if x is None else enc.decode_bytes(x) for x in cols["ids"]]}, None

    return Narrow(tokens, tokens.columns, ["data"], ids=("token_ids", lambda c: c)).map(work, {"data": "binary"})


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, ["doc_id"])
