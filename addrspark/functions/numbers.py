"""Reading numbers off the head of a text: ASCII or full-width digits, or kanji with units."""

from __future__ import annotations

import re

# The digits in three scripts, and the units.
ASCII_DIGITS = "0123456789"
WIDE_DIGITS = "０１２３４５６７８９"
KANJI_DIGITS = "〇一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
# Every character that stands for a hyphen.
HYPHENS = "-﹣－‐‑⁃˖−‒–—―﹘ー"

DIGITS = {c: k for row in (ASCII_DIGITS, WIDE_DIGITS) for k, c in enumerate(row)}
KANJI = {c: k for k, c in enumerate(KANJI_DIGITS)}
NUMERIC = {**DIGITS, **KANJI, **UNITS}


def read_number(text: str, expected: int = 0) -> tuple[int, int]:
    """(value, characters read). With expected, kanji stop as soon as the value reaches it; a run of digits is never cut."""
    done = held = 0
    digits: bool | None = None
    at = 0
    for at, c in enumerate(text):  # noqa: B007
        if 0 < expected <= done + held and not (c in DIGITS and at and text[at - 1] in DIGITS):
            return done + held, at
        if c in DIGITS and digits is not False:
            held, digits = held * 10 + DIGITS[c], True
        elif c in UNITS:
            held = held or 1
            unit = UNITS[c]
            # what stands before a larger unit is multiplied by it as a whole: 二千四十五万
            done = (done * unit if done % unit else done) + held * unit
            held = 0
        elif digits is True or c not in KANJI:
            return done + held, at
        elif KANJI[c] == 0 and done + held == 0:
            return 0, at + 1
        else:
            held, digits = held * 10 + KANJI[c], False
    return done + held, len(text)


#: ASCII and full-width digits that no unit follows: their number is their text, however long it is.
_PLAIN = re.compile(rf"[{ASCII_DIGITS}{WIDE_DIGITS}]+(?![{''.join(UNITS)}{ASCII_DIGITS}{WIDE_DIGITS}])")
_TO_ASCII = str.maketrans(WIDE_DIGITS, ASCII_DIGITS)


def plain_number(text: str, at: int = 0) -> tuple[str, int] | None:
    """(value without leading zeros, characters read) of a run of digits at at, or None if it is none or a unit follows."""
    m = _PLAIN.match(text, at)
    return m and (m[0].translate(_TO_ASCII).lstrip("0") or "0", len(m[0]))


def char_type(c: str) -> int:
    """0 hiragana, 1 katakana, 2 Latin letter, 4 other ASCII, 5 number, 6 kanji, -1 anything else."""
    if "ぁ" <= c <= "ゖ":
        return 0
    if "ァ" <= c <= "ヶ" or c == "ー":
        return 1
    if c.isascii() and c.isalpha():
        return 2
    if "!" <= c <= "~":
        return 4
    if c in NUMERIC:
        return 5
    return 6 if "一" <= c <= "鿿" else -1


def char_type_column(c):
    """char_type of a column of single characters."""
    from pyspark.sql import functions as F

    kinds = (("^[ぁ-ゖ]$", 0), ("^[ァ-ヶー]$", 1), ("^[A-Za-z]$", 2), ("^[!-~]$", 4), ("^[" + "".join(NUMERIC) + "]$", 5), ("^[一-鿿]$", 6))
    out = F.lit(-1)
    for pattern, kind in reversed(kinds):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return out
