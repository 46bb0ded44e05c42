"""Matching an address text against the names of a tree, one start node at a time.

The text keeps its numerals; names hold numbers as value and period. What a text may leave out or put in between is
looked up in a small set of rules. `descend` decides among the nodes that a text can reach below one node, which Spark has
found before: a pure function of these, the text, the nodes already visited and the settings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from .normalize import MIDDLE, Standard
from .numbers import ASCII_DIGITS, DIGITS, HYPHENS, KANJI_DIGITS, NUMERIC, WIDE_DIGITS, read_number

PREF, COUNTY, CITY, WARD, OAZA, AZA, BLOCK, BLD = range(1, 9)
NONAME = "."

# Characters that may begin a lot number.
LOT_HEADS = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥続新いろはにほへとちりぬるをわかよたれそつねイロハニホヘトチリヌルヲワカヨタレソツネ"
# Characters that may follow a name, and the end of a name that may be missing, by level.
EXTRA = "-ノ"
POSTFIXES = {
    CITY: "(市|区|町|村)$",
    WARD: "(区)$",
    OAZA: r"[0-9]+\.(町|条|線|丁|丁目|区|番|号|番丁|番町)$",
    AZA: r"[0-9]+\.(町|条|線|丁|丁目|区|番|号)$",
    BLOCK: r"[0-9A-Za-z甲乙丙丁]+\.?(番|番地|号|地)$",
    BLD: r"[0-9]+\.(号|番地)$",
}
# What cannot follow a name whose end is missing, by level.
TRAILING = {BLOCK: r"[0-9A-Za-z甲乙丙丁]+\.?(番|番地|号|地)", BLD: r"[0-9]+\.?(号|番地)"}

_POSTFIX = {k: re.compile(v) for k, v in POSTFIXES.items()}
_TRAILING = {k: re.compile(v) for k, v in TRAILING.items()}
# Fixed patterns: an omitted area's name before a number, and what may stand before an area's name.
_MIDDLE = re.compile("|".join(sorted(MIDDLE, key=len, reverse=True)))
_PREFIX = re.compile("大字|小字|字")
_SOFT = {s[0] for s in MIDDLE if len(s) > 1}
#: A name of letters that cannot be left out, and a number: 条 may go from anywhere in a name.
COUNTED = rf"([^0-9条{''.join(sorted({c for x in MIDDLE for c in x}))}]+)([0-9]+)\."
_COUNTED = re.compile(COUNTED)
#: Digits of a number in a name, leading zeros aside; in a text no longer ones are looked for.
DIGITS_AT_MOST = 64
_NUMBER = f"[{ASCII_DIGITS}{KANJI_DIGITS}{WIDE_DIGITS}十百千]+"
# Fixed pattern: what may be left out before a number, a lot head with a number, or a number at the end.
_SKIP = re.compile(rf"([^。、，．0-9a-zA-Z\t\n\r\f\v]{{0,15}}?)({_NUMBER}[条線丁区番号{re.escape(HYPHENS)}]|[{LOT_HEADS}]{_NUMBER}|{_NUMBER}$)")


def _length(pattern: re.Pattern, text: str, at: int) -> int:
    m = pattern.match(text, at)
    return len(m[0]) if m else 0


def skippable(text: str, at: int = 0) -> int:
    """How many characters from at could be the name of a small area left out: up to a number that cannot be."""
    m = _SKIP.match(text, at)
    return len(m[1]) if m else 0


def abbreviated(text: str, at: int) -> int:
    """Whether a sign of abbreviation stands at at: 1 yes, 0 nothing to tell, -1 a letter that means another name."""
    if at >= len(text):
        return 0
    if text[at] in HYPHENS:
        return 1
    if text[at] != "ノ" or at + 1 == len(text):
        return 0
    after = text[at + 1]
    return 1 if after in LOT_HEADS or NUMERIC.get(after) else -1


def _step(text: str, at: int, name: str, k: int) -> tuple[int, int] | None:
    """Characters of text and of name that agree at (at, k), or None."""
    want, have = name[k], text[at]
    if want in ASCII_DIGITS:
        stop = name.index(".", k)
        skip = _length(_MIDDLE, text, at)
        value, n = read_number(text[at + skip :], int(name[k:stop]))
        return (skip + n, stop + 1 - k) if n and value == int(name[k:stop]) else None
    if want == have and want not in _SOFT:
        return 1, 1
    a, b = _length(_MIDDLE, text, at), _length(_MIDDLE, name, k)
    after_text, after_name = text[at + a : at + a + 1], name[k + b : k + b + 1]
    options = [(a and b and after_text == after_name, (a + 1, b + 1)), (a and after_text == want, (a + 1, 1)), (b and after_name == have, (1, b + 1)), (want == have, (1, 1))]
    for fits, got in options:
        if fits:
            return got
    gap = skippable(text, at)
    beyond = text[at + gap : at + gap + 1]
    if beyond == want:
        return gap + 1, 1
    return (gap + 1, b + 1) if b and after_name == beyond else None


def match_length(text: str, name: str, removed: str | None = None) -> int:
    """How many characters of text the whole name takes; 0 if they do not agree. removed: an end cut off the name."""
    at = k = 0
    for _ in range(257):
        if k >= len(name):
            break
        if at >= len(text) or (got := _step(text, at, name, k)) is None:
            return 0
        at, k = at + got[0], k + got[1]
    else:
        raise RuntimeError(f"{name!r} and {text!r} do not come to an end")
    return 0 if removed is not None and abbreviated(text, at) < 0 else at


def prefix_length(text: str, at: int) -> int:
    """Characters from at of a word for a larger or smaller area, which may stand before any name."""
    return _length(_PREFIX, text, at)


def _numeral(text: str, at: int) -> tuple[int, int]:
    """(start, stop) of the numeral at at, without leading zeros but one."""
    stop = at
    while stop < len(text) and text[stop] in NUMERIC:
        stop += 1
    while at + 1 < stop and text[at] in "0０" and text[at + 1] in DIGITS:
        at += 1
    return at, stop


def head_of(text: str, at: int) -> str:
    """How the names begin that the text may go on with at at: a number and its period, or a character."""
    start, stop = _numeral(text, at)
    if stop - start > DIGITS_AT_MOST:
        return ""
    value, digits = read_number(text[at : stop + 1])
    return f"{value}." if digits else text[at]


def values_behind(text: str, letters: str) -> set[int]:
    """The values that a number in the text behind letters (without optional ones) can have; none if they do not agree."""
    at = k = 0
    while k < len(letters):
        if at >= len(text) or (got := _step(text, at, letters, k)) is None:
            return set()
        at, k = at + got[0], k + got[1]
    at, stop = _numeral(text, at + _length(_MIDDLE, text, at))
    return {read_number(text[at:end])[0] for end in range(at + 1, min(stop, at + DIGITS_AT_MOST) + 1)}


def name_taken(text: str, index: str, level: int) -> int:
    """How many characters the text begins with of a name, whole or without its optional end; 0 if it does not."""
    taken = match_length(text, index)
    end = _POSTFIX[level].search(index) if level in _POSTFIX else None
    if not taken and end:
        taken = match_length(text, index[: end.start(1)], end[1])
        after = _TRAILING.get(level)
        if after and after.match(text, taken):
            taken = 0
        elif text[taken : taken + 1] and text[taken] in EXTRA:
            taken += 1
    if not taken and index.endswith(".条"):
        taken = match_length(text, index.replace("条", "", 1))
    return taken


class Node(NamedTuple):
    id: int
    parent: int
    name: str
    index: str
    level: int
    valid: bool = True
    city: str = ""
    aza: str = ""
    redirects: tuple[int, ...] = ()
    #: Whether there is anything below it, and whether the registry has block numbers start anew at it.
    full: bool = True
    anew: bool = False
    #: Whether it is a ward of Kyoto, where the names of streets stand before those of places.
    kyoto: bool = False


class Found(NamedTuple):
    node: int
    matched: str
    n: int


@dataclass
class Forest:
    """The nodes that one search may visit, and the registry rows whose names are in its text: (code, name, class, start type)."""

    nodes: dict[int, Node]
    registry: list[tuple[str, str, int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.below: dict[int, list[Node]] = {}
        for n in sorted(self.nodes.values(), key=lambda n: n.id):
            self.below.setdefault(n.parent, []).append(n)
        self.registry = sorted(self.registry)
        self.heads: dict[tuple[int, str], list[Node]] = {}
        #: Of children whose names go on with a number behind the same letters: letters, value -> children.
        self.counted: dict[tuple[int, str], dict[str, dict[int, list[Node]]]] = {}
        for n in self.nodes.values():
            digits = re.match(r"\d+\.", n.index)
            key = n.parent, digits[0] if digits else n.index[:1]
            letters = None if digits else _COUNTED.match(n.index)
            if letters:
                self.counted.setdefault(key, {}).setdefault(letters[1], {}).setdefault(int(letters[2]), []).append(n)
            else:
                self.heads.setdefault(key, []).append(n)

    def children(self, node: int, head: str, deepest: int | None, text: str) -> list[Node]:
        """The children that begin with head and may match the text, by id.

        Names that differ in a number behind the same letters are looked up by the values that the text can have there.
        """
        found = list(self.heads.get((node, head), ()))
        for letters, by_value in self.counted.get((node, head), {}).items():
            values = values_behind(text, letters)
            for value in values:
                found += by_value.get(value, ())
        return sorted((n for n in found if deepest is None or n.level <= deepest), key=lambda n: n.id)


@dataclass(frozen=True)
class Settings:
    """aza_skip: None decides by the registry, True skips freely, False never."""

    aza_skip: bool | None = None
    best_only: bool = True
    target_area: tuple[str, ...] = ()
    require_coordinates: bool = True
    auto_redirect: bool = True


def omissible(forest: Forest, node: Node, text: str, done: set[int], strict: bool) -> str:
    """The head of text that may be skipped below node as the name of an unlisted area."""
    if not CITY <= node.level <= AZA:
        return ""
    for other in (forest.nodes[i] for i in done if i in forest.nodes):
        if other.parent == node.id or (other.parent == node.parent and other.index != node.index):
            return ""
    code = node.city if node.level < OAZA else node.aza.rstrip("0")
    if not code:
        return text
    rows = [r for r in forest.registry if r[0].startswith(code)]
    if strict:
        if node.anew:
            return text
        return text[: max([0, *(text.find(name) for _, name, _, kind in rows if kind == 2)])]
    for _, name, group, kind in rows:
        at = text.find(name) if group == 1 or (group == 3 and kind == 1) else -1
        if at >= 0:
            text = text[:at]
    return text


def descend(forest: Forest, node_id: int, text: str, done: set[int], settings: Settings) -> list[Found]:
    """What the text matches from the node down, in the order found; the node itself, with nothing matched, among it."""
    node, itself = forest.nodes[node_id], Found(node_id, "", 0)
    prefix = text[: _length(_PREFIX, text, 0)]
    text = text[len(prefix) :]
    if not text:
        done.add(node_id)
        return [itself]
    if not node.full:
        return redirected(forest, node, text, done, settings) or [itself]
    nearby = forest.children(node_id, head_of(text, 0), AZA if prefix else None, text)
    if not nearby and text[0] in EXTRA:
        below = descend(forest, node_id, text[1:], done, settings)
        return [f if f.node == node_id else Found(f.node, text[0] + f.matched, len(prefix) + f.n) for f in below] + [itself]
    out: list[Found] = []
    for child in nearby:
        if child.id not in done and (found := enter(forest, child, text, prefix, done, settings)):
            out += [*found, itself]
    if node.kyoto:
        out += past_streets(forest, node, text, prefix, done, settings)
    out += redirected(forest, node, text, done, settings)
    if not out or len(text) - len(out[0].matched) > 2:
        out += past_area(forest, node, text, prefix, done, settings)
    return out or [itself]


def enter(forest: Forest, child: Node, text: str, prefix: str, done: set[int], settings: Settings) -> list[Found]:
    """Results at and below child if its name begins the text, whole or without its optional end."""
    taken = name_taken(text, child.index, child.level)
    if not taken:
        return []
    head = prefix + text[:taken]
    return [Found(f.node, head + f.matched, len(head) + f.n) for f in descend(forest, child.id, text[taken:], done, settings)]


def past_streets(forest: Forest, node: Node, text: str, prefix: str, done: set[int], settings: Settings) -> list[Found]:
    """In the wards of Kyoto, children whose name stands further on, behind the names of streets."""
    out: list[Found] = []
    for child in forest.below.get(node.id, ()):
        at = text.rfind(child.index)
        if at > 0:
            stop = at + len(child.index)
            done.add(child.id)
            below = descend(forest, child.id, text[stop:], done, settings)
            out += [Found(f.node, prefix + text[:stop] + f.matched, len(prefix) + len(child.index) + len(f.matched)) for f in below]
            out.append(Found(node.id, "", 0))
    return out


def redirected(forest: Forest, node: Node, text: str, done: set[int], settings: Settings) -> list[Found]:
    """Matches below the places that node's addresses have moved to."""
    if not settings.auto_redirect or not node.redirects:
        return []
    done.add(node.id)
    return [f for target in node.redirects if target in forest.nodes and target not in done for f in descend(forest, target, text, done, settings) if f.matched]


def past_area(forest: Forest, node: Node, text: str, prefix: str, done: set[int], settings: Settings) -> list[Found]:
    """Matches behind an area name that may be left out; only of lots and below, or of lot heads."""
    if settings.aza_skip is False:
        return []
    free = omissible(forest, node, text, done, strict=settings.aza_skip is None)
    gap = skippable(text)
    if not 0 < gap <= len(free):
        return []
    below = descend(forest, node.id, text[gap:], done, replace(settings, aza_skip=False))
    if not below[0].matched:
        return []
    keep = [f for f in below if forest.nodes[f.node].level >= BLOCK or forest.nodes[f.node].index in LOT_HEADS]
    return [*(Found(f.node, prefix + text[:gap] + f.matched, len(prefix) + f.n) for f in keep), *[Found(node.id, "", 0)] * bool(keep)]


def search_start(forest: Forest, start: Node, key: str, text: str, done: set[int], settings: Settings, longer: bool = False) -> list[tuple[int, str, int, int]]:
    """(node, matched with key, length, part) of all that is found from start; text is what follows the key's notation.

    longer: whether an answer that goes beyond this key is known already, which rules out skipping areas below a city
    without named parts.
    """
    offset = match_length(text, key)
    head, rest = text[:offset], text[offset:]
    found = descend(forest, start.id, rest, done, settings)
    done.add(start.id)
    if not found[0].matched and start.level == CITY and not rest.startswith(NONAME):
        nameless = forest.nodes.get(start.id + 1)
        if nameless and nameless.name == NONAME and nameless.id not in done:
            done.add(nameless.id)
            under = replace(settings, aza_skip=False) if longer else settings
            found = found + [f for f in descend(forest, nameless.id, rest, done, under) if f.matched]
    return [(f.node, head + f.matched, offset + f.n, offset + len(f.matched)) for f in found]


def original(query: str, matched: str, name: str, standard: Standard) -> str:
    """The head of query that the standardized text matched stands for."""
    at = min(len(matched), len(query))
    seen: set[int] = set()
    while at not in seen and 0 <= at <= len(query):
        seen.add(at)
        n = len(standard(query[:at], True))
        if n == len(matched):
            if at < len(query) and name and ((query[at] == name[-1] and len(standard(query[: at + 1])) == len(matched)) or query[-2:] in ("通り", "通リ")):
                at += 1
            return query[:at]
        at += 1 if n < len(matched) else -1
    if 0 <= at <= len(query):
        raise ValueError(f"{matched!r} cannot be found in {query!r}")
    return ""
