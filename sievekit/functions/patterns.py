"""What a rule's pattern asks of a line before it is worth matching: literals of which it must hold one, and how many characters of a kind."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from re import _constants as K  # noqa: PLC2701
from re import _parser  # noqa: PLC2701

#: Kinds of characters that are counted, as tests of a code point; all but the last are single bytes.
KINDS = ("0123456789", ".", ":", "@", ",", ":-", None)  # None: anything beyond ASCII


def python_pattern(pattern: str) -> str:
    """For Python: boundaries that are ASCII alone as looks around, and a flag inside a pattern as a group up to its end."""
    edge = r"(?-u:\b)"
    if pattern.startswith(edge):
        pattern = "(?<![0-9A-Za-z_])" + pattern[len(edge) :]
    pattern = pattern.replace(edge, "(?![0-9A-Za-z_])")
    at = pattern.find("(?i)", 1)
    return pattern if at < 0 else f"{pattern[:at]}(?i:{pattern[at + 4 :]})"


@dataclass(frozen=True)
class Needs:
    """words: (text, whether case counts) of which a match holds one at least (empty: none known); counts: of each kind at least."""

    words: frozenset[tuple[str, bool]]
    counts: tuple[int, ...]


def _fits(kind: str | None, code: int) -> bool:
    return code > 127 if kind is None else chr(code) in kind


def _set_counts(items) -> tuple[int, ...]:
    """1 for each kind that holds all members of a set."""
    out = []
    for kind in KINDS:
        inside = True
        for op, value in items:
            if op is K.LITERAL:
                inside &= _fits(kind, value)
            elif op is K.RANGE:
                inside &= value[0] > 127 if kind is None else value[1] - value[0] < 128 and all(_fits(kind, c) for c in range(value[0], value[1] + 1))
            else:  # classes and complements
                inside = False
        out.append(int(inside))
    return tuple(out)


def _better(a: frozenset, b: frozenset) -> frozenset:
    """The words that fewer lines hold: by their shortest, then by their number."""
    rank = lambda w: (min((len(t.encode()) for t, _ in w), default=0), -len(w))
    return max(a, b, key=rank)


def _sequence(items, fold: bool) -> tuple[frozenset, list[int]]:
    words, run, counts = frozenset(), "", [0] * len(KINDS)

    def close():
        nonlocal words, run
        if run:
            words, run = _better(words, frozenset([(run.lower() if fold else run, not fold)])), ""

    for op, value in items:
        if op is K.LITERAL:
            run += chr(value)
            if not (fold and chr(value).isalpha()):
                counts = [c + _fits(kind, value) for c, kind in zip(counts, KINDS)]
            continue
        if op not in (K.AT, K.ASSERT, K.ASSERT_NOT):
            close()
        own, some = frozenset(), [0] * len(KINDS)
        if op is K.IN:
            some = _set_counts(value)
        elif op is K.BRANCH:
            each = [_sequence(part, fold) for part in value[1]]
            own = frozenset().union(*(w for w, _ in each)) if all(w for w, _ in each) else own
            some = [min(c) for c in zip(*(c for _, c in each))]
        elif op is K.SUBPATTERN:
            own, some = _sequence(value[3], (fold or bool(value[1] & re.IGNORECASE)) and not value[2] & re.IGNORECASE)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0]:
            own, some = _sequence(value[2], fold)
            some = [c * value[0] for c in some]
        elif op is K.ATOMIC_GROUP:
            own, some = _sequence(value, fold)
        words = _better(words, own)
        counts = [a + b for a, b in zip(counts, some)]
    close()
    return words, counts


@cache
def needs(pattern: str) -> Needs:
    """Literals under two bytes say too little and are left to the counts; lookarounds ask for nothing here."""
    parsed = _parser.parse(python_pattern(pattern))
    words, counts = _sequence(parsed, bool(parsed.state.flags & re.IGNORECASE))
    if any(len(text.encode()) < 2 for text, _ in words):
        words = frozenset()
    return Needs(words, tuple(counts))


@dataclass(frozen=True)
class Run:
    """A pattern of a set once or more up to a sign outside the set, then the rest: before each sign stands one run at most."""

    fold: bool
    edge: bool  # whether the match begins at a word boundary
    members: str  # the set
    sign: str
    rest: str


def leading_run(pattern: str) -> Run | None:
    m = re.match(r"(\(\?i\))?(\\b)?(\[(?:[^\]\\]|\\.)+\])\+([@#])", pattern)
    return Run(bool(m[1]), bool(m[2]), m[3], m[4], pattern[m.end() :]) if m and not re.fullmatch(m[3], m[4]) else None
