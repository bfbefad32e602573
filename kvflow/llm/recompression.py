"""Run-length grammars of many sequences at once by recompression, and common extensions in them.

Recompression alternates two steps until every sequence is one symbol: block compression replaces each
longest run ``a a ... a`` by one symbol for ``(a, k)``; pair compression splits the alphabet in left and
right halves and replaces every ``ab`` of a left a and a right b. Both look at adjacent symbols only, so
equal stretches are cut equally but for a symbol or two at their ends, and a common extension is
found by climbing over whole symbols and coming down where they differ: a few steps per level.

All levels of all sequences lie in common arrays. Names are exact: a new symbol is numbered by its
parts, never by a hash. Sequences are kept apart by symbols that occur once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_U = np.uint64
#: Queries that are worked on together.
_QUERIES = 1 << 17


class Grammar(NamedTuple):
    """Nodes of all levels, the words' first; node ``i`` is the word at place ``i`` for the first level."""

    symbol: np.ndarray
    level: np.ndarray
    width: np.ndarray  # words below
    ahead: np.ndarray  # equal symbols from here on that one block holds, this one included
    behind: np.ndarray
    up: np.ndarray
    first: np.ndarray  # first and last node below; own node on the words' level
    last: np.ndarray
    opens: np.ndarray  # whether it is the first, the last below its parent
    closes: np.ndarray
    top: int


def _side(names: np.ndarray, turn: int) -> np.ndarray:
    """Which half of the alphabet each symbol is in, in this turn."""
    h = (names.astype(np.uint64) + _U(turn * 0x632BE59BD9B4E019 % (1 << 64))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (h >> _U(63)).astype(bool)


def build(codes: np.ndarray, ends: np.ndarray) -> Grammar:
    """The grammar of ``codes`` (numbers from 0), cut into sequences that stop before each of ``ends``.

    The word at place p of sequence s is node ``p + s + 1``: a separator stands before each sequence and
    one at the end.
    """
    count = len(ends)
    names = int(codes.max()) + 1 if len(codes) else 0
    places = np.arange(len(codes)) + np.searchsorted(ends, np.arange(len(codes)), "right") + 1
    symbol = np.empty(len(codes) + count + 1, np.int64)
    fixed = np.ones(len(symbol), bool)
    fixed[places] = False
    symbol[places] = codes
    symbol[fixed] = -1 - np.arange(count + 1)
    width = np.ones(len(symbol), np.int32)
    levels, turn = [], 0
    while True:
        n = len(symbol)
        grow = np.ones(n, bool)  # starts a new parent
        block = turn % 2 == 0
        joint = ~(fixed[1:] | fixed[:-1])
        ahead = behind = np.ones(n, np.int32)
        if block:
            same = symbol[1:] == symbol[:-1]
            grow[1:] = ~same
        else:
            right = _side(symbol, turn)
            one, two = joint & ~right[:-1] & right[1:], joint & right[:-1] & ~right[1:]
            grow[1:] = ~(one if one.sum() >= two.sum() else two)
        begin = np.flatnonzero(grow)
        size = np.diff(np.append(begin, n))
        parent = np.cumsum(grow) - 1
        if block:
            place = np.arange(n, dtype=np.int32)
            behind = place - begin[parent].astype(np.int32) + 1
            ahead = (size[parent] - behind + 1).astype(np.int32)
        closes = np.ones(n, bool)
        closes[:-1] = grow[1:]
        levels.append((symbol, width, ahead, behind, parent, grow, closes, begin, size))
        if not joint.any():
            break
        # only symbols that joined get new names
        joined = np.flatnonzero(size > 1)
        new = symbol[begin]
        if len(joined):
            other = size[joined] if block else symbol[begin[joined] + 1]
            kind = new[joined] * (int(other.max()) + 1) + other
            _, number = np.unique(kind, return_inverse=True)
            new[joined] = names + number
            names += int(number.max()) + 1
        width = np.add.reduceat(width, begin).astype(np.int32)
        fixed = fixed[begin]
        symbol = new
        turn += 1
    sizes = [len(level[0]) for level in levels]
    bases = np.concatenate([[0], np.cumsum(sizes)])
    out = {k: [] for k in ("up", "first", "last")}
    for k, (_, _, _, _, parent, *_rest) in enumerate(levels):
        out["up"].append(parent + bases[k + 1] if k + 1 < len(levels) else np.arange(sizes[k]) + bases[k])
        if k:
            begin, size = levels[k - 1][7], levels[k - 1][8]
            out["first"].append(begin + bases[k - 1])
            out["last"].append(begin + size - 1 + bases[k - 1])
        else:
            out["first"].append(np.arange(sizes[0]))
            out["last"].append(np.arange(sizes[0]))

    def all_of(place: int) -> np.ndarray:
        return np.concatenate([level[place] for level in levels])

    return Grammar(
        all_of(0), np.repeat(np.arange(len(levels)), sizes), all_of(1), all_of(2), all_of(3),
        *(np.concatenate(out[k]) for k in ("up", "first", "last")), all_of(5), all_of(6), len(levels) - 1,
    )


def _extend(g: Grammar, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    run, edge, down = (g.ahead, g.opens, g.first) if step > 0 else (g.behind, g.closes, g.last)
    total = np.zeros(len(x), np.int64)
    who, a, b = np.arange(len(x)), x.astype(np.int64), y.astype(np.int64)
    cap = np.full(len(x), g.top)
    while len(who):
        equal = g.symbol[a] == g.symbol[b]
        at = np.flatnonzero(equal)
        if len(at):
            # blocks of different lengths have the shorter one in common
            take = np.minimum(run[a[at]], run[b[at]]).astype(np.int64)
            total[who[at]] += take * g.width[a[at]]
            a[at] += step * take
            b[at] += step * take
            climb = at[edge[a[at]] & edge[b[at]] & (g.level[a[at]] < cap[at])]
            a[climb], b[climb] = g.up[a[climb]], g.up[b[climb]]
        at = np.flatnonzero(~equal)
        if len(at):
            level = g.level[a[at]]
            cap[at] = level - 1
            a[at], b[at] = down[a[at]], down[b[at]]
            if not level.all():
                stay = np.ones(len(who), bool)
                stay[at[level == 0]] = False
                who, a, b, cap = who[stay], a[stay], b[stay], cap[stay]
    return total


def extend(g: Grammar, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many words are equal from the word nodes x and y on (step 1), or up to them (step -1).

    x and y differ; separators are never equal to anything.
    """
    parts = [_extend(g, x[k : k + _QUERIES], y[k : k + _QUERIES], step) for k in range(0, len(x), _QUERIES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
