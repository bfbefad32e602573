"""Words of many texts at once: byte offsets and 64-bit hashes, computed on Arrow buffers.

A word is a longest run of digits, letters and non-ASCII characters once A-Z is lower-cased, i.e.
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. In UTF-8 that is a property of single bytes, so whole batches
are cut with array operations and never as Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (multiply and shift)."""
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
#: All bytes but space and 0x09 to 0x0D, for words that white space alone parts.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_BASE = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(max(n, _CHUNK), base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


class Words(NamedTuple):
    """The words of a batch in order: hash, first and last byte (exclusive) in ``data``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]
    data: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # bytes of text i are offsets[i]:offsets[i + 1]


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``_CHUNK`` bytes; a longer text is a run of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def words_of(texts: pa.Array | pa.ChunkedArray, in_word: np.ndarray = _IS_WORD) -> Words:
    """All words of all texts; ``in_word`` tells of each byte whether it belongs to a word."""
    data, offsets = utf8(texts)
    hashes, starts, ends = [], [], []
    for first, last in _pieces(offsets):
        at = int(offsets[first])
        raw = data[at : int(offsets[last])]
        inside = in_word[raw]
        edges = offsets[first : last + 1] - at
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        firsts = edges[:-1][edges[:-1] < len(raw)]
        before[firsts] = False
        after[edges[1:][edges[1:] > 0] - 1] = False
        begin = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        if len(begin):
            up, down = _powers(len(raw))
            total = np.cumsum(_BYTE[raw] * up[: len(raw)])
            sums = total[end - 1] - np.where(begin > 0, total[begin - 1], _U(0))
            hashes.append(mix(sums * down[begin]))
            starts.append(begin + at)
            ends.append(end + at)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data, offsets)
    begin = np.concatenate(starts)
    return Words(
        np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets), data, offsets
    )


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` hashes; order matters."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * _U(_BASE) + hashes[k : n + k]
    return mix(out)
