"""Edit distance of many pairs of word sequences at once, in bands around the diagonal."""

from __future__ import annotations

import numpy as np

_FAR = np.int32(1 << 28)
#: Cells of one band row that are worked on together.
_CELLS = 1 << 18
#: Words of one side that are laid out together, padded to the longest; pairs come in order of length.
_WORDS = 1 << 21


def limit(a: int, b: int, similarity: float) -> int:
    """The most edits with which lengths a and b can still be that similar."""
    return int((1 - similarity) * max(a, b) + 1e-9)


def _band(left: list[np.ndarray], right: list[np.ndarray], width: int) -> np.ndarray:
    """Edit distances up to ``width``, else more; ``left`` is sorted by length."""
    n = len(left)
    sizes, others = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    longest = int(sizes[-1])
    a = np.zeros((n, longest), np.uint32)
    b = np.zeros((n, longest + 2 * width + 1), np.uint32)
    for k in range(n):
        a[k, : sizes[k]] = left[k]
        b[k, width : width + min(others[k], longest + width)] = right[k][: longest + width]
    offsets = np.arange(-width, width + 1, dtype=np.int32)
    row = np.where(offsets >= 0, offsets, _FAR)[None, :].repeat(n, axis=0)
    row[offsets[None, :] > others[:, None]] = _FAR
    out = np.full(n, _FAR)
    alive = np.arange(n)
    at_end = np.flatnonzero(sizes == 0)
    out[at_end] = others[at_end]
    for i in range(1, longest + 1):
        keep = (sizes[alive] >= i) & (row.min(axis=1) <= width)
        if not keep.all():
            alive, row = alive[keep], row[keep]
            if not len(alive):
                break
        unlike = a[alive, i - 1][:, None] != b[alive, i - 1 : i + 2 * width]
        new = row + unlike
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        place = i + offsets
        new[:, place < 0] = _FAR
        new[:, place == 0] = i
        new[place[None, :] > others[alive][:, None]] = _FAR
        new -= offsets
        np.minimum.accumulate(new, axis=1, out=new)
        new += offsets
        row = new
        done = np.flatnonzero(sizes[alive] == i)
        shift = others[alive[done]] - i + width
        inside = (shift >= 0) & (shift <= 2 * width)
        out[alive[done[inside]]] = row[done[inside], shift[inside]]
    return out


def alike(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether ``1 - edits / longer length`` reaches ``similarity``, pair by pair.

    Bands are widened from 8 edits to the most that are allowed, so that near pairs cost little.
    """
    n = len(left)
    most = np.array([limit(len(a), len(b), similarity) for a, b in zip(left, right, strict=True)], np.int64)
    open_ = np.zeros(n, bool)
    for k in range(n):
        a, b = left[k], right[k]
        if abs(len(a) - len(b)) <= most[k]:
            # words that the other side does not have are edits in any alignment
            values, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
            own = np.bincount(counts[: len(a)], minlength=len(values)) - np.bincount(counts[len(a) :], minlength=len(values))
            open_[k] = max(own[own > 0].sum(), -own[own < 0].sum()) <= most[k]
    out = np.zeros(n, bool)
    width = 8
    while open_.any():
        now = np.flatnonzero(open_)
        now = now[np.argsort([len(left[k]) for k in now], kind="stable")]
        step = max(1, _CELLS // (2 * width + 1))
        at = 0
        while at < len(now):
            take = min(step, len(now) - at)
            while take > 1 and take * (len(left[now[at + take - 1]]) + 2 * width) > _WORDS:
                take = (take + 1) // 2
            some = now[at : at + take]
            at += take
            band = int(min(width, most[some].max()))
            edits = _band([left[k] for k in some], [right[k] for k in some], band)
            out[some] = edits <= np.minimum(most[some], band)
            open_[some] = ~out[some] & (most[some] > band)
        width *= 4
    return out
