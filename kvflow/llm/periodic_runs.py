"""Periodic runs of words, found in a run-length grammar of each text.

A run is a stretch of words with smallest period q, at least ``least`` words and ``exponent`` times q
long, that no neighbouring word extends keeping the period. Candidates lie on a harmonic grid: a run of
period q has more than ``max((exponent - 1) q, least - q)`` places from which a word and the one q
further on are both inside, so grid points that far apart miss none, and all periods together have about n log n of
them. Where the two words at a grid point are equal, both extensions are asked of the grammar
(``recompression``), which gives the whole stretch of that period. A stretch that is found with several
periods has them all as multiples of the smallest one (they are long enough for that), which is its period.

Words are the longest runs of ``[^\\x20\\x09-\\x0D]``, compared as they are.

Defined results: a null text has no words; texts of fewer than ``least`` words have no runs; the text of
a document without runs is its words joined by one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.llm.common import lists, map_batches, pieces
from kvflow.llm.recompression import build, extend

LEAST, EXPONENT = 24, 3
#: A grammar takes some hundred times its text's words in bytes, so texts are taken in runs of so many bytes.
_TEXT_BYTES = 1 << 20
#: Grid points that are looked at together.
_POINTS = 1 << 20


def words_of_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and the bounds of each text's words among them."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null("")).cast(pa.large_list(pa.large_string()))
    bounds = parts.offsets.to_numpy()
    words = parts.flatten()
    bounds = bounds - bounds[0]
    # white space at an end of a text leaves an empty word there
    whole = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    return words.filter(pa.array(whole)), np.concatenate([[0], np.cumsum(whole)])[bounds]


def _grid(sizes: np.ndarray, least: int, exponent: int):
    """(text, period, place) of all grid points, in pieces of bounded size, periods in order."""
    periods = np.where(sizes >= least, sizes // exponent, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum((exponent - 1) * period, least - period)
    points = (sizes[text] - period + step - 1) // step
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - points[at] + _POINTS, "right")))
        n = points[at:to]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[at:to], n), np.repeat(period[at:to], n), place * np.repeat(step[at:to], n)
        at = to


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period; texts are cut at ``bounds``."""
    grammar, found = None, []
    for text, period, place in _grid(np.diff(bounds), least, exponent):
        word = bounds[text] + place
        equal = np.flatnonzero(codes[word] == codes[word + period])
        if not len(equal):
            continue
        if grammar is None:
            grammar = build(codes, bounds[1:])
        text, period, place = text[equal], period[equal], place[equal]
        node = word[equal] + text + 1
        ahead = extend(grammar, node, node + period, 1)
        behind = extend(grammar, node - 1, node + period - 1, -1)
        length = ahead + behind + period
        keep = length >= np.maximum(least, exponent * period)
        found.append(np.stack([text, place - behind, length, period])[:, keep])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _task(least: int, exponent: int, kind: pa.DataType):
    def some(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        words, bounds = words_of_texts(texts)
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        text, start, length, period = runs_of(codes, bounds, least, exponent)
        # a word goes if a run holds it behind its first period
        depth = np.zeros(len(codes) + 1, np.int64)
        np.add.at(depth, bounds[text] + start + period, 1)
        np.add.at(depth, bounds[text] + start + length, -1)
        keep = np.cumsum(depth)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(keep)])[bounds]
        kept = lists(left, words.filter(pa.array(keep)).cast(pa.string()))
        fields = [pa.array(c, pa.int64()) for c in (start, length, period)]
        runs = lists(np.searchsorted(text, np.arange(len(bounds))), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        return runs.cast(kind), pc.binary_join(kept, " ").cast(pa.large_string())

    def task(batch: pa.RecordBatch) -> list[pa.Array]:
        one = batch.select([batch.num_columns - 1])
        made = [some(part.column(0)) for part in pieces(one, _TEXT_BYTES)]
        return [pa.concat_arrays([m[0] for m in made]), pa.concat_arrays([m[1] for m in made])]

    return task


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start and period, and ``collapsed``.

    ``collapsed`` is the text of the words that no run holds behind its first period, joined by one
    space. Other columns stay, but for any that have these names. ``exponent`` is 2 at least.
    """
    added = docs.sparkSession.createDataFrame(
        [], "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    ).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    hidden = "_text_of_runs"
    while hidden in docs.columns:
        hidden += "_"
    source = docs.withColumn(hidden, F.col(text_col).cast("string"))
    return map_batches(source, added, _task(least, exponent, kind), (hidden,))
