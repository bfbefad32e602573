"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of at most a million words, cut where they are read, so nothing is
shuffled. Its words are indexed (``fm_index``), every window of the benchmark is searched backwards
through the wavelet ranks, occurrences are located by sampled suffix positions, compared with the
full word hashes, and merged into removal spans.

Defined results: a null text has no words; a document or item without words has no windows; equal
items are found each under its own id, a repeated item row once; an empty benchmark hits nothing;
rows of documents are never joined by id, so repeated ids are judged each by its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvflow.llm.common import lists, map_batches
from kvflow.llm.fm_index import MOST_SYMBOLS, FMIndex
from kvflow.llm.words import Words, words_of

WIDTH = 10
#: Windows that travel to a task at once, about 100 bytes each; a larger benchmark goes in blocks.
BLOCK_WINDOWS = 100_000

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """Distinct (item, window) rows; a window is an array of word hashes."""

    def cut(batches):
        for batch in batches:
            words = words_of(batch.column(1))
            ids, begins, sizes = [], [], []
            for i in range(batch.num_rows):
                first, last = int(words.bounds[i]), int(words.bounds[i + 1])
                n = last - first
                if n:
                    k = max(1, n - width + 1)
                    ids.append(np.full(k, i))
                    begins.append(first + np.arange(k))
                    sizes.append(np.full(k, min(n, width)))
            if not ids:
                continue
            begin, size = np.concatenate(begins), np.concatenate(sizes)
            offsets = np.concatenate([[0], np.cumsum(size)])
            inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(begin, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.concatenate(ids))),
                    lists(offsets, pa.array(words.hashes[inside].view(np.int64))),
                ],
                names=["item", "window"],
            )

    source = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return source.mapInArrow(cut, "item string, window array<bigint>").distinct()


class _Block:
    """Windows as one right-aligned array, and the items of each."""

    def __init__(self, rows: list, width: int):
        self.items = [r["items"] for r in rows]
        self.lengths = np.array([len(r["window"]) for r in rows], np.int64)
        self.phrases = np.zeros((len(rows), width), np.uint64)
        for k, r in enumerate(rows):
            self.phrases[k, width - len(r["window"]) :] = np.array(r["window"], np.int64).view(np.uint64)


def _shards(words: Words, width: int):
    """Runs of pieces (first word, last word) that fit in one index.

    A text too long for one index is cut into pieces that share ``width - 1`` words, so that every
    window lies in some piece.
    """
    run, used = [], 0
    most = MOST_SYMBOLS - 1
    for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        at = first
        while at < last:
            end = min(last, at + most)
            if used + end - at + 1 > MOST_SYMBOLS:
                yield run
                run, used = [], 0
            run.append((at, end))
            used += end - at + 1
            if end == last:
                break
            at = end - (width - 1)
    if run:
        yield run


def find_hits(words: Words, block: _Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in these texts."""
    found: list[np.ndarray] = []
    places: list[np.ndarray] = []
    for run in _shards(words, width):
        index = FMIndex([words.hashes[a:b] for a, b in run])
        which, low, high = index.search(block.phrases, block.lengths)
        if not len(which):
            continue
        n = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        which = np.repeat(which, n)
        begins = np.array([a for a, _ in run], np.int64)
        sizes = np.array([b - a for a, b in run], np.int64)
        shift = begins - np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = index.word_at[index.locate(rows)]
        at += shift[np.searchsorted(np.cumsum(sizes), at, "right")]
        # the index names words by 44 bits of their hash; compare all 64
        same = np.ones(len(at), bool)
        for back in range(1, width + 1):
            within = np.flatnonzero(block.lengths[which] >= back)
            word = at[within] + block.lengths[which[within]] - back
            same[within] &= words.hashes[word] == block.phrases[which[within], width - back]
        found.append(which[same])
        places.append(at[same])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def _code_points(words: Words, text: int, places: list[int]) -> list[int]:
    raw = words.data[words.offsets[text] : words.offsets[text + 1]]
    starts = np.cumsum((raw & 0xC0) != 0x80)
    return [0 if p == 0 else int(starts[p - 1]) for p in places]


def _judge(texts: pa.Array, before: tuple | None, block: _Block, width: int) -> list[pa.Array]:
    words = words_of(texts)
    which, at = find_hits(words, block, width)
    n = len(words.bounds) - 1
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    text_of = np.searchsorted(words.bounds, at, "right") - 1
    items: list[set] = [set() for _ in range(n)]
    if before is not None:
        old_items, old_spans = before
        for i, names in enumerate(old_items):
            items[i].update(names)
            for first, last in old_spans[i]:
                hit[words.bounds[i] + first : words.bounds[i] + last] = True
    for k in np.unique(text_of * len(block.items) + which).tolist() if len(which) else []:
        items[k // len(block.items)].update(block.items[k % len(block.items)])
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.bounds[1:]] - total[words.bounds[:-1]]
    spans: list[list] = [[] for _ in range(n)]
    for i in np.flatnonzero(n_hit).tolist():
        first = int(words.bounds[i])
        marks = np.diff(hit[first : words.bounds[i + 1]].astype(np.int8), prepend=0, append=0)
        spans[i] = list(zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist(), strict=True))
    names = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
    return [pa.array(np.diff(words.bounds)), pa.array(n_hit), names, spans, words]


def _span_array(spans: list[list], words: Words, in_words: bool) -> pa.Array:
    out = []
    for i, own in enumerate(spans):
        if own and not in_words:
            first, offset = words.bounds[i], words.offsets[i]
            begin = _code_points(words, i, [int(words.starts[first + a] - offset) for a, _ in own])
            end = _code_points(words, i, [int(words.ends[first + b - 1] - offset) for _, b in own])
            own = list(zip(begin, end, strict=True))
        out.append([{"start": a, "end": b} for a, b in own])
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.array(out, pa.list_(kind))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    block_windows: int = BLOCK_WINDOWS,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items and spans: what each text shares with the benchmark.

    A window is ``width`` consecutive words of an item, or all words of a shorter one. ``n_hit``
    counts the document's words inside any occurrence of any window, ``items`` names the items,
    ``spans`` are the merged stretches in code points, end exclusive. Columns of ``docs`` with one
    of these names are replaced. The benchmark's windows go to the tasks in blocks of a bounded
    size; with several blocks each text passes through one index per block.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, item_col, item_text_col, width).groupBy("window").agg(
        F.sort_array(F.collect_list("item")).alias("items")
    )
    # an item id may be null: it is no name, but its windows still hit
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    out = docs
    for k in range(blocks):
        own = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(_Block(own.collect(), width))
        last = k == blocks - 1

        def task(batch, block=block, first=k == 0, last=last):
            texts = batch.column(batch.schema.get_field_index(text_col))
            before = None
            if not first:
                spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
                pairs = [[(s["start"], s["end"]) for s in own] for own in spans]
                before = batch.column(batch.schema.get_field_index("items")).to_pylist(), pairs
            *counts, spans, words = _judge(texts, before, block.value, width)
            return [*counts, _span_array(spans, words, not last)]

        out = map_batches(out, RESULT, task, () if keep_text or not last else (text_col,))
    return out
