"""Line deduplication as an exact set-similarity join.

A line is the set of its words. Words are ordered from rare to common; two sets with a Jaccard
similarity of at least ``t`` share a word among the first ``n - ceil(t n) + 1`` of each, so lines meet
by these prefix words. Before a pair is verified it has to pass the length filter, the positional
filter (what is left behind the shared word bounds the overlap) and a bound from 128-bit parity maps
of the sets. A line is removed if an earlier line, by (doc_id, line number), is that similar to it.

Equal sets are one: their first line stands for them. In the group of a prefix word each line returns
its earliest candidates only, a fixed number; lines whose candidates all fail and that may have more
come again with the next ones, until none is left. So no group emits all pairs and no candidate is
missed. Words with very many lines are cut into blocks, and each pair of blocks is a group of its own.

Rarity comes from a fixed table of 2^20 counters by word hash, two bytes each; any order is exact, a
shared counter only makes a word look more common. A word that a single set has in its prefix needs no
group: a bit map of fixed size, by word hash, tells which words two different sets share. Such maps also
tell a task which texts and lines may be needed again. A hash that two words share only lets more pass.

Defined results: a null text is an empty text, which has one empty line; lines without words stay;
null ids come last; rows that repeat both id and text are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.llm.common import pieces, stored
from kvflow.llm.words import Words, words_of

SIMILARITY = 0.8
SLOTS = 1 << 20
#: Lines of one word that meet in one group; words with more are cut into blocks of so many.
GROUP_LINES = 8192
#: Candidates that a line returns per word and round.
FIRST, NEXT = 4, 16
#: Bits of the maps of shared prefix words, and of needed texts and lines: 2 and 8 MB.
WORD_BITS, NEED_BITS = 1 << 24, 1 << 26
_PAIRS = 1 << 21
_U = np.uint64


def _line_bounds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each line and the end, lines of each text as bounds)."""
    breaks = np.flatnonzero(words.data == 10) + 1
    marks = np.sort(np.concatenate([words.offsets[:-1], breaks]))
    before = np.searchsorted(breaks, words.offsets, "right")
    # an empty text has one line; line breaks of a text lie behind its begin
    lines = np.arange(len(words.offsets)) + before
    return np.append(np.searchsorted(words.starts, marks), len(words.starts)), lines


def counters(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often the words of each slot occur, at most 65,535."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in (piece for whole in batches for piece in pieces(whole)):
            words = words_of(batch.column(0))
            total += np.bincount((words.hashes >> _U(44)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "slot int, n long")
    summed = rows.groupBy("slot").agg(F.least(F.sum("n"), F.lit(65535)).cast("int").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint16)
    out[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    return out


def _sets(words: Words, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each line from rare to common, as counter and hash in 64 bits; lines per text."""
    count = table[(words.hashes >> _U(44)).astype(np.int64)].astype(np.uint64)
    codes = (count << _U(48)) | (words.hashes & _U((1 << 48) - 1))
    bounds, lines = _line_bounds(words)
    return [np.unique(codes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], lines


def _key(codes: np.ndarray) -> bytes:
    return blake2b(codes.tobytes(), digest_size=16).digest()


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def _parity(codes: np.ndarray) -> bytes:
    """128 bits, each flipped by every word that falls on it."""
    bit = (codes * _U(0x9E3779B97F4A7C15)) >> _U(57)
    odd = np.bincount(bit.astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _bit_map(slots: DataFrame, bits: int) -> np.ndarray:
    """The values of column ``slot`` as bits; the driver gets one number for every 64 of them."""
    rows = slots.groupBy(F.expr("slot div 64").alias("place")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("set")
    ).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("place").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return out


def _in_map(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & _U(1) == 1


def _key_slot(key):
    """Which bit stands for a set: 26 bits of its key."""
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(NEED_BITS - 1))


def prefix_rows(lines: DataFrame) -> DataFrame:
    """(word, id, line, n, place, load) of prefix words that two sets or more have; load: key, parity."""
    spark = lines.sparkSession
    own = lines.filter("prefix IS NOT NULL")
    slots = own.select(F.explode("prefix").alias("word"), F.xxhash64("key").alias("h")).filter(
        F.shiftrightunsigned("word", 48) > 1
    )
    slots = slots.groupBy(F.col("word").bitwiseAND(F.lit(WORD_BITS - 1)).alias("slot")).agg(
        F.min("h").alias("low"), F.max("h").alias("high")
    )
    shared = spark.sparkContext.broadcast(_bit_map(slots.filter("low <> high"), WORD_BITS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(3)
            words = prefix.flatten().to_numpy()
            sizes = pa.compute.list_value_length(prefix).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = (words.view(np.uint64) >> _U(48) > 1) & _in_map(shared.value, words & (WORD_BITS - 1))
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words[keep]), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at),
                    pa.array(place[keep].astype(np.int32)), batch.column(4).take(at),
                ],
                names=["word", "id", "line", "n", "place", "load"],
            )

    source = own.select("id", "line", "n", "prefix", F.concat("key", "parity").alias("load"))
    kind = dict(lines.dtypes)["id"]
    return source.mapInArrow(spread, f"word long, id {kind}, line int, n int, place int, load binary")


def line_rows(docs: DataFrame, id_col: str, text_col: str, table, similarity: float) -> DataFrame:
    """(id, _row, line, key, n, prefix, parity); only a task's first line of a set has prefix and parity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (piece for whole in batches for piece in pieces(whole)):
            words = words_of(batch.column(2))
            sets, lines = _sets(words, table.value)
            text = np.repeat(np.arange(batch.num_rows), np.diff(lines))
            keys, sizes, prefixes, parities = [], [], [], []
            for codes in sets:
                n = len(codes)
                key = _key(codes) if n else None
                fresh = n > 0 and key not in seen
                if fresh:
                    seen.add(key)
                keys.append(key)
                sizes.append(n)
                prefixes.append(codes[: prefix_length(n, similarity)].view(np.int64) if fresh else None)
                parities.append(_parity(codes) if fresh else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)),
                    pa.array((np.arange(len(sets)) - lines[text]).astype(np.int32)), pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.binary()),
                ],
                names=["id", "_row", "line", "key", "n", "prefix", "parity"],
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("_row"), text.alias("text"))
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(
        cut, f"id {kind}, _row long, line int, key binary, n int, prefix array<bigint>, parity binary"
    )


def _candidates(low: int, high: int, similarity: float):
    """Rows come by group in order of first line. Returns for each seeking line the candidates from its
    ``low``-th to before its ``high``-th, and whether there are more."""

    def scan(group: np.ndarray, word: np.ndarray, size: np.ndarray, place: np.ndarray, maps: np.ndarray,
             keys: np.ndarray, seek: np.ndarray, block: np.ndarray, cross: np.ndarray):
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.repeat(start, np.diff(np.append(start, len(group))))
        rows = np.flatnonzero(seek)
        before = (rows - first[rows]).astype(np.int64)
        rows, before = rows[before > 0], before[before > 0]
        ends = np.cumsum(before)
        at = 0
        while at < len(rows):
            done = int(ends[at] - before[at])
            to = max(at + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
            n = before[at:to]
            b = np.repeat(rows[at:to], n)
            a = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows[at:to]], n)
            at = to
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            keep = small >= similarity * large - 1e-9
            keep &= ~cross[b] | (block[a] != block[b])
            a, b = a[keep], b[keep]
            need = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - 1e-9)
            keep = 1 + np.minimum(size[a] - place[a], size[b] - place[b]) - 1 >= need
            a, b, need = a[keep], b[keep], need[keep]
            apart = np.bitwise_count(maps[a, 0] ^ maps[b, 0]).astype(np.int64) + np.bitwise_count(maps[a, 1] ^ maps[b, 1])
            keep = (apart <= size[a] + size[b] - 2 * need) & (keys[a] != keys[b])
            a, b = a[keep], b[keep]
            if not len(b):
                continue
            begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            rank = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
            chosen = (rank >= low) & (rank < high)
            more = np.zeros(len(b), bool)
            more[chosen] = (np.repeat(np.diff(np.append(begin, len(b))), np.diff(np.append(begin, len(b)))) > high)[chosen]
            yield b[chosen], a[chosen], more[chosen]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows)
            if not t.num_rows:
                return
            word, part = t["word"].to_numpy(), t["part"].to_numpy()
            group = np.cumsum(np.concatenate([[True], (word[1:] != word[:-1]) | (part[1:] != part[:-1])]))
            load = _fixed(t["load"], np.dtype([("key", "V16"), ("map", "<u8", 2)]))
            keys = np.frombuffer(load["key"].tobytes(), np.dtype([("x", "<u8"), ("y", "<u8")]))
            # of a set's lines in a group the first one stays
            order = np.lexsort((np.arange(len(keys)), keys["y"], keys["x"], group))
            same = np.zeros(len(keys), bool)
            g, x, y = group[order], keys["x"][order], keys["y"][order]
            same[1:] = (g[1:] == g[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            keep = np.ones(len(keys), bool)
            keep[order[same]] = False
            at = np.flatnonzero(keep)
            maps, both = load["map"][at], keys["x"][at] ^ (keys["y"][at] * _U(3))
            found = list(scan(
                group[at], word[at], t["n"].to_numpy()[at].astype(np.int64), t["place"].to_numpy()[at].astype(np.int64),
                maps, both, t["seek"].to_numpy(zero_copy_only=False)[at], t["block"].to_numpy()[at],
                t["cross"].to_numpy(zero_copy_only=False)[at],
            ))
            if found:
                names = load["key"][at]
                b, a, more = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[k].tobytes() for k in b], pa.binary()),
                        pa.array([names[k].tobytes() for k in a], pa.binary()), pa.array(more),
                    ],
                    names=["b", "a", "more"],
                )

        for batch in batches:
            # whole groups only: the last one may go on in the next batch
            last = (batch.column(0)[batch.num_rows - 1], batch.column(1)[batch.num_rows - 1])
            same = np.flatnonzero(
                (batch.column(0).to_numpy() != last[0].as_py()) | (batch.column(1).to_numpy() != last[1].as_py())
            )
            cut = int(same[-1]) + 1 if len(same) else 0
            if cut:
                yield from work([*waiting, batch.slice(0, cut)])
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield from work(waiting)

    return task


def _fixed(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """Binary values of one size as an array of records."""
    values = column.combine_chunks()
    values = values.cast(pa.binary(kind.itemsize))
    raw = np.frombuffer(values.buffers()[1], np.uint8)[values.offset * kind.itemsize :][: len(values) * kind.itemsize]
    return raw.view(kind)


def _hot_words(prefixes: DataFrame) -> DataFrame | None:
    """(word, blocks) of words with more lines than one group takes; None if there are none."""
    # a word's counter bounds its lines, so few words have to be counted
    hot = prefixes.filter(F.shiftrightunsigned("word", 48) > min(GROUP_LINES, 65534))
    many = hot.groupBy("word").agg(F.ceil(F.count("*") / GROUP_LINES).cast("int").alias("blocks"))
    many = stored(many.filter("blocks > 1"), "line-hot-words")
    return None if many.isEmpty() else many


def _groups(prefixes: DataFrame, many: DataFrame | None) -> DataFrame:
    """Prefix rows with their group (word, part); words with many lines get a part per pair of blocks."""
    if many is None:
        return prefixes.withColumns({"part": F.lit(0), "block": F.lit(0), "cross": F.lit(False)})
    rows = prefixes.join(many, "word", "left").withColumn(
        "block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("load"), F.col("blocks")).cast("int")).otherwise(0)
    )
    other = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_other", F.explode(other))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    return rows.select(
        "word", (low * F.coalesce("blocks", F.lit(1)) + high).alias("part"), "id", "line", "n", "place", "load",
        "seek", "block", (low != high).alias("cross"),
    )


def matched_sets(lines: DataFrame, texts_sets, similarity: float) -> DataFrame:
    """(key) of each set that is similar to one whose first line is earlier; lines that tie in id and
    number are ordered by key."""
    spark = lines.sparkSession
    # made anew in every round and not stored, as they are several times the lines
    prefixes = prefix_rows(lines)
    key = F.substring("load", 1, 16)
    many = _hot_words(prefixes)
    matched, seeking, low, high = None, None, 0, FIRST
    while True:
        if seeking is None:
            rows = prefixes.withColumn("seek", F.lit(True))
        else:
            # both are small after the first round, and written, so Spark knows that they are
            words = stored(prefixes.join(seeking, key == seeking["key"], "left_semi").select("word").distinct(), "line-words")
            flags = seeking.withColumn("seek", F.lit(True))
            rows = prefixes.join(words, "word", "left_semi").join(flags, key == flags["key"], "left").drop("key")
            rows = rows.fillna(False, ["seek"])
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = _groups(rows, many).repartition(n, "word", "part").sortWithinPartitions(
            "word", "part", F.col("id").asc_nulls_last(), "line", "load"
        )
        found = dealt.select("word", "part", "n", "place", "load", "seek", "block", "cross").mapInArrow(
            _candidates(low, high, similarity), "b binary, a binary, more boolean"
        )
        found = stored(found.groupBy("b", "a").agg(F.max("more").alias("more")), "line-candidates")
        if found.isEmpty():
            break
        good = stored(_verify(lines, found, texts_sets, similarity), "line-matched")
        matched = good if matched is None else matched.union(good)
        seeking = stored(found.filter("more").select(F.col("b").alias("key")).distinct().join(good, "key", "left_anti"), "line-seeking")
        if seeking.isEmpty():
            break
        low, high = high, high + NEXT * (high - low)
    if matched is None:
        return lines.select("key").limit(0)
    return matched.distinct()


def _verify(lines: DataFrame, pairs: DataFrame, texts_sets, similarity: float) -> DataFrame:
    """(key) of the lines that are similar enough to a candidate."""
    spark = lines.sparkSession
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "line-needed")
    holders = lines.filter("prefix IS NOT NULL").select("key", "_row").join(needed, "key", "left_semi")
    keys = _bit_map(needed.select(_key_slot(F.col("key")).alias("slot")), NEED_BITS)
    texts = _bit_map(holders.select(F.col("_row").bitwiseAND(F.lit(NEED_BITS - 1)).alias("slot")), NEED_BITS)
    sets = texts_sets(spark.sparkContext.broadcast(keys), spark.sparkContext.broadcast(texts))
    sets = stored(sets.join(needed, "key", "left_semi").dropDuplicates(["key"]), "line-sets")
    left = sets.select(F.col("key").alias("a"), F.col("words").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("words").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.filter(common >= F.lit(similarity) * union - 1e-9).select(F.col("b").alias("key")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, _row (hash of id and text), n_lines, n_equal, n_near, removed.

    ``removed`` has the numbers of the lines that go, from 0: n_equal of them have the words of an
    earlier line, n_near are similar to one.
    """
    table = docs.sparkSession.sparkContext.broadcast(counters(docs, text_col))
    lines = stored(line_rows(docs, id_col, text_col, table, similarity), "lines")

    def sets(keys, texts) -> DataFrame:
        """(key, words) of the sets whose bits are set, out of the texts whose bits are."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                wanted = _in_map(texts.value, batch.column(0).to_numpy() & (NEED_BITS - 1))
                for piece in pieces(batch.filter(pa.array(wanted))):
                    names, codes = [], []
                    for own in _sets(words_of(piece.column(1)), table.value)[0]:
                        key = _key(own) if len(own) else None
                        if key is None or key in seen:
                            continue
                        slot = int.from_bytes(key[:4], "big") & (NEED_BITS - 1)
                        if int(keys.value[slot >> 6]) >> (slot & 63) & 1:
                            seen.add(key)
                            names.append(key)
                            codes.append(own.view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["key", "words"]
                    )

        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        source = docs.select(F.xxhash64(id_col, text).alias("_row"), text.alias("text"))
        return source.mapInArrow(cut, "key binary, words array<bigint>")

    near = matched_sets(lines, sets, similarity).withColumn("near", F.lit(True))
    place = F.struct(F.col("id").isNull().alias("u"), "id", "line", "_row")
    firsts = lines.filter("n > 0").groupBy("key").agg(F.min(place).alias("first")).join(near, "key", "left")
    judged = lines.drop("prefix", "parity").join(firsts, "key", "left").select(
        "id", "_row", "line",
        F.coalesce(place != F.col("first"), F.lit(False)).alias("equal"), F.coalesce("near", F.lit(False)).alias("near"),
    )
    return judged.distinct().groupBy("id", "_row").agg(
        F.count("*").alias("n_lines"),
        F.count_if("equal").alias("n_equal"),
        F.count_if(F.col("near") & ~F.col("equal")).alias("n_near"),
        F.array_sort(F.collect_list(F.when(F.col("equal") | F.col("near"), F.col("line")))).alias("removed"),
    ).withColumnRenamed("id", id_col)


def without_lines(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the lines that ``judged`` (from ``dedup_lines``) removes; null texts stay null.

    All other columns stay as they are, whatever their names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(text_col).alias("_text"), F.struct(F.lit(0).alias("_"), *columns).alias("_columns"),
        F.xxhash64(id_col, text).alias("_row"), F.col(id_col).alias("_id"),
    )
    removed = judged.select(F.col(id_col).alias("_id"), "_row", "removed")
    same = (F.col("d._row") == F.col("r._row")) & F.col("d._id").eqNullSafe(F.col("r._id"))
    met = keyed.alias("d").join(removed.alias("r"), same, "left")
    kept = F.filter(F.split(F.col("_text"), "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    done = F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("_text"))
    return met.select(*[
        done.alias(c) if c == text_col else F.col("_columns").getField(c).alias(c) for c in docs.columns
    ])
