"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's items are its runs of three words, each labelled with how often it has occurred before, so
repeats count. A sketch takes the two items of least hash and keeps the order in which they stand in
the text; two texts agree on it more often the smaller their edit distance is, while moved passages
make them differ. Texts that agree on any of 48 sketches share a bucket. Texts of up to 40 words have
48 sketches of their three least single words in text order, as an edit leaves few of their runs.

Texts with the same words are one node. First every node is compared with one hub, of all nodes that share a
bucket with it and may be as long the one in most buckets, so that a large group of near copies is one class
after about a pair each. A group that no hub joins, as its nodes are only just alike, is joined in a few rounds in
which each node is compared with a few nodes of other classes, others in each round. Buckets whose nodes are not
all in one class then have all their pairs of different classes compared by counts of hashed words, which never
exclude a pair that is alike. Nodes that may be like another one meet again with their words and are aligned
inside the bucket, which returns no pairs but links, fewer than it has nodes; a pair is aligned in one of the buckets
that it shares. So a bucket gives all links between its classes, and rows do not grow with the square of a
group, though the comparisons of nodes that stay apart do. Buckets with many nodes are cut into blocks, and each pair of blocks
is a group of its own. A pair is linked if its word alignment, in a band no wider than the edits
allowed, has a similarity of at least 0.8: ``1 - edits / longer length``. Classes are the connected
components.

Words are those of ``words``: lower-cased runs of letters, digits and non-ASCII characters; in
alignments a word is 32 bits of its hash.

Defined results: null counts as the empty text; texts without words are alike only if equal; a class's
id is its least doc_id (null if all are null); repeated ids are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvflow.llm.alignment import alike
from kvflow.llm.common import in_block_pairs, lists, map_batches, pieces, spread, stored, whole_groups
from kvflow.llm.components import components
from kvflow.llm.words import Words, mix, windows, words_of

SHINGLE = 3
#: Sketches made in one turn, and turns.
SKETCHES, TURNS = 16, 3
SIMILARITY = 0.8
#: Texts of up to SHORT words have sketches of words, texts from LONG words on of runs; LONG is SHORT
#: times the similarity, so that two texts that are alike always have one kind in common.
SHORT, LONG, SHORT_LEAST = 40, 32, 3
#: Counts of hashed words by which pairs are ruled out.
BINS = 128
#: Nodes of one bucket that meet in one group, and their words where they come with them.
GROUP_NODES, GROUP_WORDS = 4096, 1 << 22
#: Pairs of a group that are aligned before the next ones are chosen.
FIRST = 1024
#: Rounds in which a node is compared with a few partners, partners a round, and nodes of a bucket among which one is
#: looked for; there is no further round if fewer than one in LEAST_JOINED of its pairs are links.
PARTNER_ROUNDS, PARTNERS, REACH, LEAST_JOINED = 6, 4, 32, 20
#: Bits of the map of nodes whose words are needed: 8 MB.
NEED_BITS = 26
#: Pairs of one representative that are aligned in one go, and salts of a representative's pairs.
SALT_PAIRS = 512
_U = np.uint64
_LAST = _U(0xFFFFFFFFFFFFFFFF)
_FACTORS = (mix(np.arange(101, 101 + SKETCHES * TURNS, dtype=np.uint64)) | _U(1)).reshape(TURNS, SKETCHES)
_CHUNK = 1 << 17
_GROUP_ROWS = 1 << 14


def _items(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """One hash per run of words; a run met before in the text gets another with each occurrence."""
    found = windows(hashes, shingle) if len(hashes) >= shingle else windows(hashes, max(len(hashes), 1))
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    same = np.zeros(len(found), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    if same.any():
        place = np.arange(len(found))
        first = np.maximum.accumulate(np.where(same, 0, place))
        again = np.empty(len(found), np.uint64)
        again[order] = (place - first).astype(np.uint64)
        found = np.where(again > 0, mix(found + again * _U(0x9E3779B97F4A7C15)), found)
    return found


def _sketch(items: np.ndarray, starts: np.ndarray, turn: int = 0) -> np.ndarray:
    """(texts, sketches): the two least items of each text in their order, hashed together."""
    sizes = np.diff(np.append(starts, len(items)))
    out = np.empty((len(starts), SKETCHES), np.uint64)
    for j, factor in enumerate(_FACTORS[turn]):
        values = items * factor
        one = np.minimum.reduceat(values, starts)
        at = np.flatnonzero(values == np.repeat(one, sizes))
        values[at] = _LAST
        two = np.minimum.reduceat(values, starts)
        then = np.flatnonzero((values == np.repeat(two, sizes)) & (np.repeat(sizes, sizes) > 1))
        later = np.zeros(len(starts), bool)
        later[sizes > 1] = then > at[sizes > 1]
        low, high = np.where(later, one, two), np.where(later, two, one)
        out[:, j] = mix(low * _U(3) + mix(high) + _U(turn * SKETCHES + j))
    return out


def _word_sketch(items: np.ndarray, starts: np.ndarray, turn: int) -> np.ndarray:
    """(texts, sketches): the least items of each short text in their order, hashed together."""
    sizes = np.diff(np.append(starts, len(items)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    out = np.empty((len(starts), SKETCHES), np.uint64)
    for j, factor in enumerate(_FACTORS[turn]):
        values = items * factor
        # a text of fewer words has nothing at the last places
        place = np.full((len(starts), SHORT_LEAST), len(items))
        least = np.full((len(starts), SHORT_LEAST), _LAST)
        for k in range(SHORT_LEAST):
            one = np.minimum.reduceat(values, starts)
            at = np.flatnonzero((values == one[owner]) & (sizes > k)[owner])
            place[owner[at], k] = at
            least[owner[at], k] = values[at]
            values[at] = _LAST
        least = np.take_along_axis(least, np.argsort(place, axis=1, kind="stable"), axis=1)
        found = np.full(len(starts), 1000 + turn * SKETCHES + j, np.uint64)
        for k in range(SHORT_LEAST):
            found = mix(found * _U(3) + least[:, k])
        out[:, j] = found
    return out


def _key(words: Words, i: int) -> bytes:
    """16 bytes that stand for a text's words, or for the text if it has none."""
    first, last = words.bounds[i], words.bounds[i + 1]
    if first < last:
        return blake2b(words.hashes[first:last].tobytes(), digest_size=16).digest()
    text = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
    return blake2b(text, digest_size=16, person=b"no words").digest()


def _counts(words: Words) -> np.ndarray:
    """(texts, BINS): how many words of each text fall in each bin, up to 255."""
    n = len(words.bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(words.bounds))
    bins = (words.hashes[words.bounds[0] : words.bounds[-1]] >> _U(40)).astype(np.int64) % BINS
    return np.minimum(np.bincount(owner * BINS + bins, minlength=n * BINS), 255).astype(np.uint8)


def sketches(texts: pa.Array, shingle: int = SHINGLE) -> list[pa.Array]:
    """(key, buckets, size, bins) of each text: key stands for its words, buckets is empty if it has none."""
    words = words_of(texts)
    bounds, n = words.bounds.tolist(), len(words.bounds) - 1
    sizes = np.diff(words.bounds)
    kinds = SKETCHES * TURNS
    buckets = np.zeros((n, 2 * kinds), np.uint64)
    has = np.repeat(np.stack([sizes >= LONG, (sizes > 0) & (sizes <= SHORT)], axis=1), kinds, axis=1)

    def fill(chosen: np.ndarray, run: int, first: int, make) -> None:
        rows, parts, total = [], [], 0
        for i in chosen.tolist():
            rows.append(i)
            parts.append(_items(words.hashes[bounds[i] : bounds[i + 1]], run))
            total += len(parts[-1])
            if total > _CHUNK or i == chosen[-1]:
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
                items = np.concatenate(parts)
                for turn in range(TURNS):
                    at = first + turn * SKETCHES
                    buckets[rows, at : at + SKETCHES] = make(items, starts, turn)
                rows, parts, total = [], [], 0

    fill(np.flatnonzero(has[:, 0]), shingle, 0, _sketch)
    fill(np.flatnonzero(has[:, kinds]), 1, kinds, _word_sketch)
    offsets = np.concatenate([[0], np.cumsum(has.sum(axis=1))])
    counts = _counts(words).tobytes()
    return [
        pa.array([_key(words, i) for i in range(n)], pa.binary()),
        lists(offsets, pa.array(buckets[has].view(np.int64))),
        pa.array(sizes, pa.int32()),
        pa.array([counts[i * BINS : (i + 1) * BINS] for i in range(n)], pa.binary()),
    ]


def sketch_rows(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with _key, _buckets, _size and _bins of each text."""
    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = "_key binary, _buckets array<bigint>, _size int, _bins binary"
    added = docs.sparkSession.createDataFrame([], schema).schema
    return map_batches(source, added, lambda batch: sketches(batch.column(len(keep))), ("_text",))


def _bins_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def may_be_alike(
    sizes: np.ndarray, bins: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float
) -> np.ndarray:
    """Whether rows a and b may reach ``similarity`` by their sizes and counts; never false if they do.

    Each edit takes away and adds one word at most, so each side has no more words of its own than edits.
    """
    longer = np.maximum(sizes[a], sizes[b])
    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    out = longer - np.minimum(sizes[a], sizes[b]) <= most
    at = np.flatnonzero(out)
    for k in range(0, len(at), _GROUP_ROWS):
        some = at[k : k + _GROUP_ROWS]
        more = bins[a[some]].astype(np.int16) - bins[b[some]]
        total, net = np.abs(more).sum(axis=1), more.sum(axis=1)
        out[some] = (total + np.abs(net)) // 2 <= most[some]
    return out


def hub_pairs(members: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each node of ``members`` (bucket, _key) with one hub, if it meets one.

    A bucket's hub is the node that is in most buckets; a node's hub is the foremost one of its buckets
    of which the length allows a link.
    """
    degree = members.groupBy("_key").agg(F.count("*").alias("degree"))
    rows = members.join(degree.join(nodes.select("_key", "_size"), "_key"), "_key")
    hub = F.struct((-F.col("degree")).alias("less"), F.col("_key").alias("a"), F.col("_size").alias("size"))
    hubs = rows.groupBy("bucket").agg(F.min(hub).alias("hub"))
    met = rows.join(hubs, "bucket").filter(
        (F.col("_key") != F.col("hub.a"))
        & (F.least("_size", "hub.size") >= F.lit(similarity) * F.greatest("_size", "hub.size") - 1e-9)
    )
    return met.groupBy("_key").agg(F.min("hub").alias("hub")).select(F.col("hub.a").alias("a"), F.col("_key").alias("b"))


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that sizes and counts of words do not rule out."""
    one = nodes.select(F.col("_key").alias("a"), F.col("_size").alias("s"), F.col("_bins").alias("x"))
    two = nodes.select(F.col("_key").alias("b"), F.col("_size").alias("t"), F.col("_bins").alias("y"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()]).astype(np.int64)
            bins = np.concatenate([_bins_of(batch.column(3)), _bins_of(batch.column(5))])
            good = pa.array(may_be_alike(sizes, bins, np.arange(n), np.arange(n, 2 * n), similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "s", "x", "t", "y")
    return rows.mapInArrow(task, "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of whole groups (bucket, x, y) with [bucket, x, y, block, root], sizes, bins and each row's first one."""
    for table in whole_groups(batches, 3, rows):
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        bucket, x, y, block, root, sizes = (table.column(k).to_numpy() for k in (0, 1, 2, 3, 5, 6))
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
        yield table, [bucket, x, y, block, root], sizes.astype(np.int64), _bins_of(table.column(7).combine_chunks()), first


def _partner(similarity: float):
    """Rows come by group (bucket, x, y); each returns the next row of another class, in the order of the group's rows
    and round its end, that it may be like, out of ``REACH``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, (bucket, x, y, block, root), sizes, bins, first in _groups(batches, _GROUP_ROWS):
            many = np.bincount(first, minlength=len(first))[first]
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            live = np.arange(len(first))
            for step in range(1, REACH + 1):
                live = live[many[live] > step]
                if not len(live):
                    break
                other = first[live] + (live - first[live] + step) % many[live]
                apart = (root[live] != root[other]) & ((x[live] == y[live]) | (block[live] != block[other]))
                at = np.flatnonzero(apart)
                at = at[may_be_alike(sizes, bins, live[at], other[at], similarity)]
                left.append(other[at])
                right.append(live[at])
                live = np.delete(live, at)
            a, b = np.concatenate(left), np.concatenate(right)
            keys = table.column(4).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(bucket[b])], names=["a", "b", "bucket"]
            )

    return task


class Shared:
    """Which of the buckets that two nodes share has the pair: one of them, by a hash of both."""

    def __init__(self, table: pa.Table, bucket: np.ndarray):
        values = table.column(8).combine_chunks()
        sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.bucket = bucket.view(np.uint64)
        #: The buckets of each row's node; the row's own fills up.
        self.all = np.repeat(self.bucket[:, None], int(sizes.max()), axis=1)
        self.all[row, place] = values.flatten().to_numpy().view(np.uint64)
        keys = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64)
        self.name = keys.reshape(len(bucket), -1)[:, 0]

    def here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a and b, of one bucket, have their pair in it."""
        out = np.ones(len(a), bool)
        pivot = mix(self.name[a] ^ self.name[b])
        own = self.bucket[a] - pivot
        open_ = np.arange(len(a))
        for j in range(self.all.shape[1]):
            value = self.all[a[open_], j]
            ahead = np.flatnonzero(value - pivot[open_] < own[open_])
            for k in range(0, len(ahead), FIRST):
                some = ahead[k : k + FIRST]
                met = (self.all[b[open_[some]]] == value[some, None]).any(axis=1)
                out[open_[some[met]]] = False
            open_ = open_[out[open_]]
        return out


def _candidates(columns: list[np.ndarray], sizes: np.ndarray, bins: np.ndarray, first: np.ndarray, similarity: float, most: int):
    """(a, b) of rows of different classes that may be alike, about ``most`` at a time.

    Pairs whose rows have got the same root in the meantime are left out."""
    _, x, y, block, root = columns
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, live, rank = 0, np.arange(len(first)), 0
    while True:
        live = live[live - first[live] > rank]
        if len(live):
            other = first[live] + rank
            apart = (root[live] != root[other]) & ((x[live] == y[live]) | (block[live] != block[other]))
            now, other = live[apart], other[apart]
            good = may_be_alike(sizes, bins, now, other, similarity)
            held.append((other[good], now[good]))
            count += int(good.sum())
        if held and (count >= most or not len(live)):
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            apart = root[a] != root[b]
            yield a[apart], b[apart]
            held, count = [], 0
        if not len(live):
            return
        rank += 1


def _meet(similarity: float):
    """Rows come by group (bucket, x, y); returns those that may be like one of another class."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, columns, sizes, bins, first in _groups(batches, _GROUP_ROWS):
            chosen = np.zeros(len(first), bool)
            for a, b in _candidates(columns, sizes, bins, first, similarity, _GROUP_ROWS):
                chosen[a] = chosen[b] = True
            at = pa.array(np.flatnonzero(chosen))
            yield pa.RecordBatch.from_arrays(
                [table.column(k).combine_chunks().take(at) for k in (0, 4)], names=["bucket", "_key"]
            )

    return task


def _align(similarity: float):
    """Rows come by group (bucket, x, y) with their words; returns links (a, b), of each group fewer than its rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, columns, sizes, bins, first in _groups(batches, _GROUP_ROWS >> 3):
            # classes are those of a group: what one links stays apart in others
            named = np.stack([first, columns[4]], axis=1)
            columns[4] = root = np.unique(named, axis=0, return_inverse=True)[1].reshape(-1)
            words, left, right = table.column(9).combine_chunks(), [], []
            shared = Shared(table, columns[0])
            for a, b in _candidates(columns, sizes, bins, first, similarity, _GROUP_ROWS):
                here = shared.here(a, b)
                a, b = a[here], b[here]
                for k in range(0, len(a), FIRST):
                    one, two = a[k : k + FIRST], b[k : k + FIRST]
                    apart = root[one] != root[two]
                    one, two = one[apart].tolist(), two[apart].tolist()
                    own = {i: np.frombuffer(words[i].as_buffer(), np.uint32) for i in {*one, *two}}
                    good = alike([own[i] for i in one], [own[i] for i in two], similarity) if one else []
                    for g in np.flatnonzero(good).tolist():
                        if root[one[g]] != root[two[g]]:
                            root[root == root[two[g]]] = root[one[g]]
                            left.append(one[g])
                            right.append(two[g])
            keys = table.column(4).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(left, pa.int64())), keys.take(pa.array(right, pa.int64()))], names=["a", "b"]
            )

    return task


def _dealt(members: DataFrame, nodes: DataFrame, roots: DataFrame, words: float = math.inf) -> DataFrame:
    """(bucket, x, y, block, _key, root, _size, _bins) of the buckets that hold more than one class, in blocks of
    GROUP_NODES nodes and about so many words at most."""
    known = members.join(roots.withColumnRenamed("node", "_key"), "_key", "left")
    known = known.select("bucket", "_key", F.coalesce("root", "_key").alias("root"))
    blocks, sized = F.count("*") / GROUP_NODES, known
    if words < math.inf:
        sized = known.join(nodes.select("_key", "_size"), "_key")
        blocks = F.greatest(blocks, F.sum("_size") / words)
    per = sized.groupBy("bucket").agg(
        F.ceil(blocks).cast("int").alias("blocks"), F.min("root").alias("u"), F.max("root").alias("v")
    ).filter("u <> v").select("bucket", "blocks")
    # most buckets go here, so counts of words are joined to what is left
    return in_block_pairs(known, per, "_key").join(nodes.select("_key", "_size", "_bins"), "_key").select(
        "bucket", "x", "y", "block", "_key", F.xxhash64("root").alias("root"), "_size", "_bins"
    )


def _by_group(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", *order, "_key")


def partner_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b, bucket): in each bucket a node with one of another class that it may be like; which one depends on ``turn``."""
    rows = _by_group(_dealt(members, nodes, roots), F.xxhash64("_key", "bucket", F.lit(turn)))
    return rows.mapInArrow(_partner(similarity), "a binary, b binary, bucket bigint")


def _with_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` with all buckets of their node."""
    return rows.join(rows.groupBy("_key").agg(F.array_sort(F.collect_set("bucket")).alias("buckets")), "_key").select(
        *rows.columns, "buckets"
    )


def met_rows(members: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The rows (bucket, _key) of ``members`` that may be like a row of another class of their bucket."""
    rows = _by_group(_dealt(members, nodes, roots))
    return rows.mapInArrow(_meet(similarity), "bucket bigint, _key binary").distinct()


def met_links(met: DataFrame, nodes: DataFrame, roots: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join all nodes of ``met``, from ``met_rows``, that are alike in a bucket."""
    rows = _with_buckets(_dealt(met, nodes, roots, GROUP_WORDS)).join(words, "_key").select(
        "bucket", "x", "y", "block", "_key", "root", "_size", "_bins", "buckets", "words"
    )
    return _by_group(rows).mapInArrow(_align(similarity), "a binary, b binary").distinct()


def _key_bits(nodes: DataFrame) -> np.ndarray:
    """A bit for the first ``NEED_BITS`` bits of each node's key."""
    slot = F.shiftright(F.conv(F.hex(F.substring("_key", 1, 4)), 16, 10).cast("long"), 32 - NEED_BITS)
    rows = nodes.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("place")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits")
    ).toArrow()
    out = np.zeros(1 << (NEED_BITS - 6), np.uint64)
    out[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def words_by_key(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(_key, words) of ``nodes`` (_key): the words of each text, 32 bits each.

    Texts whose key's bit is not set stay where they are; a task returns equal texts once.
    """
    needed = docs.sparkSession.sparkContext.broadcast(_key_bits(nodes))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (piece for whole in batches for piece in pieces(whole)):
            words = words_of(batch.column(0))
            keys, codes = [], []
            for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                if a == b:
                    continue
                key = _key(words, i)
                slot = int.from_bytes(key[:4], "big") >> (32 - NEED_BITS)
                if int(needed.value[slot >> 6]) >> (slot & 63) & 1 and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    codes.append((words.hashes[a:b] >> _U(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(codes, pa.binary())], names=["_key", "words"]
            )

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(code, "_key binary, words binary")
    return found.join(nodes, "_key", "left_semi").dropDuplicates(["_key"])


def _verify(similarity: float):
    """Rows come sorted by representative and salt, the representative's own words before the others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, None
        for batch in batches:
            keys, others = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words, salts = batch.column(2), batch.column(3).to_pylist()
            left, right, pairs = [], [], []
            for k in range(batch.num_rows):
                now = np.frombuffer(words[k].as_buffer(), np.uint32)
                if others[k] is None:
                    name, own = (keys[k], salts[k]), now.copy()
                elif name == (keys[k], salts[k]):
                    left.append(own)
                    right.append(now)
                    pairs.append(k)
                else:
                    raise RuntimeError("a representative's words are missing")
            good = np.flatnonzero(alike(left, right, similarity)) if pairs else []
            chosen = pa.array([pairs[g] for g in good], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen)], names=["a", "b"]
            )

    return task


def verified(pairs: DataFrame, words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose words align well enough. ``words`` has a row (_key, words) per node.

    Words travel to the pairs by key. A representative's pairs are dealt over salts, each with a copy
    of its words, so that no representative fills a task.
    """
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("salts"))
    per = stored(per, "near-salts")
    many = spread(stored(per.filter("salts > 1"), "near-many"))
    salts = F.coalesce("salts", F.lit(1))
    salted = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int"))
    others = salted.join(words, F.col("b") == F.col("_key")).select("a", "b", "words", "salt")
    own = per.join(words, F.col("a") == F.col("_key")).select(
        "a", F.lit(None).cast("binary").alias("b"), "words",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    rows = own.union(others).repartition("a", "salt")
    rows = rows.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify(similarity), "a binary, b binary")


def linked(rows: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """(node, root) of the classes of all nodes that have links; ``rows`` are stored sketch_rows."""
    nodes = stored(rows.filter(F.size("_buckets") > 0).dropDuplicates(["_key"]), "near-nodes")
    every = nodes.select("_key", F.explode("_buckets").alias("bucket"))
    nodes = spread(nodes.select("_key", "_size", "_bins"))
    many = F.count("*").over(Window.partitionBy("bucket"))
    members = stored(every.withColumn("many", many).filter("many > 1").select("bucket", "_key"), "near-members")
    words = stored(words_by_key(docs, text_col, members.select("_key").distinct()), "near-words")
    pairs, links = None, None
    roots = nodes.select(F.col("_key").alias("node"), F.col("_key").alias("root")).limit(0)

    def compared(found: DataFrame, by_counts: bool = True) -> tuple[int, int]:
        """Verify the pairs that were not compared before; how many there are, and how many links."""
        nonlocal pairs, links, roots
        new = found.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).dropDuplicates(["low", "high"])
        if pairs is not None:
            new = new.join(pairs.select("low", "high"), ["low", "high"], "left_anti")
        new = stored(new, "near-pairs")
        if new.isEmpty():
            return 0, 0
        pairs = new if pairs is None else pairs.union(new)
        near = new.select("a", "b")
        if not by_counts:
            near = stored(plausible(near, nodes, similarity), "near-plausible")
        good = stored(verified(near, words, similarity), "near-links")
        links = good if links is None else links.union(good)
        roots = spread(components(links))
        return new.count(), good.count()

    compared(hub_pairs(members, nodes, similarity), by_counts=False)
    some = members
    for turn in range(PARTNER_ROUNDS):
        found = stored(partner_pairs(some, nodes, roots, similarity, turn), "near-partners")
        few = found.groupBy("b").agg(F.slice(F.array_sort(F.collect_set("a")), 1, PARTNERS).alias("a"))
        tried, joined = compared(few.select(F.explode("a").alias("a"), "b"))
        if joined * LEAST_JOINED <= tried:
            break
        some = stored(some.join(found.select("bucket").distinct(), "bucket", "left_semi"), "near-some")
    met = stored(met_rows(members, nodes, roots, similarity), "near-met")
    good = stored(met_links(met, nodes, roots, words, similarity), "near-links")
    return roots if good.isEmpty() else components(good if links is None else links.union(good))


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: id, _key (equal for equal words), class_id, class_key.

    A class's id and key are those of its member of least id.
    """
    rows = stored(sketch_rows(docs, text_col, [id_col]), "near-sketches")
    roots = linked(rows, docs, text_col, similarity).select(F.col("node").alias("_key"), F.col("root"))
    member = rows.select(id_col, "_key").join(roots, "_key", "left").select(
        id_col, "_key", F.coalesce("root", "_key").alias("_root")
    )
    order = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col("_key").alias("key"))
    least = member.groupBy("_root").agg(F.min(order).alias("first"))
    return member.join(least, "_root").select(
        id_col, "_key", F.col("first.id").alias("class_id"), F.col("first.key").alias("class_key")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if one document of each class does: the one of least id.

    Rows that share id and words are repeats of one document, of which one stays. Columns are kept, whatever
    their names.
    """
    firsts = near_classes(docs, id_col, text_col).select(
        F.col("class_id").alias("_id"), F.col("class_key").alias("_key")
    ).distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    source = docs.select(F.col(text_col).alias("_text"), F.struct(F.lit(0).alias("_"), *others).alias("_columns"))
    added = docs.sparkSession.createDataFrame([], "_key binary").schema

    def name(batch: pa.RecordBatch) -> list[pa.Array]:
        words = words_of(batch.column(0).cast(pa.large_string()))
        return [pa.array([_key(words, i) for i in range(batch.num_rows)], pa.binary())]

    keyed = map_batches(source, added, name).withColumn("_id", F.col(f"_columns.`{id_col}`"))
    same = F.col("k._id").eqNullSafe(F.col("f._id")) & (F.col("k._key") == F.col("f._key"))
    kept = keyed.alias("k").join(firsts.alias("f"), same, "left_semi").dropDuplicates(["_key", "_id"])
    return kept.select(*[
        F.col("_text").alias(c) if c == text_col else F.col("_columns").getField(c).alias(c) for c in docs.columns
    ])
