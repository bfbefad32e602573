"""Exact Jaccard join of word n-grams by partitioning their universe.

Two sets of n-grams link when ``100 * intersection >= threshold * union``, i.e. when they differ in at most
``H = floor((100 - t) (|r| + |s|) / (100 + t))`` n-grams. Sets are indexed by size band; a band of sizes up
to ``hi`` cuts the universe by hash into m segments. If a set r looks for s in s's band and gives segment i
a budget v_i of 0, 1 or 2 with a sum of H + 1, then in some segment the two differ in fewer than v_i n-grams
(pigeonhole): segments of budget 1 have to be equal, those of budget 2 equal but for one n-gram that one
side has more. So s is indexed by the hash of each segment and by those of each segment less one
n-gram; r asks for its segments, and where the budget is 2 also for its segments less one n-gram and for
indexed segments that have one more. Sizes that link lie in r's own band and the one below.

Budgets are allocated by cost: counters of indexed hashes, of fixed size, tell how many sets each
question would meet, and the H + 1 cheapest steps are taken. Segments that very many sets have in common (a shared
passage) so get no budget, and rarer ones two. Any allocation is exact; the counters' collisions
only cost time. Hashes less one n-gram are indexed only where a bit map says that someone asks for them, and so
are empty segments.

The segments are those of 32-bit hashes of n-grams: n-grams that share a hash only make two sets look more alike,
so no link is missed and less is stored. Pairs that meet in a bucket are compared there by a parity map of
a few bits per n-gram (sets that differ in few n-grams have maps that differ in few bits), and only those that
pass leave the bucket, to have the exact difference of their 32-bit hashes taken. What is left is verified by 64-bit hashes, made once more for these sets only;
should one of these links not hold, the search goes on from the links that do.

Equal sets are one node. Sets that meet in a bucket are compared until all of a bucket are in one
component or every pair of different components that the sizes allow has been compared: first each node
with one hub, the node in most buckets; then, in a few rounds, with one node of another component that
passes; then with all. A bucket of very many sets is cut in blocks, and each pair of blocks is a group. So near copies of one text cost about a pair each, and no link between components is missed.

Defined results: words are the longest runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased; a text of fewer
words than n is one n-gram; a text without words (or null) has an empty set, which links with nothing; a component's id is
its least id, null only if all are null; repeated ids are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvflow.llm.common import in_block_pairs, pieces, spread, stored, whole_groups, written
from kvflow.llm.components import components
from kvflow.llm.words import NOT_SPACE, mix, windows, words_of
from kvflow.sources.paths import delete_path

NGRAM, THRESHOLD = 4, 85
#: Bits of a set's parity map, for each of its n-grams.
MAP_BITS = 1
#: Bytes of a set's key.
KEY_BYTES = 12
#: Bits of the maps of asked hashes and of needed sets (8 MB each), and of each of the two tables of counters: one for so many
#: n-grams, between the bounds (32 MB at most).
ASKED_BITS, COUNTER_GRAMS, COUNTER_BITS = 26, 256, (12, 22)
#: Rounds in which each node is compared with one other, before all are.
SINGLE_ROUNDS = 1
#: Sets of one bucket that meet in one group, and rows of groups that are worked on together.
GROUP_SETS, _GROUP_ROWS = 4096, 1 << 14
#: n-grams that are worked on together.
_CHUNK = 1 << 20
_INDEX, _PROBE = 1, 2
_EQUAL, _LESS = 0, 1
_U = np.uint64


# ---------------------------------------------------------------- sets


def most_apart(total, threshold: int):
    """How many n-grams two sets of ``total`` n-grams together may differ in."""
    return (100 - threshold) * total // (100 + threshold)


def bands(largest: int, threshold: int) -> np.ndarray:
    """Least size of each band and an end; sizes that link lie in one band or in two that follow each other."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 10_000 // threshold**2 + 1)
    return np.array(out, np.int64)


def _gram_sets(texts: pa.Array, ngram: int) -> list[np.ndarray]:
    """The distinct n-grams of each text, as sorted 64-bit hashes."""
    words = words_of(texts, NOT_SPACE)
    bounds = words.bounds.tolist()
    return [
        np.unique(windows(words.hashes[a:b], min(ngram, max(b - a, 1)))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ]


def _key(grams: np.ndarray) -> bytes | None:
    return blake2b(grams.tobytes(), digest_size=KEY_BYTES).digest() if len(grams) else None


def parity_map(grams: np.ndarray) -> bytes:
    """A bit for each residue of the grams' hashes, set if an odd number has it; a power of two of at least n times MAP_BITS."""
    bits = max(64, MAP_BITS << (len(grams) - 1).bit_length())
    slots = (mix(grams ^ _U(0x2545F4914F6CDD1D)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _bits_apart(one: bytes, two: bytes) -> int:
    """In how many bits two maps differ, the longer one folded: no more than the sets differ in grams."""
    x, y = sorted((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def gram_sets(docs: DataFrame, id_col: str, text_col: str, ngram: int) -> DataFrame:
    """(id, key, n, grams, parity) of each document; of equal sets in a task only the first has the last two.

    Grams are 32 bits each here.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (piece for whole in batches for piece in pieces(whole)):
            keys, sizes, sets, maps = [], [], [], []
            for grams in _gram_sets(batch.column(1), ngram):
                key = _key(grams)
                fresh = key is not None and key not in seen
                if fresh:
                    seen.add(key)
                keys.append(key)
                sizes.append(len(grams))
                sets.append((grams >> _U(32)).astype(np.uint32).view(np.int32) if fresh else None)
                maps.append(parity_map(grams) if fresh else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()),
                    pa.array(sets, pa.list_(pa.int32())), pa.array(maps, pa.binary()),
                ],
                names=["id", "key", "n", "grams", "parity"],
            )

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(task, f"id {kind}, key binary, n int, grams array<int>, parity binary")


def _bit_map(slots: DataFrame, bits: int) -> np.ndarray:
    """The values of column ``slot`` as bits; the driver gets a number for each 64 of them."""
    rows = slots.groupBy(F.expr("slot div 64").alias("place")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits")
    ).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _wanted(keys: DataFrame) -> Broadcast:
    """A map of the keys' first bits, and a row's place in it is that of ``_is_wanted``."""
    slot = F.shiftright(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), 32 - ASKED_BITS)
    return keys.sparkSession.sparkContext.broadcast(_bit_map(keys.select(slot.alias("slot")), ASKED_BITS))


def _is_wanted(bits: np.ndarray, key: bytes) -> bool:
    slot = int.from_bytes(key[:4], "big") >> (32 - ASKED_BITS)
    return int(bits[slot >> 6]) >> (slot & 63) & 1 == 1


def needed_sets(docs: DataFrame, text_col: str, ngram: int, keys: DataFrame) -> DataFrame:
    """(key, grams) of ``keys`` (key), 64 bits each; sets whose key's bit is not set stay where they are."""
    wanted = _wanted(keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (piece for whole in batches for piece in pieces(whole)):
            found, sets = [], []
            for grams in _gram_sets(batch.column(0), ngram):
                key = _key(grams)
                if key is not None and key not in seen and _is_wanted(wanted.value, key):
                    seen.add(key)
                    found.append(key)
                    sets.append(grams.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "grams"]
            )

    made = docs.select(F.col(text_col).cast("string")).mapInArrow(task, "key binary, grams array<bigint>")
    return made.join(keys, "key", "left_semi").dropDuplicates(["key"])


def stored_sets(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, grams) of ``keys`` (key), 32 bits each, from the table of all sets."""
    wanted = _wanted(keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_is_wanted(wanted.value, k) for k in batch.column(0).to_pylist()], pa.bool_()))

    near = sets.select("key", "grams").mapInArrow(task, "key binary, grams array<int>")
    return near.join(keys, "key", "left_semi").dropDuplicates(["key"])


# ---------------------------------------------------------------- segments and their hashes


class Segments:
    """The segments of some sets under one band each, and their hashes."""

    def __init__(self, grams: np.ndarray, owner: np.ndarray, band: np.ndarray, parts: np.ndarray):
        self.band, self.parts = band, parts
        self.base = np.cumsum(parts) - parts
        spread = mix(grams + _U(0x51ED270B9F1A27D5))
        self.place = self.base[owner] + ((spread >> _U(24)) % parts[owner].astype(np.uint64)).astype(np.int64)
        self.value = mix(grams ^ _U(0xA0761D6478BD642F))
        count = int(parts.sum())
        self.size = np.bincount(self.place, minlength=count)
        self.total = np.zeros(count, np.uint64)
        np.add.at(self.total, self.place, self.value)
        self.owner = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(count) - self.base[self.owner]
        self._name = mix((band[self.owner].astype(np.uint64) << _U(40)) + number.astype(np.uint64) * _U(2))

    def whole(self, kind: int) -> np.ndarray:
        """The bucket of each segment as it is."""
        return mix(self.total + self._name + _U(kind))

    def less(self, kind: int) -> np.ndarray:
        """The bucket of each gram's segment without that gram."""
        return mix(self.total[self.place] - self.value + self._name[self.place] + _U(kind))


def _slot(buckets: np.ndarray, bits: int) -> np.ndarray:
    return (buckets >> _U(64 - bits)).astype(np.int64)


class Plan:
    """What every task needs to know: bands, counters and asked hashes; no more than fixed sizes."""

    def __init__(self, threshold: int, starts: np.ndarray, counters: np.ndarray | None = None, asked: np.ndarray | None = None):
        self.threshold, self.starts, self.counters, self.asked = threshold, starts, counters, asked
        self.bits = 0 if counters is None else int(counters.shape[1]).bit_length() - 1
        #: Segments of each band: so many that sets of the band's largest size need a budget of one each.
        self.parts = most_apart(2 * (starts[1:] - 1), threshold) + 1

    def band_of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1

    def index(self, grams: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> Segments:
        band = self.band_of(sizes)
        return Segments(grams, owner, band, self.parts[band])

    def is_asked(self, buckets: np.ndarray) -> np.ndarray:
        slots = _slot(buckets, ASKED_BITS)
        return (self.asked[slots >> 6] >> (slots & 63).astype(np.uint64)) & _U(1) == 1

    def budgets(self, sizes: np.ndarray, at: Segments) -> np.ndarray:
        """0, 1 or 2 for each segment, by set the H + 1 cheapest steps."""
        largest = np.minimum(self.starts[at.band + 1] - 1, sizes)
        need = most_apart(sizes + largest, self.threshold) + 1
        equal, less = self.counters
        one = equal[_slot(at.whole(_EQUAL), self.bits)].astype(np.float64)
        meets = np.bincount(at.place, equal[_slot(at.less(_EQUAL), self.bits)], minlength=len(one))
        # a row for every question and for every set that it meets; the second step never precedes the first
        two = np.maximum(one, meets + less[_slot(at.whole(_LESS), self.bits)] + at.size + 1)
        cost = np.concatenate([one, two])
        owner = np.concatenate([at.owner, at.owner])
        order = np.lexsort((cost, owner))
        rank = np.arange(len(order)) - (2 * at.base)[owner[order]]
        taken = order[rank < need[owner[order]]]
        return np.bincount(taken % len(one), minlength=len(one))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, sizes, grams, owner of each gram) of batches (key, n, grams), some at a time."""
    for batch in (piece for whole in batches for piece in pieces(whole, 4 * _CHUNK)):
        grams = batch.column(2).flatten().to_numpy().view(np.uint32).astype(np.uint64)
        sizes = batch.column(1).to_numpy().astype(np.int64)
        if len(sizes):
            yield batch.column(0), sizes, grams, np.repeat(np.arange(len(sizes)), sizes)


def _probes(plan: Plan, sizes: np.ndarray, grams: np.ndarray, owner: np.ndarray):
    """(set, bucket, whether the hash is of an empty segment or of one with one more, in the own band) of all questions."""
    own = plan.band_of(sizes)
    for back in (0, 1):
        if back:
            # the band below, if it has sizes that link
            low = -(-plan.threshold * sizes // 100)
            some = np.flatnonzero((own > 0) & (low < plan.starts[own]))
        else:
            some = np.arange(len(sizes))
        if not len(some):
            continue
        chosen = np.zeros(len(sizes), bool)
        chosen[some] = True
        keep = chosen[owner]
        renamed = np.cumsum(chosen) - 1
        band = own[some] - back
        at = Segments(grams[keep], renamed[owner[keep]], band, plan.parts[band])
        budget = plan.budgets(sizes[some], at)
        yield some[at.owner], at.whole(_EQUAL), at.size == 0, budget > 0, back == 0
        two = budget == 2
        if two.any():
            yield some[at.owner], at.whole(_LESS), np.ones(len(two), bool), two, False
            yield some[at.owner][at.place], at.less(_EQUAL), (at.size == 1)[at.place], two[at.place], False


# ---------------------------------------------------------------- buckets


def counters(sets: DataFrame, plan: Broadcast, bits: int) -> np.ndarray:
    """(2, slots): how many indexed segments, and segments less one gram, have their hash in each slot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << bits, np.int32)
        for _, sizes, grams, owner in _chunks(batches):
            at = plan.value.index(grams, owner, sizes)
            for kind, buckets in ((_EQUAL, at.whole(_EQUAL)), (_LESS, at.less(_LESS))):
                slots = _slot(buckets, bits) + (kind << bits)
                total += np.bincount(slots, minlength=2 << bits).astype(np.int32)
        slot = np.flatnonzero(total)
        for k in range(0, len(slot), _CHUNK):
            some = slot[k : k + _CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["slot", "n"])

    rows = sets.mapInArrow(task, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 << bits, np.float32)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(2, -1)


def asked(sets: DataFrame, plan: Broadcast) -> np.ndarray:
    """Bits of the hashes that are indexed only if someone asks for them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sizes, grams, owner in _chunks(batches):
            for _, buckets, special, taken, _ in _probes(plan.value, sizes, grams, owner):
                slots = np.unique(_slot(buckets[special & taken], ASKED_BITS))
                yield pa.RecordBatch.from_arrays([pa.array(slots)], names=["slot"])

    return _bit_map(sets.mapInArrow(task, "slot long"), ASKED_BITS)


def bucket_rows(sets: DataFrame, plan: Broadcast) -> DataFrame:
    """(bucket, key, role): what is indexed and what is asked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, grams, owner in _chunks(batches):
            made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            at = plan.value.index(grams, owner, sizes)
            whole, less = at.whole(_EQUAL), at.less(_LESS)
            role = np.where((at.size > 0) | plan.value.is_asked(whole), _INDEX, 0)
            wanted = plan.value.is_asked(less)
            made.append((owner[wanted], less[wanted], np.full(int(wanted.sum()), _INDEX)))
            for set_, buckets, _, taken, same in _probes(plan.value, sizes, grams, owner):
                if same:
                    # an asked segment of the own band is indexed under the same hash
                    role = role | np.where(taken, _PROBE, 0)
                    made.append((set_[role > 0], buckets[role > 0], role[role > 0]))
                else:
                    made.append((set_[taken], buckets[taken], np.full(int(taken.sum()), _PROBE)))
            set_, buckets, role = (np.concatenate(c) for c in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets.view(np.int64)), keys.take(pa.array(set_)), pa.array(role.astype(np.int32))],
                names=["bucket", "key", "role"],
            )

    return sets.mapInArrow(task, "bucket long, key binary, role int")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, key, indexed, asks) in the buckets where one set asks for another."""
    all_ = Window.partitionBy("bucket")
    seen = rows.withColumns({
        "low": F.min("key").over(all_), "high": F.max("key").over(all_), "roles": F.expr("bit_or(role)").over(all_),
    }).filter(f"low <> high AND roles = {_INDEX | _PROBE}")
    return seen.select(
        "bucket", "key", F.expr(f"role & {_INDEX} > 0").alias("indexed"), F.expr(f"role & {_PROBE} > 0").alias("asks")
    )


# ---------------------------------------------------------------- links


def _may_link(n, m, threshold: int):
    """Whether sizes n <= m allow a link."""
    return F.lit(100) * n >= F.lit(threshold) * m


def hub_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """(a, b): every node with one hub of its buckets, the one that is in most buckets of all."""
    degree = members.groupBy("key").agg(F.count("*").alias("degree"))
    rows = members.join(degree, "key")
    hub = F.struct((-F.col("degree")).alias("d"), F.col("key").alias("a"), F.col("n").alias("m"))
    hubs = rows.groupBy("bucket").agg(F.min(hub).alias("hub"))
    met = rows.select("bucket", "key", "n").join(hubs, "bucket").filter(
        (F.col("key") != F.col("hub.a")) & _may_link(F.least("n", "hub.m"), F.greatest("n", "hub.m"), threshold)
    )
    return met.groupBy("key").agg(F.min("hub").alias("hub")).select(F.col("hub.a").alias("a"), F.col("key").alias("b"))


def _folded(parity: bytes, words: int) -> np.ndarray:
    out = np.frombuffer(parity, np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _meet(threshold: int, single: bool):
    """Rows come by group (bucket, x, y) and key. Returns the pairs that sizes, roles and maps allow to link,
    of each row the first one only if ``single``."""

    def pairs(first, roles, sizes, roots, blocks, cross, maps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        live, rank = np.arange(len(first)), 0
        found = np.zeros(len(first), bool)
        step = max(1, (1 << 20) // maps.shape[1])
        while True:
            live = live[(live - first[live] > rank) & ~found[live]]
            if not len(live):
                return
            hub = first[live] + rank
            keep = (roots[live] != roots[hub]) & (~cross[live] | (blocks[live] != blocks[hub]))
            now, hub = live[keep], hub[keep]
            small, large = np.minimum(sizes[now], sizes[hub]), np.maximum(sizes[now], sizes[hub])
            # the larger one has to ask for the smaller one; of equal ones either may
            asks = ((roles[now] & _PROBE > 0) & (roles[hub] & _INDEX > 0) & (sizes[now] >= sizes[hub])) | (
                (roles[hub] & _PROBE > 0) & (roles[now] & _INDEX > 0) & (sizes[hub] >= sizes[now])
            )
            keep = asks & (100 * small >= threshold * large)
            now, hub = now[keep], hub[keep]
            for k in range(0, len(now), step):
                a, b = hub[k : k + step], now[k : k + step]
                apart = np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1, dtype=np.int64)
                good = apart <= most_apart(sizes[a] + sizes[b], threshold)
                if good.any():
                    yield a[good], b[good]
                    if single:
                        found[b[good]] = True
            rank += 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3, _GROUP_ROWS):
            if not table.num_rows:
                continue
            bucket, x, y, block, roles, sizes, roots = (table.column(k).to_numpy() for k in (0, 1, 2, 3, 5, 6, 7))
            sizes = sizes.astype(np.int64)
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(bucket)))
            # all maps of a group are folded to that of its least set
            least = np.minimum.reduceat(sizes, starts)
            words = np.repeat(np.maximum((MAP_BITS << np.ceil(np.log2(least)).astype(np.int64)) // 64, 1), lengths)
            parities = table.column(8).to_pylist()
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(words).tolist():
                at = np.flatnonzero(words == size)
                own = new[at]
                first = np.maximum.accumulate(np.where(own, np.arange(len(at)), 0))
                maps = np.stack([_folded(parities[k], size) for k in at.tolist()])
                for a, b in pairs(first, roles[at], sizes[at], roots[at], block[at], (x != y)[at], maps):
                    left.append(at[a])
                    right.append(at[b])
            keys = table.column(4).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(np.concatenate(left))), keys.take(pa.array(np.concatenate(right)))], names=["a", "b"]
            )

    return task


def met_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: int, single: bool) -> DataFrame:
    """(a, b): pairs of different roots that may link, in all buckets that hold more than one root."""
    known = members.join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    known = known.withColumn("root", F.coalesce("root", "key"))
    per = known.groupBy("bucket").agg(
        F.ceil(F.count("*") / GROUP_SETS).cast("int").alias("blocks"), F.min("root").alias("u"), F.max("root").alias("v")
    ).filter("u <> v").select("bucket", "blocks")
    dealt = in_block_pairs(known, per, "key").select(
        "bucket", "x", "y", "block", "key", F.expr(f"IF(indexed, {_INDEX}, 0) + IF(asks, {_PROBE}, 0)").alias("role"),
        "n", F.xxhash64("root").alias("root"),
    )
    rows = dealt.join(nodes.select("key", "parity"), "key").select(
        "bucket", "x", "y", "block", "key", "role", "n", "root", "parity"
    )
    rows = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "key")
    found = rows.mapInArrow(_meet(threshold, single), "a binary, b binary")
    return found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if single else found.distinct()


def plausible(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose parity maps allow a link; ``nodes`` has key, n, parity."""
    one = nodes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x"))
    two = nodes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy(), threshold)
            maps = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True)
            good = pa.array([_bits_apart(x, y) <= h for x, y, h in maps], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "x", "y")
    return rows.mapInArrow(task, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs that differ in few enough of the grams in ``sets``, by the sizes in ``nodes``."""
    sized = sets.join(nodes.select("key", "n"), "key")
    left = sized.select(F.col("key").alias("a"), F.col("grams").alias("x"), F.col("n").alias("n_a"))
    right = sized.select(F.col("key").alias("b"), F.col("grams").alias("y"), F.col("n").alias("n_b"))
    both = pairs.join(left, "a").join(right, "b")
    # repeats of a hash are counted once on either side, so 32-bit grams never look further apart than they are
    apart = F.size(F.array_except("x", "y")) + F.size(F.array_except("y", "x"))
    most = F.expr(f"{100 - threshold} * (n_a + n_b) div {100 + threshold}")
    return both.filter(apart <= most).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()


def linked(members: DataFrame, nodes: DataFrame, sets: DataFrame, exact: Callable[[DataFrame], DataFrame], threshold: int) -> DataFrame:
    """(node, root) of all nodes that have links.

    ``members`` are the rows of shared buckets, ``nodes`` (key, n, parity), ``sets`` all sets with 32-bit
    grams; ``exact`` gives the 64-bit grams of some keys.
    """
    tested, links, sure = None, None, False
    roots = nodes.select(F.col("key").alias("node"), F.col("key").alias("root")).limit(0)
    turn = 0
    while True:
        if turn == 0:
            found = plausible(hub_pairs(members, threshold), nodes, threshold)
        else:
            found = met_pairs(members, nodes, roots, threshold, turn <= SINGLE_ROUNDS)
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "gram-pairs")
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            some = stored(stored_sets(sets, _ends(pairs)), "gram-sets-near")
            good = stored(verified(pairs, some, nodes, threshold), "gram-links")
            links = good if links is None else links.union(good)
            roots, sure = spread(components(links)), False
        elif 0 < turn <= SINGLE_ROUNDS:
            turn = SINGLE_ROUNDS
        if turn > SINGLE_ROUNDS:
            # no pair of different components is left to compare
            if sure or links is None:
                return roots
            good = stored(verified(links, stored(exact(_ends(links)), "gram-needed"), nodes, threshold), "gram-links")
            if good.count() == links.count():
                return roots
            links, roots, sure = good, spread(components(good)), True
        turn += 1


def gram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: int = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id. ``threshold`` is in hundredths.

    Other columns are not read. Components are whole; links inside a component are not all listed.
    """
    spark = docs.sparkSession
    rows, path = written(gram_sets(docs, id_col, text_col, ngram), "gram-sets")
    names = stored(rows.select("id", "key", "n"), "gram-names")
    sets = rows.filter("grams IS NOT NULL").select("key", "n", "grams")
    most = sets.agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
    if most["n"] is None:
        delete_path(spark, path)
        return names.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    starts = bands(most["n"], threshold)
    low, high = COUNTER_BITS
    bits = min(high, max(low, math.ceil(math.log2(most["all"] / COUNTER_GRAMS + 1))))
    plan = spark.sparkContext.broadcast(Plan(threshold, starts))
    plan = spark.sparkContext.broadcast(Plan(threshold, starts, counters(sets, plan, bits)))
    plan = spark.sparkContext.broadcast(Plan(threshold, starts, plan.value.counters, asked(sets, plan)))
    met = stored(shared_buckets(bucket_rows(sets, plan)), "gram-buckets")
    maps = rows.filter("parity IS NOT NULL").select("key", "n", "parity").dropDuplicates(["key"])
    nodes = spread(stored(maps.join(met.select("key").distinct(), "key", "left_semi"), "gram-nodes"))
    members = stored(met.distinct().join(nodes.select("key", "n"), "key"), "gram-members")
    roots = linked(
        members, nodes, sets, lambda keys: needed_sets(docs, text_col, ngram, keys), threshold
    ).select(F.col("node").alias("key"), "root")
    delete_path(spark, path)
    named = names.join(roots, "key", "left").select("id", "n", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    return named.join(least, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )
