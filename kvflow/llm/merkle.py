"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

Paragraphs are the lines of a text. A section ends after an empty paragraph or one whose hash ends in
zeros; a leaf, some words of one paragraph, ends after a word whose hash does. So an insertion moves
no cut but its own. A leaf hashes its characters with the white space that follows, an inner node the
hashes of its children. Equal texts have equal roots; where roots differ, only differing branches are
compared to find the edit.

A fingerprint is text: ``root|section~paragraph:leaf,leaf~paragraph:...|section...``, each leaf as
hash and length in code points, so trees are compared, and differing stretches located, without the
documents.

Defined results: a null text counts as empty, which has a root and no sections; two empty texts are
alike (1), an empty and another are not (0).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kvflow.llm.words import words_of

#: A leaf ends after one word in so many, after so many words, and after so many bytes at the latest.
LEAF_WORDS = 6
MOST_WORDS = 10
MOST_BYTES = 96
#: Short texts would be one or two leaves: the first words of a text are cut in pairs.
FIRST_WORDS = 32
#: A section has this many paragraphs on average.
SECTION = 8


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def fingerprints(texts: pa.Array) -> list[str]:
    """The fingerprint of each text."""
    words = words_of(texts)
    data, offsets = words.data, words.offsets
    lines = np.flatnonzero(data == 10) + 1
    chosen = words.hashes % np.uint64(LEAF_WORDS) == 0
    # words since the last cut, be it a chosen word or the begin of a paragraph or text
    fresh = np.concatenate([
        np.flatnonzero(chosen) + 1, np.searchsorted(words.starts, lines), words.bounds, np.zeros(1, np.int64)
    ])
    since = np.zeros(len(chosen) + 1, np.int64)
    since[fresh] = fresh
    since = np.arange(len(chosen)) - np.maximum.accumulate(since[: len(chosen)])
    head = np.arange(len(chosen)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
    pairs = (head < FIRST_WORDS) & (head % 2 == 1)
    cut = np.flatnonzero(chosen | pairs | (since % MOST_WORDS == MOST_WORDS - 1))
    after = words.starts[cut[cut + 1 < len(words.starts)] + 1]
    marks = np.unique(np.concatenate([offsets, after, lines]))
    long = np.flatnonzero(np.diff(marks) > MOST_BYTES)
    if len(long):
        more = np.concatenate([np.arange(marks[k] + MOST_BYTES, marks[k + 1], MOST_BYTES) for k in long])
        for _ in range(3):  # not inside a code point
            inside = (data[np.minimum(more, len(data) - 1)] & 0xC0) == 0x80
            more = more + inside
        marks = np.unique(np.concatenate([marks, more]))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[marks]
    bounds = np.searchsorted(marks, offsets).tolist()
    ends_line = np.zeros(len(marks), bool)
    ends_line[1:] = data[marks[1:] - 1] == 10 if len(data) else False
    sizes, ends_line, marks = np.diff(points).tolist(), ends_line.tolist(), marks.tolist()
    raw = data.tobytes()
    out = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        sections: list[bytes] = []
        shown: list[str] = []
        paragraphs: list[bytes] = []
        lines_shown: list[str] = []
        leaves: list[bytes] = []
        leaves_shown: list[str] = []
        for k in range(first, last):
            piece = raw[marks[k] : marks[k + 1]]
            leaf = _digest(piece)
            leaves.append(leaf)
            leaves_shown.append(f"{leaf[:4].hex()}{sizes[k]}")
            if ends_line[k + 1] or k + 1 == last:
                paragraph = _digest(b"p" + b"".join(leaves))
                paragraphs.append(paragraph)
                lines_shown.append(f"{paragraph[:4].hex()}:{','.join(leaves_shown)}")
                blank = len(leaves) == 1 and not piece.strip()
                leaves, leaves_shown = [], []
                if blank or paragraph[-1] % SECTION == 0 or k + 1 == last:
                    section = _digest(b"s" + b"".join(paragraphs))
                    sections.append(section)
                    shown.append(f"{section[:4].hex()}~{'~'.join(lines_shown)}")
                    paragraphs, lines_shown = [], []
        root = _digest(b"r" + b"".join(sections)).hex()
        out.append("|".join([root, *shown]))
    return out


def _leaf_weights(fingerprint: str) -> Counter:
    found: Counter = Counter()
    for section in fingerprint.split("|")[1:]:
        for paragraph in section.split("~")[1:]:
            for leaf in paragraph[9:].split(","):
                found[leaf] += int(leaf[8:])
    return found


def likeness(a: str, b: str) -> float:
    """Share of the characters of both texts that lie in common leaves, 0 to 1; 1 for equal roots."""
    if a[:32] == b[:32]:
        return 1.0
    left, right = _leaf_weights(a), _leaf_weights(b)
    total = sum(left.values()) + sum(right.values())
    return 2 * sum((left & right).values()) / total if total else 1.0


def _size(node: str, level: int) -> int:
    if level == 0:
        return sum(_size(p, 1) for p in node.split("~")[1:])
    if level == 1:
        return sum(int(leaf[8:]) for leaf in node[9:].split(","))
    return int(node[8:])


def differences(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Stretches that differ, (start, end) in a and in b, in code points; equal branches are skipped.

    The work grows with the square of a differing branch's children; ``first_difference`` does not need it.
    """
    out: list[tuple[int, int, int, int]] = []

    def descend(left: list[str], right: list[str], level: int, at: int, to: int) -> None:
        names = [[n[:8] + (n[8:] if level == 2 else "") for n in side] for side in (left, right)]
        begin_a = np.cumsum([at] + [_size(n, level) for n in left]).tolist()
        begin_b = np.cumsum([to] + [_size(n, level) for n in right]).tolist()
        for tag, i, j, k, m in SequenceMatcher(None, *names, autojunk=False).get_opcodes():
            if tag == "equal":
                continue
            if level < 2 and i < j and k < m:
                parts = [
                    [child for n in side for child in (n.split("~")[1:] if level == 0 else n[9:].split(","))]
                    for side in (left[i:j], right[k:m])
                ]
                descend(*parts, level + 1, begin_a[i], begin_b[k])
            else:
                out.append((begin_a[i], begin_a[j], begin_b[k], begin_b[m]))

    if a[:32] != b[:32]:
        descend(a.split("|")[1:], b.split("|")[1:], 0, 0, 0)
    return out


def _leaves(sections: list[str]) -> Iterator[str]:
    return (leaf for s in sections for p in s.split("~")[1:] for leaf in p[9:].split(","))


def first_difference(a: str, b: str) -> int | None:
    """Where two texts begin to differ, in code points and to a leaf; None if their roots are equal.

    Equal sections are passed by their hashes; leaves are looked at from the first differing one on, up to
    the first that differs, so the work is in proportion to the texts.
    """
    if a[:32] == b[:32]:
        return None
    left, right = a.split("|")[1:], b.split("|")[1:]
    same = next((i for i, (x, y) in enumerate(zip(left, right)) if x != y), min(len(left), len(right)))
    at = sum(_size(section, 0) for section in left[:same])
    for x, y in zip(_leaves(left[same:]), _leaves(right[same:])):
        if x != y:
            break
        at += int(x[8:])
    return at


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text in column ``name``, which is replaced if it exists."""
    source = docs.withColumn(name, F.lit(""))
    names = source.columns
    at, to = names.index(text_col), names.index(name)

    def task(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[to] = pa.array(fingerprints(columns[at]), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(task, source.schema)


# ---------------------------------------------------------------- neighbours in descending order


def _number(ids: Column, kind: str) -> Column:
    """A number that never falls as ids rise; unlike ids may share one. Texts go by their first six bytes."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(ids.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind == "date" or kind.startswith("timestamp"):
        return F.unix_micros(ids.cast("timestamp")).cast("double")
    return ids.cast("double")


def with_next(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    """Rows in about ``parts`` runs of falling ids, each run followed by the first row of the next run.

    Columns ``_part``, ``_guest`` (the row is there only to be somebody's next) are added. Each text is
    shuffled once; the run of an id follows from quantiles, and the first id of each run, one number
    per run, from a pass over ids alone. Null ids come last, in a run of their own; rows of equal id
    are ordered by the hash of the row. Ids are numbers, texts (by bytes), dates or times.
    """
    number = _number(F.col(id_col), dict(docs.dtypes)[id_col])
    ids = docs.select(number.alias("_id"))
    cuts = ids.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    cuts = [c for c in cuts if not math.isnan(c)]
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    placed = docs.withColumn("_id", number)
    if len(splits) > 2:
        bucket = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket", handleInvalid="keep")
        placed = bucket.transform(placed)
    else:
        placed = placed.withColumn("_bucket", F.when(F.col("_id").isNull(), 1.0).otherwise(0.0))
    # nulls are kept in a bucket after all others; here they come last
    placed = placed.withColumn("_part", F.when(F.col("_id").isNull(), -1).otherwise(F.col("_bucket").cast("int")))
    firsts = placed.groupBy("_part").agg(F.max(id_col).alias("first")).orderBy(F.desc("_part")).collect()
    runs = [r["_part"] for r in firsts]
    rows = []
    for k, r in enumerate(firsts):
        rows.append((r["_part"], r["first"], runs[k - 1]))
    heads = docs.sparkSession.createDataFrame(rows, f"_p int, _first {dict(docs.dtypes)[id_col]}, _before int")
    # one row per run
    joined = placed.join(F.broadcast(heads), (F.col("_part") == F.col("_p")) & F.col(id_col).eqNullSafe(F.col("_first")), "left")
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("part"), F.lit(True).alias("guest"))
    copies = F.when(F.col("_p").isNull(), F.array(own)).otherwise(F.array(own, guest))
    spread = joined.withColumn("_copy", F.explode(copies)).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("_copy.part").alias("_part"), F.col("_copy.guest").alias("_guest")
    )
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return spread.repartition(parts, "_part").sortWithinPartitions("_part", "_guest", F.desc(id_col), tie)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per document: n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, edit_at.

    The edited text has its last ``n_chars // 2`` code points replaced by the first as many of the next
    document, by falling id (after the last: the first). ``edit_at`` is where the trees begin to differ
    (null: nowhere).
    """
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    source = with_next(rows, "_key", parts)
    kind = dict(rows.dtypes)["_key"]
    schema = (
        f"{id_col} {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, edit_at long"
    )
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    names = source.columns

    def work(table: pa.Table) -> pa.RecordBatch:
        """The rows whose next is there; every run ends with a guest, so only the last one waits."""
        keys, texts = table.column("_key"), table.column("_text")
        part, guest = table.column("_part").to_pylist(), table.column("_guest").to_pylist()
        prints = table.column("_print").to_pylist()
        own = [k for k in range(table.num_rows - 1) if not guest[k] and part[k] == part[k + 1]]
        strings = texts.to_pylist()
        edited = []
        for k in own:
            half = len(strings[k]) // 2
            edited.append(strings[k][: len(strings[k]) - half] + strings[k + 1][:half])
        after = fingerprints(pa.array(edited, pa.string()))
        columns = [
            keys.take(pa.array(own, pa.int64())).combine_chunks(),
            pa.array([len(strings[k]) for k in own], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([prints[k] for k in own], pa.string()),
            pa.array(after, pa.string()),
            pa.array([likeness(prints[k], e) for k, e in zip(own, after, strict=True)], pa.float64()),
            pa.array([likeness(prints[k], prints[k + 1]) for k in own], pa.float64()),
            pa.array([first_difference(prints[k], e) for k, e in zip(own, after, strict=True)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def task(batches):
        waiting = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                now = pa.Table.from_arrays(batch.slice(at, 512).columns, names=names)
                now = now.append_column("_print", pa.array(fingerprints(now.column("_text")), pa.string()))
                if waiting is not None:
                    now = pa.concat_tables([waiting, now])
                yield work(now)
                waiting = now.slice(now.num_rows - 1)

    return source.mapInArrow(task, schema)
