"""Words, FM-index, alignment and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvflow.llm import alignment, fm_index
from kvflow.llm.components import components
from kvflow.llm.words import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB9 .\né中_", max_size=30)), max_size=8))
def test_words_are_cut_like_the_pattern(texts):
    words = words_of(pa.array(texts, pa.string()))
    got, hashes = [], {}
    for i in range(len(texts)):
        own = []
        for k in range(words.bounds[i], words.bounds[i + 1]):
            raw = words.data[words.starts[k] : words.ends[k]].tobytes().decode().translate(LOWER)
            assert hashes.setdefault(raw, words.hashes[k]) == words.hashes[k]
            own.append(raw)
        got.append(own)
    assert got == [plain_words(t) for t in texts]
    assert len(set(map(int, hashes.values()))) == len(hashes)


def test_sliced_and_long_texts():
    long = "ab " * 700_000
    texts = pa.array(["x", long, "y z", None, ""]).slice(1)
    words = words_of(texts)
    assert np.diff(words.bounds).tolist() == [700_000, 2, 0, 0]
    assert len(set(words.hashes[:700_000].tolist())) == 1


@pytest.mark.parametrize("alphabet", [1, 2, 30])
def test_index_finds_every_occurrence(alphabet):
    rng = np.random.default_rng(alphabet)
    vocabulary = rng.integers(0, 2**63, alphabet).astype(np.uint64)
    pieces = [vocabulary[rng.integers(0, alphabet, n)] for n in (0, 1, 40, 40, 200)]
    pieces.append(pieces[-1])
    index = fm_index.FMIndex(pieces, sample=4)
    flat = np.concatenate(pieces)
    starts = np.cumsum([0, *map(len, pieces)])
    phrases = np.stack([vocabulary[rng.integers(0, alphabet, 3)] for _ in range(50)])
    phrases[0, 2] = 12345  # a word that no piece has
    lengths = np.array([1 + k % 3 for k in range(50)])
    which, low, high = index.search(phrases, lengths)
    for k in range(50):
        want = phrases[k, 3 - lengths[k] :].tolist()
        places = [
            s + i for s, p in zip(starts, pieces) for i in range(len(p) - len(want) + 1) if p[i : i + len(want)].tolist() == want
        ]
        at = np.flatnonzero(which == k)
        got = sorted(index.word_at[index.locate(np.arange(low[at[0]], high[at[0]]))].tolist()) if len(at) else []
        assert got == places
    assert len(flat) == starts[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_alignment_agrees_with_the_whole_table():
    rng = random.Random(5)
    left, right = [np.zeros(0, np.uint32)] * 2, [np.zeros(0, np.uint32), np.ones(3, np.uint32)]
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(60))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        left.append(np.array(a, np.uint32))
        right.append(np.array(b, np.uint32))
    got = alignment.alike(left, right, 0.8)
    want = [edits(a, b) <= alignment.limit(len(a), len(b), 0.8) for a, b in zip(left, right)]
    assert got.tolist() == want and 50 < sum(want) < 290


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    names = list(range(120))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(39)]
    links += [(names[40], names[40 + i]) for i in range(1, 40)] + [(names[40], names[41])]
    links += [(names[80 + i], names[80 + (i + 1) % 20]) for i in range(20)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = [names[:40], names[40:80], names[80:100]]
    assert set(found) == {n for g in groups for n in g}
    assert [len({found[n] for n in g}) for g in groups] == [1, 1, 1] and len(set(found.values())) == 3
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty).count() == 0
