"""Recall of the near-duplicate classes against all pairs, by band of edit similarity."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from kvflow.llm import order_minhash
from kvflow.llm.alignment import _band, limit
from kvflow.llm.order_minhash import _key, may_be_alike, near_classes, sketches
from kvflow.llm.words import words_of

SF_DIR = "/root/testdata/sf0.01"
BANDS = (0.80, 0.85, 0.90, 0.95, 1.0)


def similarities(texts):
    """{(key, key): similarity} of all pairs of different texts with a similarity of at least 0.8."""
    words = words_of(pa.array(texts))
    own = {}
    for i in range(len(texts)):
        a, b = words.bounds[i], words.bounds[i + 1]
        if a < b:
            own.setdefault(_key(words, i), (words.hashes[a:b] >> np.uint64(32)).astype(np.uint32))
    keys = sorted(own, key=lambda k: len(own[k]))
    made = sketches(pa.array(texts))
    by_key = dict(zip(made[0].to_pylist(), made[3].to_pylist()))
    sizes = np.array([len(own[k]) for k in keys], np.int64)
    bins = np.frombuffer(b"".join(by_key[k] for k in keys), np.uint8).reshape(len(keys), -1)
    out = {}
    for i in range(len(keys)):
        last = int(np.searchsorted(sizes, sizes[i] / 0.8 + 1, "right"))
        others = np.arange(i + 1, last)
        others = others[may_be_alike(sizes, bins, np.full(len(others), i), others, 0.8)]
        if not len(others):
            continue
        most = max(limit(sizes[i], sizes[j], 0.8) for j in others)
        edits = _band([own[keys[i]]] * len(others), [own[keys[j]] for j in others], max(most, 1))
        for j, n in zip(others.tolist(), edits.tolist()):
            if n <= limit(sizes[i], sizes[j], 0.8):
                out[keys[i], keys[j]] = 1 - n / sizes[j]
    return out


def by_band(found, pairs):
    """{band: (pairs in one class, pairs)}"""
    out = {}
    for (a, b), s in pairs.items():
        band = max(x for x in BANDS if x <= s + 1e-9)
        good, n = out.get(band, (0, 0))
        out[band] = good + (found[a] == found[b]), n + 1
    return out


def classes(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    return {bytes(r["_key"]): r["class_id"] for r in near_classes(docs).collect()}


def test_recall_of_planted_copies_by_band(spark):
    """Every original with four copies of growing distance; a passage that half of the originals share."""
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(70):
        n = rng.choice([8, 12, 20, 31, 33, 40, 41, 60, 150, 400])
        own = [f"w{rng.randrange(2000)}" for _ in range(n)]
        if k % 2 and n >= 150:
            own = passage + own
        texts.append(" ".join(own))
        for share in (0.03, 0.08, 0.13, 0.18):
            words = list(own)
            for _ in range(max(1, int(share * len(own)))):
                at = rng.randrange(len(words))
                what = rng.random()
                if what < 0.6:
                    words[at] = f"new{rng.randrange(10**6)}"
                elif what < 0.8:
                    words.insert(at, f"new{rng.randrange(10**6)}")
                else:
                    del words[at]
            texts.append(" ".join(words))
    pairs = similarities(texts)
    found = by_band(classes(spark, texts), pairs)
    assert set(found) >= {0.80, 0.85, 0.90, 0.95}
    assert all(good >= 0.99 * n for good, n in found.values()), found


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_recall_over_the_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    pairs = similarities(texts)
    label = {bytes(r["_key"]): r["class_id"] for r in near_classes(docs).collect()}
    found = by_band(label, pairs)
    print(found)
    assert sum(n for _, n in found.values()) > 50
    assert all(good >= 0.9 * n for good, n in found.values()), found
    # and no class holds texts that no chain of pairs connects
    to = {k: k for k in label}

    def root(k):
        while to[k] != k:
            k = to[k]
        return k

    for a, b in pairs:
        to[root(a)] = root(b)
    chains = {}
    for k in label:
        chains.setdefault(label[k], set()).add(root(k))
    assert all(len(roots) == 1 for roots in chains.values())


def test_groups_that_are_only_just_alike(spark, monkeypatch):
    """No table of the search has more rows than buckets have members, though hubs join few of the nodes."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(100)]
    texts = []
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(100), 12):
            own[k] = f"x{i}y{k}"
        texts.append(" ".join(own))
    rows = {}
    plain = order_minhash.stored

    def counted(df, label):
        out = plain(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "stored", counted)
    found = classes(spark, texts)
    made = sketches(pa.array(texts))
    buckets = dict(zip(made[0].to_pylist(), map(set, made[1].to_pylist())))
    pairs = [(a, b) for a, b in similarities(texts) if buckets[a] & buckets[b]]
    least = {k: i for i, k in enumerate(made[0].to_pylist())}
    for _ in texts:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert found == least
    assert max(n for label in rows if label != "near-members" for n in rows[label]) <= sum(rows["near-members"])
