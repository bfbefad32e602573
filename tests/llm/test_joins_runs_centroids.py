"""Operators 11 to 13 against brute force, and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvflow.llm import centroids, jaccard_join, periodic_runs, queries
from kvflow.llm.recompression import build, extend

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 11


def shingles(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def component_rows(rows, threshold=85):
    """(id, size, least id of the component) of each row."""
    sets = [shingles(t) for _, t in rows]
    to = list(range(len(rows)))

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                to[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(i)] = min(id_, least.get(find(i), id_))
    return sorted(((id_, len(sets[i]), least.get(find(i))) for i, (id_, _) in enumerate(rows)), key=repr)


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), min(n, len(words))):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def odd_texts(seed):
    """Families around the threshold, a passage that half of the texts share, odd and short texts."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \t\n", "a", "A", "b a", "a b c", "a b c d", "x " * 50, "é É é", "\x1c \x85", "z" * 40_000]
    for k in range(25):
        own = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 160))]
        if k % 2:
            own = passage + own[:40]
        texts += [" ".join(own), "\n".join(own).upper()]
        texts += [" ".join(changed(rng, own, rng.randrange(0, 5))) for _ in range(6)]
    texts.append(" ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[5], (None, texts[20]), (None, "only here and without a name"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("threshold", [85, 60])
def test_components(spark, seed, threshold):
    rows = odd_texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({n: F.lit("mine") for n in ("key", "id", "root", "bucket", "n", "component_id")})
    got = jaccard_join.gram_components(docs, threshold=threshold)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == component_rows(rows, threshold)


def test_near_copies_without_an_original(spark):
    """Copies of one text that are too far from each other share most segments; few pairs are compared."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(160)]
    rows = [(i, " ".join(changed(rng, base, 4))) for i in range(400)]
    rows += [(1000 + i, " ".join(changed(rng, rows[i][1].split(), 1))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.gram_components(docs).collect()), key=repr)
    assert got == component_rows(rows)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (None, " ")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, jaccard_join.gram_components(docs).collect()), key=repr) == sorted(
            ((i, 0, i) for i, _ in rows), key=repr)
    named = spark.createDataFrame([("b", "one two"), ("a", "One two")], "name string, body string")
    assert {tuple(r) for r in jaccard_join.gram_components(named, "name", "body").collect()} == {("b", 1, "a"), ("a", 1, "a")}


@pytest.mark.parametrize("threshold", [60, 85, 95])
def test_budgets_leave_no_link_out(threshold):
    """Every pair that links meets in a bucket, whatever the counters say."""
    rng = np.random.default_rng(threshold)
    sizes = np.concatenate([np.arange(1, 40), rng.integers(40, 400, 60)])
    starts = jaccard_join.bands(int(sizes.max()) + 40, threshold)
    for counters in (np.zeros((2, 64), np.float32), rng.integers(0, 1000, (2, 64)).astype(np.float32)):
        every = np.full(1 << (jaccard_join.ASKED_BITS - 6), np.uint64(0xFFFFFFFFFFFFFFFF))
        plan = jaccard_join.Plan(threshold, starts, counters, every)
        assert (2 * plan.parts >= jaccard_join.most_apart(starts[1:] - 1 + (starts[1:] - 1) * 100 // threshold, threshold) + 1).all()
        for n in sizes.tolist():
            grams = rng.integers(0, 1 << 62, n).astype(np.uint64)
            # a set that is as far as links allow, and no smaller
            gone = int(rng.integers(0, n + 1))
            while gone:
                come = int(rng.integers(0, gone + 1))
                if 100 * (n - gone) >= threshold * (n + come):
                    break
                gone -= 1
            come = come if gone else 0
            other = np.concatenate([grams[gone:], rng.integers(0, 1 << 62, come).astype(np.uint64)])
            small, large = sorted((grams, other), key=len)
            has = plan.index(small, np.zeros(len(small), np.int64), np.array([len(small)]))
            indexed = set(has.whole(jaccard_join._EQUAL)) | set(has.less(jaccard_join._LESS))
            asked = set()
            for _, buckets, _, taken, _ in jaccard_join._probes(plan, np.array([len(large)]), large, np.zeros(len(large), np.int64)):
                asked |= set(buckets[taken])
            assert indexed & asked


# ---------------------------------------------------------------- 12


def plain_runs(words, least=24, exponent=3):
    """(start, length, period) by comparing the words with themselves, period by period."""
    codes = np.unique(np.array(words or [""], dtype=object).astype(str), return_inverse=True)[1][: len(words)]
    found = {}
    for p in range(1, len(words) // exponent + 1):
        same = np.concatenate([[0], (codes[p:] == codes[:-p]).astype(np.int8), [0]])
        edges = np.diff(same)
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if b - a + p >= max(least, exponent * p):
                found.setdefault((a, b - a + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(rng):
    words = [rng.choice("abc") if rng.random() < 0.3 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 200))]
    for _ in range(rng.randrange(0, 4)):
        if len(words) > 30:
            a, p = rng.randrange(len(words) - 20), rng.randrange(1, 14)
            for i in range(a + p, min(len(words), a + rng.randrange(20, 120))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least, exponent", [(24, 3), (6, 2), (1, 2)])
def test_runs(least, exponent):
    rng = random.Random(least)
    for _ in range(60):
        texts = [periodic_words(rng) for _ in range(rng.randrange(1, 6))]
        flat = [w for t in texts for w in t]
        codes = np.unique(np.array(flat, dtype=object).astype(str), return_inverse=True)[1].astype(np.int64) if flat else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = [[] for _ in texts]
        for t, *run in zip(*(c.tolist() for c in periodic_runs.runs_of(codes, bounds, least, exponent))):
            got[t].append(tuple(run))
        assert got == [plain_runs(t, least, exponent) for t in texts]


def test_common_extensions():
    rng = random.Random(4)
    for _ in range(40):
        words = [rng.randrange(3) for _ in range(rng.randrange(2, 300))]
        for _ in range(rng.randrange(3)):
            a, b, n = rng.randrange(len(words)), rng.randrange(len(words)), rng.randrange(100)
            words[b : b + n] = words[a : a + n]
        cut = rng.randrange(len(words) + 1)
        grammar = build(np.array(words, np.int64), np.array([cut, len(words)]))
        side = [int(i >= cut) for i in range(len(words))]
        pairs = [(x, y) for x, y in (sorted(rng.sample(range(len(words)), 2)) for _ in range(60))]
        node = np.array([[x + side[x] + 1, y + side[y] + 1] for x, y in pairs])

        def plain(x, y, step):
            n, ends = 0, (side[x], side[y])
            while 0 <= x < len(words) and 0 <= y < len(words) and (side[x], side[y]) == ends and words[x] == words[y]:
                x, y, n = x + step, y + step, n + 1
            return n

        for step in (1, -1):
            assert extend(grammar, node[:, 0], node[:, 1], step).tolist() == [plain(x, y, step) for x, y in pairs]


def run_texts():
    rng = random.Random(9)
    texts = [None, "", "  \t ", "one", " a " * 23, "a " * 24, "a\tb\n" * 12, "x" * 50_000, "é\x1cb c " * 30, "a\x0bb\x0cc\rd " * 9]
    texts += [" ".join(periodic_words(rng)) for _ in range(60)]
    texts.append("top " * 30_000)
    texts.append(" ".join(f"w{rng.randrange(9)}" for _ in range(3000)))
    return texts


def test_find_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "_POINTS", 1000)
    texts = run_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[20])], "doc_id long, text string")
    docs = docs.repartition(3).withColumns({"runs": F.lit("old"), "collapsed": F.lit("old"), "_text_of_runs": F.lit("mine")})
    found = periodic_runs.find_runs(docs)
    assert set(found.columns) == {"doc_id", "text", "_text_of_runs", "runs", "collapsed"}
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        words = WORD.findall(r["text"] or "")
        want = [(0, 30_000, 1)] if len(words) == 30_000 else plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(words, want) and r["_text_of_runs"] == "mine"
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_runs_query(spark, tmp_path):
    """The contract, from the planted stretches to the digests."""
    texts = run_texts()
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = [(0, n, 1)] if n and len(set(words)) == 1 and n >= 24 else plain_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(words, runs))))
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 20


# ---------------------------------------------------------------- 13


def plain_clusters(rows, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            name = "" if i is None else str(i)
            kept.append((hashlib.sha256(f"3:{name}".encode()).hexdigest(), [int(np.floor(1024 * x)) for x in v], i))
    kept.sort(key=lambda r: r[:2])
    points = np.array([v for _, v, _ in kept], np.int64).reshape(-1, 64)
    at = points[:k].copy()

    def nearest():
        away = ((points[:, None, :] - at[None]) ** 2).sum(axis=2)
        own = away.argmin(axis=1)
        return own, away[np.arange(len(own)), own]

    for _ in range(rounds):
        own, _ = nearest()
        for j in range(len(at)):
            if (own == j).any():
                at[j] = [sum(c) // len(c) for c in points[own == j].T.tolist()]
    own, away = nearest()
    return sorted(((i, int(c), int(d)) for (_, _, i), c, d in zip(kept, own, away)), key=repr), at.tolist()


def vectors(seed, n, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 64))
    return [(i, [float(x) for x in middles[rng.integers(6)] * spread + rng.normal(size=64) * rng.choice([0.01, 0.3, 1.0])]) for i in range(n)]


@pytest.mark.parametrize("seed, n, spread", [(1, 300, 1.0), (2, 500, 0.2), (3, 200, 30.0), (4, 5, 1.0), (5, 1, 1.0)])
def test_clusters(spark, seed, n, spread):
    rows = vectors(seed, n, spread)
    got = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    want, at = plain_clusters(rows)
    assert got.centroids == at
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got.rows.collect()), key=repr) == want


def test_odd_vectors(spark):
    rows = vectors(6, 80, 1.0)
    same = [0.5] * 64
    rows += [(100 + i, same) for i in range(60)] + [(3, same), (None, same), (None, rows[0][1]), rows[0]]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63)]
    rows += [(205, [float("nan")] + [1.0] * 63), (206, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    df = df.withColumns({n: F.lit("mine") for n in ("id", "v", "cluster", "upper", "distance")})
    got = centroids.cluster_vectors(df)
    want, at = plain_clusters(rows)
    assert got.centroids == at
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got.rows.collect()), key=repr) == want
    full = centroids.with_inertia(got).collect()
    assert {r["inertia"] for r in full} == {sum(d for *_, d in want)}
    # all alike: one cluster has everything, the others are empty and stay
    alike = centroids.cluster_vectors(spark.createDataFrame([(i, same) for i in range(20)], "vec_id long, embedding array<double>"))
    assert {tuple(r)[1:] for r in alike.rows.collect()} == {(0, 0)}


def test_no_vectors_and_too_large_ones(spark):
    none = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    done = centroids.cluster_vectors(none)
    assert done.centroids == [] and centroids.with_inertia(done).count() == 0
    large = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="might not fit 64 bits"):
        centroids.cluster_vectors(large)


def test_bounds_hold_and_are_tighter_than_the_drift():
    """No vector in a sphere gets nearer to a moved centroid than its loosened bound, by random trial."""
    rng = np.random.default_rng(8)
    tighter = 0
    for _ in range(200):
        d = int(rng.choice([2, 3, 64]))
        old = rng.integers(-1000, 1000, (4, d))
        new = old + rng.integers(-1, 2, (4, d)) * rng.integers(0, 300, (4, 1))
        radii = rng.uniform(0, 800, 4)
        change = centroids.drift(old, new, radii)
        for a in range(4):
            way = rng.normal(size=(200, d))
            # on the sphere and in it, its pole towards each moved centroid too
            way[:4] = new - old[a]
            way /= np.maximum(np.sqrt((way**2).sum(axis=1, keepdims=True)), 1e-9)
            points = old[a] + way * radii[a] * rng.choice([1.0, 0.5], (200, 1))
            others = [j for j in range(4) if j != a]
            before = np.sqrt(((points[:, None] - old[others][None]) ** 2).sum(axis=2))
            after = np.sqrt(((points[:, None] - new[others][None]) ** 2).sum(axis=2))
            assert ((before - after).max(axis=1) <= change.loosen_lower[a] + 1e-6).all()
            tighter += change.loosen_lower[a] < 0.95 * change.raise_upper[others].max()
    assert tighter > 100
