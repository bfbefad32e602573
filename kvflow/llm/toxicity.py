"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a classifier.

1. Lexicons: words and word beginnings (5 to 8 bytes) whose document counts lean to the toxic side of
   the labelled training rows, by a likelihood-ratio test; dealt over voters by kind and hash.
2. Voters: each lexicon voter fires on any of its terms; pattern voters fire on shouting, exclamation,
   symbol noise and repetition. A document's votes are one bit mask.
3. Label model: expectation-maximisation over the counts of all vote masks of all documents. Given the
   class, votes form a tree: each voter depends on the voter it is most correlated with (greatest
   conditional mutual information), so correlated voters do not count twice. It starts from the votes
   of the labelled training rows.
4. Classifier: logistic regression on hit counts and pattern values, fitted to the posteriors.

Labels are read only of training rows. Language, source and id are never inputs of a score.

Defined results: a null text counts as empty; an empty text gets the score of a text without any hit;
without labelled training rows no lexicon is found and every score is the prior's; repeated rows are
scored alike; a label row that repeats counts once per matching document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvflow.llm.common import map_batches, pieces, stored, without
from kvflow.llm.words import Words, words_of

#: Rows that the classifier is fitted on, at most.
FIT_ROWS = 20_000
#: Labels that are sent to every task, at most.
BROADCAST_LABELS = 1 << 20
#: Terms that a task holds before it hands their counts on.
_HELD_TERMS = 1 << 19
LEAST_DOCS = 4
#: Likelihood ratio that a term must reach; about one in a million by chance.
SIGNIFICANT = 24.0
BEGINNINGS = (5, 6, 7, 8)
#: Voters of whole words, of each length of beginning, and of patterns: 16 bits.
GROUPS = (4, 2, 2, 2, 2)
PATTERNS = ("shouting", "exclaiming", "noise", "repeating")
N_LEXICON = sum(GROUPS)
N_VOTERS = N_LEXICON + len(PATTERNS)
PATTERN_LIMITS = (0.5, 0.02, 0.1, 0.6)
N_FEATURES = 2 * N_LEXICON + len(PATTERNS) + 2
_U = np.uint64


def held_out(id_col: Column) -> Column:
    """Whether a row's label may not be learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def _terms(words: Words) -> list[np.ndarray]:
    """Per kind the term of each word, 0 where a word is shorter than a beginning."""
    lower = words.data | np.where((words.data >= 65) & (words.data <= 90), 32, 0).astype(np.uint8)
    size = words.ends - words.starts
    begin = np.zeros(len(size), np.uint64)
    for i in range(max(BEGINNINGS)):
        at = np.minimum(words.starts + i, max(len(lower) - 1, 0))
        byte = np.where(size > i, lower[at], 0).astype(np.uint64)
        begin |= byte << _U(56 - 8 * i)
    out = [words.hashes]
    for k in BEGINNINGS:
        mask = _U((0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF)
        out.append(np.where(size >= k, begin & mask, _U(0)))
    return out


def _doc_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))


def term_counts(labelled: DataFrame) -> DataFrame:
    """(kind, term, toxic, clean): documents of each class that have the term. Input: text, toxic."""

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """One entry per term, of entries (term, toxic, all) in any order."""
        term, bad, both = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(term, kind="stable")
        term = term[order]
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        return term[start], np.add.reduceat(bad[order], start), np.add.reduceat(both[order], start)

    def count(batches):
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in GROUPS]

        def handed_on(kind: int):
            term, bad, both = summed(held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(term), kind, np.int32)), pa.array(term.view(np.int64)), pa.array(bad), pa.array(both - bad)],
                names=["kind", "term", "toxic", "clean"],
            )

        for batch in (piece for whole in batches for piece in pieces(whole)):
            words = words_of(batch.column(0))
            toxic = np.array([bool(x) for x in batch.column(1).to_pylist()])
            doc = _doc_of(words)
            for kind, term in enumerate(_terms(words)):
                order = np.lexsort((doc, term))
                t, d = term[order], doc[order]
                first = np.ones(len(t), bool)
                first[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
                t, d = t[first & (t != 0)], d[first & (t != 0)]
                if not len(t):
                    continue
                held[kind].append(summed([(t, toxic[d].astype(np.int64), np.ones(len(t), np.int64))]))
                if sum(len(part[0]) for part in held[kind]) > _HELD_TERMS:
                    held[kind] = [summed(held[kind])]
                    if len(held[kind][0][0]) > _HELD_TERMS // 2:
                        yield handed_on(kind)
        for kind in range(len(GROUPS)):
            if held[kind]:
                yield handed_on(kind)

    rows = labelled.mapInArrow(count, "kind int, term long, toxic long, clean long")
    return rows.groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass(frozen=True)
class Lexicon:
    """Sorted terms of each kind with their voter."""

    terms: tuple[np.ndarray, ...]
    voters: tuple[np.ndarray, ...]


def find_lexicon(labelled: DataFrame) -> Lexicon:
    """The significant terms of the labelled rows (text, toxic): all of them, 16 bytes each in every task.

    A term needs ``LEAST_DOCS`` toxic documents and a lean that chance hardly gives, so they are words of
    the language of insults, some thousands, not of the corpus.
    """
    n = labelled.agg(F.sum("toxic"), F.count("*")).first()
    bad, total = int(n[0] or 0), int(n[1])
    share = min(max(bad / max(total, 1), 1e-6), 1 - 1e-6)
    seen = (F.col("toxic") + F.col("clean")).cast("double")
    rate = F.col("toxic") / seen
    other = F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    found = (
        term_counts(labelled).filter(F.col("toxic") >= LEAST_DOCS)
        .withColumn("lean", 2 * (F.col("toxic") * F.log(rate / share) + other))
        .filter((rate > max(0.5, 2 * share)) & (F.col("lean") >= SIGNIFICANT))
        .select("kind", "term").collect()
    )
    terms, voters, first = [], [], 0
    for kind, groups in enumerate(GROUPS):
        own = np.sort(np.array([r["term"] for r in found if r["kind"] == kind], np.int64).view(np.uint64))
        terms.append(own)
        voters.append((first + (own * _U(0x9E3779B97F4A7C15) >> _U(40)) % _U(groups)).astype(np.int64))
        first += groups
    return Lexicon(tuple(terms), tuple(voters))


def _patterns(words: Words) -> np.ndarray:
    """(texts, patterns): upper share of ASCII letters, share of !, share of symbols, share of repeats."""
    data, n = words.data, len(words.bounds) - 1
    empty = np.diff(words.offsets) == 0

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return (total[words.offsets[1:]] - total[words.offsets[:-1]]).astype(np.float64)

    upper = per_text((data >= 65) & (data <= 90))
    letters = upper + per_text((data >= 97) & (data <= 122))
    size = np.maximum(np.diff(words.offsets), 1)
    symbols = per_text(np.isin(data, np.frombuffer(b"#$%&*@^~|<>=_", np.uint8)))
    doc = _doc_of(words)
    order = np.lexsort((words.hashes, doc))
    h, d = words.hashes[order], doc[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    repeats = np.bincount(d[again], minlength=n) / np.maximum(np.diff(words.bounds), 1)
    out = np.stack([upper / np.maximum(letters, 20), per_text(data == 33) / size, symbols / size, repeats], axis=1)
    out[empty] = 0
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Vote masks and classifier inputs of each text."""
    words = words_of(texts)
    n, doc = len(words.bounds) - 1, _doc_of(words)
    counts = np.zeros((n, N_LEXICON))
    any_hit = np.zeros(len(doc), bool)
    for kind, term in enumerate(_terms(words)):
        own = lexicon.terms[kind]
        if not len(own) or not len(term):
            continue
        at = np.minimum(np.searchsorted(own, term), len(own) - 1)
        hit = np.flatnonzero(own[at] == term)
        any_hit[hit] = True
        np.add.at(counts, (doc[hit], lexicon.voters[kind][at[hit]]), 1)
    shape = _patterns(words)
    fires = np.concatenate([counts > 0, shape > np.array(PATTERN_LIMITS)], axis=1)
    masks = fires @ (1 << np.arange(N_VOTERS))
    hits = np.bincount(doc[any_hit], minlength=n).astype(np.float64)
    rest = np.stack([np.log1p(hits), 10 * np.sqrt(hits / np.maximum(np.diff(words.bounds), 10))], axis=1)
    return masks.astype(np.int32), np.concatenate([counts > 0, np.log1p(counts), shape, rest], axis=1)


# ---------------------------------------------------------------- label model


@dataclass(frozen=True)
class LabelModel:
    """Class share, the voter each voter depends on (-1: none), P(fires | class, parent's vote)."""

    share: float
    parent: tuple[int, ...]
    fires: np.ndarray  # (class, parent's vote, voter)
    accuracy: np.ndarray  # share of true positives among a voter's firings
    correlation: np.ndarray  # (class, voter, voter)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.zeros((len(votes), 2))
        given = np.stack([np.zeros(len(votes), int) if p < 0 else votes[:, p] for p in self.parent], axis=1)
        for y in (0, 1):
            p = self.fires[y][given, np.arange(votes.shape[1])[None, :]]
            logs[:, y] = np.log(np.where(votes == 1, p, 1 - p)).sum(axis=1)
        odds = logs[:, 1] - logs[:, 0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _tree(votes: np.ndarray, weight: np.ndarray) -> list[int]:
    """Parents of the tree with the greatest conditional mutual information; weight is (class, row)."""
    n = votes.shape[1]
    gain = np.zeros((n, n))
    for y in (0, 1):
        w = weight[y]
        total = w.sum() + 4.0
        both = {}
        for a in (0, 1):
            for b in (0, 1):
                both[a, b] = ((votes == a) * w[:, None]).T @ (votes == b) + 1.0
        for (a, b), m in both.items():
            left = both[a, 0] + both[a, 1]
            right = both[0, b] + both[1, b]
            gain += m / weight.sum() * np.log(m * total / (left * right))
    parent, reached = [-1] * n, {0}
    while len(reached) < n:
        g, i, j = max((gain[i, j], -i, -j) for i in reached for j in range(n) if j not in reached)
        parent[-j] = -i if g > 0 else -1
        reached.add(-j)
    return parent


def fit_label_model(
    masks: np.ndarray, counts: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 30
) -> LabelModel:
    """EM over mask counts. ``toxic`` and ``clean`` count the labelled training rows of each mask."""
    votes = (masks[:, None] >> np.arange(N_VOTERS)[None, :]) & 1
    known = np.stack([clean, toxic]).astype(float)
    free = np.maximum(counts - known.sum(axis=0), 0)
    start = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 10)
    # start: what labelled rows of a mask say, with one row's worth of the prior
    p = (toxic + start) / (toxic + clean + 1)
    unlike = (toxic + clean) == 0
    p[unlike] = np.where((votes[unlike, :N_LEXICON]).any(axis=1), 0.5, start)
    model = None
    for _ in range(rounds):
        weight = known + free * np.stack([1 - p, p])
        share = float((weight[1].sum() + 1) / (weight.sum() + 10))
        parent = _tree(votes, weight)
        given = np.stack([np.zeros(len(votes), int) if q < 0 else votes[:, q] for q in parent], axis=1)
        fires = np.zeros((2, 2, N_VOTERS))
        correlation = np.zeros((2, N_VOTERS, N_VOTERS))
        for y in (0, 1):
            w = weight[y][:, None]
            base = (w * votes).sum(axis=0) / max(w.sum(), 1e-9)
            for u in (0, 1):
                on = w * (given == u)
                # two pseudo-rows that behave as the voter does without regard to its parent
                fires[y, u] = ((on * votes).sum(axis=0) + 2 * base + 0.02) / (on.sum(axis=0) + 2.06)
            mean = votes - base
            cov = (mean * w).T @ mean / max(w.sum(), 1e-9)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            correlation[y] = cov / scale[:, None] / scale[None, :]
        true = (weight[1][:, None] * votes).sum(axis=0)
        accuracy = (true + 1) / ((weight.sum(axis=0)[:, None] * votes).sum(axis=0) + 2)
        model = LabelModel(share, tuple(parent), np.clip(fires, 1e-4, 1 - 1e-4), accuracy, correlation)
        p = model.posterior(votes)
    return model


def fit_classifier(x: np.ndarray, p: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic weights (bias first) for soft labels, by damped Newton steps with a ridge penalty."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (q - p) + ridge * w
        hessian = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    keep_text: bool = False,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """``docs`` with held_out, score and predicted; columns of these names are replaced, all others stay.

    Lexicons and the label model come from all labelled training rows, vote masks from all documents;
    ``fit_rows`` bounds the sample that the classifier is fitted on (least hashes of id and features).
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(toxic_col).cast("int").alias("_toxic"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_toxic").isNotNull() & ~held_out(F.col("_id")))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)  # else texts and labels are joined by id
    kept = [c for c in without(docs, "held_out", "score", "predicted").columns if keep_text or c != text_col]
    others = [F.col(f"`{c}`") for c in kept if c != text_col]
    # all columns but the text as one, so that none meets the names used here
    source = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
        F.struct(F.lit(0).alias("_"), *others).alias("_columns"),
    )
    labelled = source.select("_id", "_text").join(known, "_id").select(F.col("_text").alias("text"), F.col("_toxic").alias("toxic"))
    lexicon = docs.sparkSession.sparkContext.broadcast(find_lexicon(stored(labelled, "toxicity-labelled")))
    added = T.StructType([
        T.StructField("_mask", T.IntegerType()), T.StructField("_x", T.ArrayType(T.FloatType())),
    ])

    def measure(batch: pa.RecordBatch) -> list[pa.Array]:
        masks, x = features(batch.column(1), lexicon.value)
        flat = pa.array(x.astype(np.float32).ravel())
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES)
        return [pa.array(masks), pa.ListArray.from_arrays(ends, flat)]

    measured = stored(map_batches(source, added, measure, () if keep_text else ("_text",)), "toxicity-features")
    counts = measured.groupBy("_mask").count()
    seen = measured.select("_id", "_mask").join(known, "_id").groupBy("_mask").agg(
        F.sum("_toxic").alias("toxic"), F.count("*").alias("n")
    )
    rows = counts.join(seen, "_mask", "left").fillna(0).orderBy("_mask").collect()  # 2^16 masks at most
    masks = np.array([r["_mask"] for r in rows], np.int64)
    n, toxic, labelled_n = (np.array([r[c] for r in rows], float) for c in ("count", "toxic", "n"))
    weights = np.zeros(N_FEATURES + 1)
    if len(rows):
        model = fit_label_model(masks, n, toxic, labelled_n - toxic)
        some = measured.select("_mask", "_x", F.xxhash64("_id", "_x").alias("h"))
        if n.sum() > 2 * fit_rows:
            # twice as many rows as are taken have a hash below this, so little is sorted and sent
            some = some.filter(F.col("h") < int(-(1 << 63) + (1 << 64) * (2 * fit_rows / n.sum())))
        some = some.orderBy("h", "_mask").limit(fit_rows).collect()
        x = np.array([r["_x"] for r in some], float)
        votes = (np.array([r["_mask"] for r in some])[:, None] >> np.arange(N_VOTERS)[None, :]) & 1
        weights = fit_classifier(x, model.posterior(votes))
    z = F.aggregate(
        F.zip_with("_x", F.lit(weights[1:].tolist()), lambda a, b: a * b), F.lit(float(weights[0])), lambda a, b: a + b
    )
    scored = measured.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(
        *[F.col("_text").alias(c) if c == text_col else F.col("_columns").getField(c).alias(c) for c in kept],
        F.coalesce(held_out(F.col("_id")), F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
