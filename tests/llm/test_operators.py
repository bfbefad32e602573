"""The ten operators against brute force, and on odd input: nulls, empty and long texts, ties,
repeated rows, empty tables, columns of clashing names."""

import collections
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kvflow.llm import chat, decontaminate, line_dedup, merkle, mixing, order_minhash, pii, ring, token_counts, toxicity
from tests.llm.test_words_and_index import plain_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def doc_rows(seed=1, n=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(prose(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5)))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    base = prose(rng, 120)
    words = base.split()
    for k in range(4):
        changed = list(words)
        changed[10 * k + 5] = "changed"
        rows.append((100 + k, " ".join(changed), "en", "s0", 0))
    rows += [(110, base, "en", "s1", 0), (111, base.upper() + " !", "en", "s1", 0), (112, base, None, None, None)]
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (113, "", "en", "s1", 0), (114, "...", "en", "s1", 0)]
    rows += [(115, prose(rng, 30_000), "en", "s2", 0), (116, "x" * 100_000, "en", "s2", 0), (117, "é 中\n\n中 é", "fr", "s2", 0)]
    rows += [rows[0], rows[0]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def renamed(df, *names):
    """``df`` with more columns, of names that operators use for themselves."""
    return df.withColumns({n: F.lit("mine") for n in names})


# ---------------------------------------------------------------- 1


def edit_links(rows):
    from kvflow.llm.alignment import limit
    from tests.llm.test_words_and_index import edits

    texts = {tuple(plain_words(t)) for _, t, *_ in rows if plain_words(t)}
    texts = [t for t in texts if len(t) < 1000]
    return [(a, b) for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= limit(len(a), len(b), 0.8)
            and edits(a, b) <= limit(len(a), len(b), 0.8)]


def test_near_classes(spark, docs, nothing):
    rows = doc_rows()
    found = order_minhash.near_classes(renamed(docs, "_key", "class_id", "words")).collect()
    assert len(found) == len(rows)
    by_id = collections.defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add(r["class_id"])
    # every link between different texts is inside a class
    label = {tuple(plain_words(t)): min(by_id[i]) for i, t, *_ in rows if i is not None and plain_words(t)}
    for a, b in edit_links(rows):
        assert label[a] == label[b]
    assert {i for i, c in by_id.items() if c == {100}} == {100, 101, 102, 103, 110, 111, 112}
    assert by_id[115] == {115} and by_id[114] == {114} and by_id[None] == {113} and by_id[113] == {113}
    assert order_minhash.near_classes(nothing).count() == 0


def test_keep_first(docs, nothing):
    kept = order_minhash.keep_first(renamed(docs, "_root"))
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == [*range(40), 100, 113, 114, 115, 116, 117] and "_root" in kept.columns
    assert order_minhash.keep_first(nothing).count() == 0


def edited(rng, words, first, edits):
    """``words`` with so many of those from ``first`` on replaced by words of no other text."""
    words = list(words)
    for i in rng.sample(range(first, len(words)), edits):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("blocks", [False, True])
def test_near_copies_behind_a_common_passage(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(order_minhash, "GROUP_NODES", 16)
        monkeypatch.setattr(order_minhash, "FIRST", 1)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(225)]
    texts = []
    for k in range(60):
        own = passage + [f"k{k}o{i}" for i in range(75)]
        texts += [own, edited(rng, own, 225, 24)] if k < 30 else [own]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts)]
    found = order_minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    for k in range(30):
        a, b = ids[2 * k], ids[2 * k + 1]
        assert got[a] == got[b] == min(a, b)
    assert all(got[i] == i for i in ids[60:])


@pytest.mark.parametrize("size", [5, 12, 25, 40, 41, 60, 300])
def test_texts_that_are_alike_share_a_bucket(size):
    import pyarrow as pa

    rng = random.Random(size)
    for edits in {max(1, size // 10), size // 5}:
        one = [[f"w{rng.randrange(5000)}" for _ in range(size)] for _ in range(200)]
        two = [edited(rng, t, 0, edits) for t in one]
        buckets = order_minhash.sketches(pa.array([" ".join(t) for t in one + two]))[1].to_pylist()
        met = sum(bool(set(buckets[i]) & set(buckets[i + 200])) for i in range(200))
        assert met >= 0.97 * 200


def test_moved_halves_differ_for_the_sketch():
    import numpy as np

    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 400).astype(np.uint64)
    moved = np.concatenate([hashes[200:], hashes[:200]])
    items = [order_minhash._items(h, 5) for h in (hashes, moved)]
    assert len(np.intersect1d(*items)) > 380
    one, two = (order_minhash._sketch(i, np.array([0])) for i in items)
    assert 2 <= (one == two).sum() <= 14  # pairs on either side of the cut change their order


# ---------------------------------------------------------------- 2


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rng = random.Random(3)
    pieces = ["<|turn|>", "<|text|>", "<|end|>", "<", "\\", "\\<", "<\\", "|", "\n", "é", "[INST]", "x"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
            rows.append((c, t, rng.choice(["user", "assistant", "sys<|text|>tem", None]), rng.choice([text, text, None])))
    rows.append((None, None, None, "no id"))
    df = spark.createDataFrame(rows, TURNS)
    done = chat.format_chat(renamed(df, "segments", "valid")).select(
        "conv_id", "formatted", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")
    )
    for r in done.collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["formatted"].count("<|turn|>") == len(own)


def test_chat_machine(spark):
    def check(*roles):
        rows = [(1, i, r, "t") for i, r in enumerate(roles)]
        r = chat.format_chat(spark.createDataFrame(rows, TURNS)).first()
        return r["valid"], r["bad_turn"]

    assert check("system", "user", "assistant") == (True, None)
    assert check("user", "assistant", "user", "assistant") == (True, None)
    assert check("user", "user", "assistant") == (False, 1)
    assert check("user") == (False, None)
    assert check("assistant") == (False, 0)
    with pytest.raises(ValueError):
        chat.ChatTemplate(open="x")


# ---------------------------------------------------------------- 3


def plain_line_dedup(rows):
    first, seen, near, removed = {}, [], set(), collections.defaultdict(list)
    ordered = sorted({(i is None, i or 0, t or "") for i, t, *_ in rows})
    for _, i, text in ordered:
        for k, line in enumerate(text.split("\n")):
            words = frozenset(plain_words(line))
            if not words:
                continue
            if words not in first:
                first[words] = (i, k)
                if any(len(words & s) >= 0.8 * len(words | s) - 1e-9 for s in seen):
                    near.add(words)
                seen.append(words)
                if words not in near:
                    continue
            removed[i].append(k)
    return removed


def line_docs(seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randrange(1, 25)) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            rng.shuffle(words)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines), "en", "s", 0))
    return rows + [(60, None, None, None, None), (61, "", "", "", 0), (62, "\n\n", "", "", 0)]


@pytest.mark.parametrize("group,first", [(8192, 2), (4, 1)])
def test_line_dedup(spark, monkeypatch, group, first):
    monkeypatch.setattr(line_dedup, "GROUP_LINES", group)
    monkeypatch.setattr(line_dedup, "FIRST", first)
    monkeypatch.setattr(line_dedup, "NEXT", first)
    rows = line_docs(7)
    df = renamed(spark.createDataFrame(rows, DOCS).repartition(3), "_row", "key", "id")
    judged = line_dedup.dedup_lines(df)
    got = {r["doc_id"]: r["removed"] for r in judged.collect()}
    want = plain_line_dedup(rows)
    assert got == {r[0]: want.get(r[0], []) for r in rows}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(df, judged).collect()}
    for i, text, *_ in rows:
        lines = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want.get(i, []))
        assert kept[i] == lines


def test_line_dedup_of_odd_tables(docs, nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert line_dedup.dedup_lines(docs).count() == len({(r[0], r[1] or "") for r in doc_rows()})


# ---------------------------------------------------------------- 4


def plain_hits(text, items):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        n = min(10, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words)):
            if n and tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(words), len(hit), sorted(n for n in names if n is not None)


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontaminate(spark, nothing, block):
    rng = random.Random(4)
    items = [(f"i{k}", prose(rng, n)) for k, n in enumerate([3, 9, 10, 11, 25, 25])]
    items += [("twin", items[4][1]), ("none", "..."), ("null", None), (None, prose(rng, 12)), items[0]]
    rows = doc_rows(4, 12)
    for k, (_, item) in enumerate(items):
        rows.append((200 + k, f"{prose(rng, 20)} É {(item or '').upper()}, {prose(rng, 5)} {item or ''}", "en", "s", 0))
    rows.append((300, " ".join(items[4][1].split()[2:14]), "en", "s", 0))
    df = renamed(spark.createDataFrame(rows, DOCS).repartition(2), "n_hit", "spans")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.decontaminate(df, bench, block_windows=block).collect()
    for r in found:
        n, hit, names = plain_hits(r["text"], items)
        assert (r["n_words"], r["n_hit"]) == (n, hit)
        assert r["items"] == names
        inside = " ".join(r["text"][s["start"] : s["end"]] for s in r["spans"])
        assert len(plain_words(inside)) == hit
    assert len(found) == len(rows) and sum(r["n_hit"] > 0 for r in found) >= 9
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    none = decontaminate.decontaminate(df, bench.limit(0), keep_text=False)
    assert none.filter("n_hit > 0").isEmpty() and "text" not in none.columns


def test_a_text_longer_than_an_index(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_SYMBOLS", 50)
    import pyarrow as pa

    from kvflow.llm.words import words_of

    rng = random.Random(6)
    text = prose(rng, 400)
    words = words_of(pa.array([text, "a b", text]))
    rows = [{"items": [str(i)], "window": words.hashes[i : i + 10].view("int64").tolist()} for i in range(0, 390, 7)]
    which, at = decontaminate.find_hits(words, decontaminate._Block(rows, 10), 10)
    want = {(k, 7 * k + shift) for k in range(len(rows)) for shift in (0, 402)}
    assert want <= set(zip(which.tolist(), at.tolist()))


# ---------------------------------------------------------------- 5


def test_fingerprints(spark, nothing):
    rows = doc_rows()
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(i, text)
    unique = [(i, t) for i, t in ids.items()]
    df = spark.createDataFrame(unique, "doc_id long, text string").repartition(4)
    for parts in (1, 3, 9):
        found = {r["doc_id"]: r for r in merkle.compare_with_next(renamed(df, "edited", "_part"), parts=parts).collect()}
        order = sorted((i for i in ids if i is not None), reverse=True) + [None]
        assert set(found) == set(ids)
        for k, i in enumerate(order):
            text, after = ids[i] or "", ids[order[(k + 1) % len(order)]] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            r = found[i]
            assert (r["n_chars"], r["edited"]) == (len(text), edited)
            assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if len(text) > 300 and text != edited and i != 116:
                assert 0.3 < r["near_edited"] < 0.8
                changed = next(p for p, (a, b) in enumerate(zip(text, edited)) if a != b)
                assert 0 <= r["edit_at"] <= changed
    by_text = collections.defaultdict(set)
    for i, r in found.items():
        by_text[ids[i] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)
    assert merkle.compare_with_next(nothing, parts=2).count() == 0
    assert merkle.compare_with_next(df.filter("doc_id = 5"), parts=2).count() == 1


def test_tree_locates_edits(spark):
    rng = random.Random(9)
    lines = [prose(rng, 20) for _ in range(60)]
    changed = list(lines)
    changed[40] = changed[40].replace(changed[40].split()[9], "edited", 1)
    changed.insert(5, "a new line of words")
    import pyarrow as pa

    one, two = merkle.fingerprints(pa.array(["\n".join(lines), "\n".join(changed)]))
    a, b = "\n".join(lines), "\n".join(changed)
    found = merkle.differences(one, two)
    assert any("edited" in b[k:m] for _, _, k, m in found) and any("a new line" in b[k:m] for _, _, k, m in found)
    assert sum(m - k for _, _, k, m in found) < 0.2 * len(b)
    at, out = 0, []
    for i, j, k, m in found:
        out += [a[at:i], b[k:m]]
        at = j
    assert "".join([*out, a[at:]]) == b
    assert merkle.differences(one, one) == [] and merkle.likeness(one, two) > 0.8
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")
    assert merkle.fingerprint(renamed(df, "fingerprint")).select("fingerprint").distinct().count() == 2


# ---------------------------------------------------------------- 6


@pytest.mark.skipif(not os.path.exists(token_counts.RANKS_PATH), reason="no tokenizer files")
def test_token_counts(docs, nothing, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    with open(token_counts.RANKS_PATH, "rb") as file:
        encode = token_counts.encoder(file.read()).encode_ordinary
    lengths = [len(encode(t or "")) for _, t, *_ in doc_rows()]
    assert encode("<|endoftext|>") != [50256]
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(renamed(docs, "length"))))
    rows = sums.collect()
    assert sorted(r["length"] for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r["length"]
        assert r["n_docs"] == lengths.count(n) and r["docs_over"] == sum(x > n for x in lengths)
        assert r["tokens_up_to"] == sum(x for x in lengths if x <= n)
        assert r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
    limits = token_counts.at_limits(sums, [0, 7, 100, 10**7]).collect()
    assert [r["truncated_total"] for r in limits] == [sum(min(x, n) for x in lengths) for n in (0, 7, 100, 10**7)]
    for share in (0.1, 0.5, 1.0):
        at = token_counts.quantile(sums, share).first()["length"]
        assert sum(x <= at for x in lengths) >= share * len(lengths) > sum(x < at for x in lengths) - 1e-9
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(nothing))).count() == 0


# ---------------------------------------------------------------- 7


def plain_ring(keys, shards, slack):
    """One key after the other, by place on the ring."""
    places = sorted((int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), k) for k in keys)
    nodes = sorted(
        (int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(ring.VIRTUAL_NODES)
    )
    room, used, out = ring.capacities(len(keys), shards, slack), [0] * shards, {}
    width = (1 << 60) // ring.CELLS
    for place, key in places:
        start = next((i for i, (at, _) in enumerate(nodes) if at // width >= place // width), 0)
        while used[nodes[start % len(nodes)][1]] >= room[nodes[start % len(nodes)][1]]:
            start += 1
        shard = nodes[start % len(nodes)][1]
        out[key] = shard
        used[shard] += 1
    return out


@pytest.mark.parametrize("n,shards,slack", [(500, 16, 0.0), (500, 5, 0.1), (3, 16, 0.0)])
def test_ring_like_one_key_after_the_other(spark, n, shards, slack):
    found = ring.shard_rows(spark.range(n), "id", shards, slack).collect()
    assert {r["id"]: r["shard"] for r in found} == plain_ring(range(n), shards, slack)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_ring_balance_movement_and_odd_rows(spark, docs, nothing):
    df = spark.range(20_000)
    one, more = (ring.shard_rows(df, "id", s).withColumnRenamed("shard", f"s{s}").drop("slot") for s in (16, 17))
    sizes = [r["count"] for r in one.groupBy("s16").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) - min(sizes) <= 1
    assert one.join(more, "id").filter("s16 <> s17").count() < 0.12 * 20_000  # 1/17 is the least
    odd = ring.shard_rows(renamed(docs, "slot", "_cell", "_rank"), "doc_id", 4)
    assert odd.count() == len(doc_rows()) == odd.select("shard", "slot").distinct().count()
    assert ring.shard_rows(nothing, "doc_id", 4).count() == 0


# ---------------------------------------------------------------- 8

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def pii_texts():
    rng = random.Random(8)
    pieces = ["a.b@c.de", "@", "x@y", "a@b.c_d@e.f", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "0255.01.1.1", "+1 (743) 555-3824",
              "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "é", "中", " ", "\n", ".", "-", "7", "00", "word", "++12"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)]
    return texts + [None, "", "9" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+" * 1000 + "1" * 1000, "1 " * 20_000]


def test_base_rules(spark):
    texts = pii_texts()
    df = renamed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "spans", "candidates")
    found = pii.find_pii(df).collect()
    assert len(found) == len(texts)
    for r in found:
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert got == plain_base(texts[r["doc_id"]] or "")


def test_addresses_with_zero_parts(spark):
    rng = random.Random(35)
    parts = ["0", "00", "000", "1", "10", "127", "0255", "255", "256", "0256", "00100", "1000"]
    texts = ["127.0.0.1", "10.0.0.1", "192.168.0.12", "0.1.2.3", "000.1.2.3", "0.0.0.0", "0000.00.0.000", "1.2.3.0256", "0" * 3_000 + ".0.0.1"]
    texts += [f"at {'.'.join(rng.choice(parts) for _ in range(4))} now" for _ in range(300)]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert got == plain_base(texts[r["doc_id"]])
    assert sum(any(s["kind"] == "ip" and s["base"] for s in r["spans"]) for r in found) > 50


def test_more_spans_than_the_rules_give(spark, nothing):
    rng = random.Random(2)
    texts = [f"{prose(rng, 8)} call me: +1 (743) 555-{i:04d} or mail to me{i}@mail.example.com now" for i in range(60)]
    texts += [f"{prose(rng, 5)} phone (743) 555-{i:04d} {prose(rng, 5)}" for i in range(10)]
    texts += [f"{prose(rng, 5)} mail: john{i} [at] example [dot] com {prose(rng, 5)}" for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    for i in range(60, 70):
        assert [texts[i][s["start"] : s["end"]] for s in found[i]] == [f"(743) 555-{i - 60:04d}"]
    for i in range(70, 80):
        assert [texts[i][s["start"] : s["end"]] for s in found[i]] == [f"john{i - 70} [at] example [dot] com"]
    assert all(sum(s["base"] for s in found[i]) == 2 == len(found[i]) for i in range(60))
    assert pii.find_pii(nothing).count() == 0


def test_em_finds_the_reliable_labelers():
    rng = random.Random(1)
    right = [0.95, 0.9, 0.85, 0.8, 0.6, 0.55]
    patterns = collections.Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = [(1 if true == (rng.random() < r) else -1) if rng.random() < 0.9 else 0 for r in right]
        patterns[tuple(votes)] += 1
    share, got, posterior = pii.estimate(patterns)
    assert abs(share - 0.4) < 0.05 and all(abs(a - b) < 0.06 for a, b in zip(got, right))
    weights = pii.fit(patterns, posterior)
    assert weights[1] > weights[4] > 0


# ---------------------------------------------------------------- 9


def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "d", "é", None])
        rows.append((i, prose(rng, int(rng.paretovariate(1) * 10) % 900), "en", source, 0))
    rows += [(900, None, None, "zero", None), (901, "", None, "zero", 0), rows[0], (None, "x y", None, "a", 0)]
    df = renamed(spark.createDataFrame(rows, DOCS).repartition(3), "size", "copies", "rate", "_tie")
    found = mixing.mix(df, "doc_id").collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(dict(sizes), [3, 1, 2], 1.5, 2)
    taken = collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(want[r["source"]], 1)
        assert 0 <= r["copies"] <= 2 and -1e-9 <= r["rate"] <= 2 + 1e-9
        taken[r["source"]] += r["copies"] * r["size"]
    for source, target in want.items():
        # rates meet the target, copies miss it by about a short document
        rates = sum(r["rate"] * r["size"] for r in found if r["source"] == source)
        assert abs(rates - target) <= 1e-6 * max(target, 1)
        assert abs(taken[source] - target) <= 0.01 * target + 5
    again = mixing.mix(df.repartition(5), "doc_id").collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_rows(spark, docs, nothing):
    rows = mixing.mixed_rows(renamed(docs, "copies", "_row", "_key"), "doc_id")
    counted = collections.Counter(r["doc_id"] for r in rows.collect())
    want = collections.Counter()
    for r in mixing.mix(docs, "doc_id").collect():
        want[r["doc_id"]] += r["copies"]
    assert counted == +want and {"copies", "_row", "_key"} <= set(rows.columns)
    assert mixing.mixed_rows(nothing, "doc_id").count() == 0


# ---------------------------------------------------------------- 10


def toxic_rows():
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        words = prose(rng, rng.randrange(20, 80)).split()
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            bad = rng.choice(["nasty", "awful", "rotten", "grubbyxx" + rng.choice("abcdefgh"), "grubbyxx" + rng.choice("ijklmn")])
            words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, nothing):
    rows, labels = toxic_rows()
    odd = [(5000, None, "", "", 0), (5001, "", "", "", 0), (5002, "x" * 100_000, "", "", 0), (None, "nasty awful", "", "", 0), rows[0]]
    docs = renamed(spark.createDataFrame(rows + odd, DOCS).repartition(3), "score", "toxic", "_mask")
    known = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(docs, known, keep_text=True).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    truth = {i: t for i, _, t in labels}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in found)
    # held-out labels change nothing
    other = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, other).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in found)
    assert toxicity.score_toxicity(nothing, known).count() == 0
    blind = toxicity.score_toxicity(docs, known.limit(0)).select("score").distinct().collect()
    assert all(r["score"] < 0.5 for r in blind)
