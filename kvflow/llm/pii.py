"""Personal data by weak supervision, in column expressions.

Rules find candidate spans; regex, gazetteer and context labelers vote for (1), against (-1) or
abstain (0). Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability and a probability for each pattern. On these a logistic classifier is trained that sees the
votes and what no labeler does: the span's length, its share of digits, its separators, the word before it
(hashed) and what follows. It decides which candidates become spans. Spans of the base rules always stay.

Patterns are written so that Java matches them in linear time and without recursion: repeated
classes are possessive where nothing after them could use what they give back, and a match may begin
inside a run of its first class only where the last match ended.

Defined results: a null text counts as empty and has no spans; positions are code points, the end
exclusive; an empty table gives no rows; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvflow.llm.common import stored, without

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:int,end:int,base:boolean>"

# fixed values: the base rules
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "(?:0++|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"

# candidates beyond the base rules
_HIDDEN_EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?+[\[({]at[\])}]\x20?+[A-Za-z0-9-]++"
    r"(?:\x20?+(?:[\[({]dot[\])}]|\.)\x20?+[A-Za-z0-9-]++)++"
)
_IP6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
_LOCAL_PHONE = (
    r"(?<![0-9+().-])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])"
    r"[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
)

# gazetteers and trigger words
TOP_DOMAINS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be se no dk pl".split()
CARD_HEADS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
TRIGGERS = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|courriel|correo|adresse)\W{0,3}(?:\w{1,8}\W{1,3})?$",
    "ip": r"(?i)(?:\bip|address|host|server|adresse|from|at)\W{0,3}$",
    "card": r"(?i)(?:card|visa|mastercard|credit|carte|karte|tarjeta)\W{0,3}(?:\w{1,8}\W{1,3})?$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|appel|ruf|handy|llame)\w{0,6}\W{0,3}(?:\w{1,8}\W{1,3})?$",
}
COUNTER_TRIGGERS = r"(?i)(?:version|v\.|isbn|issn|order|serial|token|key|sha|hash|commit|build|no\.|#)\W{0,3}$"
LABELERS = ("rule", "shape", "gazetteer", "trigger", "counter", "edge")
_CONTEXT = 32
#: Matches of a text whose positions are summed in one go.
_BLOCK = 64
#: Values of each trait of a span: length, digits, separators, word before, what follows.
TRAITS = (6, 5, 5, 17, 4)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: as the one element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(values: Column, begin: Column) -> Column:
    none = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("sums"))

    def step(acc: Column, value: Column) -> Column:
        return F.struct((acc["at"] + value).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))

    return F.aggregate(values, none, step, lambda acc: acc["sums"])


def running(values: Column) -> Column:
    """For each of an array's numbers the sum of those before it.

    An array that grows by one costs its length, so sums are made in blocks, and block by block.
    """
    def in_blocks(whole: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(_BLOCK))
        return bound(F.transform(firsts, lambda i: F.slice(whole, i, F.lit(_BLOCK))), joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y))
        return F.flatten(F.zip_with(blocks, _sums_before(totals, F.lit(0)), _sums_before))

    return bound(values, in_blocks)


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping: (start, end, found, before, after).

    The pieces between matches give the positions: ``split`` and ``regexp_extract_all`` walk alike.
    """
    def row(m: Column, before: Column) -> Column:
        start = before + F.length(m["before"])
        return F.struct(
            start.alias("start"), (start + F.length(m["found"])).alias("end"), m["found"].alias("found"),
            F.right(m["before"], F.lit(_CONTEXT)).alias("before"), F.left(m["after"], F.lit(2)).alias("after"),
        )

    def located(both: Column) -> Column:
        """The matches of one text, cut once into pieces and matches."""
        n = F.size(both["found"])
        parts = F.arrays_zip(
            F.slice(both["pieces"], F.lit(1), n).alias("before"), both["found"].alias("found"),
            F.slice(both["pieces"], F.lit(2), n).alias("after"),
        )
        lengths = F.transform(parts, lambda m: F.length(m["before"]) + F.length(m["found"]))
        return F.zip_with(parts, running(lengths), row)

    cut = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"),
    )
    return bound(cut, located)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of 1 to 19 digits is right."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))

    def weigh(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(parts, weigh), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _vote(yes: Column | None, no: Column | None = None) -> Column:
    out = F.when(yes, 1) if yes is not None else F.when(no, -1)
    if yes is not None and no is not None:
        out = out.when(no, -1)
    return out.otherwise(0).cast("tinyint")


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    within: Callable[[Column], Column]  # a cheap test that a text may hold a match
    base: Callable[[Column], Column]  # whether a match obeys the base rule
    keep: Callable[[Column], Column]  # whether a match is a candidate at all
    shape: Callable[[Column], Column]
    known: Callable[[Column], Column]


def _has_digits(m: Column, least: int, most: int) -> Column:
    return F.length(_digits(m)).between(least, most)


def _in_bytes(m: Column) -> Column:
    return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")


def _domain_known(m: Column) -> Column:
    return F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(TOP_DOMAINS)


def traits(m: Column) -> Column:
    """What the classifier sees of a match besides votes, as one number per trait, from 0."""
    found, before, after = m["found"], m["before"], m["after"]
    length = F.length(found)
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1))
    return F.array(
        F.least(F.floor(length / 6), F.lit(5)),
        F.floor(4 * F.length(_digits(found)) / length),
        F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")), F.lit(4)),
        F.when(word == "", 16).otherwise(F.pmod(F.xxhash64(word), F.lit(16))),
        F.when(after == "", 0).when(after.rlike(r"^[\p{L}0-9]"), 1).when(after.rlike(r"^\s"), 2).otherwise(3),
    ).cast("array<tinyint>")


def _true(m: Column) -> Column:
    return F.lit(True)


def _false(m: Column) -> Column:
    return F.lit(False)


RULES = (
    Rule("email", _EMAIL, lambda t: t.contains("@"), _true, _true, lambda m: m.rlike(r"\.[A-Za-z]{2,}$"), _domain_known),
    Rule("ip", _IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _in_bytes, _in_bytes,
         lambda m: ~m.rlike(r"(?:^|\.)0[0-9]"), lambda m: ~m.rlike(r"^(?:0|22[4-9]|2[34][0-9]|25[0-5])\.")),
    Rule("card", _CARD, lambda t: t.rlike("[0-9]{2}|[0-9][ -][0-9]"),
         lambda m: F.when(_has_digits(m, 12, 19), luhn(_digits(m))).otherwise(False),
         lambda m: F.when(_has_digits(m, 12, 19), luhn(_digits(m))).otherwise(False),
         lambda m: m.rlike(r"^[0-9]{12,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}$"),
         lambda m: _digits(m).rlike(CARD_HEADS)),
    Rule("phone", _PHONE, lambda t: t.contains("+"), lambda m: _has_digits(m, 9, 15), lambda m: _has_digits(m, 9, 15),
         lambda m: m.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$"),
         lambda m: m.rlike(r"^\+[1-9]")),
    Rule("email", _HIDDEN_EMAIL, lambda t: t.rlike(r"[\[({]at[\])}]"), _false, _true,
         lambda m: m.rlike(r"[A-Za-z]{2,}$"), _domain_known),
    Rule("ip", _IP6, lambda t: t.rlike(r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"), _false, _true,
         lambda m: m.rlike(r"^[0-9a-f:]+$|^[0-9A-F:]+$"), lambda m: m.rlike(r"^(?:2|3|f[cde])")),
    Rule("phone", _LOCAL_PHONE, lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"), _false, _true,
         lambda m: m.rlike(r"^\([0-9]{3}\)|-.*-|\..*\."), lambda m: _digits(m).rlike(r"^[2-9][0-9]{2}[2-9]")),
)


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def spans(rule: Rule) -> Column:
        def row(m: Column) -> Column:
            base, found = rule.base(m["found"]), m["found"]
            return F.struct(
                F.lit(rule.kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"),
                F.array(
                    _vote(base, ~base),
                    _vote(rule.shape(found), ~rule.shape(found)),
                    _vote(rule.known(found), ~rule.known(found)),
                    _vote(m["before"].rlike(TRIGGERS[rule.kind])),
                    _vote(None, m["before"].rlike(COUNTER_TRIGGERS)),
                    _vote(None, m["before"].rlike(r"[\p{L}_]$") | m["after"].rlike(r"^[\p{L}_]")),
                ).alias("votes"),
                traits(m).alias("traits"),
            )

        rows = F.transform(F.filter(matches(text, rule.pattern), lambda m: rule.keep(m["found"])), row)
        return F.when(rule.within(text), rows)

    none = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,votes:array<tinyint>,traits:array<tinyint>>>")
    return F.flatten(F.array(*[F.coalesce(spans(rule), none) for rule in RULES]))


# ---------------------------------------------------------------- label model and classifier


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, list[float], dict]:
    """EM for one kind: (share of true spans, reliability of each labeler, posterior of each pattern).

    A labeler that does not abstain is right with its reliability. Smoothing counts hold reliabilities
    off 0 and 1 and say that labelers are better than chance.
    """
    share, right = 0.5, [0.8] * len(LABELERS)
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in patterns:
            odds = math.log(share / (1 - share))
            for vote, r in zip(votes, right, strict=True):
                odds += vote * math.log(r / (1 - r))
            posterior[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(patterns.values())
        share = (1 + sum(n * posterior[v] for v, n in patterns.items())) / (2 + total)
        for j in range(len(right)):
            agree, cast = 8.0, 10.0
            for votes, n in patterns.items():
                if votes[j]:
                    cast += n
                    agree += n * (posterior[votes] if votes[j] > 0 else 1 - posterior[votes])
            right[j] = agree / cast
    return share, right, posterior


def inputs(votes: tuple[int, ...], shape: tuple[int, ...] = ()) -> list[float]:
    """The classifier's inputs: votes as they are, and a place for each value of each trait."""
    out = [float(v) for v in votes]
    for value, size in zip(shape, TRAITS):
        out += [float(value == k) for k in range(size)]
    return out


def fit(patterns: dict, posterior: dict, penalty: float = 1.0, steps: int = 40) -> list[float]:
    """Logistic weights (bias first), trained on posteriors by Newton steps with a ridge penalty.

    ``patterns`` counts votes, or pairs of votes and traits; ``posterior`` is by votes.
    """
    rows = [(k, ()) if not isinstance(k[0], tuple) else k for k in patterns]
    if not rows:
        return [0.0] * (1 + len(LABELERS) + sum(TRAITS))
    x = np.array([[1.0, *inputs(votes, shape)] for votes, shape in rows])
    n, p = np.array(list(patterns.values()), float), np.array([posterior[votes] for votes, _ in rows])
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (q - p)) + ridge * weights
        hessian = (x * (n * (q * (1 - q) + 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        weights -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return weights.tolist()


@dataclass(frozen=True)
class Model:
    reliability: dict[str, list[float]]
    weights: dict[str, list[float]]


def train(found: DataFrame) -> Model:
    """Fit on the counts of (kind, votes, traits): a fixed number of kinds of spans, however many there are."""
    counts = (
        found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.traits").count()
        .orderBy("kind", "votes", "traits").collect()
    )
    reliability, weights = {}, {}
    for kind in KINDS:
        both = {(tuple(r["votes"]), tuple(r["traits"])): r["count"] for r in counts if r["kind"] == kind}
        patterns: dict[tuple[int, ...], int] = {}
        for (votes, _), n in both.items():
            patterns[votes] = patterns.get(votes, 0) + n
        _, reliability[kind], posterior = estimate(patterns)
        weights[kind] = fit(both, posterior)
    return Model(reliability, weights)


def _score(c: Column, model: Model) -> Column:
    out = None
    for kind in KINDS:
        bias, *own = model.weights[kind]
        z = F.lit(bias)
        for j in range(len(LABELERS)):
            z = z + F.element_at(c["votes"], j + 1) * F.lit(own[j])
        first = len(LABELERS)
        for j, size in enumerate(TRAITS):
            z = z + F.element_at(F.lit(own[first : first + size]), F.element_at(c["traits"], j + 1).cast("int") + 1)
            first += size
        out = F.when(c["kind"] == kind, z) if out is None else out.when(c["kind"] == kind, z)
    return out


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``spans``: (kind, start, end, base) in order of start.

    Candidates are written once, without texts, and used twice: to fit the model and to decide. A
    column of ``docs`` named spans or candidates is replaced.
    """
    rest = without(docs, "spans", "candidates", text_col)
    found = stored(docs.select(*[F.col(f"`{c}`") for c in rest.columns], candidates(F.col(text_col)).alias("candidates")), "pii")
    model = train(found)
    base = F.filter("candidates", lambda c: c["base"])
    more = F.filter("candidates", lambda c: ~c["base"] & (_score(c, model) >= 0))

    def clear(c: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(
        F.concat(base, F.filter(more, clear)),
        lambda c: F.struct(c["start"], F.element_at(rank, c["kind"]).alias("rank"), c["end"], c["kind"], c["base"]),
    )
    spans = F.transform(
        F.array_sort(keyed), lambda c: F.struct(c["kind"], c["start"], c["end"], c["base"])
    )
    return found.select(*[F.col(f"`{c}`") for c in rest.columns], spans.cast(f"array<{SPAN}>").alias("spans"))
