"""Personal data by weak supervision, in Column expressions.

Base patterns give spans that always stay. Wider patterns give further candidates.
Labelers (form, gazetteer, context, boundary) vote on every candidate; expectation
maximisation over the counts of vote patterns estimates how reliable each is, and its
posteriors train a logistic classifier that decides on the further candidates.
Only counts per pattern, whose number is fixed, come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .spans import apart, joined, matches, plain

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 25
THRESHOLD = 0.5

# Fixed patterns of the base spans. A match may begin where the one before ended or
# where no character of its first class stands before: elsewhere it would fail alike.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further forms: spelt-out addresses, eight-group addresses, short card numbers, local numbers.
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{13,15}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)\x20?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9])",
}
# Cheap signs without which a kind cannot occur.
_SIGN = {"email": "@", "ip": ".", "phone": "+"}

# Gazetteers: ends of host names; first digits of card issuers; common area or country codes; private networks.
_KNOWN = {
    "email": r"(?i)\b(com|org|net|edu|gov|info|de|fr|es|uk|eu|io)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+?\(?(1|3[0-9]|4[0-9]|[2-9][0-9]{2})",
}
_CUES = {
    "email": r"(?i)(mail|contact|write|reach|addr)",
    "ip": r"(?i)(\bip\b|host|server|address|client|login)",
    "card": r"(?i)(card|visa|master|credit|pay|amex)",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|contact)",
}
_AGAINST = r"(?i)(version|release|\bv|section|figure|table|page|isbn|order|invoice|date|year|\bno|\bid)[\x20.:#]*$"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    n = F.length(_digits(hit))
    if kind == "ip":
        parts = F.split(hit, r"\.")
        return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(hit))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _wide_valid(kind: str, hit: Column) -> Column:
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(7, 12)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 abstains."""
    v = F.when(yes, F.lit(1))
    return (v.when(no, F.lit(-1)) if no is not None else v).otherwise(F.lit(0))


def _candidate(kind: int, h: Column, base: bool) -> Column:
    """A candidate with the labelers' votes and the classifier's features."""
    name = KINDS[kind]
    n = F.length(_digits(h["hit"]))
    form = {
        "email": _vote(h["hit"].rlike(r"(?i)[a-z]{2,}$"), h["hit"].rlike(r"[0-9]$")),
        "ip": _vote(~h["hit"].rlike(r"(^|\.)0[0-9]"), h["hit"].rlike(r"(^|\.)0[0-9]")),
        "card": _vote(n >= 15, n < 14),
        "phone": _vote(h["hit"].rlike(r"^\+") | (n == 10), n < 8),
    }[name]
    glued = h["before"].rlike(r"[A-Za-z0-9_]$") | h["after"].rlike(r"^[A-Za-z0-9_]")
    return F.struct(
        F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end"), F.lit(base).alias("base"), form.alias("form"),
        _vote(h["hit"].rlike(_KNOWN[name]), ~h["hit"].rlike(_KNOWN[name])).alias("known"),
        _vote(h["before"].rlike(_CUES[name]), h["before"].rlike(_AGAINST)).alias("context"),
        _vote(~glued, glued).alias("boundary"),
        F.when(h["hit"].rlike(r"[()\[\]]"), 2).when(h["hit"].rlike(r"[\x20.:@-]"), 1).otherwise(0).alias("separators"),
        F.least(F.floor(F.length(h["hit"]) / 8), F.lit(3)).cast("int").alias("length"),
    )


def _where(hits: Column, holds, kind: str) -> Column:
    return F.filter(hits, lambda h: holds(kind, h["hit"]))


def _voted(hits: Column, kind: int, base: bool) -> Column:
    return F.transform(hits, lambda h: _candidate(kind, h, base))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


VOTES = ("form", "known", "context", "boundary")
FEATURES = (*VOTES, "separators", "length")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, candidates`` of each row: base spans, and all candidates with votes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    hits, base, wide = [], [], []
    for k, kind in enumerate(KINDS):
        found = matches(F.col("text"), BASE[kind])
        if kind in _SIGN:
            found = F.when(F.col("text").contains(_SIGN[kind]), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,part:string,before:string,after:string>>"))
        hits.append(_where(found, _valid, kind).alias(f"base_{kind}"))
        hits.append(_where(matches(F.col("text"), WIDE[kind]), _wide_valid, kind).alias(f"wide_{kind}"))
        base.append(plain(F.col(f"base_{kind}"), k))
        wide += [_voted(F.col(f"base_{kind}"), k, True), _voted(F.col(f"wide_{kind}"), k, False)]
    return rows.select("doc_id", *hits).select("doc_id", F.concat(*base).alias("base"), F.concat(*wide).alias("candidates"))


def reliabilities(counts: dict[tuple, int]) -> dict[tuple, float]:
    """Posterior that a span is real for each (kind, votes), by expectation maximisation.

    One latent class per kind; a labeler's vote depends on the class alone. It starts
    from the share of votes for a span, and counts are smoothed by one vote each.
    """
    posterior = {}
    for kind in sorted({key[0] for key in counts}):
        own = {key: n for key, n in counts.items() if key[0] == kind}
        real = {key: (1 + sum(v == 1 for v in key[1:])) / (2 + sum(v != 0 for v in key[1:])) for key in own}
        for _ in range(ROUNDS):
            total = [sum(n * (p if c else 1 - p) for n, p in ((own[k], real[k]) for k in own)) for c in (0, 1)]
            prior = (total[1] + 1) / (sum(total) + 2)
            chance = [
                [{v: (1 + sum(own[k] * (real[k] if c else 1 - real[k]) for k in own if k[1 + j] == v)) / (3 + total[c]) for v in (-1, 0, 1)} for j in range(len(VOTES))]
                for c in (0, 1)
            ]
            for key in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[1][j][v] / chance[0][j][v]) for j, v in enumerate(key[1:]))
                real[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        posterior |= real
    return posterior


def _features(kind: int, values: tuple) -> list[float]:
    return [1.0 if kind == k else 0.0 for k in range(len(KINDS))] + [float(v) for v in values]


def train(counts: dict[tuple, int], posterior: dict[tuple, float], rounds: int = 200, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier on ``FEATURES``, taught by the posteriors.

    Gradient steps over the counted feature patterns; ``counts`` has (kind, features).
    """
    data = [(_features(key[0], key[1:]), n, posterior[key[: 1 + len(VOTES)]]) for key, n in sorted(counts.items())]
    whole = sum(n for _, n, _ in data)
    weights = [0.0] * (len(KINDS) + len(FEATURES))
    for _ in range(rounds if whole else 0):
        slope = [-ridge * w for w in weights]
        for x, n, p in data:
            error = n / whole * (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x)))))))
            for i, v in enumerate(x):
                slope[i] += error * v
        weights = [w + s for w, s in zip(weights, slope)]
    return weights


def accepted(c: Column, weights: list[float]) -> Column:
    kinds = F.array(*[F.lit(w) for w in weights[: len(KINDS)]])
    score = F.get(kinds, c["kind"])
    for w, name in zip(weights[len(KINDS) :], FEATURES):
        score = score + c[name] * F.lit(w)
    return score >= math.log(THRESHOLD / (1 - THRESHOLD))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of each row: arrays of ``kind`` (a number), ``start``, ``end``.

    Base spans all stay; an added span overlaps none of them and no added one of an
    earlier kind. A null text counts as empty; repeated rows give a row each; further
    columns are ignored; an empty table gives an empty one.
    """
    found = materialize(candidates(docs), "candidates")
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", *[f"c.{f}" for f in FEATURES])
    # At most 4 kinds x 3**4 votes x 3 x 4 rows.
    counts = {tuple(r)[:-1]: r["count"] for r in each.groupBy("kind", *FEATURES).count().collect()}
    votes: dict[tuple, int] = {}
    for key, n in counts.items():
        votes[key[: 1 + len(VOTES)]] = votes.get(key[: 1 + len(VOTES)], 0) + n
    weights = train(counts, reliabilities(votes))
    more = F.filter("candidates", lambda c: ~c["base"] & accepted(c, weights))
    spans = F.col("base")
    chosen = found.select("doc_id", "base", F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("more"))
    for k in range(len(KINDS)):
        chosen = chosen.select("doc_id", "base", "more", F.concat(spans, apart(_of_kind(F.col("more"), k), spans)).alias("spans"))
        spans = F.col("spans")
    return chosen.select("doc_id", "base", F.array_sort("spans").alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
