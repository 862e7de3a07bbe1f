"""Secrets by a trigram inverted index, in Column expressions.

From each rule's pattern follows a Boolean query over trigrams that every match must
hold. Postings of those trigrams are intersected, and only texts that answer a rule's
query meet its pattern. A rule whose pattern needs no trigram reads every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
import re
import re._constants as op
import re._parser as regex

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .simhash import text_key
from .spans import matches


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds; a match stays if it has ``least`` characters (in ``part``)."""

    kind: str
    pattern: str
    least: int = 1
    part: int = 0


# Fixed patterns of the base kinds, then well-known key forms.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]++", 20),
    Rule("hex", r"[0-9a-f]++", 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]++", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]++", 20),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]++", 24),
)
RULES = BASE_RULES + MORE_RULES

# Strings that a stretch of a pattern may stand for before they are turned into a query.
MOST_STRINGS = 64
MOST_CLASS = 8

# A pattern that is nothing but a loop over one class.
_LOOP = re.compile(r"(\[[^\]]+\])\+\+")

Query = frozenset  # of alternatives, each a frozenset of trigrams; empty: nothing is needed


def _both(a: Query, b: Query) -> Query:
    if not a or not b:
        return a or b
    return frozenset(x | y for x, y in product(a, b))


def _trigrams(strings: set[str]) -> Query:
    """Any of the strings: an alternative for each; nothing, if one is too short."""
    if any(len(s) < 3 for s in strings):
        return frozenset()
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _derive(parts) -> tuple[set[str] | None, Query]:
    """What a parsed sequence stands for: its strings, if they are few, and its query."""
    query: Query = frozenset()
    strings, exact = {""}, True
    for kind, value in parts:
        options: set[str] | None = None
        inner: Query = frozenset()
        if kind is op.LITERAL:
            options = {chr(value).lower()}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= MOST_CLASS:
            options = {chr(v).lower() for _, v in value}
        elif kind is op.SUBPATTERN:
            options, inner = _derive(value[-1])
        elif kind is op.BRANCH:
            each = [_derive(x) for x in value[1]]
            if all(s is not None for s, _ in each):
                options = set().union(*[s for s, _ in each])
            elif all(q for _, q in each):
                inner = frozenset().union(*[q for _, q in each])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, body = value
            found, needed = _derive(body)
            if (least, most) == (0, 1) and found and len(body) == 1 and body[0][0] is op.LITERAL:
                options = {"", *found}
            elif least == most == 1:
                options, inner = found, needed
            elif least >= 1:
                inner = needed
        elif kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
            continue
        if options is not None and len(strings) * len(options) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, options)}
        else:
            query, exact = _both(query, _both(_trigrams(strings), inner if options is None else _trigrams(options))), False
            strings = {""}
    if exact:
        return strings, frozenset()
    return None, _both(query, _trigrams(strings))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams one of which every match holds whole; empty if none is sure."""
    strings, query = _derive(regex.parse(pattern))
    return _trigrams(strings) if strings is not None else query


def _spans(text: Column, rule: Rule, number: int) -> Column:
    found = F.filter(matches(text, rule.pattern, rule.part), lambda h: F.length(h["part"]) >= rule.least)
    return F.transform(found, lambda h: F.struct(h["start"].alias("start"), F.lit(number).alias("kind"), h["end"].alias("end")))


def _hits(text: Column, rules: tuple[Rule, ...], number: dict[str, int], when: Column | None = None) -> Column:
    """``start, kind, end`` of the rules' matches; ``when`` names the rules to try on a row."""
    each = []
    for r in rules:
        spans = _spans(text, r, number[r.kind])
        each.append(spans if when is None else F.when(F.array_contains(when, number[r.kind]), spans).otherwise(F.array().cast(_SPANS)))
    return F.concat(*each) if each else F.array().cast(_SPANS)


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def index(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """One scan of all texts: a row per document, and the postings of the rules' trigrams.

    First ``doc_id, text_key, spans`` with the spans of rules that must read every text;
    then ``trigram, doc_id, text_key``, sorted by trigram within each file.
    """
    number = {r.kind: i for i, r in enumerate(rules)}
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for some in q for g in some})
    scanned = tuple(_long(r) for r in rules if not queries[r.kind])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), text.alias("text"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    table = materialize(rows.select("doc_id", "text_key", held.alias("grams"), _hits(F.col("text"), scanned, number).cast(_SPANS).alias("spans")), "scan")
    postings = table.select(F.explode("grams").alias("trigram"), "doc_id", "text_key")
    return table.drop("grams"), materialize(postings.sortWithinPartitions("trigram"), "postings")


def _long(rule: Rule) -> Rule:
    """For a loop over one class: the length within the pattern, which finds the same."""
    m = _LOOP.fullmatch(rule.pattern)
    if not m or rule.part:
        return rule
    return Rule(rule.kind, f"(?<!{m[1]}){m[1]}{{{rule.least},}}+", rule.least)


def answers(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, text_key, rules``: the documents whose trigrams answer a rule's query."""
    terms = [(i, a, g, len(some)) for i, r in enumerate(rules) for a, some in enumerate(sorted(trigram_query(r.pattern), key=sorted)) for g in sorted(some)]
    wanted = postings.sparkSession.createDataFrame(terms, "rule int, alternative int, trigram string, needed int")
    # As many rows as the patterns have trigrams.
    joined = postings.distinct().join(F.broadcast(wanted), "trigram")
    whole = joined.groupBy("doc_id", "text_key", "rule", "alternative").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return whole.groupBy("doc_id", "text_key").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` of each row: arrays of ``start, kind`` (the rule's number), ``end`` in order.

    A null text counts as empty. Repeated rows give a row each; rows that share an id
    and text share a verification. Further columns are ignored; an empty table gives
    an empty one.
    """
    number = {r.kind: i for i, r in enumerate(rules)}
    table, postings = index(docs, rules)
    found = materialize(answers(postings, rules), "answers").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "rules")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tried = texts.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    checked = tried.select("id", "key", _hits(F.col("text"), indexed, number, F.col("rules")).alias("more"))
    checked = materialize(checked.where(F.size("more") > 0).dropDuplicates(["id", "key"]), "verified")
    joined = table.join(checked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    return joined.select("doc_id", F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"))


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """Counts of the base rules' spans, their digest, and all spans as text."""
    names = F.array(*[F.lit(r.kind) for r in rules])

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(k: int) -> Column:
        return F.filter("spans", lambda s: s["kind"] == k)

    counts = [F.size(of(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])]
    return found.select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda s: s["kind"] < base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
