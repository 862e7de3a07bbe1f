"""Places of a pattern's matches in a text, by Column expressions.

Offsets count code points from 0, ends exclusive. Matches are the leftmost ones that do
not overlap. Patterns use possessive loops and look-behinds, so that a long run of one
class of characters is read once and never deepens the matcher's stack. Running sums are
taken in blocks and overlaps counted by sorted ends, so a text with very many hits costs
hardly more a hit than one with few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..functions.numeric import let

# Characters kept on either side of a match.
CONTEXT = 24
# Sums that are taken together.
BLOCK = 512

_HIT = "array<struct<start:int,end:int,hit:string,part:string,before:string,after:string>>"


def _sums(values: Column) -> Column:
    return F.aggregate(values, F.array().cast("array<int>"), lambda done, v: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + v)))


def running(values: Column) -> Column:
    """Running sums of an array of ints; no array of more than ``BLOCK`` is copied once per element."""

    def blocks(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return let(F.transform(at, lambda b: _sums(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))), shifted)

    def shifted(parts: Column) -> Column:
        totals = _sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(totals, lambda t: F.flatten(F.transform(parts, lambda p, b: let(F.coalesce(F.get(t, b - 1), F.lit(0)), lambda more: F.transform(p, lambda v: v + more)))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<int>")))


def below(points: Column, marks: Column, inclusive: bool) -> Column:
    """For each point the number of marks below it (or, inclusive, at it), by one sort."""
    marked = F.transform(marks, lambda m: F.struct(m.alias("at"), F.lit(0 if inclusive else 1).alias("turn"), F.lit(1).alias("n"), F.lit(-1).alias("i")))
    asked = F.transform(points, lambda p, i: F.struct(p.alias("at"), F.lit(1 if inclusive else 0).alias("turn"), F.lit(0).alias("n"), i.alias("i")))

    def counted(events: Column) -> Column:
        sums = running(F.transform(events, lambda e: e["n"]))
        told = let(sums, lambda r: F.transform(events, lambda e, k: F.struct(e["i"].alias("i"), F.get(r, k).alias("c"))))
        return F.transform(F.array_sort(F.filter(told, lambda x: x["i"] >= 0)), lambda x: x["c"])

    return let(F.array_sort(F.concat(marked, asked)), counted)


def matches(text: Column, pattern: str, part: int = 0) -> Column:
    """Every match: ``start, end, hit, part`` (of a group), ``before`` and ``after``."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("parts"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def placed(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(x["hits"]) - 1)
        ends = running(F.transform(at, lambda i: F.length(F.get(x["gaps"], i)) + F.length(F.get(x["hits"], i))))
        return let(ends, lambda e: F.transform(at, lambda i: one(x, e, i)))

    def one(x: Column, ends: Column, i: Column) -> Column:
        hit, end = F.get(x["hits"], i), F.get(ends, i)
        before, after = F.get(x["gaps"], i), F.get(x["gaps"], i + 1)
        return F.struct(
            (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit"), F.get(x["parts"], i).alias("part"),
            F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
        )

    return F.when(text.rlike(pattern), let(found, placed).cast(_HIT)).otherwise(F.array().cast(_HIT))


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of structs ``kind`` (a number), ``start``, ``end``, by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def plain(hits: Column, kind: int) -> Column:
    """``kind, start, end`` of matches."""
    return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end")))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others.

    As many others overlap a span as begin before its end and do not end by its start.
    """

    def free(x: Column) -> Column:
        begun = below(F.transform(x["s"], lambda s: s["end"]), F.transform(x["o"], lambda o: o["start"]), False)
        over = below(F.transform(x["s"], lambda s: s["start"]), F.transform(x["o"], lambda o: o["end"]), True)
        return let(F.struct(begun.alias("begun"), over.alias("over")), lambda c: F.filter(x["s"], lambda s, i: F.get(c["begun"], i) == F.get(c["over"], i)))

    both = F.struct(spans.alias("s"), others.alias("o"))
    return let(both, lambda x: F.when((F.size(x["s"]) == 0) | (F.size(x["o"]) == 0), x["s"]).otherwise(free(x)))
