"""Scalar and in-row array arithmetic. Everything here is a Column expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double_array(values: Sequence[float]) -> Column:
    """Array literal; folded once by the optimizer, shipped with the plan."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def int_array(values: Sequence[int]) -> Column:
    if not len(values):
        return F.array().cast("array<int>")
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>")


def string_array(values: Sequence[str]) -> Column:
    """Array literal of names; as one split text it stays one plan node."""
    if not len(values):
        return F.array().cast("array<string>")
    return F.split(F.lit("\x1f".join(map(str, values))), "\x1f")


def is_finite(c: Column | str) -> Column:
    c = _col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    return F.when(is_finite(c), _col(c))


def to_number(c: Column | str) -> Column:
    """Finite number in a text cell, else null.

    The pattern keeps Java-only spellings such as ``1f`` or ``1.5d`` out.
    """
    c = _col(c)
    return finite_or_null(F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double")))


def as_number(c: Column | str) -> Column:
    """A number as double; a text only if it spells one plainly."""
    c = _col(c)
    return F.when(F.typeof(c) == "string", to_number(c.cast("string"))).otherwise(c.try_cast("double"))


def sigmoid(c: Column | str) -> Column:
    """Logistic function in the branch that cannot overflow."""
    c = _col(c)
    return F.when(c >= 0, 1.0 / (1.0 + F.exp(-c))).otherwise(F.exp(c) / (1.0 + F.exp(c)))


def let(value: Column | str, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer moves a column's definition to where the column is used; inside
    a lambda that would repeat it for every element. A lambda variable stays put.
    """
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def gather(values: Column | str, positions: Sequence[int]) -> Column:
    """Array elements at the given positions; null outside the array."""
    at = int_array(positions)
    return let(values, lambda v: F.transform(at, lambda i: F.get(v, i)))


def array_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)


def softmax(c: Column | str) -> Column:
    def shifted(x):
        return let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

    def normalized(e):
        return let(array_sum(e), lambda total: F.transform(e, lambda v: v / total))

    return let(let(c, shifted), normalized)


def log2_tpm1(c: Column | str) -> Column:
    """log2(tpm + 1) for finite, non-negative tpm; null otherwise."""
    c = _col(c)
    return F.when(is_finite(c) & (c >= 0), F.log2(c + 1.0))


def decode_log2_tpm001(c: Column | str) -> Column:
    """log2(tpm + 0.001) to log2(tpm + 1); null when it decodes below zero."""
    tpm = F.pow(F.lit(2.0), _col(c)) - 0.001
    return F.when(
        is_finite(c) & is_finite(tpm) & (tpm >= -1e-6), F.log2(F.greatest(tpm, F.lit(0.0)) + 1.0)
    )


def call(p: Column | str, threshold: float | Column, positive: str = "tumor", negative: str = "normal") -> Column:
    return F.when(_col(p) >= threshold, F.lit(positive)).otherwise(F.lit(negative))


def argmax_class(p: Column | str, classes: Sequence[str]) -> Column:
    """Class of the largest probability, the first one on ties."""
    p = _col(p)
    return F.element_at(string_array(classes), F.array_position(p, F.array_max(p)).cast("int"))


def direction_if_high(c: Column | str) -> Column:
    return F.when(_col(c) >= 0, F.lit("tumor")).otherwise(F.lit("normal"))


def preview(c: Column | str, limit: int = 5) -> Column:
    """First entries of an array as text, with an ellipsis when cut."""
    c = _col(c)
    return F.concat(
        F.array_join(F.slice(c, 1, limit), ", "), F.when(F.size(c) > limit, F.lit(", ...")).otherwise(F.lit(""))
    )


def sorted_quantile(sorted_values: Column, p: float) -> Column:
    """Linear-interpolated quantile of an already sorted array."""
    n = F.size(sorted_values)
    at = (n - 1) * F.lit(float(p))
    lo = F.floor(at).cast("int")
    low, high = F.get(sorted_values, lo), F.get(sorted_values, F.least(lo + 1, n - 1))
    return low + (high - low) * (at - lo)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def quantile_name(p: float) -> str:
    return "min" if p == 0 else "max" if p == 1 else f"p{int(p * 100):02d}"


def check_fraction(value: float, name: str = "threshold") -> float:
    """A plain number in [0, 1], as every public threshold must be."""
    if isinstance(value, bool):
        raise ValueError(f"{name}: a bool is not a fraction")
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name}: {value!r} is not a number") from None
    if not 0 <= number <= 1:
        raise ValueError(f"{name}: {number} lies outside [0, 1]")
    return number
