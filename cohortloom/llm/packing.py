"""Packing documents into sequences: repeated length patterns by least squares.

The histogram of piece lengths has as many bins as a sequence has tokens, whatever
the table's size. Patterns of a few lengths that fill a sequence, or nearly, are fitted
to it by non-negative least squares, rounded down, topped up where the histogram
still has them, and what is left is packed best-fit over counts. This is done for
several bounds of what a pattern may leave free, and the fewest sequences win. Only the
histogram comes to the driver. Pieces are then numbered within their length, in hash slices,
and a piece's number tells its pattern, repeat and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .tokens import by_bytes, encoder, texts_of, with_end

CAPACITY = 1024
# Rows of one length that a task numbers together.
SLICE_ROWS = 50_000
SWEEPS = 20
# Documents in a pattern at most, and tokens it may leave free; one plan for each bound (first: pairs and triples alone).
MOST = 24
SLACKS = (None, 0, 4, 16)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's pieces.

    A null text counts as empty (its end id alone is a piece). Only documents longer
    than ``capacity`` are cut; their first piece may be shorter than the others.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                whole, at = with_end(*encoder(tokenizer).encode(texts_of(part)), end_id)
                n = np.diff(at)
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                data = memoryview(whole.tobytes())
                begin = (at[:-1][row] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths in the histogram that fill a sequence.

    A triple's shortest length lies on a grid of 64 steps, which keeps their number
    to some ten thousand; other lengths come into it as its second and third.
    """
    there = [int(x) for x in np.flatnonzero(counts)]
    has = set(there)
    found = [(capacity - a, a) for a in there if 2 * a <= capacity and capacity - a in has]
    grid = max(1, capacity // 64)
    for a in (x for x in there if x % grid == 0 and 3 * x <= capacity):
        found += [(capacity - a - b, b, a) for b in there if a <= b <= (capacity - a) // 2 and capacity - a - b in has]
    return found


def _longer(counts: np.ndarray, capacity: int, slack: int) -> list[tuple[int, ...]]:
    """Patterns of four documents or more of at most two lengths, those that leave least free first.

    Of each length a number of copies, and up to four of the largest other that still fits.
    """
    there = np.flatnonzero(counts)
    found: dict[tuple[int, ...], int] = {}
    for a in there.tolist():
        for m in range(2, min(capacity // a, MOST) + 1):
            rest = capacity - m * a
            if rest <= slack and m > 3:
                found[(a,) * m] = rest
            for k in range(max(1, 4 - m), min(4, MOST - m) + 1):
                at = int(np.searchsorted(there, rest // k, side="right")) - 1
                if at >= 0 and (free := rest - k * int(there[at])) <= slack:
                    found[tuple(sorted((a,) * m + (int(there[at]),) * k, reverse=True))] = free
    return sorted(found, key=lambda p: (found[p], [-x for x in p]))


def _fit(patterns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Repeats of each pattern: non-negative least squares by coordinate descent."""
    left = counts.astype(float).tolist()
    repeats = [0.0] * len(patterns)
    norms = [sum(p.count(x) ** 2 for x in set(p)) for p in patterns]
    for _ in range(SWEEPS):
        for i, p in enumerate(patterns):
            step = max(-repeats[i], sum(left[x] for x in p) / norms[i])
            if step:
                repeats[i] += step
                for x in p:
                    left[x] -= step
    return np.array(repeats)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats that use up ``counts[length]`` pieces of every length."""
    return min((_plan(counts, capacity, slack) for slack in SLACKS), key=lambda p: sum(n for _, n in p))


def _plan(counts: np.ndarray, capacity: int, slack: int | None) -> list[tuple[tuple[int, ...], int]]:
    left = counts.astype(np.int64).copy()
    chosen: dict[tuple[int, ...], int] = {}

    def take(p: tuple[int, ...], most: int) -> None:
        n = min([most, *(int(left[x]) // p.count(x) for x in set(p))])
        if n > 0:
            chosen[p] = chosen.get(p, 0) + n
            for x in p:
                left[x] -= n

    take((capacity,), int(left[capacity]))
    patterns = _patterns(left, capacity) + (_longer(left, capacity, slack) if slack is not None else [])
    repeats = _fit(patterns, left)
    for p, x in zip(patterns, repeats):
        take(p, int(x))
    for i in np.argsort(-(repeats - np.floor(repeats)), kind="stable"):
        take(patterns[i], 1)
    for p in patterns:
        take(p, int(left.max()))
    for p, n in _best_fit(left, capacity):
        chosen[p] = chosen.get(p, 0) + n
    return list(chosen.items())


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: pieces of a length go to open sequences by groups."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for x in np.flatnonzero(left)[::-1].tolist():
        c = int(left[x])
        while c:
            space = min((s for s in open_ if s >= x), default=None)
            if space is None:
                each = capacity // x
                full, rest = divmod(c, each)
                for times, n in ((each, full), (rest, 1)):
                    if times and n:
                        open_.setdefault(capacity - times * x, []).append(((x,) * times, n))
                break
            p, n = open_[space].pop()
            if not open_[space]:
                del open_[space]
            k = min(c, n)
            if n > k:
                open_.setdefault(space, []).append((p, n - k))
            open_.setdefault(space - x, []).append(((*p, x), k))
            c -= k
    return [g for groups in open_.values() for g in groups]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``.

    Every piece gets a place; places of a sequence follow without gaps from 0. Rows
    that repeat are pieces of their own. An empty table gives an empty one. Reserved
    column names begin with ``__pack``.
    """
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        if not 0 < r["length"] <= capacity:
            raise ValueError(f"a piece of length {r['length']} does not fit sequences of {capacity}")
        counts[r["length"]] = r["count"]
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for p, n in plan(counts, capacity):
        offset = 0
        for x in p:
            rows.append((x, int(used[x]), int(used[x]) + n, sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    # Bounded by the number of patterns, which depends on the capacity alone.
    places = F.broadcast(spark.createDataFrame(rows, "__pack_length long, __pack_from long, __pack_to long, __pack_sequence long, offset long"))

    slices = max(1, -(-int(counts.max()) // SLICE_ROWS), 64)
    sliced = cut.withColumn("__pack_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    key = ["length", "__pack_slice"]
    before = Window.partitionBy("length").orderBy("__pack_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*key).agg(F.count(F.lit(1)).alias("__pack_n")).withColumn("__pack_base", F.coalesce(F.sum("__pack_n").over(before), F.lit(0))).drop("__pack_n")
    numbered = sliced.withColumn("__pack_row", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece")))
    ranked = numbered.join(sizes, key).withColumn("__pack_rank", F.col("__pack_row") - 1 + F.col("__pack_base"))
    at = (F.col("length") == F.col("__pack_length")) & (F.col("__pack_rank") >= F.col("__pack_from")) & (F.col("__pack_rank") < F.col("__pack_to"))
    placed = ranked.join(places, at)
    return placed.select(*cut.columns, (F.col("__pack_sequence") + F.col("__pack_rank") - F.col("__pack_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; texts are encoded once."""
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
