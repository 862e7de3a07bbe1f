"""Filter interaction audit: what five filters do to each part of a corpus, in every order.

A counting Bloom sketch of all texts comes first: each task counts into cells of its
own, the sketches are merged cell by cell, and a text with a cell that only it fills is
unique for certain. Only the texts left, possible repeats, are shuffled and grouped by
their whole text for the smallest id. What a document fails is a mask of five bits;
documents with the same part, mask and labels are counted, and every figure of every
order is a sum of those counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .tokens import by_bytes

# Filters in the order of their bits, the lowest first.
LETTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#$%&*|"
REPEAT = 1 << LETTERS.index("E")

# Cells of the sketch for each row, and cells at most: two bits each, so 32 MB. Beyond
# some 10 million rows it clears fewer texts and more are shuffled; results stay the same.
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 27
SLICE = 1 << 16
# Odd multipliers that give a text's cells.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """A row of cells for each hash; ``cells`` is a power of two."""
    return ((hashes.view(np.uint64)[:, None] * _PLACES) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _packed(counts: np.ndarray) -> np.ndarray:
    """Counts 0 to 2 in two bits each."""
    four = counts.reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6


def _unpacked(cells: np.ndarray) -> np.ndarray:
    return np.stack([cells >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel()


def sketch(hashes: DataFrame, rows: int, most: int = MAX_CELLS) -> np.ndarray:
    """Merged counts (none, one, more) of the cells of all ``h``, packed by two bits.

    Its size follows ``rows`` up to ``most`` cells, so what comes to the driver is bounded.
    """
    cells = min(most, max(SLICE, 1 << (CELLS_PER_ROW * rows).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint8)
        for batch in batches:
            at, n = np.unique(_cells(np.asarray(batch.column(0), np.int64), cells), return_counts=True)
            counts[at] = np.minimum(counts[at] + np.minimum(n, 2).astype(np.uint8), 2)
        pack = zstandard.ZstdCompressor(level=1)
        used = np.flatnonzero(counts.reshape(-1, SLICE).any(axis=1))
        parts = [pack.compress(_packed(counts[k * SLICE : (k + 1) * SLICE]).tobytes()) for k in used.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(parts, pa.binary())], ["slice", "cells"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total, unpack = np.zeros(SLICE, np.uint8), zstandard.ZstdDecompressor()
        for part in table["cells"]:
            total = np.minimum(total + _unpacked(np.frombuffer(unpack.decompress(part.as_buffer()), np.uint8)), 2)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "cells": pa.array([_packed(total).tobytes()], pa.binary())})

    merged = np.zeros(cells // 4, np.uint8)
    slices = hashes.mapInArrow(count, "slice long, cells binary").groupBy("slice").applyInArrow(merge, "slice long, cells binary")
    for r in slices.toLocalIterator():
        at = r["slice"] * SLICE // 4
        merged[at : at + SLICE // 4] = np.frombuffer(r["cells"], np.uint8)
    return merged


def met(hashes: np.ndarray, cells: np.ndarray, times: int) -> np.ndarray:
    """Whether a sketch may have met each hash once or (2) more often; false only if it has not."""
    at = _cells(hashes, 4 * len(cells))
    return ((cells[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3) >= times).all(axis=1)


def text_mask(text: bytes, points: int) -> int:
    """Bits of the filters A to D that a text of so many code points fails."""
    words = text.split()  # for bytes: white space is 20 and 09 to 0D
    n = len(words)
    short = n < MIN_WORDS
    same = 100 * len(set(words)) < DISTINCT_PERCENT * n
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > UPPER_PERCENT * points
    marked = len(text.translate(None, _MARKS)) < len(text)
    return short | same << 1 | loud << 2 | marked << 3


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of each row of ``docs``; part is the language.

    A null text counts as empty, a null language as an empty string. A row fails E if
    a row with a smaller doc_id has the same whole text; a null id is neither smaller
    nor larger than any. Repeated rows are rows of their own and fail E together or
    not at all. Further columns are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    hashed = source.select(F.xxhash64("text").alias("h"))
    cells = docs.sparkSession.sparkContext.broadcast(sketch(hashed, docs.count()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                texts, points = part.column(2), pc.utf8_length(part.column(2)).to_pylist()
                mask = [text_mask(t.as_buffer().to_pybytes(), n) for t, n in zip(texts, points)]
                maybe = met(np.asarray(part.column(3), np.int64), cells.value, 2)
                kept = texts.take(pa.array(np.arange(len(maybe)), mask=~maybe))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(mask, pa.int32()), kept], ["doc_id", "part", "mask", "text"])

    found = source.withColumn("h", F.xxhash64("text")).mapInArrow(rows, "doc_id long, part string, mask int, text string")
    found = materialize(found, "masks")
    # The first of a text is joined by text and id, so that no text's copies meet in one task.
    key = F.sha2(F.encode("text", "UTF-8"), 256)
    maybe = found.where("text is not null")
    first = maybe.groupBy("text").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select(key.alias("key"), "doc_id", F.lit(True).alias("first"))
    told = maybe.select("doc_id", "part", "mask", key.alias("key")).join(first, ["key", "doc_id"], "left")
    repeats = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(REPEAT)).otherwise(F.lit(0))
    cleared = found.where("text is null").select("doc_id", "part", "mask")
    return cleared.unionByName(told.select("doc_id", "part", (F.col("mask") + repeats).alias("mask")))


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, and those labelled good and toxic.

    A document whose id has several rows of labels is good or toxic if one says so.
    """
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int")
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    named = masked.where("doc_id is not null").join(told, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = masked.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    every = named.unionByName(nameless)
    return every.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def _orders() -> list[tuple[str, int, int, int]]:
    """``filter_order, step, earlier, bit`` of every step of every order."""
    found = []
    for order in map("".join, permutations(LETTERS)):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            found.append((order, step, earlier, bit))
            earlier |= bit
    return found


def interactions(counts: DataFrame) -> DataFrame:
    """Figures of each part, order of filters and step, from ``part, mask, n, good, toxic``.

    ``kept`` and ``removed`` count documents after and in the step, ``redundant`` those
    that fail its filter but were gone before, ``unique_fails`` those that fail it alone,
    ``good_lost`` and ``toxic_lost`` the labelled among the removed, and ``shapley`` sums
    the filter's removed over all orders.
    """
    # What a step does depends on the set of earlier filters alone: 80 cases, 600 steps.
    cases = sorted({(earlier, bit) for _, _, earlier, bit in _orders()})
    literal = F.array(*[F.struct(F.lit(e).alias("earlier"), F.lit(b).alias("bit")) for e, b in cases])
    each = counts.withColumn("case", F.explode(literal)).select("part", "mask", "n", "good", "toxic", "case.earlier", "case.bit")
    here, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(which: Column, of: str = "n") -> Column:
        return F.sum(F.when(which, F.col(of)).otherwise(F.lit(0))).cast("long")

    steps = each.groupBy("part", "earlier", "bit").agg(
        total(~here & ~before).alias("kept"), total(here & ~before).alias("removed"), total(here & before).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here & ~before, "good").alias("good_lost"), total(here & ~before, "toxic").alias("toxic_lost"),
    )
    others = len(LETTERS) - 1
    weights = F.array(*[F.lit(factorial(k) * factorial(others - k)) for k in range(len(LETTERS))])
    weighed = F.col("removed") * F.get(weights, F.bit_count("earlier"))
    shares = steps.groupBy("part", "bit").agg(F.sum(weighed).cast("long").alias("shapley"))
    orders = F.broadcast(counts.sparkSession.createDataFrame(_orders(), "filter_order string, step int, earlier int, bit int"))
    told = steps.join(shares, ["part", "bit"]).join(orders, ["earlier", "bit"])
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Figures of every order of the five filters over ``docs`` (see ``masks``, ``interactions``)."""
    return interactions(materialize(mask_counts(masks(docs), labels), "mask_counts"))
