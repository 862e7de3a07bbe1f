"""Near copies: pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Equal shingle sets are one class. SimHash (``simhash``) names the classes that may be
alike: fingerprints of 256 bits over the sets, compared in tiles by exclusive-or and bit
counts, as op1 does with 64. Bits of a pair at 0.8 differ with odds of 0.152 (0.188 for
four shingles against five, the worst), so it lies beyond the radius, or beyond the one of
the first word, with odds of 3 in a million (9 in 100,000). Sets whose sizes rule 0.8 out
do not meet. What the links reach is a group; its classes are then compared by their whole
shingle sets, so no link is below the least similarity. A group's classes are dealt to
tiles and every two tiles meet; each comparison gives the links of a spanning forest,
never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import simhash
from .components import components
from .rows import kept_once
from .simhash import text_key
from .tokens import by_bytes

SHINGLE = 5
# Least similarity as a fraction, so that it is told in whole numbers.
LEAST = (4, 5)
# Words of a fingerprint; bits in which two of them, and their first words, may differ.
FP_WORDS, RADIUS, FIRST_RADIUS = 4, 72, 24
# Cells of sizes within the factor of 1.25 that 0.8 allows (a trifle more, for rounding).
STEPS = 4
CELL = math.log(LEAST[1] / LEAST[0]) * (1 + 1e-9) / STEPS
SEED = 42
# Classes and shingles in a tile.
TILE = 512
TILE_SHINGLES = 1 << 20


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of all shingles; a text of fewer words is one, without words none."""
    words = text.lower().split()  # for bytes: A-Z, and white space is 20 and 09 to 0D
    n = max(1, len(words) - shingle + 1) if words else 0
    cut = (b" ".join(words[i : i + shingle]) for i in range(n))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in cut), np.uint64, n))


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class, n_shingles, fp`` (a fingerprint's words as bytes) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                sets = [shingles(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part.column(2)]
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                found = [simhash.wide_fingerprint(s, FP_WORDS).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.binary())],
                    ["doc_id", "text_key", "class", "n_shingles", "fp"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, text_key long, class long, n_shingles long, fp binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, shingles`` (as bytes) of each class of ``wanted`` (``text_key, class``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                sets = [shingles(x.as_buffer().to_pybytes()).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["class", "shingles"])

    texts = docs.select(text_key(), F.col("text").cast("string").alias("text")).join(wanted, "text_key").select("class", "text")
    return texts.mapInArrow(rows, "class long, shingles binary").dropDuplicates(["class"])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all pairs of sets (none empty) of the least similarity.

    Jaccard distance is a metric: a member of a component is compared with the others
    only where its and their distances from the component's first member differ by no
    more than the greatest that links. A component that nothing surrounds is done at once.
    """
    size = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    mark = np.zeros(len(words), bool)
    up, down = LEAST
    reach = 1 - up / down + 1e-9
    free = np.ones(len(sets), bool)
    found = []

    def common(i: int) -> np.ndarray:
        own = flat[starts[i] : starts[i] + size[i]]
        mark[own] = True
        n = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        return n

    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first] = False
        from_first, queue = None, [first]
        while queue:
            i = queue.pop()
            if from_first is not None and not (free & (abs(from_first - from_first[i]) <= reach)).any():
                continue
            n = common(i)
            union = size + size[i] - n
            if from_first is None:
                from_first = 1 - n / union
            new = np.flatnonzero(free & (down * n >= up * union)).tolist()
            free[new] = False
            found += [(i, j) for j in new]
            queue += new
    return found


def candidates(classes: DataFrame) -> DataFrame:
    """``vertex, root``: classes that may be alike have equal roots; those that are alone are left out."""
    cell = F.floor(F.log("n_shingles") / CELL)
    return components(simhash.wide_links(classes.where("n_shingles > 0"), RADIUS, FIRST_RADIUS, cell, STEPS))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: links between ``class``es that join all pairs of the least similarity which share a group."""
    grouped = candidates(classes).join(classes.select(F.col("class").alias("vertex"), "n_shingles"), "vertex").select(F.col("vertex").alias("class"), "n_shingles", F.col("root").alias("group"))
    grouped = materialize(grouped, "groups")
    sums = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("n") / TILE, F.col("weight") / TILE_SHINGLES)).alias("blocks")
    members = grouped.select("class", "group").join(sums.select("group", blocks), "group")
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))), "members")
    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select(F.col("first.text_key").alias("text_key"), "class")
    sets = materialize(_sets(docs, wanted), "shingles")
    tile = F.collect_list(F.struct("class", "shingles")).alias("tile")
    tiles = materialize(members.join(sets, "class").groupBy("group", "block", "blocks").agg(tile), "tiles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                both = [c.slice(k, 1).flatten() for c in batch.columns]
                keys = np.concatenate([np.asarray(x.field("class")) for x in both])
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for x in both for s in x.field("shingles")]
                for i, j in forest(sets):
                    a.append(min(keys[i], keys[j]))
                    b.append(max(keys[i], keys[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    alone = tiles.where("blocks = 1").select("tile").mapInArrow(compare, "a long, b long")
    # A pair of tiles also compares each with itself.
    many = tiles.where("blocks > 1")
    left = many.where(F.col("block") < F.col("blocks") - 1).select("group", F.col("tile").alias("own"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"))
    pairs = left.join(many.select("group", "block", "tile"), ["group", "block"]).select("own", "tile")
    return alone.unionByName(pairs.mapInArrow(compare, "a long, b long")).distinct()


def kept_rows(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of near copies, with all its columns.

    The row with the smallest doc_id stays (a null id only where there is no other), of
    several texts with that id the one with the smallest key. Texts without words, null
    included, are equal; texts of fewer than five words are alike only where their words
    are the same. An empty table gives an empty one.
    """
    found = materialize(_signed(docs), "fingerprints")
    texts = found.groupBy("doc_id", "text_key", "class").agg(F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("fp").alias("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("first")
    classes = materialize(texts.groupBy("class").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("fp").alias("fp")), "classes")
    roots = components(links(docs, classes))
    rooted = classes.select("class", "first").join(roots, F.col("class") == F.col("vertex"), "left").withColumn("root", F.coalesce("root", "class"))
    names = rooted.groupBy("root").agg(F.min("first").alias("name"))
    marks = materialize(names.select(F.col("name.doc_id").alias("doc_id"), F.col("name.text_key").alias("key"), F.col("name.n").alias("n")), "kept")
    return kept_once(docs, text_key(), marks)
