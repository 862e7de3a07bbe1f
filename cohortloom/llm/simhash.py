"""SimHash near-duplicates: exact comparison of fingerprint tiles.

Equal fingerprints are one class. A tile holds classes whose four 16-bit words have
the same population counts. Counts of two fingerprints within the radius differ by
no more than the radius in sum, so all other tile pairs are skipped; those left are
compared whole, with numpy's exclusive-or and bit counts. Each pair of tiles gives
the links of a spanning forest, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .components import components
from .rows import kept_once
from .tokens import by_bytes

RADIUS = 2
SHINGLE = 3
SEED = 42
# Fingerprints in a tile; a population count with more of them has several tiles.
TILE = 4096
WORDS = 4
# Tiles of a table for one strip more.
STRIP = 512

_HASHES = 1 << 16
_WIDE_HASHES = 1 << 13
_COMPARED = 1 << 20
_WIDE_COMPARED = 1 << 17
# The bits of a byte, most significant first, as eight bytes.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, most significant first."""
    bytes_ = hashes.astype(">u8").view(np.uint8).reshape(len(hashes), -1)
    # Up to 255 ones fit a byte lane.
    sums = np.add.reduceat(_SPREAD[bytes_], np.arange(0, len(bytes_), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), -1).sum(axis=0, dtype=np.int64)


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hashes, and beside them the same ones mixed anew for each further word."""
    x = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = hashes
    return x


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of ``words`` times 64 bits over hashes of shingles; the first word is the plain one."""
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), _WIDE_HASHES):
        ones += _bit_counts(_mixed(hashes[i : i + _WIDE_HASHES], words))
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 of all shingles; 0 without words."""
    words = text.lower().split()  # for bytes: A-Z, and white space is 20 and 09 to 0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _HASHES):
        cut = map(line.__getitem__, map(slice, starts[i : i + _HASHES], ends[i : i + _HASHES]))
        ones += _bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp``: the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                fp = np.array([fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in part.column(2)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, text_key long, fp long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of each one's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the radius between two tiles."""
    left, right = [], []
    step = max(1, _COMPARED // len(b))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ b[None, :]) <= radius)
        if not len(i):
            continue
        if len(i) > len(rows) + len(b):
            label = _labels(i, j + len(rows), len(rows) + len(b))
            both = np.concatenate([rows, b])
            left.append(both)
            right.append(both[label])
        else:
            left.append(rows[i])
            right.append(b[j])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def wide_forest(a: np.ndarray, b: np.ndarray, radius: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (those of ``b`` after those of ``a``) of links that join what lies within the radius.

    Rows are wide fingerprints. Those whose first words differ in more than ``first`` bits are left out.
    """
    n = len(a) + len(b)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    own, other = (np.ascontiguousarray(x.T) for x in (a, b))
    step = max(1, _WIDE_COMPARED // len(b))
    for at in range(0, len(a), step):
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(own[0, at : at + step, None] ^ other[0]) <= first), len(b))
        i += at
        apart = np.bitwise_count(own[0, i] ^ other[0, j])
        # Word by word, with fewer pairs each time.
        for x, y in zip(own[1:], other[1:]):
            apart = apart + np.bitwise_count(x[i] ^ y[j])
            close = np.flatnonzero(apart <= radius)
            i, j, apart = i[close], j[close], apart[close]
        j += len(a)
        if len(i) > n:
            i = _labels(i, j, n)
            j = np.flatnonzero(i != np.arange(n))
            i = i[j]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if len(i) > n:
        i = _labels(i, j, n)
        j = np.flatnonzero(i != np.arange(n))
        i = i[j]
    return i, j


def wide_links(classes: DataFrame, radius: int, first: int, cell: Column, steps: int) -> DataFrame:
    """``a, b``: links between ``class``es that join all whose wide fingerprints (``fp``) lie within the radius.

    Only classes whose cells are at most ``steps`` apart meet. A cell's classes are dealt to
    tiles and every two tiles are compared whole. Strips share out the tiles that one key meets.
    """
    celled = classes.select("class", "fp", cell.alias("cell"))
    # Cells are few: this side is bounded by the logarithm of the sizes.
    counts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    dealt = celled.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    tiles = materialize(dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("class", "fp")).alias("tile")), "tiles")
    strips = 1 + tiles.count() // STRIP
    a = tiles.select("block", F.col("tile").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"), "cell", F.pmod("block", F.lit(strips)).alias("strip"))
    a = a.select(F.col("block").alias("own_block"), "own", "step", (F.col("cell") + F.col("step")).alias("cell"), "strip")
    b = tiles.select("cell", "block", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))).alias("strip"))
    pairs = a.join(b, ["cell", "strip"]).where("step > 0 or own_block <= block").select("own", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                both = [c.slice(k, 1).flatten() for c in batch.columns]
                keys = np.concatenate([np.asarray(x.field("class")) for x in both])
                i, j = wide_forest(*(np.frombuffer(b"".join(x.field("fp").to_pylist()), np.uint64).reshape(len(x), -1) for x in both), radius, first)
                low, high = np.minimum(keys[i], keys[j]), np.maximum(keys[i], keys[j])
                at = low != high
                yield pa.RecordBatch.from_arrays([pa.array(low[at]), pa.array(high[at])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def _cell() -> Column:
    """Population counts of the words, five bits each with room for neighbours."""
    total = F.lit(0)
    for k in range(WORDS):
        part = F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
        total = total + F.bit_count(part) * (32**k)
    return total


def _neighbours(radius: int) -> list[int]:
    """Steps from a cell to itself and to the half of its neighbours after it."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius]
    return sorted(x for x in (sum(v * 32**k for k, v in enumerate(d)) for d in steps) if x >= 0)


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between fingerprints (``fp``, distinct) that join all within the radius."""
    celled = classes.select("fp", _cell().alias("cell"))
    # 17**WORDS cells at most, so this side is bounded.
    counts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    dealt = celled.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    tiles = materialize(dealt.groupBy("cell", "block").agg(F.collect_list("fp").alias("fps")), "tiles")
    near = F.explode(F.array(*[F.lit(x) for x in _neighbours(radius)])).alias("step")
    a = tiles.select(F.col("cell").alias("cell_a"), F.col("block").alias("block_a"), F.col("fps").alias("a"), near)
    a = a.withColumn("cell", F.col("cell_a") + F.col("step"))
    pairs = a.join(tiles, "cell").where((F.col("step") > 0) | (F.col("block_a") <= F.col("block"))).select("a", F.col("fps").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(0), batch.column(1)):
                found.append(_forest(*(np.asarray(t.values).view(np.uint64) for t in (x, y)), radius))
            u, v = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
            low, high = np.minimum(u, v), np.maximum(u, v)
            at = low != high
            yield pa.RecordBatch.from_arrays([pa.array(low[at].view(np.int64)), pa.array(high[at].view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, text_key, fp, component_id, kept`` of each row of ``docs``.

    Fingerprints within ``radius`` bits link; a component is all that links reach, and
    ``component_id`` its smallest doc_id. A text without words, null included, has
    fingerprint zero and links like any other. Null ids count for a component's name
    only where it has no other. ``kept`` marks the row that names the component (of
    several texts with that id the one with the smallest key). Further columns are
    ignored; an empty table gives an empty one.
    """
    found = materialize(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = materialize(found.groupBy("fp").agg(first), "classes")
    roots = components(links(classes, radius))
    rooted = materialize(classes.join(roots, F.col("fp") == F.col("vertex")).select("fp", "root", "first"), "rooted")
    names = materialize(rooted.groupBy("root").agg(F.min("first").alias("name")), "names")
    named = materialize(rooted.join(names, "root").select("fp", "name"), "named")
    whole = materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("name", "first").alias("name")), "components")
    joined = found.join(whole, "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("text_key") == F.col("name.text_key"))
    return joined.select("doc_id", "text_key", "fp", F.col("name.doc_id").alias("component_id"), kept.alias("kept"))


def kept_rows(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns."""
    found = near_duplicates(docs, radius).where("kept")
    marks = materialize(found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("text_key", "key"), "kept")
    return kept_once(docs, text_key(), marks)
