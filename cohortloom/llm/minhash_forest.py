"""MinHash near-duplicates by an LSH forest: several sorted orders of signatures.

Equal shingle sets are one class. An order sorts the classes by a row of MinHashes of its
own; those with a long common prefix are neighbours, and neighbours are candidates. The
prefix that counts is as long as a region needs: ``FLOOR`` hashes where few classes share
them, twice as many in a region that holds more than a tile. Candidates are compared by
their whole shingle sets. Crowded regions are then made complete: their classes that are
still in different components meet at the floor as well, so depth costs no link. Two texts
at the least similarity of 0.8 share no region at the floor with odds of 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .components import components
from .filter_audit import met, sketch
from .near_copies import forest
from .simhash import text_key
from .tokens import by_bytes

SHINGLE = 2
TREES, FLOOR = 24, 4
SEED = 42
# Classes and shingles in a tile.
TILE = 1024
TILE_SHINGLES = 1 << 20

_HASHES = 1 << 11
_draw = np.random.default_rng(SEED)
_TIMES, _PLUS, _MIX = (_draw.integers(0, 1 << 64, TREES * FLOOR, np.uint64) for _ in range(3))
_TIMES |= np.uint64(1)
_MIX |= np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit numbers of all word shingles; fewer words are one, none are none."""
    words = text.lower().split()  # for bytes: A-Z, and white space is 20 and 09 to 0D
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    # A polynomial of the words' hashes, mixed so that every bit counts.
    cut = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        cut = (cut ^ (cut >> np.uint64(29))) * _POWER + each[i : i + n]
    cut = (cut ^ (cut >> np.uint64(32))) * _POWER
    return np.unique(cut ^ (cut >> np.uint64(29)))


def prefixes(found: np.ndarray) -> np.ndarray:
    """For each order a number that stands for the first ``FLOOR`` hashes of its signature."""
    if not len(found):
        return np.zeros(0, np.uint64)
    least = np.full(TREES * FLOOR, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _HASHES):
        np.minimum(least, (found[at : at + _HASHES, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least * _MIX).reshape(TREES, FLOOR).sum(axis=1, dtype=np.uint64)


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class, n_shingles, orders`` of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                sets = [shingles(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part.column(2)]
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                found = [prefixes(s).view(np.int64) for s in sets]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))],
                    ["doc_id", "text_key", "class", "n_shingles", "orders"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, text_key long, class long, n_shingles long, orders array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, shingles`` (as bytes) of the classes of ``wanted`` (``text_key``), and of some more.

    A sketch of the wanted keys goes to the tasks that read the texts, so that no text is
    shuffled; its size is bounded, and those it lets through needlessly meet nothing.
    """
    cells = docs.sparkSession.sparkContext.broadcast(sketch(wanted.select("text_key"), wanted.count()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.filter(pa.array(met(np.asarray(batch.column(0), np.int64), cells.value, 1)))
            for part in by_bytes(asked):
                sets = [shingles(x.as_buffer().to_pybytes()).tobytes() for x in part.column(1)]
                keys = np.array([xxhash.xxh64_intdigest(s, SEED) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sets, pa.binary())], ["class", "shingles"])

    texts = docs.where("text is not null").select(text_key(), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(rows, "class long, shingles binary").dropDuplicates(["class"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of a spanning forest of the links within each row's tiles together."""
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


def _tiles(members: DataFrame, sets: DataFrame, key: list[str]) -> DataFrame:
    """``key, tile``: the classes of each tile with their shingle sets."""
    tile = F.collect_list(F.struct("class", "shingles")).alias("tile")
    return members.join(sets, "class").groupBy(*key).agg(tile)


def _blocks(n: str, weight: str):
    return F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(weight) / TILE_SHINGLES), F.lit(1))


def regions(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``region, class, n_shingles, blocks, block`` in sparse and in crowded regions at the floor.

    A region is an order's prefix that two classes or more share. Of regions with the
    same classes one is enough.
    """
    placed = classes.select("class", "n_shingles", F.posexplode("orders").alias("tree", "prefix"))
    placed = placed.select("class", "n_shingles", F.xxhash64("tree", "prefix").alias("region"))
    sums = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("class")).alias("members")).where("n > 1")
    once = sums.groupBy("members", "n", "weight").agg(F.min("region").alias("region"))
    members = placed.join(once.select("region", _blocks("n", "weight").alias("blocks")), "region")
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))), "members")
    return members.where("blocks = 1"), members.where("blocks > 1")


def _deeper(classes: DataFrame, crowded: DataFrame) -> DataFrame:
    """``region, class, block``: the crowded regions' classes by prefixes of twice the floor.

    An order's further hashes are the first ones of the next. A region that is crowded
    even there is dealt to tiles that are compared each by itself.
    """
    within = classes.join(crowded.select("class").distinct(), "class", "left_semi").select("class", "n_shingles", "orders")
    longer = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.get("orders", t), F.get("orders", (t + 1) % TREES)))
    placed = within.select("class", "n_shingles", F.explode(longer).alias("region"))
    sums = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("class")).alias("members")).where("n > 1")
    once = sums.groupBy("members", "n", "weight").agg(F.min("region").alias("region"))
    members = placed.join(once.select("region", _blocks("n", "weight").alias("blocks")), "region")
    return members.select("region", "class", F.pmod(F.xxhash64("class"), F.col("blocks")).alias("block"))


def _completed(crowded: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links in crowded regions between classes of different components.

    A region's largest component is its core. The others are dealt to tiles, and each of
    these meets all tiles of the region; two tiles of the core need not meet.
    """
    rooted = crowded.join(roots, F.col("class") == F.col("vertex"), "left").select("region", "class", "n_shingles", F.coalesce("root", "class").alias("root"))
    parts = rooted.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    core = parts.groupBy("region").agg(F.max(F.struct("n", "root")).alias("core"), F.sum("n").alias("all"), F.sum("weight").alias("weight"))
    split = materialize(core.where("core.n < all").select("region", F.col("core.root").alias("core"), _blocks("all", "weight").alias("blocks")), "split")
    dealt = rooted.join(split, "region").withColumn("rest", F.col("root") != F.col("core")).withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")))
    tiles = materialize(_tiles(dealt.select("region", "class", "rest", "block", "blocks"), sets, ["region", "rest", "block", "blocks"]), "tiles")
    rest = tiles.where("rest")
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    core_pairs = rest.select("region", F.col("tile").alias("own"), meets.alias("block")).join(tiles.where("not rest"), ["region", "block"]).select("own", "tile")
    later = rest.where("block < blocks - 1").select("region", F.col("tile").alias("own"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"))
    rest_pairs = later.join(rest.select("region", "block", "tile"), ["region", "block"]).select("own", "tile")
    alone = rest.select(F.col("tile").alias("own"), F.expr("filter(tile, x -> false)").alias("tile"))
    return core_pairs.unionByName(rest_pairs).unionByName(alone).mapInArrow(_compare, "a long, b long").distinct()


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: links between ``class``es that join all pairs of the least similarity found by the forest."""
    sparse, crowded = regions(classes)
    wanted = classes.join(sparse.unionByName(crowded).select("class").distinct(), "class", "left_semi").select(F.col("first.text_key").alias("text_key"))
    sets = materialize(_sets(docs, wanted), "shingles")
    candidates = sparse.select("region", "class", F.lit(0).cast("long").alias("block"))
    many = crowded.limit(1).count() > 0
    if many:
        candidates = candidates.unionByName(_deeper(classes, crowded))
    found = _tiles(candidates, sets, ["region", "block"]).select("tile").mapInArrow(_compare, "a long, b long").distinct()
    if not many:
        return found
    found = materialize(found, "links")
    return found.unionByName(_completed(crowded, sets, components(found)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class, n_shingles, component_id, kept`` of each row of ``docs``.

    Texts link whose sets of distinct word pairs have a Jaccard similarity of 0.8 or more,
    as told by the whole sets. A component is all that links reach and ``component_id``
    its smallest doc_id (null only where it has no other). A text of one word has that
    word as its only shingle; texts without words, null included, link with nothing, and
    each names itself. ``kept`` marks every row whose id names its component. Repeated
    rows are one class; further columns are ignored; an empty table gives an empty one.
    """
    found = materialize(_signed(docs), "signatures")
    worded = found.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = materialize(worded.groupBy("class").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("orders").alias("orders")), "classes")
    roots = components(links(docs, classes))
    rooted = classes.select("class", "first").join(roots, F.col("class") == F.col("vertex"), "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("name"))
    named = materialize(rooted.join(names, "root").select("class", F.col("name.doc_id").alias("component_id")), "components")
    told = worded.join(named, "class").select("doc_id", "text_key", "class", "n_shingles", "component_id")
    bare = found.where("n_shingles = 0").select("doc_id", "text_key", "class", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
