"""Ranked lexical search over a length-stratified index.

Documents with the same length normaliser ``m`` form a stratum. The index keeps each
stratum's postings (a large stratum in several blocks) sorted by term, then by falling
tf, so that the first posting of a term bounds what the term can give there. Since m is
one number for the whole stratum, an impact is computed once for each tf. A search goes
past the index where it lies: a task visits the strata it reads by falling bounds and
leaves out, for each item, those whose bound lies below the item's least score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from .tokens import by_bytes

K = 20
SEED = 42
# Postings in a shard of the index, documents in a block of a stratum.
SHARD_POSTINGS = 1 << 20
BLOCK_DOCS = 512
# Postings whose strata are ordered together, and items that are scored together.
VISIT_POSTINGS = 1 << 19
SCORED_ITEMS = 128
# Terms of items that are sent to the tasks at once: 16 bytes each.
QUERY_TERMS = 1 << 19

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytearray(bytes(range(256)).lower())
for _at in _SEPARATORS:
    _FOLD[_at] = 0x20
_EXACT = 1 << 53


def terms_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a text as sorted XXH64 numbers, and how often each occurs.

    A term is a run of ASCII digits and letters (A-Z lower-cased) and characters beyond
    ASCII. Of terms that are asked for, none is taken for another: with a million of
    them against ten billion in the corpus the odds are about one in two thousand.
    """
    words = text.translate(_FOLD).split()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)), return_counts=True)


def _lists(parts: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def _termed(rows: DataFrame, name: str) -> DataFrame:
    """``name, n, terms, tfs`` of rows with ``name`` (long) and ``text``; a null text counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                found = [terms_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(1)]
                n = pa.array([int(tf.sum()) for _, tf in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), n, _lists([t.view(np.int64) for t, _ in found], np.dtype(np.int64)), _lists([tf for _, tf in found], np.dtype(np.int32))],
                    [name, "n", "terms", "tfs"],
                )

    source = rows.select(F.col(name).cast("long").alias(name), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(count, f"{name} long, n long, terms array<long>, tfs array<int>")


def _block(m: int, docs: list) -> pa.RecordBatch:
    """One row of the index: the postings of some documents of one stratum, packed."""
    terms = np.concatenate([np.asarray(t, np.int64) for _, t, _ in docs])
    tfs = np.concatenate([np.asarray(tf, np.int32) for _, _, tf in docs])
    place = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) for _, t, _ in docs])
    by = np.lexsort((place, -tfs, terms.view(np.uint64)))
    terms, tfs, place = terms[by], tfs[by], place[by]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    dfs = np.diff(first, append=len(terms)).astype("<i4")
    data = b"".join(x.tobytes() for x in (terms[first].astype("<i8"), dfs, place.astype("<i4"), tfs.astype("<i4")))
    packed = zstandard.ZstdCompressor(level=1).compress(data)
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), pa.array([[d for d, _, _ in docs]], pa.list_(pa.int64())), pa.array([len(first)], pa.int32()), pa.array([packed], pa.binary())],
        ["m", "docs", "n_terms", "postings"],
    )


def _opened(n_terms: int, postings: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``terms, dfs, places, tfs`` of a row of the index."""
    data = zstandard.ZstdDecompressor().decompress(postings.as_buffer())
    terms, dfs = np.frombuffer(data, "<i8", n_terms), np.frombuffer(data, "<i4", n_terms, 8 * n_terms)
    rest = np.frombuffer(data, "<i4", offset=12 * n_terms).reshape(2, -1)
    return terms, dfs, rest[0], rest[1]


# Packed, a file takes no more room in a task's batches than on disk.
_STRATA = "m long, docs array<long>, n_terms int, postings binary"


def build_index(docs: DataFrame, path: str, shard_postings: int = SHARD_POSTINGS) -> None:
    """Write the index of ``docs`` (``doc_id, text``) below ``path``.

    ``strata`` has the postings, ``terms`` each term's number of documents, ``whole`` the
    numbers of documents and of terms. Documents without a term (null, empty) are in
    none of them. Repeated rows are documents of their own, null ids are kept; further
    columns are ignored; an empty table gives an empty index. Shards are ranges of m and
    of the id's hash, so a stratum that holds most of the documents has many.
    """
    spark = docs.sparkSession
    termed = materialize(_termed(docs, "doc_id").where("n > 0"), "termed")
    count, total, postings = termed.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first()
    spark.createDataFrame([(count, total or 0)], "docs long, total long").coalesce(1).write.parquet(f"{path}/whole")
    shards = max(1, -(-(postings or 0) // shard_postings))

    def strata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for m, doc, terms, tfs in zip(*(batch.column(i).to_pylist() if i < 2 else batch.column(i) for i in range(4))):
                if held and (of != m or len(held) == BLOCK_DOCS):
                    yield _block(of, held)
                    held = []
                of = m
                held.append((doc, terms.values, tfs.values))
        if held:
            yield _block(of, held)

    m = F.expr(f"75L + (25L * n * {count}L) div {max(1, total or 0)}L")
    dealt = termed.withColumn("m", m).repartitionByRange(shards, "m", F.xxhash64("doc_id"))
    sorted_ = dealt.sortWithinPartitions("m", "doc_id").select("m", "doc_id", "terms", "tfs")
    # Rows are packed already, and compressing their large pages takes memory outside the heap.
    sorted_.mapInArrow(strata, _STRATA).write.option("compression", "none").parquet(f"{path}/strata")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, postings in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _opened(n, postings)[:2]], ["term", "df"])

    each = spark.read.schema(_STRATA).parquet(f"{path}/strata").select("n_terms", "postings").mapInArrow(sizes, "term long, df int")
    each.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{path}/terms")


class Stratum:
    """A block of a stratum, with the impact of each tf."""

    def __init__(self, m: int, docs: pa.Array, terms: np.ndarray, dfs: np.ndarray, places: np.ndarray, tfs: np.ndarray):
        self.terms, self.dfs, self.places, self.size = terms.view(np.uint64), dfs, places, len(docs)
        self.starts = np.cumsum(dfs) - dfs
        self.ids, self.nameless = np.asarray(docs.fill_null(0), np.int64), np.asarray(docs.is_null())
        values, which = np.unique(tfs.astype(np.int64), return_inverse=True)
        self.impacts = ((1_000_000_000 * values) // (1000 * values + 12 * m))[which]

    def matrix(self, at: np.ndarray, kind: type) -> np.ndarray:
        """Impacts of the terms at ``at``, a row each, for every document."""
        made = np.zeros((len(at), self.size), kind)
        n = self.dfs[at]
        post = np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        made[np.repeat(np.arange(len(at)), n), self.places[post]] = self.impacts[post]
        return made


def _best(ids: np.ndarray, nameless: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` highest, equal ones by rising id, null ids last."""
    return np.lexsort((ids, nameless, -scores))[:k]


def rank(strata: list[Stratum], items: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ids, nameless, scores`` of the best documents in ``strata`` for each item (terms sorted, weights)."""
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in items)]))
    weight = np.zeros((len(items), len(words)), np.int64)
    for row, (t, w) in enumerate(items):
        weight[row, np.searchsorted(words, t)] = w
    cases = []
    for s in strata:
        at = np.searchsorted(s.terms, words)
        there = np.flatnonzero(s.terms[np.minimum(at, len(s.terms) - 1)] == words)
        if len(there):
            # A term's first posting has its greatest tf.
            bound = weight[:, there] @ s.impacts[s.starts[at[there]]]
            cases.append((int(bound.max()), bound, s, there, at[there]))
    none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    best, least = [none] * len(items), np.ones(len(items), np.int64)
    for most, bound, s, there, at in sorted(cases, key=lambda c: -c[0]):
        rows = np.flatnonzero(bound >= least)
        if not len(rows):
            continue
        part = weight[np.ix_(rows, there)]
        used = part.any(axis=0)
        # Sums of whole numbers below 2**53 are exact in doubles, whose product is the fast one.
        kind = np.float64 if most < _EXACT else np.int64
        scores = (part[:, used].astype(kind) @ s.matrix(at[used], kind)).astype(np.int64)
        which, doc = np.nonzero(scores >= least[rows, None])
        for row, a, b in zip(rows.tolist(), np.searchsorted(which, np.arange(len(rows))), np.searchsorted(which, np.arange(len(rows)), side="right")):
            if b > a:
                new = doc[a:b]
                ids, nameless, old = best[row]
                own = scores[which[a], new]
                joined = (np.concatenate([ids, s.ids[new]]), np.concatenate([nameless, s.nameless[new]]), np.concatenate([old, own]))
                keep = _best(*joined, k)
                best[row] = tuple(x[keep] for x in joined)
                if len(keep) == k:
                    least[row] = max(1, best[row][2][-1])
    return best


def _visits(batch: pa.RecordBatch) -> Iterator[list[Stratum]]:
    """Strata of a batch of the index, about ``VISIT_POSTINGS`` at a time."""
    held, size = [], 0
    for row in zip(*batch.columns):
        held.append(Stratum(row[0].as_py(), row[1].values, *_opened(row[2].as_py(), row[3])))
        size += len(held[-1].places)
        if size >= VISIT_POSTINGS:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(spark: SparkSession, path: str, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, text_key, rank, doc_id, score``: the ``k`` highest documents above zero of each item.

    ``items`` has ``item_id, text``. An item without terms, null included, finds nothing;
    rows that repeat id and text count once; equal ids with different texts (told apart
    by ``text_key``) are items of their own. Equal scores go by doc_id, null ids last.
    Items are sent to the tasks in blocks of about ``QUERY_TERMS`` terms (an item alone may
    have more); each block goes past the whole index, which is never shuffled.
    """
    count, _ = spark.read.schema("docs long, total long").parquet(f"{path}/whole").first()
    strata = spark.read.schema(_STRATA).parquet(f"{path}/strata")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), key, F.col("text").cast("string").alias("text")).groupBy("item_id", "text_key").agg(F.first("text").alias("text"))
    asked = materialize(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    worded = _termed(asked.select("item", "text"), "item").select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    weight = F.floor(1000 * F.log((2.0 * count + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = worded.join(spark.read.schema("term long, df long").parquet(f"{path}/terms"), "term").select("item", "term", (weight * F.col("times")).alias("w"))
    packed = materialize(weighed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms")), "asked")
    n_terms = packed.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_terms // QUERY_TERMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))

    def past(rows: list) -> DataFrame:
        """The best of the index for one block of items."""
        sent = []
        for r in rows:
            terms, w = np.array([t["term"] for t in r["terms"]], np.int64).view(np.uint64), np.array([t["w"] for t in r["terms"]], np.int64)
            by = np.argsort(terms)
            sent.append((r["item"], terms[by], w[by]))
        block = spark.sparkContext.broadcast(sent)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own in _visits(batch):
                    for a in range(0, len(block.value), SCORED_ITEMS):
                        some = block.value[a : a + SCORED_ITEMS]
                        found = rank(own, [(t, w) for _, t, w in some], k)
                        item = np.repeat([i for i, _, _ in some], [len(f[0]) for f in found])
                        ids, nameless, scores = (np.concatenate(x) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=nameless.astype(bool)), pa.array(scores, pa.int64())],
                            ["item", "doc_id", "score"],
                        )

        return strata.mapInArrow(find, "item long, doc_id long, score long")

    found = past(packed.where(block == 0).collect())
    for b in range(1, blocks):
        found = found.unionByName(past(packed.where(block == b).collect()))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id", "text_key"), "item").select("item_id", "text_key", "rank", "doc_id", "score")
