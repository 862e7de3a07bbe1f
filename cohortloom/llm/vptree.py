"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

A shard holds a few thousand vectors by the hash of their id, so a hot vector or id
range fills none. Queries come in blocks; a task takes a block past its share of the
trees, one at a time, and carries the nearest found so far from tree to tree. A
subtree is left out where the triangle inequality, its bound stretched by ``factor``,
says that it holds nothing nearer; factor one leaves out only what cannot count.

In the rows that are left, a product of matrices in single precision leaves out what is
farther than the nearest found by more than its own error; only the others are measured.
"""

from __future__ import annotations

from collections.abc import Iterator
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

K = 10
FACTOR = 1.2
SHARD_ROWS = 4096
# Bytes of the vectors of a shard or of a block of queries, for wide vectors and many queries.
SHARD_BYTES = 16 << 20
QUERY_BYTES = 8 << 20
LEAF = 512
# Trees that a task takes its queries past, at most; fewer where that leaves cores idle.
TASK_TREES = 1024
TASKS_A_CORE = 2

_CHUNK = 1 << 20
_STEP = 2048
# Outside of these a sum of squares may have lost digits or overflowed.
_TINY, _HUGE = 1e-140, 1e150
_NOBODY = np.iinfo(np.int64).max
# Rows of a tree table are read in groups of this size, so that a task holds few trees.
_ROW_GROUP = {"parquet.block.size": SHARD_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8}


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis in double precision, from the differences.

    Where squares leave the range of doubles (or vanish in it), components are scaled by
    a power of two first; a distance beyond the range itself is infinite.
    """
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        found = np.sqrt(np.square(a - b).sum(-1))
        odd = ~((found > _TINY) & (found < _HUGE))
        if odd.any():
            a, b = np.broadcast_arrays(a, b)
            # Halves, so that no difference of finite components overflows.
            half = a[odd] / 2 - b[odd] / 2
            top = np.abs(half).max(axis=-1, initial=0.0)
            unit = np.exp2(np.floor(np.log2(np.where(top > 0, top, 1.0))))
            found[odd] = 2 * (np.sqrt(np.square(half / unit[:, None]).sum(-1)) * unit)
    return found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``."""
    out = np.empty((len(a), len(b)))
    step = max(1, _CHUNK // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = _apart(a[i : i + step, None, :], b[None, :, :])
    return out


def build(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list]:
    """Row order and nodes ``(first, end, vantage row, radius, inner, outer)``; leaves have no radius."""
    order, nodes, rng = np.arange(len(vectors)), [], np.random.default_rng(seed)
    todo = [(0, len(vectors), None, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        node = [a, b, -1, None, -1, -1]
        nodes.append(node)
        if parent is not None:
            parent[4 + side] = len(nodes) - 1
        if b - a <= LEAF:
            continue
        vantage = order[a + int(rng.integers(b - a))]
        away = distances(vectors[vantage][None], vectors[order[a:b]])[0]
        radius = float(np.median(away))
        inner = away <= radius
        if inner.all():
            continue  # equal distances: nothing to split
        order[a:b] = np.concatenate([order[a:b][inner], order[a:b][~inner]])
        middle = a + int(inner.sum())
        node[2], node[3] = int(vantage), radius
        todo += [(middle, b, node, 1), (a, middle, node, 0)]
    return order, nodes


class Tree:
    """A tree laid out for many queries: rows in tree order, and in single precision about their mean."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, nodes: list):
        self.ids, self.data, self.nodes = ids, np.asarray(data, np.float64), nodes
        self.split = [n for n, node in enumerate(nodes) if node[3] is not None]
        self.place = {n: i for i, n in enumerate(self.split)}
        self.vantage = [nodes[n][2] for n in self.split]
        self.radius = np.array([nodes[n][3] for n in self.split])
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            self.mean = self.data.mean(axis=0)
            about = self.data - self.mean
            top = np.abs(about).max(initial=0.0)
            # Beyond these, all rows are measured.
            self.rough = bool(1e-100 < top < 1e100)
            if not self.rough:
                return
            # A power of two, so that scaling costs no digit.
            self.unit = 2.0 ** -np.floor(np.log2(top))
            about *= self.unit
            self.norms = np.square(about).sum(-1)
            # A sum of n products in single precision, its terms rounded before, is off by less than this
            # part of the squared lengths of both vectors, four times over; numbers that vanish in it count by ``least``.
            dim = about.shape[1]
            self.part, self.least = 4 * (dim + 8) * 2.0**-24, dim * 1e-20
            self.rows = np.concatenate([about, (self.norms * (1 - self.part))[:, None]], axis=1).astype(np.float32)


def lay_out(ids: np.ndarray, data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list]:
    """Ids, vectors and nodes of a tree, rows in tree order, so that a leaf is a slice."""
    order, nodes = build(np.asarray(data, np.float64), seed)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    for node in nodes:
        if node[3] is not None:
            node[2] = int(back[node[2]])
    return ids[order], data[order], nodes


def _merge(near: np.ndarray, names: np.ndarray, at: np.ndarray, d: np.ndarray, n: np.ndarray) -> None:
    """Take found pairs, ``at`` ascending, into the nearest of each query."""
    k = near.shape[1]
    keep = (d < near[at, -1]) | ((d == near[at, -1]) & (n < names[at, -1]))
    at, d, n = at[keep], d[keep], n[keep]
    if not len(at):
        return
    who, first, count = np.unique(at, return_index=True, return_counts=True)
    row, slot = np.repeat(np.arange(len(who)), count), np.arange(len(at)) - np.repeat(first, count)
    all_d, all_n = (np.concatenate([x[who], np.full((len(who), count.max()), none)], axis=1) for x, none in ((near, np.inf), (names, _NOBODY)))
    all_d[row, k + slot], all_n[row, k + slot] = d, n
    best = np.lexsort((all_n, all_d), axis=1)[:, :k]
    near[who], names[who] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_n, best, 1)


def _true(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true cells."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    word, bit = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + bit, whole + np.flatnonzero(flat[whole:])])


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, near: np.ndarray, names: np.ndarray, factor: float) -> None:
    """Take a tree's rows into ``near`` and ``names``, distances and ids of the nearest of each query so far.

    They start as infinite and ``_NOBODY``, and stay so where there are fewer rows.
    """
    for i in range(0, len(queries) if len(tree.ids) else 0, _STEP):
        some = slice(i, i + _STEP)
        _search(tree, queries[some], own[some], near[some], names[some], factor * (1 - 1e-12))


def _search(tree: Tree, queries: np.ndarray, own: np.ndarray, near: np.ndarray, names: np.ndarray, factor: float) -> None:
    rough, k = tree.rough, near.shape[1]
    if rough:
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            about = (queries - tree.mean) * tree.unit
            rough = bool(np.abs(about).max(initial=0.0) < 1e10)
    if rough:
        norms = np.square(about).sum(-1)
        asked = np.concatenate([-2 * about, np.ones((len(about), 1))], axis=1).astype(np.float32)
        # Bounds of the distance to each vantage row, as the product's error allows.
        both = norms[:, None] + tree.norms[tree.vantage]
        square = (-2 * about).astype(np.float32) @ tree.rows[tree.vantage, :-1].T + both
        off = both * tree.part + tree.least
        low = np.sqrt(np.maximum(square - off, 0)) / tree.unit
        high = np.sqrt(np.maximum(square + off, 0)) / tree.unit
    else:
        low = high = distances(queries, tree.data[tree.vantage])
    # Distances are rounded by less than this part, which must not leave out a neighbour at the bound.
    part = (queries.shape[1] + 8) * 2.0**-52
    with np.errstate(over="ignore", invalid="ignore"):
        # Nothing of the inner or outer side is nearer than this.
        inner_bound = (low * (1 - part) - tree.radius * (1 + part)) * factor
        outer_bound = (tree.radius * (1 - part) - high * (1 + part)) * factor
    # Beyond the range of doubles nothing is known about the other side.
    unknown = np.isinf(high) | np.isinf(tree.radius)
    inner_bound[unknown] = outer_bound[unknown] = -np.inf

    pending: list[tuple] = []

    def settle() -> None:
        at, d, n = (np.concatenate(x) for x in zip(*pending))
        by = np.argsort(at, kind="stable")
        _merge(near, names, at[by], d[by], n[by])
        pending.clear()

    def measure(a: int, b: int, who: np.ndarray) -> None:
        """Take the rows ``a`` to ``b`` into the nearest of the queries ``who``."""
        if b - a > SHARD_ROWS:
            measure(a, a + SHARD_ROWS, who)
            measure(a + SHARD_ROWS, b, who)
            return
        if rough:
            products = (asked if len(who) == len(asked) else asked[who]) @ tree.rows[a:b].T
            with np.errstate(over="ignore", under="ignore"):
                limit = np.square(near[who, -1] * tree.unit) * (1 + 1e-9) - norms[who] * (1 - tree.part) + tree.least
                new = np.flatnonzero(np.isinf(limit))
                if len(new) and b - a >= k:
                    # The k nearest of these rows are not farther than the k least products, whatever their error.
                    others = np.where(own[who[new], None] == tree.ids[a:b], np.float32(np.inf), products[new])
                    slack = 2 * (norms[who[new]] + tree.norms[a:b].max()) * tree.part + tree.least
                    limit[new] = np.partition(others, k - 1, axis=1)[:, k - 1] + slack
                limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
            pairs = _true(products <= limit[:, None])
        else:
            pairs = np.arange(len(who) * (b - a))
        step = max(1, _CHUNK // max(1, queries.shape[1]))
        for i in range(0, len(pairs), step):
            at, row = np.divmod(pairs[i : i + step], b - a)
            at, row = who[at], row + a
            # The query's own rows are no candidates.
            other = own[at] != tree.ids[row]
            at, row = at[other], row[other]
            pending.append((at, _apart(queries[at], tree.data[row]), tree.ids[row]))
            # Few pairs may wait for each other: bounds that are known late are only looser.
            if sum(len(x) for x, _, _ in pending) >= len(queries):
                settle()

    # Queries that have too few neighbours yet begin at the leaf on their side of every vantage row.
    home = np.full(len(queries), -1)
    todo = [(0, np.flatnonzero(names[:, -1] == _NOBODY))]
    while todo:
        at, who = todo.pop()
        a, b, _, radius, inner, outer = tree.nodes[at]
        if not len(who):
            continue
        if radius is None:
            home[who] = at
            measure(a, b, who)
            if pending:
                settle()
            continue
        inside = inner_bound[who, tree.place[at]] <= 0
        todo += [(outer, who[~inside]), (inner, who[inside])]
    todo = [(0, np.arange(len(queries)), None)]
    while todo:
        at, who, bound = todo.pop()
        if bound is not None:
            who = who[bound[who] <= near[who, -1]]
        a, b, _, radius, inner, outer = tree.nodes[at]
        if radius is None:
            who = who[home[who] != at]
        if not len(who):
            continue
        if radius is None:
            measure(a, b, who)
            continue
        i = tree.place[at]
        todo += [(outer, who, outer_bound[:, i]), (inner, who, inner_bound[:, i])]
    if pending:
        settle()


def valid(vector: Column) -> Column:
    """Whether an array of floats or doubles takes part: not null, not zero, every component finite.

    In whole-array functions, which Spark compiles, where one call a component would be
    interpreted. Searching for NaN gives null where there is a null instead.
    """
    least, most = F.array_min(vector), F.array_max(vector)
    whole = ~F.array_contains(vector, F.lit(float("nan")).cast("float"))
    return F.coalesce(whole & (least > -float("inf")) & (most < float("inf")) & ((least != 0) | (most != 0)), F.lit(False))


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as their bytes, zeros unsigned: equal vectors are equal bytes, which Spark sorts faster than arrays."""
    for batch in batches:
        vectors = batch.column("embedding")
        flat = np.asarray(vectors.flatten()) + 0.0
        ends = (np.asarray(vectors.offsets) - vectors.offsets[0].as_py()) * flat.itemsize
        told = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), told], ["vec_id", "dim", "embedding"])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    if pa.types.is_binary(column.type):
        flat = b"".join(column.to_pylist())
        return np.frombuffer(flat, f"f{len(flat) // max(1, len(column) * dim)}").reshape(-1, dim)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat).reshape(-1, dim)


def _distinct(ids: np.ndarray, vectors: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repetitions; at most ``most`` ids of equal vectors, the smallest."""
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    by = np.lexsort((ids, group := group.ravel()))
    ids, vectors, group = ids[by], vectors[by], group[by]
    new = np.ones(len(ids), bool)
    new[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
    ids, vectors, group = ids[new], vectors[new], group[new]
    if most is not None:
        first = np.searchsorted(group, group, side="left")
        few = np.arange(len(group)) - first < most
        ids, vectors = ids[few], vectors[few]
    return ids, vectors


def index(vectors: DataFrame, k: int = K, shards: int = 1) -> DataFrame:
    """``dim, shard, tree``: the trees of all ``vec_id, dim, embedding`` that take part,
    vectors as arrays or as bytes.

    Of equal vectors a shard keeps the ``k`` + 1 smallest ids: as ties go to the smaller
    id and one of them may be the query's own, no other can be among ``k`` nearest.
    """

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        rows = _distinct(np.asarray(table["vec_id"], np.int64), _matrix(table["embedding"], dim), k + 1)
        tree = pickle.dumps(lay_out(*rows, shard), protocol=5)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "tree": pa.array([tree], pa.binary())})

    sharded = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return materialize(sharded.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard long, tree binary"), "trees", **_ROW_GROUP)


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query row, nearest first.

    Candidates are all rows but those with the query's id; ties go to the smaller id.
    Vectors that are null, empty, zero or not finite, and rows without an id, take no
    part; vectors of different lengths never meet; repeated rows count once. Further
    columns are ignored; an empty table gives an empty one. ``factor`` over one may miss
    neighbours; at the default recall was 1.0 for 513 queries over 51,282 vectors.

    Every block of queries meets every tree. Neither is copied for that: a task reads its
    trees and its block where they were written, so disk and rows grow with the input.
    """
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    ok = embeddings.where(valid(vector) & F.col("vec_id").isNotNull())
    chosen = ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), vector.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    size = F.col("dim").cast("long") * (4 if single else 8)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    rows, volume, asked, different = chosen.agg(F.count("*"), total(size), total(F.when(F.col("is_query"), size)), F.approx_count_distinct(F.xxhash64("embedding"))).first()
    items = chosen.drop("is_query")
    if rows > 2 * (k + 1) * different:
        # Mostly copies: what index() says of equal vectors in a shard holds for the table too.
        copy = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
        items = items.mapInArrow(_as_bytes, "vec_id long, dim int, embedding binary")
        items = items.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
        rows, volume = 2 * (k + 1) * different, volume * 2 * (k + 1) * different // rows
    shards, blocks = max(1, -(-rows // shard_rows), -(-volume // SHARD_BYTES)), max(1, -(-asked // QUERY_BYTES))
    trees = index(items, k, shards).drop("shard")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        found = _distinct(np.asarray(table["vec_id"], np.int64), _matrix(table["embedding"], key[0].as_py()), None)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "queries": pa.array([pickle.dumps(found, protocol=5)], pa.binary())})

    blocked = chosen.where("is_query").drop("is_query").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    packed = blocked.groupBy("dim", "block").applyInArrow(pack, "dim int, block long, queries binary").repartition(blocks)
    shares = max(-(-TASKS_A_CORE * embeddings.sparkSession.sparkContext.defaultParallelism // blocks), -(-shards // TASK_TREES))
    # Each task pairs one share of the trees, as it is read, with the blocks of one partition.
    pairs = trees.coalesce(shares).hint("shuffle_replicate_nl").join(packed, "dim").select("dim", "block", "queries", "tree")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[tuple, tuple] = {}
        for batch in batches:
            tree = last = None
            for row in range(batch.num_rows):
                key = tuple(batch.column(i)[row].as_py() for i in (0, 1))
                if key not in asked:
                    own, queries = pickle.loads(batch.column(2)[row].as_buffer())
                    asked[key] = own, np.asarray(queries, np.float64), np.full((len(own), k), np.inf), np.full((len(own), k), _NOBODY)
                own, queries, near, names = asked[key]
                data = batch.column(3)[row].as_buffer()
                if last is None or not data.equals(last):
                    tree, last = Tree(*pickle.loads(data)), data
                search(tree, queries, own, near, names, factor)
        for (dim, block), (own, _, near, names) in asked.items():
            at, place = np.nonzero(names != _NOBODY)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, block, np.int64)), pa.array(at), pa.array(own[at]), pa.array(names[at, place]), pa.array(near[at, place])],
                ["dim", "block", "number", "query_id", "vec_id", "score"],
            )

    found = pairs.mapInArrow(find, "dim int, block long, number long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("dim", "block", "number").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
