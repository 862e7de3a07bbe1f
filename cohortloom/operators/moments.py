"""Moments of every gene by group, from whole arrays: no row per cell.

A task turns its rows into matrices, keeps count, mean and sum of squares around the
mean for each group and sends one row for each block of genes; the blocks are merged
pairwise, so nothing cancels and a constant gene has a variance of exactly zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Genes that travel in one row, and bytes of moments that a task holds before it sends them.
GENE_BLOCK = 1024
HELD_BYTES = 64 << 20

_Moments = tuple[np.ndarray, np.ndarray, np.ndarray]


def matrix_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length as a matrix, and where its cells are null."""
    flat = lists.flatten()
    if len(lists) and len(flat) % len(lists):
        raise ValueError("rows of different length")
    width = len(flat) // len(lists) if len(lists) else 0
    lengths = np.diff(np.asarray(lists.offsets))
    if (lengths != width).any():
        raise ValueError("rows of different length")
    shape = (len(lists), width)
    return np.asarray(flat.fill_null(0.0), np.float64).reshape(shape), np.asarray(flat.is_null()).reshape(shape)


def moments_of(x: np.ndarray, absent: np.ndarray) -> _Moments:
    """Count, mean and sum of squares around the mean of each column's present cells."""
    n = (~absent).sum(axis=0)
    base = np.where(absent, -np.inf, x).max(axis=0)
    base[n == 0] = 0.0
    # Around a value of the column, so that equal cells differ by exactly zero.
    d = np.where(absent, 0.0, x - base)
    shift = d.sum(axis=0) / np.maximum(n, 1)
    return n, base + shift, np.where(absent, 0.0, (d - shift) ** 2).sum(axis=0)


def merged(a: _Moments, b: _Moments) -> _Moments:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    d = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + d * share, b[1])
    return n, mean, a[2] + b[2] + d * d * a[0] * share


def gene_moments(rows: DataFrame, groups: Sequence[str] = (), x: str = "x") -> DataFrame:
    """``groups, pos, n, mean, var`` (of the population) of every position of ``x``.

    Null cells are left out, as are rows without ``x``; a position without a cell has n 0
    and no mean. Groups without rows do not appear. Rows must have one length.
    """
    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Moments] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for k, m in held.items():
                for at in range(0, len(m[0]), GENE_BLOCK):
                    part = [pa.array([v[at : at + GENE_BLOCK].tolist()], pa.list_(t)) for v, t in zip(m, (pa.int64(), pa.float64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at // GENE_BLOCK], pa.int32()), *part], ["key", "block", "n", "mean", "ss"])

        for batch in batches:
            cells, absent = matrix_of(batch.column(1))
            coded = batch.column(0).dictionary_encode()
            of = np.asarray(coded.indices)
            for i, k in enumerate(coded.dictionary.to_pylist()):
                own = moments_of(cells[of == i], absent[of == i])
                held[k] = merged(held[k], own) if k in held else own
            if sum(3 * m[0].nbytes for m in held.values()) > HELD_BYTES:
                yield from sent()
                held.clear()
        yield from sent()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = None
        for n, mean, ss in zip(*(table[c] for c in ("n", "mean", "ss"))):
            own = np.asarray(n.values), np.asarray(mean.values), np.asarray(ss.values)
            total = own if total is None else merged(total, own)
        n, mean, ss = total
        none = n == 0
        pos = key[1].as_py() * GENE_BLOCK + np.arange(len(n))
        return pa.table(
            {
                "key": pa.array([key[0].as_py()] * len(n), pa.string()), "pos": pa.array(pos, pa.int32()), "n": pa.array(n, pa.int64()),
                "mean": pa.array(mean, pa.float64(), mask=none), "var": pa.array(ss / np.maximum(n, 1), pa.float64(), mask=none),
            }
        )

    source = rows.select(key.alias("key"), F.col(x).cast("array<double>").alias("x")).where(F.col("x").isNotNull())
    sums = source.mapInArrow(partial, "key string, block int, n array<long>, mean array<double>, ss array<double>")
    found = sums.groupBy("key", "block").applyInArrow(merge, "key string, pos int, n long, mean double, var double")
    kind = T.StructType([T.StructField(g, rows.schema[g].dataType) for g in groups])
    names = F.from_json("key", kind)
    return found.select(*[names[g].alias(g) for g in groups], "pos", "n", "mean", "var")
