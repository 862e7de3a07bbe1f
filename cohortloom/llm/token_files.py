"""Token ids in files: shared frequency tables, independent interleaved blocks.

Below ``path`` lie two Parquet tables, so that commits are Spark's own and any
store works: ``table`` (id, freq), and ``blocks``, one row per block of up to
``BLOCK`` tokens with its lane states, its words, a CRC-32 of its ids and where it
stands in its shard. A document may go on in the next block; the block holds, as a
checkpoint, how many of its tokens came before and their CRC-32 so far. Any block
decodes by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from . import rans
from .tokens import by_bytes, encoder, texts_of, with_end

BLOCK = 1 << 19
LANES = 2048
# Tokens in a shard: some 35 MB packed, whatever the size of the table.
SHARD_TOKENS = 1 << 24

_BLOCKS = (
    "shard int, block int, shard_offset long, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "carried_tokens long, carried_crc32 long, goes_on boolean, states binary, words binary, crc32 long"
)
_BLOCK_TYPES = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("shard_offset", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("carried_tokens", pa.int64()),
        ("carried_crc32", pa.int64()), ("goes_on", pa.bool_()), ("states", pa.binary()), ("words", pa.binary()), ("crc32", pa.int64()),
    ]
)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids in byte planes, packed by zstandard.

    The last row of a task has no tokens and, for ``ids``, how often the task met each id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, total = zstandard.ZstdCompressor(level=1), np.zeros(0, np.int64)
        names = ["doc_id", "n_tokens", "ids"]
        for batch in batches:
            for part in by_bytes(batch):
                whole, at = with_end(*encoder(tokenizer).encode(texts_of(part)), end_id)
                n = np.bincount(whole, minlength=len(total))
                n[: len(total)] += total
                total = n
                payload = [_packed(whole[a:b], pack) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(payload, pa.binary())], names)
        counted = pa.array([pack.compress(total.astype("<i8").tobytes())], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), counted], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_tokens long, ids binary")


def _packed(ids: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Ids in as many byte planes as the largest needs, after a byte that tells their number."""
    planes = 1 + max(0, int(ids.max()).bit_length() - 1) // 8
    return bytes([planes]) + pack.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes())


def _unpacked(batch: pa.RecordBatch, unpack: zstandard.ZstdDecompressor) -> Iterator[np.ndarray]:
    for payload in batch.column(batch.schema.get_field_index("ids")):
        data = payload.as_buffer()
        planes = np.frombuffer(data, np.uint8, 1)[0]
        each = np.frombuffer(unpack.decompress(data.slice(1)), np.uint8).reshape(planes, -1)
        ids = np.zeros((each.shape[1], 4), np.uint8)
        ids[:, :planes] = each.T
        yield ids.view("<u4").ravel()


def _frequencies(tokens: DataFrame) -> np.ndarray:
    """Quantized frequency of each id over all tasks; one small row per id comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for counted in batch.column(0):
                total = np.frombuffer(unpack.decompress(counted.as_buffer()), "<i8")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = tokens.where("n_tokens = 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in rows), default=-1), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return rans.quantize(counts) if rows else counts


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None, block: int = BLOCK) -> None:
    """Encode every text, add ``end_id`` to each and write ids by ascending doc_id.

    A null text counts as empty. Null ids come first; rows with the same id lie side
    by side. Further columns are ignored. An empty table writes empty tables.
    Shards are ranges of doc_id (and, within an id, of its ids' hash) with about
    ``SHARD_TOKENS`` tokens each, or ``shards`` of them; texts are encoded where they
    are read and only packed ids are shuffled.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, end_id), "tokens")
    freq = _frequencies(tokens)
    n = shards or max(1, -(-(tokens.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD_TOKENS))
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unpack = rans.Table(freq), zstandard.ZstdDecompressor()
        shard, number, offset = None, 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = before = crc = 0

        def flush(goes_on: bool) -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            states, words = rans.encode(ids, table, rans.lanes_for(len(ids), LANES))
            row = (shard, number, offset, len(ids), [d for d, _ in held], [len(x) for _, x in held], before, crc, goes_on, states, words, zlib.crc32(ids.tobytes()))
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCK_TYPES.names, row))], schema=_BLOCK_TYPES)

        for batch in batches:
            for s, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch, unpack)):
                if s != shard:
                    if held:
                        yield flush(False)
                    shard, number, offset, held, size, before, crc = s, 0, 0, [], 0, 0, 0
                done = 0
                while True:
                    some = ids[done : done + block - size]
                    held.append((d, some))
                    size += len(some)
                    done += len(some)
                    if size < block:
                        break
                    goes_on = done < len(ids)
                    yield flush(goes_on)
                    first = before if len(held) == 1 else 0
                    crc = zlib.crc32(some.tobytes(), crc if len(held) == 1 else 0) if goes_on else 0
                    before = first + len(some) if goes_on else 0
                    number, offset, held, size = number + 1, offset + size, [], 0
                    if not goes_on:
                        break
        if held:
            yield flush(False)

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc()]
    dealt = tokens.where("n_tokens > 0").repartitionByRange(n, *key).withColumn("shard", F.spark_partition_id())
    ordered = dealt.sortWithinPartitions(*key)
    ordered.select("shard", "doc_id", "ids").mapInArrow(blocks, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _table(spark: SparkSession, path: str) -> np.ndarray:
    """The frequency table; as many rows as the tokenizer has ids at most."""
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").collect()
    freq = np.zeros(1 + max((r["id"] for r in rows), default=-1), np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return freq


def _decoded(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    """``rows(block, ids)`` of each decoded and checked block, with its shard's start."""
    freq = _table(spark, path)
    stored = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for batch in batches:
            for b in range(batch.num_rows):
                block = batch.slice(b, 1).to_pylist()[0]
                ids = rans.decode(block["n_tokens"], block["states"], block["words"], table)
                if zlib.crc32(ids.tobytes()) != block["crc32"]:
                    raise ValueError(f"block {block['block']} of shard {block['shard']} fails its checksum")
                yield rows(block, ids)

    # One row per shard, that is per ``SHARD_TOKENS`` tokens.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return stored.mapInArrow(read, schema).join(base, "shard")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files, by decoding them."""

    def rows(block: dict, ids: np.ndarray) -> pa.RecordBatch:
        lengths = np.array(block["lengths"], np.int64)
        ends = np.cumsum(lengths)
        crc, n, start = [], lengths.copy(), block["shard_offset"] + ends - lengths
        for i, (a, b) in enumerate(zip(ends - lengths, ends)):
            crc.append(zlib.crc32(ids[a:b].tobytes(), block["carried_crc32"] if i == 0 else 0))
        n[0] += block["carried_tokens"]
        start[0] -= block["carried_tokens"]
        whole = len(n) - block["goes_on"]  # a document is told by the block that ends it
        return pa.RecordBatch.from_arrays(
            [pa.array([block["shard"]] * whole, pa.int32()), pa.array(block["doc_ids"][:whole], pa.int64()), pa.array(start[:whole]), pa.array(n[:whole]), pa.array(crc[:whole], pa.int64())],
            ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
        )

    found = _decoded(spark, path, rows, "shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of each stretch of a document within one block."""

    def rows(block: dict, ids: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(block["lengths"])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array([block["shard"]] * len(lists), pa.int32()), pa.array(block["doc_ids"], pa.int64()), pa.array(block["shard_offset"] + ends[:-1]), lists],
            ["shard", "doc_id", "offset", "ids"],
        )

    found = _decoded(spark, path, rows, "shard int, doc_id long, offset long, ids array<long>")
    return found.select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "ids")
