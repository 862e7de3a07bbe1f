"""Mixing sources to target weights: fixed-length blocks drawn by index.

The words of each source, in a fixed pseudorandom order of its documents, are cut
into blocks of ``BLOCK`` words. A target is so many slots; every pass of a source over
its blocks follows another pseudorandom permutation of their indices, so a slot's
block is computed, not looked up, and slots meet blocks in one join by index. How
many slots of which source an output shard gets is a multinomial draw from what is
still to be dealt, so the totals hold exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .simhash import text_key
from .tokens import by_bytes

WEIGHTS = (5, 2, 1)
# A source is taken so many times at most.
MOST = 3
BLOCK = 512
SHARDS = 64
SEED = 20
# Documents of one source that a task puts in order together.
SLICE_ROWS = 50_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[float]:
    """Target of each source: shares of the whole by weight, none over ``most`` sizes.

    Weights repeat over the sources in code point order, null last; the given order
    is kept in the result. What a source cannot take goes to the others by weight.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, (sizes[i][0] or "").encode()))
    weight = {i: weights[k % len(weights)] for k, i in enumerate(order)}
    share = [0.0] * len(sizes)
    rest, free = float(sum(n for _, n in sizes)), set(order)
    while free:
        total = sum(weight[i] for i in free)
        over = {i for i in free if rest * weight[i] / total > most * sizes[i][1]}
        for i in over or free:
            share[i] = float(most * sizes[i][1]) if over else rest * weight[i] / total
        if not over:
            break
        rest -= sum(share[i] for i in over)
        free -= over
    return share


def _round(x: np.ndarray, key: int, half: int) -> np.ndarray:
    """A mixing function of ``half`` bits."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) & np.uint64((1 << half) - 1)


def permuted(at: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Images of ``at`` under a pseudorandom permutation of 0 to n - 1.

    A four-round Feistel network over the next even number of bits; what falls
    outside goes through it again.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(key * 0x100000001B3 + r * 0x632BE59BD9B4E019) & (1 << 64) - 1 for r in range(4)]
    out = np.asarray(at, np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            a, b = out[todo] >> h, out[todo] & low
            for k in reversed(keys) if inverse else keys:
                if inverse:
                    a, b = b ^ _round(a, k, half), a
                else:
                    a, b = b, a ^ _round(b, k, half)
            out[todo] = a << h | b
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Mixture:
    """What the driver knows of a mixture: a few numbers per source and shard."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    words: list[int]
    slots: list[int]
    last: list[int]
    counts: np.ndarray


def _key(seed: int, source: int, turn: int) -> int:
    return (seed << 40) + (source << 8) + turn


def draw(sizes: list[tuple[str | None, int]], block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS) -> Mixture:
    """Targets, slots and the draw of slot counts per shard, for sources in order."""
    share = targets(sizes, weights)
    words, slots, last = [], [], []
    for i, (_, size) in enumerate(sizes):
        want, n = min(round(share[i]), MOST * size), -(-size // block)
        turn, rest = divmod(want, size) if size else (0, 0)
        need, cut = 0, block
        if rest:
            # The source's last block is short; where it comes in this pass matters.
            short = size - (n - 1) * block
            at = int(permuted(np.array([n - 1]), n, _key(seed, i, turn), inverse=True)[0])
            held = lambda k: k * block - (block - short if at < k else 0)
            need = -(-rest // block)
            need += held(need) < rest
            cut = rest - held(need - 1)
        words.append(want)
        slots.append(turn * n + need)
        last.append(cut)
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    counts = np.zeros((len(sizes), shards), np.int64)
    for s in range(shards):
        room = -(-int(left.sum()) // (shards - s))
        if room:
            got = np.minimum(rng.multinomial(room, left / left.sum()), left)
            for i in np.argsort(-(left - got), kind="stable"):
                got[i] += (more := min(room - int(got.sum()), int(left[i] - got[i])))
                if not more:
                    break
            counts[:, s] = got
            left -= got
    return Mixture([s for s, _ in sizes], [n for _, n in sizes], share, words, slots, last, counts)


def sized(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text_key, source, size`` of each row, written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                n = [len(x.as_buffer().to_pybytes().split()) if x.is_valid else 0 for x in part.column(4)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(n, pa.int64())], ["row", "doc_id", "text_key", "source", "size"])

    text = F.col("text").cast("string").alias("text")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("source").cast("string").alias("source"), text)
    return materialize(source.mapInArrow(count, "row long, doc_id long, text_key long, source string, size long"), "sizes")


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The documents in stream order, and the mixture's stretches of them.

    First ``row, doc_id, text_key, source, size, source_size, target`` for each row of
    ``docs``; then ``shard, source_number, slot, turn, row, doc_id, text_key, word_start,
    n_words`` for each stretch of a document in a slot. A text's size is its number of
    words (null: 0, never taken). Null is a source like others, the last. Rows that
    repeat are documents of their own. Further columns are ignored, an empty table
    gives empty ones. The order, the draw and the permutations depend on ids, texts and
    ``seed`` alone, so reruns agree.

    One row per source comes to the driver, as its weights come from there.
    """
    spark = docs.sparkSession
    found = sized(docs)
    by_source = found.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    by_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    made = draw([(r["source"], r["size"]) for r in by_source], block, shards, seed, weights)
    numbers = [(r["source"], i, r["size"], made.targets[i]) for i, r in enumerate(by_source)]
    known = F.broadcast(spark.createDataFrame(numbers, "name string, source_number int, source_size long, target double"))

    slices = max(64, -(-max((r["n"] for r in by_source), default=0) // SLICE_ROWS))
    key = ["source_number", "slice"]
    named = found.join(known, found["source"].eqNullSafe(F.col("name"))).drop("name").withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.lit(slices)))
    before = Window.partitionBy("source_number").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = named.groupBy(*key).agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(*key).orderBy("doc_id", "text_key", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, key)
    stream = materialize(placed.withColumn("offset", F.col("base") + F.col("own")).drop("slice", "base", "own"), "stream")

    end = F.col("offset") + F.col("size")
    cut = stream.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + size - 1) div {block}"))).alias("block"))
    begin = F.greatest("offset", F.col("block") * block)
    stretches = cut.select(
        "source_number", "block", "row", "doc_id", "text_key", (begin - F.col("offset")).alias("word_start"), (begin - F.col("block") * block).alias("at"),
        (F.least(end, (F.col("block") + 1) * block) - begin).alias("n"),
    )
    joined = _slots(spark, made, block, shards, seed).join(stretches, ["source_number", "block"])
    used = F.least("n", F.col("words") - F.col("at"))
    mixture = joined.where(used > 0).select("shard", "source_number", "slot", "turn", "row", "doc_id", "text_key", "word_start", used.alias("n_words"))
    return stream.drop("offset"), mixture


def _slots(spark, made: Mixture, block: int, shards: int, seed: int) -> DataFrame:
    """``shard, source_number, slot, turn, block, words`` of every slot, made in the tasks."""
    bounds = np.concatenate([[0], np.cumsum(made.counts.ravel())])
    firsts = np.concatenate([[0], np.cumsum(made.slots)]).astype(np.int64)
    blocks = [-(-n // block) for n in made.sizes]
    last, total = np.array(made.last, np.int64), int(firsts[-1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(0), np.int64)
            cell = np.searchsorted(bounds, at, side="right") - 1
            source = cell // shards
            slot = at - firsts[source]
            n = np.array(blocks, np.int64)[source]
            turn = slot // n
            index = np.zeros(len(at), np.int64)
            for s, t in sorted(set(zip(source.tolist(), turn.tolist()))):
                here = np.flatnonzero((source == s) & (turn == t))
                index[here] = permuted(slot[here] - t * blocks[s], blocks[s], _key(seed, s, t))
            words = np.where(at + 1 == firsts[source + 1], last[source], block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell % shards, pa.int32()), pa.array(source, pa.int32()), pa.array(slot), pa.array(turn, pa.int32()), pa.array(index), pa.array(words)],
                ["shard", "source_number", "slot", "turn", "block", "words"],
            )

    return spark.range(total).mapInArrow(rows, "shard int, source_number int, slot long, turn int, block long, words long")


def taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards`` of each row of ``docs``.

    ``shards`` has the words that each drawn shard takes of the row, by shard.
    """
    stream, mixture = mix(docs, **options)
    by_shard = mixture.groupBy("row", "shard").agg(F.sum("n_words").alias("n_words"))
    sums = by_shard.groupBy("row").agg(F.sum("n_words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "n_words"))).alias("shards"))
    told = stream.join(sums, "row", "left")
    none = F.array().cast("array<struct<shard:int,n_words:bigint>>")
    return told.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def _cut(text: pa.Array, size: pa.Array, stretches: pa.Array) -> pa.Array:
    """The text of word stretches, with the white space after each word."""
    out = []
    for t, n, parts in zip(text, size.to_pylist(), stretches.to_pylist()):
        if sum(p["n_words"] for p in parts) == n:
            out.append(t.as_py())
            continue
        data = t.as_buffer().to_pybytes()
        starts = [m.start() for m in _WORD.finditer(data)]
        starts = [0, *starts[1:], len(data)]
        out.append(b"".join(data[starts[p["word_start"]] : starts[p["word_start"] + p["n_words"]]] for p in parts).decode())
    return pa.array(out, pa.string())


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as rows of ``docs``: what a pass takes of a document is a row.

    Texts hold the words taken, in order, and ``n_chars``, if there is such a column,
    their length; other columns are as they were. Of rows that repeat id and text the
    others' columns come from one of them.
    """
    stream, mixture = mix(docs, **options)
    by_turn = mixture.groupBy("row", "turn", "doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("word_start", "n_words"))).alias("__mix_parts"))
    sizes = stream.select(F.col("row"), F.col("size").alias("__mix_size"))
    parts = by_turn.join(sizes, "row").select(F.col("doc_id").alias("__mix_id"), F.col("text_key").alias("__mix_key"), "__mix_size", "__mix_parts")
    keyed = docs.withColumn("__row_key", text_key())
    if stream.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["doc_id", "__row_key"])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__mix_id")) & (F.col("__row_key") == F.col("__mix_key"))
    joined = keyed.join(parts, same).withColumn("__mix_text", F.arrow_udf(_cut, "string")(F.col("text"), "__mix_size", "__mix_parts"))
    names = {"text": F.col("__mix_text"), "n_chars": F.length("__mix_text")}
    kinds = dict(docs.dtypes)
    return joined.select(*[names[c].cast(kinds[c]).alias(c) if c in names else F.col(f"`{c}`") for c in docs.columns])
