"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .tokens import by_bytes, encoder, texts_of

LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    ``tokenizer`` is a file that every executor can open at that path (.json for
    tokenizers, .model for sentencepiece). Nothing is added, cut or padded.
    A null text counts as empty; repeated rows and null ids give a row each;
    further columns are ignored; an empty table gives an empty one. Batches are
    balanced by bytes, and long texts are cut at safe boundaries before they
    reach the library (see ``tokens``). There is no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                tokens = pa.array(encoder(tokenizer).count(texts_of(part)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, tokens], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
