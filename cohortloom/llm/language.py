"""Language by compression: the dictionary that makes a text smallest names it.

Each language has a zstandard raw-content dictionary, cut from a bounded sample of
labelled texts. A text is compressed in chunks with every dictionary; the language
with the fewest bytes is chosen, and a narrow margin to the next is a rejection.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

# Labelled texts per language, and characters of each, that a dictionary is cut from.
SAMPLE_TEXTS = 256
SAMPLE_CHARS = 400
# Bytes of a text that are compressed at once; the text is read whole, chunk by chunk.
CHUNK = 4096
# Optimal parsing and matches from 3 bytes: words here share short stems.
LEVEL = 3
PARAMETERS = {"strategy": zstandard.STRATEGY_BTOPT, "min_match": 3}
# Share of the next best size that the best must save.
MARGIN = 0.002
UNKNOWN = "und"

_open: dict[int, list] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A dictionary for each language from ``doc_id, text, lang`` (all rows given may be learned from), the most frequent first.

    About ``texts`` rows of each language, chosen by the hash of their id, give ``chars``
    characters each from a place that the hash tells too. Rows without id, text or
    language teach nothing.
    """
    labelled = docs.where("doc_id is not null and text is not null and lang is not null and lang <> ''")
    # One row per language.
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {}
    slots = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(slots, -(-2 * texts * slots // n)))])
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), room) + 1).cast("int"), F.lit(chars))
    rows = labelled.where(slot < share[F.col("lang")]).select("lang", slot.alias("slot"), "doc_id", piece.alias("piece")).collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["slot"], r["doc_id"], r["piece"])):
        found.setdefault(r["lang"], []).append(r["piece"])
    return {lang: "\n".join(found[lang][:texts]).lower().encode() for lang in sorted(found, key=lambda x: (-counts[x], x))}


def _compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    key = hash(tuple(dictionaries.items()))
    if key not in _open:
        _open.clear()
        made = []
        for lang, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, **PARAMETERS, dict_size=len(data), source_size=CHUNK, write_content_size=False)
            d.precompute_compress(compression_params=p)
            made.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=p)))
        _open[key] = made
    return _open[key]


def predict(text: str | None, compressors: list) -> tuple[str, float]:
    """Language and share of bytes saved against the next best, from 0 to 1."""
    if not compressors or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    data = text.lower().encode()
    sizes = [0] * len(compressors)
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK]
        for i, (_, c) in enumerate(compressors):
            sizes[i] += len(c.compress(chunk))
    best = min(range(len(sizes)), key=lambda i: sizes[i])
    others = [n for i, n in enumerate(sizes) if i != best]
    return compressors[best][0], 1.0 - sizes[best] / min(others) if others else 1.0


def classify(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column.

    Null texts and texts without a letter are ``und`` with score 0; equal sizes go to
    the language with more labelled rows, with score 0.
    """

    def f(texts: pa.Array) -> pa.Array:
        compressors = _compressors(dictionaries)
        found = [predict(t.as_py(), compressors) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(f, "lang_pred string, score double")(text.cast("string"))


def rejected(found: Column, margin: float = MARGIN) -> Column:
    return (found["lang_pred"] == UNKNOWN) | (found["score"] < margin)


def identify(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of each row of ``docs``.

    Dictionaries come from rows that are not held out; a prediction sees the text alone.
    A null id is not held out and teaches nothing. Without any labelled row every
    language is ``und``. Repeated rows give a row each; further columns are ignored.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    dictionaries = learn(source.where(~held_out(F.col("doc_id"))))
    found = source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), classify(F.col("text"), dictionaries).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", rejected(F.col("found"), margin).alias("rejected"))


def kept_rows(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    dictionaries = learn(source.where(~held_out(F.col("doc_id"))))
    found = docs.withColumn("__language", classify(F.col("text"), dictionaries))
    return found.where(~rejected(F.col("__language"), margin)).select(*[f"`{c}`" for c in docs.columns])
