"""Encoding whole texts with a given tokenizer file inside Spark tasks.

A byte-level tokenizer cuts a text into pre-tokens before it merges bytes. Texts are cut
at boundaries that are safe for that: before a space that a visible character follows,
and where a run of letters, digits, signs or a line end meets another. Cuts come from
the classes of bytes, whole arrays at a time, and Arrow numbers the units, so that
Python sees each distinct one once a batch; the library encodes it once per worker
while the memo has it. A text's ids are its units' ids in order. Files of another kind
go to their library whole. The memo is bounded by bytes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that one encoding batch holds; a longer text is a batch alone.
BATCH_BYTES = 4 << 20
# Bytes that one of the two generations of a worker's memo may hold, and a unit's share besides its text.
MEMO_BYTES = 40 << 20
UNIT_BYTES = 200
# Units in one call of the library.
CALL_UNITS = 1000

_SAFE = re.compile(r" (?=\S)")
_open: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a file; kept while the worker lives."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _open[path] = Pieces(path) if path.endswith(".model") else Units(path) if _cuts_at_spaces(path) else Encoder(path)
    return _open[path]


def _cuts_at_spaces(path: str) -> bool:
    """Whether cutting before a space that a visible character follows is safe."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space", True)
        and before.get("use_regex", True)
        and all(
            not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not re.search(r"\s", a["content"])
            for a in spec.get("added_tokens", ())
        )
    )


class Encoder:
    """Any file of the tokenizers library: whole texts, batch by batch."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (none null) in a row, and the number of ids of each text."""
        each = self._ids(texts.to_pylist())
        return np.concatenate(each) if each else np.zeros(0, self.dtype), np.array([len(x) for x in each], np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(e) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)], np.int64)


class Pieces(Encoder):
    """A sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dtype = np.dtype("<u2" if self.library.get_piece_size() <= 1 << 16 else "<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, self.dtype) for x in self.library.encode(texts, num_threads=1)]

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(x) for x in self.library.encode(texts.to_pylist(), num_threads=1)], np.int64)


class Memo:
    """Ids of units seen before: a dictionary of places in one array of ids."""

    def __init__(self, dtype: np.dtype):
        self.of: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.filled = self.bytes = 0

    def put(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add units (none there yet) with their ids in a row."""
        n, at = len(units), len(self.of)
        while at + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.length[at : at + n] = lengths
        self.start[at : at + n] = self.filled + np.cumsum(lengths) - lengths
        self.filled += len(ids)
        self.bytes += UNIT_BYTES * n + sum(map(len, units)) + ids.nbytes
        self.of.update(zip(units, range(at, at + n)))

    def find(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.of.get, units, repeat(-1)), np.int64, len(units))

    def ids(self, at: np.ndarray) -> np.ndarray:
        length = self.length[at]
        place = np.repeat(self.start[at] - (np.cumsum(length) - length), length)
        place += np.arange(len(place))
        return self.pool[place]


# Classes of bytes. A pre-token is a run of one class, with the space before it; HARD bytes
# (apostrophes, signs of added tokens, controls, most characters beyond Latin) keep their unit whole.
LETTER, DIGIT, SIGN, LINE, SPACE, HARD = range(6)


def _classes(hard: set[int]) -> np.ndarray:
    """A class for each byte of UTF-8; bytes of Latin letters beyond ASCII count as letters."""
    found = np.full(256, HARD, np.uint8)
    found[0x21:0x7F] = SIGN
    found[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
    found[0x30:0x3A], found[0x0A], found[0x20] = DIGIT, LINE, SPACE
    found[sorted(hard)] = HARD
    return found


def _blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space (or a control that Python counts as such) begins at ``at``; the end counts too."""
    padded = np.concatenate([data, np.full(3, 0x20, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    found = ((a >= 0x09) & (a <= 0x0D)) | ((a >= 0x1C) & (a <= 0x20)) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
    wide = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return found | (a == 0xE2) & wide | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)


class Units(Encoder):
    """A byte-level file: units between safe boundaries, each encoded once.

    The memo has two generations: a full one becomes the old one, a unit found there
    moves on to the young one, and what was not met again is gone.
    """

    def __init__(self, path: str, limit: int = MEMO_BYTES):
        super().__init__(path)
        self.limit = limit
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(1 + max(vocabulary.values()), bool)
        for token, i in vocabulary.items():
            self.spaced[i] = token.startswith("Ġ")
        # Added tokens are searched in the whole text, so each must have a byte that keeps its unit whole.
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        signs = {c for t in added for c in t.encode() if c < 0x80 and not chr(c).isalnum()}
        self.classes = _classes({0x27} | signs)
        if any(all(self.classes[c] != HARD for c in t.encode()) for t in added):
            self.classes[:] = np.where(self.classes == SPACE, SPACE, HARD)
        self.young, self.old = Memo(self.dtype), Memo(self.dtype)

    def _recall(self, units: list[str]) -> np.ndarray:
        """Places in the young generation; -1 for units in neither."""
        at = self.young.find(units)
        missing = np.flatnonzero(at < 0)
        if len(missing) and self.old.of:
            some = [units[i] for i in missing.tolist()]
            there = self.old.find(some)
            found = np.flatnonzero(there >= 0)
            if len(found):
                n = len(self.young.of)
                self.young.put([some[i] for i in found.tolist()], self.old.ids(there[found]), self.old.length[there[found]])
                at[missing[found]] = np.arange(n, n + len(found))
        return at

    def _ask(self, units: list[str]) -> None:
        """Encode new units by the library, those that begin with their only space many in a call."""
        plain = [u for u in units if u[:1] == " " and u.rfind(" ") == 0 and len(u) < 1000]
        odd = [u for u in units if not (u[:1] == " " and u.rfind(" ") == 0 and len(u) < 1000)]
        for i in range(0, len(plain), CALL_UNITS):
            some = plain[i : i + CALL_UNITS]
            ids = self._ids(["".join(some)])[0]
            # Only a unit's first token begins with a space.
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(some):
                self.young.put(some, ids, np.diff(first, append=len(ids)))
            else:
                odd += some
        for i in range(0, len(odd), CALL_UNITS):
            some = odd[i : i + CALL_UNITS]
            each = self._ids(some)
            self.young.put(some, np.concatenate(each), np.array([len(x) for x in each], np.int64))

    def _places(self, units: list[str]) -> np.ndarray:
        """Places of distinct units in the young generation."""
        at = self._recall(units)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            some = [units[i] for i in missing.tolist()]
            self._ask(some)
            at[missing] = self.young.find(some)
        return at

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Units of all texts in a row, each text's number of them, and the texts with unsafe spaces."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer else np.zeros(0, np.uint8)
        bounds -= bounds[0]
        kind = self.classes[data]
        # The signs among the letters of their block, and line ends in a row.
        kind[:-1][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = HARD
        kind[:-1][(kind[:-1] == LINE) & (data[1:] == 0x0A)] = HARD
        begin = np.zeros(len(data) + 1, bool)
        begin[bounds] = True
        ends = begin[1:].copy()
        spaces = np.flatnonzero(kind == SPACE)
        unsafe = spaces[_blank(data, spaces + 1) | ends[spaces]]
        careful = np.unique(np.searchsorted(bounds, unsafe, side="right") - 1)
        unit = begin[:-1]
        unit[spaces] = True
        cut = unit.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        hard = np.flatnonzero(kind == HARD)
        if len(hard):
            number = np.cumsum(unit, dtype=np.int32)
            whole = np.zeros(number[-1] + 1, bool)
            whole[number[hard]] = True
            cut &= unit | ~whole[number]
        so_far = np.concatenate([np.zeros(1, np.int32), np.cumsum(cut, dtype=np.int32)])
        starts = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
        return units, so_far[bounds[1:]] - so_far[bounds[:-1]], careful

    def _look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the units of all texts (none null) in a row, and each text's number of them."""
        if self.young.bytes > self.limit:
            self.old, self.young = self.young, Memo(self.dtype)
        flat, counts, careful = self._cut(texts.cast(pa.string()))
        row = np.repeat(np.arange(len(counts)), counts)
        if len(careful):
            hit = np.zeros(len(counts), bool)
            hit[careful] = True
            flat, row = flat.filter(pa.array(~hit[row])), row[~hit[row]]
        coded = flat.dictionary_encode()
        at = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
        if not len(careful):
            return at, counts
        rest, sizes = [], []
        for i in careful.tolist():
            first, *others = _SAFE.split(texts[i].as_py())
            rest += [first, *(" " + u for u in others)]
            sizes.append(1 + len(others))
        once = list(dict.fromkeys(rest))
        by = dict(zip(once, self._places(once).tolist()))
        order = np.argsort(np.concatenate([row, np.repeat(careful, sizes)]), kind="stable")
        counts = counts.copy()
        counts[careful] = sizes
        return np.concatenate([at, np.fromiter(map(by.__getitem__, rest), np.int64, len(rest))])[order], counts

    def _sums(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.young.length[at])])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def _each(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """Stretches of ``texts`` from a row on; a very long text comes in parts that are cut at safe spaces."""
        sizes, done = np.asarray(pc.binary_length(texts)), 0
        for i in np.flatnonzero(sizes > 2 * BATCH_BYTES).tolist():
            if i > done:
                yield done, texts[done:i]
            text, at = texts[i].as_py(), 0
            while len(text) - at > BATCH_BYTES and (m := _SAFE.search(text, at + BATCH_BYTES)):
                yield i, pa.array([text[at : m.start()]])
                at = m.start()
            yield i, pa.array([text[at:]])
            done = i + 1
        if done < len(texts):
            yield done, texts[done:]

    def count(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), np.int64)
        for at, some in self._each(texts):
            found[at : at + len(some)] += self._sums(*self._look_up(some))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.zeros(0, self.dtype)], np.zeros(len(texts), np.int64)
        for at, some in self._each(texts):
            places, counts = self._look_up(some)
            ids.append(self.young.ids(places))
            lengths[at : at + len(some)] += self._sums(places, counts)
        return np.concatenate(ids), lengths


def by_bytes(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about equally many bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    slot = np.cumsum(np.asarray(size, np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """Texts of a slice; null counts as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with an end id after each text, and the lengths so far in a row (from 0)."""
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    whole = np.empty(bounds[-1], np.dtype("<u4"))
    last = np.zeros(bounds[-1], bool)
    last[bounds[1:] - 1] = True
    whole[last] = end_id
    whole[~last] = ids
    return whole, bounds
