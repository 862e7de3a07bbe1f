"""Static range asymmetric numeral system over interleaved lanes, in numpy.

Token t of a block belongs to lane t mod lanes; a step codes one token of every
lane at once. A lane's state holds 31 to 63 bits and gives 32-bit words to the
block's one stream. The frequency table is shared by all blocks.
"""

from __future__ import annotations

import numpy as np

# Frequencies sum to 2**BITS.
BITS = 20
LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_BITS = np.uint64(BITS)
_MASK = np.uint64((1 << BITS) - 1)


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS; every id that occurs keeps at least 1."""
    present = np.flatnonzero(counts)
    if len(present) > 1 << BITS:
        raise ValueError(f"more than {1 << BITS} different ids")
    freq = np.zeros(len(counts), np.int64)
    freq[present] = np.maximum(1, np.floor(counts[present] / counts.sum() * (1 << BITS)))
    over = int(freq.sum()) - (1 << BITS)
    for i in present[np.argsort(-freq[present], kind="stable")]:
        if over == 0:
            break
        step = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= step
        over -= step
    return freq


class Table:
    """Look-ups of one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.below = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - BITS)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def lanes_for(n: int, most: int) -> int:
    return max(1, min(most, n // 64))


def encode(ids: np.ndarray, table: Table, lanes: int) -> tuple[bytes, bytes]:
    """Lane states where decoding begins, and the words it reads."""
    state = np.full(lanes, LOW, np.uint64)
    words = []
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        some = ids[at : at + lanes]
        x, f = state[: len(some)], table.freq[some]
        full = x >= table.limit[some]
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: len(some)] = (q << _BITS) + (x - q * f) + table.below[some]
    return state.astype("<u8").tobytes(), b"".join(w.tobytes() for w in reversed(words))


def decode(n: int, states: bytes, words: bytes, table: Table) -> np.ndarray:
    state = np.frombuffer(states, "<u8").astype(np.uint64)
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    lanes, out, read = len(state), np.empty(n, np.uint32), 0
    for at in range(0, n, lanes):
        m = min(lanes, n - at)
        x = state[:m]
        slot = x & _MASK
        some = table.symbol[slot]
        x = table.freq[some] * (x >> _BITS) + slot - table.below[some]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << _WORD) | stream[read : read + len(low)]
        read += len(low)
        state[:m] = x
        out[at : at + m] = some
    if read != len(stream) or not (state == LOW).all():
        raise ValueError("a token block is damaged: its states do not return to the start")
    return out
