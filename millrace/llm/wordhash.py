"""Word and shingle hashes of whole Arrow batches, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered, so words of UTF-8
text split only at ASCII white space. A word's hash is a polynomial in a random odd base over
random 64-bit symbols; prefix sums give all words of a buffer at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SYMBOLS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SYMBOLS[65:91] = _SYMBOLS[97:123]  # A-Z as a-z
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_STEP = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Texts are hashed in pieces of about this many bytes; a longer text is a piece of its own.
PIECE = 1 << 20


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, PIECE + 1), _BASE if kind == "up" else _INV, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a piece in order, and the n + 1 offsets of each text's words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = _IS_WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOLS[raw] * _power("up", n), out=total[1:])
    h = (total[end] - total[start]) * _power("down", n)[start]
    return mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, at)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n-word shingle, and the offsets of each text's; a text with fewer words
    than n (one at least) has its whole sequence as its one shingle."""
    count = np.diff(at)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(out_at[-1], np.uint64)
    full = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(full) else 0):
        full += words[k : k + len(full)] * _STEP[k]
    starts = np.repeat(at[:-1] - out_at[:-1], many) + np.arange(out_at[-1])
    long = np.repeat(count >= n, many)
    out[long] = full[starts[long]]
    for i in np.flatnonzero((count < n) & (count > 0)):
        own = words[at[i] : at[i + 1]]
        out[out_at[i]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) ^ np.uint64(0xA5A5 + len(own))
    return mix(out), out_at
