"""Vectorised words, shingles and set sketches over Arrow string columns (numpy, no per-word Python).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; since these are all
ASCII, working on UTF-8 bytes gives the words of the text's code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in runs of about so many bytes, which bounds the temporary arrays.
RUN_BYTES = 1 << 17

_U = np.uint64
_rng = np.random.default_rng(0x7E55E7A)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_M = 0x9E3779B97F4A7C15 | 1
_LANES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant modulo 2^64, and those of its inverse."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        n = max(n, RUN_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for name, base in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
                run = np.full(n, base, _U)
                run[0] = 1
                _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of a string column; nulls are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; no word crosses a text's bounds."""
    inside = ~_SEPARATOR[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's 64-bit hash, and the index of the first word of each text (one more at the end)."""
    start, end = word_bounds(data, offsets)
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    return hashes, np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles.

    A text of fewer words has its whole word sequence as its only shingle; one without words has none.
    """
    for _, data, offsets in runs(column):
        words, first = word_hashes(data, offsets)
        n = len(words)
        with np.errstate(over="ignore"):
            full = max(0, n - k + 1)
            whole = np.zeros(full, _U)
            for i in range(k):
                whole += words[i : i + full] * _LANES[i]
            whole = mix(whole)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= k:
                    s = np.sort(whole[a : b - k + 1])
                    fresh = s[1:] != s[:-1]
                    yield s if fresh.all() else s[np.concatenate([[True], fresh])]
                elif b > a:
                    yield mix(np.sum(words[a:b] * _LANES[: b - a], keepdims=True) + _U(b - a))
                else:
                    yield whole[:0]


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a sorted set; equal sets have equal ids."""
    with np.errstate(over="ignore"):
        return int(mix(np.sum(mix(s ^ _LANES[20]), keepdims=True) + _U(len(s)) * _LANES[21]).view(np.int64)[0])


def min_keys(s: np.ndarray, keys: int) -> list[int]:
    """Pairs of min-hashes, as signed 64-bit keys."""
    with np.errstate(over="ignore"):
        low = np.array([(s * _LANES[30 + i]).min() for i in range(2 * keys)], _U)
        out = mix(low[0::2] * _LANES[25] + low[1::2] * _LANES[26] + np.arange(keys, dtype=_U))
    return out.view(np.int64).tolist()


def bitmap(s: np.ndarray, bits: int) -> bytes:
    """Parity bitmap of a set, of a power of two of bits: bit i is the parity of the members that hash to i.

    Two bitmaps of one width differ in no more bits than the sets' symmetric difference has members;
    folding a bitmap's halves by xor gives that of half the width.
    """
    at = (mix(s + _LANES[27]) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
