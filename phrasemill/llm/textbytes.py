"""Vectorised text work inside tasks: Arrow string columns as byte arrays, words, and 64-bit hashes.

Everything here works on one bounded slice of a record batch; Spark does the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A row of more bytes is worked on in parts where that is possible.
LONG = 1 << 21

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)

#: [\x20\x09-\x0D]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), _MULTIPLIER if kind == "up" else _INVERSE, np.uint64)
            steps[0] = 1
            _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) with at most ``most`` bytes, or one longer row. Null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def long_cuts(data: np.ndarray, step: int | None = None) -> np.ndarray:
    """Where a very long row may be cut about every ``step`` bytes, with 0 and the end: before a space that stands between two
    visible ASCII characters, where a word, a pre-token and a marked segment end and another begins whatever stands around."""
    step = step or LONG
    at, lo = [0], step
    while lo < len(data):
        part = data[lo - 1 : lo + step + 1]
        seen = (part > 32) & (part < 127)
        spots = np.flatnonzero((part[1:-1] == 32) & seen[:-2] & seen[2:])
        if len(spots):
            at.append(lo + int(spots[0]))
            lo = at[-1]
        lo += step
    return np.array([*at, len(data)])


def slice_parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The slice as it is, or a very long row in parts (bytes and offsets) that cut no word."""
    if len(offsets) != 2 or len(data) <= LONG:
        yield data, offsets
        return
    at = long_cuts(data)
    for a, b in zip(at[:-1], at[1:]):
        yield data[a:b], np.array([0, b - a])


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each longest stretch without separators (by default [^\\x20\\x09-\\x0D]+)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which any substring's hash follows."""
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_CODES[data] * _power("up", len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _power("down", len(sums))[start] + (end - start).astype(np.uint64))


def hashed_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words`` of the bytes with A-Z lowered, and their ``span_hash``. Bytes are taken ``step`` at a time, sums carried over the
    cuts, so that a very long row costs memory for its words and not for its bytes."""
    found: list[tuple[np.ndarray, ...]] = []
    tails: list[tuple[np.ndarray, np.ndarray]] = []
    held, carry, mask = False, 0, (1 << 64) - 1
    with np.errstate(over="ignore"):
        for lo in range(0, len(data), step):
            part = LOWER[data[lo : lo + step]]
            inside, n = ~separator[part], len(part)
            before = np.concatenate([[held], inside[:-1]])
            a, b = np.searchsorted(offsets, [lo, lo + n])
            begins = np.zeros(n, bool)
            begins[offsets[a:b] - lo] = True
            starts, ends = np.flatnonzero(inside & (~before | begins)), np.flatnonzero(before & (~inside | begins))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_CODES[part] * _power("up", n), out=sums[1:])
            up, down = np.uint64(pow(int(_MULTIPLIER), lo, 1 << 64)), np.uint64(pow(int(_INVERSE), lo, 1 << 64))
            at = np.uint64(carry) + up * sums
            found.append((starts + lo, at[starts], down * _power("down", n)[starts]))
            tails.append((ends + lo, at[ends]))
            held, carry = bool(inside[-1]), int(at[-1]) & mask
        if held:
            tails.append((np.array([len(data)]), np.array([carry], np.uint64)))
        if not found:
            return (*words(data, offsets, separator), np.zeros(0, np.uint64))
        start, low, scale = (np.concatenate([f[k] for f in found]) for k in range(3))
        end, high = (np.concatenate([t[k] for t in tails]) for k in range(2))
        h = mix((high - low) * scale + (end - start).astype(np.uint64))
    return start, end, np.searchsorted(offsets, start, "right") - 1, h


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in the sorted row numbers, and the end."""
    return np.searchsorted(row, np.arange(n + 1))
