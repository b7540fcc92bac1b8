"""Words and shingles of Arrow string columns as 64-bit hashes, without a Python loop
over words. A hash stands for its word or shingle: for two different ones to be taken
for the same, all 64 bits must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes that are worked on at a time.
BLOCK = 1 << 19
MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = 0x0A
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
AS_IS = np.arange(256, dtype=np.uint8)
_random = np.random.default_rng(20)
BYTE = _random.integers(1, MASK, 256, np.uint64, endpoint=True)
FACTOR = 0x9E3779B97F4A7C15
PLACE = _random.integers(1, MASK, 16, np.uint64, endpoint=True) | np.uint64(1)
# Masks of the first 0 to 8 bytes of a little-endian number.
FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
# Words of more bytes than this are hashed by prefix sums instead of in steps.
LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor & MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings and where each begins and the last ends. A null is
    an empty string."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(
    data: np.ndarray, starts: np.ndarray, letters: np.ndarray = LOWER
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of the strings that begin at ``starts`` and lie
    end to end in ``data``. Letters A-Z count as a-z, but not if ``letters`` is ``AS_IS``."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    new = np.empty(len(data), bool)
    new[0] = True
    new[1:] = ~solid[:-1]
    cuts = starts[(starts > 0) & (starts < len(data))]
    new[cuts] = True
    first = np.flatnonzero(solid & new)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    last[cuts - 1] = True
    size = np.flatnonzero(solid & last) + 1 - first
    text = np.zeros(len(data) + 8, np.uint8)
    np.take(letters, data, out=text[: len(data)])
    # Eight bytes from every place on.
    eight = np.ndarray(len(data) + 1, "<u8", text, strides=(1,))
    out = mixed(eight[first] & FRONT[np.minimum(size, 8)])
    open_words = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(open_words):
        left = size[open_words] - done
        part = eight[first[open_words] + done] & FRONT[np.minimum(left, 8)]
        out[open_words] = mixed(out[open_words] ^ part)
        open_words = open_words[left > 8]
        done += 8
    for i in np.flatnonzero(size > LONG):
        out[i] = _long_word(text[first[i] : first[i] + size[i]])
    return mixed(out + size.astype(np.uint64)), first


def _long_word(text: np.ndarray) -> np.uint64:
    """A polynomial in an odd factor over the bytes, some at a time."""
    total = np.zeros(1, np.uint64)
    for at in range(0, len(text), BLOCK):
        own = text[at : at + BLOCK]
        part = (BYTE[own] * _powers(len(own), FACTOR)).sum(keepdims=True, dtype=np.uint64)
        total = mixed(total + part)
    return total[0]


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one text; of the whole text if it is shorter."""
    k = min(n, len(hashes))
    if not k:
        return hashes[:0]
    total = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        total += hashes[i : len(hashes) - k + 1 + i] * PLACE[i]
    return mixed(total + np.uint64(k))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For every string its distinct shingles in ascending order of their hashes."""
    data, at = bytes_of(column)
    # A few strings at a time, so that what is held follows the texts and not the batch.
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + 4 * BLOCK, "right")) - 1)
        hashes, first = words(data[at[i] : at[j]], at[i:j] - at[i])
        bounds = np.searchsorted(first, at[i : j + 1] - at[i])
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            yield distinct(shingles(hashes[low:high], n))
        i = j


def distinct(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def fingerprint(members: np.ndarray) -> int:
    """One signed 64-bit hash of a set of hashes."""
    total = int(mixed(members + np.uint64(FACTOR)).sum(dtype=np.uint64)) if len(members) else 0
    value = (total + len(members) * FACTOR) & MASK
    return value - (1 << 64) if value >> 63 else value


def fingerprints(members: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``fingerprint`` of sets that lie end to end in ``members``, none of them empty."""
    total = np.add.reduceat(mixed(members + np.uint64(FACTOR)), begin)
    return (total + size.astype(np.uint64) * np.uint64(FACTOR)).view(np.int64)
