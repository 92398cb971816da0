"""Words, n-grams and byte windows of Arrow text batches as numpy arrays.

A batch of texts is one byte buffer with offsets, so splitting and hashing run over whole buffers. Hashes are
polynomial prefix sums modulo 2**64 over random byte values, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Slices of tasks that hold many numbers a byte at a time.
SMALL_SLICE_BYTES = SLICE_BYTES // 4
# a worker's memory goes back to the system after each batch, not to a pool of its own
pa.set_memory_pool(pa.system_memory_pool())
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, min(2 * n, SLICE_BYTES + 1))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """What `spans_of` and `windows_of` hash from: one pass for hashes of any length."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def spans_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash of the values that `prefix` took."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start])


def windows_of(sums: np.ndarray, k: int) -> np.ndarray:
    """rolling of the values that `prefix` took."""
    if len(sums) <= k:
        return np.empty(0, np.uint64)
    return mix((sums[k:] - sums[:-k]) * _power(_INVERSE, len(sums) - k))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    return spans_of(prefix(values), start, end)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k values."""
    return windows_of(prefix(values), k)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_fold = np.arange(256)
_fold[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[_fold]
#: Words are runs of anything but space and \t \n \v \f \r.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Everything ASCII that is no letter or digit; bytes of other scripts belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if arr.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; one longer text is a range of its own."""
    off = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts
    offsets: np.ndarray  #: byte offsets of the texts
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: number of the first word of each text, and the count at the end
    hash: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array, lower: bool = False, separators: np.ndarray = WHITE, hashed: bool = True) -> Words:
    data, off = flat(texts)
    n = len(data)
    inside = ~separators[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    begin[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, off)
    h = span_hash((FOLDED_VALUES if lower else BYTE_VALUES)[data], start, end) if hashed else np.empty(0, np.uint64)
    return Words(data, off, start, end, first, h)


def inside_text(first: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the items at which a window of k items starts that does not leave its text."""
    last = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(len(last)) + k <= last)
