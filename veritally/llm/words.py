"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python loop per word.

A text column arrives as one byte buffer with offsets. A byte table says which bytes belong to a
word; every byte gets a random 64-bit value times a power for its place in the word, and the sums
per word, mixed, are the hashes. Rolling k-grams are weighted sums of neighbouring word hashes.
Null texts count as empty. Hashes do not depend on the document, the batch or the machine.
"""

from __future__ import annotations

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
NO_ID = (1 << 63) - 1  # stands for a null id inside tasks: larger than any other


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U(base), U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE, _STEP = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Kind(NamedTuple):
    """word: which bytes belong to words; value: the 64-bit value of each byte."""

    word: np.ndarray
    value: np.ndarray


def _kind(word, lower: bool) -> Kind:
    seen = _LOWER if lower else np.arange(256, dtype=np.uint8)
    return Kind(np.array([bool(word(int(b))) for b in seen]), _BYTE[seen])


def _not_space(b: int) -> bool:
    return b != 0x20 and not 0x09 <= b <= 0x0D


PLAIN = _kind(_not_space, False)
LOWER = _kind(_not_space, True)
ALNUM = _kind(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80, True)


class Words(NamedTuple):
    """h: word hashes in order; n: words per text; start, end: byte places inside their text."""

    h: np.ndarray
    n: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None

    def first(self) -> np.ndarray:
        """Index of each text's first word."""
        return np.cumsum(self.n) - self.n

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), places


def _part(data, places, kind: Kind, spans: bool) -> Words:
    lo, hi = places[0], places[-1]
    data, places = data[lo:hi], places - lo
    count = len(places) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), np.zeros(count, np.int64), none if spans else None, none if spans else None)
    word = kind.word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), np.zeros(count, np.int64), none if spans else None, none if spans else None)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    length = np.diff(start, append=len(data))
    place = np.arange(start[0], len(data)) - np.repeat(start, length)
    value = kind.value[data[start[0]:]]
    value *= _powers(_BASE, int(length.max()))[place]
    value[~word[start[0]:]] = 0
    h = mix(np.add.reduceat(value, start - start[0]) + U(1) * (end - start).astype(U))
    bounds = np.searchsorted(start, places)
    n = np.diff(bounds)
    if not spans:
        return Words(h, n, None, None)
    base = np.repeat(places[:-1], n)
    return Words(h, n, start - base, end - base)


def words(column, kind: Kind = PLAIN, spans: bool = False, step: int = 1 << 19) -> Words:
    """All words of a column, hashed about `step` bytes at a time to bound the working memory."""
    data, places = buffers(column)
    parts, lo, count = [], 0, len(places) - 1
    while lo < count:
        hi = max(lo + 1, int(np.searchsorted(places, places[lo] + step, "right")) - 1)
        parts.append(_part(data, places[lo:hi + 1], kind, spans))
        lo = hi
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), none, none if spans else None, none if spans else None)
    return Words(*(np.concatenate([p[i] for p in parts]) if parts[0][i] is not None else None for i in range(4)))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and the index of each run's first word."""
    last = len(w.h) - k + 1
    if last <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(last, U)
    for j, power in enumerate(_powers(_STEP, k)):
        total += w.h[j:j + last] * power
    text = w.text_of()
    at = np.flatnonzero(text[:last] == text[k - 1:])
    return mix(total[at]), at


def one_hash(text: str, kind: Kind) -> np.ndarray:
    return words(pa.array([text]), kind).h


def release() -> None:
    """Gives memory that a finished group needed back to the system; workers live on."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None


# ---- sorted whole numbers as short byte strings: differences, one byte plane after another

def pack(sorted_values: np.ndarray) -> bytes:
    v = sorted_values.astype(U, copy=False)
    if not len(v):
        return b""
    d = v.copy()
    d[1:] -= v[:-1]
    k = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T
    return bytes([k]) + planes.tobytes()


def plain_pack(values: np.ndarray) -> bytes:
    """Unsorted whole numbers, from their least one on."""
    if not len(values):
        return b""
    low = int(values.min())
    d = (values.astype(np.int64) - low).view(U) if len(values) else values
    k = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T
    return low.to_bytes(8, "little", signed=True) + bytes([k]) + planes.tobytes()


def _planes(data: bytes, at: int) -> np.ndarray:
    k = data[at]
    n = (len(data) - at - 1) // k
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :k] = np.frombuffer(data, np.uint8, n * k, at + 1).reshape(k, n).T
    return wide.view("<u8").reshape(-1).astype(U)


def unpack(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    return np.cumsum(_planes(data, 0), dtype=U)


def plain_unpack(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    return _planes(data, 8).view(np.int64) + int.from_bytes(data[:8], "little", signed=True)


def ids_of(column) -> np.ndarray:
    """An id column as int64, NO_ID for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.cast(pa.int64()).fill_null(NO_ID))


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values
