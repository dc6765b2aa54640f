"""Texts as arrays of bytes and word hashes, for functions that see Arrow batches.

A word is a run of ``[^\\x20\\x09-\\x0D]`` bytes of the UTF-8 text; A-Z count as a-z. Everything here
works on one slice of a batch at a time, so memory follows the slice and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes that are turned into arrays at a time. A longer text is a slice of its own.
SLICE_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose results look random."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE = _powers(_ODD, 1), _powers(_ODD_INVERSE, 1)


def _grow(n: int) -> None:
    global _POWER, _INVERSE
    if len(_POWER) < n:
        _POWER, _INVERSE = _powers(_ODD, n), _powers(_ODD_INVERSE, n)


@dataclass
class Slice:
    """Some texts of a batch: their bytes one after the other."""

    first: int            # row of the batch
    data: np.ndarray      # bytes
    bounds: np.ndarray    # len(texts) + 1 positions in data

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> str:
        return self.data[self.bounds[i]: self.bounds[i + 1]].tobytes().decode()

    def words(self) -> Words:
        inside = ~_SPACE[self.data]
        cuts = np.zeros(len(self.data) + 1, bool)
        cuts[self.bounds] = True
        before = np.concatenate(([False], inside[:-1]))[: len(inside)]
        starts = np.flatnonzero(inside & (~before | cuts[:-1]))
        after = np.concatenate((inside[1:], [False]))[: len(inside)]
        ends = np.flatnonzero(inside & (~after | cuts[1:])) + 1
        return Words(self, inside, starts, ends, np.searchsorted(starts, self.bounds))


@dataclass
class Words:
    """The words of a slice; ``bounds`` are positions of texts in the list of words."""

    of: Slice
    inside: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        return hash_spans(self.of.data, self.starts, self.ends)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each stretch of bytes."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64))


def hash_word(word: bytes) -> int:
    """What ``Words.hashes`` gives for one word, as a plain loop."""
    total = sum(int(_BYTE[_LOWER[b]]) * pow(_ODD, i, 1 << 64) for i, b in enumerate(word))
    return int(mix(np.array([(total + len(word)) % (1 << 64)], np.uint64))[0])


def slices(texts: pa.Array, limit: int = SLICE_BYTES, lower: bool = True) -> Iterator[Slice]:
    """The texts of an Arrow column, null as empty, lower-cased, in pieces of about ``limit`` bytes."""
    if texts.null_count or texts.type not in (pa.string(), pa.binary()):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    kind = np.int32 if texts.type in (pa.string(), pa.binary()) else np.int64
    bounds = np.frombuffer(offsets, kind)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        part = data[bounds[first]: bounds[last]]
        yield Slice(first, _LOWER[part] if lower else part, bounds[first: last + 1] - bounds[first])
        first = last


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers as the longs of Spark."""
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list column: row i holds ``values[bounds[i]:bounds[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
