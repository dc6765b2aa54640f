"""Short stretches of bytes in texts, over Arrow columns.

A gram is one to four bytes, with A-Z as a-z, written as one number: its length in the high half, its bytes in the low one. A long
gram is five to seven bytes, of which the low half has a hash, so that several may be one number. The gram without bytes is 0, and
every text has it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

LONGEST, LONG = 4, 7
#: Places of the table that says which grams are wanted: a byte each, whatever the number of grams.
PLACES = 1 << 20
#: Text bytes that are turned into arrays at a time; a longer text is taken alone.
SLICE_BYTES = 500_000
_GRAM_BITS = 35
#: Places that are looked at together: their numbers stay in a core's cache.
_AT_ONCE = 32_768

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def grams_of(literal: bytes) -> list[int]:
    """The grams that a text with this literal has: of four bytes, or the whole of a shorter one."""
    literal, n = literal.lower(), min(len(literal), LONGEST)
    return sorted({n << 32 | int.from_bytes(literal[i: i + n], "little") for i in range(len(literal) - n + 1)}) if n else [0]


def long_grams_of(literal: bytes) -> list[int]:
    """The grams that a text with this literal has: of seven bytes, five of a literal of six, or the whole of a shorter one."""
    literal = literal.lower()
    if len(literal) <= LONGEST:
        return grams_of(literal)
    n = LONG if len(literal) >= LONG else LONGEST + 1
    codes = [int.from_bytes(literal[i: i + n], "little") for i in range(len(literal) - n + 1)]
    return sorted(set(_numbered(np.array(codes, np.uint64), n).tolist()))


def _numbered(codes: np.ndarray, n: int) -> np.ndarray:
    """The grams of ``n`` bytes that are written as these numbers."""
    return ((codes if n <= LONGEST else codes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) | np.uint64(n << 32)).view(np.int64)


def place(grams: np.ndarray) -> np.ndarray:
    """Where a gram is in the table of wanted ones; several grams may share a place."""
    return (grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, "right")) - 1
        last = min(max(first + 1, last), len(texts))
        yield first, _LOWER[data[bounds[first]: bounds[last]]], bounds[first: last + 1] - bounds[first]
        first = last


def found_grams(texts: pa.Array, wanted: np.ndarray, sizes: Iterable[int] = range(LONGEST + 1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, grams)``: each gram at a wanted place once for each text that has it, of the sizes that are wanted."""
    if not len(texts):
        return
    sizes = set(sizes)
    for first, data, bounds in _slices(texts):
        found, n_rows = [], len(bounds) - 1
        every = np.arange(n_rows if 0 in sizes and wanted[place(np.zeros(1, np.int64))][0] else 0) << _GRAM_BITS
        # the eight bytes from each place on, of some places at a time
        codes = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=1)
        for begin in range(0, len(data), _AT_ONCE):
            code = np.array(codes[begin: begin + _AT_ONCE], np.uint64)
            for n in sorted(sizes - {0}):
                grams = _numbered(code & np.uint64((1 << 8 * n) - 1), n)
                at = np.flatnonzero(wanted.take(place(grams).view(np.int64)))
                found.append((n, at + begin, grams[at]))
        # one number for a row and a gram: a gram takes 35 bits, and a slice has fewer than 2**28 rows
        pairs = [every]
        for n, at, grams in found:
            rows = np.searchsorted(bounds, at, "right") - 1
            inside = at + n <= bounds[rows + 1]
            pairs.append(rows[inside] << _GRAM_BITS | grams[inside])
        pairs = np.sort(np.concatenate(pairs))
        if len(pairs):
            pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
            yield (pairs >> _GRAM_BITS) + first, pairs & (1 << _GRAM_BITS) - 1
