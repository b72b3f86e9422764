"""Vectorised text helpers for Arrow batches: byte arrays, runs, hashes and ragged gathers, without a loop per word.

All functions take the bytes of many texts laid end to end and the bounds between them, so that one NumPy call serves a
whole batch. Batches are cut by bytes (`pieces`), which bounds a task's memory whatever the length of the texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. A single longer text is handled whole.
PIECE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _LETTER, _NUMBER, _OTHER, _EDGE = 0, 1, 2, 3, 255


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings; null becomes the empty text."""
    if pa.types.is_null(column.type):
        return pa.array([""] * len(column), pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive slices of about `most` bytes each, at least one row."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        stop = min(max(stop, at + 1), len(texts))
        yield at, stop - at
        at = stop


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the bounds: text i is data[bounds[i]:bounds[i + 1]]."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def marked(bounds: np.ndarray, n: int) -> np.ndarray:
    """True at the first byte of every text that is not empty."""
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return first


def runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every longest run of true flags; a run never crosses from one text to the next."""
    n = len(flags)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = marked(bounds, n)
    begins = flags.copy()
    begins[1:] &= ~flags[:-1] | first[1:]
    ends = flags.copy()
    ends[:-1] &= ~flags[1:] | first[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, owner(starts, bounds)


def owner(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The text that holds each byte position."""
    return np.searchsorted(bounds, at, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


#: Bytes hashed at once; a single longer range is hashed whole.
HASH_BYTES = 1 << 17


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse, modulo 2**64."""
    base = 0xD1342543DE82EF95
    tables = []
    for factor in (base, pow(base, -1, 1 << 64)):
        table = np.full(size, factor, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


@functools.lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * HASH_BYTES)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range, from prefix sums of a polynomial; equal ranges get equal hashes.

    The ranges are in order and do not overlap; they are taken a stretch at a time, each with sums of its own.
    """
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        stop = max(int(np.searchsorted(ends, begin + HASH_BYTES, "right")), at + 1)
        part = data[begin : int(ends[stop - 1])]
        up, down = _usual_powers() if len(part) < 2 * HASH_BYTES else _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte_values()[part] * up[: len(part)], out=sums[1:])
        first, last = starts[at:stop] - begin, ends[at:stop] - begin
        found[at:stop] = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _MULTIPLIER)
        at = stop
    return found


def windows(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position of the first word) of every window of `size` words that lies within one text."""
    total = len(words) - size + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(text[:total] == text[size - 1 :])
    joined = np.zeros(len(inside), np.uint64)
    for i in range(size):
        joined = mixed(joined * _MULTIPLIER + words[inside + i])
    return joined, text[inside], inside


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start + length] of all ranges, end to end."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each key, distinct keys by first occurrence, index of the first occurrence)."""
    found = pa.array(keys).dictionary_encode()
    codes, distinct = found.indices.to_numpy(), found.dictionary.to_numpy()
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return codes, distinct, first


def repeated(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in text order: whether the key occurs twice or more in its text, and whether it occurred earlier in it."""
    both = mixed(keys + text.astype(np.uint64) * _MULTIPLIER)
    codes, distinct, first = numbered(both)
    many = np.bincount(codes, minlength=len(distinct)) > 1
    return many[codes], first[codes] != np.arange(len(codes))


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """White space, letter, number or other, of every code point."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    for start in range(0, 0x110000, 1 << 11):
        if 0xD800 <= start < 0xE000:
            continue
        every = "".join(map(chr, range(start, start + (1 << 11))))
        for pattern, kind in ((r"\p{White_Space}+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
            for found in regex.finditer(pattern, every):
                table[start + found.start() : start + found.end()] = kind
    return table


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte offset of each (and the end), and the bounds of the texts in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    offsets = np.empty(len(points) + 1, np.int64)
    offsets[:-1] = np.flatnonzero((data & 0xC0) != 0x80)
    offsets[-1] = len(data)
    return points, offsets, np.searchsorted(offsets, bounds)


def pretokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and text of every match of the byte-level BPE splitting pattern.

    The pattern takes contractions, then letters, numbers or other signs with one leading blank, then white space; of a
    run of white space before a word its last character stands alone (a blank goes to the word).
    """
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    points, offsets, at = code_points(data, bounds)
    n = len(points)
    first = marked(at, n)
    kind = _classes()[points]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[first] = _EDGE
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[:-1][first[1:]] = _EDGE
    after[-1] = _EDGE
    space = kind == _SPACE
    blank = points == 0x20
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1]
    joined &= (before == _SPACE) & ~space
    begins = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != _EDGE)), (before != kind) & ~joined)
    marks = np.flatnonzero((points == 0x27) & begins & (after == _LETTER))
    if len(marks):
        one = points[marks + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = np.where(after[marks + 1] == _LETTER, points[np.minimum(marks + 2, n - 1)], 0)
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[marks[short | long] + 1] = False
        for stop in (marks[short] + 2, marks[long] + 3):
            begins[stop[stop < n]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    return offsets[starts], offsets[ends], np.searchsorted(at, starts, "right") - 1
