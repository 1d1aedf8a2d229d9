"""Words of whole texts as 64-bit hashes, taken from Arrow buffers without a Python object per word.

A word is a maximal run of word bytes.  Its hash is a sum over its bytes: the
byte's random number times the random number of its place, plus the length, mixed
at the end.  Places have numbers of their own, not powers of a base, so texts of a
regular structure meet as rarely as others, with a chance of about 2**-62.
Sequences of words (shingles) are hashed over the word hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a single longer text is worked on alone.
SLICE_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Alphabet:
    """What counts as a word byte, and the lower-casing of A-Z before that."""

    lower: bool
    separators: bytes

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return _table(self.lower, self.separators)


#: Words between ASCII white space, as written or with A-Z lower-cased.
PLAIN = Alphabet(False, SPACES)
LOWER = Alphabet(True, SPACES)
#: Runs of 0-9, a-z and anything outside ASCII.
ALNUM = Alphabet(True, bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))


@lru_cache
def _table(lower: bool, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
    if lower:
        codes[65:91] = codes[97:123]
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return codes, inside


_places: list[np.ndarray] = []


def _place_numbers(n: int) -> np.ndarray:
    """Random odd numbers of the places 0, 1, ..., n - 1 in a span."""
    found = _places[0] if _places else np.zeros(0, np.uint64)
    if len(found) < n:
        found = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
        if n <= SLICE_BYTES:
            _places[:] = [found]
    return found


_resident: dict = {}


def resident(key: object, build: Callable[[], object]) -> object:
    """The one large object that this Python worker keeps between tasks; asking for another lets it go first."""
    if key not in _resident:
        _resident.clear()
        release_memory()
        _resident[key] = build()
        release_memory()
    return _resident[key]


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Words:
    """Words of some texts in a row: ``first[d]:first[d + 1]`` are those of text d."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and the offsets of its rows; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_utf8())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def text_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def find_spans(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes; no run crosses a text edge."""
    n = len(inside)
    begin, end = np.empty(n, bool), np.empty(n, bool)
    begin[:1] = True
    np.logical_not(inside[:-1], out=begin[1:])
    begin[edges[edges < n]] = True
    end[-1:] = True
    np.logical_not(inside[1:], out=end[:-1])
    end[edges[(edges > 0) & (edges < n)] - 1] = True
    begin &= inside
    end &= inside
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray | None = None, lead_code: int = 0) -> np.ndarray:
    """Hashes of ``codes[start:end]``, not yet mixed; spans are in order and don't overlap.

    Spans with ``lead`` are hashed as if one more byte of ``lead_code`` stood before them.
    """
    n = len(codes)
    more = np.zeros(len(starts), np.int64) if lead is None else lead.astype(np.int64)
    place = np.zeros(n + 1, np.int64)
    place[starts] = starts - more
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(n + 1), place, out=place)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.take(_place_numbers(int(place.max()) + 1), place[:-1], out=sums[1:])
    sums[1:] *= codes
    np.cumsum(sums, out=sums)
    hashes = sums[ends] - sums[starts]
    hashes += (ends - starts + more).astype(np.uint64) * GOLDEN
    if lead is not None:
        hashes += more.astype(np.uint64) * np.uint64(lead_code) * _place_numbers(1)[:1]
    return hashes


def find_words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d + 1]]``."""
    low = int(offsets[0])
    text, edges = data[low : int(offsets[-1])], offsets - low
    codes, inside = alphabet.table()
    starts, ends = find_spans(inside[text], edges)
    hashes = mix(span_hashes(codes[text], starts, ends))
    return Words(hashes, starts + low, ends + low, np.searchsorted(starts, edges))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, over text borders too: callers drop those with ``inside_text``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total *= STEP
        total += hashes[k : k + n]
    return mix(total + np.uint64(size))


def shingle_starts(words: Words, size: int) -> np.ndarray:
    """Word numbers at which a run of ``size`` words within one text begins."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    allowed = np.ones(n, bool)
    for back in range(1, size):
        border = words.first[1:-1] - back
        allowed[border[(border >= 0) & (border < n)]] = False
    # A border cuts every run that begins before it and ends after it.
    return np.flatnonzero(allowed)


def hash_text(text: bytes, alphabet: Alphabet) -> np.ndarray:
    """Word hashes of one text."""
    return find_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), alphabet).hashes


class HashTable:
    """64-bit keys -> numbers 0, 1, ... in the order of arrival, looked up many at a time.

    Open addressing over numpy arrays: at most ``2 ** bits`` slots of 12 bytes,
    of which callers fill no more than two thirds.
    """

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is new."""
        keys = np.maximum(keys, np.uint64(1))
        at = (keys >> self.shift).astype(np.int64)
        there = self.keys[at]
        found = np.where(there == keys, self.numbers[at], -1)
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            at[todo] = step = (at[todo] + 1) & self.mask
            there = self.keys[step]
            same = there == keys[todo]
            found[todo[same]] = self.numbers[step[same]]
            todo = todo[~same & (there != 0)]
        return found

    def add(self, keys: np.ndarray, first: int) -> None:
        """New, different keys get the numbers ``first``, ``first + 1``, ..."""
        keys = np.maximum(keys, np.uint64(1))
        at = (keys >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            slot, which = np.unique(at[free], return_index=True)
            self.keys[slot] = keys[free[which]]
            self.numbers[slot] = free[which] + first
            todo = np.setdiff1d(todo, free[which], assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask
