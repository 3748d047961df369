"""Vectorised hashing of byte ranges, words and rolling windows with numpy.

A range's hash is read from prefix sums: h(i, j) = (S[j] - S[i]) * m**-i over unsigned 64-bit
integers, where S sums value[k] * m**k. The multiplier m is odd and so has an inverse.

Such a hash finds candidates and decides nothing: there are unequal texts (a Thue-Morse word of 1024
letters and its mirror image) that share it whatever the multiplier. Whether texts are equal is
decided by their bytes (``Memo``) or by 128 bits of BLAKE2b over their bytes (``digests``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np

U64 = np.uint64
_MULTIPLIERS = {"bytes": 0x9E3779B97F4A7C15, "words": 0xC2B2AE3D27D4EB4F}
_POWERS: dict[tuple[str, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    return _mix_in_place(x.copy())


def _mix_in_place(x: np.ndarray) -> np.ndarray:
    moved = x >> U64(30)
    x ^= moved
    x *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, U64(27), out=moved)
    x ^= moved
    x *= U64(0x94D049BB133111EB)
    np.right_shift(x, U64(31), out=moved)
    x ^= moved
    return x


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15))
#: True for the bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(kind: str, sign: int, n: int) -> np.ndarray:
    table = _POWERS.get((kind, sign))
    if table is None or len(table) < n:
        base = _MULTIPLIERS[kind] if sign > 0 else pow(_MULTIPLIERS[kind], -1, 1 << 64)
        size = max(1, -(-n // (1 << 18))) * (1 << 18)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _POWERS[kind, sign] = table
    return table[:n]


def prefix_sums(values: np.ndarray, kind: str) -> np.ndarray:
    """The sums S for 64-bit values, with S[0] = 0."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.multiply(values, _powers(kind, 1, len(values)), out=out[1:])
    return np.cumsum(out, out=out)


def byte_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """``prefix_sums`` of a value for each byte."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.take(values, data, out=out[1:])
    out[1:] *= _powers("bytes", 1, len(data))
    return np.cumsum(out, out=out)


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A mixed hash for each range [start, end)."""
    out = sums[ends]
    out -= sums[starts]
    out *= _powers(kind, -1, len(sums))[starts]
    return _mix_in_place(out)


def rolling_hashes(sums: np.ndarray, width: int, kind: str) -> np.ndarray:
    """A mixed hash for each window of ``width`` consecutive values."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = sums[width:] - sums[:-width]
    out *= _powers(kind, -1, n)
    return _mix_in_place(out)


def spans_of_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of the concatenated documents; no word crosses an offset."""
    word = ~breaks[data]
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of concatenated documents: spans, hashes and the document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends = spans_of_words(data, offsets)
        self.hashes = range_hashes(byte_sums(data), self.starts, self.ends, "bytes")
        #: Position of each document's first word, and of the end.
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self, width: int) -> np.ndarray:
        """Whether a window of ``width`` words that starts at each word stays in its document."""
        return np.arange(len(self.doc)) + width <= self.bounds[1:][self.doc]


class HashTable:
    """Numbers for 64-bit keys by open addressing, looked up many at a time."""

    def __init__(self, room: int = 1 << 16):
        self.keys, self.numbers, self.count = np.zeros(room, dtype=np.uint64), np.zeros(room, dtype=np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none. No key may be 0."""
        out = np.full(len(keys), -1, dtype=np.int64)
        last = U64(len(self.keys) - 1)
        open_ = np.arange(len(keys))
        spot = (keys & last).astype(np.int64)
        while len(open_):
            held = self.keys[spot]
            hit = held == keys[open_]
            out[open_[hit]] = self.numbers[spot[hit]]
            on = ~hit & (held != 0)
            open_, spot = open_[on], (spot[on] + 1) & int(last)
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Enter distinct keys that are not held."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            full = self.keys != 0
            old_keys, old_numbers = self.keys[full], self.numbers[full]
            self.__init__(1 << (4 * (self.count + len(keys))).bit_length())
            self._put(old_keys, old_numbers)
        self._put(keys, numbers)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.count += len(keys)
        last = len(self.keys) - 1
        spot = (keys & U64(last)).astype(np.int64)
        while len(keys):
            free = self.keys[spot] == 0
            self.keys[spot[free]] = keys[free]  # of several keys for a place the last one gets it
            won = self.keys[spot] == keys
            self.numbers[spot[won]] = numbers[won]
            keys, numbers, spot = keys[~won], numbers[~won], (spot[~won] + 1) & last


def digests(texts: Iterable[bytes]) -> np.ndarray:
    """128 bits of BLAKE2b for each text, as a row of two 64-bit integers."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(x, digest_size=16).digest() for x in texts]), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + size)."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(starts - (ends - sizes), sizes)
    return out


class Rows:
    """Rows of various lengths, end to end in one array that grows."""

    def __init__(self, dtype: type):
        self.flat = np.zeros(1 << 18, dtype=dtype)
        self.starts, self.sizes = (np.zeros(1 << 12, dtype=np.int64) for _ in range(2))
        self.count = self.filled = 0

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The numbers of the new rows."""
        while self.count + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        own = slice(self.count, self.count + len(sizes))
        self.sizes[own], self.starts[own] = sizes, self.filled + np.cumsum(sizes) - sizes
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.count += len(sizes)
        self.filled += len(flat)
        return np.arange(own.start, own.stop)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of rows, and the rows end to end."""
        sizes = self.sizes[rows]
        return sizes, self.flat[ranges(self.starts[rows], sizes)]


#: For the places of some strings: sizes of their ids, the ids end to end, and a score for each string.
Work = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Memo:
    """Ids and scores worked out for byte strings met before, found by hash and told apart by their bytes.

    Unequal strings that share a hash each get a row of their own; only the first of them is found again.
    """

    def __init__(self, most: int):
        self.most = most
        self._start()

    def _start(self) -> None:
        self.table, self.texts, self.ids = HashTable(), Rows(np.uint8), Rows(np.uint32)
        self.keys, self.scores, self.uses = np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0, dtype=np.int32)

    def _add(self, keys: np.ndarray, texts: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray, np.ndarray], uses: np.ndarray) -> np.ndarray:
        sizes, ids, scores = found
        rows = self.texts.add(*texts)
        self.ids.add(sizes, ids)
        if self.texts.count > len(self.keys):
            room = 2 * self.texts.count
            self.keys, self.scores, self.uses = (np.concatenate([x, np.zeros(room - len(x), dtype=x.dtype)]) for x in (self.keys, self.scores, self.uses))
        self.keys[rows], self.scores[rows], self.uses[rows] = keys, scores, uses
        known = keys != 0
        self.table.add(keys[known], rows[known])
        return rows

    def _forget(self) -> None:
        """Make room: strings met once go, and beyond half the room those met less than the median."""
        uses = self.uses[: self.texts.count]
        stay = (uses > 1) & (self.keys[: len(uses)] != 0)
        if stay.sum() > self.most // 2:
            stay &= uses > np.median(uses[stay])
        rows = np.flatnonzero(stay)
        old = self.keys[rows], self.texts.take(rows), (*self.ids.take(rows), self.scores[rows]), np.zeros(len(rows), dtype=np.int32)
        self._start()
        self._add(*old)

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, work: Work) -> np.ndarray:
        """The row of each string; ``work`` is asked for those that are new."""
        if self.texts.count > self.most:
            self._forget()
        sizes = ends - starts
        keys = np.maximum(range_hashes(byte_sums(data), starts, ends, "bytes"), 1)
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(new) - 1
        distinct, sample = ordered[new], order[new]
        index = self.table.find(distinct)
        fresh = np.flatnonzero(index < 0)

        def learn(some: np.ndarray, known: np.ndarray) -> np.ndarray:
            return self._add(known, (sizes[some], data[ranges(starts[some], sizes[some])]), work(some), np.zeros(len(some), dtype=np.int32))

        for a in range(0, len(fresh), 1 << 15):
            part = fresh[a : a + (1 << 15)]
            index[part] = learn(sample[part], distinct[part])
        self.uses[index] += np.bincount(group, minlength=len(distinct)).astype(np.int32)
        out = np.empty(len(starts), dtype=np.int64)
        out[order] = index[group]
        others = self._unlike(out, data, starts, sizes)
        if len(others):
            alike: dict[bytes, list[int]] = {}
            for i in others.tolist():
                alike.setdefault(data[starts[i] : ends[i]].tobytes(), []).append(i)
            firsts = np.array([same[0] for same in alike.values()])
            for row, same in zip(learn(firsts, np.zeros(len(firsts), dtype=np.uint64)).tolist(), alike.values(), strict=True):
                out[same] = row
        return out

    def _unlike(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The strings whose bytes are not those of their row."""
        same = self.texts.sizes[rows] == sizes
        alike = np.flatnonzero(same)
        own = sizes[alike]
        differ = np.flatnonzero(data[ranges(starts[alike], own)] != self.texts.flat[ranges(self.texts.starts[rows[alike]], own)])
        same[alike[np.searchsorted(np.cumsum(own), differ, "right")]] = False
        return np.flatnonzero(~same)
