"""Edit distances and common subsequences of many names against many: names with a common beginning share the work on it.

The names are the branches of a tree; a step takes a sign of all of them at one depth. A state has a bit
for each place of the pattern (Myers' vertical differences), so patterns have at most ``PLACES`` signs. Longer
patterns and names of more than ``DEEP`` signs are worked out pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from toponexus.functions.similarity import common_length

PLACES, DEEP = 64, 256
#: States of a step, about, that are held at a time.
_STATES = 1 << 17


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, by a few additions per sign over a bit per place."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, sign in enumerate(a):
        places[sign] = places.get(sign, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for sign in b:
        eq = places.get(sign, 0)
        same = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(across | up)) & full, up & across
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = (less | ~(same | more)) & full, more & same
    return len(b) + up.bit_count() - down.bit_count()


class Tree:
    """Names as a tree: for each depth the parent and the sign of every branch, and the names that end there."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.deep = [i for i, x in enumerate(names) if len(x) > DEEP]
        order = sorted((i for i, x in enumerate(names) if len(x) <= DEEP), key=names.__getitem__)
        sizes = np.array([len(names[i]) for i in order], dtype=np.int64)
        width = int(sizes.max(initial=0))
        signs = np.array([names[i] for i in order], dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(order), max(width, 1))
        found, codes = np.unique(signs, return_inverse=True)
        codes = codes.reshape(signs.shape)
        self.codes = {chr(x): i for i, x in enumerate(found.tolist())}
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        #: At each depth, from 0: the names that end there and the branch of each.
        order = np.array(order, dtype=np.int64)
        self.ends = [(order[sizes == 0], np.zeros(int((sizes == 0).sum()), dtype=np.int64))]
        branch, apart = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=bool)
        apart[:1] = True
        for depth in range(width):
            apart[1:] |= (signs[1:, depth] != signs[:-1, depth]) | (sizes[:-1] <= depth)
            alive = sizes > depth
            first = np.flatnonzero(alive & apart)
            self.levels.append((branch[first], codes[first, depth]))
            branch = np.cumsum(alive & apart) - 1
            at = np.flatnonzero(sizes == depth + 1)
            self.ends.append((order[at], branch[at]))
        self.widest = max((len(x) for x, _ in self.levels), default=1)

    def batches(self, patterns: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Places of some of the patterns, and a row for each with the distance to every name."""
        short = [i for i, x in enumerate(patterns) if 0 < len(x) <= PLACES]
        together = max(1, _STATES // self.widest)
        for at in range(0, len(short), together):
            some = short[at : at + together]
            yield some, self._distances([patterns[i] for i in some])
        for i, x in enumerate(patterns):
            if not 0 < len(x) <= PLACES:
                yield [i], np.array([[edit_distance(x, y) for y in self.names]], dtype=np.int64)

    def held(self, patterns: list[str]) -> np.ndarray:
        """A row for each pattern with the places of every sign of the names, as bits."""
        word = np.uint32 if max(map(len, patterns)) <= 32 else np.uint64
        held = np.zeros((len(patterns), max(len(self.codes), 1)), dtype=word)
        for row, pattern in enumerate(patterns):
            for i, sign in enumerate(pattern):
                if sign in self.codes:
                    held[row, self.codes[sign]] |= word(1 << i)
        return held

    def common(self, patterns: list[str]) -> np.ndarray:
        """A row for each pattern with the length of its longest common subsequence with every name; bytes where no pattern has more than ``PLACES`` signs."""
        short = [i for i, x in enumerate(patterns) if len(x) <= PLACES]
        out = np.empty((len(patterns), len(self.names)), dtype=np.uint8 if len(short) == len(patterns) else np.int64)
        together = max(4, 2 * _STATES // self.widest)
        for at in range(0, len(short), together):
            some = short[at : at + together]
            out[some] = self._common([patterns[i] for i in some]).T
        for i, x in enumerate(patterns):
            if len(x) > PLACES:
                out[i] = [common_length(x, y) for y in self.names]
        return out

    def _common(self, patterns: list[str]) -> np.ndarray:
        # a branch has the states of all patterns side by side
        held = np.ascontiguousarray(self.held(patterns).T)
        word = held.dtype.type
        sizes = np.array([len(x) for x in patterns], dtype=np.uint8)
        full = np.array([(1 << len(x)) - 1 for x in patterns], dtype=word)
        out = np.empty((len(self.names), len(patterns)), dtype=np.uint8)
        row = np.full((1, len(patterns)), ~word(0))
        for depth, (ending, branch) in enumerate(self.ends):
            if depth:
                parent, sign = self.levels[depth - 1]
                hit, row = held.take(sign, axis=0), row.take(parent, axis=0)
                hit &= row
                more = row + hit
                row -= hit
                row |= more
            if len(ending):
                out[ending] = sizes - np.bitwise_count(row.take(branch, axis=0) & full)
        for i in self.deep:
            out[i] = [common_length(x, self.names[i]) for x in patterns]
        return out

    def _distances(self, patterns: list[str]) -> np.ndarray:
        held = self.held(patterns)
        word = held.dtype.type
        full = np.array([[(1 << len(x)) - 1] for x in patterns], dtype=word)
        out = np.empty((len(patterns), len(self.names)), dtype=np.int64)
        up, down = np.broadcast_to(~word(0), (len(patterns), 1)), np.zeros((len(patterns), 1), dtype=word)
        for depth, (ending, branch) in enumerate(self.ends):
            if depth:
                parent, sign = self.levels[depth - 1]
                eq, up, down = np.take(held, sign, axis=1), np.take(up, parent, axis=1), np.take(down, parent, axis=1)
                across = eq & up
                across += up
                across ^= up
                across |= eq
                eq |= down
                less = up & across
                across |= up
                np.invert(across, out=across)
                across |= down
                across <<= word(1)
                across |= word(1)
                less <<= word(1)
                np.bitwise_or(eq, across, out=up)
                np.invert(up, out=up)
                up |= less
                down = np.bitwise_and(across, eq, out=across)
            if len(ending):
                out[:, ending] = depth + np.bitwise_count(up[:, branch] & full).astype(np.int64) - np.bitwise_count(down[:, branch] & full)
        for i in self.deep:
            out[:, i] = [edit_distance(x, self.names[i]) for x in patterns]
        return out
