"""SentencePiece encoding and decoding: a unigram Viterbi over a double-array trie.

The trie holds every piece's UTF-8 bytes; a state's child for byte b is ``base[state] + b`` if
``check`` there names the state. The Viterbi pass walks the trie from every character of many words
at once, as numpy columns: in each round all walks that are still alive take one byte. Where no
piece covers a character, its bytes are encoded as byte pieces; where the model has none, the unknown
piece stands for it.

White space is marked by U+2581, one mark is put before the text, and no piece has a mark after
another sign. Text therefore falls apart before each run of marks without changing the best
segmentation, and each distinct part is segmented once per worker.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponexus.llm.chunks import column_bytes
from toponexus.llm.hashing import Memo, ranges
from toponexus.llm.storage import small_batches

MARK = "▁"
#: Parts whose ids a worker keeps; beyond it those met once make room.
PARTS_KEPT = 1_000_000
#: What an unknown character costs below the least score, as in the library's own unigram model.
UNKNOWN_PENALTY = 10.0
#: Scores at or below this are a sentinel for pieces that are hardly worth taking.
LEAST_SCORE = -1e8
SCHEMA = "doc_id long, n_ids long, n_byte_ids long, n_unknown long, log_score double, ids binary, ids_crc32 long, decoded_sha256 string, lossless boolean"


class DoubleArray:
    """A double-array trie over byte strings."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            node = 0
            for byte in key:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
                    values.append(-1)
            values[node] = value
        size = 2 * len(children) + 512
        base, check, value = (np.full(size, -1, dtype=np.int32) for _ in range(3))
        check[0] = 0
        value[0] = values[0]
        place = {0: 0}
        free = 1
        taken = bytearray(size)
        taken[0] = 1
        for node, kids in enumerate(children):  # a parent's number is below its children's
            at = place.pop(node)
            if not kids:
                continue
            labels = sorted(kids)
            while free < len(taken) and taken[free]:
                free += 1
            first, tries = max(1, free - labels[0]), 0
            while True:
                tries += 1
                if first + 256 >= len(taken):
                    taken += bytes(len(taken))
                    base, check, value = (np.concatenate([x, np.full(len(x), -1, dtype=np.int32)]) for x in (base, check, value))
                if not any(taken[first + b] for b in labels):
                    break
                first += 1
            if tries > 16:  # a crowded stretch is left behind
                free = max(free, first + labels[0])
            base[at] = first
            for b in labels:
                taken[first + b] = 1
                check[first + b] = at
                value[first + b] = values[kids[b]]
                place[kids[b]] = first + b
        used = max(i for i, t in enumerate(taken) if t) + 257
        # leaves lead nowhere: a base past all children, where check never names them
        self.base, self.check, self.value = (np.resize(x, max(used, 512))[: max(used, 512)].copy() for x in (base, check, value))
        self.base[self.base < 0] = 0
        self.check[used - 256 :] = -1

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The states after one more byte, -1 where there is none."""
        to = self.base[states] + labels
        return np.where((self.check[to] == states) & (to > 0), to, -1)


class Unigram:
    """Pieces with log scores from a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        byte_ids = [i for i in range(n) if model.is_byte(i)]
        self.byte_ids = np.array([i for _, i in sorted((int(self.pieces[i][3:5], 16), i) for i in byte_ids)], dtype=np.int64) if len(byte_ids) == 256 else None
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece has a mark after another sign")
        self.scores = np.array([model.get_score(i) for i in range(n)], dtype=np.float64)
        self.trie = DoubleArray({self.pieces[i].encode(): i for i in normal})
        least = float(min(x for x in self.scores[normal] if x > LEAST_SCORE))
        self.scores[self.scores <= LEAST_SCORE] = least - 1  # sums of the sentinel itself would lose the small scores
        self.unknown_score = least - 1 - UNKNOWN_PENALTY
        self._raw = [b""] * n
        for i in normal:
            self._raw[i] = self.pieces[i].encode()
        for value, i in enumerate(self.byte_ids if self.byte_ids is not None else []):
            self._raw[i] = bytes([value])
        self.known = Memo(PARTS_KEPT)

    def segment(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over each of the concatenated parts: ids, ids per part, score per part.

        Ties go to the segmentation whose last piece is longer, then so on backwards.
        """
        n = len(data)
        sizes = np.diff(offsets)
        count = len(sizes)
        heads = (data & 0xC0) != 0x80
        best = np.full(n + count, -np.inf)  # a part of k bytes has k + 1 places
        shift = np.arange(count)
        begin = offsets[:-1] + shift
        end = offsets[1:] + shift
        best[begin] = 0
        back, piece = np.zeros(n + count, dtype=np.int64), np.full(n + count, -1, dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")  # longest parts first, so that the live ones are a prefix
        lengths = sizes[order]
        begins, firsts = begin[order], offsets[:-1][order]
        for at in range(int(lengths[0]) if count else 0):
            live = int(np.searchsorted(-lengths, -at, "left"))  # parts longer than at
            source, place = firsts[:live] + at, begins[:live] + at
            own = np.flatnonzero(heads[source])
            if not len(own):
                continue
            source, place = source[own], place[own]
            left = lengths[:live][own] - at
            score = best[place]
            # the whole character, if no piece does
            char = 1 + (data[source] >= 0xC0) + (data[source] >= 0xE0) + (data[source] >= 0xF0)
            char = np.minimum(char, left)
            covered = np.zeros(len(own), dtype=bool)
            states, walk, depth = np.zeros(len(own), dtype=np.int64), np.arange(len(own)), 0
            while len(walk):
                states = self.trie.step(states, data[source[walk] + depth]).astype(np.int64)
                depth += 1
                alive = states >= 0
                states, walk = states[alive], walk[alive]
                value = self.trie.value[states]
                ends = np.flatnonzero(value >= 0)
                if len(ends):
                    who, ids = walk[ends], value[ends]
                    covered[who] |= char[who] == depth
                    to, new = place[who] + depth, score[who] + self.scores[ids]
                    better = new > best[to]
                    to = to[better]
                    best[to], back[to], piece[to] = new[better], place[who][better], ids[better]
                more = left[walk] > depth
                states, walk = states[more], walk[more]
            who = np.flatnonzero(~covered)
            if len(who):
                to, new = place[who] + char[who], score[who] + self.unknown_score
                better = new > best[to]
                to = to[better]
                best[to], back[to], piece[to] = new[better], place[who][better], -1
        # walk back from every part's end at once
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        spot, who = end.copy(), np.arange(count)
        while len(who):
            more = spot > begin[who]
            spot, who = spot[more], who[more]
            if not len(who):
                break
            found.append((who, spot, piece[spot]))
            spot = back[spot]
        if not found:
            return np.zeros(0, dtype=np.uint32), np.zeros(count, dtype=np.int64), np.zeros(count)
        who, spot, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((spot, who))
        who, spot, ids = who[order], spot[order], ids[order]
        gone = ids < 0
        if gone.any() and self.byte_ids is not None:
            widths = np.where(gone, spot - back[spot], 1)
            first = np.where(gone, back[spot] - who, 0)
            row = np.repeat(np.arange(len(ids)), widths)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(widths) - widths, widths)
            ids = np.where(gone[row], self.byte_ids[data[first[row] + nth * gone[row]]], ids[row])
            who = who[row]
        else:
            ids = np.where(gone, self.unknown, ids)
        return ids.astype(np.uint32), np.bincount(who, minlength=count), best[end]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, given as concatenated UTF-8; ids and log score of each text."""
        marked, bounds = mark_spaces(data, offsets)
        starts, ends, of_text = split_marked(marked, bounds)

        def work(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sizes = ends[some] - starts[some]
            ids, counts, scores = self.segment(marked[ranges(starts[some], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
            return counts, ids, scores

        each = self.known.rows(marked, starts, ends, work)
        sizes, flat = self.known.ids.take(each)
        total = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.searchsorted(of_text, np.arange(len(offsets)))
        scores = np.add.reduceat(np.append(self.known.scores[each], 0.0), np.minimum(edges[:-1], len(each))) if len(offsets) > 1 else np.zeros(0)
        scores[edges[1:] == edges[:-1]] = 0
        return flat, np.diff(total[edges]), scores

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: pieces and byte pieces joined, marks back to spaces, the first mark dropped."""
        raw = b"".join(map(self._raw.__getitem__, ids.tolist()))
        mark = MARK.encode()
        return (raw[len(mark) :] if raw.startswith(mark) else raw).replace(mark, b" ")


def mark_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with every space as a mark, and a mark before each text that is not empty."""
    sizes = np.diff(offsets)
    some = sizes > 0
    width = np.where(data == 32, 3, 1)
    total = np.concatenate([[0], np.cumsum(width)])
    bounds = total[offsets] + 3 * np.concatenate([[0], np.cumsum(some)])
    out = np.empty(int(bounds[-1]), dtype=np.uint8)
    lead = np.repeat(np.cumsum(some), sizes) * 3
    place = total[:-1] + lead
    spaces = data == 32
    out[place] = np.where(spaces, 0xE2, data)
    out[place[spaces] + 1] = 0x96
    out[place[spaces] + 2] = 0x81
    heads = bounds[:-1][some]
    out[heads], out[heads + 1], out[heads + 2] = 0xE2, 0x96, 0x81
    return out, bounds


def split_marked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts that begin at a run of marks or a text: starts, ends, text of each."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    mark = np.zeros(n, dtype=bool)  # the first byte of a mark
    mark[: max(0, n - 2)] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81) if n > 2 else False
    begins = mark.copy()
    begins[3:] &= ~mark[:-3]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n), np.searchsorted(bounds, starts, "right") - 1


@lru_cache(maxsize=2)
def model(path: str) -> Unigram:
    return Unigram(path)


def _rows(path: str, with_ids: bool, batch_bytes: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        is_byte = np.zeros(len(pieces.pieces), dtype=bool)
        if pieces.byte_ids is not None:
            is_byte[pieces.byte_ids] = True
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + batch_bytes, "right")) - 1)
                own, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, counts, scores = pieces.encode(own, edges)
                ends = np.concatenate([[0], np.cumsum(counts)])
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
                unknown_before = np.concatenate([[0], np.cumsum(ids == pieces.unknown)])
                raw, body = ids.astype("<u4").tobytes(), own.tobytes()
                slices = [raw[4 * x : 4 * y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                decoded = [pieces.decode(ids[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts),
                        pa.array(np.diff(bytes_before[ends])),
                        pa.array(np.diff(unknown_before[ends])),
                        pa.array(scores),
                        pa.array(slices if with_ids else [None] * (b - a), pa.binary()),
                        pa.array([zlib.crc32(x) for x in slices], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                        pa.array([x == body[p:q] for x, p, q in zip(decoded, edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.bool_()),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )
                a = b

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text, decode the ids again, and say whether that gave the text.

    Returns doc_id, n_ids, n_byte_ids (byte-fallback ids), n_unknown, log_score (sum of the pieces'
    scores), ids (little-endian 4-byte; null unless ``with_ids``), ids_crc32, decoded_sha256 and
    lossless, a row for each row of ``docs``. Null and empty text has no ids. A text that itself
    holds U+2581 decodes it as a space and is then not lossless; nor are texts with unknown pieces
    where the model has no byte pieces. Repeated rows stay. Other columns are not read.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rows(model_path, with_ids), SCHEMA)
