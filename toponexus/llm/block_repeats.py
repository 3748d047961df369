"""Substring dedup by fixed-block anchors.

Each document's words are cut into non-overlapping reference blocks of ``block`` words, which are
indexed by hash; every rolling window of ``block`` words of every document probes the index. A
window of ``2 * block - 1`` words or more holds at least one whole reference block, so a repeat of
that length has a hit whichever of its copies is the earlier. Hits are extended on both sides to all
windows of ``window`` words around them; a second exchange, of 128-bit digests of their words, finds
each such window's first document, and the union of the windows that are not first is the maximal
exact repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from toponexus.llm import chunks as C
from toponexus.llm.hashing import Words, digests, prefix_sums, rolling_hashes

#: Bits of a block's hash; a chance meeting only adds windows to the second exchange.
BLOCK_BITS = 40
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _probes(words: Words, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rolling windows and their keys."""
    sums = prefix_sums(words.hashes, "words")
    at = np.flatnonzero(words.room(block)[: max(0, len(words.hashes) - block + 1)])
    return at, rolling_hashes(sums, block, "words")[at] >> np.uint64(64 - BLOCK_BITS)


def _first_runs(block: int, bits: int):
    def kernel(chunk: C.Chunk):
        words = Words(chunk.data, chunk.offsets)
        at, keys = _probes(words, block)
        indexed = (at - words.bounds[words.doc[at]]) % block == 0
        packed = np.sort(keys << np.uint64(1) | indexed.astype(np.uint64))
        keys = packed >> np.uint64(1)
        last = np.ones(len(keys), dtype=bool)
        last[:-1] = keys[1:] != keys[:-1]  # the last of equal keys carries the flag, if any does
        keys, flags = keys[last], (packed[last] & np.uint64(1)).astype(bool)
        for bucket, a, b in C.split_sorted(keys, BLOCK_BITS, bits):
            yield bucket, C.pack_arrays(*C.code_sorted(keys[a:b]), np.packbits(flags[a:b])), None
        if not len(keys):
            yield 0, None, None

    return kernel


def _candidates(runs: list[bytes]) -> list[bytes]:
    """A key is a candidate if another chunk indexes it, or if it is indexed here and met elsewhere."""
    keys, flags, sizes = [], [], []
    for run in runs:
        first, steps, packed = C.unpack_arrays(run)
        keys.append(C.decode_sorted(first, steps))
        flags.append(np.unpackbits(packed, count=len(keys[-1])).astype(bool))
        sizes.append(len(keys[-1]))
    order, group, _ = C.distinct_sorted(np.concatenate(keys))
    flag = np.concatenate(flags)[order]
    met, indexed = np.bincount(group)[group], np.bincount(group, weights=flag)[group]
    out = np.zeros(len(order), dtype=bool)
    out[order] = (indexed > flag) | (flag & (met > 1))
    return C.bitmaps(out, sizes)


def _windows(data: np.ndarray, words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """A 128-bit digest of the words of each window, which decides whether windows are equal."""
    used = np.zeros(len(words.starts) + window, dtype=np.int64)
    used[starts] += 1
    used[starts + window] -= 1
    some = np.flatnonzero(np.cumsum(used)[: len(words.starts)])
    text, places = join_words(data, words.starts[some], words.ends[some])
    first = np.searchsorted(some, starts)
    # a window's words are all used ones, so they follow one another in the joined text
    return digests(text[a : b - 1] for a, b in zip(places[first].tolist(), places[first + window].tolist(), strict=True))


def _local(chunk: C.Chunk, words: Words, starts: np.ndarray, window: int):
    """Distinct window digests with their first local document, and each window's place among them."""
    order, group, keys = C.distinct_pairs(_windows(chunk.data, words, starts, window))
    owner = chunk.ids[words.doc[starts]]
    first = np.full(len(keys), C.NULL_ID, dtype=np.int64)
    np.minimum.at(first, group, owner[order])
    place = np.empty(len(starts), dtype=np.int64)
    place[order] = group
    return keys, first, place, owner


def _second_runs(block: int, window: int, bits: int):
    def kernel(chunk: C.Chunk, answers: dict[int, bytes], _side):
        words = Words(chunk.data, chunk.offsets)
        at, probes = _probes(words, block)
        order, group, keys = C.distinct_sorted(probes)
        hit = C.answer_bits(answers, C.split_sorted(keys, BLOCK_BITS, bits), len(keys)) | (np.bincount(group, minlength=len(keys)) > 1)
        n = len(words.hashes)
        hits = np.zeros(n + 1, dtype=np.int64)
        hits[at[order[hit[group]]] + 1] = 1
        hits = np.cumsum(hits)
        room = words.room(window)
        starts = np.flatnonzero(room)
        starts = starts[hits[starts + window - block + 1] > hits[starts]]
        mask = np.zeros(n, dtype=bool)
        mask[starts] = True
        side = C.squeeze(np.packbits(mask).tobytes())
        keys, first, _, _ = _local(chunk, words, starts, window)
        for bucket, a, b in C.split_sorted(keys[:, 0], 64, bits):
            yield bucket, C.pack_arrays(*C.code_pairs(keys[a:b]), first[a:b]), side
            side = None
        if side is not None:
            yield 0, None, side

    return kernel


def _repeats(runs: list[bytes]) -> list[bytes]:
    """A key repeats if another chunk has it in a document with a smaller id."""
    keys, docs, sizes = [], [], []
    for run in runs:
        *coded, doc = C.unpack_arrays(run)
        keys.append(C.decode_pairs(*coded))
        docs.append(doc)
        sizes.append(len(doc))
    order, group, distinct = C.distinct_pairs(np.concatenate(keys))
    doc = np.concatenate(docs)[order]
    least = np.full(len(distinct), C.NULL_ID, dtype=np.int64)
    np.minimum.at(least, group, doc)
    out = np.zeros(len(order), dtype=bool)
    out[order] = doc > least[group]
    return C.bitmaps(out, sizes)


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each followed by a space, and the offset of each word in that."""
    sizes = ends - starts + 1
    places = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(places[-1]) + np.repeat(starts - places[:-1], sizes)
    source[places[1:] - 1] = 0
    out = data[source] if len(data) else np.zeros(0, dtype=np.uint8)
    out[places[1:] - 1] = 32
    return out.tobytes(), places


def _finish(window: int, bits: int, with_text: bool):
    def kernel(chunk: C.Chunk, answers: dict[int, bytes], side: bytes) -> pd.DataFrame:
        words = Words(chunk.data, chunk.offsets)
        n = len(words.hashes)
        starts = np.flatnonzero(np.unpackbits(np.frombuffer(C.expand(side), dtype=np.uint8), count=n))
        keys, first, place, owner = _local(chunk, words, starts, window)
        repeated = C.answer_bits(answers, C.split_sorted(keys[:, 0], 64, bits), len(keys))[place] | (owner > first[place])
        cover = np.zeros(n + window + 1, dtype=np.int64)
        cover[starts[repeated]] += 1
        cover[starts[repeated] + window] -= 1
        kept = np.cumsum(cover)[:n] == 0
        text, places = join_words(chunk.data, words.starts[kept], words.ends[kept])
        kept_bounds = np.concatenate([[0], np.cumsum(kept)])[words.bounds]
        slices = [text[places[a] : max(places[a], places[b] - 1)] for a, b in zip(kept_bounds[:-1], kept_bounds[1:], strict=True)]
        return pd.DataFrame(
            {
                "doc_id": chunk.given_ids(),
                "n_words": words.counts,
                "n_removed": words.counts - np.diff(kept_bounds),
                "kept_text": [x.decode("utf-8", "replace") for x in slices] if with_text else pd.Series([None] * len(chunk), dtype=object),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in slices],
            }
        )

    return kernel


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int = 7, with_text: bool = True, chunk_bytes: int = C.CHUNK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Drop each word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_text (null unless ``with_text``) and kept_sha256, a row
    for each row of ``docs``. Null text counts as no words; a null id sorts after all others and null
    ids are equal; rows that share an id do not remove words from one another. Of other columns
    only those of ``carry`` are read; they follow as one column ``row``. An empty table gives an empty result. ``docs`` must read alike each time:
    a table, a file scan or a checkpoint.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole reference block: window >= 2 * block - 1")
    bits = C.bucket_bits(docs.sparkSession)
    packed = C.pack(docs, id_col, text_col, chunk_bytes, carry)
    hits = C.answer(packed.mapInArrow(C.each_chunk(_first_runs(block, bits)), C.RUN_SCHEMA), _candidates)
    found = C.answer(C.meet_runs(packed, hits, _second_runs(block, window, bits)), _repeats)
    return C.meet(packed, found, _finish(window, bits, with_text), C.row_schema(docs, SCHEMA, carry))
