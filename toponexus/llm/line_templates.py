"""Line dedup by a log-template tree.

A line's path in the tree is its token count, then its leading tokens to a fixed depth. Tokens that
carry a digit or an ``@`` are variable fields and stand as one wildcard, in the path as below it.
A leaf generalises the other positions: one where its lines have more than ``variety`` distinct
tokens is a variable field as well. A line's template has wildcards there, as long as a share ``fixed`` of its
tokens is left; a line with less than that in common with its leaf stands for itself.
What a leaf counts does not depend on the order of lines, and takes three exchanges:

1. Each chunk sends the hash of each leaf with the number of its documents. Leaves of fewer than
   ``min_docs`` documents can hold no recurring line and drop out, with nearly all lines.
2. For the leaves left, each chunk sends the distinct tokens of each position, one more than
   ``variety`` at most, since more can't change the answer; the union of what the chunks send decides.
3. Each chunk sends the templates of the lines left, with the number of their documents and the least id.
   A template met in ``min_docs`` documents or more is recurring, and its lines are dropped from
   all documents but the one with the least id.

Hashes only choose leaves; leaves and templates are told apart by 128-bit digests of their tokens.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from toponexus.llm import chunks as C
from toponexus.llm.hashing import Words, byte_sums, digests, mix, prefix_sums, range_hashes

SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
WILDCARD = b"<*>"
_VARIABLE_BYTES = b"0123456789@"
_VARIABLE = np.zeros(256, dtype=bool)
_VARIABLE[list(_VARIABLE_BYTES)] = True


class Lines:
    """The lines of a chunk: spans, and the document of each."""

    def __init__(self, chunk: C.Chunk):
        data, offsets = chunk.data, chunk.offsets
        newline = data == 10
        # a document has a line more than it has newlines
        per_doc = np.diff(np.concatenate([[0], np.cumsum(newline)])[offsets]) + 1
        self.doc = np.repeat(np.arange(len(chunk)), per_doc)
        self.first = np.concatenate([[0], np.cumsum(per_doc)])
        is_first = np.zeros(self.first[-1], dtype=bool)
        is_first[self.first[:-1]] = True
        self.starts = np.empty(self.first[-1], dtype=np.int64)
        self.starts[is_first] = offsets[:-1]
        self.starts[~is_first] = np.flatnonzero(newline) + 1
        self.ends = np.empty_like(self.starts)
        self.ends[:-1] = self.starts[1:] - 1
        self.ends[self.first[1:] - 1] = offsets[1:]

    def leaf_hashes(self, data: np.ndarray, depth: int, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """The lines of ``min_tokens`` tokens or more, and a hash of each one's leaf; equal leaves have equal hashes."""
        words = Words(data, np.concatenate([self.starts, [len(data)]]))
        variable = np.concatenate([[0], np.cumsum(_VARIABLE[data])])
        mask = np.frombuffer(WILDCARD, dtype=np.uint8)
        wildcard = range_hashes(byte_sums(mask), np.array([0]), np.array([len(mask)]), "bytes")[0]
        tokens = np.where(variable[words.ends] > variable[words.starts], wildcard, words.hashes)
        low, high = words.bounds[:-1], words.bounds[1:]
        some = np.flatnonzero(high - low >= min_tokens)
        low, high = low[some], high[some]
        path = range_hashes(prefix_sums(tokens, "words"), low, np.minimum(low + depth, high), "words")
        return some, mix(path ^ mix((high - low).astype(np.uint64)))


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line, those with a digit or ``@`` as the wildcard."""
    return [WILDCARD if len(token.translate(None, _VARIABLE_BYTES)) < len(token) else token for token in line.split()]


def _documents(group: np.ndarray, doc: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` groups of lines, the number of documents and their least id."""
    least = np.full(n, C.NULL_ID, dtype=np.int64)
    np.minimum.at(least, group, ids[doc])
    pairs = np.unique(np.stack([group, doc], axis=1), axis=0) if len(doc) else np.zeros((0, 2), dtype=np.int64)
    return np.bincount(pairs[:, 0], minlength=n), least


def _leaf_runs(depth: int, min_tokens: int, bits: int):
    def kernel(chunk: C.Chunk):
        lines = Lines(chunk)
        some, hashes = lines.leaf_hashes(chunk.data, depth, min_tokens)
        order, group, keys = C.distinct_sorted(hashes)
        counts, _ = _documents(group, lines.doc[some[order]], chunk.ids, len(keys))
        place = np.empty(len(some), dtype=np.int32)
        place[order] = group
        pieces = C.split_sorted(keys, 64, bits)
        side = C.pack_arrays(some.astype(np.int32), place, np.array(pieces, dtype=np.int64).ravel())
        for bucket, a, b in pieces:
            yield bucket, C.pack_arrays(*C.code_sorted(keys[a:b]), counts[a:b]), side
            side = None
        if side is not None:
            yield 0, None, side

    return kernel


def _busy(min_docs: int):
    """Leaves of ``min_docs`` documents or more."""

    def reduce(runs: list[bytes]) -> list[bytes]:
        parts = [C.unpack_arrays(run) for run in runs]
        order, group, _ = C.distinct_sorted(np.concatenate([C.decode_sorted(p[0], p[1]) for p in parts]))
        docs = np.bincount(group, weights=np.concatenate([p[2] for p in parts])[order])
        out = np.zeros(len(order), dtype=bool)
        out[order] = docs[group] >= min_docs
        return C.bitmaps(out, [len(p[2]) for p in parts])

    return reduce


class Leaves:
    """The distinct lines of some leaves, and the distinct tokens of each leaf's positions below its path."""

    def __init__(self, chunk: C.Chunk, lines: Lines, some: np.ndarray, depth: int, variety: int):
        text = chunk.data.tobytes()
        number: dict[bytes, int] = {}
        #: Of each line of ``some``, the number of its distinct text.
        self.text_of = np.array([number.setdefault(text[a:b], len(number)) for a, b in zip(lines.starts[some].tolist(), lines.ends[some].tolist(), strict=True)], dtype=np.int64)
        self.tokens = [masked(line) for line in number]
        self.depth = depth
        leaves: dict[tuple, int] = {}
        self.leaf_of = [leaves.setdefault((len(t), *t[:depth]), len(leaves)) for t in self.tokens]
        self.counts = [key[0] for key in leaves]
        names = [b"%d " % key[0] + b" ".join(key[1:]) for key in leaves]
        found: list[list[dict[bytes, None]]] = [[{} for _ in range(max(0, n - depth))] for n in self.counts]
        for leaf, tokens in zip(self.leaf_of, self.tokens, strict=True):
            for held, token in zip(found[leaf], tokens[depth:], strict=True):
                if len(held) <= variety:
                    held[token] = None
        #: Of each token sent: its leaf and position, and digests of these and of the token.
        rows = [(leaf, i, token) for leaf, places in enumerate(found) for i, held in enumerate(places) for token in held]
        places = [(leaf, i) for leaf, held in enumerate(found) for i in range(len(held))]
        at = {place: n for n, place in enumerate(places)}
        self.places = np.array(places, dtype=np.int64).reshape(-1, 2)
        keys = digests(names[leaf] + b" %d" % i for leaf, i in places)
        self.place_of = np.array([at[leaf, i] for leaf, i, _ in rows], dtype=np.int64)
        token_keys = digests(token for _, _, token in rows)[:, 0]
        self.keys = np.concatenate([keys[self.place_of], token_keys[:, None]], axis=1)
        self.order = np.lexsort((self.keys[:, 2], self.keys[:, 1], self.keys[:, 0]))

    def templates(self, variable: np.ndarray, fixed: float) -> np.ndarray:
        """A digest of each distinct text's template, given which of ``places`` are variable."""
        wild: dict[int, list[int]] = {}
        for leaf, i in self.places[variable].tolist():
            wild.setdefault(leaf, []).append(self.depth + i)
        out = []
        for leaf, tokens in zip(self.leaf_of, self.tokens, strict=True):
            if leaf in wild:
                general = tokens.copy()
                for i in wild[leaf]:
                    general[i] = WILDCARD
                if len(general) - general.count(WILDCARD) >= fixed * len(general):
                    tokens = general
            out.append(b" ".join(tokens))
        return digests(out)


def _pieces(flat: np.ndarray) -> list[tuple[int, int, int]]:
    return [(bucket, a, b) for bucket, a, b in flat.reshape(-1, 3).tolist()]


def _token_runs(depth: int, variety: int, bits: int):
    def kernel(chunk: C.Chunk, answers: dict[int, bytes], side: bytes):
        some, place, flat = C.unpack_arrays(side)
        busy = C.answer_bits(answers, _pieces(flat), int(flat[-1]) if len(flat) else 0)
        some = some[busy[place]].astype(np.int64)
        leaves = Leaves(chunk, Lines(chunk), some, depth, variety)
        keys = leaves.keys[leaves.order]
        side = C.pack_arrays(some.astype(np.int32))
        for bucket, a, b in C.split_sorted(keys[:, 0], 64, bits):
            yield bucket, C.pack_arrays(*C.code_pairs(keys[a:b, :2]), keys[a:b, 2]), side
            side = None
        if side is not None:
            yield 0, None, side

    return kernel


def _varied(variety: int):
    """Positions with more than ``variety`` distinct tokens."""

    def reduce(runs: list[bytes]) -> list[bytes]:
        parts = [C.unpack_arrays(run) for run in runs]
        places, tokens = np.concatenate([C.decode_pairs(*p[:3]) for p in parts]), np.concatenate([p[3] for p in parts])
        order = np.lexsort((tokens, places[:, 1], places[:, 0]))
        places, tokens = places[order], tokens[order]
        new_place = np.ones(len(order), dtype=bool)
        new_place[1:] = (places[1:] != places[:-1]).any(axis=1)
        new = new_place.copy()
        new[1:] |= tokens[1:] != tokens[:-1]
        group = np.cumsum(new_place) - 1
        out = np.zeros(len(order), dtype=bool)
        out[order] = (np.bincount(group, weights=new) > variety)[group]
        return C.bitmaps(out, [len(p[3]) for p in parts])

    return reduce


def _template_runs(depth: int, variety: int, fixed: float, bits: int):
    def kernel(chunk: C.Chunk, answers: dict[int, bytes], side: bytes):
        some = C.unpack_arrays(side)[0].astype(np.int64)
        lines = Lines(chunk)
        leaves = Leaves(chunk, lines, some, depth, variety)
        flags = C.answer_bits(answers, C.split_sorted(leaves.keys[leaves.order][:, 0], 64, bits), len(leaves.keys))
        variable = np.zeros(len(leaves.places), dtype=bool)
        variable[leaves.place_of[leaves.order[flags]]] = True
        order, group, keys = C.distinct_pairs(leaves.templates(variable, fixed)[leaves.text_of])
        counts, least = _documents(group, lines.doc[some[order]], chunk.ids, len(keys))
        place = np.empty(len(some), dtype=np.int32)
        place[order] = group
        pieces = C.split_sorted(keys[:, 0], 64, bits)
        side = C.pack_arrays(some.astype(np.int32), place, least, np.array(pieces, dtype=np.int64).ravel())
        for bucket, a, b in pieces:
            yield bucket, C.pack_arrays(*C.code_pairs(keys[a:b]), counts[a:b], least[a:b]), side
            side = None
        if side is not None:
            yield 0, None, side

    return kernel


def _recurring(min_docs: int):
    """Two flags a template: whether it recurs, and whether its least document is the first of all."""

    def reduce(runs: list[bytes]) -> list[bytes]:
        parts = [C.unpack_arrays(run) for run in runs]
        order, group, keys = C.distinct_pairs(np.concatenate([C.decode_pairs(*p[:3]) for p in parts]))
        least_here = np.concatenate([p[4] for p in parts])[order]
        docs = np.bincount(group, weights=np.concatenate([p[3] for p in parts])[order])
        least = np.full(len(keys), C.NULL_ID, dtype=np.int64)
        np.minimum.at(least, group, least_here)
        recurring, first = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
        recurring[order] = docs[group] >= min_docs
        first[order] = least_here == least[group]
        return C.bitmaps(np.stack([recurring, first], axis=1).ravel(), [2 * len(p[3]) for p in parts])

    return reduce


def _finish(with_text: bool):
    def kernel(chunk: C.Chunk, answers: dict[int, bytes], side: bytes) -> pd.DataFrame:
        some, place, least, flat = C.unpack_arrays(side)
        lines = Lines(chunk)
        flags = C.answer_bits(answers, [(bucket, 2 * a, 2 * b) for bucket, a, b in _pieces(flat)], 2 * len(least)).reshape(-1, 2)
        owner = chunk.ids[lines.doc[some]]
        gone = np.zeros(len(lines.starts), dtype=bool)
        gone[some] = flags[place, 0] & ~(flags[place, 1] & (owner == least[place]))
        dropped = np.diff(np.concatenate([[0], np.cumsum(gone)])[lines.first])
        text = chunk.data.tobytes()
        offsets = chunk.offsets.tolist()
        kept = []
        for i in range(len(chunk)):
            if not dropped[i]:
                kept.append(text[offsets[i] : offsets[i + 1]])
            else:
                stay = np.flatnonzero(~gone[lines.first[i] : lines.first[i + 1]]) + lines.first[i]
                kept.append(b"\n".join(text[a:b] for a, b in zip(lines.starts[stay].tolist(), lines.ends[stay].tolist(), strict=True)))
        return pd.DataFrame(
            {
                "doc_id": chunk.given_ids(),
                "n_lines": np.diff(lines.first),
                "n_dropped": dropped,
                "kept_text": [x.decode() for x in kept] if with_text else pd.Series([None] * len(chunk), dtype=object),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
            }
        )

    return kernel


def drop_recurring(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_tokens: int = 3,
    depth: int = 3,
    variety: int = 5,
    fixed: float = 0.5,
    with_text: bool = True,
    chunk_bytes: int = C.CHUNK_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Drop lines whose template recurs in ``min_docs`` documents or more, save in the document with the least id.

    Returns doc_id, n_lines, n_dropped, kept_text (the lines left, joined by newlines; null unless
    ``with_text``) and kept_sha256, a row for each row of ``docs``. Lines are parted by newlines,
    tokens by the six ASCII spaces; lines of fewer than ``min_tokens`` tokens stay. Null text counts
    as one empty line. A null id sorts after all others; rows that share an id count as so many
    documents and keep their lines alike. An empty table gives an empty result. Of other columns
    only those of ``carry`` are read; they follow as one column ``row``. ``docs`` must read alike each time: a table, a file scan or a checkpoint.
    """
    bits = C.bucket_bits(docs.sparkSession)
    packed = C.pack(docs, id_col, text_col, chunk_bytes, carry)
    busy = C.answer(packed.mapInArrow(C.each_chunk(_leaf_runs(depth, min_tokens, bits)), C.RUN_SCHEMA), _busy(min_docs))
    varied = C.answer(C.meet_runs(packed, busy, _token_runs(depth, variety, bits)), _varied(variety))
    found = C.answer(C.meet_runs(packed, varied, _template_runs(depth, variety, fixed, bits)), _recurring(min_docs))
    return C.meet(packed, found, _finish(with_text), C.row_schema(docs, SCHEMA, carry))
