"""Concatenate-and-cut packing of documents into sequences of a fixed number of tokens.

Pass one turns each document into token ids with an end-of-document id, and gives it a running
start within its partition. The token table is written once to the shared folder, then the
partition totals, one row per partition, are summed to give every partition's global start. Pass
two cuts each document at multiples of the sequence length and emits one boundary record per piece;
it needs no exchange of tokens. Only the last sequence is not full.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from toponexus.llm import storage
from toponexus.llm.chunks import column_bytes, give_back
from toponexus.llm.hashing import Memo, spans_of_words

#: Words whose ids a worker keeps at once; beyond it those met seldom make room.
WORDS_KEPT = 450_000
#: Bytes that part words here; other white space stays inside a word and is the tokenizer's.
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[10, 32]] = True
#: The parts of a printable lower-case ASCII word without an apostrophe: letters, a digit, other signs.
_PLAIN = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+").findall
TOKENS_SCHEMA = "part int, doc_id long, local_start long, doc_tokens long, ids binary"
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordTokenizer:
    """Ids of whole texts by a tokenizer file, with the ids of each word looked up once.

    The file's splitting rules never join what white space parts, so a text's ids are those of its
    space- and newline-separated words in turn. Words are found by hashes, taken over all bytes of a
    batch at once, and told apart by their bytes; only words that are new to the worker are encoded.
    The rules also part letters from other signs: a word's plain parts are encoded many at once, and each ends in
    exactly one id whose piece closes a part.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.closes[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.known = Memo(WORDS_KEPT)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, dtype=np.uint32) for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts that the rules do not split."""
        out: list[np.ndarray] = []
        groups = [parts[a : a + 256] for a in range(0, len(parts), 256)]
        for group, ids in zip(groups, self._encode([" ".join(group) for group in groups]), strict=True):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                ends = ends.tolist()
                out += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._encode(group)
        return out

    def ids_of(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        parts: dict[str, int] = {}
        plan: list[list[int] | None] = []
        odd = []
        for word in words:
            low = word.lower()
            if low.isascii() and low.isprintable() and "'" not in low and "<|" not in low:
                plan.append([parts.setdefault(part, len(parts)) for part in ([low] if low.isalpha() else _PLAIN(low))])
            elif word.isalpha() and is_normalized("NFC", word):  # the tokenizer's own lower case may differ
                plan.append([parts.setdefault(word, len(parts))])
            elif word[:-1].isalpha() and word[-1] in ".," and is_normalized("NFC", word):
                plan.append([parts.setdefault(word[:-1], len(parts)), parts.setdefault(word[-1], len(parts))])
            else:
                plan.append(None)
                odd.append(word)
        found, others = self._parts(list(parts)), iter(self._encode(odd))
        none = np.zeros(0, dtype=np.uint32)
        return [next(others) if p is None else found[p[0]] if len(p) == 1 else np.concatenate([none, *(found[i] for i in p)]) for p in plan]

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as concatenated UTF-8, and each text's count."""
        starts, ends = spans_of_words(data, offsets, _BREAKS)
        body = data.tobytes()

        def work(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = self.ids_of([body[x:y].decode() for x, y in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            return np.array([len(x) for x in ids], dtype=np.int64), np.concatenate(ids), np.zeros(len(ids))

        rows = self.known.rows(data, starts, ends, work)
        sizes, ids = self.known.ids.take(rows)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core; threads would each keep memory of their own
    return WordTokenizer(path)


def _tokens(path: str, end_id: int, batch_bytes: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages left in this worker
        words, part, at = tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + batch_bytes, "right")) - 1)
                ids, counts = words.batch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sizes = counts + 1
                ends = np.cumsum(sizes)
                full = np.full(int(ends[-1]), end_id, dtype="<u4")
                inside = np.ones(len(full), dtype=bool)
                inside[ends - 1] = False
                full[inside] = ids
                starts = at + ends - sizes
                at += int(ends[-1])
                narrow = full.astype("<u2") if full.max() < 1 << 16 else full
                raw, cut = narrow.tobytes(), np.concatenate([[0], ends * narrow.itemsize])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, part, dtype=np.int32)),
                        batch.column(0).slice(a, b - a),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array([raw[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    ["part", "doc_id", "local_start", "doc_tokens", "ids"],
                )
                a = b
        give_back()

    return run


def tokenize(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows (part, doc_id, local_start, doc_tokens, ids): ids little-endian, 2 bytes each where doc_tokens * 2 is their size, else 4."""
    rows = storage.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_tokens(tokenizer_path, end_id), TOKENS_SCHEMA)


def _cut(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, sizes, raws = (batch.column(i) for i in range(4))
            rows = []
            for doc, start, size, raw in zip(docs.to_pylist(), starts.to_pylist(), sizes.to_pylist(), raws, strict=True):
                raw = raw.as_buffer()
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * size else "<u4").astype("<u4").tobytes()
                at = 0
                while at < size:
                    place = (start + at) % length
                    n = min(length - place, size - at)
                    piece = ids[4 * at : 4 * (at + n)]
                    rows.append((doc, at, n, zlib.crc32(piece), size, (start + at) // length, place, piece if with_ids else None))
                    at += n
            if rows:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pack every document, end id included, into sequences of ``length`` tokens without gaps.

    Returns a row per piece: doc_id, start (ids of the document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset in the sequence, and ids (little-endian 4-byte; null unless
    ``with_ids``). Null text counts as empty and gives the end id alone; null and repeated ids are
    packed like any other row. Only the last sequence is short, by less than ``length``. An empty
    table gives an empty result. Other columns are not read.
    """
    tokens = storage.table(tokenize(docs, id_col, text_col, tokenizer_path, end_id))
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # one row per partition of the input, not per document
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(before), "part")
    return placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "doc_tokens", "ids").mapInArrow(_cut(length, with_ids), PIECES_SCHEMA)
