"""Word shingles of texts, their XXH64 hashes and SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from toponexus.llm.chunks import column_bytes

SEED = 42


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of each text, repeats included, end to end, and the number of each text's.

    A-Z count as a-z, and the six ASCII spaces part words. A text of fewer words is one shingle, one
    without a word has none.
    """
    hashes: list[int] = []
    sizes = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        parts = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
        n = len(parts)
        if n <= words:
            sizes.append(1 if n else 0)
            if n:
                hashes.append(digest(b" ".join(parts), SEED))
            continue
        sizes.append(n - words + 1)
        line = b" ".join(parts)
        ends = np.cumsum([len(x) + 1 for x in parts])
        firsts = [0, *ends[: n - words].tolist()]
        hashes += [digest(line[a:b], SEED) for a, b in zip(firsts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def prints_of(values: np.ndarray, sizes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The SimHash of each text from its shingles' hashes: a bit is 1 if set in over half of them."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    at = 0
    for i, size in enumerate(sizes.tolist()):
        ones = np.zeros(64, dtype=np.int64)
        for a in range(at, at + size, block):
            part = values[a : min(a + block, at + size)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += size
        out[i] = np.packbits(2 * ones > size, bitorder="little").view("<u8")[0]
    return out


def text_blocks(batch: pa.RecordBatch, column: int, batch_bytes: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes]]]:
    """A batch's texts, some at a time: first row, end, texts. Null is empty."""
    data, offsets = column_bytes(batch.column(column))
    body = data.tobytes()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + batch_bytes, "right")) - 1)
        places = offsets[a : b + 1].tolist()
        yield a, b, [body[x:y] for x, y in zip(places[:-1], places[1:], strict=True)]
        a = b
