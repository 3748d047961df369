"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance
of two embeddings is at most the Hamming distance of their fingerprints, so links lie within
Manhattan distance 3. The 32 counts are cut into 6 bands; at distance 3 or less at least 3 bands are
equal, so each fingerprint falls into 20 grid cells (a choice of 3 bands and their counts) and every
link meets in one of them. Inside a cell the Manhattan distance prunes, the Hamming distance
decides, and only a spanning forest of the links leaves the cell.

Rows with equal fingerprints count once. Cells of up to ``CELL`` fingerprints compare them in memory; where a
cell would hold more, its fingerprints are linked exactly through *balls* instead of pairs: two
fingerprints are within 3 bits exactly if some word is within 1 bit of one and 2 bits of the other,
which takes a fixed number of rows for each fingerprint, whatever the size of the group.

``near_duplicates`` links by fingerprints alone; ``similar`` checks the sets of shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponexus.llm import components, near_copies
from toponexus.llm.chunks import give_back
from toponexus.llm.shingles import prints_of, shingle_hashes, text_blocks
from toponexus.llm.storage import keep, small_batches

BANDS, EQUAL_BANDS, RADIUS = 6, 3, 3
#: Fingerprints that a cell compares among themselves; larger cells go through balls.
CELL = 4096
#: Cells that are compared together, all cells of a batch at once.
SMALL_CELL = 32
#: First bit and number of bits of each band: whole two-bit segments.
BAND_BITS = [(0, 10), (10, 10), (20, 10), (30, 10), (40, 12), (52, 12)]
CHOICES = list(combinations(range(BANDS), EQUAL_BANDS))
_PAIRS = np.uint64(0x5555555555555555)


def fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """The SimHash of each text."""
    return prints_of(*shingle_hashes(texts, words))


def _fingerprint_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=np.uint64)
            for a, b, texts in text_blocks(batch, 1):
                out[a:b] = fingerprints(texts, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])
        give_back()

    return run


def embed(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in unary (00, 01, 11), so that differing bits count the difference."""
    shifted = prints >> np.uint64(1)
    return ((prints | shifted) & _PAIRS) | (((prints & shifted) & _PAIRS) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings; never more than the Hamming distance of what they embed."""
    return np.bitwise_count(a ^ b)


def cells(prints: np.ndarray) -> np.ndarray:
    """The cell keys of each fingerprint, a column per choice of bands; equal keys of unequal cells are harmless."""
    counts = embed(prints)
    bands = [(counts >> np.uint64(first)) & np.uint64((1 << size) - 1) for first, size in BAND_BITS]
    out = np.empty((len(prints), len(CHOICES)), dtype=np.int64)
    for j, (a, b, c) in enumerate(CHOICES):
        key = ((bands[a] << np.uint64(24)) | (bands[b] << np.uint64(12)) | bands[c]) * np.uint64(32) + np.uint64(j)
        out[:, j] = key.view(np.int64)
    return out


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1 << 14):
            prints = np.asarray(batch.column(0).slice(a, 1 << 14))
            keys = cells(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(prints, len(CHOICES)))], ["cell", "fp"])


def _near(prints: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those within the radius: by Manhattan distance, then exactly."""
    close = manhattan(counts[i], counts[j]) <= RADIUS
    i, j = i[close], j[close]
    close = np.bitwise_count(prints[i] ^ prints[j]) <= RADIUS
    return i[close], j[close]


def _links_in(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """A spanning forest of the links within the cells of sorted keys, as pairs of signed fingerprints."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edge)
    counts = embed(prints)
    found = []
    size_at = np.repeat(sizes, sizes)
    place = np.arange(len(keys)) - np.repeat(edge[:-1], sizes)
    small = size_at <= SMALL_CELL
    for step in range(1, min(SMALL_CELL, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small & (place + step < size_at))
        if not len(i):
            break
        found.append(np.stack(_near(prints, counts, i, i + step), axis=1))
    for a, b in zip(edge[:-1][sizes > SMALL_CELL].tolist(), edge[1:][sizes > SMALL_CELL].tolist(), strict=True):
        for x in range(a, b, 256):
            i, j = np.meshgrid(np.arange(x, min(x + 256, b)), np.arange(x, b), indexing="ij")
            later = j > i
            pairs = np.stack(_near(prints, counts, i[later], j[later]), axis=1)
            found.append(components.spanning_pairs(pairs))
    if not found:
        return np.zeros((0, 2), dtype=np.int64)
    pairs = np.concatenate(found)
    return components.spanning_pairs(prints.view(np.int64)[pairs])


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, fp) that come sorted, a cell of at most ``CELL`` rows never split between results."""
    held_keys, held_prints = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def result(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        kept = _links_in(keys, prints)
        return pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_keys, np.asarray(batch.column(0))])
        prints = np.concatenate([held_prints, np.asarray(batch.column(1)).view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        if cut:
            yield result(keys[:cut], prints[:cut])
        held_keys, held_prints = keys[cut:], prints[cut:]
    if len(held_keys):
        yield result(held_keys, held_prints)


def _masks(weight: int) -> np.ndarray:
    return np.array([sum(1 << x for x in bits) for w in range(weight + 1) for bits in combinations(range(64), w)], dtype=np.uint64)


def _ball_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(centre, fp, whether within 1 bit) for every word within 2 bits of a fingerprint."""
    masks = _masks(2)
    inner = np.bitwise_count(masks) <= 1
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            prints = np.asarray(batch.column(0).slice(a, 64))
            centres = (prints.view(np.uint64)[:, None] ^ masks[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(centres), pa.array(np.repeat(prints, len(masks))), pa.array(np.tile(inner, len(prints)))], ["centre", "fp", "inner"])


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly what is within 3 bits among ``prints`` (column fp, distinct).

    Around each centre that has a fingerprint within 1 bit, all fingerprints within 2 bits are linked
    to the least of those within 1 bit; two fingerprints within 3 bits share such a centre, and any
    that meet at one are within 3 bits of that least one. Rows grow with the input only.
    """
    rows = prints.select("fp").mapInArrow(_ball_rows, "centre long, fp long, inner boolean")
    centres = rows.where("inner").groupBy("centre").agg(F.min("fp").alias("a"))
    return rows.join(centres, "centre").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose closure is the closure of all links within 3 bits.

    The list of large cells is computed first; mostly there is none, and then the rows of cells are
    exchanged once and joined with nothing.
    """
    rows = prints.mapInArrow(_cell_rows, "cell long, fp long")
    large = keep(rows.groupBy("cell").count().where(F.col("count") > CELL).select("cell"))
    some = not large.isEmpty()
    few = rows.join(large, "cell", "left_anti") if some else rows
    found = few.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_cell_links, "a long, b long")
    if not some:
        return found.distinct()
    return found.union(ball_links(rows.join(large, "cell", "left_semi").select("fp").distinct())).distinct()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint's bits in a signed long; null text has no words."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_rows(words), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Components of documents whose fingerprints link at 3 or fewer differing bits.

    Returns doc_id, fingerprint (16 lowercase hex digits), component_id (the least id reachable,
    itself included) and class_size (rows with the same fingerprint). Null and empty text has
    fingerprint zero. A null id is kept; it never is a component's id unless all its ids are null.
    Repeated rows stay. An empty table gives an empty result. Other columns are not read.
    """
    marked = keep(fingerprint(docs, id_col, text_col, words))
    classes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("class_size")))
    found = components.connected(keep(links(classes.select("fp"))))
    named = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id", "class_size")
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """Rows (doc_id, component_id): components of documents linked at a Jaccard similarity of ``least`` or more.

    The operator with an exact check by sets of shingles: the grid proposes what lies within 3 bits. More
    similar sets than those can lie further apart, up to a dozen bits, where the grid has no cells that are both few and
    small; minhash bands propose them. See ``near_copies`` for nulls, repeats and empty tables.
    """
    return near_copies.near_copies(docs, id_col, text_col, words, least, links)
