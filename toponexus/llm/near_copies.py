"""Near copies by the Jaccard similarity of their sets of five-word shingles.

SimHash links (operator 5) propose pairs, and so do minhashes: 32 bands of 5 minima each, so a pair at similarity 0.8 misses all bands with
a chance of 3 in a million, and a more similar pair with less. Every proposed pair is then decided by the sets themselves.

Texts with equal sets count once. A band bucket of up to ``SMALL`` sets proposes all its pairs. In a larger one
all are first paired with its most central member, the one whose buckets are largest, which is nearest to what the
others were copied from. Members that the links found leave in different parts are then compared with one another in
blocks of about ``BLOCK``, by counts of their hashes in ``BINS`` bins: sets share no more than the sum of the lesser counts, so
a pair that cannot reach the similarity goes, and no other. No pair that shares a bucket is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponexus.llm import components
from toponexus.llm.chunks import give_back
from toponexus.llm.hashing import mix
from toponexus.llm.shingles import prints_of, shingle_hashes, text_blocks
from toponexus.llm.storage import keep, small_batches

WORDS, LEAST = 5, 0.8
BANDS, MINIMA = 32, 5
#: Sets of a band bucket that are all paired at once.
SMALL = 32
#: Bins of hashes that a set is told apart by, and members of a larger bucket that a task compares with as many.
BINS, BLOCK = 256, 512
#: Bits for each id that texts are looked up by, and the most bits of a filter; beyond 4 million ids it lets more texts by.
ID_BITS, MOST_BITS = 16, 1 << 26
_FACTORS = mix(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mix(np.arange(1 << 20, (1 << 20) + BANDS * MINIMA, dtype=np.uint64))


def sets_of(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted, end to end, and their bounds."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(len(sizes) + 1))


def set_keys(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set."""
    raw, places = values.tobytes(), (8 * bounds).tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(places[:-1], places[1:], strict=True)]


def band_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` bucket keys for each set that is not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), BANDS), dtype=np.uint64)
    moved = np.empty_like(values)
    for band in range(BANDS):
        key = np.full(len(starts), band, dtype=np.uint64)
        for i in range(band * MINIMA, (band + 1) * MINIMA):
            np.add(values, _TERMS[i], out=moved)
            moved ^= moved >> np.uint64(31)
            moved *= _FACTORS[i]
            key = mix(key ^ np.minimum.reduceat(moved, starts)) if len(starts) else key
        out[:, band] = key
    return out


def _mark(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch, 1):
                values, counts = shingle_hashes(texts, words)
                prints = prints_of(values, counts)
                values, bounds = sets_of(values, counts)
                sizes = np.diff(bounds)
                held = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(held), pa.array(band_keys(values, bounds).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(set_keys(values, bounds), pa.binary()), pa.array(sizes), pa.array(prints.view(np.int64)), bands], ["doc_id", "key", "n", "fp", "bands"]
                )
        give_back()

    return run


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bytes of a filter with two bits set for each row of ``ids`` (column id, a hash): whoever is in it has both."""
    size = 64
    while size < min(ID_BITS * ids.count(), MOST_BITS):
        size *= 2
    two = F.array(*(c.bitwiseAND(F.lit(size - 1).cast("long")) for c in (F.col("id"), F.shiftright("id", 32))))
    words = ids.select(F.explode(two).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype="<u8")
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def in_filter(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each of the hashes may be in the filter."""
    bit = lambda place: (held[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1)
    return (bit(ids & (8 * len(held) - 1)) & bit((ids >> 32) & (8 * len(held) - 1))).astype(bool)


def _sets(words: int, held: np.ndarray):
    """Of rows (id, text), the sets of those in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(held, batch.column(0).to_numpy())))
            for _, _, texts in text_blocks(batch, 1):
                values, bounds = sets_of(*shingle_hashes(texts, words))
                raw = [values[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, bounds), pa.binary()), pa.array(raw, pa.binary())], ["key", "shingles"])
        give_back()

    return run


def _decide(least: float):
    """Of the pairs (a, b) with both their sets, those of at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            close = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(side[i].as_buffer(), dtype=np.uint64) for side in (left, right))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                close[i] = common >= least * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(close)) for j in (0, 1)], ["a", "b"])
        give_back()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets (key, shingles), the counts of hashes in each bin, 255 standing for that or more."""
    for batch in batches:
        out = []
        for one in batch.column(1):
            bins = mix(np.frombuffer(one.as_buffer(), dtype=np.uint64)) % np.uint64(BINS)
            out.append(np.minimum(np.bincount(bins.astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "counts"])


def _apart(least: float):
    """Pairs of two blocks (low, high) of a bucket, in different parts, whose counts allow the similarity."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own, low, high, n = (rows[c].to_numpy() for c in ("own", "low", "high", "n"))
        root = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), dtype=np.uint8).reshape(len(n), BINS)
        more = (counts == 255).any(axis=1)
        first = np.flatnonzero(own == low)
        second = np.flatnonzero(own == high)
        found: list[tuple[int, int]] = []
        for i in first.tolist():
            others = second[(root[second] != root[i]) & ((own[second] != own[i]) | (second > i))]
            both = n[others] + n[i]
            most = np.minimum(n[others], n[i])
            common = np.minimum(counts[others], counts[i]).sum(axis=1, dtype=np.int64)
            common = np.where(more[others] | more[i], most, np.minimum(common, most))
            found += [(i, j) for j in others[common + 1e-9 >= least * (both - common)].tolist()]
        keys = rows["key"].to_pylist()
        pairs = [sorted((keys[i], keys[j])) for i, j in found]
        return pa.table([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], names=["a", "b"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, grid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (doc_id, component_id): components of documents linked at a similarity of ``least`` or more.

    ``grid`` proposes links (a, b) between distinct SimHash fingerprints (column fp); bands propose the rest.
    ``component_id`` is the least id reachable, itself included. Null text and text without a word
    have the empty set, which is like itself only. A null id is kept; it never is a component's id unless all its
    ids are null. Repeated rows stay. An empty table gives an empty result. ``docs`` must read alike each
    time: a table, a file scan or a checkpoint. The bands are chosen for ``LEAST`` and above.
    """
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = keep(texts.mapInArrow(_mark(words), "doc_id long, key binary, n long, fp long, bands array<long>"))
    classes = keep(marked.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    rows = classes.select("key", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = keep(rows.join(shared, "band"))
    # sizes apart by more than that cannot be so similar
    sizes = F.least("n", "m") >= least * F.greatest("n", "m")
    other = met.select("band", F.col("key").alias("b"), F.col("n").alias("m"))
    small = met.where(F.col("held") <= SMALL).join(other, "band").where(F.col("key") < F.col("b")).where(sizes).select(F.col("key").alias("a"), "b")
    large = met.where(F.col("held") > SMALL)
    large = keep(large.join(met.groupBy("key").agg(F.sum("held").alias("weight")), "key").select("band", "key", "n", "weight"))

    def paired(members: DataFrame, among: DataFrame) -> DataFrame:
        """Pairs (a, b) of members (band, key, n, root) with the most central of ``among`` where their parts differ."""
        chosen = F.max_by(F.struct("key", "n", "root"), F.struct("weight", "key")).alias("first")
        together = members.join(among.groupBy("band").agg(chosen), "band").withColumn("m", F.col("first.n"))
        return together.where("root <> first.root").where(sizes).select(F.least("first.key", "key").alias("a"), F.greatest("first.key", "key").alias("b")).distinct()

    alone = large.withColumn("root", F.col("key"))
    star = paired(alone, alone)
    proposed = small.union(star)
    if grid:
        # sets of one fingerprint with their least, and the least of linked fingerprints
        leads = classes.where("n > 0").groupBy("fp").agg(F.min("key").alias("lead"))
        alike = classes.where("n > 0").join(leads, "fp").select(F.col("lead").alias("a"), F.col("key").alias("b"))
        near = grid(leads.select("fp")).join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
        proposed = proposed.union(alike.where("a <> b")).union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    proposed = keep(proposed.distinct())

    def sets_for(wanted: DataFrame) -> DataFrame:
        """Rows (key, shingles) for keys."""
        wanted = keep(classes.join(wanted, "key", "left_semi").select("key", "least_id"))
        # one document of a set gives it. Texts are not exchanged: a filter picks them where they are read, and what it lets by besides has another key.
        held = id_filter(wanted.select(F.xxhash64("least_id").alias("id")))
        sets = texts.select(F.xxhash64("doc_id").alias("id"), "text").mapInArrow(_sets(words, held), "key binary, shingles binary")
        return sets.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))

    def decided(pairs: DataFrame) -> DataFrame:
        sets = keep(sets_for(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()))
        left, right = (sets.select(F.col("key").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        return keep(pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_decide(least), "a binary, b binary"))

    links = decided(proposed)
    found = components.connected(links)
    placed = large.join(found.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    parts = placed.groupBy("band").agg(F.min("root").alias("least_root"), F.max("root").alias("most_root")).where("least_root <> most_root").select("band")
    placed = keep(placed.join(parts, "band").select("band", "key", "n", "root"))
    if not placed.isEmpty():
        # sets of one class of sizes, or of two neighbouring ones, can be so similar
        placed = placed.withColumn("size", F.floor(F.log("n") / (-math.log(least) * (1 + 1e-9))))
        dealt = placed.groupBy("band", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        code = lambda size, block: size * (1 << 32) + block
        own = placed.join(dealt, ["band", "size"]).withColumn("own", code(F.col("size"), F.pmod(F.xxhash64("key"), "blocks")))
        own = own.join(keep(sets_for(placed.select("key").distinct()).mapInArrow(_counts, "key binary, counts binary")), "key")
        blocks = dealt.select("band", F.col("size").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        near = blocks.select("band", F.explode(F.array(F.col("of") - 1, "of", F.col("of") + 1)).alias("size"), code(F.col("of"), F.col("block")).alias("other"))
        met = own.join(near, ["band", "size"]).select("band", "key", "n", "root", "counts", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        pairs = keep(met.groupBy("band", "low", "high").applyInArrow(_apart(least), "a binary, b binary").distinct().join(proposed, ["a", "b"], "left_anti"))
        more = decided(pairs)
        if not more.isEmpty():
            found = components.connected(links.union(more))
    named = classes.select("key", "least_id").join(found.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    component = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.select("doc_id", "key").join(named.join(component, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
