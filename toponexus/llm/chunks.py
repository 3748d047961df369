"""Documents packed into compressed chunks, and exchanges of sorted hash runs between them.

``pack`` turns (id, text) rows into rows of about ``chunk_bytes`` of text each, so that kernels run
over large byte arrays and a shuffle moves compressed text once. An *exchange* sends, from each
chunk, one sorted and delta-coded run of keys per bucket; a bucket's reducer sees the runs of all
chunks together and answers each run with a bitmap (or another payload) in the run's own order.
Runs hold each key once per chunk, so a key that fills a third of the corpus reaches a reducer once
per chunk. Chunk names are digests of the ids they hold: if a lost executor's rows were read again
in another order, names would not meet and the job would fail rather than give wrong rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponexus.llm.storage import small_batches

CHUNK_BYTES = 2 << 20
#: Stands for a null id in sort order: after every other.
NULL_ID = np.iinfo(np.int64).max
CHUNK_SCHEMA = "chunk string, body binary, rest binary"
RUN_SCHEMA = "bucket int, chunk string, run binary, side binary"
ANSWER_SCHEMA = "chunk string, bucket int, answer binary, side binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, which compress well when high bytes are alike."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=n * size).reshape(size, n).T).view(dtype).reshape(n)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Several numpy arrays as one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.char)))], dtype=np.int64).tobytes()
    return squeeze(head + b"".join(planes(a) for a in arrays))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = expand(data)
    count = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    head = np.frombuffer(raw, dtype=np.int64, count=1 + 2 * count)[1:].reshape(count, 2)
    out, at = [], 8 * (1 + 2 * count)
    for n, kind in head.tolist():
        size = np.dtype(chr(kind)).itemsize * n
        out.append(unplanes(raw[at : at + size], chr(kind), n))
        at += size
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, body = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and the allocator keeps what kernels freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Chunk:
    """Ids (as given and as sort keys), offsets and bytes of the documents of one chunk."""

    def __init__(self, body: bytes):
        raw = expand(body)
        n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
        self.ids, self.lengths = np.frombuffer(raw, dtype=np.int64, count=2 * n, offset=8).reshape(2, n)
        self.known = np.frombuffer(raw, dtype=np.uint8, count=n, offset=8 + 16 * n).astype(bool)
        self.data = np.frombuffer(raw, dtype=np.uint8, offset=8 + 17 * n)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    def given_ids(self) -> pd.Series:
        return pd.Series(self.ids, dtype="Int64").mask(~self.known)


def _pack_rows(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rest: list[pa.RecordBatch] = []
        size = 0

        def release() -> pa.RecordBatch:
            ids, known, lengths, data = (np.concatenate(x) for x in zip(*held, strict=True))
            raw = np.int64(len(ids)).tobytes() + ids.tobytes() + lengths.tobytes() + known.tobytes() + data.tobytes()
            name = hashlib.blake2b(ids.tobytes() + lengths.tobytes() + hashlib.blake2b(data.tobytes()).digest() + place, digest_size=12).hexdigest()
            carried = squeeze(_to_ipc(rest)) if rest else None
            held.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([squeeze(raw)], pa.binary()), pa.array([carried], pa.binary())], ["chunk", "body", "rest"])

        # equal chunks of different partitions keep different names
        from pyspark import TaskContext

        count, part = 0, TaskContext.get().partitionId() if TaskContext.get() else 0
        place = b""
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid()).astype(np.uint8)
            keys = np.asarray(ids.fill_null(NULL_ID)).astype(np.int64)
            data, offsets = column_bytes(batch.column(1))
            at = 0
            while at < len(keys):
                # as many rows as still fit, one at least
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max(0, chunk_bytes - size), "right")) - 1)
                end = min(end, len(keys))
                held.append((keys[at:end], known[at:end], np.diff(offsets[at : end + 1]), data[offsets[at] : offsets[end]]))
                if batch.num_columns > 2:
                    rest.append(batch.select([2]).slice(at, end - at))
                size += int(offsets[end] - offsets[at]) + 64 * (end - at)
                at = end
                if size >= chunk_bytes:
                    place = f"{part}:{count}".encode()
                    count, size = count + 1, 0
                    yield release()
        if held:
            place = f"{part}:{count}".encode()
            yield release()
        give_back()

    return run


def _to_ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as stream:
        for batch in batches:
            stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Rows (chunk, body, rest) that hold all of ``docs``; shuffled once by chunk, so that later steps on chunks meet in place.

    ``rest`` holds the columns ``carry``, so that a result gets them without a join.
    """
    rows = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    if carry:
        rows.append(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"))
    packed = small_batches(docs).select(*rows).mapInArrow(_pack_rows(chunk_bytes), CHUNK_SCHEMA)
    return packed.repartition(partitions(docs.sparkSession), "chunk")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_bits(spark: SparkSession) -> int:
    """Buckets follow the session's shuffle partitions, the setting that is sized with the data."""
    return max(6, (4 * partitions(spark) - 1).bit_length())


def each_chunk(kernel: Callable[[Chunk], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of a first exchange from rows (chunk, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                yield _runs(name.as_py(), kernel(Chunk(body.as_py())))
                give_back()

    return run


def _runs(name: str, rows: Iterator[tuple]) -> pa.RecordBatch:
    buckets, runs, sides = [], [], []
    for bucket, run, side in rows:
        buckets.append(bucket)
        runs.append(run)
        sides.append(side)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array([name] * len(buckets), pa.string()), pa.array(runs, pa.binary()), pa.array(sides, pa.binary())],
        ["bucket", "chunk", "run", "side"],
    )


def answer(runs: DataFrame, reducer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """The answers to all runs: ``reducer`` gets the runs of a bucket and gives a payload for each."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", ignore_index=True)
        full = rows["run"].notna()
        answers = pd.Series([None] * len(rows), dtype=object)
        if full.any():
            answers[full] = reducer(rows["run"][full].tolist())
        give_back()
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "answer": answers, "side": rows["side"]})

    return runs.groupBy("bucket").applyInPandas(reduce, ANSWER_SCHEMA)


def _found(name: str, bodies: pa.Table, answers: pa.Table) -> tuple[Chunk, dict[int, bytes], bytes | None]:
    if bodies.num_rows != 1 or not answers.num_rows:
        raise RuntimeError(f"chunk {name} was packed anew in another order; read the documents from a table or a checkpoint")
    side = [x for x in answers["side"].to_pylist() if x is not None]
    got = {b: a for b, a in zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True) if a is not None}
    return Chunk(bodies["body"][0].as_py()), got, side[0] if side else None


def row_schema(docs: DataFrame, schema: str, carry: list[str] | None) -> str:
    """A result's schema with the carried columns in one column ``row``."""
    return f"{schema}, row {docs.select([f'`{c}`' for c in carry]).schema.simpleString()}" if carry else schema


def meet(chunks: DataFrame, answers: DataFrame, kernel: Callable[[Chunk, dict[int, bytes], bytes | None], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` on each chunk together with the answers to its runs, by bucket; carried columns follow as ``row``."""

    empty = {"kept": pa.binary(), "kept_text": pa.string(), "doc_id": pa.int64()}

    def run(key: tuple, bodies: pa.Table, found: pa.Table) -> pa.Table:
        out = pa.Table.from_pandas(kernel(*_found(key[0].as_py(), bodies, found)), preserve_index=False)
        for i, field in enumerate(out.schema):  # a column of nulls alone has no type yet
            if pa.types.is_null(field.type):
                out = out.set_column(i, field.name, out.column(i).cast(empty[field.name]))
        rest = bodies["rest"][0].as_py()
        if rest is not None:
            out = out.append_column("row", pa.ipc.open_stream(expand(rest)).read_all().column(0))
        give_back()
        return out

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def meet_runs(chunks: DataFrame, answers: DataFrame, kernel: Callable[[Chunk, dict[int, bytes], bytes | None], Iterator[tuple]]) -> DataFrame:
    """As ``meet``, giving the runs of a next exchange."""

    def run(key: tuple, bodies: pa.Table, found: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([_runs(key[0].as_py(), kernel(*_found(key[0].as_py(), bodies, found)))])
        give_back()
        return out

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, RUN_SCHEMA)


def split_sorted(keys: np.ndarray, key_bits: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) for each bucket that sorted keys fill; a bucket is the top ``bits`` of a key."""
    tops = (keys >> np.uint64(key_bits - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], tops[1:] != tops[:-1], [True]])) if len(keys) else np.zeros(1, dtype=np.int64)
    return [(int(tops[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def code_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First key and differences; 32-bit where they fit."""
    steps = np.diff(keys)
    if not len(steps) or steps.max() < (1 << 32):
        steps = steps.astype(np.uint32)
    return keys[:1], steps


def decode_sorted(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    out = np.empty(len(steps) + 1, dtype=np.uint64)
    out[0] = first[0]
    out[1:] = steps
    return np.cumsum(out, dtype=np.uint64)


def distinct_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, the index of each sorted key's distinct value, and the distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.cumsum(new) - 1, ordered[new]


def distinct_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``distinct_sorted`` for 128-bit keys, rows of two integers; the first one orders them."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ordered = keys[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    return order, np.cumsum(new) - 1, ordered[new]


def code_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 128-bit keys: the first halves as ``code_sorted`` has them, and the second halves."""
    return *code_sorted(keys[:, 0]), keys[:, 1]


def decode_pairs(first: np.ndarray, steps: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.stack([decode_sorted(first, steps), second], axis=1)


def answer_bits(answers: dict[int, bytes], pieces: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """One flag for each key sent, from the bitmaps that came back."""
    out = np.zeros(n, dtype=bool)
    for bucket, a, b in pieces:
        out[a:b] = np.unpackbits(np.frombuffer(expand(answers[bucket]), dtype=np.uint8), count=b - a).astype(bool)
    return out


def bitmaps(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return [squeeze(np.packbits(flags[a:b]).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
