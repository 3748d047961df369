"""Substring dedup by a sparse suffix array and a common-prefix-aware distributed merge sort.

A string of ``length`` bytes that starts twice is found through *anchors*: of the ``gram``-byte
strings inside each window of ``length`` bytes, the one whose hash is least (the leftmost of equals)
is the window's anchor. Equal windows have equal anchors at equal distances, so only suffixes that
start at anchors need sorting, about one in ``(length - gram) / 2`` bytes.

1. Sorted runs of anchor hashes are exchanged; anchors whose gram is met once only drop out, and
   grams met in many chunks are told apart as hot ones.
2. Each chunk sorts the suffixes of the anchors left, front-codes the sorted run (the length of the
   prefix shared with the suffix before, and the rest) and sends it to the bucket of the gram. A hot
   gram has no bucket of its own: its windows go, by their distance to the anchor in ``PARTS`` parts, to
   the bucket of the string that all windows of a part share, which is longer than the gram.
3. A bucket merges the runs of all chunks with a loser tree. Every loser keeps the length of the
   prefix that it shares with the winner that beat it; unequal lengths decide a match without
   looking at a byte, and equal ones compare from that length on.
4. Windows are equal when, for the distance d of their anchor, the suffixes share ``length - d``
   bytes and the texts before them share d bytes. Both are classes of neighbours in a sorted order,
   so each window gets a pair of class numbers, and the least (id, start) of each pair is the first.

Copies inside a chunk are sent once. So a passage that many documents hold in contexts of their own is
spread over the buckets of these contexts, and one that is longer than what a part shares reaches a
bucket once for each chunk and context.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from toponexus.llm import chunks as C
from toponexus.llm.hashing import byte_sums, mix, range_hashes, rolling_hashes

#: Bits of an anchor's hash in the first exchange; a chance meeting only adds suffixes to the sort.
ANCHOR_BITS = 48
#: Chunks that hold a gram before it counts as hot, and the parts that the distances of its windows fall into.
HOT, PARTS = 32, 4
#: Window starts of a chunk that are looked at together; each takes some 70 bytes meanwhile.
TOGETHER = 1 << 17
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string"


class Anchors:
    """Anchors of a chunk's windows: positions, hashes, and the windows of each."""

    def __init__(self, chunk: C.Chunk, length: int, gram: int, together: int = TOGETHER):
        # windows may not cross documents
        docs = np.flatnonzero(chunk.lengths >= length)
        begins, stops = chunk.offsets[:-1][docs], chunk.offsets[1:][docs] - length + 1
        parts = [_least_grams(chunk.data, begins, stops, a, min(a + together, len(chunk.data)), length, gram) for a in range(0, max(0, len(chunk.data) - length + 1), together)]
        at, values, first, last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64))
        # a run of windows that goes over the end of a part is one run
        new = np.ones(len(at), dtype=bool)
        new[1:] = at[1:] != at[:-1]
        kept = np.flatnonzero(new)
        final = np.concatenate([kept[1:], [len(at)]]) - 1 if len(kept) else kept
        # scrambled once more: anchors have small hashes, and buckets are cut from the top bits
        self.at, self.hashes = at[kept], mix(values[kept])
        #: Distances from the anchor's windows to the anchor, least and most.
        self.near, self.far = self.at - last[final], self.at - first[kept]
        self.doc = np.searchsorted(chunk.offsets, self.at, "right") - 1


def _least_grams(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, low: int, high: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The anchors of the windows that start from ``low`` to ``high``, and the hash, first and last window of each.

    Windows start inside [begins, stops), sorted ranges that do not overlap.
    """
    hashes = rolling_hashes(byte_sums(data[low : high + length - 1]), gram, "bytes")
    under = np.uint64((1 << 32) - 1)
    least = hashes & ~under
    least |= np.arange(low, low + len(hashes), dtype=np.uint64)  # the position breaks ties
    reach, width = 1, length - gram + 1
    while 2 * reach <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:]) if len(least) > reach else least[:0]
        reach *= 2
    if reach < width:
        more = width - reach
        least = np.minimum(least[: len(least) - more], least[more:]) if len(least) > more else least[:0]
    fits = np.zeros(len(least) + 1, dtype=np.int32)
    np.add.at(fits, np.clip(begins - low, 0, len(least)), 1)
    np.add.at(fits, np.clip(stops - low, 0, len(least)), -1)
    starts = np.flatnonzero(np.cumsum(fits[:-1]))
    at = (least[starts] & under).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    # a document's windows go on from the one before, or its anchors differ
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1 if len(first) else first
    at = at[first]
    return at, hashes[at - low], starts[first] + low, starts[last] + low


def _anchor_runs(length: int, gram: int, bits: int):
    def kernel(chunk: C.Chunk):
        keys = np.unique(Anchors(chunk, length, gram).hashes >> np.uint64(64 - ANCHOR_BITS))
        for bucket, a, b in C.split_sorted(keys, ANCHOR_BITS, bits):
            yield bucket, C.pack_arrays(*C.code_sorted(keys[a:b])), None
        if not len(keys):
            yield 0, None, None

    return kernel


def _met_elsewhere(hot: int):
    """Two flags a gram: whether more chunks than one hold it, and whether more than ``hot`` do."""

    def reduce(runs: list[bytes]) -> list[bytes]:
        keys = [C.decode_sorted(*C.unpack_arrays(run)) for run in runs]
        order, group, _ = C.distinct_sorted(np.concatenate(keys))
        held = np.empty(len(order), dtype=np.int64)
        held[order] = np.bincount(group)[group]
        return C.bitmaps(np.stack([held > 1, held > hot], axis=1).ravel(), [2 * len(x) for x in keys])

    return reduce


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """For each row of a byte matrix, the length of the prefix that it shares with the row before."""
    out = np.zeros(len(rows), dtype=np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared-prefix lengths, lengths and the rests of sorted suffixes."""
    sizes = np.array([len(x) for x in suffixes], dtype=np.int64)
    if not len(sizes):
        return sizes, sizes, b""
    rows = np.frombuffer(b"".join(x.ljust(int(sizes.max()), b"\0") for x in suffixes), dtype=np.uint8).reshape(len(sizes), -1)
    shared = shared_prefixes(rows)
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    return shared, sizes, b"".join(x[h:] for x, h in zip(suffixes, shared.tolist(), strict=True))


class Run:
    """A front-coded sorted run, read in order; ``shared`` is with the suffix read before."""

    def __init__(self, shared: np.ndarray, sizes: np.ndarray, rest: bytes):
        self.shared_all, self.rest = shared.tolist(), rest
        self.ends = np.cumsum(sizes - shared).tolist()
        self.i, self.text, self.shared = -1, b"", 0

    def step(self) -> bool:
        self.i += 1
        if self.i == len(self.ends):
            return False
        self.shared = self.shared_all[self.i]
        self.text = self.text[: self.shared] + self.rest[self.ends[self.i - 1] if self.i else 0 : self.ends[self.i]]
        return True


def shared_from(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes are known."""
    x, y = a[known:], b[known:]
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return known + n - (differ.bit_length() + 7) // 8


def merge_runs(runs: list[Run]) -> tuple[list[int], list[int]]:
    """Merge sorted runs by a loser tree: the run of each output, and the prefix shared with the output before."""
    k = len(runs)
    leaves = 1 << max(0, (k - 1).bit_length())
    live = [run.step() for run in runs] + [False] * (leaves - k)
    # at a node: the loser of its match and the prefix shared with that match's winner
    losers, shared = [-1] * leaves, [0] * leaves

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves if live[node - leaves] else -1
        a, b = build(2 * node), build(2 * node + 1)
        if a < 0 or b < 0:
            return max(a, b)
        h = shared_from(runs[a].text, runs[b].text, 0)
        if runs[b].text[h:] < runs[a].text[h:]:
            a, b = b, a
        losers[node], shared[node] = b, h
        return a

    winner, h = build(1), 0
    out_runs: list[int] = []
    out_shared: list[int] = []
    while winner >= 0:
        out_runs.append(winner)
        out_shared.append(h)
        node = (winner + leaves) >> 1
        if runs[winner].step():
            h = runs[winner].shared
        else:
            winner, h = -1, -1
        while node:
            loser = losers[node]
            if loser >= 0:
                other = shared[node]
                if other > h:  # it shares more with the last output and so comes first
                    losers[node], shared[node] = winner, h
                    winner, h = loser, other
                elif other == h:
                    a, b = runs[winner].text, runs[loser].text
                    common = shared_from(a, b, h)
                    shared[node] = common
                    if b[common:] < a[common:]:
                        losers[node], winner = winner, loser
            node >>= 1
    return out_runs, out_shared


def _spread(chunk: C.Chunk, anchors: Anchors, keep: np.ndarray, hot: np.ndarray, length: int, gram: int, bits: int) -> tuple[np.ndarray, ...]:
    """What is sent of the anchors ``keep``: anchor, bucket, and least and most distance of the windows that go with it."""
    calm, busy = keep[~hot[keep]], keep[hot[keep]]
    found = [(calm, (anchors.hashes[calm] >> np.uint64(64 - bits)).astype(np.int64), anchors.near[calm], anchors.far[calm])]
    if len(busy):
        sums = byte_sums(chunk.data)
        width = -(-(length - gram + 1) // PARTS)
        for low in range(0, length - gram + 1, width):
            high = min(low + width - 1, length - gram)
            some = busy[(anchors.near[busy] <= high) & (anchors.far[busy] >= low)]
            at = anchors.at[some]
            # inside every window of a distance from low to high
            shared = mix(range_hashes(sums, at - low, at + length - high, "bytes") + np.uint64(low))
            found.append((some, (shared >> np.uint64(64 - bits)).astype(np.int64), np.maximum(anchors.near[some], low), np.minimum(anchors.far[some], high)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _suffix_runs(length: int, gram: int, bits: int):
    def kernel(chunk: C.Chunk, answers: dict[int, bytes], _side):
        anchors = Anchors(chunk, length, gram)
        order, group, keys = C.distinct_sorted(anchors.hashes >> np.uint64(64 - ANCHOR_BITS))
        pieces = [(bucket, 2 * a, 2 * b) for bucket, a, b in C.split_sorted(keys, ANCHOR_BITS, bits)]
        flags = C.answer_bits(answers, pieces, 2 * len(keys)).reshape(-1, 2)
        met = flags[:, 0] | (np.bincount(group, minlength=len(keys)) > 1)
        hot = np.zeros(len(anchors.at), dtype=bool)
        hot[order] = flags[group, 1]
        keep = np.sort(order[met[group]])
        keep, bucket, near, far = _spread(chunk, anchors, keep, hot, length, gram, bits)
        at, doc = anchors.at[keep], anchors.doc[keep]
        text, starts, ends = chunk.data.tobytes(), (at - far).tolist(), (at - near + length).tolist()
        ids, edges = chunk.ids[doc], at - chunk.offsets[doc]
        # copies in this chunk: the first by (id, start) stands for the others
        firsts: dict[tuple[bytes, int], int] = {}
        sent: list[int] = []
        copies: list[int] = []
        for i in np.lexsort((edges, ids)).tolist():
            seen = firsts.setdefault((text[starts[i] : ends[i]], far.item(i)), i)
            (sent if seen == i else copies).append(i)
        suffix = {i: text[at.item(i) : ends[i]] for i in sent}
        sent.sort(key=lambda i: (bucket.item(i), suffix[i]))
        chosen, copies = np.array(sent, dtype=np.int64), np.array(copies, dtype=np.int64)
        side = C.pack_arrays(at[chosen], bucket[chosen], at[copies], near[copies], far[copies])
        edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[chosen]) != 0, [True]])) if len(chosen) else np.zeros(1, dtype=np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            part = chosen[a:b]
            shared, sizes, rest = front_code([suffix[i] for i in part.tolist()])
            before = b"".join(text[starts[i] : at.item(i)][::-1] for i in part.tolist())
            yield (
                bucket.item(sent[a]),
                C.pack_arrays(shared.astype(np.int32), sizes.astype(np.int32), near[part].astype(np.int32), far[part].astype(np.int32), ids[part], edges[part], np.frombuffer(rest, dtype=np.uint8), np.frombuffer(before, dtype=np.uint8)),
                side,
            )
            side = None
        if side is not None:
            yield 0, None, side

    return kernel


def _classes_before(groups: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (group, text before the anchor read backwards) and the prefix shared with the neighbour; -1 across groups."""
    width = -(-before.shape[1] // 8) * 8
    padded = np.zeros((len(before), width), dtype=np.uint8)
    padded[:, : before.shape[1]] = before
    columns = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*(columns[:, j] for j in range(columns.shape[1] - 1, -1, -1)), groups))
    shared = shared_prefixes(before[order])
    shared[np.concatenate([[True], np.diff(groups[order]) != 0])] = -1
    return order, shared


def _covered(length: int, gram: int):
    def reduce(runs: list[bytes]) -> list[bytes]:
        parts = [C.unpack_arrays(run) for run in runs]
        counts = [len(p[0]) for p in parts]
        base = np.concatenate([[0], np.cumsum(counts)])
        out_runs, out_shared = merge_runs([Run(p[0].astype(np.int64), p[1].astype(np.int64), p[6].tobytes()) for p in parts])
        owner = np.array(out_runs, dtype=np.int64)
        # the i-th output of a run is its i-th suffix
        by_run = np.argsort(owner, kind="stable")
        entry = np.empty(len(owner), dtype=np.int64)
        entry[by_run] = np.arange(base[-1])
        near, far, ids, edges = (np.concatenate([p[j] for p in parts]) for j in (2, 3, 4, 5))
        shared = np.array(out_shared, dtype=np.int64)
        gram_group = np.cumsum(shared < gram)  # in merged order
        size = np.bincount(gram_group)[gram_group]
        out = np.zeros(base[-1], dtype=np.uint64)
        wide = length - gram
        keep = size > 1
        # a dropped suffix is alone with its gram, so the shared lengths of those kept hold
        entry, shared = entry[keep], shared[keep]
        if len(entry):
            n = len(entry)
            before = np.zeros((n, max(1, wide)), dtype=np.uint8)
            texts = np.concatenate([p[7] for p in parts])
            begins = np.concatenate([[0], np.cumsum(far.astype(np.int64))])
            spans = far[entry].astype(np.int64)
            row = np.repeat(np.arange(n), spans)
            column = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
            before[row, column] = texts[np.repeat(begins[entry], spans) + column]
            order, left = _classes_before(np.cumsum(shared < gram), before)
            rank = np.empty(n, dtype=np.int64)
            by_place = np.lexsort((edges[entry], ids[entry]))
            rank[by_place] = np.arange(n)
            low, high = near[entry], far[entry]
            for d in range(wide + 1):
                use = np.flatnonzero((low <= d) & (d <= high))
                if len(use) < 2:
                    continue
                right_class = np.cumsum(shared < length - d)
                left_class = np.empty(n, dtype=np.int64)
                left_class[order] = np.cumsum(left < d)
                keys = np.lexsort((rank[use], left_class[use], right_class[use]))
                r, l = right_class[use][keys], left_class[use][keys]
                again = np.zeros(len(use), dtype=bool)
                again[1:] = (r[1:] == r[:-1]) & (l[1:] == l[:-1])
                out[entry[use[keys[again]]]] |= np.uint64(1 << d)
        return [C.pack_arrays(out[a:b]) for a, b in zip(base[:-1], base[1:], strict=True)]

    return reduce


def _finish(length: int, with_bytes: bool, with_text: bool):
    def kernel(chunk: C.Chunk, answers: dict[int, bytes], side: bytes) -> pd.DataFrame:
        at, bucket, copies, near, far = C.unpack_arrays(side)
        flags = np.concatenate([C.unpack_arrays(answers[b])[0] for b in np.unique(bucket).tolist()]) if len(at) else np.zeros(0, dtype=np.uint64)
        cover = np.zeros(len(chunk.data) + 1, dtype=np.int32)
        some = np.flatnonzero(flags)
        row, d = np.nonzero(np.unpackbits(flags[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        starts = at[some[row]] - d
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + length, -1)
        np.add.at(cover, copies - far, 1)  # all windows of a copy
        np.add.at(cover, copies - near + length, -1)
        gone = np.cumsum(cover, out=cover)[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = chunk.offsets[:-1][chunk.lengths > 0]
        begins[inner] = gone[inner]
        cover[0] = 0

        def before(marks: np.ndarray) -> np.ndarray:
            np.cumsum(marks, out=cover[1:], dtype=np.int32)
            return cover[chunk.offsets].astype(np.int64)

        removed, spans = before(gone), before(begins)
        kept = chunk.data[~gone].tobytes()
        edges = (chunk.offsets - removed).tolist()
        slices = [kept[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        none = pd.Series([None] * len(chunk), dtype=object)
        return pd.DataFrame(
            {
                "doc_id": chunk.given_ids(),
                "n_bytes": chunk.lengths,
                "n_removed": np.diff(removed),
                "n_spans": np.diff(spans),
                "kept": slices if with_bytes else none,
                "kept_text": [x.decode("utf-8", "ignore") for x in slices] if with_text else none,
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in slices],
            }
        )

    return kernel


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 50, with_bytes: bool = True, with_text: bool = False, chunk_bytes: int = C.CHUNK_BYTES, carry: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """Drop each byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or the same id and an earlier start; strings do not cross documents.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes;
    null unless ``with_bytes``), kept_text (the same as text, without what is left of cut characters;
    null unless ``with_text``) and kept_sha256, a row for each row of ``docs``. Null text counts as
    empty; a null id sorts after all others. Rows that share an id count as one document read in an
    undefined order, so of equal rows one keeps its bytes. Of other columns only
    those of ``carry`` are read; they follow as one column ``row``. An empty
    table gives an empty result. ``docs`` must read alike each time: a table, a file scan or a
    checkpoint.
    """
    if not 0 < gram <= length <= gram + 63:
        raise ValueError("gram must be at most length, and length - gram at most 63")
    bits = C.bucket_bits(docs.sparkSession)
    packed = C.pack(docs, id_col, text_col, chunk_bytes, carry)
    met = C.answer(packed.mapInArrow(C.each_chunk(_anchor_runs(length, gram, bits)), C.RUN_SCHEMA), _met_elsewhere(hot))
    found = C.answer(C.meet_runs(packed, met, _suffix_runs(length, gram, bits)), _covered(length, gram))
    return C.meet(packed, found, _finish(length, with_bytes, with_text), C.row_schema(docs, SCHEMA, carry))
