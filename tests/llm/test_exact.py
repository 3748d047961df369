"""Exact operators against brute force, on tables with nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from toponexus.llm import block_repeats, chunks, line_templates, packing, suffix_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, bucket int, chunk string, row string, kept string"


def corpus(seed: int = 0, n: int = 40):
    """Rows whose extra columns are called like inner ones of the operators."""
    rng = random.Random(seed)
    words = ["a", "été", "x1", "the", "of", "ñandú", "漢字", "k@v", "zz", "line"]
    passage = " ".join(rng.choice(words) + str(i % 7) for i in range(60))
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 4))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), passage[rng.randrange(20) :])
        if i % 4 == 0:
            parts.append(f"Call 555-{i} now please")
        rows.append((i, "\n".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "ab" * 3000), (n + 4, rows[0][1]), (n + 5, rows[0][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "c", "r", "k") for i, t in rows], SCHEMA)


def covered(rows, unit, width, earlier):
    """Texts as sequences of units, and for each unit whether a window that is met earlier covers it."""
    first = {}
    parts = [(i, unit(t)) for i, t in sorted(rows, key=lambda r: r[0])]
    for i, u in parts:
        for j in range(len(u) - width + 1):
            key = u[j : j + width] if isinstance(u, bytes) else tuple(u[j : j + width])
            first.setdefault(key, (i, j))
    out = {}
    for i, u in parts:
        gone = np.zeros(len(u), dtype=bool)
        for j in range(len(u) - width + 1):
            key = u[j : j + width] if isinstance(u, bytes) else tuple(u[j : j + width])
            if earlier(first[key], (i, j)):
                gone[j : j + width] = True
        out[i] = u, gone
    return out


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [500, 1 << 20])
def test_block_repeats(spark, chunk_bytes):
    rows = corpus()
    want = covered(rows, lambda t: WORD.findall(t or ""), 13, lambda a, b: a[0] < b[0])
    got = block_repeats.remove_repeats(frame(spark, rows), chunk_bytes=chunk_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        words, gone = want[r.doc_id]
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) == (len(words), gone.sum(), kept, digest(kept.encode()))
    assert sum(r.n_removed for r in got) > 100


@pytest.mark.parametrize(("chunk_bytes", "length", "gram", "hot"), [(500, 100, 50, 32), (500, 100, 50, 1), (1 << 20, 100, 50, 0), (700, 40, 40, 2), (700, 30, 8, 1)])
def test_suffix_repeats(spark, chunk_bytes, length, gram, hot):
    rows = corpus(1)
    want = covered(rows, lambda t: (t or "").encode(), length, lambda a, b: a < b)
    got = suffix_repeats.remove_repeats(frame(spark, rows), length=length, gram=gram, chunk_bytes=chunk_bytes, hot=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        data, gone = want[r.doc_id]
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) == (len(data), gone.sum(), spans, kept, digest(kept))
    assert sum(r.n_removed for r in got) > 100


def test_a_hot_passage_is_spread_over_buckets():
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    text = "".join("".join(rng.choice("abcdefgh ") for _ in range(120)) + passage for _ in range(1500)).encode()
    raw = np.int64(1).tobytes() + np.int64(7).tobytes() + np.int64(len(text)).tobytes() + b"\1" + text
    chunk = suffix_repeats.C.Chunk(suffix_repeats.C.squeeze(raw))
    anchors = suffix_repeats.Anchors(chunk, 100, 50)
    _, gram, met = np.unique(anchors.hashes, return_inverse=True, return_counts=True)
    inside = np.flatnonzero(met[gram] > 20)
    assert len(inside) > 100
    sent, bucket, near, far = suffix_repeats._spread(chunk, anchors, inside, np.ones(len(anchors.at), dtype=bool), 100, 50, 8)
    assert np.bincount(bucket, minlength=256).max() < 0.05 * len(bucket)
    windows = [(anchors.at[i], d) for i in inside.tolist() for d in range(anchors.near[i], anchors.far[i] + 1)]
    assert sorted(windows) == sorted((anchors.at[i], d) for i, a, b in zip(sent.tolist(), near.tolist(), far.tolist(), strict=True) for d in range(a, b + 1))


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(3)
    for _ in range(50):
        runs = [sorted("".join(rng.choice("ab\0") for _ in range(rng.randrange(8))).encode() for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 7))]
        coded = [suffix_repeats.front_code(run) for run in runs]
        out, shared = suffix_repeats.merge_runs([suffix_repeats.Run(*c) for c in coded])
        at = [0] * len(runs)
        merged = []
        for k in out:
            merged.append(runs[k][at[k]])
            at[k] += 1
        assert merged == sorted(x for run in runs for x in run)
        for i in range(1, len(merged)):
            a, b = merged[i - 1], merged[i]
            assert shared[i] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def templates(rows, min_tokens=3, depth=3, variety=5, fixed=0.5):
    """The template of each line, leaf by leaf over all rows."""
    def tokens(line):
        return ["<*>" if re.search("[0-9@]", w) else w for w in WORD.findall(line)]

    seen = defaultdict(set)
    lines = {line for _, t in rows for line in (t or "").split("\n")}
    for line in lines:
        found = tokens(line)
        for i, w in enumerate(found[depth:], depth):
            seen[len(found), tuple(found[:depth]), i].add(w)
    out = {}
    for line in lines:
        found = tokens(line)
        if len(found) >= min_tokens:
            general = [w if i < depth or len(seen[len(found), tuple(found[:depth]), i]) <= variety else "<*>" for i, w in enumerate(found)]
            literal = sum(w != "<*>" for w in general)
            out[line] = " ".join(general if literal >= fixed * len(general) else found)
    return out


def lines_kept(rows, min_docs, **settings):
    of, who = templates(rows, **settings), defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if line in of:
                who[of[line]].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        out[i] = lines, [x for x in lines if not (x in of and len(who[of[x]]) >= min_docs and min(who[of[x]]) != i)]
    return out


def named_lines(n=30, seed=9):
    """Documents with lines whose variable fields are plain words, and prose that shares a beginning only."""
    rng = random.Random(seed)
    names = ["Ann", "Bob", "Cho", "Dee", "Eve", "Fay", "Gus", "Hal", "Ida", "Jo"]
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(n):
        lines = [f"Posted on day by {rng.choice(names)} in the main forum", "at the end " + " ".join(rng.choice(words) for _ in range(6)), f"Share this page with {rng.choice(names[:2])} and others"]
        rows.append((i, "\n".join(lines[: 1 + i % 3])))
    return rows


@pytest.mark.parametrize("chunk_bytes", [500, 1 << 20])
@pytest.mark.parametrize("settings", [{}, {"depth": 1}, {"depth": 6}, {"variety": 1, "fixed": 0.2}])
def test_line_templates(spark, chunk_bytes, settings):
    rows = corpus(2) + [(100 + i, t) for i, t in named_lines()]
    want = lines_kept(rows, 3, **settings)
    got = line_templates.drop_recurring(frame(spark, rows), min_docs=3, chunk_bytes=chunk_bytes, **settings).collect()
    assert len(got) == len(rows)
    for r in got:
        lines, kept = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert r.kept_sha256 == digest("\n".join(kept).encode())
    assert sum(r.n_dropped for r in got) > 5


def test_leaves_generalise_words_and_leave_prose(spark):
    rows = named_lines()
    for depth, left in ((3, 1), (6, 10)):  # a path through the name keeps the names apart
        got = line_templates.drop_recurring(frame(spark, rows), min_docs=12, depth=depth).collect()
        kept = [line for r in got for line in r.kept_text.split("\n")]
        assert sum(line.startswith("Posted") for line in kept) >= left and sum(line.startswith("at the end") for line in kept) == 20
        assert (sum(line.startswith("Posted") for line in kept) == 1) == (depth == 3)
        assert all(line.startswith(("Posted", "at the end", "Share")) or not line for line in kept)


def mirror_words():
    """Two unequal words whose sums of value times power agree modulo 2**64 for all values and odd multipliers."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_hash_are_told_apart(spark):
    from tokenizers import Tokenizer

    from toponexus.llm import unigram
    from toponexus.llm.hashing import byte_sums, range_hashes

    one, other = mirror_words()
    both = np.frombuffer((one + other).encode(), dtype=np.uint8)
    assert len(set(range_hashes(byte_sums(both), np.array([0, 1024]), np.array([1024, 2048]), "bytes").tolist())) == 1
    rest = " one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, (one if i % 2 else other) + rest) for i in range(8)] + [(8, f"{one} {other} {one}"), (9, f"{other} {one} {other}")]
    texts = dict(rows)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = frame(spark, rows).coalesce(1)
    ids = defaultdict(list)
    for r in sorted(packing.pack(docs, path).collect(), key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += np.frombuffer(r.ids, dtype="<u4").tolist()
    assert all(ids[i] == [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows)
    found = unigram.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r.lossless and r.decoded_sha256 == digest(texts[r.doc_id].encode()) for r in found)
    for chunk_bytes in (500, 1 << 20):
        got = {r.doc_id: r.n_removed for r in block_repeats.remove_repeats(docs, chunk_bytes=chunk_bytes).collect()}
        assert got == {0: 0, 1: 0, **dict.fromkeys(range(2, 8), 13), 8: 0, 9: 0}
        want = lines_kept(rows, 4)
        kept = {r.doc_id: r.kept_text for r in line_templates.drop_recurring(docs, min_docs=4, chunk_bytes=chunk_bytes).collect()}
        assert kept == {i: "\n".join(x[1]) for i, x in want.items()}
        assert {i for i, t in kept.items() if t} == {0, 1, 8, 9}


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["it's 3x don't", "a\x1cb c d e", "İstanbul ΑΣ", "é ́x", "<|endoftext|> x<|startoftext|>y", "a" * 5000, "क़ क़", "***!!! ...", "!!a1b2!!"]
    rows = corpus(4) + [(900 + i, t) for i, t in enumerate(odd)]
    length = 64
    got = packing.pack(frame(spark, rows), path, length=length).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert (len(ids), len(docs[r.doc_id]), zlib.crc32(r.ids)) == (r.length, r.start, r.ids_crc32)
        docs[r.doc_id] += ids
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        assert docs[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], t
    assert all(r.doc_tokens == len(docs[r.doc_id]) for r in got)
    for number, pieces in sequences.items():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at == length or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_words_are_forgotten_and_learned_again(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "WORDS_KEPT", 5)
    own, other = packing.WordTokenizer(path), Tokenizer.from_file(path)
    for text in ("one two three one", "four five six seven two", "eight one nine ten eleven", "one two 12 thirteen"):
        ids, counts = own.batch(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == other.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


OPERATORS = {
    "block": lambda d: block_repeats.remove_repeats(d),
    "suffix": lambda d: suffix_repeats.remove_repeats(d),
    "lines": lambda d: line_templates.drop_recurring(d, min_docs=2),
    "pack": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_null_and_repeated_ids(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    rows = [(None, text), (None, None), (5, text), (5, text), (7, text)]
    got = OPERATORS[name](frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 5), (False, 5), (False, 7), (True, 0), (True, 0)]
    if name == "block":
        removed = sorted((r.doc_id or 99, r.n_removed) for r in got)
        assert removed == [(5, 0), (5, 0), (7, 18), (99, 0), (99, 18)]
    if name == "suffix":  # of equal rows one keeps its bytes
        assert sorted(r.n_removed for r in got if r.doc_id == 5) == [0, len(text)]
    if name == "lines":
        assert sorted(r.n_dropped for r in got) == [0, 0, 0, 1, 1]


def test_carried_columns(spark):
    docs = frame(spark, corpus(5))
    for found in (block_repeats.remove_repeats(docs, carry=["doc_id", "chunk", "bucket"]), suffix_repeats.remove_repeats(docs, carry=["doc_id", "chunk", "bucket"], chunk_bytes=300)):
        got = found.collect()
        assert all((r.row.doc_id, r.row.chunk, r.row.bucket) == (r.doc_id, "c", 1) for r in got) and len(got) == docs.count()


def test_anchors_do_not_depend_on_parts():
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"ab c", dtype=np.uint8)
    for sizes in ([], [0], [100], [99, 100, 101], [1000, 5, 300, 0, 101]):
        texts = [bytes(rng.choice(letters, n)) for n in sizes]
        raw = np.int64(len(texts)).tobytes() + np.arange(len(texts)).tobytes() + np.array(sizes, dtype=np.int64).tobytes() + bytes([1] * len(texts)) + b"".join(texts)
        chunk = chunks.Chunk(chunks.squeeze(raw))
        whole = suffix_repeats.Anchors(chunk, 100, 50, 1 << 17)
        for together in (1, 7, 64):
            parts = suffix_repeats.Anchors(chunk, 100, 50, together)
            for field in ("at", "hashes", "near", "far", "doc"):
                assert np.array_equal(getattr(parts, field), getattr(whole, field))
