"""Language identification by a byte convolutional network.

Bytes are embedded, filters of widths 2 to 5 slide over fixed windows, each filter's largest answer
in a window is kept, and a softmax layer scores the languages. The network is trained in numpy on a
bounded sample of labelled rows and applied to every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from toponexus.llm.chunks import column_bytes, give_back
from toponexus.llm.storage import small_batches

#: Rows a language gives to the training sample at most, and the characters read of each.
SAMPLE_ROWS, SAMPLE_CHARS = 600, 512
#: Languages that the training sample holds at most: the most frequent ones.
LANGUAGES = 256
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4, 5), 12, 8
WINDOW = 256
#: Windows overlap so that every position starts one filter.
STRIDE = WINDOW - max(WIDTHS) + 1
PAD = 256
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double"


class Network:
    """Weights of the network; ``train`` and ``scores`` are its two uses."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        widest, total = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (PAD + 1, EMBEDDED)).astype(np.float32)
        self.embedding[PAD] = 0
        self.used = np.zeros((widest, EMBEDDED, total), dtype=np.float32)
        for i, width in enumerate(WIDTHS):
            self.used[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.used = self.used.reshape(widest * EMBEDDED, total)
        self.filters = (rng.normal(0, 0.3, self.used.shape) * self.used).astype(np.float32)
        self.bias = np.zeros(total, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (total, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        embedded = self.embedding[windows]
        flat = np.lib.stride_tricks.sliding_window_view(embedded, max(WIDTHS), axis=1)  # (n, places, EMBEDDED, widest)
        return np.ascontiguousarray(flat.transpose(0, 1, 3, 2)).reshape(len(windows), STRIDE, -1)

    def _pooled(self, windows: np.ndarray) -> np.ndarray:
        patches = self._patches(windows)
        answers = patches.reshape(-1, patches.shape[2]) @ self.filters
        return np.maximum(answers.reshape(len(windows), STRIDE, -1).max(axis=1) + self.bias, 0)

    def logits(self, windows: np.ndarray, block: int = 32) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), dtype=np.float32)
        for a in range(0, len(windows), block):
            out[a : a + block] = self._pooled(windows[a : a + block]) @ self.out + self.out_bias
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> None:
        """Adam on the cross-entropy; gradients flow through each filter's best place."""
        rng = np.random.default_rng(seed)
        weights = [self.embedding, self.filters, self.bias, self.out, self.out_bias]
        first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                x, y = windows[some], labels[some]
                n = len(some)
                patches = self._patches(x)
                answers = (patches.reshape(-1, patches.shape[2]) @ self.filters).reshape(n, STRIDE, -1)
                best = answers.argmax(axis=1)
                pooled = np.maximum(np.take_along_axis(answers, best[:, None, :], axis=1)[:, 0] + self.bias, 0)
                logits = pooled @ self.out + self.out_bias
                slope = _softmax(logits)
                slope[np.arange(n), y] -= 1
                slope /= n
                to_pool = (slope @ self.out.T) * (pooled > 0)
                chosen = patches[np.arange(n)[:, None], best]  # (n, filters, patch)
                to_filters = np.einsum("nfp,nf->pf", chosen, to_pool) * self.used
                to_patch = to_pool[:, :, None] * self.filters.T[None]
                to_embedding = np.zeros_like(self.embedding)
                reach = best[:, :, None] + np.arange(max(WIDTHS))
                np.add.at(to_embedding, x[np.arange(n)[:, None, None], reach], to_patch.reshape(*best.shape, max(WIDTHS), EMBEDDED))
                to_embedding[PAD] = 0
                step += 1
                for w, g, m, v in zip(weights, (to_embedding, to_filters, to_pool.sum(0), pooled.T @ slope, slope.sum(0)), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over whole concatenated texts, padded at each text's end, and each window's text."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = offsets[:-1][text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    place = begin[:, None] + np.arange(WINDOW)
    inside = place < offsets[1:][text][:, None]
    out = np.full(place.shape, PAD, dtype=np.int16)
    out[inside] = data[place[inside]]
    return out, text


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most ``SAMPLE_ROWS`` pieces of text for each of at most ``LANGUAGES`` labels, those with the least hashes of the id.

    Labels are counted first, so that of each one only hashes below a limit are ranked: some twenty
    times as many rows as are wanted, however many there are.
    """
    lang = F.col(f"`{lang_col}`").cast("string").alias("lang")
    counts = docs.select(lang).where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    share = {r["lang"]: min(1.0, 20 * SAMPLE_ROWS / r["count"]) for r in counts}
    limits = docs.sparkSession.createDataFrame([(name, int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1) for name, part in share.items()], "lang string, most long")
    picked = F.xxhash64(F.col(f"`{id_col}`").cast("string"))
    text = F.col(f"`{text_col}`").cast("string")
    start = F.pmod(picked, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    rows = docs.select(lang, picked.alias("picked"), text.alias("text"), start.alias("start")).join(F.broadcast(limits), "lang").where(F.col("picked") <= F.col("most"))
    pieces = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", "picked", F.col("text").substr(F.col("start"), F.lit(SAMPLE_CHARS)).alias("piece"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("picked", "piece"))
    few = pieces.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_ROWS)
    return [(r.lang, r.piece) for r in few.orderBy("lang", "nth").select("lang", "piece").collect()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on a bounded sample of the labelled rows of ``docs``; None where there are none."""
    rows = sample(docs, id_col, text_col, lang_col)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    network = Network(languages)
    texts = [piece.encode() for _, piece in rows]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    windows, text = windows_of(data, np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64))
    names = {lang: i for i, lang in enumerate(languages)}
    labels = np.array([names[lang] for lang, _ in rows])[text]
    full = (windows != PAD).sum(axis=1) >= 16
    keep = full if len(set(labels[full].tolist())) == len(languages) else np.ones(len(full), dtype=bool)
    network.train(windows[keep], labels[keep])
    return network


def _predict(network: Network | None, place: int, kept: int, block: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            data, offsets = column_bytes(row.field(place))
            lettered = np.asarray(batch.column("lettered").fill_null(False)).astype(bool)
            names: list[str] = [UNKNOWN] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            rows = np.flatnonzero(lettered) if network else []
            a = 0
            while a < len(rows):  # as many texts as make a block; a long text makes its own
                b, held = a, 0
                while b < len(rows) and (b == a or held + offsets[rows[b] + 1] - offsets[rows[b]] <= block):
                    held += offsets[rows[b] + 1] - offsets[rows[b]]
                    b += 1
                total = np.zeros((b - a, len(network.languages)))
                counts = np.zeros(b - a)
                for own, logits in _text_logits(network, data, offsets, rows[a:b], block):
                    probs = np.log(_softmax(logits.astype(np.float64)) + 1e-9)
                    np.add.at(total, own, probs)
                    np.add.at(counts, own, 1)
                probs = _softmax(total / counts[:, None])
                for i, best in enumerate(probs.argmax(axis=1).tolist()):
                    names[rows[a + i]] = network.languages[best]
                    scores[rows[a + i]] = probs[i, best]
                a = b
            if place == kept:  # the text was sent for the prediction alone
                fields = [row.type.field(i) for i in range(row.type.num_fields)]
                none = pa.nulls(batch.num_rows, fields[place].type)
                row = pa.StructArray.from_arrays([*(row.field(i) for i in range(kept)), none], fields=fields)
            yield pa.RecordBatch.from_arrays([row, pa.array(names, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])
        give_back()

    return run


def _text_logits(network: Network, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, block: int):
    """(place among rows, logits) for the windows of each text, long texts in blocks."""
    if len(rows) == 1:
        a, end = int(offsets[rows[0]]), int(offsets[rows[0] + 1])
        step = max(1, block // STRIDE) * STRIDE
        for x in range(a, max(a + 1, end - max(WIDTHS) + 1), step):
            piece = np.array([0, min(end, x + step + max(WIDTHS) - 1) - x])
            windows, own = windows_of(data[x : x + piece[1]], piece)
            yield own, network.logits(windows)
        return
    # windows_of wants texts that touch one another
    parts = [data[offsets[r] : offsets[r + 1]] for r in rows]
    windows, own = windows_of(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
    yield own, network.logits(windows)


def identify(docs: DataFrame, network: Network | None, text_col: str = "text", keep: list[str] | None = None, as_row: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with lang_pred and score.

    The prediction reads the text alone, all of it. Null text, text without a letter, and every text
    where there is no network give ``und`` with score 0. Scores are the mean over a text's windows.
    Repeated rows stay. An empty table gives an empty result. Kept columns that are called lang_pred
    or score give way to the result's, unless ``as_row`` keeps all of them in one column ``row``.
    """
    keep = docs.columns if keep is None else keep
    if not as_row:
        keep = [c for c in keep if c not in ("lang_pred", "score")]
    kinds = [f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*(f"`{c}`" for c in keep)).schema.fields]
    parts = [F.col(f"`{c}`") for c in keep]
    source = F.col(f"`{text_col}`").cast("string")
    if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string":
        place = keep.index(text_col)  # a text is sent once
    else:
        place = len(keep)
        parts.append(source.alias("__text"))
        kinds.append("__text: string")
    rows = small_batches(docs).select(F.struct(*parts).alias("row"), source.rlike(r"\p{L}").alias("lettered"))
    found = rows.mapInArrow(_predict(network, place, len(keep)), f"row struct<{', '.join(kinds)}>, {SCHEMA}")
    return found if as_row else found.select(*(F.col(f"row.`{c}`") for c in keep), "lang_pred", "score")


def held_out(id_col: str):
    """True for the rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
