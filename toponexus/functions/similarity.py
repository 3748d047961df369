"""String similarity: the engine's edit distance, and Arrow-batched kernels for the fuzzy ratios."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponexus.functions.text import ARABIC_ARTICLE, ARABIC_RANGES, LOCALITY_WORDS
from toponexus.functions.translit import latin


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance without regard to case, as a double."""
    return F.levenshtein(F.lower(a), F.lower(b)).cast("double")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one addition per sign over a bit per place."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, sign in enumerate(a):
        places[sign] = places.get(sign, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for sign in b:
        hit = row & places.get(sign, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


@lru_cache(maxsize=1 << 12)
def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words, and the shared words with the rest of either side."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 100.0
    own, other = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    s = len(" ".join(sorted(shared)))
    gap = 1 if s else 0
    # both sides begin with the shared words, so only the rests differ
    total = 2 * (s + gap) + len(own) + len(other)
    apart = len(own) + len(other) - 2 * common_length(own, other)
    best = 100.0 - 100.0 * apart / total
    if s:
        for rest in (own, other):
            best = max(best, 100.0 - 100.0 * (gap + len(rest)) / (2 * s + gap + len(rest)))
    return best


def _beginnings(a: str, b: str, count: int) -> list[int]:
    """Common lengths of ``a`` with the first 1, 2, ... ``count`` signs of ``b``, in one pass."""
    places: dict[str, int] = {}
    for i, sign in enumerate(a):
        places[sign] = places.get(sign, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    out = []
    for sign in b[:count]:
        hit = row & places.get(sign, 0)
        row = (row + hit | row - hit) & full
        out.append(len(a) - row.bit_count())
    return out


def _partial(short: str, long: str, best: float) -> float:
    """The best ratio of ``short`` against windows of its length in ``long``, cut off at both ends; ``best`` if none is better."""
    n, m = len(short), len(long)
    for common in (_beginnings(short, long, n), _beginnings(short[::-1], long[::-1], n)):
        best = max(best, *(200.0 * c / (n + k) for k, c in enumerate(common, 1)))
    if m > n + 1 and 100.0 * common_length(short, long) / n > best:  # no window shares more than the whole does
        for start in range(1, m - n):
            best = max(best, ratio(short, long[start : start + n]))
    return best


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """The best ratio of the shorter text against any stretch of the longer one; ``floor`` if that is not reached."""
    if not a or not b:
        return 100.0 if a == b else floor
    if len(a) == len(b):
        return _partial(b, a, _partial(a, b, floor))
    return _partial(*sorted((a, b), key=len), floor)


#: Texts of at most this many signs have a bit for each place in one machine word.
PLACES = 64
#: Pairs taken through the steps at a time.
_TOGETHER = 1 << 13


def _signs(texts: list[str]) -> np.ndarray:
    """The signs of each text in a row of ``PLACES``, filled up with zeros."""
    return np.array(texts, dtype=f"<U{PLACES}").view(np.uint32).reshape(len(texts), PLACES)


def _many_beginnings(a: np.ndarray, sizes: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """``_beginnings`` for each row of sign matrices: common lengths with the first 1, 2, ... ``steps`` signs of ``b``."""
    width = int(sizes.max())
    bits = np.uint64(1) << np.arange(width, dtype=np.uint64)
    full = np.uint64((1 << 64) - 1) >> (PLACES - sizes).astype(np.uint64)
    row = full.copy()
    out = np.empty((len(a), steps), dtype=np.int64)
    for j in range(steps):
        hit = ((a[:, :width] == b[:, j, None]) * bits).sum(axis=1, dtype=np.uint64) & row
        row = (row + hit | row - hit) & full
        out[:, j] = sizes - np.bitwise_count(row)
    return out


def _many_partial(shorts: list[str], longs: list[str]) -> np.ndarray:
    """``_partial`` with no floor for many pairs of texts of 1 to ``PLACES`` signs."""
    n, m = (np.array([len(x) for x in side]) for side in (shorts, longs))
    a, b = _signs(shorts), _signs(longs)
    most = int(m.max())
    common = _many_beginnings(a, n, b, most)
    whole = common[np.arange(len(n)), m - 1]
    steps = int(n.max())
    k = np.arange(1, steps + 1)
    inside = k <= n[:, None]
    best = np.zeros(len(n))
    for part in (common[:, :steps], _many_beginnings(_signs([x[::-1] for x in shorts]), n, _signs([x[::-1] for x in longs]), steps)):
        best = np.maximum(best, np.where(inside, 200.0 * part / (n[:, None] + k), 0.0).max(axis=1))
    # windows in the middle share no more than the whole does
    starts = np.where((m > n + 1) & (100.0 * whole / n > best), m - n - 1, 0)
    row = np.repeat(np.arange(len(n)), starts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + 1
    for at in range(0, len(row), _TOGETHER):
        r, s = row[at : at + _TOGETHER], start[at : at + _TOGETHER]
        steps = int(n[r].max())
        window = np.take_along_axis(b[r], np.minimum(s[:, None] + np.arange(steps), PLACES - 1), axis=1)
        shared = _many_beginnings(a[r], n[r], window, steps)[np.arange(len(r)), n[r] - 1]
        np.maximum.at(best, r, 200.0 * shared / (2 * n[r]))
    return best


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """``partial_ratio`` of many pairs: those of short texts take each step together, the others one by one."""
    out = np.zeros(len(pairs))
    asked: list[tuple[int, str, str]] = []
    for i, (a, b) in enumerate(pairs):
        if not 0 < min(len(a), len(b)) <= max(len(a), len(b)) <= PLACES:
            out[i] = partial_ratio(a, b)
            continue
        asked.append((i, a, b) if len(a) <= len(b) else (i, b, a))
        if len(a) == len(b):
            asked.append((i, b, a))
    for at in range(0, len(asked), _TOGETHER):
        places, shorts, longs = zip(*asked[at : at + _TOGETHER], strict=True)
        np.maximum.at(out, np.array(places), _many_partial(list(shorts), list(longs)))
    return out.tolist()


_SPLIT = re.compile(r"[\s\-–—]+").split
_ARTICLE = re.compile(rf"^\s*{ARABIC_ARTICLE}[\s\-_:]*")
_has_arabic = re.compile(ARABIC_RANGES).search


@lru_cache(maxsize=1 << 16)
def without_localities(text: str) -> str:
    bare = ((word, word.removeprefix(ARABIC_ARTICLE)) for word in _SPLIT(text) if word)
    return " ".join(b for w, b in bare if w not in LOCALITY_WORDS and b not in LOCALITY_WORDS)


@lru_cache(maxsize=1 << 16)
def without_article(text: str) -> str:
    return _ARTICLE.sub("", text)


@lru_cache(maxsize=1 << 16)
def latin_words(text: str) -> tuple[str, ...]:
    words = (word.removeprefix(ARABIC_ARTICLE) for word in _SPLIT(text) if word)
    return tuple(x for x in (latin(without_localities(w) or w).lower() for w in words) if x)


def word_score(english: str, arabic: str, partial: Callable[[str, str, float], float] = partial_ratio) -> float:
    """The best score of the English name against any one word of the Arabic name in Latin letters."""
    best = 0.0
    for word in latin_words(arabic):
        if word == english:
            return 100.0
        best = max(best, token_set_ratio(english, word))
        best = partial(english, word, best)
    return best


def script_score(a: str, b: str) -> float:
    """Two names in Arabic script: as they are, without locality words, and without the article on either side."""
    best = token_set_ratio(a, b)
    x, y = without_localities(a), without_localities(b)
    if x and y:
        best = max(best, token_set_ratio(x, y))
    a_bare, b_bare = without_article(a), without_article(b)
    if a_bare != a:
        best = max(best, token_set_ratio(a_bare, b))
    if b_bare != b:
        best = max(best, token_set_ratio(a, b_bare))
    if a_bare != a and b_bare != b:
        best = max(best, token_set_ratio(a_bare, b_bare))
    return best


def latin_score(english: str, english_bare: str, arabic: str, by_word: bool, bare_forms: bool, partial: Callable[[str, str, float], float] = partial_ratio) -> float:
    """An English name against an Arabic one in Latin letters; ``bare_forms`` also tries both without articles."""
    tries = [(english, latin(arabic).lower())]
    stripped = without_localities(arabic)
    if stripped:
        tries.append((english, latin(stripped).lower()))
    if bare_forms:
        bare = latin(without_article(arabic)).lower()
        tries.append((english, bare))
        if english_bare and english_bare != english:
            tries += [(english_bare, tries[0][1]), (english_bare, bare)]
    best = max(token_set_ratio(a, b) for a, b in dict.fromkeys(tries))
    return max(best, word_score(english, arabic, partial)) if by_word else best


def phrase_score(phrases: list[str], arabic: str) -> tuple[str, float]:
    """The best phrase in Arabic script for an Arabic name and its score; the first of equal ones."""
    via, best = "", 0.0
    for phrase in phrases:
        if _has_arabic(phrase):
            score = script_score(arabic, phrase.strip())
            if score > best:
                via, best = phrase.strip(), score
    return via, best


def pair_scores(rows: list[tuple[str, str, list[str], str, bool]]) -> list[tuple[str, float]]:
    """The best phrase and score of each (English name, without article, phrases, Arabic name, by word).

    Where no phrase scores, names meet in Latin letters; the ratios of single words are worked out
    together for all rows.
    """
    found = [phrase_score(phrases, arabic) for _, _, phrases, arabic, _ in rows]
    asked = {(r[0], word): 0.0 for r, (_, best) in zip(rows, found, strict=True) if r[4] and best <= 0 for word in latin_words(r[3])}
    asked = dict(zip(asked, partial_ratios(list(asked)), strict=True))

    def partial(a: str, b: str, floor: float) -> float:
        return max(floor, asked[a, b])

    out = []
    for (english, bare, phrases, arabic, by_word), (via, best) in zip(rows, found, strict=True):
        if best <= 0:
            via, best = "" if phrases else latin(arabic), latin_score(english, bare, arabic, by_word, not phrases, partial)
        out.append((via, best))
    return out


def pair_score(english: str, english_bare: str, phrases: list[str], arabic: str, by_word: bool) -> tuple[str, float]:
    """``pair_scores`` of one row."""
    return pair_scores([(english, english_bare, phrases, arabic, by_word)])[0]


def _series(kernel: Callable[[str, str], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(kernel(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


KERNELS = {"indel_ratio": ratio, "token_set_ratio": token_set_ratio, "partial_ratio": partial_ratio, "script_score": script_score, "word_score": word_score}


def similarity(name: str, a: Column, b: Column) -> Column:
    """A fuzzy ratio by name, over Arrow batches; null where either side is."""
    run = _series(KERNELS[name])
    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())(a, b)


def register(spark: SparkSession) -> None:
    """Make the ratios callable from SQL under their names."""
    for name, kernel in KERNELS.items():
        run = _series(kernel)
        run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
        spark.udf.register(name, F.pandas_udf(run, T.DoubleType()))


@F.pandas_udf(T.StructType([T.StructField("via", T.StringType()), T.StructField("score", T.DoubleType())]))
def scored(english: pd.Series, english_bare: pd.Series, phrases: pd.Series, arabic: pd.Series, by_word: pd.Series) -> pd.DataFrame:
    rows = [(e, b, [] if p is None else list(p), a, bool(w)) for e, b, p, a, w in zip(english, english_bare, phrases, arabic, by_word, strict=True)]
    return pd.DataFrame(pair_scores(rows), columns=["via", "score"])
