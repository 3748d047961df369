"""The matchers' scores of names against names of the same district, without a row for every pair.

A task gets a block of names with about ``FOUND`` candidates, scores them in memory and gives back only what is asked
for: the best of each name, those at a threshold, or those that can be the first free one. Names without a phrase in
Arabic script meet the candidates in Latin letters. Their ratios of whole texts follow from the longest common
subsequences, which texts with a common beginning share (``Tree.common``). A ratio of single words is worked out only
where its bound reaches what is asked for: a stretch that shares at most L signs with n has at most 200 L / (n + L).
Pairs with a word in common, and names with Arabic phrases, are scored one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from toponexus.deploy import ship
from toponexus.functions import similarity, text
from toponexus.functions.name_tree import PLACES, Tree

#: Names and candidates that a task compares at a time, and names whose pairs are scored one by one.
ASKED, FOUND, ALONE = 512, 1 << 16, 16
PARTS = ["district_en", "asked_part", "found_part"]
#: Names taken together, candidates of each that give the first bound, and pairs scored at a time.
_TOGETHER, _FIRST, _PAIRS = 32, 32, 1 << 14
#: Bounds and scores are rounded differently; this is far above the one and below any step of the other.
_SLACK = 1e-9


def sorted_words(x: str) -> str:
    """The distinct words in order; texts without a common word have the ratio of these as their token set ratio."""
    return " ".join(sorted(set(x.split())))


class _Lists:
    """For each candidate some of the texts, by number; ``flat`` has them one after the other."""

    def __init__(self, lists: list[list[int]], nothing: int) -> None:
        lists = [x or [nothing] for x in lists]
        sizes = np.array([len(x) for x in lists])
        self.flat = np.array([i for x in lists for i in x], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.single = len(self.flat) == len(lists)

    def greatest(self, values: np.ndarray) -> np.ndarray:
        """The greatest of the values of each candidate's texts, given in the order of ``flat``."""
        return values if self.single else np.maximum.reduceat(values, self.starts)

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``places``, text) for all texts of these candidates."""
        sizes = self.sizes[places]
        which = np.repeat(np.arange(len(places)), sizes)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.flat[self.starts[places][which] + inner]


class Candidates:
    """Candidate names, prepared for the scores of many English names."""

    def __init__(self, names: list[str], by_word: bool) -> None:
        self.names, self.by_word = names, by_word
        numbers: dict[str, int] = {}
        wholes, words = [], []
        self.with_word: dict[str, list[int]] = {}
        for at, name in enumerate(names):
            if name.isascii() and "-" not in name and name.split() == [name]:  # one word, and nothing to put into Latin letters
                word = name.lower()
                wholes.append([numbers.setdefault(word, len(numbers))])
                words.append(wholes[-1] if by_word else [])
                self.with_word.setdefault(word, []).append(at)
                continue
            stripped = similarity.without_localities(name)
            forms = [similarity.latin(x).lower() for x in ((name, stripped) if stripped else (name,))]
            own = similarity.latin_words(name) if by_word else ()
            wholes.append([numbers.setdefault(x, len(numbers)) for x in dict.fromkeys(sorted_words(x) for x in forms)])
            words.append([numbers.setdefault(x, len(numbers)) for x in dict.fromkeys(own)])
            for word in {*own, *(w for x in forms for w in x.split())}:
                self.with_word.setdefault(word, []).append(at)
        self.texts = list(numbers)
        self.tree = Tree(self.texts)
        self.sizes = np.array([len(x) for x in self.texts], dtype=np.int64)
        self.kinds, self.kind = np.unique(self.sizes, return_inverse=True)
        nothing = len(self.texts)
        self.all = _Lists([a if a is b else list(dict.fromkeys(a + b)) for a, b in zip(wholes, words, strict=True)], nothing)
        self.words = _Lists(words, nothing)
        self.same = np.array_equal(self.all.flat, self.words.flat)
        # signs of the words, in the tree's numbers
        self.signs = np.zeros((len(self.texts), 0), dtype=np.int64)
        at = np.unique(self.words.flat)
        at = at[at < nothing]
        at = at[self.sizes[at] <= PLACES]
        if len(at):
            width = int(self.sizes[at].max())
            signs = np.array([self.texts[i] for i in at.tolist()], dtype=f"<U{width}").view(np.uint32).reshape(len(at), width)
            self.signs = np.zeros((len(self.texts), width), dtype=np.int64)
            self.signs[at] = np.searchsorted(np.array([ord(x) for x in self.tree.codes], dtype=np.uint32), signs)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _tables(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For names of this size, by size of the text and signs in common, the last for no text at all: the token set ratio, its order, and the bound of partial ratios.

        Ratios are those of texts without a word in common, as ``similarity.token_set_ratio`` gives them.
        """
        if size not in self.tables:
            common, other = np.arange(size + 1), self.kinds[:, None]
            total = size + other
            ratios = np.append((100.0 - 100.0 * (total - 2 * common) / total).ravel(), 0.0)
            bounds = np.append((200.0 * common / np.maximum(np.minimum(size, other) + common, 1)).ravel(), 0.0)
            self.tables[size] = ratios, np.argsort(-ratios, kind="stable"), bounds
        return self.tables[size]

    def _cells(self, common: np.ndarray, size: int, lists: _Lists) -> np.ndarray:
        """The places in the tables of all texts of ``lists``."""
        cells = np.append(self.kind * (size + 1) + common, len(self.kinds) * (size + 1))
        return cells[lists.flat]

    def scores(self, names: list[str], k: int | None, threshold: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each name (lower case, with a word) places of candidates in order, and their scores: the ``k`` best and all at the threshold at least, or all if ``k`` is none."""
        for at in range(0, len(names), _TOGETHER):
            some = names[at : at + _TOGETHER]
            ordered = [sorted_words(x) for x in some]
            common = self.tree.common(ordered)
            others = [i for i, x in enumerate(some) if self.by_word and x != ordered[i]]
            unordered = dict(zip(others, self.tree.common([some[i] for i in others]), strict=True)) if others else {}
            values, cells, known, first, leasts = [], [], [], [], []
            for i, name in enumerate(some):
                ratios, order, _ = self._tables(len(ordered[i]))
                own = self._cells(common[i], len(ordered[i]), self.all)
                found = self.all.greatest(ratios[own])
                shared = self._shared(name, found)
                values.append(found)
                known.append(shared)
                first.append(_front(found, None if shared or not self.all.single else own, ratios, order, max(_FIRST, k or 0)))
                if self.by_word:
                    cells.append(own if self.same and i not in unordered else self._cells(unordered.get(i, common[i]), len(name), self.words))
            if self.by_word:
                self._raise(some, values, first)
            for found, own in zip(values, first, strict=True):
                leasts.append(-np.inf if k is None else min(_kth(found[own], k, len(found)), np.inf if threshold is None else threshold))
            if self.by_word:
                rest = []
                for i, least in enumerate(leasts):
                    open_ = self.words.greatest((self._tables(len(some[i]))[2] >= least - _SLACK)[cells[i]])
                    open_[first[i]] = False
                    open_[known[i]] = False
                    rest.append(np.flatnonzero(open_))
                self._raise(some, values, rest)
            for found, least in zip(values, leasts, strict=True):
                places = np.flatnonzero(found >= least)
                yield places, found[places]

    def _shared(self, name: str, values: np.ndarray) -> list[int]:
        """Candidates with a word of ``name``, their scores put into ``values``. Its phrases do not matter, only that there are some."""
        places = sorted({at for word in set(name.split()) for at in self.with_word.get(word, ())})
        for at in range(0, len(places), _PAIRS):
            part = places[at : at + _PAIRS]
            values[part] = [score for _, score in similarity.pair_scores([(name, name, ["-"], self.names[i], self.by_word) for i in part])]
        return places

    def _raise(self, names: list[str], values: list[np.ndarray], places: list[np.ndarray]) -> None:
        """Raise the ``values`` of some places of each name to the ratios of single words."""
        who = np.repeat(np.arange(len(names)), [len(x) for x in places])
        where = np.concatenate(places).astype(np.int64)
        which, word = self.words.of(where)
        real = word < len(self.texts)
        which, word = which[real], word[real]
        if not len(word):
            return
        best = np.zeros(len(word))
        sizes = np.array([len(x) for x in names])
        n, m = sizes[who[which]], self.sizes[word]
        kinds, kind = np.unique(n * (1 << 32) + m, return_inverse=True)
        short = [x if len(x) <= PLACES else "" for x in names]
        sides = [(self.tree.held(short), False), (self.tree.held([x[::-1] for x in short]), True)]
        for number, both in enumerate(kinds.tolist()):
            at = np.flatnonzero(kind == number)
            size, other = both >> 32, both & ((1 << 32) - 1)
            if max(size, other) > PLACES:
                best[at] = similarity.partial_ratios([(names[who[which[i]]], self.texts[word[i]]) for i in at])
                continue
            for begin in range(0, len(at), _PAIRS):
                part = at[begin : begin + _PAIRS]
                best[part], more = self._partial(sides, who[which[part]], word[part], size, other)
                if len(more):
                    best[part[more]] = similarity.partial_ratios([(names[who[which[i]]], self.texts[word[i]]) for i in part[more]])
        raised = np.zeros(len(where))
        np.maximum.at(raised, which, best)
        ends = np.cumsum([len(x) for x in places])
        for i, (end, own) in enumerate(zip(ends, places, strict=True)):
            values[i][own] = np.maximum(values[i][own], raised[end - len(own) : end])

    def _partial(self, sides: list[tuple[np.ndarray, bool]], who: np.ndarray, word: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """``similarity.partial_ratio`` of names of ``n`` signs with words of ``m``, and the places of those for which stretches in the middle matter too."""
        best = np.zeros(len(who))
        signs = np.ascontiguousarray(self.signs[word, :m].T)
        for held, backwards in sides:
            kind = held.dtype.type
            flat, base = held.ravel(), who * held.shape[1]
            full = kind((1 << n) - 1)
            row = np.full(len(who), full)
            for k, sign in enumerate(signs[::-1] if backwards else signs, 1):
                hit = flat[base + sign]
                hit &= row
                more = row + hit
                row -= hit
                row |= more
                row &= full
                if k <= n <= m:
                    np.maximum(best, (200.0 * np.arange(n, -1, -1) / (n + k))[np.bitwise_count(row)], out=best)
            if m <= n:
                for k in range(1, m + 1):
                    np.maximum(best, (200.0 * np.arange(k, -1, -1) / (m + k))[np.bitwise_count(row & kind((1 << k) - 1))], out=best)
        shorter = min(n, m)
        whole = n - np.bitwise_count(row).astype(np.int64)
        middle = (100.0 * whole / shorter > best) if abs(n - m) > 1 else np.zeros(len(best), dtype=bool)
        return best, np.flatnonzero(middle)


def _front(values: np.ndarray, cells: np.ndarray | None, table: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of ``k`` of the greatest values, all if there are no more; ``cells`` are their places in ``table``, if they come from it as they are."""
    if len(values) <= k:
        return np.arange(len(values))
    if cells is None:
        least = np.partition(values, len(values) - k)[len(values) - k]
    else:
        least = table[order[np.searchsorted(np.cumsum(np.bincount(cells, minlength=len(table))[order]), k)]]
    places = np.flatnonzero(values >= least)
    over = values[places] > least
    return np.concatenate([places[over], places[~over][: k - int(over.sum())]])


def _kth(values: np.ndarray, k: int, of: int) -> float:
    """The ``k``-th greatest of the values, some ``of`` more; none if there are not more than ``k`` in all."""
    return -np.inf if of <= k else float(np.partition(values, len(values) - k)[len(values) - k])


def _search(names: DataFrame, candidates: DataFrame, by_word: bool, k: int | None, threshold: float | None, pick: Callable, carried: tuple[str, ...] = ()) -> DataFrame:
    """Rows (row_id, name, district_en, cand, cand_ord, via, score).

    ``pick`` gets scores in order of cand_ord, those that ``k`` and ``threshold`` ask for (see ``Candidates.scores``) among them, and
    the ``carried`` columns of these candidates, and gives the places of the rows to return.
    """
    spark = names.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    left = names.select("row_id", "name", F.col("district").alias("district_en"), "phrases", text.name_key(F.col("name")).alias("key"), text.name_key(text.drop_latin_article(text.strip(F.col("name")))).alias("bare"))
    left = left.withColumn("alone", F.coalesce((F.size("phrases") == 0) | F.exists("phrases", text.has_arabic), F.lit(True)))
    right = candidates.select("district_en", "cand", "cand_ord", text.strip(F.col("cand")).alias("text"), *carried)
    count = lambda alone, most: F.ceil(F.count(F.when(F.col("alone") == alone, 1)) / most).cast("int")
    asked_parts = left.groupBy("district_en").agg(count(False, ASKED).alias("together"), count(True, ALONE).alias("apart"))
    parts = asked_parts.join(right.groupBy("district_en").agg(F.ceil(F.count(F.lit(1)) / FOUND).cast("int").alias("found_parts")), "district_en")
    every = lambda most: F.explode(F.sequence(F.lit(0), most - 1))
    dealt = F.xxhash64("row_id")
    own = F.when(F.col("alone"), F.col("together") + F.pmod(dealt, F.greatest("apart", F.lit(1)))).otherwise(F.pmod(dealt, F.greatest("together", F.lit(1))))
    left = left.join(parts, "district_en").withColumn("asked_part", own.cast("int")).withColumn("found_part", every(F.col("found_parts"))).drop("together", "apart", "found_parts")
    right = right.join(parts, "district_en").withColumn("found_part", F.pmod(F.xxhash64("cand"), "found_parts").cast("int"))
    right = right.withColumn("asked_part", every(F.col("together") + F.col("apart"))).drop("together", "apart", "found_parts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.take(pc.sort_indices(right["cand_ord"])).combine_chunks()
        texts, extra = right["text"].to_pylist(), [right[c].to_numpy() for c in carried]
        rows = list(zip(*(left[c].to_pylist() for c in ("key", "bare", "phrases", "alone")), strict=True))
        who, where, scores, vias = [], [], [], []

        def take(i: int, places: np.ndarray, values: np.ndarray, via: list[str] | None) -> None:
            kept = pick(values, *(x[places] for x in extra))
            who.append(np.full(len(kept), i))
            where.append(places[kept])
            scores.append(values[kept])
            vias.extend([""] * len(kept) if via is None else [via[x] for x in kept.tolist()])

        together = [i for i, (key, _, _, alone) in enumerate(rows) if not alone and key.split()] if texts else []
        if together:
            for i, (places, values) in zip(together, Candidates(texts, by_word).scores([rows[i][0] for i in together], k, threshold), strict=True):
                take(i, places, values, None)
        for i in sorted(set(range(len(rows))).difference(together)) if texts else []:
            key, bare, phrases, _ = rows[i]
            found = [x for at in range(0, len(texts), _PAIRS) for x in similarity.pair_scores([(key, bare, phrases, y, by_word) for y in texts[at : at + _PAIRS]])]
            take(i, np.arange(len(texts)), np.array([score for _, score in found]), [via for via, _ in found])
        who, where, scores = (np.concatenate(x) if x else np.empty(0, dtype=kind) for x, kind in ((who, np.int64), (where, np.int64), (scores, np.float64)))
        out = [left[c].take(pa.array(who)) for c in ("row_id", "name", "district_en")] + [right[c].take(pa.array(where)) for c in ("cand", "cand_ord")]
        return pa.table([*out, pa.array(vias, pa.string()), pa.array(scores, pa.float64())], names=["row_id", "name", "district_en", "cand", "cand_ord", "via", "score"])

    schema = T.StructType([*(left.schema[c] for c in ("row_id", "name", "district_en")), *(right.schema[c] for c in ("cand", "cand_ord")), T.StructField("via", T.StringType()), T.StructField("score", T.DoubleType())])
    return left.repartition(tasks, *PARTS).groupBy(*PARTS).cogroup(right.repartition(tasks, *PARTS).groupBy(*PARTS)).applyInArrow(run, schema)


def best(names: DataFrame, candidates: DataFrame, by_word: bool, k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` best candidates of each name, equal ones by cand_ord, and all at the threshold if there is one."""

    def pick(values: np.ndarray) -> np.ndarray:
        order = np.argsort(-values, kind="stable")
        return order[: max(k, 0 if threshold is None else int((values >= threshold).sum()))]

    found = _search(names, candidates, by_word, k, threshold, pick)
    # each task that has some of a name's candidates gives the best of those
    rank = F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("score"), "cand_ord"))
    reached = F.lit(False) if threshold is None else F.col("score") >= threshold
    return found.withColumn("rn", rank).where((F.col("rn") <= k) | reached).drop("rn")


def first_free(names: DataFrame, candidates: DataFrame, by_word: bool) -> DataFrame:
    """The candidates of each name that can be the first free one of any row, by the column owner_ord of ``candidates``.

    As ``assignment.steps``: one taken by no later row than one ranked before it is not; nothing takes those without an owner.
    """

    def pick(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.argsort(-values, kind="stable")
        until = np.maximum.accumulate(owner[order])
        return order[np.append(True, until[1:] > until[:-1])[: len(order)]]

    free = candidates.withColumn("owner_ord", F.coalesce(F.col("owner_ord").cast("long"), F.lit((1 << 63) - 1)))
    return _search(names, free, by_word, None, None, pick, ("owner_ord",))
