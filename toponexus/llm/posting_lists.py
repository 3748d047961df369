"""Approximate nearest neighbours by balanced posting lists.

*Fit*: a bounded sample is bisected again and again at the median of the two distances, so that the
leaves, whose means are the centroids, hold equally many vectors. A graph over the centroids finds
those nearest to any vector by best-first search in memory.
*Index*: every vector goes to its nearest centroid's list, and boundary vectors also to lists almost
as near. (The usual further rule, to skip a list whose centroid is nearer to a chosen one's than to
the vector, leaves one copy of nearly every vector in 64 dimensions and is not applied.)
*Search*: a query reads the lists whose distance is within a ratio of the nearest list's, so easy
queries read few and hard ones many.

The largest inner product is searched as the least distance after one more coordinate is added to
the vectors, which gives all of them the same length. Equal vectors are indexed once, with as many
of their least ids as an answer can need. Neighbouring lists form groups, and a vector or query goes to a group
once, with the lists that it is in or reads there. Groups, and the queries to a group, are cut into
blocks, so a task's work has a bound whatever a list's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from toponexus.llm import storage


@dataclass
class Settings:
    """Bounds and thresholds of fit, index and search."""

    #: Vectors that a list is meant to hold, and the number of lists at most; beyond it lists grow with the table.
    list_size: int = 8
    most_lists: int = 16_384
    #: Vectors that a centroid is fitted on, so ``most_lists`` times as many are gathered at most.
    fitted: int = 4
    #: Copies of a boundary vector at most, and how much farther than the nearest a list may be.
    copies: int = 4
    boundary: float = 0.2
    #: Lists that every query reads, so that a table of few lists is searched exactly; lists that it reads at most, as
    #: a multiple of the root of their number; and how much farther than the nearest these may be. With as many
    #: ``probes`` as there are lists the search is exact at any size.
    probes: int = 48
    probes_by_root: float = 7.0
    ratio: float = 0.5
    #: Neighbours of a centroid in the graph, and the candidates that a search keeps.
    degree: int = 24
    beam: int = 64
    #: Lists next to one another in the bisection that are kept together: a query is sent once to all of them.
    together: int = 256
    #: Vectors, and queries, of such a group of lists that one task compares at once.
    block: int = 16_384

    def lists(self, rows: int) -> int:
        return int(min(self.most_lists, max(1, rows // self.list_size)))

    def most_probes(self, lists: int) -> int:
        return int(min(lists, max(self.probes, round(self.probes_by_root * lists**0.5))))


class Centroids:
    """Centroids, and the graph that finds the nearest."""

    def __init__(self, sample: np.ndarray, count: int, settings: Settings, seed: int = 11):
        rng = np.random.default_rng(seed)
        leaves = [sample]
        while 2 * len(leaves) <= count and max(len(x) for x in leaves) > 1:
            leaves = [part for leaf in leaves for part in self._halves(leaf, rng)]
        self.points = np.array([leaf.mean(axis=0) for leaf in leaves])
        self.squares = (self.points**2).sum(axis=1)
        n, degree = len(self.points), min(settings.degree, len(self.points) - 1)
        near = np.empty((n, degree), dtype=np.int32)
        for a in range(0, n, 256):
            apart = self._distances(self.points[a : a + 256], np.arange(n))
            apart[np.arange(len(apart)), np.arange(a, a + len(apart))] = np.inf
            near[a : a + 256] = np.argpartition(apart, max(0, degree - 1), axis=1)[:, :degree]
        # some links at random, so that no part of the graph is cut off
        links = np.concatenate([near, rng.integers(0, n, (n, 4), dtype=np.int32)], axis=1)
        #: The last row is that of no centroid, which leads to itself.
        self.links = np.concatenate([links, np.full((1, links.shape[1]), n, dtype=np.int32)])
        self.entries = np.unique(rng.integers(0, n, 8, dtype=np.int32))

    @staticmethod
    def _halves(leaf: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        if len(leaf) < 2:
            return [leaf]
        ends = leaf[rng.choice(len(leaf), 2, replace=False)].astype(np.float64)
        for _ in range(8 if len(leaf) > 64 else 3):
            side = leaf @ (ends[1] - ends[0])
            second = np.zeros(len(leaf), dtype=bool)
            second[np.argsort(side, kind="stable")[len(leaf) // 2 :]] = True
            new = np.array([leaf[~second].mean(axis=0), leaf[second].mean(axis=0)])
            if np.allclose(new, ends):
                break
            ends = new
        return [leaf[~second], leaf[second]]

    def _distances(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.maximum((vectors**2).sum(axis=1)[:, None] - 2 * vectors @ self.points[which].T + self.squares[which], 0)

    def nearest(self, vectors: np.ndarray, want: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids nearest to each vector, with distances: best-first search over the graph, many vectors at once."""
        beam = min(max(beam, want), len(self.points))
        rows = max(16, 1 << 15 // beam)
        parts = [self._search(vectors[a : a + rows], beam) for a in range(0, max(1, len(vectors)), rows)]
        want = min(want, beam)
        return np.concatenate([ids[:, :want] for ids, _ in parts]), np.sqrt(np.concatenate([far[:, :want] for _, far in parts]))

    def _search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids and squared distances; an eighth of the beam is followed at a time."""
        n, total = len(vectors), len(self.points)
        step = max(1, beam // 8)
        own = (vectors**2).sum(axis=1)
        ids = np.full((n, beam), -1, dtype=np.int32)
        far = np.full((n, beam), np.inf)
        opened = np.zeros((n, beam), dtype=bool)
        seen = np.zeros((n, total + 1), dtype=bool)
        seen[:, total] = True  # stands for no centroid
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        rows = np.arange(n)
        while len(rows):
            at = rows[:, None]
            fresh = np.sort(fresh, axis=1)
            new = ~seen[at, fresh]
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]  # links to one centroid twice count once
            seen[at, fresh] = True
            who, what = np.nonzero(new)
            found = fresh[who, what]
            dist = np.full(fresh.shape, np.inf)
            dist[who, what] = np.maximum(own[rows[who]] - 2 * np.einsum("kd,kd->k", vectors[rows[who]], self.points[found]) + self.squares[found], 0)
            all_far = np.concatenate([far[rows], dist], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[rows] = np.take_along_axis(all_far, best, axis=1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], fresh], axis=1), best, axis=1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], np.zeros_like(new)], axis=1), best, axis=1)
            waiting = ~opened[rows] & np.isfinite(far[rows])
            some = waiting.any(axis=1)
            rows, waiting = rows[some], waiting[some]
            waiting &= np.cumsum(waiting, axis=1) <= step
            opened[rows] |= waiting
            held = np.sort(np.where(waiting, np.arange(beam), beam), axis=1)[:, :step]
            chosen = np.where(held < beam, np.take_along_axis(ids[rows], np.minimum(held, beam - 1), axis=1), total)
            fresh = self.links[chosen].reshape(len(rows), chosen.shape[1] * self.links.shape[1])
        return ids, far

    def lists(self, vectors: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs of the index: the nearest list, and others for boundary vectors."""
        ids, far = self.nearest(vectors, settings.copies, settings.beam)
        who, nth = np.nonzero((far <= (1 + settings.boundary) * far[:, :1]) & (ids >= 0))
        return who, ids[who, nth]

    def probes(self, queries: np.ndarray, settings: Settings, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) pairs to search, by the ratio of distances, but ``probes`` lists and lists of ``least`` entries together at least."""
        ids, far = self.nearest(queries, settings.most_probes(len(self.points)), settings.beam)
        held = np.where(ids >= 0, sizes[ids], 0)
        before = np.cumsum(held, axis=1) - held
        always = np.arange(ids.shape[1]) < settings.probes
        who, nth = np.nonzero(((far <= (1 + settings.ratio) * far[:, :1]) | (before < least) | always) & (ids >= 0))
        return who, ids[who, nth]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v, size, square) whose vector is not null, zero or holding null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return fine.select("id", "v", F.size("v").alias("size"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("square")).where("square > 0")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), size)


def _place(centroids: Centroids, settings: Settings, length: float, size: int, lists_read: tuple[np.ndarray, int] | None = None):
    """Rows (part, id, v, lists) for vectors (id, v), or for queries, given the sizes of lists and the entries to read at least.

    A row for each group of lists that a vector is in, or a query reads, with those lists; v as little-endian doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                vectors = _matrix(part.column(1), size)
                squares = (vectors**2).sum(axis=1)
                if lists_read:  # a query's length does not change its order of answers
                    wide = np.concatenate([vectors * (length / np.sqrt(squares))[:, None], np.zeros((len(vectors), 1))], axis=1)
                    who, lists = centroids.probes(wide, settings, *lists_read)
                else:
                    wide = np.concatenate([vectors, np.sqrt(np.maximum(length**2 - squares, 0))[:, None]], axis=1)
                    who, lists = centroids.lists(wide, settings)
                order = np.lexsort((lists, who))
                who, lists = who[order], lists[order].astype(np.int32)
                groups = lists // settings.together
                new = np.ones(len(who), dtype=bool)
                new[1:] = (who[1:] != who[:-1]) | (groups[1:] != groups[:-1])
                first = np.flatnonzero(new)
                raw = [x.tobytes() for x in vectors]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(groups[first], pa.int32()),
                        part.column(0).take(pa.array(who[first])),
                        pa.array([raw[i] for i in who[first].tolist()], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.append(first, len(who)).astype(np.int32)), pa.array(lists)),
                    ],
                    ["part", "id", "v", "lists"],
                )

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of components, so that equal pairs give equal sums."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _members(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(list, row) for the lists of each row."""
    sizes = frame["lists"].map(len).to_numpy()
    return np.concatenate(frame["lists"].to_list()), np.repeat(np.arange(len(frame)), sizes)


def _best(size: int, keep: int):
    """The ``keep`` best vectors of a block for each query of a block, list by list."""

    def run(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            q, x = (np.frombuffer(b"".join(frame["v"]), dtype="<f8").reshape(-1, size) for frame in (queries, vectors))
            ids, owners = vectors["id"].to_numpy(), queries["id"].to_numpy()
            (asked, asker), (held, holder) = _members(queries), _members(vectors)
            for a in range(0, len(q), 256):
                near = np.full((len(q[a : a + 256]), len(x)), -np.inf)
                some = (asker >= a) & (asker < a + 256)
                for number in np.unique(asked[some]).tolist():
                    rows, columns = asker[some & (asked == number)], holder[held == number]
                    near[np.ix_(rows - a, columns)] = q[rows] @ x[columns].T
                read = np.isfinite(near)
                if near.shape[1] > keep:  # what rounding could put among the best is summed again
                    least = np.partition(near, -keep, axis=1)[:, -keep]
                    read &= near >= (least - 1e-9 * np.abs(np.where(read, near, 0)).max(axis=1))[:, None]
                who, what = np.nonzero(read)
                score = products(q[a + who], x[what])
                order = np.lexsort((ids[what], -score, who))
                who, what, score = who[order], what[order], score[order]
                nth = np.arange(len(who)) - np.searchsorted(who, who)
                best = nth < keep
                out.append(pd.DataFrame({"query": owners[a + who[best]], "id": ids[what[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, dtype=np.int64), "id": np.zeros(0, dtype=np.int64), "score": np.zeros(0)})

    return run


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, settings: Settings | None = None) -> DataFrame:
    """The ``k`` nearest rows by inner product for each row of ``vectors`` where ``is_query`` (a column over its id, named id) holds.

    Returns query_id, rank (from 1), vec_id and score (the inner product of the original vectors in
    double precision), nearest first, ties to the smaller id; a query's own id is no answer. Null
    ids, and vectors that are null, empty, zero, or hold null or non-finite components, take no part;
    nor do vectors of another size than the most frequent one. Rows that share id and vector count
    once; where an id has several vectors, each is a candidate. Other columns are not read. Fewer
    candidates than ``k`` give fewer rows, and an empty table an empty result.
    """
    settings = settings or Settings()
    spark = vectors.sparkSession
    rows = usable(storage.small_batches(vectors), id_col, vector_col)
    shape = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], schema)
    size, length = shape["size"], float(np.sqrt(shape["square"]))
    rows = rows.where(F.col("size") == size).select("id", "v")
    count = settings.lists(shape["n"])
    wanted = count * settings.fitted
    # of the least hashes only a few times as many rows as are wanted are ranked, however many there are
    most = int(-(2**63) + 4 * wanted / shape["n"] * (2**64 - 1)) if shape["n"] > 4 * wanted else 2**63 - 1
    fitted = rows.where(F.xxhash64("id") <= most).orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow()
    sample = _matrix(fitted.column(0).combine_chunks(), size)
    wide = np.concatenate([sample, np.sqrt(np.maximum(length**2 - (sample**2).sum(axis=1), 0))[:, None]], axis=1)
    centroids = Centroids(wide, max(1, min(count, len(wide) // 2)), settings)

    # equal vectors: the least id stands for all, and k + 1 least ids are all that answers can need
    nth = F.row_number().over(W.partitionBy("v").orderBy("id"))
    first = F.min("id").over(W.partitionBy("v").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow))
    few = storage.table(rows.distinct().select("id", "v", nth.alias("nth"), first.alias("stands")).where(F.col("nth") <= k + 1))
    distinct = few.where("nth = 1").select("id", "v")
    asked = rows.where(is_query).select(F.col("id").alias("query_id"), "v").distinct().join(distinct.withColumnRenamed("id", "stands"), "v").select("query_id", "stands")
    asked = storage.table(asked)
    placed = "part int, id long, v binary, lists array<int>"
    posted = storage.table(distinct.mapInArrow(_place(centroids, settings, length, size), placed))
    sizes = np.zeros(len(centroids.points), dtype=np.int64)
    for row in posted.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # a row per list, and the number of lists has a bound
        sizes[row["list"]] = row["count"]
    # a vector is in ``copies`` lists at most, so that many entries hold k others than the query
    least = settings.copies * (k + 1)
    askers = distinct.join(asked.select(F.col("stands").alias("id")).distinct(), "id", "left_semi")
    probing = storage.table(askers.mapInArrow(_place(centroids, settings, length, size, (sizes, least)), placed))

    # blocks of groups of lists and of their queries; both counts have a row per group, and the number of lists a bound
    def blocks(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("int").alias(name))

    cut = F.broadcast(blocks(posted, "vs").join(blocks(probing, "qs"), "part"))
    left = probing.join(cut, "part").withColumn("qb", F.pmod(F.xxhash64("id"), "qs").cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
    right = posted.join(cut, "part").withColumn("vb", F.pmod(F.xxhash64("id"), "vs").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    key = ["part", "qb", "vb"]
    columns = [*key, "id", "v", "lists"]
    found = left.select(columns).groupBy(*key).cogroup(right.select(columns).groupBy(*key)).applyInPandas(_best(size, k + 1), "query long, id long, score double")

    ranked = W.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.distinct().withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k + 1).select("query", "score", F.col("id").alias("stands"))
    members = best.join(few.select("id", "stands"), "stands").withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k + 1)
    answers = members.groupBy(F.col("query").alias("stands")).agg(F.sort_array(F.collect_list(F.struct("nth", F.col("id").alias("vec_id"), "score"))).alias("found"))
    others = asked.join(answers, "stands").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
