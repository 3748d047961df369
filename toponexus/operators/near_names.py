"""Names against names of the same block by edit distance, without a row for every pair.

Rows are (eng_id, eng_name, block) on one side and (cand_id, cand, block) on the other. Equal names of a block are
compared once. A task gets about ``ASKED`` names of a block with about ``FOUND`` of the other side, whatever the size of the
block, works out all their distances in memory and gives back only what is asked for. Case does not count. The score is 100
less the percentage of the longer name that the distance makes up, and no number for two empty names, which ranks
first and passes every threshold. A null name has no distance and no score, and comes last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from toponexus.deploy import ship
from toponexus.functions.name_tree import Tree

#: Names of either side that a task compares at a time.
ASKED, FOUND = 512, 1 << 16
PARTS = ["block", "asked_part", "found_part"]


def score_of(distance: np.ndarray, longer: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return 100.0 - 100.0 * distance / longer


def nearness(distance: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return -distance.astype(np.float64)


def _search(asked: DataFrame, found: DataFrame, worth: Callable, pick: Callable, carried: list[str]) -> DataFrame:
    """Rows (block, name, ``carried`` columns of found, worth) for the distinct names ``asked`` (block, name) among ``found`` (block, cand, ...).

    ``found`` is put in the order of its column ``cand_id``. For each name asked, ``pick`` gets the worth of each row found, null
    names' being no number with a mark in the second array, and gives the places of the rows to return.
    """
    spark = asked.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sides = {"asked": asked.withColumn("low", F.lower("name")).withColumn("size", F.length("name")), "found": found.withColumn("low", F.lower("cand")).withColumn("size", F.length("cand"))}
    asked_parts, found_parts = (side.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(f"{x}_parts")) for (x, side), most in zip(sides.items(), (ASKED, FOUND), strict=True))
    parts = asked_parts.join(found_parts, "block")

    def dealt(own: str, other: str, name: str):
        side = sides[own].join(parts, "block").withColumn(f"{own}_part", F.pmod(F.xxhash64(name), f"{own}_parts").cast("int"))
        side = side.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))).drop("asked_parts", "found_parts")
        return side.repartition(tasks, *PARTS).groupBy(*PARTS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.take(pc.sort_indices(right["cand_id"])).combine_chunks()
        coded = right["cand"].combine_chunks().dictionary_encode()
        at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        null = at < 0
        rows = np.full(len(coded.dictionary), 0)
        rows[at[~null]] = np.flatnonzero(~null)
        tree = Tree(right["low"].take(pa.array(rows)).to_pylist())
        sizes = right["size"].take(pa.array(rows)).to_numpy().astype(np.int64)
        own, own_sizes = left["low"].to_pylist(), left["size"].to_pylist()
        named = [i for i, x in enumerate(own) if x is not None]
        nothing = np.full(len(at), np.nan)
        picked = []

        def take(i: int, value: np.ndarray, missing: np.ndarray) -> None:
            places = pick(value, missing)
            picked.append((np.full(len(places), i), places, value[places], missing[places]))

        for i in set(range(len(own))).difference(named):
            take(i, nothing, np.ones(len(at), dtype=bool))
        for places, distances in tree.batches([own[i] for i in named]):
            for place, distance in zip(places, distances, strict=True):
                i = named[place]
                take(i, np.where(null, np.nan, np.append(worth(distance, np.maximum(sizes, own_sizes[i])), np.nan)[at]), null)
        who, places, values, missing = (np.concatenate(x) if picked else np.empty(0, dtype=kind) for x, kind in zip(zip(*picked, strict=True) if picked else [()] * 4, (int, int, float, bool), strict=True))
        out = [*(left[c].take(pa.array(who)) for c in ("block", "name")), *(right[c].take(pa.array(places)) for c in carried), pa.array(values, pa.float64(), mask=missing.astype(bool))]
        return pa.table(out, names=["block", "name", *carried, "worth"])

    schema = T.StructType([*(asked.schema[c] for c in ("block", "name")), *(found.schema[c] for c in carried), T.StructField("worth", T.DoubleType())])
    return dealt("asked", "found", "name").cogroup(dealt("found", "asked", "cand")).applyInArrow(run, schema)


def _first(k: int):
    def pick(value: np.ndarray, missing: np.ndarray) -> np.ndarray:
        key = np.where(missing, -np.inf, np.where(np.isnan(value), np.inf, value))
        if len(key) <= k:
            return np.argsort(-key, kind="stable")
        least = np.partition(key, len(key) - k)[len(key) - k]
        over = np.flatnonzero(key > least)
        places = np.concatenate([over, np.flatnonzero(key == least)[: k - len(over)]])
        return places[np.argsort(-key[places], kind="stable")]

    return pick


def best(left: DataFrame, right: DataFrame, k: int, by_distance: bool = False) -> DataFrame:
    """Rows (eng_id, eng_name, block, cand_id, cand, score, rn): the ``k`` best of each row, equal ones by ``cand_id``; distance instead of score if asked."""
    left, right = left.where("block is not null"), right.where("block is not null")
    # of rows that share a name only the first can be among the best
    copies = F.row_number().over(W.partitionBy("block", "cand").orderBy(F.asc_nulls_last("cand_id")))
    found = right.withColumn("rn", copies).where(F.col("rn") <= k).select("block", "cand_id", "cand")
    picked = _search(left.select("block", F.col("eng_name").alias("name")).distinct(), found, nearness if by_distance else score_of, _first(k), ["cand_id", "cand"])
    out = left.join(picked.withColumnRenamed("block", "in"), F.col("block").eqNullSafe(F.col("in")) & F.col("eng_name").eqNullSafe(F.col("name"))).drop("in", "name")
    rank = F.row_number().over(W.partitionBy("eng_id").orderBy(F.desc("worth"), F.asc_nulls_last("cand_id")))
    out = out.withColumn("rn", rank).where(F.col("rn") <= k)
    value = (-F.col("worth")).alias("distance") if by_distance else F.col("worth").alias("score")
    return out.select("eng_id", "eng_name", "block", "cand_id", "cand", value, "rn")


def _reached(threshold: float):
    return lambda value, missing: np.flatnonzero(~missing & ~(value < threshold))


def within(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Rows (eng_id, eng_name, block, cand_id, cand, score) of all names at the threshold or above, each name once with its least ``cand_id``."""
    found = right.where("block is not null and cand is not null").groupBy("block", "cand").agg(F.min("cand_id").alias("cand_id"))
    picked = _search(left.where("block is not null and eng_name is not null").select("block", F.col("eng_name").alias("name")).distinct(), found, score_of, _reached(threshold), ["cand_id", "cand"])
    return left.join(picked.withColumnRenamed("name", "eng_name"), ["block", "eng_name"]).select("eng_id", "eng_name", "block", "cand_id", "cand", F.col("worth").alias("score"))


def strong(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Rows (block, n_pairs, n_strong): pairs of each block, and those at the threshold or above."""
    asked = left.where("block is not null").groupBy("block", F.col("eng_name").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    found = right.where("block is not null").groupBy("block", "cand").agg(F.count(F.lit(1)).alias("held"))
    pairs = asked.groupBy("block").agg(F.sum("rows").alias("a")).join(found.groupBy("block").agg(F.sum("held").alias("b")), "block")
    # the order does not matter here
    picked = _search(asked.where("name is not null").select("block", "name"), found.where("cand is not null").withColumn("cand_id", F.lit(0)), score_of, _reached(threshold), ["held"])
    met = picked.groupBy("block", "name").agg(F.sum("held").alias("held")).join(asked, ["block", "name"]).groupBy("block").agg(F.sum(F.col("held") * F.col("rows")).alias("n"))
    return pairs.join(met, "block", "left").select("block", (F.col("a") * F.col("b")).alias("n_pairs"), F.coalesce("n", F.lit(0).cast("long")).alias("n_strong"))
