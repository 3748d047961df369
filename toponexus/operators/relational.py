"""Joins, updates, aggregates, ranks and bags that linkage needs, as plain relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from toponexus.functions.text import is_blank


def work_queue(frame: DataFrame, column: str) -> DataFrame:
    """Rows whose counterpart is missing."""
    return frame.where(F.col(column).isNull())


def translate_keys(frame: DataFrame, mapping: DataFrame, key: str, mapped: str) -> tuple[DataFrame, DataFrame]:
    """(rows with each mapped key, rows without any): a many-to-many mapping, null targets left out."""
    pairs = mapping.where(F.col(mapped).isNotNull()).select(key, mapped).distinct()
    return frame.join(pairs, key), frame.join(pairs, key, "left_anti")


def block_pairs(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """All pairs within a block. The block is an equality, so that the plan never is a full product."""
    return left.join(right, on)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], distance: Column, order: str, block: Column | None = None) -> DataFrame:
    """For each left key, the right row of the least distance, the first in ``order`` among equals.

    ``right`` is the smaller list. Each task keeps the best it has seen for a key, so the pairs are
    streamed and never stored.
    """
    pairs = left.join(right, block if block is not None else F.lit(True))
    names = [c for c in right.columns]
    best = F.min_by(F.struct(*names, distance.alias("distance")), F.struct(distance, F.col(order)))
    return pairs.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def first_hit(options: DataFrame, master: DataFrame, key: str, position: str, value: str, carried: list[str] | None = None) -> DataFrame:
    """For each key, the first option in order that the master list holds."""
    hits = options.join(master.select(value).distinct(), value, "left_semi")
    return hits.groupBy(key, *(carried or [])).agg(F.min_by(value, position).alias(value), F.min(position).alias(position))


def cached(frame: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with what the cache has, distinct keys it lacks). A cached empty value is a known miss, not a lack."""
    return frame.join(cache, key, "left"), frame.select(key).distinct().join(cache.select(key), key, "left_anti")


def by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two lists side by side. Positions must be stored; they are compared, not made up."""
    return left.join(right, F.col(left_order) == F.col(right_order))


def ordinals(frame: DataFrame, order: str, name: str = "ord") -> DataFrame:
    """1, 2, 3 ... in the order of a column, without gathering the rows in one task.

    Rows are range-partitioned; the sizes of the partitions, a row for each, are summed.
    """
    placed = frame.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    inner = placed.withColumn("__n", F.row_number().over(W.partitionBy("__part").orderBy(order)))
    sizes = inner.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).alias("__before"))
    return inner.join(F.broadcast(before), "__part").withColumn(name, F.col("__n") + F.col("__before")).drop("__part", "__n", "__size", "__before")


def last_wins(source: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return source.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_wins(source: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return source.groupBy(key).agg(F.min_by(value, order).alias(value))


def overwrite(target: DataFrame, source: DataFrame, key: str, target_value: str, value: str, order: str) -> DataFrame:
    """Every row whose key the source has gets its value, the last one where there are several."""
    new = last_wins(source, key, value, order).withColumnRenamed(value, "__new")
    return target.join(new, key, "left").withColumn(target_value, F.coalesce("__new", target_value)).select(target.columns)


def fill_blank(target: DataFrame, source: DataFrame, key: str, target_value: str, value: str, order: str) -> DataFrame:
    """As ``overwrite``, but only null or blank values change and the first value wins."""
    new = first_wins(source, key, value, order).withColumnRenamed(value, "__new")
    filled = F.when(is_blank(F.col(target_value)), F.coalesce("__new", target_value)).otherwise(F.col(target_value))
    return target.join(new, key, "left").withColumn(target_value, filled).select(target.columns)


def reconcile(left: DataFrame, right: DataFrame, left_key: str, left_value: str, right_key: str, right_value: str, order: str, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fill each side from the other: left from right, then right from the left that came of it.

    ``legacy`` overwrites every row of a name that has a gap somewhere, also rows already filled.
    """

    def update(target: DataFrame, source: DataFrame, key: str, value: str, from_key: str, from_value: str) -> DataFrame:
        rows = source.where(F.col(from_key).isNotNull() & F.col(from_value).isNotNull()).select(F.col(from_value).alias(key), F.col(from_key).alias("__v"), F.col(order).alias("__o"))
        if not legacy:
            return fill_blank(target, rows, key, value, "__v", "__o")
        gaps = work_queue(target, value).select(key).distinct()
        return overwrite(target, rows.join(gaps, key, "left_semi"), key, value, "__v", "__o")

    left = update(left, right, left_key, left_value, right_key, right_value)
    return left, update(right, left, right_key, right_value, left_key, left_value)


def ordered_distinct(frame: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place where each was first seen."""
    return frame.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias(order))


def merge_max(frame: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The greatest score of each key; keys that never score above zero drop out."""
    return frame.groupBy(*keys).agg(F.max(score).alias(score)).where(F.col(score) > 0)


def ordered_lists(frame: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The values of each key as a list in order. Meant for keys with few values: a list is one row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return frame.groupBy(key).agg(F.transform(ordered, lambda x: x[value]).alias("values"))


def top_k(frame: DataFrame, key: str, score: str, order: str, k: int) -> DataFrame:
    """The ``k`` best rows of each key, ranked from 1; equal scores in ``order``."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), order))
    return frame.withColumn("rn", rank).where(F.col("rn") <= k)


def pivot_ranked(frame: DataFrame, keys: list[str], columns: dict[str, str], k: int = 3) -> DataFrame:
    """Ranked rows (column rn) as columns: ``{"cand": "Cand{}"}`` gives Cand1 to Cand``k``, null where there are fewer."""
    cells = [F.max(F.when(F.col("rn") == i, F.col(c))).alias(name.format(i)) for i in range(1, k + 1) for c, name in columns.items()]
    return frame.groupBy(*keys).agg(*cells)


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of ``right`` takes away one like it."""
    return left.exceptAll(right)


def set_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()
