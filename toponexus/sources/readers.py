"""Sources: pair files, word caches, line files, literal lists, gazetteer and shape files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponexus import schemas


def discover(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths under a folder that match a glob, on any file system; none is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"nothing in {folder} matches {pattern}")
    return sorted(status.getPath().toString() for status in found)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row_id, value): a file's lines that are not empty; row_id rises in file order."""
    return spark.read.text(path).where("value <> ''").select(F.monotonically_increasing_id().alias("row_id"), "value")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, value) of a two-column file without header; the last value of a repeated key wins, files in the order of their names."""
    # places in a file hold within a part of it, and parts are ordered by file name and offset
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = spark.read.schema(schemas.PAIRS).csv(path).select("*", order.alias("ord"))
    return rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.coalesce("value", F.lit("")), "ord").alias("value"))


def word_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows (token, cands) of a cache of one JSON object or of JSON rows; a missing or broken file is an empty cache."""
    empty = spark.createDataFrame([], schemas.TOKENS)
    if not _exists(spark, path):
        return empty
    rows = spark.read.schema(schemas.TOKENS).json(path).where("token is not null")
    if not rows.isEmpty():
        return rows
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("token", "cands"))


def literals(spark: SparkSession, values: list[str], name: str = "name") -> DataFrame:
    """Rows (row_id, name) of a list kept in code, repeats and order kept."""
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField(name, T.StringType())])
    return spark.createDataFrame(list(enumerate(values)), schema)


def gazetteer(spark: SparkSession, path: str, alternate: bool = False) -> DataFrame:
    """The tab-separated gazetteer, or its table of alternate names."""
    schema = schemas.ALTERNATE_NAMES if alternate else schemas.GAZETTEER
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("dateFormat", "yyyy-MM-dd").csv(path)


def shape_names(spark: SparkSession, path: str, level: int = 3) -> DataFrame:
    """Names of the areas of a GeoJSON file: rows (row_id, name, district)."""
    fields = f"properties struct<NAME_{level}: string, NAME_{level - 1}: string>"
    rows = spark.read.schema(f"features array<struct<{fields.replace('properties ', 'properties: ')}>>").option("multiLine", True).json(path)
    places = rows.select(F.posexplode("features").alias("row_id", "f"))
    return places.select(F.col("row_id").cast("long"), F.col(f"f.properties.NAME_{level}").alias("name"), F.col(f"f.properties.NAME_{level - 1}").alias("district"))
