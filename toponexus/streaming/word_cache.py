"""The word cache filled as names arrive: each micro-batch asks once for the words that are new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from toponexus.plans.linkage import lacking_words
from toponexus.schemas import TOKENS
from toponexus.sources.providers import Fetch, ask


def keep_filled(names: DataFrame, cache_path: str, fetch: Fetch, checkpoint: str) -> StreamingQuery:
    """Stream (row_id, name) into the Parquet cache (token, cands) at ``cache_path``.

    A batch writes to a folder of its own that a rerun replaces, so a batch tried twice leaves its
    words once.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(TOKENS).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).parquet(cache_path)
        lacks = lacking_words(batch, known.where(f"input_file_name() not like '%/batch={number}/%'"))
        ask(lacks, "token", fetch).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    names.sparkSession.createDataFrame([], TOKENS).write.mode("append").parquet(f"{cache_path}/start")
    return names.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
