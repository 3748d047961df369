"""Sinks: result files, caches, metrics and line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from toponexus.functions.text import quoted_list


def append_csv(frame: DataFrame, path: str) -> None:
    """Add rows; every part file has its own header, so a reader sees one."""
    frame.write.mode("append").option("header", True).csv(path)


def replace_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def with_fallback(write, frame: DataFrame, path: str, fallback: str) -> str:
    """Write to ``path``, or where that is refused to ``fallback``; the path that was used."""
    try:
        write(frame, path)
        return path
    except Exception as error:  # noqa: BLE001  the cause decides
        text = str(error)
        if not any(sign in text for sign in ("Permission denied", "AccessControlException", "Mkdirs failed", "Read-only")):
            raise
        if isinstance(error, AnalysisException):
            raise
        write(frame, fallback)
        return fallback


def append_metrics(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table each."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_json(frame: DataFrame, path: str) -> None:
    """Rows as JSON lines, letters of any script as they are; replaces what was there."""
    frame.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(frame: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """Columns joined by commas, not quoted, a row a line."""
    frame.select(F.concat_ws(",", *(F.coalesce(F.col(c), F.lit("")) for c in columns)).alias("value")).write.mode(mode).text(path)


def array_literal(frame: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """One row ``name=["a","b"]`` of a short list."""
    ordered: Column = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return frame.agg(F.concat(F.lit(f"{name}="), quoted_list(ordered)).alias("value"))


def show_low_confidence(scored: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` candidates of each row, for the console."""
    from toponexus.operators.relational import top_k

    return top_k(scored, "eng_id", "score", "cand_ord", k).orderBy("eng_id", "rn")
