"""Outside services as providers: a function from keys to answers, called once per distinct key.

No service is called by the library itself; a caller brings its own function, and a lookup table is
the default. Answers are kept, empty ones as well, so a key is asked for once.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponexus.deploy import ship

#: Tries after the first, seconds before the first of them (doubled each time), partitions that ask at once.
RETRIES, BACKOFF, WORKERS = 3, 0.3, 8
#: Seconds a call may take.
TIMEOUT = 6.0

Fetch = Callable[[str], list[str]]


class RetryableError(Exception):
    """What a fetch raises for a passing fault."""


def _within(fetch: Fetch, seconds: float) -> Fetch:
    """``fetch`` given up after some seconds. Its thread is left to end by itself and doesn't keep the worker alive."""

    def run(key: str) -> list[str]:
        done: queue.SimpleQueue = queue.SimpleQueue()

        def call() -> None:
            try:
                done.put((fetch(key), None))
            except BaseException as error:  # noqa: BLE001  raised again by the caller
                done.put((None, error))

        threading.Thread(target=call, daemon=True).start()
        try:
            answer, error = done.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(key) from None
        if error is not None:
            raise error
        return answer

    return run


def with_retries(fetch: Fetch, retries: int = RETRIES, backoff: float = BACKOFF, timeout: float | None = TIMEOUT) -> Fetch:
    """``fetch`` tried again after passing faults; any failure in the end, a call that takes too long too, is an empty answer."""
    if timeout is not None:
        fetch = _within(fetch, timeout)

    def run(key: str) -> list[str]:
        for attempt in range(retries + 1):
            try:
                return fetch(key) or []
            except RetryableError:
                if attempt < retries:
                    time.sleep(backoff * 2**attempt)
            except Exception:  # noqa: BLE001  a service's failure is a known miss
                return []
        return []

    return run


def from_mapping(table: dict[str, list[str]]) -> Fetch:
    return lambda key: table.get(key, [])


def ask(keys: DataFrame, key: str, fetch: Fetch, workers: int = WORKERS, timeout: float | None = TIMEOUT) -> DataFrame:
    """Rows (key, cands) for distinct keys, asked from ``workers`` partitions at once."""
    ship(keys.sparkSession)
    answer = with_retries(fetch, timeout=timeout)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "cands": [list(answer(x)) for x in batch[key]]})

    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct().repartition(workers)
    return distinct.mapInPandas(run, f"`{key}` string, cands array<string>")


def ask_through_cache(keys: DataFrame, cache: DataFrame, key: str, fetch: Fetch, workers: int = WORKERS) -> DataFrame:
    """The cache with answers for the keys it lacks; a cached empty answer counts as known."""
    missing = keys.select(key).distinct().join(cache.select(key), key, "left_anti")
    return cache.select(key, "cands").unionByName(ask(missing, key, fetch, workers))
