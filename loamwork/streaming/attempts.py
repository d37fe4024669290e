"""Scoring of batches through an unreliable scorer: attempts with backoff, and a log that several writers append to.

Every run writes a folder of its own, which Spark commits whole or not at all, so writers need no lock. A batch that two
runs scored has two entries and one that counts: a success before a failure, then the first run in order.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

ENTRY = "batch_digest string, status string, attempts int, error string, response string"
#: Attempts a run, and the longest pause between two in seconds.
ATTEMPTS, LONGEST_PAUSE_S = 5, 12.0


def pause(attempt: int, longest: float = LONGEST_PAUSE_S) -> float:
    """Seconds to wait after the given failed attempt, counted from 1."""
    return min(2.0**attempt, longest)


def attempted(batches: DataFrame, score: Callable[[dict[str, Any]], Any], digest: str = "batch_digest", attempts: int = ATTEMPTS, longest: float = LONGEST_PAUSE_S, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """An entry a batch: ``ok`` with the scorer's answer as JSON, or ``failed`` with the last error, and how many attempts it took.

    ``score`` gets a batch's columns by name and is called in the tasks, one batch after the other; a task that is run again calls it again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            entries = []
            for row in part.to_dict("records"):
                error = response = None
                for attempt in range(1, attempts + 1):
                    try:
                        response = json.dumps(score(row), ensure_ascii=False)
                        break
                    except Exception as e:  # noqa: BLE001 - whatever the scorer raises is an attempt that failed
                        error = f"{type(e).__name__}: {e}"
                        if attempt < attempts:
                            wait(pause(attempt, longest))
                entries.append((str(row[digest]), "failed" if response is None else "ok", attempt, error if response is None else None, response))
            yield pd.DataFrame(entries, columns=["batch_digest", "status", "attempts", "error", "response"])

    return batches.mapInPandas(run, ENTRY)


def append(entries: DataFrame, path: str) -> str:
    """Adds a run's entries to the log and returns the run's name."""
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    entries.write.mode("error").json(f"{path}/run={run}")
    return run


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entry of each batch that counts, with its ``run``; a log that nobody has written yet is empty."""
    try:
        every = spark.read.schema(f"{ENTRY}, run string").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{ENTRY}, run string")
    best = F.min(F.struct((F.col("status") != "ok").alias("_failed"), "run", "attempts", "status", "error", "response"))
    return every.groupBy("batch_digest").agg(best.alias("e")).select("batch_digest", "e.status", "e.attempts", "e.error", "e.response", "e.run")


def resumed(batches: DataFrame, path: str, score: Callable[[dict[str, Any]], Any], digest: str = "batch_digest", **settings: Any) -> str:
    """One run over the batches without a success in the log; batches that repeat a digest are one."""
    done = entries(batches.sparkSession, path).where("status = 'ok'").select(F.col("batch_digest").alias("_done"))
    todo = batches.dropDuplicates([digest]).join(done, F.col(digest).cast("string") == F.col("_done"), "left_anti")
    return append(attempted(todo, score, digest, **settings), path)
