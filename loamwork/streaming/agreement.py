"""Running agreement of two raters on a stream: counts of label pairs as keyed state, with a timer for keys that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FORMS = "n long, observed double, expected double, kappa double"


def agreement_of(counts: dict[tuple[str, str], int], degenerate: float | None = 1.0) -> tuple[int, float, float, float | None]:
    """n, observed and expected agreement and Cohen's kappa from counts of label pairs, as the batch operator has them."""
    n = sum(counts.values())
    first, second = {}, {}
    for (a, b), k in counts.items():
        first[a] = first.get(a, 0) + k
        second[b] = second.get(b, 0) + k
    same, both = sum(k for (a, b), k in counts.items() if a == b), sum(k * second.get(a, 0) for a, k in first.items())
    observed, expected = same / n, both / n / n
    return n, observed, expected, degenerate if both == n * n else (observed - expected) / (1 - expected)


class RunningKappa(StatefulProcessor):
    """Of each key, after every batch that touches it: the agreement of all its rows so far. After ``silence_s`` without rows it is said once more, closed."""

    def __init__(self, degenerate: float | None = 1.0, silence_s: int | None = None) -> None:
        self.degenerate, self.silence_s = degenerate, silence_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "first string, second string", "n long")

    def _row(self, key: Any, closed: bool) -> pd.DataFrame:
        counts = {tuple(pair): n[0] for pair, n in self.counts.iterator()}
        n, observed, expected, value = agreement_of(counts, self.degenerate)
        return pd.DataFrame({"key": [key[0]], "n": [n], "observed": [observed], "expected": [expected], "kappa": [value], "closed": [closed]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            for (a, b), k in part.groupby(["first", "second"]).size().items():
                held = self.counts.getValue((a, b))[0] if self.counts.containsKey((a, b)) else 0
                self.counts.updateValue((a, b), (int(held + k),))
        if self.silence_s is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.silence_s)
        yield self._row(key, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)

    def close(self) -> None:
        pass


def running_kappa(stream: DataFrame, key: str, first: str, second: str, degenerate: float | None = 1.0, silence_s: int | None = None) -> DataFrame:
    """(key, n, observed, expected, kappa, closed): a row a key and batch; the last of a key holds for all rows seen.

    Rows without a rating are left out; a null key is one like any. State is a count a key and pair of labels, so it grows
    with these and not with the rows. ``silence_s`` sets timers, which keep a stream going, so a run to the present end of its input
    leaves them out. The session's state store must be RocksDB.
    """
    rows = stream.selectExpr(f"cast({key} as string) as key", f"cast({first} as string) as first", f"cast({second} as string) as second").where("first is not null and second is not null")
    return rows.groupBy("key").transformWithStateInPandas(RunningKappa(degenerate, silence_s), f"key string, {FORMS}, closed boolean", "Update", "None" if silence_s is None else "ProcessingTime")
