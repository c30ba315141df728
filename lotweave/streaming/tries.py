"""First success of a request over tries that arrive in any order.

The state of a request is its best success, its last failure and which ranks have failed.  It answers
as soon as no try that is still out can change the answer: when all ranks before a success have failed,
or all of the request's tries have.  When its wait is over it answers with what there is.  Then the
state is dropped, but for a mark that keeps tries which come too late from answering again, and that
goes with the next timer.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Executors get this module with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRIES = "request_id long, rank int, tries int, page_id long, url string, success boolean, error string, tried_at timestamp"
RESULT = "request_id long, rank int, page_id long, url string, success boolean, error string, complete boolean"
_ONE = "rank int, page_id long, url string, error string"
_FIELDS = ("rank", "page_id", "url", "error")


class FirstSuccess(StatefulProcessor):
    """One request: see the module."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", _ONE)
        self.last = handle.getValueState("last", _ONE)
        self.failed = handle.getMapState("failed", "rank int", "seen boolean")
        self.prefix = handle.getValueState("prefix", "n int, tries int")
        self.done = handle.getValueState("done", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            for _ in rows:
                pass
            return
        begun = self.prefix.exists()
        n, total = self.prefix.get() if begun else (0, 0)
        first = None
        for frame in rows:
            for r in frame.itertuples(index=False):
                one = (int(r.rank), None if pd.isna(r.page_id) else int(r.page_id), r.url, r.error)
                first = int(r.tried_ms) if first is None else min(first, int(r.tried_ms))
                total = max(total, int(r.tries or 0)) if not pd.isna(r.tries) else total
                if r.success:
                    if not self.best.exists() or one[0] < self.best.get()[0]:
                        self.best.update(one)
                else:
                    self.failed.updateValue((one[0],), (True,))
                    if not self.last.exists() or one[0] > self.last.get()[0]:
                        self.last.update(one)
        while self.failed.exists() and self.failed.containsKey((n + 1,)):  # ranks from 1 that have all failed
            n += 1
            self.failed.removeKey((n,))
        self.prefix.update((n, total))
        if not begun:
            self.handle.registerTimer(first + self.wait_ms)
        won = self.best.exists() and self.best.get()[0] == n + 1
        if won or (total and n >= total):
            yield self._answer(key, True)
            self.done.update((timerValues.getCurrentWatermarkInMs(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            self.done.clear()
        elif self.prefix.exists():
            yield self._answer(key, False)

    def _answer(self, key, complete: bool) -> pd.DataFrame:
        success = self.best.exists()
        one = dict(zip(_FIELDS, (self.best if success else self.last).get()))
        for state in (self.best, self.last, self.failed, self.prefix):
            state.clear()
        row = {"request_id": key[0], "rank": one["rank"], "page_id": one["page_id"], "url": one["url"], "success": success, "error": one["error"], "complete": complete}
        return pd.DataFrame([row]).astype({"page_id": "Int64"})

    def close(self) -> None:
        pass


def first_successes(tries: DataFrame, wait_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """One row (RESULT) per request of a stream of TRIES.

    The wait runs from the first try that arrives, by the tries' own times.  ``tries`` is the number of the request's tries, null if not known: then all failures are known to be
    all only when the wait is over.  ``complete`` is false for answers that the wait forced.  Needs the
    RocksDB state store.
    """
    marked = tries.withWatermark("tried_at", delay).withColumn("tried_ms", F.unix_millis("tried_at"))
    return marked.groupBy("request_id").transformWithStateInPandas(
        FirstSuccess(wait_seconds * 1000), T.StructType.fromDDL(RESULT), "Append", "EventTime"
    )
