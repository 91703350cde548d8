"""Saved searches that report what is new: a keyed state on a stream of search runs."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Executors get the processor with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "run bigint, ids array<string>"
NEW = "watch string, run bigint, id string, n int"


class Watch(StatefulProcessor):
    """Of one watch, the ids of its last run. A run reports its ids that the run before did not have; the first run only records."""

    def __init__(self, top: int, reported: int):
        self.top, self.reported = top, reported

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs: dict[int, list] = {}
        for frame in rows:
            for run, at, score in zip(frame["run"], frame["id"], frame["score"]):
                best = runs.setdefault(int(run), [])
                if at is not None and at == at:
                    best.append((-score, at))
                    if len(best) > 4 * self.top:  # never more than a few pages of one run
                        best[:] = heapq.nsmallest(self.top, set(best))
        seen = self.last.get() if self.last.exists() else None
        at_run, ids = (seen[0], list(seen[1])) if seen else (None, None)
        for run in sorted(runs):
            if at_run is not None and run <= at_run:
                continue  # a run that comes again
            top = [i for _, i in heapq.nsmallest(self.top, set(runs[run]))]
            if ids is not None:
                known = set(ids)
                fresh = [i for i in top if i not in known][: self.reported]
                if fresh:
                    yield pd.DataFrame({"watch": key[0], "run": run, "id": fresh, "n": range(1, len(fresh) + 1)}).astype({"n": "int32"})
            at_run, ids = run, top
        if at_run is not None:
            self.last.update((at_run, ids))

    def close(self) -> None:
        pass


def search_watches_stream(hits: DataFrame, path: str, checkpoint: str, top: int = 100, reported: int = 10) -> StreamingQuery:
    """hits: a stream of (watch string, run long, id string, score double), a run's hits in one batch, a row without an id for a run
    without hits. What is new goes to Parquet at `path`: (watch, run, id, n). The state lives in the checkpoint, by watch."""
    spark = hits.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    new = hits.select("watch", "run", "id", "score").groupBy("watch").transformWithStateInPandas(Watch(top, reported), NEW, "append", "none")
    return new.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
