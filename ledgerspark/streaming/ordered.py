"""Job events that arrive late, twice or in any order, judged in the order in which they happened."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerspark.streaming.jobs import NEXT, stage_code

#: No status before a job's first event.
NONE = max(NEXT) + 1
#: ALLOWED[before, after]; the last row is that of a new job, which starts queued.
ALLOWED = np.zeros((NONE + 1, NONE), bool)
for _before, _after in NEXT.items():
    ALLOWED[_before, list(_after)] = True
ALLOWED[NONE, 0] = True

_OUT = "job_id long, event_id long, ts timestamp, previous int, status int, is_allowed boolean"


class OrderedTransitions(StatefulProcessor):
    """State of a job: its last status, and a list of events that are younger than the watermark.

    Events wait until nothing older can come, then leave in order of time and id. A timer is set for the oldest that waits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("status", T.IntegerType())]))
        event = [("ts", T.LongType()), ("event_id", T.LongType()), ("status", T.IntegerType())]
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(n, k) for n, k in event]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        micros = new["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        self.waiting.appendList([(int(t), int(e), int(s)) for t, e, s in zip(micros, new["event_id"], new["status"], strict=True)])
        yield from self._leave(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._leave(key, timerValues)

    def _leave(self, key, timerValues) -> Iterator[pd.DataFrame]:
        held = sorted(self.waiting.get())
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        ready = [x for x in held if x[0] < limit]
        rest = held[len(ready) :]
        if ready:
            status = np.array([x[2] for x in ready])
            before = np.concatenate([[self.last.get()[0] if self.last.exists() else NONE], status[:-1]])
            previous = pd.array(before, "Int32")
            previous[before == NONE] = pd.NA
            yield pd.DataFrame(
                {
                    "job_id": key[0],
                    "event_id": [x[1] for x in ready],
                    "ts": pd.to_datetime([x[0] for x in ready], unit="us", utc=True),
                    "previous": previous,
                    "status": status.astype(np.int32),
                    "is_allowed": ALLOWED[before, status],
                }
            )
            self.last.update((int(status[-1]),))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)

    def close(self) -> None:
        pass


def ordered_transitions(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Every event once, with its predecessor's status in time and whether the step is allowed.

    ``events`` is a stream of ``(event_id, job_id, ts, stage)``. An event that comes twice within ``lateness`` counts once; one that comes
    later than that is dropped, as its place in the order has gone by. Unknown stages, and events without id, job or time, are dropped too.
    Results leave once the watermark has passed them. Needs the RocksDB state store (:func:`assemble.rocks_state`).
    """
    known = events.select("event_id", "job_id", F.col("ts").cast("timestamp").alias("ts"), stage_code(F.col("stage")).alias("status")).dropna()
    once = known.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("job_id").transformWithStateInPandas(OrderedTransitions(), _OUT, "Append", "EventTime")
