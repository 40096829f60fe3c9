"""Counters of running streams: rows in and out, lag, state size."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last ``keep`` progress reports; add with spark.streams.addListener."""

    def __init__(self, keep: int = 1000):
        self.reports: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.reports.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "dropped_late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)})

    def onQueryTerminated(self, event):
        pass
