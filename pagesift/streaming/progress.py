"""Progress of streams as a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query_id string, run_id string, batch_id long, metric string, counter string, value long"


class ProgressTable(StreamingQueryListener):
    """Keeps every micro-batch's observed counters: one row per batch, metric and counter.

    Rows are small (a few per micro-batch); ``save`` moves them to a Parquet
    table, so a long-running stream can be drained from time to time.
    """

    def __init__(self):
        self._lock, self._rows, self._ended = threading.Lock(), [], {}

    def _end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.id), str(p.runId), int(p.batchId), metric, counter, int(value))
                for metric, row in p.observedMetrics.items() for counter, value in row.asDict().items() if isinstance(value, int)]
        with self._lock:
            self._rows += rows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def wait(self, run: str, seconds: float = 60) -> None:
        """Until the end of a run was reported, which comes after all its progress."""
        if not self._end_of(run).wait(seconds):
            raise TimeoutError(f"no report of the end of run {run}")

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows held now."""
        with self._lock:
            return spark.createDataFrame(list(self._rows), SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append the rows held now to the table at ``path`` and forget them."""
        with self._lock:
            rows, self._rows = self._rows, []
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
