"""What running queries tell about themselves, as rows."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Rows that are held before they are written.
FLUSH = 1000
ROWS = "query string, run string, batch long, source string, metric string, value double"


class Recorder(StreamingQueryListener):
    """Rows of (query, run, batch, source, metric, value): input_rows of each source, behind (what the source knows of beyond what was read, where it
    tells so as a number), batch_ms, state_rows, and the observed counts of each batch.

    A trigger gives a few rows. They stay in the driver until there are FLUSH of them, if there is a folder to write them to; without one they all do,
    as for a query that ends."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.rows: list[tuple] = []
        self.running: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        with self.changed:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        own = (p.name or str(p.id), str(p.runId), p.batchId)
        rows = [(*own, None, "batch_ms", float(p.batchDuration or 0))]
        for s in p.sources:
            rows.append((*own, s.description, "input_rows", float(s.numInputRows)))
            for name, value in (s.metrics or {}).items():
                rows += [(*own, s.description, name, float(value))] if _number(value) else []
        for s in p.stateOperators:
            rows.append((*own, s.operatorName, "state_rows", float(s.numRowsTotal)))
        for name, seen in p.observedMetrics.items():
            rows += [(*own, name, k, float(v)) for k, v in seen.asDict().items() if v is not None]
        with self.changed:
            self.rows += rows
        if self.folder and len(self.rows) >= FLUSH:
            self.flush()

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        with self.changed:
            self.running.discard(str(event.runId))
            if getattr(event, "exception", None):
                self.rows.append((str(event.id), str(event.runId), None, None, "failed", 1.0))
            self.changed.notify_all()

    def flush(self) -> None:
        """Appends what is held to the folder, as Parquet."""
        with self.changed:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        """What is held."""
        with self.changed:
            return self.spark.createDataFrame(list(self.rows), ROWS)


def _number(text: object) -> bool:
    try:
        float(text)
    except (TypeError, ValueError):
        return False
    return True


@contextmanager
def recorded(spark: SparkSession, folder: str | None = None, wait: float = 60.0) -> Iterator[Recorder]:
    """Records the queries that run inside, to folder as Parquet if that is given; at the end waits until those that ended have told all."""
    recorder = Recorder(spark, folder)
    spark.streams.addListener(recorder)
    try:
        yield recorder
        active = {str(q.runId) for q in spark.streams.active}
        with recorder.changed:
            recorder.changed.wait_for(lambda: not recorder.running - active, wait)
        if folder:
            recorder.flush()
    finally:
        spark.streams.removeListener(recorder)
