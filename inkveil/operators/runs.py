"""What a run did: counts taken while its plan runs, as a row of a run table, and progress of streams."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

RUN = "run string, pages long, finds long, bytes_in long, bytes_out long, elapsed_ms long"


def page_metrics(finds: str = "finds", before: str = "text", after: str = "redacted") -> list[Column]:
    """Metrics of a redacted page table: pages, finds, and bytes of text before and after."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias
    return [F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.size(finds)), F.lit(0)).cast("long").alias("finds"), size(before)("bytes_in"), size(after)("bytes_out")]


def summarised(run: str, pages: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``write`` on redacted pages and return the run's row (:data:`RUN`).

    The counts are observed in the very pass that ``write`` makes: nothing is read twice.
    """
    seen, began = Observation(run), time.time()
    write(pages.observe(seen, *page_metrics()))
    counts = seen.get
    row = (run, *(int(counts[c]) for c in ("pages", "finds", "bytes_in", "bytes_out")), int(1000 * (time.time() - began)))
    return pages.sparkSession.createDataFrame([row], RUN)


class Progress(StreamingQueryListener):
    """Collects a row for each finished batch of the streams whose plan observes ``name``: batch, rows read, and the observed counts.

    One row a batch, ``keep`` at most (the latest), is held by the driver; :meth:`table` gives them as a frame.
    """

    def __init__(self, name: str, keep: int = 10_000):
        self.name, self.keep, self.rows = name, keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = json.loads(event.progress.json)
        counts = told.get("observedMetrics", {}).get(self.name)
        if counts is not None:
            self.rows.append((told["id"], told["batchId"], int(told.get("numInputRows", 0)), json.dumps(counts, sort_keys=True)))
            del self.rows[: -self.keep]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "stream string, batch long, rows_read long, counts string")
