"""What a host hears while the ingest runs: the steps of an epoch, and each epoch's counters.

A host is a callable that takes a dict.  The ingest hands it a step as soon as
it begins (``kind`` "step": ``epoch, message, progress``), and writes it beside
the status rows; the listener hands it Spark's own report of every finished
epoch with the counters observed on the stream ("epoch": ``epoch, rows, documents,
without_text, characters``) and of the query's end ("end": ``error``).  A host that fails is
logged and does not stop the stream.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Host = Callable[[dict], None]
COUNTERS = "ingested"


def tell(host: Host, report: dict) -> None:
    try:
        host(report)
    except Exception:  # noqa: BLE001 -- a host's own failure is none of the evaluation's
        logging.getLogger(__name__).exception("the host failed on %s", report)


def counted(stream: DataFrame) -> DataFrame:
    """The stream of documents with the counters that the listener reports for each epoch."""
    return stream.observe(COUNTERS, F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text").isNull()).alias("without_text"),
                          F.sum(F.length("text")).alias("characters"))


class HostListener(StreamingQueryListener):
    def __init__(self, host: Host, name: str | None = None):
        self.host, self.name, self.runs = host, name, set()

    def onQueryStarted(self, event):
        if self.name is None or event.name == self.name:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event):
        p = event.progress
        if str(p.runId) not in self.runs:
            return
        seen = p.observedMetrics.get(COUNTERS)
        tell(self.host, {"kind": "epoch", "epoch": p.batchId, "rows": p.numInputRows} | (seen.asDict() if seen else {}))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if str(event.runId) in self.runs:
            self.runs.discard(str(event.runId))
            tell(self.host, {"kind": "end", "error": event.exception})


def listen(spark: SparkSession, host: Host, name: str | None = None) -> HostListener:
    """Hand a host the reports of the session's streams, or of those of one name; ``spark.streams.removeListener`` ends it."""
    listener = HostListener(host, name)
    spark.streams.addListener(listener)
    return listener


class Steps:
    """The steps of one epoch, told to the host and written to ``<out>/steps/epoch=<id>/step=<n>``.

    An epoch that runs again writes over its rows.
    """

    def __init__(self, spark: SparkSession, out_dir: str, epoch: int, host: Host):
        self.spark, self.host, self.epoch, self.n = spark, host, epoch, 0
        self.folder = f"{out_dir}/steps/epoch={epoch}"

    def __call__(self, message: str, progress: int) -> None:
        row = self.spark.createDataFrame([(message, progress)], "message string, progress long").coalesce(1)
        row.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.folder}/step={self.n}")
        self.n += 1
        tell(self.host, {"kind": "step", "epoch": self.epoch, "message": message, "progress": progress})


def read_steps(spark: SparkSession, out_dir: str) -> DataFrame:
    """All step rows, with ``epoch`` and ``step``."""
    return spark.read.parquet(f"{out_dir}/steps")
