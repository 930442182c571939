"""Evaluate documents as they arrive (Structured Streaming).

New ``.txt`` files (one document each) or new rows of a parquet table are
read as a stream; every micro-batch runs the same batch plan inside
``foreachBatch`` (windows such as ``lag`` and ``row_number`` are not allowed
on a streaming DataFrame itself) and writes

* ``<out>/results/epoch=<id>/``: one row per (document, model),
* ``<out>/status/epoch=<id>/phase=<n>/``: one status row per document, first
  (phase 0) ``processing``, then (phase 1) ``completed`` or ``error`` with the
  failure's message.

Writing each epoch to its own folder with ``overwrite`` makes a replayed
epoch (after a failure) idempotent; the checkpoint folder records progress,
so a restarted query continues where it stopped.  No event time exists, so no
watermark is needed, and the query keeps no state.  ``out`` belongs to the
caller and outlives the run: a later session reads its history and results.

A document that is sent again is evaluated again.  ``latest_results`` has the
rows of each document's last finished epoch; ``compact`` writes them as one
table, so that readers don't go through all epochs for ever.
"""

from __future__ import annotations

from dataclasses import replace

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpora import strict_corpus_of
from ..plans.evaluate import DocumentEvaluation, Options
from ..session import materialise
from ..sources import results_io as IO
from .progress import Host, Steps, counted


def text_file_stream(spark: SparkSession, folder: str, glob: str = "*.txt",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Each new text file is one document (``doc_id`` = file name).  Only names
    matching ``glob`` (case-sensitive, default ``*.txt``) are accepted."""
    r = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def table_stream(spark: SparkSession, folder: str, schema, glob: str, max_bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """New parquet files of a table (``doc_id, text``) under ``folder``, an epoch of about ``max_bytes_per_trigger`` at most.

    ``arrival`` orders the rows: by their file's time and name, then by their place in it.
    """
    place = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index")
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
                 .option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(folder)
                 .select(F.col("doc_id"), F.col("text"), place.alias("arrival")))


def last_of_each(batch: DataFrame) -> DataFrame:
    """Of rows with the same ``doc_id`` the one that arrived last; a batch without ``arrival`` as it is."""
    if "arrival" not in batch.columns:
        return batch
    last = (batch.groupBy("doc_id").agg(F.max("arrival").alias("arrival"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").select(F.col("doc_id").alias("again"), F.col("arrival").alias("last")))
    same = F.col("doc_id").eqNullSafe(F.col("again")) & (F.col("arrival") < F.col("last"))
    return batch.join(last, same, "left_anti").drop("arrival")


def evaluate_batch(batch: DataFrame, options: Options | None = None) -> DataFrame:
    """Results (flat rows) of one batch of documents."""
    corpus, _ = strict_corpus_of(batch)
    ev = DocumentEvaluation(corpus, options or Options())
    return ev.results().select(
        "doc", "model_name", "model_id", *IO.COHERENCE, *IO.BOUNDARIES, *IO.SEARCH, "overall_score")


def start(stream: DataFrame, out_dir: str, checkpoint: str, options: Options | None = None,
          available_now: bool = True, processing_time: str | None = None, host: Host | None = None,
          name: str | None = None):
    """Start the evaluation query; returns the ``StreamingQuery``.

    An epoch's batch is written once and its results are computed once; the
    final status is derived from the results as written.  If the evaluation
    can't be planned, its documents get ``error`` rows and the stream goes on.
    A failed Spark job (lost executors, memory) fails the epoch instead: the
    query ends, and once restarted it runs the epoch again.

    A ``host`` is told the steps of each epoch as they begin, which are written
    too; ``progress.listen`` reports finished epochs with the stream's counters.
    """
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = last_of_each(materialise(batch, "ingest-batch"))
        docs = batch.select(F.col("doc_id").cast("string").alias("doc"))
        results = f"{out_dir}/results/epoch={epoch_id}"

        def report(status: DataFrame, phase: int) -> None:
            (status.withColumn("updated_at", F.current_timestamp())
             .write.mode("overwrite").parquet(f"{out_dir}/status/epoch={epoch_id}/phase={phase}"))

        report(IO.processing_status(docs), 0)
        used = options
        if host is not None:
            step = Steps(spark, out_dir, epoch_id, host)
            used = replace(options or Options(), report=step)
        try:
            rows = evaluate_batch(batch, used)
            if host is not None:
                step("Blending and saving results", 80)
            rows.write.mode("overwrite").parquet(results)
        except Exception as failure:  # noqa: BLE001 -- its message is the documents' status
            if isinstance(failure, (Py4JError, PySparkException)) and not isinstance(failure, AnalysisException):
                raise
            report(IO.error_status(docs, f"{type(failure).__name__}: {str(failure)[:500]}"), 1)
            return
        report(IO.run_status(spark.read.parquet(results), docs), 1)
        if host is not None:
            step("Results saved", 100)

    w = (stream if host is None else counted(stream)).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return (w.queryName(name) if name else w).start()


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """The result rows of every epoch, with ``epoch``."""
    return spark.read.parquet(f"{out_dir}/results")


def read_history(spark: SparkSession, out_dir: str) -> DataFrame:
    """All status rows, with ``epoch`` and ``phase``."""
    return spark.read.parquet(f"{out_dir}/status")


def current_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest status per document over all epochs (``max_by`` on epoch and phase)."""
    s = read_history(spark, out_dir)
    latest = F.max_by(F.struct("status", "message", "progress", "n_models"), F.struct("epoch", "phase"))
    return s.groupBy("document_name").agg(latest.alias("s")).select("document_name", "s.*")


def last_run(spark: SparkSession, out_dir: str) -> DataFrame:
    """``last_document, last_evaluation_time`` of the history under ``out_dir``, whichever session wrote it."""
    done = read_history(spark, out_dir).where("phase = 1")
    return IO.latest_run(done.select("document_name", F.col("updated_at").alias("evaluated_at")))


def unfinished(spark: SparkSession, out_dir: str) -> DataFrame:
    """Documents whose last epoch began and has no end: a restarted query runs that epoch again."""
    return current_status(spark, out_dir).where("status = 'processing'").select("document_name")


def _compactions(spark: SparkSession, out_dir: str) -> list[int]:
    """The epochs up to which finished compactions go."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/compacted")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    done = [p.getPath() for p in files.listStatus(folder)]
    return sorted(int(p.getName().split("=")[1]) for p in done
                  if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows of each document's last finished epoch, with ``epoch``: one row for each (document, model).

    A document whose last evaluation gave no result has no rows, whatever
    earlier ones gave.  Reads the last compaction and the epochs after it.
    """
    upto = max(_compactions(spark, out_dir), default=None)
    rows = read_results(spark, out_dir)
    ends = read_history(spark, out_dir).where("phase = 1")
    if upto is not None:
        old = spark.read.parquet(f"{out_dir}/compacted/upto={upto}")
        rows = rows.where(F.col("epoch") > upto).unionByName(old.select(rows.columns))
        ends = ends.where(F.col("epoch") > upto).select("document_name", "epoch").unionByName(
            old.select(F.col("doc").alias("document_name"), "epoch"))
    last = ends.groupBy(F.col("document_name").alias("doc")).agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["doc", "epoch"])


def compact(spark: SparkSession, out_dir: str) -> int | None:
    """Writes :func:`latest_results` up to the last finished epoch as one table and returns that epoch.

    Readers take a compaction once it is complete; a failed one is written over.
    """
    upto = read_history(spark, out_dir).where("phase = 1").agg(F.max("epoch")).first()[0]
    if upto is not None and upto not in _compactions(spark, out_dir):
        (latest_results(spark, out_dir).where(F.col("epoch") <= upto)
         .write.mode("overwrite").parquet(f"{out_dir}/compacted/upto={upto}"))
    return upto
