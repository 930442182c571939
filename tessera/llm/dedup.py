"""Exact deduplication by a stateful stream, with DataFrame functions only.

A stream groups fingerprints by digest.  Its keyed state lies on disk
(RocksDB), never expires, and holds for each digest the count, the smallest
identifier seen and where that document's content lies.  Every digest that was
hit more than once is then checked against the full bytes of its documents.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialise, scratch_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else every partition's store takes megabytes of disk ahead of its first row
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def one_space(text: Column) -> Column:
    """The text with each run of space, tab, line feed, vertical tab, form feed and return as one space; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings while a table is written here, and as they were after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def is_plain_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is files, filtered and projected only, so that no two rows have the same place."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` where each row has a file and a place in it that no other row has.

    That is ``docs`` itself if it is rows of files as they stand; what a join,
    a generator or a union made is written first.
    """
    if is_plain_scan(docs):
        try:
            docs.select("_metadata.row_index")
            return docs
        except AnalysisException:
            pass
    return materialise(docs, "dedup-documents")


def located(docs: DataFrame) -> DataFrame:
    """Rows of a stored table as ``locator`` (file, row) and ``record``."""
    return docs.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
                       .alias("locator"), F.struct("*").alias("record"))


def keyed_state(prints: DataFrame, spark: SparkSession, path: str, bytes_per_batch: int) -> DataFrame:
    """Streams the fingerprints in ``path`` and returns the final state, one row for each digest."""
    checkpoint = scratch_path(spark, "dedup-state")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "locator"))
    with settings(spark, STATE):
        stream = (spark.readStream.schema(prints.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(path)
                  .groupBy("digest").agg(first.alias("keep"), F.count(F.lit(1)).alias("group_size")))
        (stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
        if prints.isEmpty():  # no batch ran, so there is no state to read
            return prints.select("digest", F.struct(F.lit(False).alias("unknown"), "doc_id", "locator").alias("keep"),
                                 F.lit(0).cast("long").alias("group_size"))
        state = spark.read.format("statestore").load(checkpoint)
        return materialise(state.select("key.digest", F.col("value").getField(
            state.schema["value"].dataType.names[0]).alias("keep"), F.col("value").getField(
                state.schema["value"].dataType.names[1]).alias("group_size")), "dedup-groups")


def decide(docs: DataFrame, digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 4 << 30) -> DataFrame:
    """One row for each row of a :func:`stored` table: ``locator, doc_id, digest, keep, group_size``.

    ``keep`` has the doc_id and locator of the row that stays: the smallest
    doc_id of an equal text, null after all others, then the first by file and
    place, so that of repeated rows one stays.  Null texts are empty texts.
    """
    spark = docs.sparkSession
    body = one_space(F.col("record.text"))
    path = scratch_path(spark, "dedup-prints")
    (located(docs).select("locator", F.col("record.doc_id").alias("doc_id"), digest(body).alias("digest"))
     .write.parquet(path))
    prints = spark.read.parquet(path)
    groups = keyed_state(prints, spark, path, bytes_per_batch)

    # a hit is checked on full bytes; texts meet as the least and greatest of a digest, which sums up before it shuffles
    hits = prints.join(groups.where("group_size > 1").select("digest"), "digest", "left_semi").select("locator", "digest")
    bodies = located(docs).select("locator", body.alias("body")).join(hits, "locator")
    split = (bodies.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
             .where("least <> greatest").select("digest"))
    split = materialise(split, "dedup-collisions")
    decided = prints.join(groups, "digest")
    if split.isEmpty():
        return decided
    own = bodies.join(split, "digest").join(prints.select("locator", "doc_id"), "locator")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "locator"))
    exact = own.groupBy("digest", "body").agg(first.alias("keep"), F.count(F.lit(1)).alias("group_size"))
    apart = own.join(exact, ["digest", "body"]).select("digest", "locator", "doc_id", "keep", "group_size")
    return decided.join(split, "digest", "left_anti").unionByName(apart)


def first_of_equal(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all columns."""
    docs = stored(docs)
    gone = decide(docs, digest).where("locator <> keep.locator").select("locator")
    return located(docs).join(gone, "locator", "left_anti").select("record.*")


def dedup_report(docs: DataFrame) -> DataFrame:
    """The query: what became of every document."""
    return decide(stored(docs)).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("locator") == F.col("keep.locator")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


DEDUP_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
"""
