"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records by a seeded hash into buckets of a bounded size;
pass two puts each bucket into a random order by a Fisher-Yates shuffle in
memory and writes it.  The buckets, one after the other, are a random order of
all records; shards are equal cuts of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

#: Bytes of a record besides its text.
RECORD_BYTES = 8
#: Most bytes of bucket offsets (16 each) that are sent to every executor; beyond, Spark plans the join.
OFFSETS_SENT = 64 << 20


def record_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def shuffle_externally(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7,
                       bucket_bytes: int = 24 << 20) -> DataFrame:
    """``docs`` as ``bucket``, ``place`` (from 0 in the bucket) and ``record`` (struct of all columns).

    The table is written to the shared folder.  A bucket has about
    ``bucket_bytes`` of records, whatever the input's size; each is a partition
    of its own, so that it is the most that a task holds.  The hash takes key and text, so that null or repeated
    keys spread; only rows that agree in both share a bucket.  The same rows
    in any order give the same result, since buckets are sorted before they
    are shuffled.
    """
    total = docs.select(F.sum(record_bytes(text))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    pick = F.xxhash64(F.lit(seed), F.col(f"record.{key}"), F.col(f"record.{text}"))
    scattered = (docs.select(F.struct("*").alias("record"))
                 .select(pick.alias("pick"), "record")
                 .withColumn("bucket", F.pmod("pick", F.lit(buckets)).cast("int"))
                 .repartitionById(buckets, "bucket")   # a partition a bucket, none shares one
                 .sortWithinPartitions("bucket", "pick", f"record.{key}"))
    shuffled = (scattered.groupBy("bucket").agg(F.shuffle(F.collect_list("record"), seed).alias("records"))
                .select("bucket", F.posexplode("records").alias("place", "record")))
    return materialise(shuffled, "shuffled-buckets")


def assign_shards(buckets: DataFrame, shards: int) -> DataFrame:
    """The records of :func:`shuffle_externally` with ``shard`` and ``slot``.

    Shards are cuts of the whole order, so their row counts are at most one
    apart; slots count from 0 without gaps.
    """
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (sizes.select("bucket", "n", (F.sum("n").over(before) - F.col("n")).alias("first"))
               .withColumn("total", F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(
                   Window.unboundedPreceding, Window.unboundedFollowing))))
    offsets = materialise(offsets.drop("n"), "shuffled-offsets")
    if offsets.count() * 16 <= OFFSETS_SENT:
        offsets = F.broadcast(offsets)
    first_of_shard = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (buckets.join(offsets, "bucket").withColumn("shard", F.expr(f"(first + place) * {shards} div total"))
            .select("record", F.col("shard").cast("int").alias("shard"),
                    (F.col("first") + F.col("place") - first_of_shard).alias("slot")))


def shard_documents(docs: DataFrame, shards: int, seed: int = 7, bucket_bytes: int = 24 << 20) -> DataFrame:
    """All rows of ``docs`` as ``record`` (struct of its columns), ``shard`` and ``slot``.

    Nulls in any column, empty texts and repeated rows are records like any
    other; an empty table gives no rows; columns may have any name.
    """
    return assign_shards(shuffle_externally(docs, seed=seed, bucket_bytes=bucket_bytes), shards)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; its files hold ranges of slots, rows in their order, and are written by many tasks."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("shard", "slot", "record").write.partitionBy("shard").parquet(path))


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The query: size, checksum and place of every document."""
    text = F.col("record.text")
    return shard_documents(docs, shards).select(
        F.col("record.doc_id").alias("doc_id"), record_bytes("record.text").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
