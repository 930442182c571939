"""Pearson and Spearman correlation per group (e.g. per model).

Pearson is ``covar_pop / (stddev_pop * stddev_pop)`` with ``try_divide``:
NULL, not an error, on a constant column (ANSI mode makes ``corr`` throw).

Spearman is Pearson of average ranks.  A ``rank()`` window per model would
sort a model's whole pair table in one task, so ranks come from counts: the
average rank of value ``v`` is ``#(x < v) + (#(x = v) + 1) / 2``.  Distinct
values (ties collapse, so no hot value) are cut into contiguous ranges by a
range partitioner; a running count inside each range plus the totals of the
earlier ranges gives ``#(x < v)`` exactly.  Sampling only affects how
balanced the ranges are, never the ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def pearson(df: DataFrame, keys: list[str], x: str, y: str, out: str = "pearson_correlation") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(out),
        F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, keys: list[str], value: str, buckets: int | None = None) -> DataFrame:
    """``keys, value, rank`` with 1-based average ranks of ``value`` per group.

    Distinct values (with their counts) are range-partitioned on
    ``(keys, value)`` by Spark's sampling range partitioner, so every
    partition holds a contiguous, similarly sized slice of the sort order, even
    when one group holds most rows.  The partition id is the bucket; the slice
    is frozen by writing it, so that both readers see the same buckets.
    ``buckets`` defaults to ``spark.sql.shuffle.partitions``.
    """
    spark = df.sparkSession
    n_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    tagged = materialise(counts.repartitionByRange(n_buckets, *keys, value)
                               .withColumn("bucket", F.spark_partition_id()), "rank-buckets")
    within = tagged.withColumn(
        "below_in_bucket",
        F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "bucket").orderBy(value)
                                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = tagged.groupBy(*keys, "bucket").agg(F.sum("c").alias("bucket_total"))
    offsets = totals.withColumn(
        "below_buckets",
        F.coalesce(F.sum("bucket_total").over(Window.partitionBy(*keys).orderBy("bucket")
                                              .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = within.join(offsets.select(*keys, "bucket", "below_buckets"), keys + ["bucket"])
    return j.select(*keys, value,
                    (F.col("below_buckets") + F.col("below_in_bucket")
                     + (F.col("c") + F.lit(1)) / F.lit(2.0)).cast("double").alias("rank"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "spearman_correlation",
             buckets: int | None = None, materialize: bool = True) -> DataFrame:
    if materialize:
        # read three times: two rank tables and the final join
        df = materialise(df.select(*keys, x, y), "rank-input")
    rx = average_ranks(df, keys, x, buckets).withColumnRenamed("rank", "_rx")
    ry = average_ranks(df, keys, y, buckets).withColumnRenamed("rank", "_ry")
    j = df.select(*keys, x, y).join(rx, keys + [x]).join(ry, keys + [y])
    return pearson(j, keys, "_rx", "_ry", out)
