"""Sharding and exact deduplication against brute force."""

import re
import zlib
from collections import Counter, defaultdict

from llm_tables import SF_SMALL, awkward, empty  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import dedup, sharding
from tessera.sources.tables import read_table


def _check_shards(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_hold_every_row_once(spark, awkward, empty):
    for buckets in (1 << 30, 300):
        rows = sharding.shard_report(awkward, 4).collect() if buckets > 300 else \
            sharding.shard_documents(awkward, 4, bucket_bytes=300).select("record.*", "shard", "slot").collect()
        _check_shards(rows, 4)
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in awkward.collect())
    report = sharding.shard_report(awkward).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                    for r in awkward.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in report) == texts
    assert {(r.law, r.grown_shard) for r in report} == {("rows", None)}
    assert sharding.shard_report(empty).collect() == []


def test_shards_are_the_same_however_rows_come(spark, awkward):
    docs = read_table(spark, SF_SMALL, "documents")
    def place(d):
        return {r.doc_id: (r.shard, r.slot) for r in sharding.shard_report(d).collect()}
    one = place(docs)
    assert one == place(docs.repartition(7)) and len(one) == docs.count()
    order = [i for i, _ in sorted(one.items(), key=lambda x: x[1])]
    assert order != sorted(order) and order != sorted(order, reverse=True)


def test_written_shards(spark, awkward, tmp_path):
    sharding.write_shards(sharding.shard_documents(awkward, 3, bucket_bytes=500), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == awkward.count() and back.select("shard").distinct().count() == 3


def _brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    out = Counter()
    for ids in groups.values():
        known = sorted((i is None, i) for i in ids if i is not None) or [(True, None)]
        for i in ids:
            out[i, known[0][1], len(ids)] += 1
    return out, len(groups)


def _weak(body):
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 1)


def test_dedup_with_awkward_rows(spark, awkward, empty):
    want, groups = _brute(awkward.collect())
    for digest in (dedup.sha256, _weak):
        rows = dedup.decide(dedup.stored(awkward), digest).collect()
        assert Counter((r.doc_id, r.keep.doc_id, r.group_size) for r in rows) == want
        assert sum(r.locator == r.keep.locator for r in rows) == groups
    kept = dedup.first_of_equal(awkward)
    assert kept.count() == groups and kept.columns == awkward.columns
    assert dedup.dedup_report(empty).collect() == [] and dedup.first_of_equal(empty).count() == 0


def test_dedup_many_batches_and_colliding_digests(spark, tmp_path):
    path = str(tmp_path / "docs")
    read_table(spark, SF_SMALL, "documents").repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    want, _ = _brute(docs.collect())
    assert any(size > 1 for _, _, size in want)
    # a digest of one byte makes every group collide with others: the bytes decide
    rows = dedup.decide(dedup.stored(docs), _weak, bytes_per_batch=2000).collect()
    assert Counter((r.doc_id, r.keep.doc_id, r.group_size) for r in rows) == want


def test_native_plans_have_no_python(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    for df in (sharding.shard_report(docs), dedup.dedup_report(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_rows_that_share_a_place_in_a_file_are_rows_of_their_own(spark):
    from tessera.llm import jaccard, lm_score
    docs = read_table(spark, SF_SMALL, "documents")
    other = spark.range(2).withColumnRenamed("id", "copy")
    tables = [docs.join(other, F.lit(True)), docs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")),
              docs.withColumn("copy", F.lit(0)).unionByName(docs.withColumn("copy", F.lit(1)))]
    path = f"{spark.conf.get('spark.checkpoint.dir', '/tmp')}/derived-{id(docs)}"
    tables[1].write.parquet(path)
    written = spark.read.parquet(path)
    assert dedup.is_plain_scan(written) and not any(map(dedup.is_plain_scan, tables))
    report = lambda d: Counter(tuple(r) for r in dedup.dedup_report(d).collect())
    want, kept = report(written), dedup.first_of_equal(written).count()
    near = jaccard.one_of_each(written, words=5, percent=80).count()
    for table in tables:
        assert report(table) == want and dedup.first_of_equal(table).count() == kept == sum(r[3] * n for r, n in want.items())
    assert jaccard.one_of_each(tables[0], words=5, percent=80).count() == near < kept
    score = lambda d: round(sum(r.base_score for r in lm_score.language_model_report(d).collect()), 3)
    assert score(tables[2]) == score(written)


def test_no_task_holds_two_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tessera.llm import sharding as S
    from tessera.session import materialise
    plans = []
    monkeypatch.setattr(S, "materialise", lambda df, name: plans.append(df) or materialise(df, name))
    docs = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 50).alias("text"))
    buckets = S.shuffle_externally(docs, bucket_bytes=1 << 14)
    assert buckets.count() == 4000
    placed = plans[0].select(F.spark_partition_id().alias("task"), "bucket").distinct().collect()
    assert len(placed) > 40 and len({r.task for r in placed}) == len(placed)
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_a_shard_is_written_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    from tessera.llm import sharding as S
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 50).alias("text"))
    sharded = S.shard_documents(docs, 2, bucket_bytes=1 << 14)
    path = str(tmp_path / "shards")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")   # small tables would be put together
    try:
        S.write_shards(sharded, path)
    finally:
        spark.conf.set(coalesce, before)
    rows = spark.read.parquet(path).select("shard", "slot", "record.doc_id", F.col("_metadata.file_name").alias("file"))
    ranges = rows.groupBy("shard", "file").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b - r.a + 1 == r.n for r in ranges) and len(ranges) > 4
    want = {(r.shard, r.slot, r.doc_id) for r in sharded.select("shard", "slot", "record.doc_id").collect()}
    assert {(r.shard, r.slot, r.doc_id) for r in rows.collect()} == want and len(want) == 3000
