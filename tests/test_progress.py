"""A host hears of the steps while an epoch runs, of finished epochs and of the end."""

import time

from conftest import SAMPLE_DOC

from tessera.session import scratch_path
from tessera.streaming import ingest as ST
from tessera.streaming import progress as PR


def _wait(seen, kind, n):
    for _ in range(100):
        if sum(s["kind"] == kind for s in seen) >= n:
            return
        time.sleep(0.1)


def test_host_hears_steps_before_the_end(spark, tmp_path):
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    source, out, ckpt = str(tmp_path / "in"), scratch_path(spark, "p-out"), scratch_path(spark, "p-ckpt")
    schema = "doc_id string, text string"
    seen, status_then = [], []

    def host(report):
        if report["kind"] == "step" and report["progress"] == 55:   # the epoch has no result yet
            status_then.extend(r.status for r in ST.current_status(spark, out).collect())
        seen.append(report)
        raise RuntimeError("a host that fails")

    listener = PR.listen(spark, host, "heard")
    try:
        for docs in ([("a", text), ("b", None)], [("c", text)]):
            spark.createDataFrame(docs, schema).coalesce(1).write.mode("append").parquet(source)
            ST.start(ST.table_stream(spark, source, spark.createDataFrame([], schema).schema, "*.parquet"), out, ckpt,
                     host=host, name="heard").awaitTermination()
        # a stream of another name is not reported
        ST.start(ST.table_stream(spark, source, spark.createDataFrame([], schema).schema, "*.parquet"),
                 scratch_path(spark, "q-out"), scratch_path(spark, "q-ckpt"), name="unheard").awaitTermination()
        _wait(seen, "end", 2)
    finally:
        spark.streams.removeListener(listener)
    steps = [(s["epoch"], s["progress"]) for s in seen if s["kind"] == "step"]
    assert steps == [(e, p) for e in (0, 1) for p in (15, 35, 55, 70, 80, 100)]
    assert status_then[:2] == ["processing", "processing"]
    written = [(r.epoch, r.step, r.progress) for r in PR.read_steps(spark, out).orderBy("epoch", "step").collect()]
    assert written == [(e, i, p) for e in (0, 1) for i, p in enumerate((15, 35, 55, 70, 80, 100))]
    epochs = {s["epoch"]: s for s in seen if s["kind"] == "epoch" and s.get("documents")}
    assert {e: (s["documents"], s["without_text"], s["characters"]) for e, s in epochs.items()} == {
        0: (2, 1, len(text)), 1: (1, 0, len(text))}
    assert [s["error"] for s in seen if s["kind"] == "end"] == [None, None]
    assert {r.doc for r in ST.read_results(spark, out).collect()} == {"a", "c"}


def test_a_failing_epoch_is_heard(spark, tmp_path, monkeypatch):
    source, out, ckpt = str(tmp_path / "in"), scratch_path(spark, "f-out"), scratch_path(spark, "f-ckpt")
    spark.createDataFrame([("a", "Title\nBody of it.")], "doc_id string, text string").write.parquet(source)
    seen = []

    def broken(batch, options=None):
        return batch.select(PR.F.raise_error(PR.F.lit("executor lost")).cast("string").alias("doc"))

    monkeypatch.setattr(ST, "evaluate_batch", broken)
    listener = PR.listen(spark, seen.append, "failing")
    try:
        query = ST.start(ST.table_stream(spark, source, spark.read.parquet(source).schema, "*.parquet"), out, ckpt,
                         host=seen.append, name="failing")
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001 -- the epoch's failure
            pass
        _wait(seen, "end", 1)
    finally:
        spark.streams.removeListener(listener)
    assert [s["progress"] for s in seen if s["kind"] == "step"] == [80]
    (end,) = [s for s in seen if s["kind"] == "end"]
    assert "executor lost" in end["error"]
