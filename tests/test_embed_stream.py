"""Hashing embedder against a plain-Python rendering; user models; streaming."""

import hashlib
import os
import re
import tempfile
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import SAMPLE_DOC
from pyspark.sql import functions as F

from tessera.operators import embed as E
from tessera.operators import queries as Q
from tessera.plans.evaluate import model_table
from tessera.sources import literals as L

WORD = re.compile(r"[^\W]+", re.UNICODE)


def _py_vector(text, dim):
    v = np.zeros(dim)
    for t in WORD.findall(text.lower()):
        v[int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % dim] += 1
    return v


def test_hashing_matches_python(spark):
    texts = ["Straße über a_1 x", "Hello, hello world!", "", "x" * 3, "Ünïcödé wörds 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = E.embed_native(df, [E.HashingModel("h16", 16), E.HashingModel("h7", 7)]).collect()
    for r in got:
        want = _py_vector(texts[r.id], r.dim)
        assert np.array_equal(np.array(r.vec), want)
        assert r.norm_sq == float(want @ want)
        assert r.nz == [int(i) for i in np.nonzero(want)[0]]


def test_long_texts_take_no_more_memory_than_a_step():
    rng = np.random.default_rng(3)
    lens = [0, 3, E.STEP_WORDS + 1, 0, 900_000, 17, 2 * E.STEP_WORDS, 0]
    words = [np.array([f"w{i}" for i in range(500)], dtype=object)[rng.integers(0, 500, n)].tolist() for n in lens]
    tokens = pa.array([None if i == 3 else w for i, w in enumerate(words)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lens))), tokens], names=["id", "tokens"])
    tracemalloc.start()
    got = list(E._bincount([batch.slice(1)], ["id"], [("a", 64), ("b", 256)], timed=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * 8 * E.STEP_WORDS     # 1.7 million words, 14 MB for each array of a number a word
    hashes = {w: int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in words[4]}
    assert [rb.column("model_name")[0].as_py() for rb in got] == ["a", "b"]
    for rb, dim in zip(got, (64, 256)):
        assert rb.column("id").to_pylist() == list(range(1, len(lens)))
        want = [np.bincount([hashes[w] % dim for w in own], minlength=dim) for own in words[1:]]
        assert rb.column("vec").to_pylist() == [w.tolist() for w in want]
        assert rb.column("nz").to_pylist() == [np.flatnonzero(w).tolist() for w in want]
        assert rb.column("norm_sq").to_pylist() == [float((w * w).sum()) for w in want]
        assert min(rb.column("elapsed_s").to_pylist()) > 0


def test_literal_tables_need_no_python_worker(spark, capsys):
    models = model_table(spark, [E.HASH_64, E.PandasModel("own", "given", None)])
    assert [tuple(r) for r in models.collect()] == [(0, "hash-64", "hashing/md5-64", 64), (1, "own", "given", None)]
    assert models.schema.simpleString() == "struct<model_order:int,model_name:string,model_id:string,dim:int>"
    queries = Q.default_queries(spark)
    assert [tuple(r) for r in queries.collect()] == [(i, q, list(kws)) for i, (q, kws) in enumerate(L.DEFAULT_QUERIES)]
    capsys.readouterr()
    for table in (models, queries, model_table(spark, [])):
        assert all(f.nullable for f in table.schema.fields)
        table.explain()
        assert "ExistingRDD" not in capsys.readouterr().out


def test_pandas_model_and_failures(spark):
    # defined inside the test so that it is pickled by value
    def _toy_factory(model_id):
        if model_id == "broken":
            raise RuntimeError("cannot load")

        def embed(texts):
            if any("FAIL" in t for t in texts):
                raise ValueError("bad batch")
            return np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype=np.float32)
        return embed

    units = spark.createDataFrame([(1, "banana"), (2, "apple"), (3, "banana")], "id long, text string")
    ok = E.embed_with_model(units, E.PandasModel("toy", "toy", _toy_factory, batch_size=2)).collect()
    assert sorted((r.id, tuple(r.vec)) for r in ok) == [(1, (6.0, 3.0, 1.0)), (2, (5.0, 1.0, 1.0)),
                                                      (3, (6.0, 3.0, 1.0))]
    assert all(r.error is None and r.dim == 3 for r in ok)
    bad = E.embed_with_model(units, E.PandasModel("b", "broken", _toy_factory)).collect()
    assert all(r.vec is None and "cannot load" in r.error for r in bad)
    mixed = spark.createDataFrame([(1, "FAIL here"), (2, "fine")], "id long, text string")
    m = E.embed_with_model(mixed, E.PandasModel("toy", "toy", _toy_factory, batch_size=1)).collect()
    assert {r.id: r.error is None for r in m} == {1: False, 2: True}


def test_stream_equals_batch(spark):
    from tessera.session import scratch_path
    from tessera.streaming import ingest as ST
    from tessera.sources.tables import read_text_documents
    src = tempfile.mkdtemp(prefix="tessera-in-")
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    with open(os.path.join(src, "a.txt"), "w", encoding="utf-8") as f:
        f.write(text.replace("\n", "\r\n"))
    with open(os.path.join(src, "b.txt"), "w", encoding="utf-8") as f:
        f.write("Only\nHeaders\nHere")
    with open(os.path.join(src, "c.md"), "w", encoding="utf-8") as f:
        f.write(text)
    out, ckpt = scratch_path(spark, "t-out"), scratch_path(spark, "t-ckpt")
    q = ST.start(ST.text_file_stream(spark, src), out, ckpt)
    q.awaitTermination()
    streamed = sorted((r.doc, r.model_name, round(r.overall_score, 9)) for r in ST.read_results(spark, out).collect())
    batch_res = ST.evaluate_batch(read_text_documents(spark, src))
    batch = sorted((r.doc, r.model_name, round(r.overall_score, 9)) for r in batch_res.collect())
    assert streamed == batch and {d for d, _, _ in streamed} == {"a.txt"}
    status = {r.document_name: r.status for r in ST.current_status(spark, out).collect()}
    assert status == {"a.txt": "completed", "b.txt": "error"}
    history = sorted((r.document_name, r.phase, r.status) for r in ST.read_history(spark, out).collect())
    assert history == [("a.txt", 0, "processing"), ("a.txt", 1, "completed"), ("b.txt", 0, "processing"), ("b.txt", 1, "error")]


def test_failing_evaluation_leaves_an_error_with_its_message(spark):
    from tessera.plans.evaluate import Options
    from tessera.session import scratch_path
    from tessera.streaming import ingest as ST
    src = tempfile.mkdtemp(prefix="tessera-in3-")
    with open(os.path.join(src, "a.txt"), "w", encoding="utf-8") as f:
        f.write(open(SAMPLE_DOC, encoding="utf-8").read())
    out, ckpt = scratch_path(spark, "e-out"), scratch_path(spark, "e-ckpt")
    ST.start(ST.text_file_stream(spark, src), out, ckpt, Options(models=["no model"])).awaitTermination()
    (row,) = ST.current_status(spark, out).collect()
    assert row.document_name == "a.txt" and row.status == "error" and "'str' object" in row.message


def test_failed_job_fails_the_epoch_and_a_restart_runs_it_again(spark, monkeypatch):
    import pytest
    from pyspark.errors import StreamingQueryException
    from pyspark.sql import functions as F
    from tessera.session import scratch_path
    from tessera.streaming import ingest as ST
    src = tempfile.mkdtemp(prefix="tessera-in4-")
    with open(os.path.join(src, "a.txt"), "w", encoding="utf-8") as f:
        f.write(open(SAMPLE_DOC, encoding="utf-8").read())
    out, ckpt = scratch_path(spark, "j-out"), scratch_path(spark, "j-ckpt")
    with monkeypatch.context() as m:
        m.setattr(ST, "evaluate_batch", lambda batch, options: batch.select(F.raise_error(F.lit("lost")).alias("x")))
        with pytest.raises(StreamingQueryException):
            ST.start(ST.text_file_stream(spark, src), out, ckpt).awaitTermination()
    assert [r.status for r in ST.current_status(spark, out).collect()] == ["processing"]
    ST.start(ST.text_file_stream(spark, src), out, ckpt).awaitTermination()
    assert [r.status for r in ST.current_status(spark, out).collect()] == ["completed"]
    assert {r.doc for r in ST.read_results(spark, out).collect()} == {"a.txt"}


def test_python_model_equals_native(spark):
    from tessera.plans.registry import registry
    units = spark.createDataFrame([(1, "Straße über a_1 x"), (2, "Hello, hello world!"), (3, "")],
                                  "id long, text string")
    py = E.embed_with_model(units, E.PandasModel("p", E.HASH_64.model_id, E.python_hashing_factory))
    nat = E.embed_native(units, [E.HASH_64])
    a = {r.id: list(r.vec) for r in py.collect()}
    b = {r.id: list(r.vec) for r in nat.collect()}
    assert a == b
    t = registry()["embedding_timing"](spark, "/root/testdata/sf0.001").collect()
    assert {r.model_name for r in t} == {"hash-64", "hash-256"} and all(r.n_failed == 0 for r in t)


def test_stream_restart_processes_only_new_files(spark):
    from tessera.session import scratch_path
    from tessera.streaming import ingest as ST
    src = tempfile.mkdtemp(prefix="tessera-in2-")
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    with open(os.path.join(src, "first.txt"), "w", encoding="utf-8") as f:
        f.write(text)
    out, ckpt = scratch_path(spark, "r-out"), scratch_path(spark, "r-ckpt")
    ST.start(ST.text_file_stream(spark, src), out, ckpt).awaitTermination()
    with open(os.path.join(src, "second.txt"), "w", encoding="utf-8") as f:
        f.write(text.replace("Introduction", "Preface"))
    ST.start(ST.text_file_stream(spark, src), out, ckpt).awaitTermination()   # restart, same checkpoint
    res = ST.read_results(spark, out)
    per_epoch = {r.epoch: sorted({x.doc for x in res.filter(f"epoch = {r.epoch}").collect()})
                 for r in res.select("epoch").distinct().collect()}
    assert sorted(per_epoch.values()) == [["first.txt"], ["second.txt"]]


def test_a_document_sent_twice_has_its_last_result(spark):
    from tessera.session import scratch_path
    from tessera.streaming import ingest as ST
    src = tempfile.mkdtemp(prefix="tessera-in5-")
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    out, ckpt = scratch_path(spark, "l-out"), scratch_path(spark, "l-ckpt")
    versions = [[(1, text), (2, text), (3, text)], [(2, text + "\nA line more that the second version has.")],
                [(3, "Only\nHeaders"), (1, "Old\nversion"), (1, text + "\nLast of two in one file, which stays.")]]
    seen = []
    for rows in versions:
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        stream = ST.table_stream(spark, src, spark.read.parquet(src).schema, "*.parquet", 1 << 30)
        ST.start(stream, out, ckpt).awaitTermination()
        if len(seen) < 2:
            seen.append(ST.compact(spark, out))
    assert seen == [0, 1] and ST.unfinished(spark, out).collect() == []
    last = {1: versions[2][2][1], 2: versions[1][0][1]}
    want = ST.evaluate_batch(spark.createDataFrame(list(last.items()), "doc_id long, text string")).collect()
    key = lambda r: (r.doc, r.model_name, round(r.overall_score, 9))
    later = spark.newSession()  # another session reads what the first one left
    for _ in range(2):
        assert sorted(map(key, ST.latest_results(later, out).collect())) == sorted(map(key, want))
        assert ST.compact(spark, out) == 2
    assert {r.document_name: r.status for r in ST.current_status(later, out).collect()} == {
        "1": "completed", "2": "completed", "3": "error"}
    assert ST.last_run(later, out).first().last_document == "3"


def test_the_ingest_reads_a_table_of_many_files(spark, tmp_path):
    """``documents.parquet`` as a folder of parts, as larger tables are, and as one file."""
    from pyspark.sql import functions as F
    from tessera.plans.registry import registry
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 30")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    one = str(tmp_path / "one")
    docs.coalesce(1).write.parquet(one + "-part")
    os.makedirs(one)
    (part,) = [n for n in os.listdir(one + "-part") if n.endswith(".parquet")]
    os.link(f"{one}-part/{part}", f"{one}/documents.parquet")
    want = {str(r.doc_id) for r in docs.collect()}
    for folder in (str(tmp_path / "many"), one):
        history = registry()["status_history"](spark, folder)
        assert {r.document_name for r in history.where(F.col("phase") == 1).collect()} == want
        assert registry()["latest_run"](spark, folder).first().last_document == max(want)
        assert registry()["stream_ingest"](spark, folder).columns == ["doc", "model_name", "avg_coherence", "overall_score"]


def test_a_stand_in_model_hashes_a_word_once(monkeypatch):
    asked, md5 = [], hashlib.md5
    monkeypatch.setattr(E.hashlib, "md5", lambda b: asked.append(b) or md5(b))
    got = E.python_hashing_factory("hashing/md5-64")(["One two one", "two", "", None])
    assert sorted(asked) == [b"one", b"two"]
    assert got.dtype == "float32" and got.sum(axis=1).tolist() == [3, 1, 0, 0] and (got[1] <= got[0]).all()


def test_models_that_fail_on_digits_and_questions():
    from tessera.plans import registry as R
    for kind, fails, passes in (("digits", ["a1", "9", "x\n0"], ["a?", "", "\u0663", "a\n"]),
                                ("questions", ["?", "a?"], ["?a", "a?\n", "", "1"])):
        embed = R._picky_factory(kind)
        assert embed(passes).shape == (len(passes), 64)
        for text in fails:
            with pytest.raises(ValueError, match=f"fails on {kind}"):
                embed(["plain", text])
