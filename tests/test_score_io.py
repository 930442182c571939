"""Blend, leaderboard, best model per metric, JSON round trip, placeholder."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import score as S
from tessera.sources import results_io as IO

# published document results: (name, avg_coherence, contrast, precision, overall)
PUBLISHED = [
    ("bge-small-en-v1.5", 0.6946632862091064, 0.1072879433631897, 0.55, 0.4605853688716889),
    ("all-MiniLM-L6-v2", 0.449889600276947, 0.2659090757369995, 0.4333333333333333, 0.3880729361375173),
    ("gte-large", 0.8541471362113953, 0.05774414539337158, 0.55, 0.49356738448143006),
]


@pytest.fixture(scope="module")
def metrics(spark):
    coh = spark.createDataFrame([(m, "doc", c) for m, c, _, _, _ in PUBLISHED],
                                "model_name string, doc string, avg_coherence double")
    con = spark.createDataFrame([(m, "doc", k) for m, _, k, _, _ in PUBLISHED],
                                "model_name string, doc string, section_boundary_contrast double")
    sea = spark.createDataFrame([(m, "doc", p) for m, _, _, p, _ in PUBLISHED],
                                "model_name string, doc string, semantic_search_precision double")
    order = spark.createDataFrame([(i, m) for i, (m, *_r) in enumerate(PUBLISHED)], "model_order int, model_name string")
    return S.overall_score(coh, con, sea).join(order, "model_name")


def test_overall_reproduces_published(metrics):
    got = {r.model_name: r.overall_score for r in metrics.collect()}
    for m, _, _, _, overall in PUBLISHED:
        assert abs(got[m] - overall) < 1e-15, m


def test_within_minus_cross():
    assert abs((0.6889811158180237 - 0.581693172454834) - 0.1072879433631897) < 1e-15


def test_leaderboard_and_best(metrics):
    lb = S.leaderboard(metrics).orderBy("position").collect()
    assert [r.model_name for r in lb] == ["gte-large", "bge-small-en-v1.5", "all-MiniLM-L6-v2"]
    assert [r.is_best for r in lb] == [True, False, False]
    best = {r.metric: r.best_model for r in S.best_per_metric(metrics).collect()}
    assert best == {"overall_score": "gte-large", "avg_coherence": "gte-large",
                    "section_boundary_contrast": "all-MiniLM-L6-v2",
                    "semantic_search_precision": "bge-small-en-v1.5"}   # tie at 0.55: first wins


def test_json_round_trip_and_placeholder(spark, metrics):
    flat = metrics.select("model_name", "doc", F.lit("id").alias("model_id"),
                          *[F.lit(0.1).alias(c) for c in IO.COHERENCE if c != "avg_coherence"], "avg_coherence",
                          *[F.lit(0.0).alias(c) for c in IO.BOUNDARIES if c != "section_boundary_contrast"],
                          "section_boundary_contrast",
                          *[F.lit(0.0).alias(c) for c in IO.SEARCH if c != "semantic_search_precision"],
                          "semantic_search_precision", "overall_score")
    docs = IO.to_json_documents(IO.nest(flat)).collect()
    assert len(docs) == 1
    obj = json.loads(docs[0].results_json)
    assert set(obj) == {m for m, *_ in PUBLISHED}
    assert set(obj["gte-large"]) == {"model_id", "coherence", "section_boundaries", "semantic_search",
                                     "evaluation_time_seconds", "overall_score"}
    back = IO.from_json_documents(spark.createDataFrame(docs)).collect()
    assert {r.model_name: r.overall_score for r in back} == {m: o for m, *_x, o in PUBLISHED}
    listed = spark.createDataFrame([("doc",), ("new",)], "doc string")
    ph = IO.with_placeholder(IO.from_json_documents(spark.createDataFrame(docs)), listed)
    assert sorted(r.model_name for r in ph.filter("doc = 'new'").collect()) == ["empty"]
    clean = IO.clean_placeholder(ph.unionByName(
        ph.filter("doc = 'new'").withColumn("doc", F.lit("doc")))).collect()
    assert sorted(r.model_name for r in clean if r.doc == "doc") == sorted(m for m, *_ in PUBLISHED)
    assert [r.model_name for r in clean if r.doc == "new"] == ["empty"]
    assert {r.doc: r.n_models for r in S.model_count(ph).collect()} == {"doc": 3, "new": 0}


def test_status_and_latest_run(spark):
    res = spark.createDataFrame([("a", "m")], "doc string, model_name string")
    docs = spark.createDataFrame([("a",), ("b",)], "doc string")
    st = {r.document_name: r.status for r in IO.run_status(res, docs).collect()}
    assert st == {"a": "completed", "b": "error"}
    hist = spark.createDataFrame([("x.txt", 1.0), ("y.txt", 3.0), ("z.txt", 2.0)], "document_name string, t double") \
        .select("document_name", F.timestamp_seconds("t").alias("evaluated_at"))
    assert IO.latest_run(hist).collect()[0].last_document == "y.txt"


def test_default_models_flag(spark):
    from tessera.functions.text import truthy_flag
    df = spark.createDataFrame([("TRUE",), ("no",), (None,), ("On",), ("0",)], "f string")
    assert [r[0] for r in df.select(truthy_flag(F.col("f"))).collect()] == [True, False, True, True, False]


def test_result_files_round_trip(spark, metrics):
    import os
    import tempfile
    from tessera.session import scratch_path
    flat = metrics.select("model_name", "doc", F.lit("id").alias("model_id"),
                          *[F.lit(0.0).alias(c) for c in IO.COHERENCE if c != "avg_coherence"], "avg_coherence",
                          *[F.lit(0.0).alias(c) for c in IO.BOUNDARIES if c != "section_boundary_contrast"],
                          "section_boundary_contrast",
                          *[F.lit(0.0).alias(c) for c in IO.SEARCH if c != "semantic_search_precision"],
                          "semantic_search_precision", "overall_score")
    folder = tempfile.mkdtemp(prefix="tessera-json-")
    for r in IO.to_json_documents(IO.nest(flat)).collect():
        with open(os.path.join(folder, f"{r.doc}.json"), "w") as f:
            f.write(r.results_json)
    back = IO.read_results_json(spark, folder).collect()
    assert {(r.doc, r.model_name) for r in back} == {("doc.json", m) for m, *_ in PUBLISHED}
    out = scratch_path(spark, "results")
    IO.write_results(flat, out)
    again = spark.read.parquet(out).filter("model_name = 'gte-large'").collect()
    assert len(again) == 1 and abs(again[0].overall_score - 0.49356738448143006) < 1e-15
