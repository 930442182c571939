"""User models in the whole evaluation: each text embedded once, vectors written once or not at all."""
import importlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embed as E
from tessera.plans import corpora as CO
from tessera.plans.evaluate import DocumentEvaluation, Options
from tessera.plans.registry import finalize

SHORT = [("a", i, f"Paragraph {i % 7} tells of embeddings, models and search. And there is one more sentence, Straße {i % 5}.")
         for i in range(30)] + [("b", i, "Always the same line about vector databases, every time. It is said twice.") for i in range(9)]


def _corpus(spark, rows=SHORT):
    units = spark.createDataFrame(rows, "doc string, major long, text string").selectExpr(
        "doc", "string(major div 5) section", "major", "0L minor", "text")
    return CO.Corpus("own", units, CO.P.sentence_units(units), CO.Q.default_queries(spark))


def _recorder(path, fails_on=None):
    """A hashing model that writes down each text it was given."""
    def factory(model_id):
        embed = E.python_hashing_factory(model_id)

        def recording(texts):
            with open(os.path.join(path, f"{os.getpid()}-{model_id.rsplit('-')[-1]}"), "a", encoding="utf-8") as f:
                f.writelines(f"{t}\n" for t in texts)
            if fails_on and any(fails_on in t for t in texts):
                raise ValueError("refused")
            return embed(texts)
        return recording
    return factory


def _seen(path, dim):
    return sorted(line for f in os.listdir(path) if f.endswith(f"-{dim}") for line in open(
        os.path.join(path, f), encoding="utf-8").read().splitlines())


def _written(monkeypatch):
    written = []
    for module in ("plans.evaluate", "operators.search", "operators.coherence", "operators.contrast", "operators.embed"):
        module = importlib.import_module(f"tessera.{module}")
        former = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, f=former: written.append((name, df.columns)) or f(df, name))
    return written


def test_each_text_is_embedded_once_and_no_sentence_vector_is_written(spark, tmp_path, monkeypatch):
    corpus = _corpus(spark)
    models = [E.PandasModel(f"hash-{d}", f"hashing/md5-{d}", _recorder(str(tmp_path))) for d in (64, 256)]
    written = _written(monkeypatch)
    ev = DocumentEvaluation(corpus, Options(models=models, ranges=3))
    got = finalize(ev.results(), 9).drop("model_id").orderBy("model_name", "doc").collect()
    monkeypatch.undo()
    of_vectors = [(name, "piece" in columns) for name, columns in written if "vec" in columns]
    # the paragraphs' and the queries', of a range its first and last; those of paragraphs once
    assert sorted(of_vectors) == [("adjacent", False), ("model-vectors", False), ("model-vectors", False)]
    native = DocumentEvaluation(corpus, Options(models=[E.HASH_64, E.HASH_256], ranges=3))
    assert got == finalize(native.results(), 9).drop("model_id").orderBy("model_name", "doc").collect() and len(got) == 4
    texts = [t for units, c in ((corpus.paragraphs, "text"), (corpus.sentences, "text"), (corpus.queries, "query"))
             for t in units.select(c).distinct().toPandas()[c]]
    for dim in (64, 256):
        assert _seen(tmp_path, dim) == sorted(texts)


def test_a_sentence_that_fails_leaves_no_result(spark, tmp_path):
    rows = [("a", 0, "One line that is fine. It has two sentences."), ("a", 1, "Another line, also fine and long enough."),
            ("b", 0, "Here stands a sentence zyxw. And one behind it."), ("b", 1, "The last line of the second document."),
            ("b", 2, "Twice a sentence zyxw. And one behind it."), (None, 0, "No document, a sentence zyxw. The end of it all.")]
    corpus = _corpus(spark, rows)
    broken = E.PandasModel("half", "hashing/md5-64", _recorder(str(tmp_path), "sentence zyxw."))
    lost = E.PandasModel("query", "hashing/md5-64", _recorder(str(tmp_path), corpus.queries.first()["query"]))
    fine = E.PandasModel("fine", "hashing/md5-64", E.python_hashing_factory)
    # a native model beside them: sentence vectors are written and read
    for natives in ([], [E.HASH_64]):
        corpus.paragraphs = corpus.paragraphs.withColumn("text", F.regexp_replace("text", "zyxw\\.", "zyxw"))
        ev = DocumentEvaluation(corpus, Options(models=[*natives, broken, lost, fine]))
        assert ev._searched_where_embedded() is not bool(natives)
        ledger = {tuple(r) for r in ev.failure_ledger().collect()}
        assert ledger == {("half", False, "b", "sentence", 2, "ValueError: refused"), ("half", False, None, "sentence", 1, "ValueError: refused"),
                          ("query", True, None, "query", 1, "ValueError: refused")}
        assert {(r.model_name, r.doc) for r in ev.results().collect() if r.model_name != "hash-64"} == {
            ("half", "a"), ("fine", "a"), ("fine", "b")}


@pytest.mark.parametrize("hot_rows", [1, 5, 1 << 16])
def test_texts_that_many_units_have(spark, tmp_path, hot_rows):
    texts = [None, "", "one", "two two", "Three, three; three!", "ÄÖÜ ß", "x_1 İ ΣαΣ"]
    rows = [(i, texts[i % len(texts)] if i % 3 else "the same", i % 4) for i in range(90)]
    units = spark.createDataFrame(rows, "id long, text string, other int")
    model = E.PandasModel("own", "hashing/md5-64", _recorder(str(tmp_path)), batch_size=3)
    former = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a text's units in several batches
    try:
        got = E.embed_with_model(units, model, hot_rows=hot_rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", former)
    want = {r.id: r for r in E.embed_native(units, [E.HASH_64], keep_text=True).collect()}
    assert sorted((r.id, r.other) for r in got) == [(i, o) for i, _, o in rows]
    for r in got:
        w = want[r.id]
        assert (r.text, r.vec, r.norm_sq, r.error) == (w.text, w.vec or [0.0] * 64, w.norm_sq or 0.0, None)
        assert (r.dim, r.model_name, r.model_id) == (64, "own", "hashing/md5-64")
        assert r.nz == [i for i, x in enumerate(r.vec) if x]
    assert _seen(tmp_path, 64) == sorted({t or "" for _, t, _ in rows})


def test_vectors_of_several_sizes_with_errors_and_nan(spark):
    def factory(model_id):
        def embed(texts):
            if len({len(t) for t in texts}) > 1 or "bad" in texts:
                raise ValueError("not together" if len(texts) > 1 else "bad")
            return np.array([[float("nan") if t == "nan" else len(t)] + [0.0] * (len(t) - 1) for t in texts])
        return embed

    units = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "nan", "four", "a", "bad"])], "id long, text string")
    got = {r.id: r for r in E.embed_with_model(units.coalesce(1), E.PandasModel("m", "m", factory)).collect()}
    assert np.isnan(got[2].vec[0])
    got[2].vec[0] = "no number"
    assert [(got[i].vec, got[i].nz, got[i].norm_sq, got[i].dim, got[i].error) for i in range(6)] == [
        ([1.0], [0], 1.0, 1, None), (None, None, None, None, "ValueError: bad"), (["no number", 0.0, 0.0], [0], None, 3, None),
        ([4.0, 0.0, 0.0, 0.0], [0], 16.0, 4, None), ([1.0], [0], 1.0, 1, None), (None, None, None, None, "ValueError: bad")]
