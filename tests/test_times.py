"""Times of a timed evaluation: those that the model took, by document."""

import importlib
import time

import numpy as np
import pytest

from tessera.operators import embed as E
from tessera.plans import corpora as CO
from tessera.plans import pair_eval as PE
from tessera.plans.evaluate import DocumentEvaluation, Options
from tessera.plans.registry import finalize
from tessera.sources import results_io as IO

NAP = 0.02


def _sleeper():
    """Takes its time for each text, longer for one with "slow" in it, and half a second to load."""
    def load(model_id):
        time.sleep(0.5)

        def embed(texts):
            time.sleep(sum(NAP * (5 if "slow" in t else 1) for t in texts))
            return np.array([[1.0 + len(t), 2.0 + t.count("e")] for t in texts], dtype=np.float32)
        return embed
    return load


DOCS = [("quick", "Title one\nThe first paragraph is here, it is long enough to count as one of a section.\n"
                  "Another paragraph of the same section follows, which is about the same length.\n"),
        ("slow", "Title two\nThe slow paragraph is here, it is long enough to count as one of a section.\n"
                 "Another slow paragraph of that section follows, which is about the same length.\n"),
        ("short", "Title\nOnly one paragraph, so that there is no result of this document at all.\n")]


@pytest.mark.parametrize("long_rows", [False, True])
def test_times_are_those_of_the_documents_units(spark, long_rows):
    df = spark.createDataFrame(DOCS, "doc_id string, text string")
    if long_rows:
        rows = [(d, 0, i, line) for d, text in DOCS for i, line in enumerate(text.split("\n"))]
        corpus = CO.long_corpus(spark.createDataFrame(rows, "doc_id string, major long, minor long, line string"), 4)
    else:
        corpus, _ = CO.strict_corpus_of(df)
    # batches of one text: no text shares its time with another
    model = E.PandasModel("sleeper", "sleeper", _sleeper(), batch_size=1)
    ev = DocumentEvaluation(corpus, Options(models=[E.NATIVE_MODELS[0], model], timed=True))
    got = {(r.model_name, r.doc): r for r in ev.results().collect()}
    assert {k[1] for k in got} == {"quick", "slow"}
    n = {r.doc: r.n for r in corpus.sentences.groupBy("doc").count().withColumnRenamed("count", "n").collect()}
    n_queries = corpus.queries.groupBy("doc").count().collect()[0]["count"]
    for doc in ("quick", "slow"):
        r = got["sleeper", doc]
        units = 2 + n[doc] + n_queries
        assert r.n_embedded == units == got["hash-64", doc].n_embedded
        least = 0.5 + NAP * units + (NAP * 4 * 4 if doc == "slow" else 0)
        assert least * 0.99 <= r.evaluation_time_seconds < least + 2
        assert 0 < got["hash-64", doc].evaluation_time_seconds < 2
    assert got["sleeper", "slow"].evaluation_time_seconds > got["sleeper", "quick"].evaluation_time_seconds
    totals = {r.model_name: r for r in ev.total_times().collect()}
    assert totals["sleeper"].n_docs == 2 and totals["sleeper"].total_time_seconds == pytest.approx(
        sum(r.evaluation_time_seconds for k, r in got.items() if k[0] == "sleeper"))
    nested = IO.nest(ev.results(), time_col="evaluation_time_seconds").collect()
    assert all(r.result.evaluation_time_seconds > 0 for r in nested)
    untimed = DocumentEvaluation(corpus, Options(models=[E.NATIVE_MODELS[0]]))
    assert "evaluation_time_seconds" not in untimed.results().columns
    with pytest.raises(ValueError):
        untimed.evaluation_times()


def test_shared_queries_count_for_each_document(spark):
    corpus, _ = CO.strict_corpus_of(spark.createDataFrame(DOCS, "doc_id string, text string"))
    corpus.queries, corpus.per_document_queries = CO.Q.default_queries(spark), False
    times = DocumentEvaluation(corpus, Options(models=[E.NATIVE_MODELS[0]], timed=True)).evaluation_times().collect()
    sentences = {r.doc: r["count"] for r in corpus.sentences.groupBy("doc").count().collect()}
    assert {r.doc: r.n_embedded for r in times} == {"quick": 9 + sentences["quick"], "slow": 9 + sentences["slow"],
                                                    "short": 8 + sentences["short"]}


def test_comparison_shows_measured_times(spark):
    table = spark.createDataFrame([(0, "native", 0.123456, 1.0, 64), (1, "own", -0.00001, None, 3)],
                                  "model_order int, model_name string, pearson_correlation double, "
                                  "spearman_correlation double, embedding_dimension int")
    timing = spark.createDataFrame([("own", 1.005, 0.03125)],
                                   "model_name string, load_time_seconds double, average_embedding_time_seconds double")
    got = [tuple(r)[1:] for r in PE.comparison_display(table, timing).orderBy("model_order").collect()]
    assert got == [("native", "0.1235", "1.0000", 64, None, None), ("own", "-0.0000", None, 3, "1.00", "0.0313")]


def test_timed_native_models_exchange_no_vectors(spark, monkeypatch):
    rows = [("a", i, f"Paragraph {i} of the document has a sentence. And it has another one, about as long.") for i in range(40)] + [
        ("b", 0, "One paragraph alone, with a single sentence.")]
    units = spark.createDataFrame(rows, "doc string, major long, text string").selectExpr(
        "doc", "string(major div 5) section", "major", "0L minor", "text")
    corpus = CO.Corpus("own", units, CO.P.sentence_units(units), CO.Q.default_queries(spark))
    written = []
    for module in ("evaluate", "operators.search", "operators.coherence", "operators.contrast", "operators.embed"):
        module = importlib.import_module(f"tessera.{'plans.' if module == 'evaluate' else ''}{module}")
        former = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, f=former: written.append((name, df.columns)) or f(df, name))
    timed, plain = (DocumentEvaluation(corpus, Options(timed=t, ranges=3)) for t in (True, False))
    got = timed.results().drop("n_embedded", "evaluation_time_seconds")
    vectors = {name for name, columns in written if "vec" in columns}
    assert vectors <= {"adjacent", "query-vectors", "timed-query"}  # of a range its first and last, and the queries
    key = ["model_name", "doc"]
    assert finalize(got, 9).orderBy(key).collect() == finalize(plain.results().select(got.columns), 9).orderBy(key).collect()
    times = {(r.model_name, r.doc): r for r in timed.evaluation_times().collect()}
    assert {k: r.n_embedded for k, r in times.items()} == {
        (m.name, d): n for m in E.NATIVE_MODELS for d, n in (("a", 40 + 80 + 7), ("b", 1 + 1 + 7))}
    assert all(r.evaluation_time_seconds > 0 for r in times.values())
