"""End-to-end document evaluation on the sample document and edge documents."""

from conftest import SAMPLE_DOC

from tessera.plans.corpora import strict_corpus_of
from tessera.plans.evaluate import DocumentEvaluation, Options


def test_sample_document_end_to_end(spark):
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    docs = spark.createDataFrame([(0, text), (1, ""), (2, "Only\nHeaders"),
                                  (3, "Title\nOne single body paragraph that is long enough to count.")],
                                 "doc_id long, text string")
    corpus, _ = strict_corpus_of(docs)
    ev = DocumentEvaluation(corpus)
    res = {(r.model_name, r.doc): r for r in ev.results().collect()}
    # documents with fewer than two paragraphs get no result (empty, headers only, one paragraph)
    assert {d for _, d in res} == {"0"}
    for m in ("hash-64", "hash-256"):
        r = res[(m, "0")]
        assert r.n_adjacent_pairs == 6
        assert r.n_within_pairs == 0 and r.n_cross_pairs == 21      # one paragraph per section
        assert r.avg_within_section_similarity == 0.0 and r.within_similarity_std == 0.0
        assert abs(r.section_boundary_contrast + r.avg_cross_section_similarity) < 1e-15
        assert r.n_queries == 5
        assert abs(r.overall_score - (0.3 * r.avg_coherence + 0.3 * r.section_boundary_contrast
                                      + 0.4 * r.semantic_search_precision)) < 1e-12
        assert -1.0 <= r.min_coherence <= r.avg_coherence <= r.max_coherence <= 1.0
    qp = ev.query_precision().collect()
    for r in qp:
        assert r.keyword_matches <= 3 and r.precision == min(1.0, r.keyword_matches / r.n_keywords)


def test_progress_counters(spark):
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    corpus, _ = strict_corpus_of(docs)
    ev = DocumentEvaluation(corpus, Options(observe=True))
    ev.results().collect()
    p = ev.progress()
    assert p["paragraph_vectors"]["n_vectors"] == 7 * 2        # 7 paragraphs x 2 models
    assert p["sentence_vectors"]["n_vectors"] == 45 * 2


def test_user_models_and_given_vectors_enter_the_evaluation(spark):
    from tessera.operators import embed as E
    from pyspark.sql import functions as F
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    docs = spark.createDataFrame([(0, text), (1, text + "\nOne more line that ends the text.")], "doc_id long, text string")
    corpus, _ = strict_corpus_of(docs)
    native = DocumentEvaluation(corpus, Options(models=[E.HASH_64]))
    given = native.paragraph_vectors().drop("model_name")

    def broken(model_id):
        raise RuntimeError("cannot load")

    user = E.PandasModel("mine", "hashing/md5-64", E.python_hashing_factory)
    ev = DocumentEvaluation(corpus, Options(models=[user, E.PandasModel("broken", "x", broken)], given=[("given", given)]))
    want = {r.doc: r for r in native.results().collect()}
    got = {(r.model_name, r.doc): r for r in ev.results().collect()}
    assert set(got) == {(m, d) for m in ("mine", "given") for d in ("0", "1")}
    for (m, d), r in got.items():
        assert abs(r.avg_coherence - want[d].avg_coherence) < 1e-9
        assert abs(r.section_boundary_contrast - want[d].section_boundary_contrast) < 1e-9
        if m == "mine":
            assert abs(r.overall_score - want[d].overall_score) < 1e-9
    failed = {r.doc: (r.model_name, r.n_failed, r.error) for r in ev.failed_units().collect()}
    paragraphs = {r.doc: r["count"] for r in corpus.paragraphs.groupBy("doc").count().collect()}
    assert failed == {d: ("broken", n, "RuntimeError: cannot load") for d, n in paragraphs.items()}


def _half_failing(where):
    import numpy as np

    def factory(model_id):
        def embed(texts):
            if any(where in t for t in texts):
                raise ValueError("refused")
            return np.array([[len(t), t.count("e"), 1.0] for t in texts], dtype=np.float32)
        return embed
    return factory


def test_one_failing_unit_of_any_kind_leaves_no_result(spark):
    from tessera.operators import embed as E
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    docs = spark.createDataFrame([(0, text + "\nA closing line with the word zyxw, and more of it. Then a second one here."),
                                  (1, text)], "doc_id long, text string")
    corpus, _ = strict_corpus_of(docs)
    query = corpus.queries.where("doc = '1'").orderBy("query_idx").first()["query"]
    sentence = corpus.sentences.where("text like '%zyxw%'").first()["text"]
    for kind, where in (("sentence", sentence), ("query", query)):  # a sentence ends in a full stop, a paragraph holds more
        ev = DocumentEvaluation(corpus, Options(models=[E.HASH_64, E.PandasModel("half", "x", _half_failing(where))]))
        ledger = {(r.model_name, r.every_doc, r.doc, r.unit_kind, r.error) for r in ev.failure_ledger().collect()}
        bad = {r[2] for r in ledger}
        assert {r[3] for r in ledger} >= {kind} and {(r[0], r[1], r[4]) for r in ledger} == {("half", False, "ValueError: refused")}
        got = {(r.model_name, r.doc) for r in ev.results().collect()}
        assert got == {("hash-64", "0"), ("hash-64", "1")} | {("half", d) for d in {"0", "1"} - bad}
        assert {(r.model_name, r.doc) for r in ev.search().collect()} == got
    corpus.queries = corpus.queries.where("doc = '1'").drop("doc")
    corpus.per_document_queries = False
    ev = DocumentEvaluation(corpus, Options(models=[E.HASH_64, E.PandasModel("half", "x", _half_failing(query))]))
    (row,) = ev.failure_ledger().collect()
    assert row.every_doc and row.doc is None and row.unit_kind == "query" and row.n_failed == 1
    assert {(r.model_name, r.doc) for r in ev.results().collect()} == {("hash-64", "0"), ("hash-64", "1")}
    assert ev.failed_units().collect() == []


def test_given_vectors_with_and_without_search(spark):
    from tessera.operators import embed as E
    from tessera.plans.evaluate import GivenVectors
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    corpus, _ = strict_corpus_of(spark.createDataFrame([(0, text), (1, text + "\nOne more line.")], "doc_id long, text string"))
    native = DocumentEvaluation(corpus, Options(models=[E.HASH_64]))
    tables = GivenVectors(native.paragraph_vectors().drop("model_name"), native.sentence_vectors().drop("model_name"),
                          native.query_vectors().drop("model_name", "query", "keywords"))
    ev = DocumentEvaluation(corpus, Options(models=[E.HASH_64], given=[("all", tables), ("bare", tables.paragraphs)]))
    rows = {(r.model_name, r.doc): r for r in ev.results().collect()}
    assert set(rows) == {(m, d) for m in ("hash-64", "all", "bare") for d in ("0", "1")}
    for d in ("0", "1"):
        want, full, bare = (rows[m, d] for m in ("hash-64", "all", "bare"))
        assert (full.n_queries, full.semantic_search_precision) == (want.n_queries, want.semantic_search_precision)
        assert abs(full.overall_score - want.overall_score) < 1e-12 and abs(bare.avg_coherence - want.avg_coherence) < 1e-12
        assert [bare[c] for c in ("overall_score", "n_queries", "semantic_search_precision", "max_precision")] == [None] * 4


def test_tiles_and_blocks_give_what_the_join_gives(spark):
    from pyspark.sql import functions as F
    from tessera.operators import search as R
    from tessera.plans.corpora import chat_corpus_with_own_queries
    corpus = chat_corpus_with_own_queries(spark, "/root/testdata/sf0.001")
    hot = F.when(F.xxhash64("doc") % 3 == 0, F.lit("hot"))  # a third of all conversations becomes one document
    sentences = corpus.sentences.withColumn("major", F.col("major") + F.xxhash64("doc") % 1000 * 100).withColumn(
        "doc", F.coalesce(hot, "doc"))
    queries = corpus.queries.withColumn("query_idx", F.col("query_idx") + F.xxhash64("doc") % 1000 * 100).withColumn(
        "doc", F.coalesce(hot, "doc")).dropDuplicates(["doc", "query_idx"])
    corpus.sentences, corpus.queries = sentences.dropDuplicates(["doc", "major", "minor", "piece"]), queries
    ev = DocumentEvaluation(corpus)
    s, q = ev.sentence_vectors(), ev.query_vectors()
    rows = lambda df: sorted((r.model_name, r.doc, r.query_idx, r["rank"], r.major, r.minor, r.piece,
                              -1 if r.similarity is None else round(r.similarity, 9)) for r in df.collect())
    want = rows(R.top_k(R.query_sentence_similarity(s, q, True)))
    assert want and rows(R.top_k_in_tiles(s, q)) == want
    assert rows(R.top_k_in_tiles(s, q, tile_sentences=7, tile_queries=5)) == want
    shared = q.where("doc = 'hot'").drop("doc")
    want = rows(R.top_k(R.query_sentence_similarity(s, shared, False)))
    for components in (1 << 20, 500):
        assert rows(R.top_k_in_blocks(s, shared, block_components=components)) == want


def test_a_few_own_queries_go_to_the_sentences(spark, monkeypatch):
    """Long documents: their queries fit one block, so that no sentence vector is written or dealt out."""
    from tessera.operators import search as R
    from tessera.plans import corpora as CO
    lines = CO.source_lines(spark, "/root/testdata/sf0.001")
    ev = DocumentEvaluation(CO.long_corpus(lines, ranges=3))
    rows = lambda df: sorted((r.model_name, r.doc, r.query_idx, r["rank"], r.major, r.minor, r.piece,
                              -1 if r.similarity is None else round(r.similarity, 9)) for r in df.collect())
    want = R.top_k_in_tiles(ev.sentence_vectors(), ev.query_vectors())
    monkeypatch.setattr(R, "top_k_in_tiles", None)
    got = ev.top3()
    assert rows(got) == rows(want) and rows(got)
    assert got.schema["query_idx"] == want.schema["query_idx"]
