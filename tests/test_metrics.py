"""Coherence, contrast and search against brute force on small fixtures."""

import itertools

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.operators import coherence as C
from tessera.operators import contrast as K
from tessera.operators import embed as E
from tessera.operators import search as R
from tessera.plans import corpora as CO


def _vecs(spark, rows, model="m"):
    """rows: (doc, section, major, minor, vector)"""
    df = spark.createDataFrame([(d, s, a, b, [float(x) for x in v]) for d, s, a, b, v in rows],
                               "doc string, section string, major long, minor long, embedding array<double>")
    return E.vectors_from_array(df, model)


def _cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    na, nb = a @ a, b @ b
    return None if na == 0 or nb == 0 else float(a @ b / np.sqrt(na * nb))


@pytest.fixture(scope="module")
def given(spark):
    return CO.vector_corpus(spark, SF_SMALL).cache()


def test_blocked_lag_equals_plain_lag(spark, given):
    rows = sorted(given.select("major", "vec").collect())
    want = [_cos(rows[i - 1].vec, rows[i].vec) for i in range(1, len(rows))]
    for block in (1, 2, 7, 40):
        got = sorted((r.major, r.similarity) for r in C.adjacent_similarity(given, ranges=block).collect())
        assert [g[0] for g in got] == [r.major for r in rows[1:]]
        assert np.allclose([g[1] for g in got], want, atol=1e-12), block


def test_block_gaps_and_documents(spark):
    rows = [("d1", "s", 0, 0, [1, 0]), ("d1", "s", 5, 0, [1, 1]), ("d1", "s", 5, 1, [0, 1]),
            ("d1", "s", 40, 0, [1, 2]), ("d2", "s", 3, 0, [1, 0]), ("d3", "s", 9, 0, [0, 0]),
            ("d3", "s", 10, 0, [1, 0])]
    adj = C.adjacent_similarity(_vecs(spark, rows), ranges=4).collect()
    got = {(r.doc, r.major, r.minor): (r.prev_major, r.prev_minor, r.similarity) for r in adj}
    assert got[("d1", 5, 0)][:2] == (0, 0) and got[("d1", 5, 1)][:2] == (5, 0)
    assert got[("d1", 40, 0)][:2] == (5, 1)
    assert ("d2", 3, 0) not in got and got[("d3", 10, 0)][2] is None
    coh = {r.doc: r for r in C.paragraph_coherence(C.adjacent_similarity(_vecs(spark, rows))).collect()}
    assert "d2" not in coh                      # a single paragraph has no result
    assert coh["d3"].n_undefined == 1 and coh["d3"].avg_coherence is None


def _brute_contrast(rows):
    out = {}
    for doc in {r[0] for r in rows}:
        us = [r for r in rows if r[0] == doc and np.any(r[4])]
        within, cross = [], []
        for a, b in itertools.combinations(us, 2):
            (within if a[1] == b[1] else cross).append(_cos(a[4], b[4]))
        out[doc] = (np.mean(within) if within else 0.0, np.mean(cross) if cross else 0.0,
                    np.std(within) if within else 0.0, np.std(cross) if cross else 0.0,
                    len(within), len(cross))
    return out


@pytest.mark.parametrize("small_max,rows_per_partial", [(10 ** 6, 10), (0, 10 ** 6), (0, 7), (5, 3)])
def test_contrast_paths_agree_with_brute_force(spark, small_max, rows_per_partial):
    rng = np.random.default_rng(11)
    rows = []
    for d, n in (("a", 3), ("b", 40), ("c", 1), ("e", 25)):
        for i in range(n):
            v = rng.integers(0, 3, 6).astype(float) if i % 9 else np.zeros(6)
            rows.append((d, f"s{i % 4}", i // 3, i % 3, list(v)))
    want = _brute_contrast(rows)
    got = K.section_contrast(_vecs(spark, rows), small_max=small_max, rows_per_partial=rows_per_partial).collect()
    assert {r.doc for r in got} == set(want)
    for r in got:
        w = want[r.doc]
        assert (r.n_within_pairs, r.n_cross_pairs) == (w[4], w[5])
        np.testing.assert_allclose([r.avg_within_section_similarity, r.avg_cross_section_similarity,
                                    r.within_similarity_std, r.cross_similarity_std], w[:4], atol=1e-9)
        assert abs(r.section_boundary_contrast - (w[0] - w[1])) < 1e-9


def test_moment_form_on_given_vectors(spark, given):
    rows = [(r.doc, r.section, r.major, r.minor, list(r.vec)) for r in given.collect()]
    w = _brute_contrast(rows)["embeddings"]
    b = {r.doc: r for r in K.section_contrast(given, small_max=0, rows_per_partial=97).collect()}["embeddings"]
    assert b.n_within_pairs + b.n_cross_pairs == 500 * 499 // 2 == w[4] + w[5]
    np.testing.assert_allclose([b.avg_within_section_similarity, b.avg_cross_section_similarity,
                                b.within_similarity_std, b.cross_similarity_std], w[:4], atol=1e-10)


def test_search_ties_and_precision(spark):
    sents = spark.createDataFrame(
        [("d", 0, 0, 0, "alpha beta"), ("d", 0, 0, 1, "alpha beta"), ("d", 1, 0, 0, "alpha beta"),
         ("d", 2, 0, 0, "alpha beta"), ("e", 0, 0, 0, "gamma")],
        "doc string, major long, minor long, piece int, text string")
    queries = spark.createDataFrame([(0, "alpha beta", ["beta", "x", "y", "z"])],
                                    "query_idx int, query string, keywords array<string>")
    models = [E.HashingModel("h", 16)]
    sv = E.embed_native(sents, models, keep_text=True)
    qv = E.embed_native(queries, models, text_col="query", keep_text=True)
    top = R.top_k(R.query_sentence_similarity(sv, qv, per_document=False)).collect()
    d = sorted((r.rank, r.major, r.piece) for r in top if r.doc == "d")
    assert d == [(1, 2, 0), (2, 1, 0), (3, 0, 1)]      # ties: later sentence first
    hits = R.keyword_hits(R.top_k(R.query_sentence_similarity(sv, qv, False)), queries, False)
    docs = spark.createDataFrame([("h", "d"), ("h", "e"), ("h", "z")], "model_name string, doc string")
    qp = {r.doc: r.precision for r in R.query_precision(docs, qv, hits, False).collect()}
    assert qp == {"d": 0.75, "e": 0.0, "z": 0.0}        # 3 hits / 4 keywords; no sentence -> 0


def test_small_groups_across_arrow_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{i % 3}", f"s{i % 2}", i, 0, list(rng.integers(0, 4, 5).astype(float) + (i % 2)))
            for i in range(60)]
    want = _brute_contrast(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = K.section_contrast(_vecs(spark, rows), small_max=64).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in got:
        w = want[r.doc]
        assert (r.n_within_pairs, r.n_cross_pairs) == (w[4], w[5])
        np.testing.assert_allclose([r.avg_within_section_similarity, r.avg_cross_section_similarity,
                                    r.within_similarity_std, r.cross_similarity_std], w[:4], atol=1e-9)


def test_hot_document_all_skew_paths(spark):
    """One document holds a third of all units: coherence runs over many
    stitched ranges and contrast over many salted Gram chunks, and both still
    equal brute force."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):                                   # the hot document
        rows.append(("hot", f"s{i // 37}", i // 4, i % 4, list(rng.integers(0, 3, 8).astype(float) + 0.5)))
    for d in range(60):                                    # many small documents
        for i in range(10):
            rows.append((f"d{d}", f"s{i % 3}", i, 0, list(rng.integers(0, 3, 8).astype(float))))
    vecs = _vecs(spark, rows)
    want = _brute_contrast(rows)
    got = {r.doc: r for r in K.section_contrast(vecs, small_max=8, rows_per_partial=50).collect()}
    assert set(got) == set(want)
    for doc, w in want.items():
        r = got[doc]
        assert (r.n_within_pairs, r.n_cross_pairs) == (w[4], w[5]), doc
        np.testing.assert_allclose([r.avg_within_section_similarity, r.avg_cross_section_similarity,
                                    r.within_similarity_std, r.cross_similarity_std], w[:4], atol=1e-9)
    hot = sorted(r for r in rows if r[0] == "hot")
    ordered = sorted(hot, key=lambda r: (r[2], r[3]))
    want_adj = [_cos(ordered[i - 1][4], ordered[i][4]) for i in range(1, len(ordered))]
    adj = sorted((r.major, r.minor, r.similarity)
                 for r in C.adjacent_similarity(vecs, ranges=9).collect() if r.doc == "hot")
    assert len(adj) == 299
    np.testing.assert_allclose([a[2] for a in adj], want_adj, atol=1e-12)


def test_hot_document_runs_in_many_tasks(spark):
    """Two thirds of the rows in one document, no broadcast joins: its chunks
    are dealt to several tasks, and the numbers equal brute force."""
    from pyspark.sql.functions import spark_partition_id
    rng = np.random.default_rng(5)
    rows = [("hot", f"s{i // 60}", i, 0, list(rng.integers(0, 3, 6).astype(float) + 0.5)) for i in range(400)]
    rows += [(f"d{i % 20}", "s", i, 0, list(rng.integers(0, 3, 6).astype(float))) for i in range(200)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with much data
    try:
        vecs = _vecs(spark, rows)
        v = vecs.filter("norm_sq > 0")
        sized = v.join(v.groupBy("model_name", "doc").count().withColumnRenamed("count", "n"), ["model_name", "doc"])
        chunks = (sized.withColumn("n_chunks", F.ceil(F.col("n") / 20))
                  .withColumn("salt", F.pmod(F.xxhash64("major", "minor"), F.col("n_chunks")))
                  .repartition(F.col("model_name"), F.col("doc"), F.col("salt")))
        tasks = {r[0] for r in chunks.where("doc = 'hot'").select(spark_partition_id()).distinct().collect()}
        assert len(tasks) > 3
        plan = K.pair_statistics(vecs, ["model_name", "doc"], small_max=8, rows_per_partial=20) \
            ._jdf.queryExecution().executedPlan().toString()
        assert any("salt" in x for x in plan.splitlines() if "hashpartitioning" in x)
        got = {r.doc: r for r in K.section_contrast(vecs, small_max=8, rows_per_partial=20).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    w = _brute_contrast(rows)["hot"]
    r = got["hot"]
    assert (r.n_within_pairs, r.n_cross_pairs) == (w[4], w[5])
    np.testing.assert_allclose([r.avg_within_section_similarity, r.avg_cross_section_similarity], w[:2], atol=1e-9)


def test_pair_counts_are_exact(spark):
    ns = [0, 1, 2, 3, 4, 10 ** 10, 10 ** 10 + 1, 4 * 10 ** 18]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert [int(r[0]) for r in df.select(K.pairs_of(F.col("n"))).collect()] == [n * (n - 1) // 2 for n in ns]


def test_sparse_and_repeated_order_keys(spark):
    """Order keys far apart, and many lines of one key, in a few ranges; one shuffle and one scan of the vectors."""
    rng = np.random.default_rng(3)
    rows = [("d", "s", int(k), j, list(rng.integers(0, 3, 5).astype(float) + 0.1))
            for k in (-10 ** 15, 0, 7, 10 ** 17) for j in range(25)]
    vecs = _vecs(spark, rows)
    want = [_cos(rows[i - 1][4], rows[i][4]) for i in range(1, len(rows))]
    got = sorted((r.major, r.minor, r.similarity) for r in C.adjacent_similarity(vecs, ranges=6).collect())
    assert np.allclose([g[2] for g in got], want, atol=1e-6)
    plan = vecs.select("model_name", "doc", "major", "minor", "vec", "norm_sq").repartitionByRange(
        6, "model_name", "doc", "major", "minor")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1


def test_query_blocks_equal_one_join(spark):
    """A caller's queries in blocks of a few give the rows of the plain join, and precision needs no product."""
    from tessera.operators import queries as Q
    from tessera.sources.tables import read_table
    corpus = CO.chat_corpus(spark, SF_SMALL)
    queries = Q.passage_queries(read_table(spark, SF_SMALL, "benchmark"))
    none = spark.createDataFrame([(10 ** 6, "a to of", [])], "query_idx int, query string, keywords array<string>")
    queries = queries.unionByName(none)
    sv = E.embed_native(corpus.sentences, [E.HASH_64], keep_text=True)
    qv = E.embed_native(queries, [E.HASH_64], text_col="query", keep_text=True)
    plain = R.top_k(R.query_sentence_similarity(sv, qv, False))
    blocks = R.top_k_in_blocks(sv, qv, block_components=64 * 7)
    key = lambda d: sorted((r.doc, r.query_idx, r["rank"], r.major, r.minor, r.piece) for r in d.collect())
    assert key(plain) == key(blocks)
    docs = corpus.paragraphs.select(F.lit("hash-64").alias("model_name"), "doc").distinct()
    hits = R.keyword_hits(blocks, queries, False)
    want = {r.doc: r for r in R.search_precision(R.query_precision(docs, qv, hits, False)).collect()}
    got = {r.doc: r for r in R.search_precision_of_set(docs, queries, hits).collect()}
    assert set(want) == set(got)
    for d, r in got.items():
        for c in ("n_queries", "semantic_search_precision", "min_precision", "max_precision", "search_precision_std"):
            assert abs(r[c] - want[d][c]) < 1e-9, (d, c)


def test_a_task_hands_on_its_best_only(spark):
    """The default set and a caller's: neither a row for each comparison nor one for each batch leaves a task."""
    from types import SimpleNamespace

    from tessera.plans.evaluate import DocumentEvaluation
    texts = [f"word{i % 7} word{i % 5} main topic {i % 3} and some more of it" for i in range(60)]
    sents = spark.createDataFrame(
        [(f"d{i % 2}" if i % 20 else None, i // 3 if i % 11 else None, 0, i % 3, t) for i, t in enumerate(texts)]
        + [("zero", 0, 0, 0, "")], "doc string, major long, minor long, piece int, text string")
    corpus = CO.Corpus("own", sents.withColumn("section", F.lit("s")), sents, CO.Q.default_queries(spark))
    ev = DocumentEvaluation(corpus)
    key = lambda d: sorted(map(repr, (
        (r.model_name, r.doc, r.query_idx, r["rank"], r.major, r.minor, r.piece, r.similarity, r.text) for r in d.collect())))
    want = key(R.top_k(ev.similarities()))
    assert want and key(ev.top3()) == want
    assert "Join" not in ev.top3()._jdf.queryExecution().optimizedPlan().toString()
    s, q = ev.sentence_vectors(), ev.query_vectors()
    for kept in (1, 1 << 18):
        got = R.top_k_in_blocks(s, q, kept_rows=kept, nan_is_largest=True)
        assert key(got) == want
    columns = ["model_name", "doc", *R.SENT_ORDER, "text", "vec", "norm_sq"]
    batches = s.where("model_name = 'hash-64'").select(*columns).toArrow().to_batches(max_chunksize=4)
    sent = SimpleNamespace(value=R._query_matrices(q.collect(), ["model_name"]))
    out = sum(b.num_rows for b in R._best_of_task(sent, 3, False, True, 1 << 18, None)(iter(batches)))
    assert out == 7 * (3 + 3 + 3 + 1)


def test_a_similarity_that_is_no_number_keeps_its_place(spark):
    schema = "model_name string, doc string, major long, minor long, piece int, text string, dim int, vec array<float>, " \
             "nz array<int>, norm_sq double"
    nan = float("nan")
    s = spark.createDataFrame([("m", "d", i, 0, 0, f"t{i}", 2, v, [0, 1], n) for i, (v, n) in enumerate(
        [([1.0, 0.0], 1.0), ([nan, 1.0], nan), ([0.0, 0.0], 0.0), ([1.0, 1.0], 2.0), ([1.0, 2.0], None)])], schema)
    q = spark.createDataFrame([("m", 0, 2, [1.0, 0.0], [0], 1.0)],
                              "model_name string, query_idx int, dim int, vec array<float>, nz array<int>, norm_sq double")
    key = lambda d: sorted((r["rank"], r.major, repr(r.similarity)) for r in d.collect())
    want = key(R.top_k(R.query_sentence_similarity(s, q, False), 5))
    assert key(R.top_k_in_blocks(s, q, 5, nan_is_largest=True)) == want


def test_a_dealt_document_has_parts_by_its_size(spark):
    """Each part gives a Gram matrix: their number must not grow with that of the tasks."""
    rows = spark.range(0, 1000, 1, 4).selectExpr("'a' doc", "string(id div 5) section", "id major", "0L minor", "id value")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        dealt = K._dealt(rows, ["doc"], 100, 64).select("value", "section", "dealt", "dealt_section",
                                                        F.spark_partition_id().alias("part")).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert sorted(r.value for r in dealt) == list(range(1000)) and all(r.dealt and not r.dealt_section for r in dealt)
    assert 1 < len({r.part for r in dealt}) <= 10
    assert len({(r.part, r.section) for r in dealt}) == 200
