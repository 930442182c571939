"""Parsing: the sample document (golden counts) and edge cases."""

from conftest import SAMPLE_DOC

from tessera.operators import parse as P
from tessera.operators import queries as Q


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sample_document_golden(spark):
    text = open(SAMPLE_DOC, encoding="utf-8").read()
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    lines = P.document_lines(docs).collect()
    assert len(lines) == 15 and sum(r.is_header for r in lines) == 8
    parsed = P.parse_structure(docs)
    secs = P.sections(parsed).orderBy("section_id").collect()
    assert len(secs) == 8 and secs[0].n_body_lines == 0
    assert secs[0].header == "KEEPING BEES: A YEAR IN THE APIARY"
    paras = P.paragraphs(parsed).orderBy("para_idx").collect()
    assert [len(p.text) for p in paras] == [324, 361, 433, 468, 458, 468, 177]
    sents = P.sentences(parsed).collect()
    per_para = {}
    for s in sents:
        per_para[s.para_idx] = per_para.get(s.para_idx, 0) + 1
        assert s.text.endswith(".") and len(s.text) > 21
    assert len(sents) == 45 and [per_para[i] for i in range(7)] == [5, 6, 7, 8, 8, 8, 3]
    sp = P.section_paragraphs(parsed).collect()
    assert len(sp) == 7 and sorted({r.section_idx for r in sp}) == list(range(7))
    q = Q.topic_queries(parsed).orderBy("query_idx").collect()
    assert [r.query for r in q] == [
        "What does the document say about keeping bees: a year in the apiary?",
        "What does the document say about introduction?",
        "What does the document say about choosing hives?",
        "What does the document say about spring work?",
        "What does the document say about swarm control?"]
    assert [r.keywords for r in q] == [
        ["keeping", "bees", "year", "apiary", "information", "details"],
        ["introduction", "information", "details"],
        ["choosing", "hives", "information", "details"],
        ["spring", "work", "information", "details"],
        ["swarm", "control", "information", "details"]]


def test_edge_cases(spark):
    b49 = "x" * 49
    b50 = "y" * 50
    b51 = "z" * 51
    texts = [
        "",                                        # 0: nothing
        "Head one\nHead two!\nHead three?",        # 1: headers only
        "Body line before any header goes away.\nTitle\nA body line that ends with a period.",  # 2
        f"Title\n{b49}\n{b50}\n{b51}",             # 3: 49 -> header, 50/51 -> body
        "T\r\nSome body text here, long enough to keep.\r\n",  # 4: CRLF
        "T\nabcdefghij abcdefghi. twenty-one chars here.",     # 5: sentences of 20 / 21 chars
    ]
    parsed = P.parse_structure(_docs(spark, texts))
    lines = {(r.doc_id, r.line_no): r for r in P.document_lines(_docs(spark, texts)).collect()}
    assert not any(k[0] == 0 for k in lines)
    assert all(lines[(1, i)].is_header for i in range(3))
    assert lines[(3, 1)].is_header and not lines[(3, 2)].is_header and not lines[(3, 3)].is_header
    paras = P.paragraphs(parsed).collect()
    by_doc = {}
    for p in paras:
        by_doc.setdefault(p.doc_id, []).append(p.text)
    assert 1 not in by_doc
    assert by_doc[2] == ["A body line that ends with a period."]
    assert by_doc[3] == [b50, b51]
    assert by_doc[4] == ["Some body text here, long enough to keep."]
    sp = P.section_paragraphs(parsed).collect()
    assert [r.text for r in sp if r.doc_id == 3] == [b51]
    sents = [r.text for r in P.sentences(parsed).collect() if r.doc_id == 5]
    assert sents == ["twenty-one chars here."]


def test_generic_fallback(spark):
    texts = ["Alpha Beta\nA body line that is long enough to be a paragraph, really.",
             "What\nAbout\nDoes\nBody text for the document goes here and there."]
    q = Q.topic_queries(P.parse_structure(_docs(spark, texts))).collect()
    for d in ("0", "1"):
        qs = sorted((r.query_idx, r.query) for r in q if r.doc == d)
        assert len(qs) == 5 and qs[0][1] == "What is the main subject of this document?"


def test_topic_queries_kept_when_three(spark):
    text = "Planets Overview\nBody one is here and it is long.\nOcean Currents\nBody two.\nMountain Ranges\n"
    q = Q.topic_queries(P.parse_structure(_docs(spark, [text]))).orderBy("query_idx").collect()
    assert [r.keywords for r in q] == [["planets", "overview", "information", "details"],
                                       ["ocean", "currents", "information", "details"],
                                       ["mountain", "ranges", "information", "details"]]


def test_zip_query_lists(spark):
    df = spark.createDataFrame([("s", ["q1", "q2", "q3"], [["a"], ["b", "c"]])],
                               "set string, queries array<string>, keywords array<array<string>>")
    got = [(r.query_idx, r.query, r.keywords) for r in Q.queries_from_lists(df).orderBy("query_idx").collect()]
    assert got == [(0, "q1", ["a"]), (1, "q2", ["b", "c"])]     # shorter list wins


def test_long_conversation_is_paired_in_many_ranges(spark):
    rows = [("hot", i, f"Subject {i} about gardening") for i in range(500)] + [("one", 0, "alone"), (None, 4, "without key"),
            (None, 7, "last"), ("two", 1, None), ("two", 1, "same turn later text"), ("two", None, "first turn")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, text string").repartition(5)
    sets = Q.queries_from_turns(df, "conv_id", "turn", buckets=16)
    got = sorted(((r.conv_id or ""), r.query_idx, r.query, r.keywords) for r in sets.collect())
    want = [("", 0, "without key", ["without"])] + [
        ("hot", i, f"Subject {i} about gardening", ["subject", "gardening"]) for i in range(499)] + [
        ("two", 0, "first turn", ["first", "turn"]), ("two", 1, None, None)]
    assert got == want
    assert "collect_list" not in sets._jdf.queryExecution().toString()


def test_registered_query_sets_gather_no_conversation(spark):
    from tessera.plans.registry import registry
    df = registry()["conversation_query_sets"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_model_selection(spark):
    from tessera.operators import embed as E
    from tessera.plans.evaluate import models_for_flag, select_models
    from tessera.sources import literals as L
    assert [m.name for m in select_models(E.NATIVE_MODELS, ["hash-256"])] == ["hash-256"]
    assert select_models(E.NATIVE_MODELS, None) == E.NATIVE_MODELS
    import pytest
    with pytest.raises(ValueError):
        select_models(E.NATIVE_MODELS, ["nope"])
    full = [E.HashingModel(n, 8) for n, _ in L.DOCUMENT_MODELS]
    reduced = [E.HashingModel(n, 8) for n, _ in L.REDUCED_MODELS]
    req = spark.createDataFrame([("a", None), ("b", "Yes"), ("c", "off")], "doc string, flag string")
    got = {}
    for r in models_for_flag(req, "flag", full, reduced).collect():
        got.setdefault(r.doc, []).append(r.model_name)
    assert got == {"a": [n for n, _ in L.DOCUMENT_MODELS], "b": [n for n, _ in L.DOCUMENT_MODELS],
                   "c": ["bge-small-en-v1.5"]}


def test_strip_matches_python(spark):
    from pyspark.sql import functions as F
    from tessera.functions import text as T
    samples = ["  a b  ", "\x1c\x1dx\x1f", "　y ", "\t\n z \x0b\x0c\r", "", "   ", "\x85q\xa0"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(T.strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]
