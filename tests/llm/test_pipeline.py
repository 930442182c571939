"""The pipeline: each stage's decisions, and what reaches the windows."""

import re
from collections import Counter

import pytest
from llm_tables import SF_SMALL, awkward, empty  # noqa: F401

from tessera.sources.tables import read_table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_packed_rows(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = read_table(spark, SF_SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{id(docs)}"
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {p.doc_id for p in pieces} == kept
    run = corpus_pipeline.run(spark, SF_SMALL).collect()
    key = lambda p: (p.doc_id, p.start, p.length, bytes(p.ids))
    total = lambda rows: Counter({d: sum(p.length for p in rows if p.doc_id == d) for d in {p.doc_id for p in rows}})
    assert total(run) == total(pieces) and all(key(p)[2] > 0 for p in run)


def test_queries_run_and_have_named_columns(spark):
    import __spark_entry__ as entry
    from tessera.llm.queries import llm_oracles, llm_queries
    assert {int(n[2:].split("_")[0]) for n in llm_queries()} == set(range(1, 14))
    assert set(llm_oracles()) <= set(llm_queries()) <= set(entry.queries()) and "pipeline" in entry.queries()


def test_stages_on_awkward_and_empty_tables(spark, awkward, empty):
    clean = awkward.where("label is not null").select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (awkward, clean, empty, empty.select("doc_id", "text")):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = f"{spark.conf.get('spark.checkpoint.dir')}/awkward-{name}-{id(docs)}"
            stage(spark, now, SF_SMALL).write.parquet(path)
            before, now = Counter(map(repr, now.collect())), spark.read.parquet(path)
            assert now.columns == docs.columns and not Counter(map(repr, now.collect())) - before
            if name == "exact_dedup":  # one row of each text, null as empty
                body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
                held = Counter(body(r.text) for r in now.collect())
                assert set(held.values()) <= {1} and set(held) == {body(t) for t in texts_before}
            texts_before = [r.text for r in now.collect()]
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF_SMALL).collect()
        assert Counter(p.doc_id for p in pieces).keys() == Counter(r.doc_id for r in now.collect()).keys()
