"""Named queries over the driver's tables: ``name -> fn(spark, sf_dir)``.

Each returns a DataFrame with flat, named columns; doubles are rounded to 6
digits so that results compare across engines (summation order differs).
Every query reads the given tables and runs over all of their rows.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import display as D
from ..functions import text as T
from ..operators import embed as E
from ..operators import long_parse as LP
from ..operators import parse as P
from ..operators import queries as Q
from ..operators import score as S
from ..session import balance, materialise, scratch_path, ship_package
from ..sources import literals as L
from ..sources import results_io as IO
from ..sources.tables import read_table
from . import corpora as CO
from . import pair_eval as PE
from .evaluate import DocumentEvaluation, GivenVectors, Options


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (Ty.DoubleType, Ty.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, Ty.DecimalType):
            c = c.cast("double")  # numbers of pairs, exact up to 2^53 here
        elif isinstance(f.dataType, (Ty.IntegerType, Ty.ShortType, Ty.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


_REGISTRY: dict = {}


def query(name: str):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return finalize(fn(spark, sf_dir))
        _REGISTRY[name] = run
        return run
    return deco


def registry() -> dict:
    return dict(_REGISTRY)


# ---------------------------------------------------------------------------
# sources and parsing (strict header rule, each documents row a document)

def _docs(spark, sf_dir):
    return balance(read_table(spark, sf_dir, "documents"))


@query("doc_scan")
def doc_scan(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", "source", "lang", F.length(T.normalize_newlines(F.col("text"))).alias("text_len"),
                    F.size(T.nonblank_lines(F.col("text"))).alias("n_lines"))


@query("doc_lines")
def doc_lines(spark, sf_dir):
    return P.document_lines(_docs(spark, sf_dir))


def _parsed(spark, sf_dir):
    return P.parse_structure(_docs(spark, sf_dir))


@query("sections")
def sections(spark, sf_dir):
    return P.sections(_parsed(spark, sf_dir)).drop("body")


@query("paragraphs")
def paragraphs(spark, sf_dir):
    return P.paragraphs(_parsed(spark, sf_dir))


@query("sentences")
def sentences(spark, sf_dir):
    return P.sentences(_parsed(spark, sf_dir))


@query("section_paragraphs")
def section_paragraphs(spark, sf_dir):
    return P.section_paragraphs(_parsed(spark, sf_dir))


@query("search_queries")
def search_queries(spark, sf_dir):
    q = Q.topic_queries(_parsed(spark, sf_dir))
    return q.select("doc", "query_idx", "query", F.array_join("keywords", "|").alias("keywords"))


@query("page_search_queries")
def page_search_queries(spark, sf_dir):
    q = Q.topic_queries(P.parse_structure(CO.page_documents(spark, sf_dir)))
    return q.select("doc", "query_idx", "query", F.array_join("keywords", "|").alias("keywords"))


@query("doc_stats")
def doc_stats(spark, sf_dir):
    """Sizes of row-local arrays: one projection, no join and no shuffle."""
    body = F.flatten(F.transform("sections", lambda s: s["body"]))
    pieces = F.flatten(F.transform(body, T.sentence_pieces))
    return _parsed(spark, sf_dir).select(
        "doc_id", F.size("sections").alias("n_sections"), F.size(body).alias("n_paragraphs"),
        F.size(F.filter(pieces, T.keep_sentence)).alias("n_sentences"), F.size(Q.chosen_queries()).alias("n_queries"))


# documents larger than a row: each source is one, its lines in many tasks

def _placed(spark, sf_dir):
    return LP.place_lines(CO.source_lines(spark, sf_dir))


@query("long_document_sections")
def long_document_sections(spark, sf_dir):
    return LP.sections(_placed(spark, sf_dir))


@query("long_document_paragraphs")
def long_document_paragraphs(spark, sf_dir):
    """All lines of a section, numbered in their document; long ones also among those and their sections."""
    return _placed(spark, sf_dir).where(F.col("para_idx").isNotNull()).select(
        "doc_id", "para_idx", "section_id", "section_idx", "pos", F.col("line").alias("text"))


@query("long_document_sentences")
def long_document_sentences(spark, sf_dir):
    return LP.sentences(_placed(spark, sf_dir))


@query("long_document_score")
def long_document_score(spark, sf_dir):
    r = DocumentEvaluation(CO.long_corpus(CO.source_lines(spark, sf_dir)), Options()).results()
    return r.select("model_name", "doc", "avg_coherence", "section_boundary_contrast",
                    "semantic_search_precision", "overall_score")


# ---------------------------------------------------------------------------
# embeddings (source corpus: documents grouped by source)

def _source_eval(spark, sf_dir, **kw) -> DocumentEvaluation:
    return DocumentEvaluation(CO.source_corpus(spark, sf_dir), Options(**kw))


@query("unit_embeddings")
def unit_embeddings(spark, sf_dir):
    v = _source_eval(spark, sf_dir).paragraph_vectors()
    return v.select("model_name", "doc", "major", "minor", "dim", "norm_sq",
                    F.size("nz").alias("nnz"))


@query("vector_preview")
def vector_preview(spark, sf_dir):
    v = _source_eval(spark, sf_dir).paragraph_vectors()
    return v.select("model_name", "doc", "major", "minor", F.size("vec").alias("dim"),
                    *[F.try_element_at("vec", F.lit(i + 1)).cast("double").alias(f"v{i}") for i in range(5)])


@query("cosine_scalar")
def cosine_scalar(spark, sf_dir):
    """Cosine of each given vector with the next one (equi-join on vec_id + 1),
    with the plain dense formula."""
    from ..functions import vectors as V
    emb = read_table(spark, sf_dir, "embeddings")
    a = emb.select("vec_id", F.col("embedding").alias("a"))
    b = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", V.cosine(F.col("a"), F.col("b")).alias("cosine"))


# ---------------------------------------------------------------------------
# coherence

@query("adjacent_similarity")
def adjacent_similarity(spark, sf_dir):
    return _source_eval(spark, sf_dir).adjacent()


@query("paragraph_coherence")
def paragraph_coherence(spark, sf_dir):
    return _source_eval(spark, sf_dir).coherence()


@query("paragraph_coherence_vectors")
def paragraph_coherence_vectors(spark, sf_dir):
    from ..operators import coherence as C
    return C.paragraph_coherence(C.adjacent_similarity(CO.vector_corpus(spark, sf_dir)))


@query("paragraph_coherence_chats")
def paragraph_coherence_chats(spark, sf_dir):
    return DocumentEvaluation(CO.chat_corpus(spark, sf_dir)).coherence()


@query("paragraph_coherence_strict")
def paragraph_coherence_strict(spark, sf_dir):
    corpus, _ = CO.strict_corpus(spark, sf_dir)
    return DocumentEvaluation(corpus).coherence()


# ---------------------------------------------------------------------------
# contrast

@query("section_contrast")
def section_contrast(spark, sf_dir):
    return _source_eval(spark, sf_dir).contrast()


@query("section_contrast_moments")
def section_contrast_moments(spark, sf_dir):
    # every group through the Gram-matrix path, several chunks per document
    return _source_eval(spark, sf_dir, small_max=0, rows_per_partial=100).contrast()


@query("section_contrast_vectors")
def section_contrast_vectors(spark, sf_dir):
    from ..operators import contrast as K
    return K.section_contrast(CO.vector_corpus(spark, sf_dir))


@query("section_contrast_chats")
def section_contrast_chats(spark, sf_dir):
    return DocumentEvaluation(CO.chat_corpus(spark, sf_dir)).contrast()


@query("paragraph_pairs")
def paragraph_pairs(spark, sf_dir):
    """Pair counts and mean similarity split by same / different section."""
    c = _source_eval(spark, sf_dir).contrast()
    same = c.select("model_name", "doc", F.lit(True).alias("same_section"),
                    F.col("n_within_pairs").alias("n_pairs"),
                    F.col("avg_within_section_similarity").alias("avg_similarity"))
    cross = c.select("model_name", "doc", F.lit(False).alias("same_section"),
                     F.col("n_cross_pairs").alias("n_pairs"),
                     F.col("avg_cross_section_similarity").alias("avg_similarity"))
    return same.unionByName(cross).filter(F.col("n_pairs") > 0)


# ---------------------------------------------------------------------------
# search (source corpus with the default query set)

@query("search_queries_default")
def search_queries_default(spark, sf_dir):
    """Every source document with the default query set (a row-local generator
    over the fixed literal; no join)."""
    from ..sources.literals import DEFAULT_QUERIES
    docs = _docs(spark, sf_dir).select(F.col("source").alias("doc")).distinct()
    qs = F.array(*[F.struct(F.lit(i).alias("query_idx"), F.lit(q).alias("query"),
                            F.lit("|".join(kw)).alias("keywords"))
                   for i, (q, kw) in enumerate(DEFAULT_QUERIES)])
    return docs.select("doc", F.inline(qs))


@query("query_sentence_similarity")
def query_sentence_similarity(spark, sf_dir):
    return _source_eval(spark, sf_dir).similarities().drop("text")


@query("search_top3")
def search_top3(spark, sf_dir):
    return _source_eval(spark, sf_dir).top3().drop("text")


@query("keyword_hits")
def keyword_hits(spark, sf_dir):
    h = _source_eval(spark, sf_dir).hits()
    return h.select("model_name", "doc", "query_idx", "rank", "major", "minor", "piece",
                    "similarity", "matched")


@query("query_precision")
def query_precision(spark, sf_dir):
    return _source_eval(spark, sf_dir).query_precision()


@query("search_precision")
def search_precision(spark, sf_dir):
    return _source_eval(spark, sf_dir).search()


@query("search_precision_topics")
def search_precision_topics(spark, sf_dir):
    corpus, _ = CO.strict_corpus(spark, sf_dir)
    return DocumentEvaluation(corpus).search()


@query("page_search_precision")
def page_search_precision(spark, sf_dir):
    return DocumentEvaluation(CO.page_corpus(spark, sf_dir)).search()


@query("conversation_query_sets")
def conversation_query_sets(spark, sf_dir):
    """Query sets paired by position: of each conversation's turns the texts, and for all but
    the last turn a keyword list; what has no partner is left out."""
    turns = read_table(spark, sf_dir, "conversations")
    return Q.queries_from_turns(turns, "conv_id", "turn").select("conv_id", "query_idx", "query",
                                                                 F.array_join("keywords", "|").alias("keywords"))


@query("search_precision_custom")
def search_precision_custom(spark, sf_dir):
    corpus = CO.source_corpus(spark, sf_dir)
    corpus.queries = Q.passage_queries(read_table(spark, sf_dir, "benchmark"))
    corpus.literal_queries = False
    return DocumentEvaluation(corpus).search()


@query("conversation_set_precision")
def conversation_set_precision(spark, sf_dir):
    """Each conversation scored with the query set of its own turns."""
    return DocumentEvaluation(CO.chat_corpus_with_own_queries(spark, sf_dir)).search()


# ---------------------------------------------------------------------------
# the user's own models

def _python_models(*names):
    return [E.PandasModel(m.name, m.model_id, E.python_hashing_factory) for m in E.NATIVE_MODELS if m.name in names]


def _broken_factory(model_id):
    raise RuntimeError(f"no such model: {model_id}")


@query("user_model_score")
def user_model_score(spark, sf_dir):
    """The whole evaluation with user models, which embed as the native ones do."""
    r = _source_eval(spark, sf_dir, models=_python_models("hash-64", "hash-256")).results()
    return r.select("model_name", "doc", "avg_coherence", "section_boundary_contrast",
                    "semantic_search_precision", "overall_score")


@query("user_model_pairs")
def user_model_pairs(spark, sf_dir):
    """Pair evaluation with a user model beside a native one."""
    conv = balance(read_table(spark, sf_dir, "conversations"))
    vecs = PE.turn_vectors(conv, [E.HASH_64, *_python_models("hash-256")])
    return PE.pair_similarity(PE.conversation_pairs(conv), materialise(vecs, "turn-vectors")).select(
        "model_name", "conv_id", "turn", "similarity")


@query("failed_units")
def failed_units(spark, sf_dir):
    """A model that can't be loaded: an error row for each document; the other model's results are there."""
    ev = _source_eval(spark, sf_dir, models=[E.HASH_64, E.PandasModel("broken", "none", _broken_factory)])
    failed = ev.failed_units().select("model_name", "doc", "n_failed", F.lit(False).alias("evaluated"), "error")
    done = ev.coherence().select("model_name", "doc", F.lit(0).cast("long").alias("n_failed"),
                                 F.lit(True).alias("evaluated"), F.lit(None).cast("string").alias("error"))
    return failed.unionByName(done)


def _picky_factory(model_id):
    """Hashing vectors; ``digits`` fails on a text with a digit, ``questions`` on one that ends in a question mark."""
    embed = E.python_hashing_factory("hashing/md5-64")
    fails_on = re.compile("[0-9]" if model_id == "digits" else r"\?\Z").search

    def picky(texts):
        if any(map(fails_on, texts)):
            raise ValueError(f"fails on {model_id}")
        return embed(texts)
    return picky


@query("failure_ledger")
def failure_ledger(spark, sf_dir):
    """Models that fail on some units: what they failed on by kind, and the results that are left.  A query of the
    set that all documents share fails its model everywhere."""
    models = [E.HASH_64, *(E.PandasModel(f"no-{k}", k, _picky_factory) for k in ("digits", "questions"))]
    ev = DocumentEvaluation(CO.chat_corpus(spark, sf_dir), Options(models=models))
    ledger = ev.failure_ledger().select("model_name", "every_doc", "doc", "unit_kind", "n_failed", "error",
                                        F.lit(None).cast("double").alias("overall_score"))
    none = F.lit(None).cast("string")
    done = ev.results().select("model_name", F.lit(False).alias("every_doc"), "doc", none.alias("unit_kind"),
                               F.lit(0).cast("long").alias("n_failed"), none.alias("error"), "overall_score")
    return ledger.unionByName(done)


@query("given_vectors_score")
def given_vectors_score(spark, sf_dir):
    """The whole evaluation of given vectors, with those of sentences and queries and without: then no search."""
    corpus, tables = CO.given_corpus(spark, sf_dir)
    given = [("given", GivenVectors(**tables)), ("given-bare", GivenVectors(tables["paragraphs"]))]
    r = DocumentEvaluation(corpus, Options(models=[], given=given)).results()
    return r.select("model_name", "doc", "n_adjacent_pairs", "avg_coherence", "section_boundary_contrast", "n_queries",
                    "semantic_search_precision", "min_precision", "max_precision", "overall_score")


@query("embedded_texts")
def embedded_texts(spark, sf_dir):
    """Distinct texts that the user-model job embeds, by model."""
    t = E.embedding_timing(_embedded(spark, sf_dir))
    return t.select("model_name", "n_texts", "n_failed")


# ---------------------------------------------------------------------------
# blend, ranking, result files

def _results(spark, sf_dir):
    return _source_eval(spark, sf_dir).results()


@query("overall_score")
def overall_score(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("model_name", "doc", "avg_coherence", "section_boundary_contrast",
                    "semantic_search_precision", "overall_score")


@query("leaderboard")
def leaderboard(spark, sf_dir):
    lb = S.leaderboard(_results(spark, sf_dir))
    return lb.select("doc", "position", "model_name", F.round("overall_score", 4).alias("overall_score"),
                     "is_best")


@query("best_per_metric")
def best_per_metric(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("overall_score", F.round("overall_score", 6)) \
        .withColumn("avg_coherence", F.round("avg_coherence", 6)) \
        .withColumn("section_boundary_contrast", F.round("section_boundary_contrast", 6)) \
        .withColumn("semantic_search_precision", F.round("semantic_search_precision", 6))
    return S.best_per_metric(r)


@query("model_count")
def model_count(spark, sf_dir):
    return S.model_count(_results(spark, sf_dir))


@query("results_merge")
def results_merge(spark, sf_dir):
    """Two runs over the same documents (all models, then the 256-d model
    again); per (model, doc) the later run wins."""
    first = _source_eval(spark, sf_dir).coherence().withColumn("run_order", F.lit(1))
    second = _source_eval(spark, sf_dir, models=[E.HASH_256]).coherence().withColumn("run_order", F.lit(2))
    m = S.merge_latest(first.unionByName(second), ["model_name", "doc"])
    return m.select("model_name", "doc", "run_order", "avg_coherence")


def _nested(spark, sf_dir):
    return IO.nest(_results(spark, sf_dir))


@query("results_export")
def results_export(spark, sf_dir):
    return IO.canonical_export(IO.to_json_documents(_nested(spark, sf_dir)))


@query("results_json_rows")
def results_json_rows(spark, sf_dir):
    rows = IO.from_json_documents(IO.to_json_documents(_nested(spark, sf_dir)))
    return rows.select("doc", "model_name", "model_id", "avg_coherence", "section_boundary_contrast",
                       "semantic_search_precision", "overall_score")


@query("result_files")
def result_files(spark, sf_dir):
    """The results, written as result files in the place of earlier ones, and read again."""
    from ..sources import result_files as RF
    path = scratch_path(spark, "result-files")
    nested = materialise(_nested(spark, sf_dir), "nested-results")
    RF.write_result_files(nested.where("model_name = 'hash-64'"), path)
    RF.write_result_files(nested, path)
    return RF.read_result_files(spark, path).select(
        "doc", "model_name", "model_id", "avg_coherence", "section_boundary_contrast", "semantic_search_precision",
        "overall_score")


@query("dashboard_table")
def dashboard_table(spark, sf_dir):
    """The rows of the dashboard by score, each number as text with its fixed digits."""
    lb = S.leaderboard(_results(spark, sf_dir))
    numbers = ["overall_score", "avg_coherence", "section_boundary_contrast", "semantic_search_precision"]
    return lb.select("doc", "position", "model_name", *[D.to_fixed(F.col(c), L.SCORE_DIGITS).alias(c) for c in numbers],
                     D.to_fixed(D.shown_contrast(F.col("section_boundary_contrast")), L.SCORE_DIGITS).alias("shown_contrast"))


@query("evaluation_timing")
def evaluation_timing(spark, sf_dir):
    """A timed evaluation: what was embedded of each document, and whether its time was measured (it is not the same twice)."""
    r = _source_eval(spark, sf_dir, timed=True).results()
    seconds = F.col("evaluation_time_seconds")
    return r.select("model_name", "doc", "n_embedded", (seconds > 0).alias("measured"), "overall_score")


@query("results_or_placeholder")
def results_or_placeholder(spark, sf_dir):
    """Strict-parse documents: most have no result and get the placeholder."""
    corpus, _ = CO.strict_corpus(spark, sf_dir)
    ev = DocumentEvaluation(corpus)
    flat = IO.from_json_documents(IO.to_json_documents(IO.nest(ev.results())))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"))
    out = IO.with_placeholder(flat, docs)
    return out.select("doc", "model_name", "model_id", "avg_coherence", "overall_score")


@query("results_clean")
def results_clean(spark, sf_dir):
    """Pages, of which all have a placeholder and many a real result too: the placeholder stays where it is alone."""
    real = DocumentEvaluation(CO.page_corpus(spark, sf_dir)).results()
    flat = IO.from_json_documents(IO.to_json_documents(IO.nest(real)))
    docs = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc"))
    both = IO.with_placeholder(flat.where(F.lit(False)), docs).unionByName(IO.with_placeholder(flat, flat.select("doc")))
    return IO.clean_placeholder(both).select("doc", "model_name", "overall_score")


@query("run_status")
def run_status(spark, sf_dir):
    corpus, _ = CO.strict_corpus(spark, sf_dir)
    ev = DocumentEvaluation(corpus)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"))
    return IO.run_status(ev.results(), docs)


# ---------------------------------------------------------------------------
# pair evaluation (conversation turn pairs)

def _pair_sims(spark, sf_dir):
    """Each turn is embedded once; both sides of the pairs read the written vectors."""
    conv = balance(read_table(spark, sf_dir, "conversations"))
    return PE.pair_similarity(PE.conversation_pairs(conv), materialise(PE.turn_vectors(conv), "turn-vectors"))


@query("pairs_scan")
def pairs_scan(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return PE.conversation_pairs(conv).select("conv_id", "turn", "human_score",
                                              F.length("text1").alias("len1"), F.length("text2").alias("len2"))


@query("pair_similarity")
def pair_similarity(spark, sf_dir):
    return _pair_sims(spark, sf_dir)


@query("pearson_by_model")
def pearson_by_model(spark, sf_dir):
    from ..operators import correlate as X
    d = _pair_sims(spark, sf_dir).filter("similarity is not null and human_score is not null")
    return X.pearson(d, ["model_name"], "human_score", "similarity")


@query("spearman_by_model")
def spearman_by_model(spark, sf_dir):
    from ..operators import correlate as X
    d = _pair_sims(spark, sf_dir).filter("similarity is not null and human_score is not null")
    return X.spearman(d, ["model_name"], "human_score", "similarity")


def _comparison(spark, sf_dir):
    sims = materialise(_pair_sims(spark, sf_dir).select(
        "model_name", "human_score", "similarity", "embedding_dimension"), "pair-similarity")
    corr = PE.correlations(sims)
    dims = sims.groupBy("model_name").agg(F.max("embedding_dimension").alias("embedding_dimension"))
    from .evaluate import model_table
    models = model_table(spark, E.NATIVE_MODELS).select("model_name", "model_order", "model_id")
    return (corr.join(dims, "model_name").join(F.broadcast(models), "model_name")
                .select("model_order", "model_name", "model_id", "pearson_correlation",
                        "spearman_correlation", "embedding_dimension", F.col("n").alias("n_pairs")))


@query("comparison_table")
def comparison_table(spark, sf_dir):
    return _comparison(spark, sf_dir)


@query("comparison_display")
def comparison_display(spark, sf_dir):
    """The comparison's six columns as text with their digits; native models load nothing and have no times."""
    return PE.comparison_display(_comparison(spark, sf_dir))


# ---------------------------------------------------------------------------
# streaming ingest: the documents table read as a stream, evaluated per batch

_INGESTED: dict[tuple[str, str], str] = {}


def _stream_documents(spark, sf_dir) -> str:
    """The output folder of the ingest over the documents table as a stream, which runs once for a session and table."""
    from ..session import scratch_path
    from ..streaming import ingest as ST
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INGESTED:
        schema = read_table(spark, sf_dir, "documents").select("doc_id", "text").schema
        out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
        table = f"{sf_dir}/documents.[p]arquet"  # a pattern: a stream takes the file as well as a folder of files by it
        ST.start(ST.table_stream(spark, table, schema, "*"), out, ckpt).awaitTermination()
        _INGESTED[key] = out
    return _INGESTED[key]


@query("stream_reingest")
def stream_reingest(spark, sf_dir):
    """All documents, then the German ones again with a line more: one result for each document and model, the last."""
    from ..session import scratch_path
    from ..streaming import ingest as ST
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    folder, out, ckpt = (scratch_path(spark, f"reingest-{k}") for k in ("in", "out", "ckpt"))
    again = docs.where("lang = 'de'").withColumn("text", F.concat("text", F.lit("\n" + L.LATER_LINE)))
    for rows in (docs, again):
        rows.select("doc_id", "text").write.mode("append").parquet(folder)
        stream = ST.table_stream(spark, folder, docs.select("doc_id", "text").schema, "*.parquet")
        ST.start(stream, out, ckpt).awaitTermination()
        ST.compact(spark, out)
    return ST.latest_results(spark, out).select("doc", "model_name", "avg_coherence", "overall_score")


@query("stream_ingest")
def stream_ingest(spark, sf_dir):
    from ..streaming import ingest as ST
    out = _stream_documents(spark, sf_dir)
    return ST.read_results(spark, out).select("doc", "model_name", "avg_coherence", "overall_score")


@query("latest_run")
def latest_run(spark, sf_dir):
    """Last evaluated document of the run history that the ingest writes; of one epoch, the greatest name."""
    from ..streaming import ingest as ST
    out = _stream_documents(spark, sf_dir)
    return ST.last_run(spark, out).select("last_document")


@query("status_history")
def status_history(spark, sf_dir):
    """Status rows of the ingest in their order: processing, then completed or error."""
    from ..streaming import ingest as ST
    return ST.read_history(spark, _stream_documents(spark, sf_dir)).select(
        "document_name", "phase", "status", "progress", "n_models")


# ---------------------------------------------------------------------------
# user-model embedding job (mapInArrow): timing per model, rows-only check

def _embedded(spark, sf_dir):
    conv = balance(read_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")
    outs = [E.embed_texts(conv, m) for m in _python_models("hash-64", "hash-256")]
    return materialise(outs[0].unionByName(outs[1]), "embedded-texts")


@query("embedding_timing")
def embedding_timing(spark, sf_dir):
    """Seconds are those of a per-word Python loop that stands in for a model: they measure the job, no model."""
    return E.embedding_timing(_embedded(spark, sf_dir))
