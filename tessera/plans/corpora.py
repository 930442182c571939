"""Corpus bindings: the driver's tables as paragraph / sentence / query units.

* ``source_corpus``   (C1) ``documents``: a ``source`` is a document, each
  ``doc_id`` row a section, each non-blank line a paragraph; default queries.
* ``strict_corpus``   (C2) ``documents``: each row is a document parsed with
  the header rule; topic queries with the generic fallback.
* ``long_corpus``     (C7) ``documents``: a ``source`` is one document, however
  large, whose text is that of its rows by ``doc_id``; parsed with the header
  rule from rows of lines, topic queries.
* ``page_corpus``    (C5) ``pages``: the lines of a web page's text, parsed
  with the header rule; topic queries, also the generic fallback.
* ``vector_corpus``   (C3) ``embeddings``: one document of given vectors,
  ``label`` as section, ``vec_id`` as order.
* ``given_corpus``    (C6) ``documents`` whose ``doc_id`` is a ``vec_id`` of ``embeddings``:
  a ``source`` is a document, each row a paragraph and a sentence with that
  given vector, ``label`` its section; the passages of ``benchmark`` whose
  ``item_id`` is a ``vec_id`` are the queries, with that vector.
* ``chat_corpus``     (C4) ``conversations``: a conversation is a document,
  each turn a paragraph, the role its section; default queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import long_parse as LP
from ..operators import parse as P
from ..operators import queries as Q
from ..session import balance, materialise
from ..sources.tables import read_table


@dataclass
class Corpus:
    name: str
    paragraphs: DataFrame            # doc, section, major, minor, text
    sentences: DataFrame | None      # doc, major, minor, piece, text
    queries: DataFrame | None        # [doc,] query_idx, query, keywords
    per_document_queries: bool = False
    literal_queries: bool = True     # a fixed literal set: proven size, may broadcast
    bounded_sets: bool = True        # per-document sets of a few queries; else of any size


def source_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    docs = balance(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    paras = P.line_units(docs, F.col("source"), F.col("doc_id"), F.col("doc_id"))
    return Corpus("source", paras, P.sentence_units(paras), Q.default_queries(spark))


def strict_corpus(spark: SparkSession, sf_dir: str) -> tuple[Corpus, DataFrame]:
    docs = balance(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return strict_corpus_of(docs)


def strict_corpus_of(docs: DataFrame) -> tuple[Corpus, DataFrame]:
    """Strict-parse corpus of any ``doc_id, text`` DataFrame (e.g. a micro-batch)."""
    parsed = P.parse_structure(docs)
    paras, sents = P.strict_units(parsed)
    return (Corpus("strict", paras, sents, Q.topic_queries(parsed), per_document_queries=True,
                   literal_queries=False), parsed)


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of ``pages`` as ``doc_id, text``: scripts and styles go, every tag ends a line."""
    html = F.coalesce("html", F.lit(""))
    for element in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{element}\b.*?</{element}\s*>", "\n")
    return balance(read_table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.col("page_id").alias("doc_id"), F.regexp_replace(html, "<[^>]*>", "\n").alias("text"))


def page_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Each web page a document parsed with the header rule: many have topic queries of their own."""
    return strict_corpus_of(page_documents(spark, sf_dir))[0]


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, major, minor, line``: each ``source`` a document, its lines by row and place in the row."""
    docs = balance(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("long").alias("major"),
                       F.posexplode(T.nonblank_lines(F.col("text"))).alias("minor", "line"))


def long_corpus(lines: DataFrame, ranges: int | None = None) -> Corpus:
    """Documents larger than a row, given by their lines (also ``sources.tables.read_text_lines``)."""
    placed = LP.place_lines(lines, ranges)
    paras, sents = LP.units(placed)
    return Corpus("long", paras, sents, LP.topic_queries(placed), per_document_queries=True, literal_queries=False,
                  bounded_sets=False)


def chat_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    conv = balance(read_table(spark, sf_dir, "conversations"))
    paras = P.whole_text_units(conv, F.col("conv_id"), F.col("role"), F.col("turn"))
    return Corpus("chat", paras, P.sentence_units(paras), Q.default_queries(spark))


def chat_corpus_with_own_queries(spark: SparkSession, sf_dir: str) -> Corpus:
    """Conversations with a caller's query set each, of any size: their own turns and the keywords of them."""
    corpus = chat_corpus(spark, sf_dir)
    turns = read_table(spark, sf_dir, "conversations")
    corpus.queries = Q.queries_from_turns(turns, "conv_id", "turn").withColumnRenamed("conv_id", "doc").withColumn(
        "doc", F.col("doc").cast("string"))
    corpus.per_document_queries, corpus.literal_queries, corpus.bounded_sets = True, False, False
    return corpus


def vector_corpus(spark: SparkSession, sf_dir: str, model_name: str = "given-vectors") -> DataFrame:
    """Vector table of the ``embeddings`` table (no text, so no search)."""
    from ..operators.embed import vectors_from_array
    emb = read_table(spark, sf_dir, "embeddings")
    units = emb.select(F.lit("embeddings").alias("doc"), F.col("label").cast("string").alias("section"),
                       F.col("vec_id").cast("long").alias("major"), F.lit(0).cast("long").alias("minor"),
                       "embedding")
    return vectors_from_array(units, model_name)


def given_corpus(spark: SparkSession, sf_dir: str) -> tuple[Corpus, dict[str, DataFrame]]:
    """The corpus without texts to embed, and its given vector tables: paragraphs, sentences and queries."""
    from ..operators.embed import vectors_from_array
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("section"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc"), "text")
    zero = F.lit(0).cast("long")
    rows = (docs.join(emb, F.col("doc_id") == F.col("vec_id"))
            .select("doc", "section", F.col("doc_id").cast("long").alias("major"), zero.alias("minor"),
                    zero.alias("piece"), "text", "embedding"))
    vectors = materialise(vectors_from_array(rows, "given").drop("model_name"), "given-vectors")
    queries = Q.passage_queries(read_table(spark, sf_dir, "benchmark"))
    keyed = vectors_from_array(queries.select("query_idx").join(emb, F.col("query_idx") == F.col("vec_id")), "given")
    own = vectors.select("doc", "section", "major", "minor", "text").where(F.lit(False))
    corpus = Corpus("given", own, None, queries, literal_queries=False)
    return corpus, {"paragraphs": vectors.drop("piece", "text"), "sentences": vectors.drop("section"),
                    "queries": keyed.select("query_idx", "dim", "vec", "nz", "norm_sq")}
