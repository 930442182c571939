"""Document parsing: lines, sections, paragraphs, sentences.

A document is one row, so the whole header state machine runs row-locally
with array functions: no shuffle, no window, no Python.  Sections come from
the positions of header lines; a section spans from its header to the line
before the next header.  Body lines before the first header belong to no
section and are dropped, as in the evaluated toolkit.

Unit tables share one schema so every metric runs on any corpus binding:

* paragraphs: ``doc, section, major, minor, text`` -- ``(major, minor)`` is the
  document order, ``section`` the grouping for contrast.
* sentences:  ``doc, major, minor, piece, text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import literals as L

_SECTION = "struct<section_id:int,header:string,body:array<string>>"


def _sections_expr(lines: Column) -> Column:
    """``array<struct<section_id, header, body>>`` from non-blank lines."""
    n = F.size(lines)
    positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(positions, lambda i: T.is_header(F.element_at(lines, i)))

    def one(h, k):
        nxt = F.coalesce(F.try_element_at(heads, k + 2), n + 1)
        return F.struct(
            (k + 1).cast("int").alias("section_id"),
            F.element_at(lines, h).alias("header"),
            F.slice(lines, h + 1, nxt - h - 1).alias("body"),
        )

    return F.transform(heads, one)


def parse_structure(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with ``lines`` and ``sections`` arrays."""
    lines = T.nonblank_lines(F.col(text_col))
    return (docs.select(F.col(doc_col).alias("doc_id"), lines.alias("lines"))
                .withColumn("sections", _sections_expr(F.col("lines"))))


def document_lines(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-blank stripped lines with their position and header flag."""
    return (docs.select(F.col(doc_col).alias("doc_id"),
                        F.posexplode(T.nonblank_lines(F.col(text_col))).alias("line_no", "line"))
                .withColumn("is_header", T.is_header(F.col("line"))))


def sections(parsed: DataFrame) -> DataFrame:
    """Sections: header, body lines and the section text ``header\\nbody...``."""
    s = parsed.select("doc_id", F.inline("sections"))
    return s.select(
        "doc_id", "section_id", "header", "body",
        F.size("body").alias("n_body_lines"),
        F.array_join(F.concat(F.array("header"), F.col("body")), "\n").alias("section_text"))


def _paragraph_array(sections_col: Column) -> Column:
    return F.flatten(F.transform(
        sections_col,
        lambda s: F.transform(s["body"], lambda b: F.struct(s["section_id"].alias("section_id"),
                                                             b.alias("text")))))


def paragraphs(parsed: DataFrame) -> DataFrame:
    """Body lines under a header, numbered in document order (``para_idx``)."""
    return (parsed.select("doc_id", F.posexplode(_paragraph_array(F.col("sections")))
                          .alias("para_idx", "p"))
                  .select("doc_id", "para_idx", F.col("p.section_id").alias("section_id"),
                          F.col("p.text").alias("text")))


def sentences(parsed: DataFrame) -> DataFrame:
    """Sentences of all paragraphs, numbered in document order (``sent_idx``)."""
    paras = _paragraph_array(F.col("sections"))

    def per_para(p, i):
        kept = F.filter(T.sentence_pieces(p["text"]), T.keep_sentence)
        return F.transform(kept, lambda s: F.struct(i.alias("para_idx"), T.as_sentence(s).alias("text")))

    return (parsed.select("doc_id", F.posexplode(F.flatten(F.transform(paras, per_para)))
                          .alias("sent_idx", "s"))
                  .select("doc_id", "sent_idx", F.col("s.para_idx").alias("para_idx"),
                          F.col("s.text").alias("text")))


def section_paragraphs(parsed: DataFrame) -> DataFrame:
    """Body lines longer than 50 chars; sections without one vanish and the
    remaining sections get a dense index ``section_idx`` (0-based)."""
    def long_lines(s):
        return F.filter(s["body"], lambda b: F.length(b) > L.SECTION_PARAGRAPH_MIN_CHARS)

    kept = F.filter(F.transform(F.col("sections"),
                                lambda s: F.struct(s["section_id"].alias("section_id"),
                                                   long_lines(s).alias("paras"))),
                    lambda s: F.size(s["paras"]) > 0)
    flat = F.flatten(F.transform(kept, lambda s, i: F.transform(
        s["paras"], lambda p: F.struct(i.alias("section_idx"), s["section_id"].alias("section_id"),
                                       p.alias("text")))))
    return (parsed.select("doc_id", F.posexplode(flat).alias("pos", "p"))
                  .select("doc_id", F.col("p.section_idx").alias("section_idx"),
                          F.col("p.section_id").alias("section_id"), "pos",
                          F.col("p.text").alias("text")))


# ---------------------------------------------------------------------------
# unit tables in the shared schema


def strict_units(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraph and sentence units of documents parsed with the header rule."""
    paras = paragraphs(parsed).select(
        F.col("doc_id").cast("string").alias("doc"),
        F.col("section_id").cast("string").alias("section"),
        F.col("para_idx").cast("long").alias("major"),
        F.lit(0).cast("long").alias("minor"), "text")
    sents = sentences(parsed).select(
        F.col("doc_id").cast("string").alias("doc"),
        F.col("para_idx").cast("long").alias("major"),
        F.lit(0).cast("long").alias("minor"),
        F.col("sent_idx").cast("int").alias("piece"), "text")
    return paras, sents


def line_units(rows: DataFrame, doc: Column, section: Column, major: Column,
               text_col: str = "text") -> DataFrame:
    """Each non-blank line of each row is a paragraph.  ``major`` orders rows
    inside a document, the line position orders lines inside a row."""
    return (rows.select(doc.cast("string").alias("doc"), section.cast("string").alias("section"),
                        major.cast("long").alias("major"),
                        F.posexplode(T.nonblank_lines(F.col(text_col))).alias("minor", "text"))
                .withColumn("minor", F.col("minor").cast("long")))


def whole_text_units(rows: DataFrame, doc: Column, section: Column, major: Column,
                     text_col: str = "text") -> DataFrame:
    """Each row's stripped text is one paragraph (blank rows dropped)."""
    txt = T.strip(T.normalize_newlines(F.coalesce(F.col(text_col), F.lit(""))))
    return (rows.select(doc.cast("string").alias("doc"), section.cast("string").alias("section"),
                        major.cast("long").alias("major"), F.lit(0).cast("long").alias("minor"),
                        txt.alias("text"))
                .filter(F.length("text") > 0))


def sentence_units(paragraph_units: DataFrame) -> DataFrame:
    """Sentences of paragraph units; ``piece`` is the position in the split."""
    return (paragraph_units
            .select("doc", "major", "minor",
                    F.posexplode(T.sentence_pieces(F.col("text"))).alias("piece", "s"))
            .filter(T.keep_sentence(F.col("s")))
            .select("doc", "major", "minor", F.col("piece").cast("int").alias("piece"),
                    T.as_sentence(F.col("s")).alias("text")))
