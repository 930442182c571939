"""Documents larger than a row: the header rule over lines that many tasks hold.

A document comes as rows ``doc_id, major, minor, line``; ``(major, minor)`` is
the order of its lines.  The lines are dealt out by ranges of that order, which
Spark's sampling balances, so one document may fill many tasks.  Each range is
numbered by itself (windows inside the range), one row a document and range has
its totals, and what earlier ranges hand on -- the open section, numbers of
lines, paragraphs, sentences and long sections -- is a window over those rows.
Joined back, it places every line; results equal ``parse.py`` on the whole text.

A line is bounded by its row.  Blank and null lines count for nothing, a null
``doc_id`` is a document of its own, lines that agree in their position are
ordered by their text, and other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise
from ..sources import literals as L
from . import queries as Q

ORDER = ["major", "minor", "line"]
COUNTED = ["body", "sents", "longs"]


def _flagged(lines: DataFrame) -> DataFrame:
    """Non-blank lines with what each counts for: a header, a paragraph, its sentences, a long paragraph."""
    body = ~F.col("is_header")
    pieces = F.filter(T.sentence_pieces(F.col("line")), T.keep_sentence)
    return (lines.select("doc_id", "major", "minor", T.strip(F.coalesce("line", F.lit(""))).alias("line"))
            .where(F.length("line") > 0)
            .withColumn("is_header", T.is_header(F.col("line")))
            .select("doc_id", *ORDER, "is_header", body.cast("long").alias("body"),
                    F.when(body, F.size(pieces)).otherwise(0).cast("long").alias("sents"),
                    (body & (F.length("line") > L.SECTION_PARAGRAPH_MIN_CHARS)).cast("long").alias("longs")))


def _numbered_in_range(ranges: DataFrame) -> DataFrame:
    """Running numbers inside a document's part of a range; ``head`` 0 is the part before its first header."""
    part = Window.partitionBy("doc_id", "range")
    so_far = part.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = ranges.withColumn("head", F.sum(F.col("is_header").cast("long")).over(so_far))
    in_section = Window.partitionBy("doc_id", "range", "head").orderBy(*ORDER).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    opened = headed.withColumn("opens", ((F.col("longs") == 1) & (F.sum("longs").over(in_section) == 1)).cast("long"))
    return opened.select("*", F.row_number().over(part.orderBy(*ORDER)).alias("nth"),
                         *[F.sum(c).over(so_far).alias(f"run_{c}") for c in [*COUNTED, "opens"]])


def _carried(numbered: DataFrame) -> DataFrame:
    """A row for each document and range: what the ranges before it hand on.

    Lines ahead of the range's first header (``lead_``) belong to the section that is open there, if any is.
    """
    lead = F.col("head") == 0
    totals = numbered.groupBy("doc_id", "range").agg(
        F.count(F.lit(1)).alias("lines"), F.max("head").alias("heads"),
        *[F.sum(F.when(lead, F.col(c)).otherwise(0)).alias(f"lead_{c}") for c in [*COUNTED, "opens"]],
        *[F.sum(F.when(lead, 0).otherwise(F.col(c))).alias(f"own_{c}") for c in [*COUNTED, "opens"]],
        F.max(F.when(~lead & (F.col("longs") == 1), F.col("head"))).alias("last_long"))
    earlier = Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    def before(number: Column) -> Column:
        return F.coalesce(F.sum(number).over(earlier), F.lit(0))

    opened = totals.withColumn("heads_before", before(F.col("heads"))).withColumn("in_open", F.col("heads_before") > 0)
    for c in [*COUNTED, "opens"]:
        opened = opened.withColumn(f"all_{c}", F.col(f"own_{c}") + F.when(F.col("in_open"), F.col(f"lead_{c}")).otherwise(0))
    # a section with long paragraphs on both sides of a border counts once
    goes_on = F.col("in_open") & (F.col("lead_opens") > 0)
    last = F.when(F.col("own_opens") > 0, F.col("heads_before") + F.col("last_long")).when(goes_on, F.col("heads_before"))
    shared = opened.withColumn("goes_on", goes_on).withColumn("last_section", last).withColumn(
        "shared", F.coalesce(F.col("goes_on") & (F.last("last_section", ignorenulls=True).over(earlier)
                                                == F.col("heads_before")), F.lit(False)).cast("long"))
    return shared.select(
        F.col("doc_id").alias("of_doc"), F.col("range").alias("of_range"), "heads_before", "shared",
        before(F.col("lines")).alias("lines_before"),
        before(F.col("all_opens") - F.col("shared")).alias("opens_before"),
        *[before(F.col(f"all_{c}")).alias(f"{c}_before") for c in COUNTED],
        *[F.when(F.col("in_open"), 0).otherwise(F.col(f"lead_{c}")).alias(f"skip_{c}") for c in [*COUNTED, "opens"]])


def place_lines(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id, line_no, line, is_header, section_id, para_idx, first_sent, section_idx, pos`` of all non-blank lines.

    ``section_id`` is 0 ahead of the first header.  ``para_idx`` and
    ``first_sent`` (number of the paragraph's first sentence) are set for body
    lines of a section, ``section_idx`` and ``pos`` for those of more than 50
    characters.  ``ranges`` defaults to ``spark.sql.shuffle.partitions``; the
    lines as numbered in their ranges and the result are written and read back.
    """
    n = ranges or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _flagged(lines).repartitionByRange(n, "doc_id", "major", "minor").withColumn("range", F.spark_partition_id())
    numbered = materialise(_numbered_in_range(dealt), "line-ranges")
    carried = materialise(_carried(numbered), "line-totals")  # few rows: joined without dealing out the lines again
    joined = numbered.join(carried, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("range") == F.col("of_range")))

    def number(c: str) -> Column:
        return F.col(f"{c}_before") + F.col(f"run_{c}") - F.col(f"skip_{c}")

    section = F.col("heads_before") + F.col("head")
    para = (section > 0) & (F.col("body") == 1)
    long_ = para & (F.col("longs") == 1)
    return materialise(joined.select(
        "doc_id", (F.col("lines_before") + F.col("nth") - 1).alias("line_no"), "line", "is_header",
        section.alias("section_id"), F.when(para, number("body") - 1).alias("para_idx"),
        F.when(para, number("sents") - F.col("sents")).alias("first_sent"),
        F.when(long_, number("opens") - F.col("shared") - 1).alias("section_idx"),
        F.when(long_, number("longs") - 1).alias("pos")), "placed-lines")


def sections(placed: DataFrame) -> DataFrame:
    """``doc_id, section_id, header, n_body_lines``; a section of any size adds up before it is shuffled."""
    return (placed.where(F.col("section_id") > 0).groupBy("doc_id", "section_id")
            .agg(F.max(F.when(F.col("is_header"), F.col("line"))).alias("header"),
                 F.count_if(~F.col("is_header")).alias("n_body_lines")))


def paragraphs(placed: DataFrame) -> DataFrame:
    return placed.where(F.col("para_idx").isNotNull()).select(
        "doc_id", "para_idx", "section_id", F.col("line").alias("text"))


def sentences(placed: DataFrame) -> DataFrame:
    kept = F.filter(T.sentence_pieces(F.col("line")), T.keep_sentence)
    return (placed.where(F.col("para_idx").isNotNull())
            .select("doc_id", "para_idx", "first_sent", F.posexplode(kept).alias("k", "s"))
            .select("doc_id", (F.col("first_sent") + F.col("k")).alias("sent_idx"), "para_idx",
                    T.as_sentence(F.col("s")).alias("text")))


def section_paragraphs(placed: DataFrame) -> DataFrame:
    return placed.where(F.col("pos").isNotNull()).select(
        "doc_id", "section_idx", "section_id", "pos", F.col("line").alias("text"))


def topic_queries(placed: DataFrame) -> DataFrame:
    """The queries of each document: only its first headers are gathered."""
    first = F.when(F.col("is_header") & (F.col("section_id") <= L.MAX_TOPICS),
                   F.struct("section_id", F.col("line").alias("header")))
    return Q.topic_queries(placed.groupBy("doc_id").agg(F.sort_array(F.collect_list(first)).alias("sections")))


def units(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraph and sentence units in the schema that ``parse.strict_units`` gives."""
    doc = F.col("doc_id").cast("string").alias("doc")
    place = [F.col("para_idx").alias("major"), F.lit(0).cast("long").alias("minor")]
    return (paragraphs(placed).select(doc, F.col("section_id").cast("string").alias("section"), *place, "text"),
            sentences(placed).select(doc, *place, F.col("sent_idx").cast("int").alias("piece"), "text"))
