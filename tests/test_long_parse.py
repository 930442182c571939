"""Documents larger than a row: the parse over ranges of lines equals the row-local one."""

import random

import pytest
from conftest import SAMPLE_DOC

from tessera.operators import long_parse as LP
from tessera.operators import parse as P
from tessera.operators import queries as Q
from tessera.sources.tables import read_text_lines


def _lines(spark, texts):
    rows = [(d, 0, i, line) for d, text in texts for i, line in enumerate(text.split("\n"))]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id string, major long, minor long, line string").repartition(5)


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def _same(spark, texts, placed):
    parsed = P.parse_structure(spark.createDataFrame(texts, "doc_id string, text string"))
    lines = P.document_lines(spark.createDataFrame(texts, "doc_id string, text string"))
    for got, want, columns in [
            (placed, lines, ["doc_id", "line_no", "line", "is_header"]),
            (LP.paragraphs(placed), P.paragraphs(parsed), ["doc_id", "para_idx", "section_id", "text"]),
            (LP.sentences(placed), P.sentences(parsed), ["doc_id", "sent_idx", "para_idx", "text"]),
            (LP.section_paragraphs(placed), P.section_paragraphs(parsed),
             ["doc_id", "section_idx", "section_id", "pos", "text"]),
            (LP.sections(placed), P.sections(parsed), ["doc_id", "section_id", "header", "n_body_lines"])]:
        assert _rows(got, *columns) == _rows(want, *columns)
    with_lines = {r.doc_id for r in lines.select("doc_id").distinct().collect()}
    own = Q.topic_queries(parsed)
    want = [r for r in _rows(own, "doc", "query_idx", "query", "keywords") if r[0] in with_lines]
    assert _rows(LP.topic_queries(placed), "doc", "query_idx", "query", "keywords") == want


def _text(rng):
    """Any order of headers, long and short paragraphs and blank lines; some without a header, some only of headers."""
    kinds = rng.choice(["h", "b", "l", "hbl", "bl", "hbbbbbbbll", "hl", "hb  "])
    made = {"h": lambda: f"Head {rng.randrange(50)} topic{rng.randrange(9)}", "b": lambda: f"Body number {rng.randrange(50)}.",
            "l": lambda: f"A long paragraph number {rng.randrange(50)} of some words. It goes on! Does it say enough words here?",
            " ": lambda: rng.choice(["", "   ", "\t"])}
    lead = [made["b"]() for _ in range(rng.choice([0, 0, 3]))] + [made["l"]() for _ in range(rng.choice([0, 0, 2]))]
    return "\n".join(lead + [made[rng.choice(kinds)]() for _ in range(rng.choice([1, 5, 60]))])


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_equals_the_row_local_parse(spark, ranges):
    rng = random.Random(ranges)
    hot = "\n".join(_text(rng) for _ in range(12))
    one_section = "Title\n" + "\n".join(f"Paragraph {i} of the only section, which fills all of its ranges." for i in range(150))
    texts = [(f"d{i}", _text(rng)) for i in range(25)] + [("hot", hot), ("one", one_section), ("no text", ""),
             ("sample", open(SAMPLE_DOC, encoding="utf-8").read())]
    placed = LP.place_lines(_lines(spark, texts), ranges)
    _same(spark, texts, placed)


def test_a_large_document_fills_many_tasks(spark):
    text = "\n".join(f"Header {i}\nA body line, number {i}, that ends with a period and is long." for i in range(500))
    lines = _lines(spark, [("hot", text)])
    dealt = LP._flagged(lines).repartitionByRange(8, "doc_id", "major", "minor")
    sizes = [r["count"] for r in dealt.groupBy(LP.F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 300
    last = LP.paragraphs(LP.place_lines(lines, 8)).orderBy("para_idx").collect()[-1]
    assert (last.para_idx, last.section_id, last.text[:25]) == (499, 500, "A body line, number 499, ")


def test_awkward_lines(spark):
    rows = [(None, 0, 1, "Title of none"), (None, 0, 2, "Body line of none."), ("a", 1, 0, None), ("a", 1, 1, "  "),
            ("b", None, None, "Header"), ("b", 0, 0, "Same place, second."), ("b", 0, 0, "Same place, first."),
            ("b", 0, 0, "Same place, first.")]
    lines = spark.createDataFrame([(*r, "x") for r in rows],
                                  "doc_id string, major long, minor long, line string, section_id string")
    placed = LP.place_lines(lines, 4)
    assert _rows(LP.paragraphs(placed), "doc_id", "para_idx", "section_id", "text") == [
        ("b", 0, 1, "Same place, first."), ("b", 1, 1, "Same place, first."), ("b", 2, 1, "Same place, second."),
        (None, 0, 1, "Body line of none.")]
    assert LP.place_lines(lines.limit(0), 4).count() == 0


def test_text_files_are_read_by_splits(spark, tmp_path):
    rng = random.Random(5)
    texts = [(f"{i}.txt", "\n".join(_text(rng) for _ in range(10)) + "\nünïcödé line that is neither short nor ended here") for i in range(3)]
    for i, (name, text) in enumerate(texts):
        (tmp_path / name).write_bytes(text.replace("\n", ["\n", "\r\n", "\r"][i]).encode())
    (tmp_path / "other.csv").write_text("Not\nread")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = read_text_lines(spark, str(tmp_path))
        assert lines.groupBy("doc_id").agg(LP.F.count_distinct("major").alias("n")).where("n > 2").count() >= 1
        _same(spark, texts, LP.place_lines(lines, 6))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
