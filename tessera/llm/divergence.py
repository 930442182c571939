"""Source divergence audit by count-cell ranking.

A group is a source of a language.  Its probability of a term depends on the
term's count in it alone, the language's on the count in the language, so terms
with the same two counts are one cell: f is evaluated once for each cell, cells
of equal value are merged and ranked by how many terms stand before them, and
only the cells that reach the wanted ranks are expanded into terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.compression import values
from tessera.session import materialise

#: Letters A-Z and a-z and every byte of a character beyond ASCII make terms; A-Z become a-z, all else a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
UNIT = 1_000_000_000
ADDED = 5
LEAST_DOCS = 30
MOST_RANK = 50
#: Counted (group, term) entries that a task holds before it hands them on.
HELD = 400_000
#: Terms and sources whose probabilities make one dense matrix.
BLOCK_TERMS = 2048
TILE_SOURCES = 256


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group, and rows that hold it.

    A task counts its own rows first, so a hot group sends one row for each
    task and term.  A group also has a row with the empty term (n and docs 0),
    which stands for the group itself, terms or not.  Nulls are empty.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, text in zip(keys, values(batch.column(2).cast(pa.binary()))):
                held = groups.get(key)
                if held is None:
                    held = groups[key] = (Counter(), Counter())
                terms = text.translate(TERM_BYTES).split()
                held[0].update(terms)
                held[1].update(set(terms))
            if sum(len(n) for n, _ in groups.values()) >= HELD:
                yield from map(_counted, groups.items())
                groups.clear()
        yield from map(_counted, groups.items())

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(group: tuple[tuple, tuple[Counter, Counter]]) -> pa.RecordBatch:
    (lang, source), (times, docs) = group
    terms = [b"", *times]
    n = [0, *times.values()]
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()),
        "term": pa.array(terms, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64()),
        "docs": pa.array([0, *map(docs.__getitem__, times)], pa.int64())})


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, first`` of the terms that at least ``least_docs`` rows of a language hold.

    ``lang_n``: occurrences in the language; ``first`` marks one row of each
    (lang, term).  Rows with the empty term stand for groups and always stay.
    """
    own = Window.partitionBy("lang", "term")
    known = (term_counts(docs).withColumn("lang_n", F.sum("n").over(own))
             .withColumn("lang_docs", F.sum("docs").over(own))
             .withColumn("first", F.row_number().over(own.orderBy("source")) == 1))
    return materialise(known.where((F.col("lang_docs") >= least_docs) | (F.col("term") == ""))
                       .drop("docs", "lang_docs"), "audit-terms")


def probability(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 5) / (N + 5 V)), exact at any size; 0 where no term is kept."""
    many = F.expr(f"cast({UNIT} * cast({n} + {ADDED} as decimal(20, 0)) as decimal(31, 0))")
    of = F.expr(f"cast({total} + {ADDED} * terms as decimal(20, 0))")
    return F.when(F.col("terms") > 0, F.call_function("div", many, of) + 1).otherwise(0).cast("long")


def groups_of(kept: DataFrame) -> DataFrame:
    """``lang, source, total, lang_total, terms, sources, idle``: N of group and language, V, and p of a count of 0."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.sum(F.when(F.col("first") & (F.col("term") != ""), 1).otherwise(0)).alias("terms"),
        F.sum(F.when(F.col("term") == "", 1).otherwise(0)).alias("sources"))
    return groups.join(langs, "lang").withColumn("idle", probability("0", "total"))


def over_used_terms(kept: DataFrame, groups: DataFrame, most_rank: int = MOST_RANK) -> DataFrame:
    """``lang, source, item, value, rank``: terms that a group uses more than its language, by how much more."""
    cell = ["lang", "source", "n", "lang_n"]
    used = kept.where("term <> '' and n > 0")
    cells = (used.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
             .join(groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
             .withColumn("value", probability("n", "total") - probability("lang_n", "lang_total"))
             .where("value > 0").select(*cell, "size", "value"))
    # every value has a term at least, so no more than most_rank values reach the wanted ranks
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = (cells.groupBy("lang", "source", "value").agg(F.sum("size").alias("size"))
              .withColumn("place", F.row_number().over(down)).where(F.col("place") <= most_rank)
              .withColumn("before", F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)))
              .where(F.coalesce("before", F.lit(0)) < most_rank).select("lang", "source", "value"))
    wanted = cells.join(merged, ["lang", "source", "value"]).select(*cell, "value")
    return (used.join(wanted, cell).withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= most_rank)
        .select("lang", "source", F.col("term").alias("item"), "value", "rank"))


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: each other source of the language by the sum of |p - q| over kept terms.

    A unit is a block of terms with a pair of tiles of sources; its matrix of
    probabilities is bounded, whatever the number of terms and of sources.
    """
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("long")
    tiles = F.ceil(F.col("sources") / TILE_SOURCES).cast("long")
    sized = (groups.select("lang", "source", "total", "terms", "idle", blocks.alias("blocks"), tiles.alias("tiles"))
             .withColumn("tile", F.expr("pmod(xxhash64(source), tiles)")))
    counted = (kept.where("term <> '' and n > 0").join(sized, ["lang", "source"])
               .select("lang", "source", "tile", "tiles", F.expr("pmod(xxhash64(term), blocks)").alias("block"), "term",
                       probability("n", "total").alias("p"), "terms"))
    idle = sized.select("lang", "source", "tile", "tiles", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
                        F.lit(None).cast("string").alias("term"), F.col("idle").alias("p"), "terms")
    units = (counted.unionByName(idle).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
             .select("lang", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
                     "source", "tile", "term", "p", "terms"))
    sums = (units.groupBy("lang", "block", "a", "b")
            .applyInArrow(_unit_distances, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank)


def _unit_distances(unit: pa.Table) -> pa.Table:
    """Sums over the unit's terms, for ordered pairs of a source of one tile with one of the other.

    A row without term has a source's probability of a term that it lacks.
    Terms outside the unit's rows are lacking in both: block 0 adds |p - q| of
    lacking ones for all kept terms, and every block takes off its own number.
    """
    lang, block, a, b = (unit.column(c)[0].as_py() for c in ("lang", "block", "a", "b"))
    present = unit.column("term").is_valid().to_numpy()
    names = unit.column("source").combine_chunks().dictionary_encode()
    number, p = names.indices.to_numpy(), unit.column("p").to_numpy()
    sources = np.array(names.dictionary.to_pylist(), dtype=object)
    lacking, tile = np.zeros(len(sources), dtype=np.int64), np.zeros(len(sources), dtype=np.int64)
    lacking[number[~present]] = p[~present]
    tile[number] = unit.column("tile").to_numpy()
    terms = unit.column("term").combine_chunks().filter(pa.array(present)).dictionary_encode()
    matrix = np.repeat(lacking[:, None], len(terms.dictionary), axis=1)
    matrix[number[present], terms.indices.to_numpy()] = p[present]
    elsewhere = (unit.column("terms")[0].as_py() if block == 0 else 0) - matrix.shape[1]
    left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in left:
        others = right[right != i]
        value = np.abs(matrix[others] - matrix[i]).sum(axis=1) + elsewhere * np.abs(lacking[others] - lacking[i])
        out.append((np.full(len(others), i), others, value))
        if a != b:
            out.append((others, np.full(len(others), i), value))
    one, two, value = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, dtype=np.int64),) * 3
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": pa.array(sources[one], pa.string()),
                     "item": pa.array(sources[two], pa.string()), "value": pa.array(value, pa.int64())})


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, most_rank: int = MOST_RANK) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) group of ``docs`` (text, lang, source).

    Part ``pair`` ranks the other sources of the language by their distance,
    part ``term`` the terms that the group uses more than its language, up to
    ``most_rank``.  Terms are runs of letters A-Z (in lower case) and of
    characters beyond ASCII that ``least_docs`` rows of the language hold.
    Null texts, languages and sources are empty; every row counts, repeated
    rows too; a group without kept terms has pairs; a language without any has
    distances of 0; equal values go by UTF-8 order; an empty table gives no
    rows; other columns are not read.
    """
    kept = kept_terms(docs, least_docs)
    groups = materialise(groups_of(kept), "audit-groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_distances(kept, groups).withColumn("part", F.lit("pair"))
    terms = over_used_terms(kept, groups, most_rank).withColumn("part", F.lit("term"))
    return pairs.select(columns).unionByName(terms.select(columns))


AUDIT_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
occurrences AS (SELECT id, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT l.lang, coalesce(sum(k.lang_n), 0)::HUGEINT AS lang_total, count(k.term)::HUGEINT AS terms
          FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
counts AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept USING (lang, term)
           GROUP BY o.lang, o.source, o.term),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
           FROM (SELECT DISTINCT lang, source FROM docs) g
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
dense AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT // (t.total + 5 * l.terms) AS p,
    1 + 1000000000 * (k.lang_n + 5)::HUGEINT // (l.lang_total + 5 * l.terms) AS q
    FROM totals t JOIN langs l ON l.lang = t.lang JOIN kept k ON k.lang = t.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 50
"""
