"""Search query sets: topic queries from headers, generic fallback, the default
set, and caller-supplied sets.  Query tables have ``query_idx int, query
string, keywords array<string>`` (plus ``doc`` when queries depend on the
document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise, small_table
from ..sources import literals as L

QUERY_SCHEMA = "query_idx int, query string, keywords array<string>"


def _literal_set(pairs) -> "F.Column":
    return F.array(*[F.struct(F.lit(q).alias("query"),
                              F.array(*[F.lit(k) for k in kws]).alias("keywords"))
                     for q, kws in pairs])


def chosen_queries() -> "F.Column":
    """From the column ``sections``: a query for each of the first 5 section
    headers that yields keywords; fewer than 3 such queries -> the 5 generic
    queries.  Row-local: the decision needs only the document's own sections."""
    def one(s):
        topic = s["header"]
        kw = T.topic_keywords(topic)
        return F.struct(F.concat(F.lit(L.TOPIC_QUERY_PREFIX), F.lower(topic),
                                 F.lit(L.TOPIC_QUERY_SUFFIX)).alias("query"),
                        kw.alias("kw"))

    extra = F.array(*[F.lit(k) for k in L.EXTRA_KEYWORDS])
    cand = F.transform(F.slice(F.col("sections"), 1, L.MAX_TOPICS), one)
    kept = F.transform(F.filter(cand, lambda q: F.size(q["kw"]) > 0),
                       lambda q: F.struct(q["query"].alias("query"),
                                          F.concat(q["kw"], extra).alias("keywords")))
    chosen = F.when(F.size(kept) >= L.MIN_TOPIC_QUERIES, kept) \
              .otherwise(_literal_set(L.GENERIC_QUERIES))
    return F.slice(chosen, 1, L.MAX_QUERIES)


def topic_queries(parsed: DataFrame) -> DataFrame:
    """One row per document and chosen query."""
    return (parsed.select(F.col("doc_id").cast("string").alias("doc"),
                          F.posexplode(chosen_queries()).alias("query_idx", "q"))
                  .select("doc", F.col("query_idx").cast("int").alias("query_idx"),
                          F.col("q.query").alias("query"), F.col("q.keywords").alias("keywords")))


def default_queries(spark: SparkSession) -> DataFrame:
    """The 7-query default set (a fixed literal, safe to broadcast)."""
    rows = [(i, q, kws) for i, (q, kws) in enumerate(L.DEFAULT_QUERIES)]
    return small_table(spark, rows, QUERY_SCHEMA)


def custom_queries(df: DataFrame, query_col: str = "query", keywords_col: str = "keywords",
                   id_col: str | None = None) -> DataFrame:
    """A caller-supplied set ``(query, keywords)``, used as given: no cap on
    its size (the 7-query cap applies to generated sets only).  ``query_idx``
    is the caller's id column, else a unique id assigned without a shuffle."""
    qid = F.col(id_col) if id_col else F.monotonically_increasing_id()
    return df.select(qid.cast("long").alias("query_idx"), F.col(query_col).alias("query"),
                     F.col(keywords_col).alias("keywords"))


def passage_queries(passages: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Queries from reference passages (e.g. the ``benchmark`` table): the
    passage is the query and its distinct keyword-rule words are the expected
    keywords.  Every passage is kept: one query per passage; one without
    keywords has no precision."""
    kw = F.array_distinct(T.topic_keywords(F.col(text_col)))
    return passages.select(F.col(id_col).cast("int").alias("query_idx"),
                           F.col(text_col).alias("query"), kw.alias("keywords"))


def queries_from_lists(df: DataFrame, queries_col: str = "queries", keywords_col: str = "keywords") -> DataFrame:
    """A query set given as two parallel lists (one row per set): queries and
    keyword lists are paired by position and the shorter list wins."""
    z = F.arrays_zip(F.col(queries_col).alias("query"), F.col(keywords_col).alias("keywords"))
    n = F.least(F.size(queries_col), F.size(keywords_col))
    other = [c for c in df.columns if c not in (queries_col, keywords_col)]
    return (df.select(*other, F.posexplode(F.slice(z, 1, n)).alias("query_idx", "q"))
              .select(*other, F.col("query_idx").cast("int").alias("query_idx"),
                      F.col("q.query").alias("query"), F.col("q.keywords").alias("keywords")))


def queries_from_turns(turns: DataFrame, key: str, order: str, text: str = "text", buckets: int | None = None) -> DataFrame:
    """``key, query_idx, query, keywords``: the query sets whose queries are the texts of each ``key`` by ``order``
    (then text), and whose keyword lists are those of all but the last, paired by position.

    A query and the keyword list at its position come from the same row, so
    nothing is gathered: rows are range-partitioned and sorted, and a row's
    position is its place in its range plus the rows of its key in earlier
    ranges.  The last position of a key has no keyword list.  ``buckets``
    defaults to ``spark.sql.shuffle.partitions``.
    """
    spark = turns.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [key, order, text]
    # the id has the number of the range in its upper bits and the place there in the lower 33
    number = F.monotonically_increasing_id()
    ranges = materialise(turns.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("id", number)
                         .withColumn("bucket", F.shiftright("id", 33)), "turn-ranges")
    pieces = ranges.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    whole = Window.partitionBy(key)
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col(key).alias("piece_key"), F.col("bucket").alias("piece_bucket"), "first",
                           F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"),
                           F.sum("c").over(whole).alias("n"))
    placed = ranges.join(pieces, ranges[key].eqNullSafe(F.col("piece_key")) & (F.col("bucket") == F.col("piece_bucket")))
    return (placed.withColumn("query_idx", F.col("before") + F.col("id") - F.col("first"))
            .where(F.col("query_idx") < F.col("n") - 1)
            .select(key, "query_idx", F.col(text).alias("query"), T.topic_keywords(F.col(text)).alias("keywords")))
