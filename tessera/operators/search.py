"""Semantic search precision: for each query, the 3 sentences most similar to
it; a sentence counts when it contains any expected keyword (lower-cased
substring); precision = min(1, matching sentences / number of keywords).

Ties are broken by later sentence first (``major, minor, piece`` descending,
which equals a stable ascending sort reversed); an undefined similarity (zero
vector) ranks last.  ``row_number() <= 3`` becomes a ``WindowGroupLimit``,
applied before and after the shuffle, so a huge document only ships its
per-task top 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..session import materialise
from ..sources import literals as L

SENT_ORDER = ["major", "minor", "piece"]


def query_sentence_similarity(sentence_vecs: DataFrame, query_vecs: DataFrame,
                              per_document: bool, broadcast_queries: bool = False) -> DataFrame:
    """Similarity of every query with every sentence of the same document.

    ``query_vecs``: ``model_name, [doc,] query_idx, vec, nz, norm_sq``.  A
    global query set joins on the model only, so it must be the literal default
    set, for which callers set ``broadcast_queries``; sets of any size go
    through :func:`top_k_in_blocks`.
    """
    keys = ["model_name", "doc"] if per_document else ["model_name"]
    q = query_vecs.select(*keys, "query_idx", *[F.col(c).alias("q_" + c) for c in ("vec", "nz", "norm_sq")])
    if broadcast_queries:
        q = F.broadcast(q)
    text = ["text"] if "text" in sentence_vecs.columns else []
    s = sentence_vecs.select("model_name", "doc", *SENT_ORDER, *text,
                             *[F.col(c).alias("s_" + c) for c in ("vec", "nz", "norm_sq")])
    return (s.join(q, keys)
             .select("model_name", "doc", "query_idx", *SENT_ORDER, *text,
                     V.cosine_between("s_", "q_").alias("similarity")))


def top_k(sims: DataFrame, k: int = L.TOP_K) -> DataFrame:
    w = Window.partitionBy("model_name", "doc", "query_idx").orderBy(
        F.col("similarity").desc_nulls_last(), *[F.col(c).desc() for c in SENT_ORDER])
    return sims.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Vector components of a block of queries that is sent to every task (8 bytes each).
BLOCK_COMPONENTS = 1 << 20
#: Sentences that a task keeps as the best so far, over all documents and queries, before it hands them on.
KEPT_ROWS = 1 << 18


def top_k_in_blocks(sentence_vecs: DataFrame, query_vecs: DataFrame, k: int = L.TOP_K,
                    block_components: int = BLOCK_COMPONENTS, per_document: bool = False,
                    nan_is_largest: bool = False, kept_rows: int = KEPT_ROWS, embedding: Callable | None = None,
                    timed: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """:func:`top_k` for a caller's query set of any size: the same rows.

    Queries go to the tasks in blocks of a bounded size, sentences stay where
    they are.  A task compares a batch of sentences with a block in one matrix
    product and keeps the best ``k`` for each document and query over all of its
    batches, so that neither a row for each comparison nor a join on the model
    arises, nor are sentences sorted.  With more than ``kept_rows`` it hands them on and begins anew.

    ``per_document``: a query is put to its own ``doc`` only.  A similarity that is no number is undefined or, with
    ``nan_is_largest``, comes first as in Spark's order.  With an ``embedding`` (``embed.native_pass``) the
    sentences are those of that pass, whose vectors are compared in the task that makes them; if the pass is ``timed``,
    there is also a table ``model_name, doc, n, s`` of the sentences embedded and the seconds that they took.
    """
    spark = sentence_vecs.sparkSession
    keys = ["model_name", "doc"] if per_document else ["model_name"]
    queries = materialise(query_vecs.select(*keys, "query_idx", "dim", "vec", "norm_sq"), "query-vectors")
    blocks = max(1, -(-_components(queries) // block_components))
    number = F.pmod(F.xxhash64("query_idx"), F.lit(blocks))
    rows = sentence_vecs if embedding else sentence_vecs.select("model_name", "doc", *SENT_ORDER, "text", "vec", "norm_sq")
    if blocks > 1:  # embedded once, read for each block; or the words, which are fewer
        rows = materialise(rows, "sentence-vectors")
    shape = _shape(rows)
    out = times = None
    for block in range(blocks):
        own = queries.where(number == block).select(*keys, "query_idx", "vec", "norm_sq").collect()
        sent = spark.sparkContext.broadcast(_query_matrices(own, keys))
        found = rows.mapInArrow(_best_of_task(sent, k, per_document, nan_is_largest, kept_rows, embedding, timed),
                                shape)
        if timed:  # the times of the pass whose sentences are used: both are written together
            found = materialise(found, "timed-top")
            if times is None:  # each block embeds the sentences again
                times = found.where(F.col("query_idx").isNull()).groupBy("model_name", "doc").agg(
                    F.sum("major").alias("n"), F.sum("similarity").alias("s"))
            found = found.where(F.col("query_idx").isNotNull())
        best = top_k(found, k)
        if blocks > 1:  # a query is in one block, so that its top k is final and the block can go
            best = materialise(best, "block-top")
            sent.destroy()
        out = best if out is None else out.unionByName(best)
    return (out, times) if timed else out


def _components(query_vecs: DataFrame) -> int:
    return query_vecs.select(F.sum("dim")).first()[0] or 0


def _shape(sentences: DataFrame) -> str:
    """Schema of what a task finds in them."""
    return "model_name string, " + ", ".join(
        f"{c} {sentences.schema[c].dataType.simpleString()}" for c in ("doc", *SENT_ORDER, "text")) + \
        ", query_idx long, similarity double"


def fit_one_block(query_vecs: DataFrame) -> bool:
    """Whether :func:`top_k_in_blocks` sends these queries to the tasks at once."""
    return _components(query_vecs) <= BLOCK_COMPONENTS


def top_k_of_passes(passes: list[tuple[DataFrame, Callable | None]], query_vecs: DataFrame, k: int = L.TOP_K,
                    nan_is_largest: bool = False, kept_rows: int = KEPT_ROWS) -> tuple[DataFrame, DataFrame]:
    """:func:`top_k_in_blocks` of sentences that are embedded once (``embed.user_passes``) for queries of one block, and
    ``model_name, doc, n_failed, error`` of sentences that a model failed on.  What the tasks find is written, the vectors are not."""
    queries = query_vecs.select("model_name", "query_idx", "vec", "norm_sq").collect()
    sent = query_vecs.sparkSession.sparkContext.broadcast(_query_matrices(queries, ["model_name"]))
    found = None
    for rows, embedding in passes:
        best = rows.mapInArrow(_best_of_task(sent, k, False, nan_is_largest, kept_rows, embedding), _shape(rows))
        found = best if found is None else found.unionByName(best)
    found = materialise(found, "best-sentences")
    sent.destroy()
    failed = found.where(F.col("query_idx").isNull()).select(
        "model_name", "doc", F.col("major").cast("long").alias("n_failed"), F.col("text").alias("error"))
    return top_k(found.where(F.col("query_idx").isNotNull()), k), failed


#: Sentences and queries of one document that are compared in one matrix product.
TILE_SENTENCES = 4096
TILE_QUERIES = 1024


def top_k_in_tiles(sentence_vecs: DataFrame, query_vecs: DataFrame, k: int = L.TOP_K,
                   tile_sentences: int = TILE_SENTENCES, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """:func:`top_k` for a query set of each document, of any size: the same rows.

    A document of more sentences or queries than a tile has is cut into tiles of
    sentences and of queries; every pair of them is a unit of its own, so that
    the comparisons of a hot document are dealt to many tasks.  Smaller documents
    share units of about a tile's sentences.  A unit gives its best ``k``
    for each query, which are merged by document and query.
    """
    sentences = materialise(sentence_vecs.select("model_name", "doc", *SENT_ORDER, "text", "vec", "norm_sq"), "tile-sentences")
    queries = materialise(query_vecs.select("model_name", "doc", "query_idx", "vec", "norm_sq"), "tile-queries")
    keys = ["model_name", "doc"]
    sizes = (sentences.groupBy(keys).agg(F.count(F.lit(1)).alias("s"))
             .join(queries.groupBy(keys).agg(F.count(F.lit(1)).alias("q")), keys))
    small = sizes.where((F.col("s") <= tile_sentences) & (F.col("q") <= tile_queries))
    shared = -(-(small.agg(F.sum(F.greatest("s", "q"))).first()[0] or 0) // tile_sentences) or 1
    rows, columns = (F.ceil(F.col(c) / most).cast("long") for c, most in (("s", tile_sentences), ("q", tile_queries)))
    alone = (rows > 1) | (columns > 1)
    sizes = materialise(sizes.select(
        *keys, rows.alias("rows"), columns.alias("columns"), F.when(alone, F.col("doc")).alias("alone"),
        F.when(alone, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc"), F.lit(shared))).cast("long").alias("unit")), "tile-sizes")
    unit = ["model_name", "alone", "unit", "row", "column"]
    left = (sentences.join(sizes, keys).withColumn("row", F.expr("pmod(xxhash64(major, minor, piece), rows)"))
            .withColumn("column", F.explode(F.expr("sequence(0, columns - 1)"))).drop("rows", "columns"))
    right = (queries.join(sizes.toDF(*sizes.columns), keys).withColumn("column", F.expr("pmod(xxhash64(query_idx), columns)"))
             .withColumn("row", F.explode(F.expr("sequence(0, rows - 1)"))).drop("rows", "columns"))
    shape = sentences.drop("vec", "norm_sq").schema.fields + [queries.schema["query_idx"]]
    best = left.groupBy(unit).cogroup(right.groupBy(unit)).applyInArrow(
        _best_of_unit(k), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape) + ", similarity double")
    return top_k(best, k)


def _best_of_unit(k: int):
    def run(sentences: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["model_name", "doc", *SENT_ORDER, "text"]
        s_docs, q_docs = sentences.column("doc").to_pylist(), queries.column("doc").to_pylist()
        own_queries: dict = {}
        for i, doc in enumerate(q_docs):
            own_queries.setdefault(doc, []).append(i)
        own_sentences: dict = {}
        for i, doc in enumerate(s_docs):
            own_sentences.setdefault(doc, []).append(i)
        order = list(zip(*(sentences.column(c).to_pylist() for c in SENT_ORDER)))
        rows, asked, values = [], [], []
        for doc, of_query in own_queries.items():
            own = sorted(own_sentences.get(doc, ()), key=order.__getitem__, reverse=True)
            if not own:
                continue
            best, value = _best(_matrix(sentences, own), _norms(sentences, own), _matrix(queries, of_query),
                                _norms(queries, of_query), k)
            rows.append(np.asarray(own)[best].ravel())
            asked.append(np.broadcast_to(of_query, best.shape).ravel())
            values.append(value.ravel())
        at = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        value = np.concatenate(values) if rows else np.empty(0)
        value[np.isneginf(value)] = np.nan
        kept = sentences.select(names).take(pa.array(at, pa.int64()))
        query = queries.column("query_idx").take(pa.array(np.concatenate(asked) if rows else at, pa.int64()))
        return kept.append_column("query_idx", query).append_column("similarity", pa.array(value, from_pandas=True))
    return run


def _matrix(table: pa.Table, rows: list[int]) -> np.ndarray:
    flat = table.column("vec").take(pa.array(rows)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(rows), -1)


def _norms(table: pa.Table, rows: list[int]) -> np.ndarray:
    return table.column("norm_sq").to_numpy()[rows]


def _best(sentences: np.ndarray, norms: np.ndarray, queries: np.ndarray, squares: np.ndarray, k: int
          ) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places of its ``k`` most similar sentences, first ones of equal ones, and the similarities.

    A similarity that is not defined is minus infinity.
    """
    dots = sentences @ queries.T
    norm = norms[:, None] * squares[None, :]
    sims = np.divide(dots, np.sqrt(norm), out=np.full(dots.shape, -np.inf), where=norm > 0)
    best = np.argsort(-sims, axis=0, kind="stable")[:k]
    return best, np.take_along_axis(sims, best, axis=0)


def _query_matrices(rows: list, keys: list[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and squared norms of the queries of each model, or of each model and document."""
    own: dict[tuple, list] = {}
    for r in rows:
        own.setdefault(tuple(r[c] for c in keys), []).append(r)
    return {key: (np.array([r["query_idx"] for r in of], dtype=np.int64), np.array([r["vec"] for r in of], dtype=np.float64),
                  np.array([np.nan if r["norm_sq"] is None else r["norm_sq"] for r in of])) for key, of in own.items()}


#: Below every similarity: one that is not defined.
UNDEFINED = -np.finfo(np.float64).max
#: Where an order column is null; it comes last.
NO_PLACE = np.iinfo(np.int64).min


def _best_rows(sentences: np.ndarray, norms: np.ndarray, queries: np.ndarray, squares: np.ndarray, k: int,
               nan_is_largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_best` with a row for each query, in ``k`` passes instead of a sort."""
    sims = queries @ sentences.T
    with np.errstate(all="ignore"):
        norm = squares[:, None] * norms[None, :]
        sims /= np.sqrt(norm)
    if nan_is_largest:
        sims[(squares <= 0)[:, None] | (norms <= 0)[None, :]] = UNDEFINED
    else:
        sims[~(norm > 0) | np.isnan(sims)] = UNDEFINED
    at = np.arange(len(sims))
    best, values = [], []
    for _ in range(min(k, sims.shape[1])):
        best.append(sims.argmax(axis=1))
        values.append(sims[at, best[-1]])
        sims[at, best[-1]] = -np.inf
    return np.stack(best, axis=1), np.stack(values, axis=1)


def _best_of_task(sent, k: int, per_document: bool, nan_is_largest: bool, kept_rows: int, embedding: Callable | None,
                  timed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[np.ndarray]] = {}   # similarity, order, text of each (model, doc): a row for each query
        held = 0
        spent: dict[tuple, list] = {}              # sentences embedded and seconds of each (model, doc)
        failed: dict[tuple, list] = {}             # sentences that a model failed on, and the least message
        schema = None

        def times() -> pa.RecordBatch:
            """Rows without a query: number of sentences as ``major``, seconds as ``similarity`` or message as ``text``."""
            n = len(spent) + len(failed)
            of = [*spent, *failed]
            counts = [v[0] for v in (*spent.values(), *failed.values())]
            values = {"model_name": [g[0] for g in of], "doc": [g[1] for g in of], "major": counts,
                      "text": [None] * len(spent) + [v[1] for v in failed.values()]}
            arrays = [pa.array(values.get(c, [None] * n), schema.field(c).type) for c in ("model_name", "doc", *SENT_ORDER, "text")]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.nulls(n, pa.int64()), pa.array([v[1] for v in spent.values()] + [None] * len(failed), pa.float64())],
                names=["model_name", "doc", *SENT_ORDER, "text", "query_idx", "similarity"])

        def handed_on() -> Iterator[pa.RecordBatch]:
            for start in range(0, len(groups := list(kept)), 1024):
                some = groups[start:start + 1024]
                columns = [np.concatenate([kept[g][i].ravel() for g in some]) for i in range(2 + len(SENT_ORDER))]
                sizes = [kept[g][0].size for g in some]
                asked = [np.repeat(queries_of(g)[0], kept[g][0].shape[1]) for g in some]
                value, *places, text = columns
                arrays = [pa.array(np.repeat(np.arange(len(some)), sizes)) for _ in range(2)]
                arrays = [pa.array([g[i] for g in some], schema.field(c).type).take(a) for i, (c, a) in
                          enumerate(zip(("model_name", "doc"), arrays))]
                arrays += [pa.array(p, mask=p == NO_PLACE).cast(schema.field(c).type) for c, p in zip(SENT_ORDER, places)]
                arrays += [pa.array(text, schema.field("text").type), pa.array(np.concatenate(asked)),
                           pa.array(value, mask=value == UNDEFINED)]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["model_name", "doc", *SENT_ORDER, "text", "query_idx", "similarity"])

        def queries_of(group: tuple):
            return sent.value.get(group if per_document else group[:1])

        for batch in embedding(batches) if embedding else batches:
            schema = batch.schema
            if "error" in schema.names and batch.column("error").null_count < len(batch):
                lost = batch.column("error").is_valid()
                for *group, error in zip(*(batch.column(c).filter(lost).to_pylist() for c in ("model_name", "doc", "error"))):
                    of_group = failed.setdefault(tuple(group), [0, error])
                    of_group[:] = of_group[0] + 1, min(of_group[1], error)
                if len(failed) > kept_rows:
                    yield times()
                    spent.clear(), failed.clear()
                batch = batch.filter(pc.invert(lost))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("model_name", "doc")))):
                groups.setdefault(key, []).append(i)
            order = [batch.column(c).cast(pa.int64()).fill_null(NO_PLACE).to_numpy(zero_copy_only=False) for c in SENT_ORDER]
            vecs = batch.column("vec")
            norms = batch.column("norm_sq").fill_null(np.nan if not nan_is_largest else 0.0).to_numpy(zero_copy_only=False)
            if timed:
                seconds = batch.column("elapsed_s").to_numpy()
                for group, found in groups.items():
                    own = spent.setdefault(group, [0, 0.0])
                    own[0] += len(found)
                    own[1] += float(seconds[found].sum())
                if len(spent) > kept_rows:
                    yield times()
                    spent.clear(), failed.clear()
            for group, found in groups.items():
                asked = queries_of(group)
                if asked is None:
                    continue
                own = np.array(found)
                own = own[np.lexsort([c[own] for c in reversed(order)])[::-1]]  # of equal similarities the later sentence wins
                mat = vecs.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                at, value = _best_rows(mat.reshape(len(own), -1), norms[own], asked[1], asked[2], k, nan_is_largest)
                at = own[at]
                new = [value, *(c[at] for c in order)]
                former = kept.get(group)
                if former is not None:
                    both = [np.concatenate([f, n], axis=1) for f, n in zip(former, new)]
                    first = np.lexsort((both[3], both[2], both[1], both[0]), axis=1)[:, ::-1][:, :k]
                    new = [np.take_along_axis(c, first, axis=1) for c in both]
                    fresh = first >= former[0].shape[1]
                    text = np.empty(first.shape, dtype=object)
                    text[~fresh] = np.take_along_axis(former[-1], np.where(fresh, 0, first), axis=1)[~fresh]
                    at = np.take_along_axis(at, np.where(fresh, first - former[0].shape[1], 0), axis=1)[fresh]
                    text[fresh] = batch.column("text").take(pa.array(at)).to_pylist()
                    held -= former[0].size
                else:
                    text = np.empty(at.shape, dtype=object)
                    text[:] = np.array(batch.column("text").take(pa.array(at.ravel())).to_pylist(), dtype=object).reshape(at.shape)
                kept[group] = [*new, text]
                held += text.size
                if held > kept_rows:
                    yield from handed_on()
                    kept, held = {}, 0
        if kept:
            yield from handed_on()
        if spent or failed:
            yield times()
    return run


def keyword_hits(top: DataFrame, queries: DataFrame, per_document: bool) -> DataFrame:
    """Attach the query's keywords to the top rows (which carry the sentence
    text) and flag a hit.  ``queries``: ``[doc,] query_idx, keywords``."""
    qk = ["doc", "query_idx"] if per_document else ["query_idx"]
    q = queries.select(*qk, "keywords")
    j = top.join(q, qk)
    return j.withColumn("matched", T.any_keyword_in(F.col("text"), F.col("keywords")))


def query_precision(docs: DataFrame, query_vecs: DataFrame, hits: DataFrame, per_document: bool,
                    broadcast_queries: bool = False) -> DataFrame:
    """One row per (model, doc, query): matches among the top 3 and precision.

    ``docs`` (``model_name, doc``) lists the evaluated documents and
    ``query_vecs`` the embedded queries (``model_name, [doc,] query_idx,
    keywords``).  A query with no sentence at all scores 0, so the query table
    is the left side.
    """
    keys = ["model_name", "doc"] if per_document else ["model_name"]
    q = query_vecs.select(*keys, "query_idx", "keywords")
    if broadcast_queries:
        q = F.broadcast(q)
    base = docs.join(q, keys)
    m = hits.groupBy("model_name", "doc", "query_idx").agg(
        F.sum(F.col("matched").cast("int")).alias("keyword_matches"))
    j = base.join(m, ["model_name", "doc", "query_idx"], "left").fillna(0, subset=["keyword_matches"])
    return j.select("model_name", "doc", "query_idx",
                    F.col("keyword_matches").cast("long").alias("keyword_matches"),
                    F.size("keywords").cast("long").alias("n_keywords"),
                    precision_of(F.col("keyword_matches"), F.size("keywords")).alias("precision"))


def precision_of(matches: Column, keywords: Column) -> Column:
    """Matches for each expected keyword, at most 1; NULL for a query without keywords."""
    return F.when(keywords > 0, F.least(F.lit(1.0), matches / keywords))


def search_precision_of_set(docs: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """:func:`search_precision` of a set that all documents share, without a row for each document and query.

    Queries that hit nothing in a document have precision 0; they enter by
    their number.  ``n_queries`` counts all queries, also those without
    keywords, whose precision is NULL and enters nothing else.
    """
    number = queries.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("keywords") > 0).alias("scored")).first()
    n = F.lit(number["scored"])
    m = (hits.where(F.size("keywords") > 0).groupBy("model_name", "doc", "query_idx")
         .agg(precision_of(F.sum(F.col("matched").cast("int")), F.first(F.size("keywords"))).alias("p")))
    sums = m.groupBy("model_name", "doc").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"),
                                              F.min("p").alias("low"), F.max("p").alias("high"),
                                              F.count(F.lit(1)).alias("seen"))
    j = docs.join(sums, ["model_name", "doc"], "left").fillna(0, subset=["s", "q", "low", "high", "seen"])
    avg = F.try_divide(F.col("s"), n)
    return j.where(F.lit(number["n"]) > 0).select(
        "model_name", "doc", F.lit(number["n"]).cast("long").alias("n_queries"),
        avg.alias("semantic_search_precision"),
        F.when(n > 0, F.when(F.col("seen") < n, F.lit(0.0)).otherwise(F.col("low"))).alias("min_precision"),
        F.when(n > 0, F.col("high")).alias("max_precision"),
        F.sqrt(F.greatest(F.try_divide(F.col("q"), n) - avg * avg, F.lit(0.0))).alias("search_precision_std"))


def search_precision(qp: DataFrame) -> DataFrame:
    p = F.col("precision")
    return qp.groupBy("model_name", "doc").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(p).alias("semantic_search_precision"),
        F.min(p).alias("min_precision"),
        F.max(p).alias("max_precision"),
        F.stddev_pop(p).alias("search_precision_std"))
