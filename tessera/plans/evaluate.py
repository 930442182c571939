"""Document evaluation plan: three metric branches per (model, document) and
their blend, over any corpus binding.

Stages: units -> vectors -> coherence (ordered ranges), contrast (pair
statistics), search (best 3 of each query) -> one row per (model, doc).
Native models embed in the tasks that use their vectors, so that texts are
exchanged and not vectors; a user's model embeds each distinct text once: the
vectors of paragraphs are written once and reused by the coherence and contrast
branches, those of sentences are compared in the task that makes them.
Shuffles are keyed by document (and block / section / query) only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coherence as C
from ..operators import contrast as K
from ..operators import embed as E
from ..operators import score as S
from ..operators import search as R
from ..sources import literals as L
from ..session import materialise, small_table
from .corpora import Corpus


@dataclass
class Options:
    models: list = field(default_factory=lambda: list(E.NATIVE_MODELS))
    ranges: int | None = None      # order ranges of the coherence pass; None: shuffle partitions
    small_max: int = 64
    rows_per_partial: int = 20000
    materialize_vectors: bool = True
    given: list = field(default_factory=list)   # (name, GivenVectors or paragraph vector table) pairs
    observe: bool = False          # progress counters through df.observe
    timed: bool = False            # results with evaluation_time_seconds
    report: Callable[[str, int], None] | None = None   # told (message, percent) as each step of results() begins


@dataclass(frozen=True)
class GivenVectors:
    """Vectors of a model that ran elsewhere, in vector-table form (``dim, vec, nz, norm_sq`` with unit keys).

    ``paragraphs`` have ``doc, section, major, minor`` and, where short ones
    are left out of the contrast, ``is_section_paragraph``; ``sentences`` have
    ``doc, major, minor, piece, text``; ``queries`` have the keys of the
    corpus's queries (``[doc,] query_idx``).  Without sentences or queries there is no
    search: its numbers and the overall score are NULL.
    """

    paragraphs: DataFrame
    sentences: DataFrame | None = None
    queries: DataFrame | None = None

    @property
    def searches(self) -> bool:
        return self.sentences is not None and self.queries is not None


TIMES = ["elapsed_s", "load_s"]
VECTOR = ["dim", "vec", "nz", "norm_sq"]


def select_models(models: list, names: list[str] | None) -> list:
    """Models whose name is listed (all when ``names`` is empty); an unknown
    selection is an error, as on the command line of the evaluated tool."""
    if not names:
        return list(models)
    chosen = [m for m in models if m.name in set(names)]
    if not chosen:
        raise ValueError(f"no valid models selected; available: {[m.name for m in models]}")
    return chosen


def models_for_flag(requests: DataFrame, flag_col: str, full: list, reduced: list) -> DataFrame:
    """Per request row, the model list chosen by a text flag: absent or one of
    true/yes/1/on (any case) -> ``full``, else ``reduced``.  A generator, no join."""
    from ..functions.text import truthy_flag

    def arr(models):
        return F.array(*[F.struct(F.lit(i).alias("model_order"), F.lit(m.name).alias("model_name"),
                                  F.lit(m.model_id).alias("model_id")) for i, m in enumerate(models)])
    chosen = F.when(truthy_flag(F.col(flag_col)), arr(full)).otherwise(arr(reduced))
    return requests.select("*", F.inline(chosen))


def model_table(spark, models) -> DataFrame:
    rows = [(i, m.name, m.model_id, getattr(m, "dim", None)) for i, m in enumerate(models)]
    return small_table(spark, rows, "model_order int, model_name string, model_id string, dim int")


class DocumentEvaluation:
    """DataFrames of one evaluation, each built when first asked for.

    Tables that several branches read (vectors, neighbours, ranks) are written
    while a DataFrame is built; all else runs with the caller's action.
    """

    def __init__(self, corpus: Corpus, options: Options | None = None):
        self.corpus = corpus
        self.o = options or Options()
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def _observed(self, name: str, df: DataFrame) -> DataFrame:
        """Attach progress counters (rows and zero vectors per stage); read
        them with :meth:`progress` after an action has run."""
        if not self.o.observe:
            return df
        from pyspark.sql import Observation
        obs = Observation(name)
        self._observations = getattr(self, "_observations", {})
        self._observations[name] = obs
        return df.observe(obs, F.count(F.lit(1)).alias("n_vectors"),
                          F.count_if(F.col("norm_sq") <= 0).alias("n_zero_vectors"))

    def progress(self) -> dict:
        """Counters of the stages that have run (the progress hook)."""
        return {k: o.get for k, o in getattr(self, "_observations", {}).items()}

    # -- vectors ---------------------------------------------------------
    def _given(self) -> list[tuple[str, GivenVectors]]:
        return [(name, t if isinstance(t, GivenVectors) else GivenVectors(t)) for name, t in self.o.given]

    def _embedded(self, kind: str) -> DataFrame:
        """Every paragraph, sentence or query with every model, with the ``error`` of those that a model failed on."""
        def build():
            if kind == "paragraph":
                return E.embed(self.corpus.paragraphs.withColumn(
                    "is_section_paragraph", F.length("text") > L.SECTION_PARAGRAPH_MIN_CHARS), self.o.models,
                    timed=self.o.timed)
            if kind == "sentence":  # the text rides along so that keyword hits need no join after the top 3
                return E.embed(self.corpus.sentences, self.o.models, keep_text=True, timed=self.o.timed)
            return E.embed(self.corpus.queries, self.o.models, text_col="query", keep_text=True, timed=self.o.timed)
        # times are those of the run whose vectors are used: both are written together
        return self._get(f"embedded_{kind}", lambda: materialise(build(), f"timed-{kind}") if self.o.timed else build())

    def _user_models(self) -> bool:
        return any(not isinstance(m, E.HashingModel) for m in self.o.models)

    def paragraph_vectors(self) -> DataFrame:
        """One vector per (model, paragraph).  Once a second branch needs them
        (contrast, or the full evaluation) they are written and every
        later reader uses the materialised table.  A model that fails on a
        paragraph of a document has none of that document."""
        if "paragraph_vectors_mat" in self._cache:
            return self._cache["paragraph_vectors_mat"]

        def build():
            vecs = self._embedded("paragraph")
            if self._user_models():
                failed = materialise(vecs.where(F.col("error").isNotNull()).select("model_name", "doc").distinct(), "failed-docs")
                vecs = vecs.where(F.col("error").isNull())
                if not failed.isEmpty():
                    vecs = vecs.join(failed, ["model_name", "doc"], "left_anti")
            vecs = vecs.drop("error", *TIMES)
            for name, given in self._given():
                table = given.paragraphs
                columns = [c for c in vecs.columns if c not in ("model_name", "is_section_paragraph")]
                long_enough = F.col("is_section_paragraph") if "is_section_paragraph" in table.columns else F.lit(True)
                vecs = vecs.unionByName(table.select(*columns, F.lit(name).alias("model_name"),
                                                     long_enough.alias("is_section_paragraph")))
            return self._observed("paragraph_vectors", vecs)
        return self._get("paragraph_vectors", build)

    # -- failures --------------------------------------------------------
    def failure_ledger(self) -> DataFrame:
        """``model_name, every_doc, doc, unit_kind, n_failed, error``: the units that a user's model failed on.

        A row for each model, document and kind (paragraph, sentence, query)
        with the least message.  A failed query of a set that all documents
        share fails the model for every document (``every_doc``, doc NULL).
        Such (model, document) pairs have no result.  The ledger is written once.
        """
        key = self.corpus.paragraphs.schema["doc"].dataType

        def build():
            ledger = None
            units = {"paragraph": self.corpus.paragraphs, "sentence": self.corpus.sentences, "query": self.corpus.queries}
            for kind, table in units.items():
                if table is None or not self._user_models():
                    continue
                own = "doc" in table.columns
                counts = [F.count(F.lit(1)).alias("n_failed"), F.min("error").alias("error")]
                if kind == "sentence" and self._searched_where_embedded():
                    self.top3()
                    failed = self._cache["failed_sentences"]
                    counts = [F.sum("n_failed").alias("n_failed"), F.min("error").alias("error")]
                else:
                    failed = self._embedded(kind).where(F.col("error").isNotNull())
                rows = failed.select(
                    "model_name", F.lit(not own).alias("every_doc"),
                    (F.col("doc") if own else F.lit(None)).cast(key).alias("doc"), F.lit(kind).alias("unit_kind"), "error",
                    *["n_failed"] * ("n_failed" in failed.columns)).groupBy("model_name", "every_doc", "doc", "unit_kind").agg(*counts)
                ledger = rows if ledger is None else ledger.unionByName(rows)
            if ledger is None:
                return self.corpus.paragraphs.sparkSession.createDataFrame(
                    [], f"model_name string, every_doc boolean, doc {key.simpleString()}, unit_kind string, "
                        "n_failed long, error string")
            return materialise(ledger, "failures")
        return self._get("failures", build)

    def failed_units(self) -> DataFrame:
        """``model_name, doc, n_failed, error``: paragraphs that a user's model failed on, and the least message."""
        return self.failure_ledger().where("unit_kind = 'paragraph'").select("model_name", "doc", "n_failed", "error")

    def _without_failed(self, rows: DataFrame) -> DataFrame:
        """Rows (``model_name, doc, ...``) of the documents on which their model did not fail."""
        if not self._user_models():
            return rows
        ledger = self.failure_ledger()
        if self._get("no_failures", ledger.isEmpty):
            return rows
        everywhere = ledger.where("every_doc").select("model_name").distinct()
        somewhere = ledger.where("not every_doc").select("model_name", "doc").distinct()
        return (rows.join(everywhere, "model_name", "left_anti")
                    .join(somewhere, ["model_name", "doc"], "left_anti"))

    def materialized_paragraph_vectors(self) -> DataFrame:
        written = not (self.o.given or self.o.observe) and all(not isinstance(m, E.HashingModel) for m in self.o.models)
        if not self.o.materialize_vectors or (written and self.o.models):
            return self.paragraph_vectors()
        return self._get("paragraph_vectors_mat", lambda: materialise(self.paragraph_vectors(), "paragraph-vectors"))

    def sentence_vectors(self) -> DataFrame:
        def build():
            vecs = None
            if self.corpus.sentences is not None:
                vecs = self._embedded("sentence").where(F.col("error").isNull()).drop("error", *TIMES)
            for name, given in self._given():
                if given.searches:
                    table = given.sentences.select("doc", *R.SENT_ORDER, "text", F.lit(name).alias("model_name"), *VECTOR)
                    vecs = table if vecs is None else vecs.unionByName(table)
            return self._observed("sentence_vectors", vecs)
        return self._get("sentence_vectors", build)

    def query_vectors(self) -> DataFrame:
        def build():
            keys = ["doc", "query_idx"] if self.corpus.per_document_queries else ["query_idx"]
            vecs = self._embedded("query").where(F.col("error").isNull()).drop("error", *TIMES)
            for name, given in self._given():
                if given.searches:
                    vecs = vecs.unionByName(given.queries.select(*keys, *VECTOR).join(self.corpus.queries, keys)
                                            .withColumn("model_name", F.lit(name)))
            return vecs
        return self._get("query_vectors", build)

    def searched_models(self) -> list[str]:
        """The models whose search is measured: all but given vectors without sentences or queries."""
        own = [m.name for m in self.o.models] if self.corpus.sentences is not None else []
        if self.corpus.queries is None:
            return []
        return own + [name for name, given in self._given() if given.searches]

    def _in_task(self) -> bool:
        """Whether all vectors are native ones that nobody counts: each step makes them in its own tasks, from
        texts, so that vectors are neither written nor exchanged."""
        return not (self._user_models() or self.o.given or self.o.observe) and bool(self.o.models)

    def _sentences_in_task(self) -> bool:
        """:meth:`_in_task` for sentences; timed ones of documents with their own query sets are written."""
        return self._in_task() and self.corpus.sentences is not None and not (
            self.o.timed and self.corpus.per_document_queries)

    def _searched_where_embedded(self) -> bool:
        """Whether the sentences of the user's models are compared in the tasks that embed them, so that their vectors
        are not written: where nothing else asks for them, and one block has all queries of a shared set."""
        def build():
            o, c = self.o, self.corpus
            if (o.given or o.observe or o.timed or not o.models or any(isinstance(m, E.HashingModel) for m in o.models)
                    or c.sentences is None or c.queries is None or c.per_document_queries
                    or not (c.bounded_sets or self._shared_set()) or "embedded_sentence" in self._cache):
                return False
            return R.fit_one_block(self.query_vectors())
        return self._get("searched_where_embedded", build)

    def _native(self, units: DataFrame) -> tuple[DataFrame, Callable]:
        return E.native_pass(units, self.o.models)

    def _timed_native(self, units: DataFrame) -> tuple[DataFrame, Callable]:
        return E.native_pass(units, self.o.models, timed=self.o.timed)

    def paragraph_texts(self) -> DataFrame:
        """The paragraphs as written once for the steps that embed them in their tasks."""
        def build():
            units = self.corpus.paragraphs.withColumn("is_section_paragraph",
                                                      F.length("text") > L.SECTION_PARAGRAPH_MIN_CHARS)
            return materialise(units, "paragraph-texts") if self.o.materialize_vectors else units
        return self._get("paragraph_texts", build)

    # -- coherence -------------------------------------------------------
    def _neighbour_pass(self) -> DataFrame:
        return self._get("neighbour_pass", lambda: C.neighbour_pass(
            self.paragraph_texts(), ranges=self.o.ranges, native=self._timed_native))

    def adjacent(self) -> DataFrame:
        if self._in_task():
            return self._get("adjacent", lambda: C.neighbouring(self._neighbour_pass()))
        return self._get("adjacent", lambda: C.adjacent_similarity(
            self.materialized_paragraph_vectors(), ranges=self.o.ranges))

    def coherence(self) -> DataFrame:
        return self._get("coherence", lambda: C.paragraph_coherence(self.adjacent()))

    # -- contrast --------------------------------------------------------
    def contrast(self) -> DataFrame:
        if self._in_task():
            return self._get("contrast", lambda: K.section_contrast(
                self.paragraph_texts().filter("is_section_paragraph"), small_max=self.o.small_max,
                rows_per_partial=self.o.rows_per_partial, materialize=False, native=self._native))
        return self._get("contrast", lambda: K.section_contrast(
            self.materialized_paragraph_vectors().filter("is_section_paragraph"),
            small_max=self.o.small_max, rows_per_partial=self.o.rows_per_partial,
            materialize=not self.o.materialize_vectors))

    # -- search ----------------------------------------------------------
    def similarities(self) -> DataFrame:
        return self._get("similarities", lambda: R.query_sentence_similarity(
            self.sentence_vectors(), self.query_vectors(), self.corpus.per_document_queries,
            broadcast_queries=self.corpus.literal_queries))

    def _shared_set(self) -> bool:
        """Whether a caller's query set, of any size, is put to all documents."""
        return not self.corpus.per_document_queries and not self.corpus.literal_queries

    def _top_in_blocks(self, **how) -> DataFrame:
        """The best sentences without an exchange of vectors; those of native models alone don't even leave their task."""
        if self._searched_where_embedded():
            passes = E.user_passes(self.corpus.sentences, self.o.models, keep_text=True)
            found, self._cache["failed_sentences"] = R.top_k_of_passes(passes, self.query_vectors(), **how)
            return found
        if not self._sentences_in_task():
            return R.top_k_in_blocks(self.sentence_vectors(), self.query_vectors(), **how)
        words, embedding = E.native_pass(self.corpus.sentences, self.o.models, keep_text=True, timed=self.o.timed)
        found = R.top_k_in_blocks(words, self.query_vectors(), embedding=embedding, timed=self.o.timed, **how)
        if self.o.timed:
            found, self._cache["search_times"] = found
        return found

    def _top_of_own_sets(self) -> DataFrame:
        """Each document's own query set: all sets as one block if they fit into one, else by tiles."""
        if self._sentences_in_task():
            most = R.BLOCK_COMPONENTS // max(1, sum(m.dim for m in self.o.models))
            if self.corpus.queries.limit(most + 1).count() <= most:
                kind = self.corpus.queries.schema["query_idx"].dataType
                return self._top_in_blocks(per_document=True).withColumn("query_idx", F.col("query_idx").cast(kind))
        return R.top_k_in_tiles(self.sentence_vectors(), self.query_vectors())

    def top3(self) -> DataFrame:
        if self._shared_set():
            return self._get("top3", self._top_in_blocks)
        if not self.corpus.bounded_sets:
            return self._get("top3", self._top_of_own_sets)
        if not self.corpus.per_document_queries:
            return self._get("top3", lambda: self._top_in_blocks(nan_is_largest=True).select(
                "model_name", "doc", F.col("query_idx").cast("int").alias("query_idx"), *R.SENT_ORDER, "text",
                "similarity", "rank"))
        return self._get("top3", lambda: R.top_k(self.similarities()))

    def hits(self) -> DataFrame:
        return self._get("hits", lambda: R.keyword_hits(
            self.top3(), self.corpus.queries, self.corpus.per_document_queries))

    def evaluated_docs(self) -> DataFrame:
        """(model, doc) pairs that get a result: documents with at least two
        paragraphs (exactly those with a coherence row).  Counted on the
        written vector table when there is one (of which only the two key
        columns are read), else on the units; the vector plan is not rebuilt for it."""
        def build():
            if "paragraph_vectors_mat" in self._cache:
                v = self._cache["paragraph_vectors_mat"]
                return (v.groupBy("model_name", "doc").agg(F.count(F.lit(1)).alias("n"))
                         .filter(F.col("n") >= 2).select("model_name", "doc"))
            if self._user_models() or self.o.given:
                v = self.materialized_paragraph_vectors()
                return (v.groupBy("model_name", "doc").agg(F.count(F.lit(1)).alias("n"))
                         .filter(F.col("n") >= 2).select("model_name", "doc"))
            names = F.array(*[F.lit(m.name) for m in self.o.models])
            units = self._cache.get("paragraph_texts", self.corpus.paragraphs)
            docs = (units.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
                    .filter(F.col("n") >= 2))
            return docs.select(F.explode(names).alias("model_name"), "doc")
        return self._get("evaluated_docs", lambda: self._without_failed(build()))

    def searched_docs(self) -> DataFrame:
        """The :meth:`evaluated_docs` of models whose search is measured."""
        if len(self.searched_models()) == len(self.o.models) + len(self.o.given):
            return self.evaluated_docs()
        return self.evaluated_docs().where(F.col("model_name").isin(self.searched_models()))

    def query_precision(self) -> DataFrame:
        return self._get("query_precision", lambda: R.query_precision(
            self.searched_docs(), self.query_vectors(), self.hits(),
            self.corpus.per_document_queries, broadcast_queries=self.corpus.literal_queries))

    def search(self) -> DataFrame:
        if self._shared_set():
            return self._get("search", lambda: R.search_precision_of_set(
                self.searched_docs(), self.corpus.queries, self.hits()))
        return self._get("search", lambda: R.search_precision(self.query_precision()))

    # -- times -----------------------------------------------------------
    def evaluation_times(self) -> DataFrame:
        """``model_name, doc, n_embedded, evaluation_time_seconds`` of a timed evaluation.

        The time is measured in the tasks: a unit's share of the batch it was
        embedded in, over the document's paragraphs, sentences and queries, and
        the slowest load of the model.  Native models embed in the pass that compares
        the units, where it is measured; the contrast embeds its paragraphs once more, which is not in it.  A set of queries that all documents share
        counts for each, as does a text that several documents have, though it
        was embedded once.  The comparisons of vectors are not in it.
        Given vectors have no time.
        """
        if not self.o.timed:
            raise ValueError("times are measured with Options(timed=True)")
        keys = ["model_name", "doc"]
        sums = [F.count(F.lit(1)).alias("n"), F.sum("elapsed_s").alias("s"), F.max("load_s").alias("load")]
        kinds = ["paragraph"] + ["sentence"] * (self.corpus.sentences is not None)
        own = self.corpus.queries is not None and self.corpus.per_document_queries
        tables = [self._unit_times(kind, keys, sums) for kind in kinds + ["query"] * own]
        units = tables[0]
        for table in tables[1:]:
            units = units.unionByName(table)
        times = units.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("load").alias("load"))
        if self.corpus.queries is not None and not own:
            shared = self._embedded("query").groupBy("model_name").agg(*sums).select(
                "model_name", F.col("n").alias("qn"), F.col("s").alias("qs"), F.col("load").alias("qload"))
            times = times.join(shared, "model_name", "left").select(
                *keys, (F.col("n") + F.coalesce("qn", F.lit(0))).alias("n"),
                (F.col("s") + F.coalesce("qs", F.lit(0.0))).alias("s"), F.greatest("load", "qload").alias("load"))
        return times.select(*keys, F.col("n").alias("n_embedded"), (F.col("s") + F.col("load")).alias("evaluation_time_seconds"))

    def _unit_times(self, kind: str, keys: list[str], sums: list) -> DataFrame:
        """``keys, n, s, load`` of one kind of units, from the pass that uses their vectors or the written ones."""
        load = F.lit(0.0).alias("load")
        if kind == "paragraph" and self._in_task():
            return C.embedding_times(self._neighbour_pass()).select(*keys, "n", "s", load)
        if kind == "sentence" and self._sentences_in_task() and self.corpus.queries is not None:
            self.top3()
            return self._cache["search_times"].select(*keys, "n", "s", load)
        return self._embedded(kind).groupBy(*keys).agg(*sums)

    def total_times(self) -> DataFrame:
        """``model_name, n_docs, total_time_seconds``: the times of a model's documents that have a result, added up."""
        done = self.evaluated_docs().join(self.evaluation_times(), ["model_name", "doc"])
        return done.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_docs"),
                                              F.sum("evaluation_time_seconds").alias("total_time_seconds"))

    # -- blend -----------------------------------------------------------
    def _begin(self, message: str, progress: int) -> None:
        if self.o.report is not None:
            self.o.report(message, progress)

    def results(self) -> DataFrame:
        """One row per (model, document) with all metrics and their blend.

        A model that failed on any unit of a document has no row of it.  Search
        numbers that were not measured are NULL, and so is the blend.
        """
        def build():
            models = model_table(self.corpus.paragraphs.sparkSession, [
                *self.o.models, *(E.PandasModel(name, "given", None) for name, _ in self.o.given)])
            self._begin("Embedding paragraphs", 15)
            # shared by coherence and contrast
            self.paragraph_texts() if self._in_task() else self.materialized_paragraph_vectors()
            self._begin("Comparing neighbouring paragraphs", 35)
            coherence = self.coherence()
            self._begin("Comparing sections", 55)
            contrast = self.contrast()
            searched = self.searched_models()
            self._begin("Searching", 70)
            r = S.overall_score(coherence, contrast, self.search() if searched else None, searched=searched)
            r = self._without_failed(r)
            if self.o.timed:
                r = r.join(self.evaluation_times(), ["model_name", "doc"], "left")
            return r.join(F.broadcast(models.select("model_name", "model_order", "model_id")), "model_name")
        return self._get("results", build)
