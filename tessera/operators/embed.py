"""Embedding jobs: text units -> vectors, one row per (model, unit).

Vector tables carry ``model_name, <unit keys>, dim, vec array<float>,
nz array<int>, norm_sq double``.

Two kinds of models:

* **Native hashing models** (default, offline, oracle-checkable).  Tokens are
  lower-cased Unicode words; a token goes to bucket
  ``int(md5(token)[:7], 16) % dim``; the vector holds integer counts.  Words
  are taken out JVM-side; each distinct one of an Arrow batch is hashed once,
  and one ``np.bincount`` per batch gives the dense vectors.  Integer counts keep dot products exact.  The
  embedder is cheap and row-local, so it runs inline on every unit: a
  ``distinct`` over texts would cost a full shuffle to save a hash.
* **User models** (``PandasModel``): a factory ``model_id -> callable(list[str])
  -> ndarray`` loaded once per task.  Inference is expensive, so each distinct
  text is embedded once per model: units are dealt out and sorted by text, one
  exchange for all models, and the pass embeds a run of equal texts once.  Texts
  that very many units have are embedded apart and joined back.  A failure becomes
  an ``error`` row instead of killing the job; time spent is reported per row for
  timing aggregates.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..session import materialise


@dataclass(frozen=True)
class HashingModel:
    name: str
    dim: int

    @property
    def model_id(self) -> str:
        return f"hashing/md5-{self.dim}"


# Native models shipped with the library (ours, not the evaluated toolkit's).
HASH_64 = HashingModel("hash-64", 64)
HASH_256 = HashingModel("hash-256", 256)
NATIVE_MODELS = [HASH_64, HASH_256]


def _ddl(df: DataFrame, drop: set[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
                     if f.name not in drop)


def _batch_hashes(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """md5 bucket hashes of the distinct tokens of a batch, and each token's
    place among them (word frequencies are heavily skewed, so a batch of ~100k
    tokens has a few thousand distinct ones)."""
    if len(tokens) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    enc = pc.dictionary_encode(tokens)
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    uniq = [int(hashlib.md5(t.encode("utf-8")).hexdigest()[:7], 16) for t in enc.dictionary.to_pylist()]
    return np.asarray(uniq, dtype=np.int64), enc.indices.to_numpy(zero_copy_only=False)


#: Vector components that one step of the embedding makes: its arrays are some MB, whatever the Arrow batch.
STEP_COMPONENTS = 1 << 19
#: Words that are counted at a time: the rows of a step may have millions.
STEP_WORDS = 1 << 18


def _bincount(batches, keep: list[str], models: list[tuple[str, int]], timed: bool = False):
    """Arrow batches with ``tokens`` (list<string>) -> one dense count vector
    per (row, model): bucket = md5 hash % dim, counted with ``np.bincount``.
    ``timed``: and the row's share of the time that its step took, the hashes' being shared by the models."""
    step = max(1, STEP_COMPONENTS // max((dim for _, dim in models), default=1))
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            yield from _bincount_step(whole.slice(start, step), keep, models, timed)


def _counts(lists: pa.ListArray, models: list[tuple[str, int]]) -> tuple[list[np.ndarray], list[float]]:
    """For each model the bucket counts of all rows, a step of words at a time, and the seconds that they took."""
    n = len(lists)
    began = time.perf_counter()
    lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lens)
    uniq, words = _batch_hashes(lists.flatten())
    hashing = (time.perf_counter() - began) / max(len(models), 1)
    counts, spent = [0] * len(models), [hashing] * len(models)
    for start in range(0, max(len(words), 1), STEP_WORDS):
        began = time.perf_counter()
        hashes = uniq[words[start:start + STEP_WORDS]]
        own = np.minimum(ends, start + len(hashes)) - np.maximum(ends - lens, start)
        rows = np.repeat(np.arange(n), np.maximum(own, 0))
        shared = (time.perf_counter() - began) / max(len(models), 1)
        for i, (_, dim) in enumerate(models):
            began = time.perf_counter()
            counts[i] = counts[i] + np.bincount(rows * dim + hashes % dim, minlength=n * dim)
            spent[i] += shared + time.perf_counter() - began
    return counts, spent


def _bincount_step(rb, keep: list[str], models: list[tuple[str, int]], timed: bool):
    n = rb.num_rows
    counts, spent = _counts(rb.column("tokens"), models)
    for i, (name, dim) in enumerate(models):
        began = time.perf_counter()
        dense = counts[i].astype(np.float32)
        mat = dense.reshape(n, dim)
        norm_sq = np.einsum("ij,ij->i", mat, mat, dtype=np.float64)
        mask = mat > 0
        nz_vals = np.nonzero(mask)[1].astype(np.int32)
        nz_off = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(mask.sum(axis=1), out=nz_off[1:])
        vec_off = (np.arange(n + 1, dtype=np.int32) * dim)
        cols = [rb.column(c) for c in keep]
        cols += [pa.array(np.full(n, name, dtype=object), type=pa.string()),
                 pa.array(np.full(n, dim, dtype=np.int32)),
                 pa.ListArray.from_arrays(pa.array(vec_off), pa.array(dense)),
                 pa.ListArray.from_arrays(pa.array(nz_off), pa.array(nz_vals, type=pa.int32())),
                 pa.array(norm_sq)]
        names = keep + ["model_name", "dim", "vec", "nz", "norm_sq"]
        if timed:
            cols.append(pa.array(np.full(n, (spent[i] + time.perf_counter() - began) / max(n, 1))))
            names = names + ["elapsed_s"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def native_pass(units: DataFrame, models: list[HashingModel], text_col: str = "text", keep_text: bool = False,
                timed: bool = False) -> tuple[DataFrame, Callable]:
    """The units with their words, and the pass over Arrow batches of them that gives a row per (unit, model): for
    :func:`embed_native`, and for steps that use vectors in the task that made them."""
    keys = [c for c in units.columns if c != text_col or keep_text]
    staged = units.select(*keys, T.words(F.col(text_col)).alias("tokens"))
    spec = [(m.name, m.dim) for m in models]
    return staged, lambda it: _bincount(it, keys, spec, timed)


def embed_native(units: DataFrame, models: list[HashingModel] = NATIVE_MODELS,
                 text_col: str = "text", keep_text: bool = False, timed: bool = False) -> DataFrame:
    """Embed every unit with every native model.  No join and no second pass
    over the text: words are extracted JVM-side, hashed once per distinct
    token of an Arrow batch, and one pass emits a row per (unit, model)."""
    staged, embedding = native_pass(units, models, text_col, keep_text, timed)
    schema = (_ddl(staged, {"tokens"}) +
              ", model_name string, dim int, vec array<float>, nz array<int>, norm_sq double" + ", elapsed_s double" * timed)
    return staged.mapInArrow(embedding, schema)


def vectors_from_array(df: DataFrame, model_name: str, vec_col: str = "embedding") -> DataFrame:
    """Precomputed vectors (e.g. the ``embeddings`` table) in vector-table form."""
    v = F.col(vec_col)
    out = (df.withColumn("model_name", F.lit(model_name))
             .withColumn("dim", F.size(v))
             .withColumn("nz", V.nonzero_indices(v))
             .withColumn("norm_sq", V.norm_sq(v))
             .withColumn("vec", v.cast("array<float>")))
    return out.drop(vec_col) if vec_col != "vec" else out


# ---------------------------------------------------------------------------
# user models through mapInArrow


@dataclass(frozen=True)
class PandasModel:
    """A user model: ``factory(model_id)`` returns ``embed(list[str]) -> ndarray``."""
    name: str
    model_id: str
    factory: Callable[[str], Callable[[list], np.ndarray]]
    batch_size: int = 256


def _attempt(embed, texts: list) -> tuple[list, list]:
    """Vectors and errors of some texts; where they fail together, each is tried alone, so that only those that a
    model can't embed have an error, whatever batch they came in."""
    try:
        return list(np.asarray(embed(texts), dtype=np.float32)), [None] * len(texts)
    except Exception as e:  # noqa: BLE001 -- a failure becomes an error row
        if len(texts) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    alone = [_attempt(embed, [t]) for t in texts]
    return [v for (v,), _ in alone], [e for _, (e,) in alone]


#: Rows that a step of a user's model takes: its arrays are some MB, whatever the Arrow batch.
STEP_ROWS = 2048


def _embedded_texts(embed, load_error: str | None, texts: list, batch_size: int) -> pa.RecordBatch:
    """``vec, norm_sq, error, elapsed_s`` of each text."""
    vecs, errors, spent = [], [], []
    for start in range(0, len(texts), batch_size):
        chunk = texts[start:start + batch_size]
        began = time.time()
        of_chunk, failed = ([None] * len(chunk), [load_error] * len(chunk)) if embed is None else _attempt(embed, chunk)
        if len(of_chunk) != len(chunk):
            raise ValueError(f"{len(of_chunk)} vectors for {len(chunk)} texts")
        vecs += of_chunk
        errors += failed
        spent += [0.0 if embed is None else (time.time() - began) / len(chunk)] * len(chunk)
    found = [v for v in vecs if v is not None]
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.float32)
    sizes = np.array([0 if v is None else len(v) for v in vecs], dtype=np.int64)
    offsets = np.zeros(len(vecs) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    missing = np.array([v is None for v in vecs], dtype=bool)
    if found and len(found) == len(vecs) and (sizes == sizes[0]).all():
        norm_sq = np.square(flat.reshape(len(vecs), -1), dtype=np.float64).sum(axis=1)
    else:
        norm_sq = np.array([np.nan if v is None else np.square(v, dtype=np.float64).sum() for v in vecs], dtype=np.float64)
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float32()), mask=pa.array(missing)),
         pa.array(norm_sq, pa.float64(), from_pandas=True), pa.array(errors, pa.string()), pa.array(spent, pa.float64())],
        names=["vec", "norm_sq", "error", "elapsed_s"])


def _user_pass(model: PandasModel, keep: list[str], text_col: str = "text"):
    """Arrow batches of units -> their ``keep`` columns and those of ``OF_MODEL``.  Of neighbours with one text
    (a null one counts as empty) the first is embedded, also across batches."""
    def run(batches):
        began = time.time()
        try:
            embed, load_error = model.factory(model.model_id), None
        except Exception as e:  # noqa: BLE001 -- a failing model becomes error rows
            embed, load_error = None, f"{type(e).__name__}: {e}"
        load_s = time.time() - began
        last = None     # the text of the row before, and what was made of it
        for whole in batches:
            for start in range(0, whole.num_rows, STEP_ROWS):
                rb = whole.slice(start, STEP_ROWS)
                n, text = rb.num_rows, pc.fill_null(rb.column(text_col), "")
                new = np.ones(n, dtype=bool)
                new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[0] = last is None or text[0].as_py() != last[0]
                made = _embedded_texts(embed, load_error, text.filter(pa.array(new)).to_pylist(), model.batch_size)
                at = np.cumsum(new) - 1
                if not new[0]:
                    made, at = pa.Table.from_batches([last[1], made]).combine_chunks().to_batches()[0], at + 1
                last = text[n - 1].as_py(), made.slice(int(at[-1])).take(pa.array([0]))   # a copy, so that the rest can go
                if len(made) < n or not new[0]:
                    made = made.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(rb.column(c) for c in keep), pa.array(np.full(n, model.name, dtype=object), type=pa.string()),
                     pa.array(np.full(n, load_s)), *made.columns],
                    names=[*keep, "model_name", "load_s", *made.schema.names])
    return run


def embed_texts(units: DataFrame, model: PandasModel, text_col: str = "text") -> DataFrame:
    """Each distinct text once: ``text_key, model_name, model_id, load_s, vec, error, elapsed_s``.

    ``elapsed_s`` is a text's share of the time of the batch it was embedded in.
    """
    return _with_model(_distinct_texts(units, text_col), model, ["text_key"]).select(
        "text_key", "model_name", F.lit(model.model_id).alias("model_id"), "load_s", "vec", "error", "elapsed_s")


OF_MODEL = "model_name string, load_s double, vec array<float>, norm_sq double, error string, elapsed_s double"


def _with_model(rows: DataFrame, model: PandasModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The rows' ``keep`` columns and those of ``OF_MODEL``."""
    kept = ", ".join([_ddl(rows.select(*keep), set()), OF_MODEL]) if keep else OF_MODEL
    return rows.select(*keep, *[text_col] * (text_col not in keep)).mapInArrow(_user_pass(model, keep, text_col), kept)


def _distinct_texts(units: DataFrame, text_col: str) -> DataFrame:
    texts = units.select(_text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return texts.dropDuplicates(["text_key"])


def _text_key(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


#: Units with one text that a task takes together; the vector of a text that more have is joined to them.
HOT_ROWS = 1 << 16


def _by_text(units: DataFrame, text_col: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The units dealt out and sorted by text, all with one text in one task; those whose text more than ``hot_rows``
    have (or one of the same 64 bits) apart, None if there are none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = units.withColumn("text_hash", F.xxhash64(text))
    hot = materialise(keyed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
                      .select("text_hash"), "hot-texts")
    apart = None
    if not hot.isEmpty():   # one in hot_rows units at most
        # written, as each model reads them
        apart = materialise(keyed.join(hot, "text_hash", "left_semi").drop("text_hash"), "hot-units")
        keyed = keyed.join(hot, "text_hash", "left_anti")
    return keyed.repartition("text_hash").sortWithinPartitions("text_hash", text).drop("text_hash"), apart


def user_passes(units: DataFrame, models: list[PandasModel], text_col: str = "text", keep_text: bool = False,
                hot_rows: int = HOT_ROWS) -> list[tuple[DataFrame, Callable | None]]:
    """For each of the user's models the units, dealt out by text, and the pass over Arrow batches of them that gives
    their rows with the model: the unit's columns and ``OF_MODEL``.  The units of all models are one exchange.  Where the
    pass is None, the table has the rows themselves: those of texts that very many units have."""
    keys = [c for c in units.columns if c != text_col or keep_text]
    dealt, apart = _by_text(units, text_col, hot_rows)
    passes: list = [(dealt.select(*keys, *[text_col] * (not keep_text)), _user_pass(m, keys, text_col)) for m in models]
    if apart is not None:
        texts = materialise(_distinct_texts(apart, text_col), "hot-texts")
        apart = apart.withColumn("text_key", _text_key(text_col))
        for m in models:
            rows = apart.join(_with_model(texts, m, ["text_key"]), "text_key")
            passes.append((rows.select(*keys, *(c.split()[0] for c in OF_MODEL.split(", "))), None))
    return passes


def _with_models(units: DataFrame, models: list[PandasModel], text_col: str, keep_text: bool, hot_rows: int) -> DataFrame:
    kept = _ddl(units, set() if keep_text else {text_col})
    out = None
    for rows, run in user_passes(units, models, text_col, keep_text, hot_rows):
        part = rows if run is None else rows.mapInArrow(run, f"{kept}, {OF_MODEL}")
        out = part if out is None else out.unionByName(part)
    return out


def _nonzero() -> Column:
    """``nz`` of the ``vec`` of a user's model, null where it has none."""
    return F.when(F.col("vec").isNotNull(), V.nonzero_indices(F.col("vec")))


def embed_with_model(units: DataFrame, model: PandasModel, text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each distinct text is embedded once, by the task that has all units with it.

    Returns the units with ``model_name, model_id, dim, vec, nz, norm_sq,
    error, elapsed_s, load_s``; failed texts keep ``vec`` NULL and ``error`` set.
    """
    rows = _with_models(units, [model], text_col, True, hot_rows)
    return rows.select(*units.columns, "model_name", F.lit(model.model_id).alias("model_id"), "load_s", "vec", "error",
                       "elapsed_s", _nonzero().alias("nz"), "norm_sq", F.size("vec").alias("dim"))


def embed(units: DataFrame, models: list, text_col: str = "text", keep_text: bool = False,
          timed: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every unit with every model, native ones and the user's: the columns of
    :func:`embed_native` and ``error``.  The user's models run once, their
    vectors are written and read back.  ``timed``: also ``elapsed_s`` of each unit and
    ``load_s``, how long its task took to load the model (0 for native ones)."""
    native = [m for m in models if isinstance(m, HashingModel)]
    own = [m for m in models if not isinstance(m, HashingModel)]
    parts = [embed_native(units, native, text_col, keep_text, timed).withColumn("error", F.lit(None).cast("string"))] \
        if native or not models else []
    times = ["elapsed_s", "load_s"] if timed else []
    if timed and parts:
        parts = [parts[0].withColumn("load_s", F.lit(0.0))]
    keys = [c for c in units.columns if c != text_col or keep_text]
    if own:
        written = materialise(_with_models(units, own, text_col, keep_text, hot_rows).select(
            *keys, "model_name", "vec", "norm_sq", "error", *times), "model-vectors")
        parts.append(written.select(*keys, "model_name", F.size("vec").alias("dim"), "vec", _nonzero().alias("nz"), "norm_sq",
                                    "error", *times))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class _Buckets(dict):
    """Buckets of the words met lately."""

    def __init__(self, dim: int, most: int = 1 << 17):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        bucket = self[word] = (int.from_bytes(hashlib.md5(word.encode("utf-8")).digest()[:4], "big") >> 4) % self.dim
        return bucket


def python_hashing_factory(model_id: str):
    """A user-model factory that renders the hashing rule in plain Python
    (``model_id`` = ``hashing/md5-<dim>``).  It stands in for an external
    inference library in the ``mapInArrow`` path and must give the same
    vectors as the native job."""
    import re as _re
    from itertools import chain
    dim = int(model_id.rsplit("-", 1)[-1])
    word = _re.compile(r"[^\W]+")
    buckets = _Buckets(dim)
    # of ASCII texts the words stand between blanks once all else is one
    plain = "".join(c.lower() if c.isalnum() or c == "_" else " " for c in map(chr, range(128)))

    def words(text):
        return text.translate(plain).split() if text.isascii() else word.findall(text.lower())

    def embed(texts):
        found = [words(t or "") for t in texts]
        places = np.fromiter(map(buckets.__getitem__, chain.from_iterable(found)), np.int64)
        rows = np.repeat(np.arange(len(texts)) * dim, list(map(len, found)))
        return np.bincount(places + rows, minlength=len(texts) * dim).reshape(-1, dim).astype(np.float32)
    return embed


def embedding_timing(texts: DataFrame) -> DataFrame:
    """Per model, over :func:`embed_texts` rows: distinct texts embedded and
    failed, total and mean seconds of those embedded, seconds of the slowest
    load.  NULL where nothing was embedded."""
    done = F.col("error").isNull()
    return texts.groupBy("model_name").agg(
        F.count_if(done).alias("n_texts"),
        F.count_if(~done).alias("n_failed"),
        F.sum(F.when(done, F.col("elapsed_s"))).alias("embedding_time_seconds"),
        F.avg(F.when(done, F.col("elapsed_s"))).alias("average_embedding_time_seconds"),
        F.max("load_s").alias("load_time_seconds"))
