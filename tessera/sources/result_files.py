"""Result files as a Spark data source and sink: ``format("tessera_results")``.

A line is one document with its results keyed by model, as ``results_io``
nests them: ``{"doc": ..., "results": {model: {...}}}``.  Each task writes files
of its own, of at most ``rowsPerFile`` lines (100,000).  Nothing of a write can
be read before its commit, which lists the files in a manifest of the next
number; readers take the last manifest.  So a write that fails or is aborted
leaves the former results as they were, and a task that ran twice counts once.
Until then the files lie in a folder of that write, which only the driver makes and
deletes: a task that is still at work after an abort can't leave one behind.

``overwrite`` lists the new files alone, ``append`` adds them to the former ones.
The files that only the manifest before the last one named are deleted with the
next commit, not at once, so that a reader already at work can finish.  One
writer at a time; the folder must be one that driver and executors share.

Columns are ``doc, results_json``; others are dropped, a null ``results_json`` is ``{}``.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import StructType

from .results_io import from_json_documents, to_json_documents

SCHEMA = "doc string, results_json string"
MANIFEST = re.compile(r"_manifest-(\d+)\.json")
WRITING = "_writing-"
LINES_A_BATCH = 1000


def _storage(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _names(storage: fs.FileSystem, folder: str) -> list[str]:
    return [f.base_name for f in storage.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file]


def _drop_writing(storage: fs.FileSystem, folder: str) -> None:
    """Delete the folders of writes, also one that a task puts a file in meanwhile."""
    for found in storage.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        for last in (False, False, True):
            if found.is_file or not found.base_name.startswith(WRITING):
                break
            try:
                storage.delete_dir(found.path)
                break
            except FileNotFoundError:
                break
            except OSError:
                if last:
                    raise


def _manifests(storage: fs.FileSystem, folder: str) -> list[int]:
    return sorted(int(m[1]) for name in _names(storage, folder) if (m := MANIFEST.fullmatch(name)))


def _listed(storage: fs.FileSystem, folder: str, number: int) -> list[str]:
    with storage.open_input_stream(f"{folder}/_manifest-{number}.json") as f:
        return json.loads(f.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


@dataclass
class ResultFile(InputPartition):
    name: str | None


class ResultWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, rows_per_file: int):
        self.path, self.overwrite, self.rows_per_file = path, overwrite, rows_per_file
        self.write_id = uuid.uuid4().hex
        storage, folder = _storage(path)
        storage.create_dir(f"{folder}/{self._own()}", recursive=True)

    def _own(self) -> str:
        return f"{WRITING}{self.write_id}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        storage, folder = _storage(self.path)
        done, out, lines = Written(), None, 0
        try:
            for batch in iterator:
                for doc, results in zip(batch.column("doc").to_pylist(), batch.column("results_json").to_pylist()):
                    if out is None:
                        done.files.append(f"part-{self.write_id}-{uuid.uuid4().hex}.jsonl")
                        out, lines = storage.open_output_stream(f"{folder}/{self._own()}/{done.files[-1]}"), 0
                    out.write(f'{{"doc": {json.dumps(doc)}, "results": {results or "{}"}}}\n'.encode())
                    lines += 1
                    if lines == self.rows_per_file:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        storage, folder = _storage(self.path)
        numbers = _manifests(storage, folder)
        former = _listed(storage, folder, numbers[-1]) if numbers else []
        new = [name for m in messages if m is not None for name in m.files]
        files = new if self.overwrite else former + new
        for name in new:
            storage.move(f"{folder}/{self._own()}/{name}", f"{folder}/{name}")
        hidden = f"{folder}/{self._own()}/manifest"
        with storage.open_output_stream(hidden) as f:
            f.write(json.dumps({"files": files}).encode())
        storage.move(hidden, f"{folder}/_manifest-{numbers[-1] + 1 if numbers else 0}.json")
        needed = {*files, *former}
        older = [f"_manifest-{n}.json" for n in numbers[:-1]]
        for name in older + [n for n in _names(storage, folder) if n.startswith("part-") and n not in needed]:
            storage.delete_file(f"{folder}/{name}")
        _drop_writing(storage, folder)

    def abort(self, messages: list[Written | None]) -> None:
        storage, folder = _storage(self.path)
        for name in _names(storage, folder):  # moved by a commit that failed
            if self.write_id in name:
                storage.delete_file(f"{folder}/{name}")
        _drop_writing(storage, folder)


class ResultReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ResultFile]:
        storage, folder = _storage(self.path)
        numbers = _manifests(storage, folder)
        if not numbers:
            raise FileNotFoundError(f"no results were committed in {self.path}")
        return [ResultFile(name) for name in _listed(storage, folder, numbers[-1])] or [ResultFile(None)]

    def read(self, partition: ResultFile) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        storage, folder = _storage(self.path)
        docs, results = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(results, pa.string())],
                                              names=["doc", "results_json"])

        with io.TextIOWrapper(storage.open_input_file(f"{folder}/{partition.name}"), encoding="utf-8", newline="\n") as f:
            for line in f:
                row = json.loads(line)
                docs.append(row["doc"])
                results.append(json.dumps(row["results"]))
                if len(docs) == LINES_A_BATCH:
                    yield batch()
                    docs, results = [], []
        if docs:
            yield batch()


class ResultFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_results"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ResultReader:
        return ResultReader(self.options["path"].rstrip("/"))

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        missing = {"doc", "results_json"} - set(schema.names)
        if missing:
            raise ValueError(f"result files need the columns {sorted(missing)}")
        return ResultWriter(self.options["path"].rstrip("/"), overwrite, int(self.options.get("rowsPerFile", 100_000)))


def write_result_files(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``model_name, doc, result`` (``results_io.nest``) as result files."""
    nested.sparkSession.dataSource.register(ResultFiles)
    to_json_documents(nested).write.format("tessera_results").mode(mode).save(path)


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document and model of the results last committed in a folder."""
    spark.dataSource.register(ResultFiles)
    return from_json_documents(spark.read.format("tessera_results").load(path))
