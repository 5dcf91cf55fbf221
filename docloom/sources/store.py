"""A store of document files as a Spark format: one folder for each document, whole files committed together.

    spark.dataSource.register(DocumentFiles)
    rows.write.format("document_files").mode("append").save(folder)
    spark.read.format("document_files").load(folder)

Rows are (doc_id, file_name, content). Tasks write below a folder of their attempt; only when all have ended does the
driver give the files their names and move them, so that a failed write leaves nothing. The folder may be in any store
that pyarrow reaches and that all workers share.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.storage import stored
from .ole import free_name, safe_name

COLUMNS = "doc_id string, file_name string, content binary"
#: Bytes of file contents in a batch that a reader gives back at a time.
BATCH_BYTES = 1 << 24


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _folder(doc: str | None, plain: bool = False) -> str:
    """A document's folder: its id with what is not a plain letter written as %XX, so that ids and folders are one to one.

    Plain folders have the id itself, made safe, as readers of folders of documents expect it.
    """
    return safe_name(doc or "") if plain else "doc=" + ("" if doc is None else "." + quote(doc, safe=""))


def _names(files: fs.FileSystem, root: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.base_name for x in found)


def _cleared(files: fs.FileSystem, folder: str, overwrite: bool, clear: tuple[str, ...]) -> set[str]:
    """The names in a document's folder, which is made if there is none; with overwrite, those that the write replaces go."""
    files.create_dir(folder, recursive=True)
    old = set(_names(files, folder))
    gone = {x for x in old if not clear or x.lower().endswith(clear)} if overwrite else set()
    for x in gone:
        files.delete_file(f"{folder}/{x}")
    return old - gone


def _removed(files: fs.FileSystem, staging: str) -> None:
    for left in range(5, 0, -1):  # a task that is being stopped may add a file meanwhile
        try:
            if files.get_file_info(staging).type == fs.FileType.Directory:
                files.delete_dir(staging)
            return
        except OSError:
            if left == 1:
                raise
            time.sleep(0.2)


def _ending(clear: str) -> tuple[str, ...]:
    return tuple(x.strip().lower() for x in clear.split(",") if x.strip())


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (doc, wanted name, SHA-256, staged path) of each file."""

    files: list[tuple[str | None, str, str, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, clear: tuple[str, ...], plain: bool = False):
        self.path, self.overwrite, self.clear, self.plain, self.run = path.rstrip("/"), overwrite, clear, plain, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{_opened(self.path)[1]}/_staging-{self.run}"

    def write(self, iterator: Iterator) -> Written:
        files, _ = _opened(self.path)
        attempt = f"{self.staging}/{TaskContext.get().taskAttemptId()}"
        files.create_dir(attempt, recursive=False)  # fails once the write was given up and its folder is gone
        out = []
        for n, (doc, name, content) in enumerate(iterator):
            body = bytes(content) if content is not None else b""
            with files.open_output_stream(f"{attempt}/{n}", compression=None) as f:
                f.write(body)
            out.append((doc, safe_name(name or ""), hashlib.sha256(body).hexdigest(), f"{attempt}/{n}"))
        return Written(out)

    def commit(self, messages: list[Written]) -> None:
        """Names and moves the files: in order of document, name and content; a taken name gets _2, _3, ... before its suffixes."""
        files, root = _opened(self.path)
        staged = sorted((x for m in messages if m for x in m.files), key=lambda x: (x[0] is not None, *(y or "" for y in x)))
        taken: dict[str, set[str]] = {}
        tried: dict[str, dict[str, int]] = {}
        for doc, name, _, where in staged:
            doc = _folder(doc, self.plain)
            folder = f"{root}/{doc}"
            if doc not in taken:
                taken[doc], tried[doc] = _cleared(files, folder, self.overwrite, self.clear), {}
            final = free_name(name, taken[doc], tried[doc])
            taken[doc].add(final)
            files.move(where, f"{folder}/{final}")
        self._clean()

    def abort(self, messages: list[Written]) -> None:
        self._clean()

    def _clean(self) -> None:
        _removed(_opened(self.path)[0], self.staging)


@dataclass
class Folder(InputPartition):
    name: str


class Reader(DataSourceReader):
    def __init__(self, path: str, plain: bool = False):
        self.path, self.plain = path.rstrip("/"), plain

    def partitions(self) -> list[Folder]:
        return [Folder(x) for x in _names(*_opened(self.path)) if x.startswith("doc=") or (self.plain and not x.startswith("_"))] or [Folder("")]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.path)
        schema = pa.schema([("doc_id", pa.string()), ("file_name", pa.string()), ("content", pa.binary())])
        rows, size = [], 0
        doc = partition.name if self.plain else unquote(partition.name.removeprefix("doc=.")) if partition.name.startswith("doc=.") else None
        for name in _names(files, f"{root}/{partition.name}") if partition.name else ():
            with files.open_input_stream(f"{root}/{partition.name}/{name}", compression=None) as f:
                rows.append({"doc_id": doc, "file_name": name, "content": f.read()})
            size += len(rows[-1]["content"])
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


class DocumentFiles(DataSource):
    """append adds files; overwrite clears the folders of the documents that are written (those files alone that end
    in one of the option `clear`, as ".txt,.json", if it is given). Other documents stay in both. With the option `folders`
    set to plain, folders have the ids of documents as names, which must then be safe ones."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("folders") == "plain")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if [f.name for f in schema.fields] != ["doc_id", "file_name", "content"]:
            raise ValueError(f"columns must be {COLUMNS}")
        writer = Writer(self.options["path"], overwrite, _ending(self.options.get("clear", "")), self.options.get("folders") == "plain")
        _opened(self.options["path"])[0].create_dir(writer.staging, recursive=True)
        return writer


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores: each is a file to write, move or read, however few bytes it has."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def save(rows: DataFrame, path: str, overwrite: bool = False, clear: str = "", folders: str = "") -> None:
    """Writes (doc_id, file_name, content) rows to a store, as DocumentFiles does; texts are written as UTF-8.

    Tasks write, name and move the files, so that the driver sees none of them: all are written to a folder beside before the
    first is moved. The files of a document are named by one task, which has their names and hashes.
    """
    path, plain, endings = path.rstrip("/"), folders == "plain", _ending(clear)
    files, root = _opened(path)
    staging = f"{root}/_staging-{uuid.uuid4().hex}"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(path)
        attempt, n = f"{TaskContext.get().taskAttemptId()}", 0
        files.create_dir(f"{staging}/{attempt}", recursive=False)  # fails once the write was given up and its folder is gone
        for batch in batches:
            out = []
            for doc, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                body, place, n = content or b"", f"{attempt}/{n}", n + 1
                with files.open_output_stream(f"{staging}/{place}", compression=None) as f:
                    f.write(body)
                out.append((_folder(doc, plain), doc, safe_name(name or ""), hashlib.sha256(body).hexdigest(), place))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)] or [pa.array([], pa.string())] * 5, ["folder", "doc_id", "name", "sha256", "place"])

    def named(key, staged):
        files, root = _opened(path)
        taken, tried, finals = _cleared(files, f"{root}/{key[0]}", overwrite, endings), {}, []
        order = sorted(range(len(staged)), key=[(d is not None, d or "", n, h) for d, n, h in zip(staged["doc_id"], staged["name"], staged["sha256"])].__getitem__)
        staged = staged.iloc[order]
        for name in staged["name"]:
            finals.append(free_name(name, taken, tried))
            taken.add(finals[-1])
        return pd.DataFrame({"place": staged["place"], "target": [f"{key[0]}/{x}" for x in finals]})

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(path)
        for batch in batches:
            for place, target in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    files.move(f"{staging}/{place}", f"{root}/{target}")
                except FileNotFoundError:  # a task that was tried before may have moved it
                    if files.get_file_info(f"{root}/{target}").type != fs.FileType.File:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.create_dir(staging, recursive=True)
    try:
        rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "file_name", F.col("content").cast("binary").alias("content"))
        staged = stored(_dealt(rows).mapInArrow(written, "folder string, doc_id string, name string, sha256 string, place string"))
        names = stored(staged.groupBy("folder").applyInPandas(named, "place string, target string"))
        _dealt(names).mapInArrow(moved, "n long").agg(F.sum("n")).collect()
    finally:
        _removed(files, staging)


def listed(spark, path: str, inside: Callable[[str], bool] | None = None) -> DataFrame:
    """(path): the files in the folders below a path, found by tasks; the driver sees the folders at its top.

    With `inside` all files below the folders of such names; without it files that stand in the path itself come too, and hidden
    names (of a leading _ or .) are left out, as Spark's file sources do.
    """
    files, root = _opened(path.rstrip("/"))
    top = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    units = [(x.base_name,) for x in top if x.type == fs.FileType.Directory and (inside is None or inside(x.base_name))]
    units += [(None,)] if inside is None and any(x.type == fs.FileType.File for x in top) else []

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(path.rstrip("/"))
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                within = root if unit is None else f"{root}/{unit}"
                names = [x.path for x in files.get_file_info(fs.FileSelector(within, recursive=unit is not None)) if x.type == fs.FileType.File]
                shown = names if inside is not None else [x for x in names if not any(part[:1] in ("_", ".") for part in x[len(root) + 1 :].split("/"))]
                for first in range(0, len(shown), 10000):
                    yield pa.RecordBatch.from_arrays([pa.array(shown[first : first + 10000], pa.string())], ["path"])

    return _dealt(spark.createDataFrame(units, "folder string")).mapInArrow(found, "path string")


def contents(paths: DataFrame, store: str) -> DataFrame:
    """(path, content) of the files at (path), read by tasks in batches of bounded bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(store)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary()))], ["path", "content"])
        for batch in batches:
            rows, size = [], 0
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as f:
                    rows.append((path, f.read()))
                size += len(rows[-1][1])
                if size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    return _dealt(paths.select("path")).mapInArrow(read, "path string, content binary")


def load(spark, path: str) -> DataFrame:
    """(doc_id, file_name, content) of a store; tasks list the folders and read the files."""
    doc = F.element_at(F.split("path", "/"), -2)
    unquoted = F.udf(lambda x: unquote(x.removeprefix("doc=.")) if x.startswith("doc=.") else None, "string")
    found = contents(listed(spark, path, lambda x: x.startswith("doc=")), path)
    return found.select(unquoted(doc).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


#: Maps of a parsed document: file, column and the field that names an entry.
MAPS = (("table_map.json", "tables", "table_id"), ("cell_map.json", "cells", "cell_id"), ("asset_map.json", "assets", "asset_id"))


def maps(parsed: DataFrame) -> DataFrame:
    """(doc_id, file_name, content): JSON maps of the tables, cells and assets (without their bytes) of parsed files, by id, indented by 2.

    A document is one row, whose maps are made at a time; letters stay as they are. A file that could not be read has no maps.
    """

    def written(docs: pa.Array, *columns: pa.Array) -> pa.Array:
        out = []
        for values in zip(*(c.to_pylist() for c in columns)):
            row = []
            for (file, _, key), entries in zip(MAPS, values):
                by_id = {e.pop(key): {k: v for k, v in e.items() if k != "content"} for e in entries or ()}
                row.append({"file_name": file, "content": json.dumps(by_id, ensure_ascii=False, indent=2)})
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("file_name", pa.string()), ("content", pa.string())])))

    made = F.arrow_udf(written, "array<struct<file_name: string, content: string>>")("doc_id", *(c for _, c, _ in MAPS))
    return parsed.where("error is null").select("doc_id", F.inline(made))
