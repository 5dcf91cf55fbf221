"""Text chunks, JSON, logs, manifests and vector tables as DataFrames, and the writers of the same."""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: The two layouts of a vector table, by the columns that tell them.
SCHEMAS = {"document": ("document_id", "document_name", "chunk_id", "file_name", "section_id", "chunk_type", "hierarchy_path", "text"), "source": ("source", "chunk_file", "section_id", "chunk_type", "hierarchy_path", "document")}


def _names(path: Column) -> tuple[Column, Column]:
    parts = F.split(path, "/")
    return F.element_at(parts, -2), F.element_at(parts, -1)


def missing(requested: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Requested ids that were not found; a caller that needs all raises if there are any."""
    return requested.select(key).distinct().join(found.select(key), key, "left_anti")


def resolve_path(base: Column, target: Column) -> Column:
    """A relative path seen from a folder, with `.` and `..` folded, by a fold over its parts."""
    parts = F.filter(F.split(F.concat_ws("/", base, target), "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def content_types(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """(part, content_type): a part's own type, else that of its suffix in lower case."""
    p = parts.withColumn("extension", F.lower(F.regexp_extract("part", r"\.([^./]+)$", 1)))
    own = overrides.select(F.regexp_replace("part", "^/+", "").alias("part"), F.col("content_type").alias("own"))
    by = defaults.select(F.lower("extension").alias("extension"), F.col("content_type").alias("by"))
    return p.join(own, "part", "left").join(F.broadcast(by), "extension", "left").select("part", F.coalesce("own", "by").alias("content_type"))


def text_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, file_name, chunk_index, content): the chunk files of each document in string order, nested ones left out.

    Tasks list the folders below root and read the files. Where only Spark reads root, it lists them on the driver.
    """
    doc, name = _names(F.col("path"))
    wanted = name.endswith(".txt") & ~F.contains(name, F.lit("_nested_"))
    try:
        t = store.contents(store.listed(spark, root).where(wanted), root)
    except pa.ArrowInvalid:
        t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root).where(wanted)
    t = t.select(doc.alias("doc_id"), name.alias("file_name"), F.decode("content", "UTF-8").alias("content"))
    return t.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("file_name")) - 1)


def json_objects(spark: SparkSession, root: str) -> DataFrame:
    """(path, value): one VARIANT for each JSON file; a file that is not an object fails the query that reads it."""
    t = spark.read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("value"))
    good = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    return t.where(F.assert_true(good, F.concat(F.lit("not a JSON object: "), F.col("path"))).isNull())


def manifest_texts(manifest: DataFrame, texts: DataFrame, doc: str = "doc_id", name: str = "file_name") -> DataFrame:
    """The manifest's rows with their texts: a missing file is an error, an empty text is left out."""
    j = manifest.join(texts.select(doc, name, "content"), [doc, name], "left")
    # One condition: two would let the optimizer turn the join into an inner one and lose the missing files.
    return j.where(F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("missing file: "), F.col(name))).cast("boolean")).otherwise(F.trim("content") != ""))


def detect_schema(columns: list[str]) -> str:
    """Which of the two layouts a vector table has; ValueError if neither."""
    for name, fields in SCHEMAS.items():
        if set(fields[:2]) <= set(columns):
            return name
    raise ValueError(f"no known layout: {sorted(columns)}")


def known_fields(df: DataFrame) -> DataFrame:
    """The columns of a vector table's layout that it has."""
    return df.select(*(c for c in SCHEMAS[detect_schema(df.columns)] if c in df.columns))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by document; the partitions of the documents written are replaced, others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, non-ASCII letters as they are."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def zip_chunks(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, archive): each document's chunk files as a ZIP; a document is one group, as its archive is one file."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(zip(rows["file_name"], rows["content"])):
                z.writestr(zipfile.ZipInfo(name), text)
        return pd.DataFrame({doc: [key[0]], "archive": [out.getvalue()]})

    kind = chunks.schema[doc].dataType.simpleString()
    return chunks.select(doc, "file_name", "content").groupBy(doc).applyInPandas(pack, f"{doc} {kind}, archive binary")


def write_assets(assets: DataFrame, root: str) -> DataFrame:
    """Writes assets below root/doc_id on a file system that all workers share; (doc_id, stored_name, path)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for f in frames:
            paths = []
            for doc, name, content in zip(f["doc_id"], f["stored_name"], f["content"]):
                folder = posixpath.join(root, re.sub(r"[^\w.-]+", "_", str(doc)))
                os.makedirs(folder, exist_ok=True)
                paths.append(posixpath.join(folder, posixpath.basename(name)))
                with open(paths[-1], "wb") as out:
                    out.write(content)
            yield pd.DataFrame({"doc_id": f["doc_id"], "stored_name": f["stored_name"], "path": paths})

    return assets.select("doc_id", "stored_name", "content").mapInPandas(run, "doc_id string, stored_name string, path string")


def inside(root: str, path: str) -> str:
    """The real path of `path` below root; ValueError if it leads out of it."""
    top, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath((top, full)) != top:
        raise ValueError(f"{path} is not below {root}")
    return full
