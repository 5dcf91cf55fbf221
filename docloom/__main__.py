"""Commands over folders and tables, each reading what the one before wrote.

    python -m docloom parse FOLDER PARSED       Word files to parsed documents
    python -m docloom chunks FOLDER CHUNKS      Word files to chunks, by document
    python -m docloom maps PARSED STORE         JSON maps of tables, cells and assets, a folder for each document
    python -m docloom labels CHUNKS LABELS      chunks with section labels
    python -m docloom cues CHUNKS LABELS        the same by cues alone, with the evidence
    python -m docloom headers PARSED HEADINGS   headings of the tables of each span
    python -m docloom sections PARSED SECTIONS  section JSON of each span
    python -m docloom export PARSED CHUNKS      retrieval chunks
    python -m docloom split CHUNKS PARTS        chunks cut into balanced parts

Models are those of DOCLOOM_BASE_URL, DOCLOOM_MODEL, DOCLOOM_API_KEY and DOCLOOM_ATTEMPTS; without an address the rules label.
"""

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline
from .operators import classify, cues, models, rag
from .sources import files, ooxml, store


def client(settings: models.Settings) -> models.ModelClient:
    """The client that the settings name; rules without an address."""
    return models.connect(settings.base_url, settings.model, settings.api_key) if settings.base_url else models.RuleModel(classify.CUES)


def run(command: str, source: DataFrame, settings: models.Settings, unwrap: bool = False) -> DataFrame:
    """The table that a command writes, of the Word files (doc_id, content) or the table that it reads."""
    if command == "parse":
        return ooxml.parse(source, unwrap)
    if command == "chunks":
        return ooxml.part(ooxml.parse(source, unwrap), "chunks")
    if command == "maps":
        return store.maps(source)
    if command == "labels":
        chunks = source.withColumn("skipped", classify.is_empty(F.col("content")))
        return models.label_documents(chunks, client(settings), settings.attempts)
    if command == "cues":
        return cues.label_by_cues(source, ["doc_id", "chunk_index"], "content")
    if command == "split":
        chunks = source.withColumn("segments", rag.segments(F.col("content"))).withColumn("key", F.struct("doc_id", "chunk_index"))
        return rag.split(chunks, "key", "segments").select("key.*", "part_num", "n_words", "text")
    if command == "export":
        return pipeline.run(source, client(settings))["chunks"]
    rows = pipeline.labelled(source, client(settings), settings.attempts)
    if command == "headers":
        return pipeline.inspected(pipeline.span_rows(rows, source)[0])[1]
    return pipeline.section_results(rows, source)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="docloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("parse", "chunks", "maps", "labels", "cues", "headers", "sections", "export", "split"))
    p.add_argument("source", help="a folder of Word files, or a table written by the step before")
    p.add_argument("target", help="the folder of the table to write")
    p.add_argument("--unwrap", action="store_true", help="documents wrapped in one outer table cell")
    p.add_argument("--newest", action="store_true", help="the newest Word file of a folder, not the first by name")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    source = ooxml.files(spark, a.source, a.newest) if a.command in ("parse", "chunks") else spark.read.parquet(a.source)
    out = run(a.command, source, models.Settings.from_env(), a.unwrap)
    if a.command == "chunks":
        files.write_chunks(out, a.target)
    elif a.command == "maps":
        store.save(out, a.target, overwrite=True, clear=".json", folders="plain")
    else:
        out.write.mode("overwrite").parquet(a.target)


if __name__ == "__main__":
    main()
