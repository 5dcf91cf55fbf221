"""Word files to retrieval chunks, offline: chunks, labels, spans, headings, section JSON, export.

Each step is an operator of docloom.operators; this module only joins them. A model client labels chunks; headings and
section JSON come from the deterministic rules, as they do where a model's answer does not hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import classify, export, headers, models, sections, spans
from .schema import OTHER, SECTIONS, UNPROCESSED, header_dim
from .sources import ooxml

SPAN = ["doc_id", "section", "span_index"]


def labelled(parsed: DataFrame, client: models.ModelClient, attempts: int = 6) -> DataFrame:
    """(doc_id, idx, file_name, content, table_id, skipped, labels): chunks but nested tables, in order of their names."""
    c = ooxml.part(parsed, "chunks").where("chunk_type <> 'nested_table'")
    c = c.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("file_name")).cast("long")).withColumn("skipped", classify.is_empty(F.col("content")))
    found = models.label_documents(c, client, attempts, order="idx").select("doc_id", "idx", "labels")
    return c.join(found, ["doc_id", "idx"]).select("doc_id", "idx", "file_name", "content", "table_id", "skipped", "labels")


def span_rows(rows: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table rows of each span for extraction, numbered through (SPAN, row, n_cells, is_title, cells), and all its chunks."""
    members = spans.spans(rows, "doc_id", "idx", "labels").where(~F.col("section").isin(*UNPROCESSED))
    # Spans of a section are one, but for other text, where each row stands alone.
    members = members.withColumn("span_index", F.when(F.col("section") == OTHER, F.col("span_index")).otherwise(F.lit(1)))
    m = members.join(rows.select("doc_id", "idx", "table_id", "content"), ["doc_id", "idx"])
    tables = ooxml.part(parsed, "tables").select("doc_id", "table_id", "column_count")
    cells = ooxml.part(parsed, "cells").join(tables, ["doc_id", "table_id"])
    r = spans.table_rows(cells, ["doc_id", "table_id"], "column_count")
    j = m.where("table_id is not null").join(r, ["doc_id", "table_id"])
    number = F.row_number().over(Window.partitionBy(*SPAN).orderBy("idx", "row"))
    return j.withColumn("row", number).select(*SPAN, "row", "n_cells", "is_title", "cells"), m


def inspected(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table rows of spans with section_id, and the headings found for each span: known orders first, then the rows themselves."""
    keyed = table.withColumn("section_id", F.col("section"))
    orders = header_dim(table.sparkSession)
    logical = spans.logical_columns(table, SPAN).withColumn("section_id", F.col("section"))
    seen = headers.visible_header(table.join(logical.select(*SPAN, "logical_columns"), SPAN), SPAN, "logical_columns")
    best = headers.best_match(headers.match_scores(keyed, orders, SPAN), SPAN)
    return keyed, headers.resolve(logical, best, seen, keyed, orders, SPAN)


def section_results(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, sec_no, section_id, section_english, status, section_json) of all spans, by rules."""
    table, members = span_rows(rows, parsed)
    _, found = inspected(table)
    ids = table.join(found.select(*SPAN, F.col("header_row").alias("row")), [*SPAN, "row"]).select(*SPAN, F.transform("cells", lambda c: c["cell_id"]).alias("header_ids"))
    t = table.join(found.select(*SPAN, F.col("valid_column_order").alias("columns")), SPAN).join(ids, SPAN, "left")
    t = t.withColumn("header_ids", F.coalesce("header_ids", F.array().cast("array<string>")))
    workflow = F.col("section").isin("SEC12", "SEC13")
    by_table = sections.entries_json(sections.table_entries(t, SPAN, workflow), SPAN, workflow)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.trim("content").alias("t")))), lambda x: x["t"])
    spans_ = members.groupBy(*SPAN).agg(F.min("idx").alias("first"), F.array_join(texts, "\n\n").alias("content"))
    by_text = F.to_json(F.struct(F.col("section").alias("section_id"), "content"))
    j = spans_.join(by_table, SPAN, "left").withColumn("section_json", F.coalesce("section_json", by_text))
    english = F.create_map(*(F.lit(x) for s, _, e in SECTIONS for x in (s, e)))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "section", "span_index"))
    return j.select("doc_id", number.alias("sec_no"), F.col("section").alias("section_id"), F.element_at(english, F.col("section")).alias("section_english"), F.lit("resolved").alias("status"), "section_json")


def run(parsed: DataFrame, client: models.ModelClient) -> dict[str, DataFrame]:
    """The tables of all steps for parsed files (ooxml.parse), best written or cached before, as every step reads them."""
    rows = labelled(parsed, client)
    results = section_results(rows, parsed)
    cells, tables = ooxml.part(parsed, "cells"), ooxml.part(parsed, "tables")
    text = F.coalesce(F.nullif("text", F.lit("")), F.col("display_text"))
    nodes = cells.select("doc_id", F.col("cell_id").alias("id"), text.alias("text")).unionByName(tables.select("doc_id", F.col("table_id").alias("id"), F.col("rendered_table").alias("text")))
    names = parsed.select("doc_id", F.col("doc_id").alias("document_name"))
    return {"labels": rows, "sections": results, "chunks": export.export(results, names, nodes)}
