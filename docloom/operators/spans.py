"""Runs of labelled chunks: spans of a section, their components, merged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OTHER, SECTION_IDS
from .windows import islands, ordered, running


def chunk_records(classified: DataFrame, tables: DataFrame, texts: DataFrame, doc: str = "doc_id", name: str = "file_name") -> DataFrame:
    """Classified chunks with their table (by chunk file name), kind, and content: the file's, else the drawn table."""
    t = tables.select(doc, F.col("chunk_file_name").alias(name), "table_id", "rendered_table")
    j = classified.join(t, [doc, name], "left").join(texts.select(doc, name, F.col("content").alias("file_content")), [doc, name], "left")
    kind = F.when(F.col("table_id").isNotNull(), "table").when(F.col(name).endswith("_text.txt"), "text").otherwise("unknown")
    return j.withColumn("kind", kind).withColumn("content", F.coalesce("file_content", "rendered_table", F.lit(""))).drop("file_content", "rendered_table")


def spans(rows: DataFrame, doc: str, order: str, labels: str) -> DataFrame:
    """(doc, section, order, span_index): maximal runs of consecutive rows that carry a section's label.

    Order must count all rows of a document without gaps, so that a row without the label, a skipped one too, breaks
    a run. Every row of the label of other text is a span of its own.
    """
    each = rows.select(doc, order, F.explode(F.array_distinct(labels)).alias("section"))
    run = islands(each, [doc, "section"], order, "run")
    run = run.withColumn("run", F.when(F.col("section") == OTHER, F.col(order)).otherwise(F.col("run")))
    index = F.dense_rank().over(ordered([doc, "section"], ["run"]))
    return run.select(doc, "section", order, index.cast("long").alias("span_index"))


def span_table(members: DataFrame, doc: str, order: str) -> DataFrame:
    """One row per span: first and last row and their number."""
    return members.groupBy(doc, "section", "span_index").agg(F.min(order).alias("first_row"), F.max(order).alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


def merge_nonadjacent(members: DataFrame, doc: str, order: str) -> DataFrame:
    """Spans for extraction: those of one section are one, but for other text; equal sets of rows count once."""
    merged = members.withColumn("span_index", F.when(F.col("section") == OTHER, F.col("span_index")).otherwise(F.lit(1)))
    rows = F.array_join(F.transform(F.array_sort(F.collect_set(order)), lambda x: x.cast("string")), ",")
    out = merged.groupBy(doc, "section", "span_index").agg(rows.alias("members"), F.min(order).alias("first_row"))
    return out.dropDuplicates([doc, "section", "members"])


def extraction_order(spans_: DataFrame, labels: DataFrame, doc: str, order: str) -> DataFrame:
    """Adds span_order: by first row, place of the section in that row's labels, span."""
    l = labels.select(doc, F.col(order).alias("first_row"), F.col("labels").alias("__labels"))
    j = spans_.join(l, [doc, "first_row"], "left")
    catalog = F.array_position(F.array(*map(F.lit, SECTION_IDS)), F.col("section"))
    place = F.coalesce(F.nullif(F.array_position("__labels", F.col("section")), F.lit(0)), catalog)
    w = Window.partitionBy(doc).orderBy("first_row", place, "section", "span_index")
    return j.withColumn("span_order", F.row_number().over(w)).drop("__labels")


def components(rows: DataFrame, group: list[str], order: str, is_table: Column, together: Column | None = None) -> DataFrame:
    """Numbers the components of each group: consecutive tables are one (if together), other rows stand alone."""
    w = ordered(group, [order])
    flagged = rows.withColumn("__table", is_table)
    first = ~F.col("__table") | ~F.coalesce(F.lag("__table").over(w), F.lit(False))
    if together is not None:
        first = first | ~together
    return flagged.withColumn("component", running(first, w)).withColumn("component_kind", F.when(F.col("__table"), "table_group").otherwise("text")).drop("__table")


def table_rows(cells: DataFrame, table: list[str], columns: str) -> DataFrame:
    """(table, row, n_cells, is_title, cells): the cells of a row from left to right; one cell over all columns is a title."""
    c = F.array_sort(F.collect_list(F.struct("col", "cell_id", "colspan", "text", "display_text")))
    g = cells.groupBy(*table, "row").agg(c.alias("cells"), F.max(columns).alias("n_columns"))
    title = (F.size("cells") == 1) & (F.element_at("cells", 1)["colspan"] >= F.col("n_columns"))
    return g.select(*table, "row", F.size("cells").alias("n_cells"), title.alias("is_title"), "cells")


def logical_columns(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, logical_columns): the most cells of a row that is no title; 1 if all are."""
    return rows.groupBy(*group).agg(F.coalesce(F.max(F.when(~F.col("is_title"), F.col("n_cells"))), F.lit(1)).alias("logical_columns"))


def merged_table(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows of a group's tables numbered on, their cells in columns from 1; titles span the whole width."""
    w = Window.partitionBy(*group)
    width = F.max(F.when(~F.col("is_title"), F.col("n_cells"))).over(w)
    number = F.row_number().over(w.orderBy(*order))
    numbered = rows.withColumn("new_row", number).withColumn("width", F.coalesce(width, F.lit(1)))
    return numbered.select(*group, "new_row", "width", "is_title", F.posexplode("cells").alias("p", "cell")).select(
        *group, "new_row", (F.col("p") + 1).alias("new_col"), F.when(F.col("is_title"), F.col("width")).otherwise(F.lit(1)).alias("new_span"), "cell.cell_id", "cell.text"
    )


def span_name(section: Column, index: Column, first: Column, last: Column) -> Column:
    return F.concat(section, F.lit("_span_"), F.lpad(index.cast("string"), 2, "0"), F.lit("_"), first, F.lit("__"), last)


def co_sections(members: DataFrame, rows: DataFrame, doc: str, order: str, labels: str) -> DataFrame:
    """(doc, section, span_index, others): the other labels that occur in a span."""
    j = members.join(rows.select(doc, order, labels), [doc, order])
    g = j.groupBy(doc, "section", "span_index").agg(F.array_distinct(F.flatten(F.collect_set(labels))).alias("all"))
    return g.select(doc, "section", "span_index", F.array_sort(F.array_except("all", F.array("section"))).alias("others"))


def inspection_order(spans: DataFrame, doc: str) -> DataFrame:
    """Adds inspection_order: spans of a document by their first row, section and number."""
    return spans.withColumn("inspection_order", F.row_number().over(ordered([doc], ["first_row", "section", "span_index"])))


def component_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, component, component_kind) with the files of each, and the tables, rows and columns of table groups or the characters of texts.

    rows has component, component_kind, file_name, chunk_index, table_id, n_rows, logical_columns and content.
    """
    is_table = F.col("component_kind") == "table_group"
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", x))), lambda s: s[x])
    s = rows.groupBy(*group, "component", "component_kind").agg(
        listed("file_name").alias("files"), F.array_compact(listed("table_id")).alias("table_ids"), F.sum("n_rows").alias("n_rows"), F.max("logical_columns").alias("logical_columns"), F.sum(F.length("content")).alias("n_chars"),
    )
    only = lambda c, x: F.when(c, F.col(x)).alias(x)
    return s.select(*group, "component", "component_kind", "files", "table_ids", *(only(is_table, x) for x in ("n_rows", "logical_columns")), only(~is_table, "n_chars"), (is_table & (F.size("table_ids") > 1)).alias("merged"))


def component_text(parts: Column) -> Column:
    """The texts of a component's chunks that are not blank, without white space at their ends, a blank line between them and a line end; empty without any."""
    full = F.filter(F.transform(parts, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+\z", "")), lambda x: x != "")
    return F.when(F.size(full) > 0, F.concat(F.array_join(full, "\n\n"), F.lit("\n"))).otherwise("")
