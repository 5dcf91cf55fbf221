"""Chunk assembly, list numbering and assets of documents in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REFERENCE, strip_markup
from .windows import ordered, running, upto


def assemble(blocks: DataFrame, doc: str = "doc_id", order: str = "pos", is_table: str = "is_table", text: str = "text") -> DataFrame:
    """(doc, chunk_index, chunk_type, n_blocks, content): runs of paragraphs are one text chunk, each table is a chunk.

    Paragraphs are joined by a blank line. Blocks of blank text that are not tables do not count.
    """
    w = ordered([doc], [order])
    kept = blocks.where(F.col(is_table) | (F.trim(text) != ""))
    first = F.col(is_table) | F.coalesce(F.lag(is_table).over(w), F.lit(True))
    numbered = kept.withColumn("chunk_index", running(first, w) - 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.regexp_replace(text, r"(?U)\s+$", "").alias("t")))), lambda x: x["t"])
    kind = F.when(F.max(is_table), "table").otherwise("text")
    return numbered.groupBy(doc, "chunk_index").agg(kind.alias("chunk_type"), F.count(F.lit(1)).alias("n_blocks"), F.array_join(parts, "\n\n").alias("content"))


def chunk_name(index: Column, kind: Column) -> Column:
    return F.concat(F.lpad(index.cast("string"), 4, "0"), F.lit("_"), kind, F.lit(".txt"))


def list_values(items: DataFrame, doc: str, order: str, level: str, levels: int, start: int = 1) -> DataFrame:
    """Adds v0, v1, ...: the number that a label shows for each level of its list.

    An item counts its level up and clears deeper ones. The number of level k at an item of level l is `start` for
    k > l, else start - 1 + the items of level k since the last item of a smaller level (the item itself included),
    and `start` if there is none. So one running count per level, partitioned by a running count of resets.
    """
    w = ordered([doc], [order])
    out = items
    for k in range(levels):
        out = out.withColumn(f"__r{k}", running(F.col(level) < k, w))
        inner = upto(ordered([doc, f"__r{k}"], [order]))
        n = F.sum(F.when(F.col(level) == k, 1).otherwise(0)).over(inner)
        out = out.withColumn(f"v{k}", F.when(F.col(level) < k, F.lit(start)).otherwise(F.greatest(n + (start - 1), F.lit(start))))
    return out.drop(*(f"__r{k}" for k in range(levels)))


def first_seen_ids(rows: DataFrame, doc: str, order: str, source: str, prefix: str = "EM") -> DataFrame:
    """(doc, source, first position, asset id): one id per source part, numbered by first appearance."""
    first = rows.groupBy(doc, source).agg(F.min(order).alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("first_pos", source))
    return first.withColumn("asset_id", F.concat(F.lit(prefix), F.lpad(rank.cast("string"), 6, "0")))


def row_labels(cells: DataFrame, table: list[str], row: str, col: str, text: str, asset: str) -> DataFrame:
    """(table, asset, label): the text of the first other cell with text in an asset's row; the first row that has one wins."""
    a = cells.where(F.col(asset).isNotNull()).select(*table, F.col(row).alias("r"), F.col(col).alias("c"), F.col(asset).alias("asset"))
    b = cells.where(F.col(text) != "").select(*table, F.col(row).alias("r"), F.col(col).alias("c2"), F.col(text).alias("label"))
    joined = a.join(b, [*table, "r"]).where("c <> c2")
    return joined.groupBy(*table, "asset").agg(F.min_by("label", F.struct("r", "c", "c2")).alias("label"))


def text_labels(cells: DataFrame, table: list[str], row: str, col: str, text: str) -> DataFrame:
    """(table, asset, label): the last line with text before an asset's mark in its cell, else the first one after it; the first mark with a label wins.

    Other references and markup are no text.
    """
    mark = r"<EM[0-9]{6}>"
    lines = lambda x: F.filter(F.transform(F.split(x, "\n"), lambda line: strip_markup(F.regexp_replace(line, REFERENCE, " "))), lambda line: line != "")
    c = cells.select(*table, row, col, F.split(text, mark, -1).alias("__parts"), F.regexp_extract_all(text, F.lit(mark), F.lit(0)).alias("__marks"))
    c = c.select(*table, row, col, "__parts", F.posexplode("__marks").alias("__i", "__mark"))
    before, after = (lines(F.array_join(F.slice("__parts", *at), " ")) for at in ((F.lit(1), F.col("__i") + 1), (F.col("__i") + 2, F.size("__parts"))))
    label = F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1)))
    found = c.select(*table, row, col, "__i", F.substring("__mark", 2, 8).alias("asset"), label.alias("label")).where("label is not null")
    return found.groupBy(*table, "asset").agg(F.min_by("label", F.struct(row, col, "__i")).alias("label"))


def asset_labels(cells: DataFrame, table: list[str], row: str, col: str, text: str) -> DataFrame:
    """(table, asset, label): by the text around the mark, and for assets without any by the first other cell with text in their row."""
    around = text_labels(cells, table, row, col, text)
    marks = cells.select(*table, row, col, text, F.explode(F.regexp_extract_all(text, F.lit(r"<(EM[0-9]{6})>"), F.lit(1))).alias("__asset"))
    bare = strip_markup(F.regexp_replace(text, REFERENCE, " "))
    plain = cells.select(*table, row, col, bare.alias("__text"), F.lit(None).cast("string").alias("__asset"))
    beside = row_labels(plain.union(marks.select(*table, row, col, F.lit(""), "__asset")), table, row, col, "__text", "__asset")
    return around.union(beside.join(around.select(*table, "asset"), [*table, "asset"], "left_anti"))
