"""Headings of tables: matching rows with known orders, choosing the main table, deciding without a model, checking one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_label, strip_markup

SCAN_ROWS = 8
CANONICAL = 0.9


def similarity(a: Column, b: Column) -> Column:
    """0 if a label is empty, 1 if equal, 0.9 if one holds the other, else null: such pairs need functions.text_udf."""
    x, y = normalize_label(a), normalize_label(b)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9)


def match_scores(rows: DataFrame, orders: DataFrame, table: list[str], similar=similarity) -> DataFrame:
    """(table, row, order_no, score): (least + mean) / 2 of the similarities of a row's cells to an order's labels.

    Only the first SCAN_ROWS rows that are no titles count, and only orders of as many labels as the row has cells:
    an equi-join on section and number of columns with the small table of orders.
    """
    place = F.row_number().over(Window.partitionBy(*table).orderBy("row"))
    r = rows.withColumn("place", place).where((F.col("place") <= SCAN_ROWS) & ~F.col("is_title"))
    o = orders.withColumn("n_cells", F.size("labels"))
    pairs = r.join(F.broadcast(o), ["section_id", "n_cells"])
    cells = pairs.select(*table, "section_id", "row", "order_no", F.explode(F.arrays_zip(F.col("cells.text").alias("text"), F.col("labels").alias("label"))).alias("z"))
    s = cells.withColumn("s", F.coalesce(similar(F.col("z.text"), F.col("z.label")), F.lit(0.0)))
    return s.groupBy(*table, "section_id", "row", "order_no").agg(((F.min("s") + F.avg("s")) / 2).alias("score"))


def best_match(scores: DataFrame, table: list[str]) -> DataFrame:
    """The best row and order of each table, the first of equal ones; tables that match nothing have no row."""
    w = Window.partitionBy(*table).orderBy(F.col("score").desc(), "row", "order_no")
    return scores.where("score > 0").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def primary_table(groups: DataFrame, span: list[str]) -> DataFrame:
    """The main table group of each span: best score, most rows, first; groups without columns do not count."""
    w = Window.partitionBy(*span).orderBy(F.coalesce("score", F.lit(0.0)).desc(), F.col("n_rows").desc(), "position")
    return groups.where("logical_columns >= 1").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def visible(cell_id: Column, display: Column) -> Column:
    return (F.trim(F.coalesce(display, F.lit(""))) != "") & (F.trim(display) != cell_id)


def visible_header(rows: DataFrame, table: list[str], columns: str) -> DataFrame:
    """The first row among the first ones whose cells are as many as the columns, all shown, all with text."""
    place = F.row_number().over(Window.partitionBy(*table).orderBy("row"))
    shown = F.forall("cells", lambda c: visible(c["cell_id"], c["display_text"]) & (strip_markup(c["text"]) != ""))
    r = rows.withColumn("place", place).where((F.col("place") <= SCAN_ROWS) & ~F.col("is_title") & (F.col("n_cells") == F.col(columns)) & shown)
    return r.groupBy(*table).agg(F.min_by(F.struct("row", "cells"), "row").alias("h")).select(
        *table, F.col("h.row").alias("header_row"), F.transform("h.cells", lambda c: strip_markup(c["text"])).alias("labels"), F.col("h.cells.cell_id").alias("cell_ids")
    )


def resolve(tables: DataFrame, best: DataFrame, seen: DataFrame, rows: DataFrame, orders: DataFrame, table: list[str]) -> DataFrame:
    """Header of each table without a model.

    A match of CANONICAL or more decides: visible_valid or hidden_valid, with the order's labels. Else a visible row of
    labels. Else missing, with the first order of the section that has as many columns, or numbered names.
    """
    o = orders.select("section_id", "order_no", F.col("labels").alias("canonical"))
    matched = best.where(F.col("score") >= CANONICAL).join(F.broadcast(o), ["section_id", "order_no"])
    cells = rows.select(*table, "row", F.forall("cells", lambda c: visible(c["cell_id"], c["display_text"])).alias("shown"))
    matched = matched.join(cells, [*table, "row"]).select(*table, F.col("row").alias("m_row"), "canonical", "shown")
    first = o.groupBy(F.col("section_id").alias("s"), F.size("canonical").alias("n")).agg(F.min_by("canonical", "order_no").alias("default"))
    j = tables.join(matched, table, "left").join(seen, table, "left").join(F.broadcast(first), (F.col("section_id") == F.col("s")) & (F.col("logical_columns") == F.col("n")), "left")
    generic = F.transform(F.sequence(F.lit(1), F.col("logical_columns").cast("int")), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    state = F.when(F.col("m_row").isNotNull() & F.col("shown"), "visible_valid").when(F.col("m_row").isNotNull(), "hidden_valid").when(F.col("header_row").isNotNull(), "visible_valid").otherwise("missing")
    return j.select(
        *table, "section_id", state.alias("header_state"), (state != "visible_valid").alias("inspection_required"),
        F.coalesce("canonical", "labels", "default", generic).alias("valid_column_order"), F.coalesce("m_row", "header_row").alias("header_row"),
    )


#: Keys of a resolution.
KEYS = ("status", "inspection_required", "header_state", "valid_column_order", "actual_header_row_exists", "actual_header_row_index", "actual_header_cell_ids", "brief_description")
STATES = ("visible_valid", "visible_invalid", "hidden_valid", "hidden_invalid", "missing")


def validate(payload: Column, known_ids: Column, row_ids: Column) -> Column:
    """What is wrong with a model's resolution, or null. row_ids maps a row's number to all its cell ids in order."""
    v = F.try_parse_json(payload)
    text = F.to_json(v)
    keys = F.array_sort(F.json_object_keys(text))
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    ids, state = get("actual_header_cell_ids", "array<string>"), get("header_state", "string")
    exists, index, order = get("actual_header_row_exists", "boolean"), get("actual_header_row_index", "int"), get("valid_column_order", "array<string>")
    required = get("inspection_required", "boolean")
    return (
        F.when(v.isNull(), "not JSON")
        .when(keys.isNull() | (keys != F.array(*map(F.lit, sorted(KEYS)))), "wrong keys")
        .when(get("status", "string") != "resolved", "wrong status")
        .when(state.isNull() | ~state.isin(*STATES), "wrong state")
        .when(required.isNull() | exists.isNull(), "not boolean")
        .when(order.isNull() | (F.size(order) == 0) | F.exists(order, lambda x: F.trim(x) == ""), "no column order")
        .when(ids.isNull() | (F.size(F.array_distinct(ids)) != F.size(ids)), "repeated cell ids")
        .when(F.size(F.array_except(ids, known_ids)) > 0, "unknown cell ids")
        .when(required != (state != "visible_valid"), "inspection_required against state")
        .when(exists & (index.isNull() | (F.size(ids) == 0)), "no header row")
        .when(~exists & (index.isNotNull() | (F.size(ids) > 0) | (state != "missing")), "header row that should be missing")
        .when(exists & (state == "missing"), "missing against row")
        .when(exists & ~F.coalesce(F.try_element_at(row_ids, index) == ids, F.lit(False)), "not all cells of one row")
        .when(F.trim(F.coalesce(get("brief_description", "string"), F.lit(""))) == "", "no description")
    )


def with_fallback(model: Column, heuristic: Column, error: Column) -> tuple[Column, Column]:
    """The resolution that holds, and who gave it."""
    use = model.isNotNull() & error.isNull()
    return F.when(use, model).otherwise(heuristic), F.when(use, "llm").otherwise("heuristic")


def summary(inspections: DataFrame, doc: str) -> DataFrame:
    """Per document: spans, those without a table (skipped), and how the others were resolved."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    skipped = F.col("status") == "skipped"
    return inspections.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_spans"), n(skipped).alias("n_skipped"), n(~skipped & (F.col("resolved_by") == "llm")).alias("n_llm"), n(~skipped & (F.col("resolved_by") != "llm")).alias("n_fallback"), n(~skipped & F.col("inspection_required")).alias("n_required"),
    )


def with_skipped(spans: DataFrame, resolved: DataFrame, key: list[str]) -> DataFrame:
    """Resolved spans, and those without a table as skipped ones."""
    none = spans.join(resolved.select(*key), key, "left_anti").select(*key).withColumn("status", F.lit("skipped"))
    return resolved.unionByName(none, allowMissingColumns=True)


def row_excerpt(rows: DataFrame, table: list[str], n: int = SCAN_ROWS) -> DataFrame:
    """(table, excerpt): the first n rows of each table with their cells, as JSON for a prompt."""
    row = F.struct(F.col("row").alias("row_index"), F.col("is_title").alias("is_full_width_title"), "cells")
    return rows.groupBy(*table).agg(F.to_json(F.slice(F.array_sort(F.collect_list(row)), 1, n)).alias("excerpt"))
