"""Tables as long tables of grid positions: occupancy, trimming, display and widths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canvas
from ..functions.text import INVISIBLE, MARKUP
from .windows import before, ordered, upto


def occupancy(cells: DataFrame, table: str, row: str, pos: str, span: str, continues: str) -> DataFrame:
    """(table, r, c, anchor): the cell that each grid position shows; null where a row is too short.

    Cells are laid from the left by their spans. A cell that continues shows the cell above it in its first column,
    or is an anchor of its own if there is none. Columns are counted from 0; the grid is as wide as its widest row.
    """
    w = before(ordered([table, row], [pos]))
    placed = cells.withColumn("start", F.coalesce(F.sum(span).over(w), F.lit(0)))
    width = F.max(F.col("start") + F.col(span)).over(Window.partitionBy(table))
    placed = placed.withColumn("width", width)
    spread = placed.select(table, F.col(row).alias("r"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col(span) - 1)).alias("c"), F.col(pos).alias("own"), F.col(continues).alias("continues"))
    grid = placed.groupBy(table, F.col(row).alias("r")).agg(F.max("width").alias("width"))
    grid = grid.select(table, "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    full = grid.join(spread, [table, "r", "c"], "left")
    down = upto(ordered([table, "c"], ["r"]))
    # A run of continuing positions shows what stands on top of it; a hole ends the run.
    top = F.max(F.when(~F.coalesce(F.col("continues"), F.lit(False)), F.col("r"))).over(down)
    full = full.withColumn("top", top)
    above = F.first(F.when(~F.col("continues"), F.col("own")), ignorenulls=True).over(Window.partitionBy(table, "c", "top"))
    alone = F.first(F.when(F.col("continues"), F.col("own")), ignorenulls=True).over(Window.partitionBy(table, "c", "top").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return full.select(table, "r", "c", F.when(F.col("continues"), F.coalesce(above, alone)).otherwise(F.col("own")).alias("anchor"))


def meaningful(text: Column) -> Column:
    """Whether a cell has text besides markup, white space and invisible characters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MARKUP, ""), INVISIBLE, ""), r"(?U)\s+", "") != ""


def trim(cells: DataFrame, table: str, row: str, col: str, text: str) -> DataFrame:
    """Cells without the rows and columns that are blank throughout; rows and columns are numbered anew from 0."""
    flag = F.when(meaningful(F.col(text)), 1).otherwise(0)
    kept = cells.withColumn("__r", F.max(flag).over(Window.partitionBy(table, row))).withColumn("__c", F.max(flag).over(Window.partitionBy(table, col))).where("__r = 1 and __c = 1")
    w = lambda x: F.dense_rank().over(ordered([table], [x])) - 1
    return kept.withColumn("new_row", w(row)).withColumn("new_col", w(col)).drop("__r", "__c")


def display(cells: DataFrame, table: list[str], cell_id: str, text: str, color: str) -> DataFrame:
    """Adds display_text: in a table with fills, cells without one show their id, filled ones their text and fill."""
    filled = F.max(F.when(F.col(color).isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*table)) == 1
    token = F.concat(F.lit("["), F.col(color), F.lit("]"))
    shown = (
        F.when(~meaningful(F.col(text)), "")
        .when(F.col(color).isNotNull(), F.concat_ws(" ", F.col(text), token))
        .when(filled, F.col(cell_id))
        .otherwise(F.col(text))
    )
    return cells.withColumn("display_text", shown)


def widths(cells: DataFrame, table: str, col: str, text: str) -> DataFrame:
    """(table, col, width): the longest line of a column without spans, at least 1."""
    longest = F.array_max(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), F.length))
    return cells.groupBy(table, col).agg(F.greatest(F.max(longest), F.lit(1)).alias("width"))


def render(cells: DataFrame, table: str, row: str, col: str, text: str) -> DataFrame:
    """(table, rendered): a table without spans drawn with ASCII lines, every row of one line; missing cells are blank."""
    w = widths(cells, table, col, text)
    rows = cells.select(table, row).distinct()
    grid = rows.join(w, table).join(cells.select(table, row, col, F.col(text).alias("__text")), [table, row, col], "left")
    cell = F.concat(F.lit(" "), F.rpad(F.coalesce("__text", F.lit("")), F.col("width"), " "), F.lit(" |"))
    ordered_ = lambda order, x: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), x.alias("x")))), lambda s: s["x"])
    lines = grid.groupBy(table, row).agg(F.concat(F.lit("|"), F.array_join(ordered_(col, cell), "")).alias("line"))
    border = w.groupBy(table).agg(F.concat(F.lit("+"), F.array_join(ordered_(col, F.concat(F.repeat(F.lit("-"), F.col("width") + 2), F.lit("+"))), "")).alias("border"))
    body = lines.groupBy(table).agg(ordered_(row, F.col("line")).alias("lines"))
    drawn = F.concat_ws("\n", "border", F.array_join(F.transform("lines", lambda x: F.concat_ws("\n", x, F.col("border"))), "\n"))
    return body.join(border, table).select(table, drawn.alias("rendered"))


def spanned_widths(cells: Column, n: Column) -> Column:
    """Widths of n columns of a table: array<struct<row, col, colspan, text>> in order, col from 1.

    Each cell with text in turn spreads what it lacks over its columns, the leftmost getting the rest.
    """

    def step(widths: Column, c: Column) -> Column:
        first, span = c["col"] - 1, F.greatest(c["colspan"], F.lit(1))
        have = F.aggregate(F.slice(widths, c["col"], span), F.lit(0), lambda a, b: a + b) + 3 * (span - 1)
        need = F.array_max(F.transform(F.split(c["text"], "\n"), lambda x: F.length(x)))
        lack = F.when(c["text"] == "", 0).otherwise(F.greatest(need - have, F.lit(0)))
        extra = lambda j: F.when((j >= first) & (j < first + span), F.floor(lack / span) + F.when(j - first < lack % span, 1).otherwise(0)).otherwise(0)
        return F.transform(widths, lambda w, j: (w + extra(j)).cast("int"))

    return F.aggregate(cells, F.array_repeat(F.lit(1), n.cast("int")), step)


def virtual(cells: DataFrame, table: list[str], row: str, col: str, colspan: str, text: str, columns: str) -> DataFrame:
    """(table, rendered): rows of several tables drawn as one, with the same line between all rows; cells may span columns and have several lines.

    A table is one group, as its widths depend on all its cells.
    """
    c = F.struct(F.col(row).cast("int").alias("row"), F.col(col).cast("int").alias("col"), F.col(colspan).cast("int").alias("colspan"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = cells.groupBy(*table).agg(F.array_sort(F.collect_list(c)).alias("cells"), F.max(columns).alias("n"))
    t = t.withColumn("widths", spanned_widths(F.col("cells"), F.col("n")))
    border = F.concat(F.lit("+"), F.array_join(F.transform("widths", lambda w: F.repeat(F.lit("-"), w + 2)), "+"), F.lit("+"))

    def line(row_cells: Column, k: Column) -> Column:
        def segment(x: Column) -> Column:
            span = F.greatest(x["colspan"], F.lit(1))
            inner = F.aggregate(F.slice("widths", x["col"], span), F.lit(0), lambda a, b: a + b) + 3 * (span - 1)
            own = F.coalesce(F.get(F.split(x["text"], "\n"), k), F.lit(""))
            return F.concat(F.lit(" "), own, F.repeat(F.lit(" "), F.greatest(inner - F.length(own), F.lit(0))), F.lit(" |"))

        return F.concat(F.lit("|"), F.array_join(F.transform(row_cells, segment), ""))

    def drawn(r: Column) -> Column:
        mine = F.filter("cells", lambda x: x["row"] == r)
        height = F.array_max(F.transform(mine, lambda x: F.size(F.split(x["text"], "\n"))))
        return F.array_join(F.transform(F.sequence(F.lit(0), height - 1), lambda k: line(mine, k)), "\n")

    rows = F.array_distinct(F.transform("cells", lambda x: x["row"]))
    t = t.withColumn("border", border).withColumn("lines", F.transform(rows, drawn))
    return t.select(*table, F.concat(F.col("border"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n"), x, F.lit("\n"), F.col("border"))), "")).alias("rendered"))


def spanned(
    cells: DataFrame, table: list[str], row: str, col: str, rowspan: str, colspan: str, text: str, order: str, n_rows: str | None = None, n_cols: str | None = None, through: bool = False
) -> DataFrame:
    """(table, rendered): tables whose cells span rows and columns, drawn with ASCII lines.

    Rows and columns count from 1. A table is as wide and high as n_cols and n_rows say (the same in all its cells), or
    without a number above 0 as its cells need. Places and spans under 1 or missing count as 1; a column beyond the width
    counts as the last, spans end with the table, and rows outside it are left out. Of overlapping cells the later one in order of row, column and
    `order` is in front. Positions without a cell are blank boxes. With `through`, lines between rows run through cells
    of several rows. A table is one group, as its widths depend on all its cells.
    """
    number = lambda name: F.col(name).cast("int")
    whole = lambda name: F.lit(None).cast("int") if name is None else F.when(number(name) > 0, number(name))
    least = lambda name: F.greatest(F.coalesce(number(name), F.lit(1)), F.lit(1))
    cell = F.struct(F.coalesce(number(row), F.lit(0)).alias("row"), least(col).alias("col"), F.col(order).alias("order"), least(rowspan).alias("down"), least(colspan).alias("across"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = cells.groupBy(*table).agg(
        F.array_sort(F.collect_list(cell)).alias("cells"), F.coalesce(F.max(whole(n_rows)), F.greatest(F.max(number(row)), F.lit(0))).alias("rows"),
        F.coalesce(F.max(whole(n_cols)), F.max(least(col) + least(colspan) - 1)).alias("cols"),
    )

    def drawn(many: pa.Array, heights: pa.Array, widths: pa.Array) -> pa.Array:
        out, at, flat = [], 0, many.flatten()
        where = list(zip(*(flat.field(name).to_pylist() for name in ("row", "col", "down", "across"))))
        texts = flat.field("text").to_pylist()
        for n, rows, cols in zip(many.value_lengths().to_pylist(), heights.to_pylist(), widths.to_pylist()):
            inside = [k for k in range(at, at + n) if 1 <= where[k][0] <= rows]
            boxes = tuple((row - 1, min(col, cols) - 1, down, across) for row, col, down, across in map(where.__getitem__, inside))
            out.append(canvas.draw_boxes(boxes, rows, cols, {k: texts[i].split("\n") for k, i in enumerate(inside)}, through) if inside else "")
            at += n
        return pa.array(out, pa.string())

    return t.select(*table, F.arrow_udf(drawn, "string")("cells", "rows", "cols").alias("rendered"))
