"""Section JSON: which inspection applies, how answers are checked, and tables turned into JSON without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COLOR_TOKEN, INVISIBLE, MARKUP, collapse, display_color
from ..schema import GROUP_FILLS, OTHER, SECTIONS
from .headers import visible

FORMATS = ("titled_item", "matrix", "empty", "other", "not_found")


def inspection_for(spans: DataFrame, inspections: DataFrame, key: list[str], files: str, order: str) -> DataFrame:
    """Each span with the first inspection of its section that shares a file with it; skipped inspections do not count.

    spans: key, section, files; inspections: key's document, section, order, files, status. An equi-join on the files.
    """
    s = spans.select(*key, "section", F.explode(files).alias("__f"))
    i = inspections.where("status <> 'skipped'").select(F.col(key[0]).alias("__d"), F.col("section").alias("__s"), order, F.explode(files).alias("__g"))
    hit = s.join(i, (F.col(key[0]) == F.col("__d")) & (F.col("section") == F.col("__s")) & (F.col("__f") == F.col("__g")))
    return spans.join(hit.groupBy(*key, "section").agg(F.min(order).alias("inspection")), [*key, "section"], "left")


def validate(payload: Column, section: Column) -> Column:
    """What is wrong with an answer, or null: other text is an array of objects of known formats, all else an object of its section."""
    v = F.try_parse_json(payload)
    kind, text = F.schema_of_variant(v), F.to_json(v)
    formats = F.try_variant_get(v, "$", "array<struct<format: string>>")
    bad = F.filter(F.transform(formats, lambda x: F.coalesce(x["format"], F.lit("?"))), lambda x: ~x.isin(*FORMATS))
    own = F.get_json_object(text, "$.section_id")
    return (
        F.when(v.isNull(), "not JSON")
        .when((section == OTHER) & ~kind.startswith("ARRAY"), "not an array")
        .when((section == OTHER) & (F.coalesce(F.size(formats), F.lit(0)) == 0), "empty array")
        .when((section == OTHER) & (F.size(bad) > 0), "unknown format")
        .when((section != OTHER) & ~kind.startswith("OBJECT"), "not an object")
        .when((section != OTHER) & own.isNotNull() & (own != section), "wrong section")
    )


def shown(cell: Column) -> Column:
    """What a cell shows: its display text unless that is its id, else its text."""
    return F.when(visible(cell["cell_id"], cell["display_text"]), F.trim(cell["display_text"])).otherwise(F.trim(F.coalesce(cell["text"], F.lit(""))))


def clean(x: Column) -> Column:
    """A label without fills, markup and invisible characters."""
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, COLOR_TOKEN, " "), MARKUP, ""), INVISIBLE, ""))


def label_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(clean(x), r"(?U)\W+", ""))


def is_header_row(cells: Column, columns: Column, header_ids: Column) -> Column:
    """A row that holds all known header cells, or whose first cells are the columns' labels."""
    ids = F.transform(cells, lambda c: c["cell_id"])
    by_id = (F.size(header_ids) > 0) & (F.size(F.array_except(header_ids, ids)) == 0)
    pairs = F.zip_with(F.slice(F.transform(cells, shown), F.lit(1), F.greatest(F.size(columns), F.lit(1))), columns, lambda a, b: (label_key(a) != "") & (label_key(a) == label_key(b)))
    by_label = (F.size(columns) > 0) & (F.size(cells) >= F.size(columns)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))
    return by_id | by_label


def names_section(x: Column, section: Column) -> Column:
    """Whether a text holds the Arabic or English name of a section."""
    names = F.create_map(*(y for s, arabic, english in SECTIONS for y in (F.lit(s), F.array(F.lit(arabic), F.lit(english.lower())))))
    low = F.lower(clean(x))
    return F.exists(F.try_element_at(names, section), lambda n: F.contains(low, n))


def heading_type(x: Column) -> Column:
    """Main headings of a workflow have one of a few dark fills."""
    return F.when(F.upper(display_color(x)).isin(*GROUP_FILLS), "group_header").otherwise("subgroup_header")


def table_entries(rows: DataFrame, table: list[str], workflow: Column) -> DataFrame:
    """Tables as JSON entries: (table, row, kind, heading, fields), one row each, and the section's heading.

    rows: table, section, row, is_title, cells, columns, header_ids. Header rows go. A title or lone cell with text is
    the section heading if it is the first that names the section; else it is a heading (workflow) or a value under
    the first column (matrix). Other rows refer to their cells by id, column by column. Tables without columns take
    the labels of their first row that is no title, which is then a header.
    """
    w = Window.partitionBy(*table)
    first = F.min(F.when(~F.col("is_title"), F.struct("row", "cells"))).over(w)
    r = rows.withColumn("__first", first)
    few = F.size("columns") < F.when(workflow, 2).otherwise(1)
    inferred = F.transform("__first.cells", lambda c: F.coalesce(F.nullif(clean(shown(c)), F.lit("")), c["cell_id"]))
    r = r.withColumn("header_ids", F.when(few & (F.size("header_ids") == 0), F.coalesce(F.transform("__first.cells", lambda c: c["cell_id"]), F.col("header_ids"))).otherwise(F.col("header_ids")))
    r = r.withColumn("columns", F.when(few, F.coalesce(inferred, F.col("columns"))).otherwise(F.col("columns")))
    r = r.where(~is_header_row(F.col("cells"), F.col("columns"), F.col("header_ids")) & (F.size("cells") > 0))
    single = F.col("is_title") | (F.size("cells") == 1)
    value = shown(F.element_at("cells", 1))
    r = r.withColumn("single", single).withColumn("value", value).where(~F.col("single") | (clean(F.col("value")) != ""))
    names = F.col("single") & names_section(F.col("value"), F.col("section"))
    r = r.withColumn("__names", names).withColumn("section_row", F.min(F.when(F.col("__names"), F.col("row"))).over(w))
    r = r.withColumn("section_heading", F.max(F.when(F.col("row") == F.col("section_row"), F.col("value"))).over(w))
    r = r.where(F.col("section_row").isNull() | (F.col("row") != F.col("section_row")))
    kind = F.when(~F.col("single"), F.when(workflow, "step").otherwise("row")).when(workflow, heading_type(F.col("value"))).otherwise("value")
    n = F.least(F.size("columns"), F.size("cells"))
    fields = F.when(~F.col("single"), F.zip_with(F.slice("columns", F.lit(1), n), F.slice(F.transform("cells", lambda c: c["cell_id"]), F.lit(1), n), lambda a, b: F.concat(a, F.lit("="), b)))
    fields = F.when(F.col("single") & ~workflow, F.array(F.concat(F.element_at("columns", 1), F.lit("="), F.col("value")))).otherwise(fields)
    # Steps without any text are left out.
    text = F.exists("cells", lambda c: clean(shown(c)) != "")
    r = r.where(F.col("single") | ~workflow | text)
    return r.select(*table, "row", kind.alias("kind"), F.when(F.col("single") & workflow, F.col("value")).alias("heading"), fields.alias("fields"), "section_heading")


def fill_down(cells: DataFrame, table: list[str], row: str, col: str, value: str, span: str) -> DataFrame:
    """Cell ids carried down blanks as far as their row span, and runs of equal ones numbered, for drawing."""
    w = Window.partitionBy(*table, col).orderBy(row)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(row).alias("r"), F.col(span).alias("s"))), ignorenulls=True).over(up)
    c = cells.withColumn("__l", last)
    filled = F.when(F.col("__l.r") + F.col("__l.s") > F.col(row), F.col("__l.v"))
    c = c.withColumn("filled", filled)
    changed = ~F.col("filled").eqNullSafe(F.lag("filled").over(w)) | F.col("filled").isNull()
    c = c.withColumn("__new", F.when(changed, 1).otherwise(0))
    return c.withColumn("run", F.sum("__new").over(up)).drop("__l", "__new")


def entries_json(found: DataFrame, key: list[str], workflow: Column) -> DataFrame:
    """(key, section_json): the rows of table_entries() as one JSON text per table.

    Fields are `column=value`; they become the keys of a step or a row.
    """
    pairs = F.transform("fields", lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    fields = F.when(F.col("fields").isNotNull(), F.map_from_arrays(F.transform(pairs, lambda p: p["k"]), F.transform(pairs, lambda p: p["v"])))
    typed = lambda kind: F.map_concat(F.create_map(F.lit("type"), kind), F.coalesce(fields, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    heading = F.create_map(F.lit("type"), F.col("kind"), F.lit("heading"), F.col("heading"))
    entry = F.when(workflow, F.when(F.col("heading").isNotNull(), heading).otherwise(typed(F.lit("step")))).otherwise(typed(F.lit("data_row")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row", F.to_json(entry).alias("j")))), lambda x: x["j"])
    g = found.groupBy(*key).agg(listed.alias("entries"), F.max(workflow).alias("workflow"), F.max("section_heading").alias("section_heading"))
    items = F.concat(F.lit("["), F.array_join("entries", ","), F.lit("]"))
    name = F.when(F.col("workflow"), "entries").otherwise("rows")
    head = F.when(F.col("section_heading").isNotNull(), F.concat(F.lit('"section_heading":'), F.to_json(F.array("section_heading")).substr(F.lit(2), F.length(F.to_json(F.array("section_heading"))) - 2), F.lit(","))).otherwise("")
    return g.select(*key, F.concat(F.lit("{"), head, F.lit('"'), name, F.lit('":'), items, F.lit("}")).alias("section_json"))


def canonical_heading(section_id: Column, kind: Column, heading: Column) -> Column:
    """The heading of a section: that of SEC18 in the form of sections is always the catalog's, Arabic and English."""
    arabic, english = next((a, e) for s, a, e in SECTIONS if s == "SEC18")
    return F.when((section_id == "SEC18") & (kind == "sections"), F.lit(f"{arabic} ({english})")).otherwise(heading)


def column_context(resolution: Column) -> Column:
    """What a prompt says about a table's columns, of a header resolution; empty without one."""
    keys = ("valid_column_order", "actual_header_row_exists", "actual_header_cell_ids", "header_state")
    shown = F.to_json(F.struct(*(resolution[k].alias(k) for k in keys)))
    return F.when(resolution.isNotNull(), F.concat(F.lit("The columns were checked before. Use just these labels:\n"), shown)).otherwise("")


def extraction_prompt(document: Column, section_id: Column, files: Column, content: Column, columns: Column, co_sections: Column) -> Column:
    """The text that asks a model for one section's JSON: document, section, files, what was found out about columns, content.

    A chunk of both SEC01 and SEC02 says so for SEC02, as the first's department name and banner do not belong to its table.
    """
    name = F.create_map(*(x for s, a, e in SECTIONS for x in (F.lit(s), F.lit(f"{s}: {a} ({e})"))))[section_id]
    both = F.when((section_id == "SEC02") & F.array_contains(co_sections, "SEC01"), F.lit("The content also holds SEC01, the department's name and banner. Leave these and their images out, and return the rows of the document header table only."))
    lines = [
        F.lit("Return the section below as JSON."), F.concat(F.lit("Document: "), document), F.concat(F.lit("Section: "), name), F.concat(F.lit("Files: "), F.array_join(files, ", ")),
        both, F.nullif(columns, F.lit("")), F.concat(F.lit("Content:\n"), content),
    ]
    return F.concat_ws("\n\n", *lines)
