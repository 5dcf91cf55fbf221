"""Sections as HTML: escaped text with the markup that is allowed, tables, lists."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import COLOR_TOKEN, contrast_color, display_color, dominant_direction, without_color
from . import rag
from .storage import stored

_ALLOWED = re.compile(r"&lt;(/?)(strong|em|u)&gt;")
_LINK = re.compile(r"&lt;HL:(https?://[^&\s]*(?:&amp;[^&\s]*)*)&gt;(.*?)&lt;/HL&gt;", re.S)


def inline(text: str | None) -> str:
    """Escaped text in which bold, italic, underline and web links work; other markup shows as text."""
    out = html.escape(text or "", quote=False)
    out = _ALLOWED.sub(r"<\1\2>", out)
    out = _LINK.sub(lambda m: f'<a href="{html.escape(html.unescape(m[1]), quote=True)}">{m[2]}</a>', out)
    return out.replace("\n", "<br>")


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def inline_column(x: Column) -> Column:
    """inline() as an expression."""
    out = F.regexp_replace(escape(F.coalesce(x, F.lit(""))), r"&lt;(/?)(strong|em|u)&gt;", "<$1$2>")
    out = F.regexp_replace(out, r"(?s)&lt;HL:(https?://[^&\s\"]*(?:&amp;[^&\s\"]*)*)&gt;(.*?)&lt;/HL&gt;", '<a href="$1">$2</a>')
    return F.replace(out, F.lit("\n"), F.lit("<br>"))


def cell(x: Column) -> Column:
    """A table cell with its fill, a legible text colour and its direction."""
    color = display_color(x)
    style = F.when(color.isNotNull(), F.concat(F.lit(' style="background:'), color, F.lit(";color:"), contrast_color(color), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<td class="text-'), dominant_direction(x), F.lit('"'), style, F.lit(">"), inline_column(without_color(x)), F.lit("</td>"))


def matrix(columns: Column, rows: Column) -> Column:
    """A table of an array of columns and an array of rows, arrays of values."""
    head = F.array_join(F.transform(columns, lambda c: F.concat(F.lit("<th>"), inline_column(c), F.lit("</th>"))), "")
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: cell(x)), ""), F.lit("</tr>"))), "")
    return F.concat(F.lit("<table><tr>"), head, F.lit("</tr>"), body, F.lit("</table>"))


def paragraphs(x: Column) -> Column:
    """Text as paragraphs, one for each block between blank lines."""
    blocks = F.filter(F.split(x, r"\n\s*\n"), lambda b: F.trim(b) != "")
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit('<p class="text-'), dominant_direction(b), F.lit('">'), inline_column(b), F.lit("</p>"))), "")


def section(section_id: Column, heading: Column, content: Column, columns: Column, rows: Column) -> Column:
    """A section by its shape: a matrix if it has rows, else its content."""
    body = F.when(F.size(rows) > 0, matrix(columns, rows)).otherwise(paragraphs(F.coalesce(content, F.lit(""))))
    return F.concat(F.lit('<section id="'), section_id, F.lit('"><h2>'), inline_column(F.regexp_replace(heading, COLOR_TOKEN, "")), F.lit("</h2>"), body, F.lit("</section>"))


def rows_table(rows: Column) -> Column:
    """A table of an array of rows, arrays of values, without a head."""
    body = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: cell(F.coalesce(x, F.lit("")))), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>"))


def outline(entries: Column) -> Column:
    """Entries (array<struct<type, level, heading, value>>) as nested blocks: a subsection of a level closes those open at its level or deeper.

    One fold over the entries of a section; the state is the open levels and the parts so far.
    """

    def close(n: Column) -> Column:
        return F.repeat(F.lit("</div></details>"), n)

    def step(acc: Column, e: Column) -> Column:
        head = (e["type"] == "subsection") & e["level"].isNotNull()
        stay = F.filter(acc["open"], lambda x: x < e["level"])
        title = F.concat(close(F.size(acc["open"]) - F.size(stay)), F.lit('<details open><summary class="text-'), dominant_direction(F.coalesce(e["heading"], F.lit(""))), F.lit('">'), inline_column(without_color(F.coalesce(e["heading"], F.lit("Subsection")))), F.lit('</summary><div>'))
        value = F.when(F.coalesce(e["value"], F.lit("")) != "", paragraphs(e["value"])).otherwise("")
        label = F.when(~F.coalesce(e["type"], F.lit("")).isin("subsection", "content", ""), F.concat(F.lit("<b>"), inline_column(e["type"]), F.lit("</b>"))).otherwise("")
        return F.struct(
            F.when(head, F.array_append(stay, e["level"])).otherwise(acc["open"]).alias("open"), F.array_append(acc["parts"], F.when(head, F.concat(title, value)).otherwise(F.concat(label, value))).alias("parts")
        )

    start = F.struct(F.expr("cast(array() as array<int>)").alias("open"), F.expr("cast(array() as array<string>)").alias("parts"))
    return F.aggregate(entries, start, step, lambda acc: F.concat(F.lit('<div class="outline">'), F.array_join(acc["parts"], ""), close(F.size(acc["open"])), F.lit("</div>")))


_ENTRY = "array<struct<type: string, level: int, heading: string, value: string>>"


def _body(v: Column) -> Column:
    """The body of one section or item by its shape: entries, a matrix, plain rows, content, or its values by name."""
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    columns, objects, arrays = get("$.columns", "array<string>"), get("$.rows", "array<map<string, string>>"), get("$.rows", "array<array<string>>")
    # Rows of objects without columns have those of their first row.
    names = F.coalesce(columns, F.filter(F.map_keys(F.get(objects, F.lit(0))), lambda k: k != "type"))
    values = F.transform(objects, lambda r: F.transform(names, lambda c: F.coalesce(F.try_element_at(r, c), F.lit(""))))
    pairs = F.filter(F.map_entries(get("$", "map<string, string>")), lambda e: ~e["key"].isin("section_id", "section_heading", "header_cell_ids", "status", "format") & e["value"].isNotNull())
    generic = F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("<div><b>"), inline_column(e["key"]), F.lit("</b> "), inline_column(e["value"]), F.lit("</div>"))), "")
    return (
        F.when(get("$.entries", _ENTRY).isNotNull(), outline(get("$.entries", _ENTRY)))
        .when(objects.isNotNull() & (F.size(names) > 0), matrix(names, values))
        .when(arrays.isNotNull(), rows_table(arrays))
        .when(get("$.content", "string").isNotNull(), paragraphs(get("$.content", "string")))
        .otherwise(F.coalesce(generic, F.lit("")))
    )


def payload(section_id: Column, section_json: Column, fallback: Column) -> Column:
    """A section's JSON as HTML, by its shape; empty for one that was not found. A list (other text) is a block for each item."""
    v = F.try_parse_json(section_json)
    get = lambda x, path: F.try_variant_get(x, path, "string")
    items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(get(x, "$.format"), F.lit("")) != "not_found")
    title = lambda x: F.when(get(x, "$.section_heading").isNotNull(), F.concat(F.lit("<h3>"), inline_column(without_color(get(x, "$.section_heading"))), F.lit("</h3>"))).otherwise("")
    block = lambda x: F.when(get(x, "$.format") == "empty", F.lit("<p>Empty table</p>")).otherwise(F.concat(F.lit('<div class="other">'), title(x), _body(x), F.lit("</div>")))
    heading = F.when(items.isNull(), get(v, "$.section_heading"))
    body = F.when(items.isNotNull(), F.array_join(F.transform(items, block), "")).otherwise(_body(v))
    whole = F.concat(F.lit('<section id="'), section_id, F.lit('"><h2>'), inline_column(without_color(F.coalesce(heading, fallback))), F.lit("</h2>"), body, F.lit("</section>"))
    return F.when(F.coalesce(get(v, "$.status"), F.lit("")) == "not_found", "").otherwise(F.coalesce(whole, F.lit("")))


def document(sections: DataFrame, doc: str, name: str, order: str, html_column: str) -> DataFrame:
    """(doc, html): the rendered sections of each document in order, under its name; empty sections go."""
    s = F.transform(F.array_sort(F.collect_list(F.when(F.col(html_column) != "", F.struct(F.col(order).alias("o"), F.col(html_column).alias("h"))))), lambda x: x["h"])
    g = sections.groupBy(doc).agg(F.first(name).alias("__name"), s.alias("__parts"))
    body = F.when(F.size("__parts") > 0, F.array_join("__parts", "")).otherwise("<p>No resolved document sections are ready to display.</p>")
    return g.select(doc, F.concat(F.lit("<article><h1>"), inline_column(F.col("__name")), F.lit("</h1>"), body, F.lit("</article>")).alias("html"))


def with_html(hits: DataFrame, sections: DataFrame, doc: str, section: str, order: str, html_column: str = "html") -> DataFrame:
    """hits with the HTML of the first section of their document and section id; null if there is none."""
    first = sections.groupBy(F.col(doc).alias("__doc"), F.col(section).alias("__section")).agg(F.min_by(html_column, order).alias("section_html"))
    return hits.join(first, (F.col(doc) == F.col("__doc")) & (F.col(section) == F.col("__section")), "left").drop("__doc", "__section")


def direction_sources(cells: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, source): the text of each cell with its references replaced by what they say, two levels deep.

    A reference gives the text of its cell, or of all cells of its table, in which references give texts once more, as
    those are written; assets give their name (doc_id, asset_id, display_name). A cell does not say itself again, what is unknown
    is said as it is written. Two joins on the ids of a document, whatever the depth of the references.
    """
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "cell_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    tables = cells.groupBy("doc_id", F.col("table_id").alias("id")).agg(F.array_join(in_order, " ").alias("text"))
    said = cells.select("doc_id", F.col("cell_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).union(tables)
    p = said.select("doc_id", "id", F.posexplode(rag.pieces(F.col("text"))).alias("pos", "p"))
    bare = F.when(F.col("p.is_ref"), F.regexp_replace("p.text", "[<>]", ""))
    p = p.select("doc_id", "id", "pos", F.col("p.text").alias("text"), F.when(~bare.startswith("EM"), bare).alias("target"), F.when(bare.startswith("EM"), bare).alias("asset"))
    if assets is not None:
        names = assets.select(F.col("doc_id").alias("__doc"), F.col("asset_id").alias("__asset"), "display_name")
        p = p.join(names, (F.col("doc_id") == F.col("__doc")) & (F.col("asset") == F.col("__asset")), "left").withColumn("text", F.coalesce("display_name", "text"))
    raw = said.select(F.col("doc_id").alias("__doc"), F.col("id").alias("__id"), F.col("text").alias("raw"))
    p = p.join(raw, (F.col("doc_id") == F.col("__doc")) & (F.col("target") == F.col("__id")), "left")
    p = stored(p.select("doc_id", "id", "pos", "text", "target", "raw"))
    known = F.col("target").isNotNull() & F.col("raw").isNotNull()
    own = p.where(~known).select("doc_id", "id", "pos", F.lit(0).alias("then"), F.col("text").alias("said"))
    deep = p.select(F.col("doc_id").alias("__doc"), F.col("id").alias("__id"), F.col("pos").alias("then"), F.col("text").alias("__text"), F.col("target").alias("__target"), F.col("raw").alias("__raw"))
    there = p.where(known & (F.col("target") != F.col("id"))).select("doc_id", "id", "pos", "target").join(deep, (F.col("doc_id") == F.col("__doc")) & (F.col("target") == F.col("__id")))
    again = F.coalesce((F.col("__target") == F.col("id")) | (F.col("__target") == F.col("target")), F.lit(False))
    deep = there.select("doc_id", "id", "pos", "then", F.when(~again, F.coalesce("__raw", "__text")).alias("said"))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "then", "said"))), lambda x: x["said"]), lambda x: x.isNotNull())
    return own.union(deep).groupBy("doc_id", "id").agg(F.array_join(parts, " ").alias("source")).where(F.col("id").startswith("CL"))


def nodes(cells: DataFrame, tables: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, text) of cells and tables for references(): a table's text is its HTML around the ids of its cells.

    A table nested in a cell whose text does not name it follows the text. The direction of a cell is that of what it and
    its references say (direction_sources).
    """
    sources = direction_sources(cells, assets).select(F.col("doc_id").alias("__doc"), F.col("id").alias("__cell"), "source")
    cells = cells.join(sources, (F.col("doc_id") == F.col("__doc")) & (F.col("cell_id") == F.col("__cell")), "left").drop("__doc", "__cell").withColumn("source", F.coalesce("source", "text", F.lit("")))
    unnamed = F.filter(F.coalesce("nested_table_ids", F.array().cast("array<string>")), lambda t: ~F.contains(F.col("text"), F.concat(F.lit("<"), t, F.lit(">"))))
    text = F.concat(F.col("text"), F.array_join(F.transform(unnamed, lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""))
    known = F.col("color").rlike("^#[0-9A-Fa-f]{6}$")
    style = F.when(known, F.concat(F.lit(' style="background:'), F.col("color"), F.lit(";color:"), contrast_color(F.col("color")), F.lit('"'))).otherwise("")
    span = lambda x: F.greatest(F.coalesce(F.col(x), F.lit(1)), F.lit(1)).cast("string")
    td = F.concat(F.lit('<td rowspan="'), span("rowspan"), F.lit('" colspan="'), span("colspan"), F.lit('" class="text-'), dominant_direction(F.col("source")), F.lit('"'), style, F.lit(">"), F.col("cell_id"), F.lit("</td>"))
    in_order = lambda key, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, x.alias("x")))), lambda s: s["x"]), "")
    tr = cells.groupBy("doc_id", "table_id", "row").agg(F.concat(F.lit("<tr>"), in_order(("col", "cell_id"), td), F.lit("</tr>")).alias("tr"))
    drawn = tr.groupBy("doc_id", "table_id").agg(F.concat(F.lit("<table>"), in_order(("row",), F.col("tr")), F.lit("</table>")).alias("text"))
    whole = tables.select("doc_id", "table_id").join(drawn, ["doc_id", "table_id"], "left").select("doc_id", F.col("table_id").alias("id"), F.coalesce("text", F.lit("<table></table>")).alias("text"))
    return cells.select("doc_id", F.col("cell_id").alias("id"), text.alias("text")).union(whole)


def references(every: DataFrame, assets: DataFrame, url: str = "assets") -> DataFrame:
    """(doc_id, root, html): texts of nodes() with is_root as HTML, their references to cells, tables and assets in place, to any depth.

    What is on its own path is left out; unknown cells, tables and assets show as missing.
    """
    a = assets.select(F.col("doc_id").alias("__doc"), F.col("asset_id").alias("__asset"), "display_name", "stored_name", "content_type")
    bare = F.regexp_replace("text", "[<>]", "")
    found = rag.walk(every).join(a, (F.col("doc_id") == F.col("__doc")) & (F.col("state") == "asset") & (bare == F.col("__asset")), "left")
    label, link = escape(F.coalesce("display_name", "stored_name", "__asset")), F.concat(F.lit(f"{url}/"), F.col("__asset"))
    image = F.concat(F.lit('<figure><img src="'), link, F.lit('" alt="'), F.replace(label, F.lit('"'), F.lit("&quot;")), F.lit('"></figure>'))
    file = F.concat(F.lit('<a class="file" href="'), link, F.lit('">'), label, F.lit("</a>"))
    missing = F.concat(F.lit('<span class="missing">'), escape(bare), F.lit("</span>"))
    shown = (
        F.when(F.col("state") == "cycle", "")
        .when((F.col("state") == "asset") & F.col("__asset").isNotNull(), F.when(F.col("content_type").startswith("image/"), image).otherwise(file))
        .when(F.col("state") != "text", missing)
        .when(F.col("node").startswith("TB"), F.col("text"))
        .otherwise(inline_column(F.col("text")))
    )
    return found.groupBy("doc_id", "root").agg(F.array_join(rag.in_place(shown), "").alias("html"))
