"""Fields, names and records: text functions, catalog steps and Word files with lists, styles and merged cells."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import text_udf
from ..operators import catalog, chunks, classify, spans
from ..schema import SECTION_IDS
from ..sources import files, ooxml
from .base import LINES, Registry, lines, table

query = Registry()
_WS = r"'\s+', ' ', 'g'"


@query(
    "txt_clip",
    f"select doc_id, case when length(t) > 40 then left(t, 39) || '>' else t end as clipped, case when length(t) > 500 then left(t, 497) || '...' else t end as previewed from (select doc_id, trim(regexp_replace(text, {_WS})) as t from documents)",
)
def clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 40).alias("clipped"), T.preview(F.col("text"), 500).alias("previewed"))


@query(
    "txt_slug_file_name",
    r"""select doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'section') as slug, regexp_replace(text, '[\\/:*?"<>|]+', '_', 'g') as file_name from documents""",
)
def slugs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.slug(F.col("text")).alias("slug"), T.safe_file_name(F.col("text")).alias("file_name"))


@query(
    "txt_excerpt",
    """select doc_id, case when len(l) > 3 then array_to_string(l[:3], chr(10)) || chr(10) || '...' else text end as excerpt from (select doc_id, text, string_split(text, chr(10)) as l from documents)""",
)
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 3).alias("excerpt"))


@query("txt_strip_fences", r"select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as answer from documents")
def fences(spark, sf_dir):
    """Every other document in a code fence; what is inside comes back."""
    d = table(spark, sf_dir, "documents")
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ```json\n"), "text", F.lit("\n```\n"))).otherwise(F.col("text"))
    return d.select("doc_id", T.strip_fences(fenced).alias("answer"))


@query(
    "txt_safe_number",
    """select o_orderkey, case when o_orderkey % 4 = 0 then o_totalprice when o_orderkey % 4 = 1 then -1.0 when o_orderkey % 4 = 2 then -1.0 else 0.5 end::double as value from orders""",
)
def safe_number(spark, sf_dir):
    """Numbers, words, infinities and fractions as text."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, "no number").when(k == 2, "Infinity").otherwise(" 0.5 ")
    return o.select("o_orderkey", T.safe_double(text, -1.0).alias("value"))


@query(
    "txt_content_disposition",
    """select p_partkey, 'attachment; filename="' || p_name || '.pdf"; filename*=UTF-8''''' || replace(p_name, ' ', '%20') || '.pdf' as header from part""",
)
def disposition(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.replace(T.content_disposition(F.concat("p_name", F.lit(".pdf"))), F.lit("''"), F.lit("''")).alias("header")).withColumn("header", _percent(F.col("header")))


@query(
    "txt_content_disposition_marks",
    """select p_partkey, 'attachment; filename="' || p_name || ' (final) ~v1!' || chr(39) || '*_+?.pdf"; filename*=UTF-8' || chr(39) || chr(39) || p_name || ' (final) ~v1!' || chr(39) || '*%C3%A9%2B%3F.pdf' as header from part""",
)
def disposition_marks(spark, sf_dir):
    """Names with marks that stay, that are encoded, and a letter that ASCII lacks: the header as it is."""
    name = F.concat("p_name", F.lit(" (final) ~v1!'*\u00e9+?.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", T.content_disposition(name).alias("header"))


def _percent(x):
    """Spaces after the charset mark as %20, as clients send them."""
    head, tail = F.substring_index(x, "''", 1), F.substring_index(x, "''", -1)
    return F.concat(head, F.lit("''"), F.replace(tail, F.lit(" "), F.lit("%20")))


@query("txt_unescape_links", r"""select doc_id, t as plain, t as label from (select doc_id, trim(regexp_replace(translate(text, '<>&[', '  +('), '\s+', ' ', 'g')) as t from documents)""")
def unescape(spark, sf_dir):
    """Texts of one line with tags and references put in; they come back as they were."""
    flat = T.collapse(F.translate("text", "<>&[", "  +("))
    marked = F.concat(F.lit("<strong>"), F.replace(flat, F.lit("e"), F.lit("&#101;")), F.lit("</strong>"))
    return table(spark, sf_dir, "documents").select("doc_id", text_udf.plain_content(marked).alias("plain"), text_udf.plain_label(marked).alias("label"))


@query("cls_ids_in_order", f"select event_id, '{','.join(sorted({SECTION_IDS[1], SECTION_IDS[4], SECTION_IDS[2]}))}' as ordered, '{SECTION_IDS[4]},{SECTION_IDS[1]}' as parsed from events")
def ids_in_order(spark, sf_dir):
    """Ids as a reviewer types them, and in the catalog's order."""
    a, b, c = SECTION_IDS[1], SECTION_IDS[2], SECTION_IDS[4]
    typed = F.lit(f" {c.lower()} ;{a}, nothing,{c}")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(classify.by_catalog(F.array(F.lit(c), F.lit(a), F.lit(b))), ",").alias("ordered"), F.array_join(classify.parse_id_list(typed), ",").alias("parsed"))


@query("span_file_name", f"select l_orderkey, 'SEC05_span_' || lpad(count(*)::varchar, 2, '0') || '_' || min_by(l_returnflag, pos) || '__' || max_by(l_returnflag, pos) as name from {LINES} group by l_orderkey")
def span_file_name(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min_by("l_returnflag", "pos").alias("a"), F.max_by("l_returnflag", "pos").alias("b"))
    return g.select("l_orderkey", spans.span_name(F.lit("SEC05"), F.col("n"), F.col("a"), F.col("b")).alias("name"))


@query(
    "span_merged_table",
    f"""with r as (select l_orderkey, pos, l_quantity > 40 as is_title, row_number() over (partition by l_orderkey order by pos) as new_row, case when max(case when l_quantity <= 40 then 2 end) over (partition by l_orderkey) is null then 1 else 2 end as width from {LINES})
    select l_orderkey, new_row::int as new_row, 1 as new_col, case when is_title then width else 1 end::int as new_span, 'a' || pos as text from r
    union all select l_orderkey, new_row::int, 2, 1, 'b' || pos from r where not is_title""",
)
def merged_table(spark, sf_dir):
    """Lines stand for rows of two cells, those of large quantity for titles."""
    cell = lambda x: F.struct(F.concat(F.lit(x), F.col("pos").cast("string")).alias("cell_id"), F.concat(F.lit(x), F.col("pos").cast("string")).alias("text"))
    title = F.col("l_quantity") > 40
    rows = lines(spark, sf_dir).select("l_orderkey", "pos", title.alias("is_title"), F.when(title, F.array(cell("a"))).otherwise(F.array(cell("a"), cell("b"))).alias("cells")).withColumn("n_cells", F.size("cells"))
    m = spans.merged_table(rows, ["l_orderkey"], ["pos"])
    return m.select("l_orderkey", "new_row", "new_col", F.col("new_span").cast("int").alias("new_span"), "text")


@query("cat_upsert", "select c_custkey, case when c_custkey % 3 = 0 then 'new' else c_name end as name from customer union all select -1, 'added'")
def upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    updates = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("name")).union(spark.createDataFrame([(-1, "added")], "c_custkey long, name string"))
    return catalog.upsert(c, updates, "c_custkey")


@query(
    "cat_select_documents",
    """with w as (select o_custkey as doc, min(o_orderkey) as pos from (select case when o_orderkey % 7 = 0 then -o_custkey else o_custkey end as o_custkey, o_orderkey from orders) group by 1)
    select doc, pos, case when c_custkey is null then 'unknown document' when c_acctbal < 0 then 'no manifest' end as error from w left join customer on doc = c_custkey""",
)
def select_documents(spark, sf_dir):
    """Customers of orders stand for wanted documents; some are unknown, those in debt have no manifest."""
    doc = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    wanted = table(spark, sf_dir, "orders").select(doc.alias("doc"), F.col("o_orderkey").alias("pos"))
    existing = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_acctbal") >= 0).alias("has_manifest"))
    return catalog.select_documents(wanted, existing, "doc").select("doc", "pos", "error")


@query(
    "cat_asset_name",
    """select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_name || '.png' when 2 then p_type || '.bin' else 'EM000009' end as name from part""",
)
def asset_name(spark, sf_dir):
    """Shown, original and stored names, and ids."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    blank = F.lit("  ")
    shown, original = F.when(k == 0, F.col("p_name")).otherwise(blank), F.when(k == 1, F.concat(F.lit("a/b/"), "p_name", F.lit(".png"))).otherwise(blank)
    stored = F.when(k == 2, F.concat(F.lit("EM000001_"), "p_type", F.lit(".bin")))
    return p.select("p_partkey", catalog.asset_name(shown, original, stored, F.lit("EM000009")).alias("name"))


@query("src_manifest_texts", "select doc_id, lang, text as content from documents where trim(text) <> ''")
def manifest_texts(spark, sf_dir):
    """Documents as the files of a manifest."""
    d = table(spark, sf_dir, "documents")
    return files.manifest_texts(d.select("doc_id", F.col("source").alias("file_name"), "lang"), d.select("doc_id", F.col("source").alias("file_name"), F.col("text").alias("content"))).select("doc_id", "lang", "content")


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_NUMBERING = f"""<w:numbering {_W}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
    <w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum>
    <w:num w:numId="7"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>"""
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="link" Target="https://example.org/a" TargetMode="External"/></Relationships>'


def _rich(names: list[str]) -> bytes:
    """A Word file: a numbered list with sublists, bold parts cut into runs and links; a table whose first column is one merged cell."""
    run = lambda text, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"
    item = lambda level, body: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="7"/></w:numPr></w:pPr>{body}</w:p>'
    listed = "".join(
        item(0, run(n[:2], "<w:b/>") + run(n[2:], "<w:b/>") + run(" plain") + '<w:r><w:tab/><w:t>x</w:t></w:r>') + item(1, f'<w:hyperlink r:id="rId1">{run("link")}</w:hyperlink>{run("off", "<w:b w:val=" + chr(34) + "0" + chr(34) + "/>")}')
        for n in names
    )
    cell = lambda props, text: f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{run(text)}</w:p></w:tc>"
    rows = "".join(f"<w:tr>{cell('<w:vMerge w:val=%s/>' % (chr(34) + ('restart' if i == 0 else 'continue') + chr(34)), 'all' if i == 0 else '')}{cell('<w:shd w:fill=%sabc%s/>' % (chr(34), chr(34)) if i % 2 else '', n)}{cell('', '')}</w:tr>" for i, n in enumerate(names))
    body = f"{listed}<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid>{rows}</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", _NUMBERING)
        z.writestr("word/_rels/document.xml.rels", _RELS)
    return out.getvalue()


def rich_files(spark, sf_dir):
    """(doc_id, content): a Word file for each region, with its nations."""
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    build = F.pandas_udf(lambda names: pd.Series([_rich(list(x)) for x in names]), "binary")
    return g.select(F.col("n_regionkey").cast("string").alias("doc_id"), build("names").alias("content"))


@query(
    "docx_lists_and_styles",
    """with n as (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) + 4 as k from nation)
    select n_regionkey::varchar as doc_id, string_agg(k || '. <strong>' || n_name || '</strong> plain' || chr(9) || 'x' || chr(10) || chr(10) || '  ' || k || '.a) <HL:https://example.org/a>link</HL>off', chr(10) || chr(10) order by k) || chr(10) as content from n group by n_regionkey""",
)
def lists_and_styles(spark, sf_dir):
    """Numbers from an override, letters that start again, runs of one style joined, links, switched-off bold: through the parser of real files."""
    c = ooxml.part(ooxml.parse(rich_files(spark, sf_dir)), "chunks")
    return c.where("chunk_type = 'text'").select("doc_id", "content")


@query(
    "docx_merged_cells",
    """with n as (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as k, count(*) over (partition by n_regionkey) as c from nation)
    select n_regionkey::varchar as doc_id, 1 as row, 1 as col, max(c)::int as rowspan, 'all' as text, null as color, 'CL000001' as display_text from n group by n_regionkey
    union all select n_regionkey::varchar, k::int, 2, 1, n_name, '#AABBCC', n_name || ' [#AABBCC]' from n where k % 2 = 0""",
)
def merged_cells(spark, sf_dir):
    """A merged first column, filled cells, and a blank third column that goes: through the parser of real files."""
    c = ooxml.part(ooxml.parse(rich_files(spark, sf_dir)), "cells").where("col = 1 or color is not null")
    return c.select("doc_id", "row", "col", "rowspan", "text", "color", "display_text")


@query(
    "asset_labels",
    f"""select l_orderkey, 'EM' || lpad(pos::varchar, 6, '0') as asset, case pos % 3 when 0 then l_returnflag || 'a' when 1 then l_returnflag || 'c' else l_returnflag || 'beside' end as label from {LINES}""",
)
def asset_labels(spark, sf_dir):
    """Each line is a row of two cells: text before the mark, text after it, or text in the other cell alone."""
    name = F.concat(F.lit("<EM"), F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit(">"))
    k, flag = F.col("pos") % 3, F.col("l_returnflag")
    first = F.when(k == 0, F.concat(F.lit("x\n<strong>"), flag, F.lit("a</strong>\n"), name, F.lit("\nb"))).when(k == 1, F.concat(name, F.lit(" <TB000001>\n\n"), flag, F.lit("c\nd"))).otherwise(F.concat(name, F.lit(" CL000001 ")))
    both = F.posexplode(F.array(first, F.concat(flag, F.lit("beside")))).alias("col", "text")
    cells = lines(spark, sf_dir).select("l_orderkey", "pos", both)
    return chunks.asset_labels(cells, ["l_orderkey"], "pos", "col", "text")
