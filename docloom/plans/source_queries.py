"""Group K and sources: Word files made of the driver's tables, paths and content types."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..sources import files, ole, ooxml
from .base import Registry, table

query = Registry()
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _paragraph(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def _file(title: str, rows) -> bytes:
    """A Word file: a title, a table of two columns with a title row over both, and a closing line."""
    cells = lambda *xs: "".join(f"<w:tc>{_paragraph(x)}</w:tc>" for x in xs)
    span = f'<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{_paragraph(title)}</w:tc></w:tr>'
    body = f"{_paragraph(title)}<w:tbl>{span}{''.join(f'<w:tr>{cells(*r)}</w:tr>' for r in rows)}</w:tbl>{_paragraph('end')}"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def region_files(spark, sf_dir):
    """(doc_id, content): a Word file for each region, with its nations."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = F.struct("n_nationkey", F.col("n_name"))
    g = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    build = F.pandas_udf(lambda names, rows: pd.Series([_file(a, [(str(x["n_nationkey"]), x["n_name"]) for x in b]) for a, b in zip(names, rows)]), "binary")
    return g.select(F.col("r_name").alias("doc_id"), build("r_name", "rows").alias("content"))


@query(
    "docx_extract",
    """select r_name as doc_id, 1 as row, 1 as col, 2 as colspan, r_name as text from region
    union all select r_name, row_number() over (partition by r_name order by n_nationkey)::int + 1, 1, 1, n_nationkey::varchar from nation join region on n_regionkey = r_regionkey
    union all select r_name, row_number() over (partition by r_name order by n_nationkey)::int + 1, 2, 1, n_name from nation join region on n_regionkey = r_regionkey""",
)
def docx_cells(spark, sf_dir):
    """The cells of the regions' files."""
    return ooxml.part(ooxml.parse(region_files(spark, sf_dir)), "cells").select("doc_id", "row", "col", "colspan", "text")


@query(
    "docx_chunks",
    """select r_name as doc_id, 0 as chunk_index, 'text' as chunk_type, '0000_text.txt' as file_name, 2 as n_lines from region
    union all select r_name, 1, 'table', '0001_table.txt', 2 * (count(*)::int + 1) + 1 + 1 from nation join region on n_regionkey = r_regionkey group by all
    union all select r_name, 2, 'text', '0002_text.txt', 2 from region""",
)
def docx_chunks(spark, sf_dir):
    """The chunks of the regions' files."""
    c = ooxml.part(ooxml.parse(region_files(spark, sf_dir)), "chunks")
    return c.select("doc_id", "chunk_index", "chunk_type", "file_name", F.size(F.split("content", "\n")).alias("n_lines"))


@query("src_resolve_path", """select p_partkey, 'word/media/i' || p_size || '.png' as path from part""")
def paths(spark, sf_dir):
    target = F.concat(F.lit("./x/../../word/media//i"), F.col("p_size").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "part").select("p_partkey", files.resolve_path(F.lit("word"), target).alias("path"))


@query(
    "src_content_types",
    """select p_name || p_partkey || case p_partkey % 3 when 0 then '.PNG' when 1 then '.xml' else '' end as part, case when p_partkey % 10 = 0 then 'own/type' when p_partkey % 3 = 0 then 'image/png' end as content_type from part""",
)
def types(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".PNG").when(F.col("p_partkey") % 3 == 1, ".xml").otherwise(""))
    own = p.where("p_partkey % 10 = 0").select(F.concat(F.lit("/"), name).alias("part"), F.lit("own/type").alias("content_type"))
    defaults = spark.createDataFrame([("png", "image/png")], "extension string, content_type string")
    return files.content_types(p.select(name.alias("part")), own, defaults)


#: A container for each part, by its number: a native stream of a few bytes, one of many, and a PDF in CONTENTS inside a storage.
def _container(key: int, text: str) -> bytes:
    body = (text * (1 if key % 3 == 0 else 400 if key % 3 == 1 else 20)).encode()
    if key % 3 == 2:
        return ole.compound({("ObjectPool", "CONTENTS"): b"%PDF-" + body, ("other",): b"x" * 5000})
    return ole.compound({(ole.NATIVE,): ole.native_stream(f"part {key}.txt", body), ("\x03ObjInfo",): b"\0" * 6})


def part_containers(spark, sf_dir):
    """(path, content): a container for each part with its name, so often that short and long streams occur."""
    build = F.pandas_udf(lambda keys, names: pd.Series([_container(k, n) for k, n in zip(keys, names)]), "binary")
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("/objects/oleObject"), F.col("p_partkey").cast("string"), F.lit(".bin")).alias("path"), build("p_partkey", "p_name").alias("content"))


@query(
    "ole_payloads",
    """with b as (select p_partkey as k, case p_partkey % 3 when 0 then p_name when 1 then repeat(p_name, 400) else '%PDF-' || repeat(p_name, 20) end as body from part)
    select '/objects/oleObject' || k || '.bin' as path, case when k % 3 = 2 then 'oleObject' || k || '.pdf' else 'part ' || k || '.txt' end as payload_name,
        case when k % 3 = 2 then 'application/pdf' else 'text/plain' end as payload_type, length(body)::int as size, sha256(body) as sha256 from b""",
)
def ole_payloads(spark, sf_dir):
    """What the containers of all parts carry."""
    out = ole.payloads(part_containers(spark, sf_dir))
    return out.select("path", "payload_name", "payload_type", F.length("payload").alias("size"), F.sha2("payload", 256).alias("sha256"))


def _file_with_objects(region: str, objects) -> bytes:
    """A Word file with a table: in each row a name and an embedded container, in the last row a picture under the name of the region."""
    ns = f'{_NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows, links, parts = [], [], {}
    for k, x in enumerate(objects):
        rows.append(f'<w:tr><w:tc>{_paragraph(x["n_name"])}</w:tc><w:tc><w:p><w:r><w:object><o:OLEObject r:id="o{k}"/></w:object></w:r></w:p></w:tc></w:tr>')
        links.append(f'<Relationship Id="o{k}" Type="{base}/oleObject" Target="embeddings/oleObject{k}.bin"/>')
        parts[f"word/embeddings/oleObject{k}.bin"] = ole.compound({(ole.NATIVE,): ole.native_stream("comment.txt", f"about {x['n_name']}".encode())})
    rows.append(f'<w:tr><w:tc>{_paragraph(region)}</w:tc><w:tc><w:p><w:r><w:drawing><a:blip r:embed="p"/></w:drawing></w:r></w:p></w:tc></w:tr>')
    links.append(f'<Relationship Id="p" Type="{base}/image" Target="media/image1.png"/>')
    parts["word/media/image1.png"] = b"\x89PNG\r\n\x1a\n" + region.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:tbl>{''.join(rows)}</w:tbl></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{''.join(links)}</Relationships>")
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


@query(
    "docx_assets",
    """with n as (select r_name, n_name, 'about ' || n_name as about, row_number() over (partition by r_name order by n_nationkey) as k from nation join region on n_regionkey = r_regionkey),
    a as (select r_name as doc_id, k, 'embedded' as kind, n_name as display_name, 'comment.txt' as original_name, case when k = 1 then 'comment.txt' else 'comment_' || k || '.txt' end as stored_name, 'text/plain' as content_type, sha256(about) as sha256 from n
        union all select r_name, max(k) + 1, 'image', r_name, 'image1.png', 'image1.png', 'image/png', sha256(from_hex('89504E470D0A1A0A' || hex(encode(r_name)))) from n group by r_name)
    select doc_id, 'EM' || lpad(k::varchar, 6, '0') as asset_id, kind, display_name, original_name, stored_name, content_type, sha256 from a""",
)
def docx_assets(spark, sf_dir):
    """Embedded files and pictures of Word files, out of their containers, named and labelled."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = F.struct("n_nationkey", "n_name")
    g = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    build = F.pandas_udf(lambda names, rows: pd.Series([_file_with_objects(a, b) for a, b in zip(names, rows)]), "binary")
    assets = ooxml.part(ooxml.parse(g.select(F.col("r_name").alias("doc_id"), build("r_name", "rows").alias("content"))), "assets")
    return assets.select("doc_id", "asset_id", "kind", "display_name", "original_name", "stored_name", "content_type", F.sha2("content", 256).alias("sha256"))


def _file_of_themes(rows) -> bytes:
    """A Word file with a table of two columns: a name filled by a theme colour, and a table of one cell with a number."""
    ns = _NS + ' xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shade = '<w:tcPr><w:shd w:fill="auto" w:themeFill="background2"/></w:tcPr>'
    inner = lambda x: f'<w:tbl><w:tr><w:tc>{_paragraph(x)}</w:tc></w:tr></w:tbl>'
    body = "".join(f'<w:tr><w:tc>{shade}{_paragraph(x["n_name"])}</w:tc><w:tc>{inner(str(x["n_nationkey"]))}<w:p/></w:tc></w:tr>' for x in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:tbl>{body}</w:tbl></w:body></w:document>")
        z.writestr("word/theme/theme1.xml", '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme><a:lt2><a:srgbClr val="44546a"/></a:lt2></a:clrScheme></a:themeElements></a:theme>')
    return out.getvalue()


@query(
    "docx_nested_themes",
    """with n as (select n_regionkey as r, n_name, n_nationkey as v, row_number() over (partition by n_regionkey order by n_nationkey)::int as k from nation),
    w as (select r, greatest(max(length(n_name)) + 10, 1) as a from n group by r),
    t as (select r, 'TB000001' as table_id, 'body block 1 (table 1)' as location, '0000_table.txt' as chunk_file_name, null as parent_cell_id,
            string_agg('+' || repeat('-', (a + 2)::int) || '+----------+' || chr(10) || '| ' || rpad(n_name || ' [#44546A]', a::int, ' ') || ' | CL' || lpad((2 * k)::varchar, 6, '0') || ' |', chr(10) order by k) || chr(10) || '+' || repeat('-', (any_value(a) + 2)::int) || '+----------+' as rendered
        from n join w using (r) group by r
        union all select r, 'TB' || lpad((k + 1)::varchar, 6, '0'), 'body block 1 (table 1) > row ' || k || ', col 2 (table ' || (k + 1) || ')', '0000_table_nested_' || lpad(k::varchar, 4, '0') || '.txt', 'CL' || lpad((2 * k)::varchar, 6, '0'),
            '+' || repeat('-', length(v::varchar) + 2) || '+' || chr(10) || '| ' || v || ' |' || chr(10) || '+' || repeat('-', length(v::varchar) + 2) || '+' from n)
    select r::varchar as doc_id, table_id, location, chunk_file_name, parent_cell_id, rendered from t""",
)
def docx_nested(spark, sf_dir):
    """Tables in tables and fills of a theme, through the parser of real files: places, names and drawings."""
    row = F.struct("n_nationkey", "n_name")
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    build = F.pandas_udf(lambda rows: pd.Series([_file_of_themes(x) for x in rows]), "binary")
    t = ooxml.part(ooxml.parse(g.select(F.col("n_regionkey").cast("string").alias("doc_id"), build("rows").alias("content"))), "tables")
    return t.select("doc_id", "table_id", "location", "chunk_file_name", "parent_cell_id", F.col("rendered_table").alias("rendered"))
