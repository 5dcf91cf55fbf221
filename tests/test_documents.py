"""Word files, chunks, models, spans and retrieval over small fixtures made here."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import grid, models, rag, spans, vectors
from docloom.sources import ooxml
from docloom.streaming import progress

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def p(text, props="", run=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def tc(content, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{content}</w:tc>"


NUM = '<w:numPr><w:ilvl w:val="{}"/><w:numId w:val="1"/></w:numPr>'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Default Extension="png" ContentType="image/png"/></Types>')
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Type="t/image" Target="media/i.png"/><Relationship Id="rId2" Type="t/hyperlink" Target="http://x/a" TargetMode="External"/></Relationships>')
        z.writestr("word/media/i.png", b"\x89PNG\r\n\x1a\n")
        level = '<w:lvl w:ilvl="{}"><w:start w:val="{}"/><w:numFmt w:val="{}"/><w:lvlText w:val="{}"/></w:lvl>'
        z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{level.format(0, 1, "decimal", "%1.")}{level.format(1, 1, "lowerRoman", "%1.%2)")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride></w:num></w:numbering>')
    return out.getvalue()


IMAGE = '<w:p><w:r><w:drawing><a:blip r:embed="rId1"/></w:drawing></w:r></w:p>'
NESTED = f"<w:tbl><w:tr>{tc(p('deep'))}</w:tr></w:tbl>"
TABLE = (
    "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid>"
    f"<w:tr>{tc(p('head'), '<w:gridSpan w:val=\"2\"/>')}{tc(p('c'), '<w:vMerge w:val=\"restart\"/>')}</w:tr>"
    f"<w:tr>{tc(p('a'))}{tc(p('') + NESTED)}{tc(p('gone'), '<w:vMerge/>')}</w:tr>"
    f"<w:tr>{tc(p('label'))}{tc(IMAGE)}</w:tr></w:tbl>"
)
BODY = (
    p("one", run="<w:b/>") + p("") + p("two", NUM.format(0)) + p("sub", NUM.format(1)) + p("sub", NUM.format(1)) + p("three", NUM.format(0)) + p("again", NUM.format(1))
    + TABLE + '<w:p><w:r><w:t xml:space="preserve">see </w:t></w:r><w:hyperlink r:id="rId2"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
)


@pytest.fixture(scope="module")
def parsed(spark):
    return ooxml.parse(spark.createDataFrame([("d", docx(BODY)), ("broken", b"no zip")], "doc_id string, content binary")).cache()


def test_docx_chunks(parsed):
    rows = ooxml.part(parsed, "chunks").orderBy("chunk_index").collect()
    assert [(r.chunk_type, r.file_name) for r in rows] == [("text", "0000_text.txt"), ("table", "0001_table.txt"), ("nested_table", "0001_table_nested_0001.txt"), ("text", "0003_text.txt")]
    assert rows[0].content.split("\n\n") == ["<strong>one</strong>", "3. two", "  3.i) sub", "  3.ii) sub", "4. three", "  4.i) again\n"]
    assert rows[3].content == "see <HL:http://x/a>link</HL>\n"


def test_docx_tables_and_cells(parsed):
    tables = {r.table_id: r for r in ooxml.part(parsed, "tables").collect()}
    assert (tables["TB000001"].row_count, tables["TB000001"].column_count) == (3, 3)
    assert (tables["TB000002"].parent_table_id, tables["TB000002"].is_nested) == ("TB000001", True)
    cells = {r.cell_id: r for r in ooxml.part(parsed, "cells").where("table_id = 'TB000001'").collect()}
    head = next(c for c in cells.values() if c.text == "head")
    merged = next(c for c in cells.values() if c.text == "c")
    assert (head.colspan, merged.rowspan, merged.col) == (2, 3, 3)  # the short last row goes on in the merged cell
    assert next(c for c in cells.values() if "<TB000002>" in c.text).nested_table_ids == ["TB000002"]
    lines = tables["TB000001"].rendered_table.split("\n")
    assert len({len(x) for x in lines}) == 1 and lines[0].startswith("+--")
    asset = ooxml.part(parsed, "assets").first()
    assert (asset.asset_id, asset.kind, asset.display_name, asset.content_type) == ("EM000001", "image", "label", "image/png")


def test_docx_errors_stay_rows(parsed):
    assert parsed.where("doc_id = 'broken'").first().error.startswith("BadZipFile")


def test_fills_and_display():
    a, b = ooxml.Cell("CL000001", "x", "#112233"), ooxml.Cell("CL000002", "y")
    g = ooxml.Grid([[a, b]], [a, b])
    assert (g.display(a), g.display(b)) == ("x [#112233]", "CL000002")
    assert [ooxml.fill(x) for x in ("auto", "abc", "A1B2C3", None, "window", "red")] == [None, "#AABBCC", "#A1B2C3", None, None, "RED"]
    blank = ooxml.Cell("CL000003", " <u> </u>")
    assert ooxml.Grid([[blank]], [blank]).render() == ooxml.EMPTY_TABLE


def test_rule_model_labels_in_order(spark):
    chunks = spark.createDataFrame([("d", 1, "b", "the scope", False), ("d", 0, "a", "a purpose", False), ("d", 2, "c", "", True)], "doc_id string, chunk_index int, file_name string, content string, skipped boolean")
    out = models.label_documents(chunks, models.RuleModel((("SEC07", ("purpose",)), ("SEC08", ("scope",))))).orderBy("chunk_index").collect()
    assert [(r.labels, r.retries, r.error) for r in out] == [(["SEC07"], 0, None), (["SEC08"], 0, None), ([], 0, None)]


@pytest.mark.parametrize("bad", ["{", "[]", '{"sections": []}', '{"sections": ["X"]}', '{"sections": "SEC01"}', '{"sections": ["SEC01"], "b": 1}', '{"sections": [1]}'])
def test_bad_answers_are_sent_back(bad):
    m = models.ReplayModel([bad, '{"sections": ["SEC02", "SEC01", "SEC02"]}'])
    got, failed = models.ask(m, [{"role": "user", "content": "x"}], models.check_labels)
    assert got == ["SEC02", "SEC01"] and len(failed) == 1 and len(m.asked[1]) == 3
    assert models.ask(models.ReplayModel([bad]), [], models.check_labels, 2)[0] is None


def test_spans_break_at_skipped_rows(spark):
    labels = [["A"], ["A"], [], ["A"], ["A", "B"], ["B"], ["SEC99"], ["SEC99"], ["B"], ["A"]]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(labels)], "doc string, idx long, labels array<string>")
    got = {(r.section, r.span_index): (r.first_row, r.last_row) for r in spans.span_table(spans.spans(df, "doc", "idx", "labels"), "doc", "idx").collect()}
    assert got == {("A", 1): (0, 1), ("A", 2): (3, 4), ("A", 3): (9, 9), ("B", 1): (4, 5), ("B", 2): (8, 8), ("SEC99", 1): (6, 6), ("SEC99", 2): (7, 7)}


def test_grid_holes_and_orphans(spark):
    cells = spark.createDataFrame([("t", 0, 0, 1, True), ("t", 0, 1, 1, False), ("t", 1, 2, 1, True), ("t", 2, 3, 2, False)], "t string, r int, pos int, span int, cont boolean")
    got = {(x.r, x.c): x.anchor for x in grid.occupancy(cells, "t", "r", "pos", "span", "cont").collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): None, (2, 0): 3, (2, 1): 3}


def cuts_by_hand(words, target=400, trigger=500, least=100):
    total, n = sum(words), len(words)
    k_max = min(-(-total // target), n)
    if total <= trigger or k_max <= 1:
        return []
    upto, out = [sum(words[: i + 1]) for i in range(n)], []
    for k in range(1, k_max):
        low = out[-1] + 1 if out else 0
        high = min(max(n - (k_max - k) - 1, low), n - 1)
        fit = [i for i in range(low, high + 1) if k < k_max - 1 or total - upto[i] >= least]
        out.append(min(fit, key=lambda i: (abs(upto[i] - total * k / k_max), i)) if fit else low)
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 450), min_size=1, max_size=12))
def test_cuts(spark, words):
    df = spark.createDataFrame([(words,)], "w array<int>")
    assert df.select(rag.cuts(F.col("w"))).first()[0] == cuts_by_hand(words)


def test_segments_keep_tables_and_first_items(spark):
    long = "label\n1. " + "a " * 300 + "\n2. " + "b " * 300
    table = "+--+\n| 1. x |\n+--+"
    df = spark.createDataFrame([(f"{long}\n\n{table}\n\n\nshort",)], "t string")
    got = df.select(rag.segments(F.col("t"))).first()[0]
    assert [x.split("\n")[0].strip()[:5] for x in got] == ["label", "2. b", "+--+", "short"] or [x[:2] for x in got] == ["la", "2.", "+-", "sh"]


def test_references_with_a_cycle(spark):
    nodes = spark.createDataFrame([("CL000001", "a CL000002 <EM000009>", True), ("CL000002", "b <TB000001> CL000001", False), ("TB000001", "t CL000077", False)], "id string, text string, is_root boolean")
    r = rag.resolve(spark, nodes).first()
    assert (r.text, r.unresolved) == ("a\nb\nt\nCL000077\n<EM000009>", ["CL000077"])


def test_hierarchy_numbers(spark):
    rows = [(0, 1), (1, None), (2, 3), (3, 2), (4, None), (5, 2), (6, 1), (7, None)]
    df = spark.createDataFrame([("d", i, lv, f"h{i}") for i, lv in rows], "d string, i long, lv int, t string")
    h = {r.i: (r.n, r.p) for r in rag.hierarchy(df, "d", "i", "lv", "t").select("i", rag.number_path(F.col("numbers")).alias("n"), rag.title_path(F.col("titles")).alias("p")).collect()}
    assert h == {0: ("01", "h0"), 1: ("01_01", "h0"), 2: ("01_01", "h0 > h2"), 3: ("01_02", "h0 > h3"), 4: ("01_02_01", "h0 > h3"), 5: ("01_03", "h0 > h5"), 6: ("02", "h6"), 7: ("02_01", "h6")}


def test_vector_limits_and_ranking(spark, tmp_path):
    row = lambda t: ("d", "n", "c", "f", "SEC01", "text", "h", t)
    cols = "document_id string, document_name string, chunk_id string, file_name string, section_id string, chunk_type string, hierarchy_path string, text string"
    df = spark.createDataFrame([row("x" * 60000), row("x" * 60001), row("é" * 30001)], cols)
    assert [r[0] for r in vectors.violations(df).select("violations").collect()] == [[], ["text", "text_bytes"], ["text_bytes"]]
    with pytest.raises(ValueError):
        vectors.ingest(df, str(tmp_path / "v"), vectors.embed(F.col("text"), 8))
    good = df.limit(1)
    assert vectors.ingest(good, str(tmp_path / "v"), vectors.embed(F.col("text"), 8)) == {"rows": 1, "recreated": False}
    assert vectors.ingest(good, str(tmp_path / "v"), vectors.embed(F.col("text"), 8))["recreated"]
    hits = spark.createDataFrame([(1, 0.0), (2, float("nan")), (3, 0.5), (4, 0.5)], "rank int, s double")
    assert [(r.rank, r.reranker_score) for r in vectors.rerank(hits, F.col("s"), 4).collect()] == [(3, 0.5), (4, 0.5), (1, 0.0), (2, None)]


def test_streams_agree_with_batches(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = progress.snapshots(s, "user_id", "event_id", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("snap").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = progress.snapshots(e, "user_id", "event_id", ["event_type"])
    assert sorted(map(tuple, spark.table("snap").collect())) == sorted(map(tuple, want.collect()))
    q = progress.windowed_counts(s, "ts", "event_type", "value", late="3650 days").writeStream.outputMode("update").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("win").groupBy("window_start", "event_type").agg(F.max("n_events").alias("n")).agg(F.sum("n")).first()[0] == e.count()


def test_plans(spark, data):
    def plan(df):
        return df._jdf.queryExecution().toString()

    emb = spark.read.parquet(f"{data}/embeddings.parquet")
    top = plan(vectors.search(emb, [0.1] * 64, only=("label", [1, 2])))
    assert "TakeOrderedAndProject" in top and "PushedFilters: [In(label" in top
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", rag.segments(F.col("text"), r"\n+").alias("s"))
    assert "Exchange" not in plan(rag.split(d, "doc_id", "s")).split("== Physical Plan ==")[1]


def test_sources_and_sinks(spark, tmp_path):
    from docloom.operators import catalog
    from docloom.sources import files

    root = tmp_path / "docs"
    for doc, names in (("a", ("other.docx", "source.docx")), ("b", ("z.docx", "y.docx"))):
        (root / doc).mkdir(parents=True)
        for n in names:
            (root / doc / n).write_bytes(docx(p("x")))
    found = ooxml.files(spark, str(root)).select("doc_id", F.substring_index("path", "/", -1).alias("n"))
    assert sorted(map(tuple, found.collect())) == [("a", "source.docx"), ("b", "y.docx")]
    assert [r.doc_id for r in files.missing(spark.createDataFrame([("a",), ("c",)], "doc_id string"), found).collect()] == ["c"]
    for n, t in (("0001_text.txt", "two"), ("0000_table.txt", "one"), ("0000_table_nested_0001.txt", "no")):
        (root / "a" / n).write_text(t)
    assert [(r.file_name, r.chunk_index) for r in files.text_chunks(spark, str(root)).orderBy("chunk_index").collect()] == [("0000_table.txt", 0), ("0001_text.txt", 1)]
    chunks = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "doc_id string, chunk_index int, content string")
    files.write_chunks(chunks, str(tmp_path / "c"))
    files.write_chunks(chunks.where("doc_id = 'a'").withColumn("content", F.lit("new")), str(tmp_path / "c"))
    assert sorted((r.doc_id, r.content) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [("a", "new"), ("b", "y")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "good.json").write_text('{"a": 1}')
    assert files.json_objects(spark, str(tmp_path / "j")).select(F.expr("variant_get(value, '$.a', 'int')")).first()[0] == 1
    (tmp_path / "j" / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="not a JSON object"):
        files.json_objects(spark, str(tmp_path / "j")).collect()
    manifest = spark.createDataFrame([("a", "1"), ("a", "2")], "doc_id string, file_name string")
    texts = spark.createDataFrame([("a", "1", "t"), ("a", "2", " ")], "doc_id string, file_name string, content string")
    assert files.manifest_texts(manifest, texts).count() == 1
    with pytest.raises(Exception, match="missing file"):
        files.manifest_texts(manifest, texts.limit(1)).collect()
    log = spark.createDataFrame([("",), ("{x",), ('{"a": 1}',), ("[1]",)], "value string")
    assert catalog.read_log(log).count() == 1
    assert files.detect_schema(["source", "chunk_file", "x"]) == "source"
    archive = files.zip_chunks(spark.createDataFrame([("a", "n.txt", "t")], "doc_id string, file_name string, content string")).first().archive
    assert zipfile.ZipFile(io.BytesIO(archive)).read("n.txt") == b"t"
    one = spark.createDataFrame([("d", "x.png", b"1")], "doc_id string, stored_name string, content binary")
    path = files.write_assets(one, str(tmp_path / "assets")).first().path
    assert open(path, "rb").read() == b"1"


def test_prompts_over_frames(spark):
    prompts = spark.createDataFrame([(1, "s", "u"), (2, "s", "u")], "id long, system string, user string")
    good = models.answer(prompts, models.ReplayModel(['{"sections": ["SEC01"]}']), models.check_labels).collect()
    assert [(r.answer, r.attempts, r.error) for r in good] == [('["SEC01"]', 1, None)] * 2
    bad = models.answer(prompts, models.ReplayModel(["{"]), models.check_labels, 2).first()
    assert bad.answer is None and bad.attempts == 2 and bad.error


def test_streaming_state_and_log(spark, tmp_path):
    rows = [(1, "a", "running", False), (1, "b", "done", False), (2, "a", "paused", False), (1, "b", "warning", True)]
    df = spark.createDataFrame(rows, "job long, step string, status string, failed boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progress.step_machine(s, "job", "step", "status").writeStream.outputMode("update").format("memory").queryName("steps").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("steps").collect())) == [(1, "a", "error"), (1, "b", "warning"), (2, "a", "paused")]
    progress.append_log(s, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_inline_html(spark):
    from docloom.operators import render

    x = '<strong>a</strong> <script>&</script>\n<HL:http://x.y/?a=1>l</HL> <HL:javascript:z>n</HL>'
    want = '<strong>a</strong> &lt;script&gt;&amp;&lt;/script&gt;<br><a href="http://x.y/?a=1">l</a> &lt;HL:javascript:z&gt;n&lt;/HL&gt;'
    assert render.inline(x) == want
    df = spark.createDataFrame([(x,)], "x string")
    assert df.select(render.inline_column(F.col("x"))).first()[0] == want


def test_export_of_sections(spark):
    import json

    from docloom.operators import export

    long = "\n\n".join("w " * 300 for _ in range(2))
    sections = [
        ("SEC02", "Document Header", "resolved", {"rows": [{"type": "data_row", "cells": ["Bank", "Policy 7"]}]}),
        ("SEC07", "Purpose", "resolved", {"section_id": "SEC07", "content": "CL000001"}),
        ("SEC08", "Scope", "resolved", {"status": "not_found"}),
        ("SEC09", "Responsibilities", "resolved", {"columns": ["Who", "What"], "rows": [{"Who": "A", "What": "x"}, {"cells": ["B", ""]}]}),
        ("SEC10", "Key References", "failed", {"content": "no"}),
        ("SEC12", "Procedures", "resolved", {"columns": ["Step", "Owner"], "entries": [{"type": "group_header", "heading": "G"}, {"type": "step", "Step": "do", "Owner": "me"}, {"type": "step", "Step": " "}, {"type": "subgroup_header", "heading": "S"}, {"type": "step", "a": "one", "b": "two"}, {"type": "content", "value": "note"}]}),
        ("SEC11", "General Instructions", "resolved", {"section_heading": "Rules", "entries": [{"type": "content", "value": "v", "values": ["u"]}, {"type": "subsection", "heading": "H", "values": [long]}, "bare"]}),
    ]
    df = spark.createDataFrame([("d", i, s, e, st_, json.dumps(j)) for i, (s, e, st_, j) in enumerate(sections)], "doc_id string, sec_no int, section_id string, section_english string, status string, section_json string")
    nodes = spark.createDataFrame([("d", "CL000001", "aim <TB000001>"), ("d", "TB000001", "| t |")], "doc_id string, id string, text string")
    names = spark.createDataFrame([("d", "x_20240101_101010")], "doc_id string, document_name string")
    rows = export.export(df, names, nodes).orderBy("file_name").collect()
    assert [r.file_name for r in rows] == [
        "0001_purpose.txt", "0002_responsibilities.txt", "0003_procedure_01_01.txt", "0004_procedure_01_01_01.txt", "0005_procedure_01_01_02.txt",
        "0006_general_instruction_01.txt", "0007_general_instruction_02.txt", "0008_general_instruction_01_01~p01.txt", "0009_general_instruction_01_01~p02.txt", "0010_general_instruction_01_02.txt",
    ]
    assert rows[0].text == "--- RAG METADATA ---\nDocument: Bank | Policy 7\nSection: Purpose\nHierarchy: Purpose\n--- END RAG METADATA ---\n\nContent:\naim\n| t |"
    assert rows[1].text.endswith("Rows:\nRow 1:\nWho: A\nWhat: x\n\nRow 2:\nWho: B")
    assert rows[2].text.endswith("Step:\ndo\n\nOwner:\nme") and rows[2].hierarchy_path == "Procedures > G"
    assert rows[3].text.endswith("Step:\none\n\nOwner:\ntwo") and rows[3].hierarchy_path == "Procedures > G > S"
    assert rows[7].hierarchy_path == "Rules > H" and rows[9].text.endswith("Instruction:\nbare")
    assert all(r.content_character_count == len(r.text) for r in rows)
    assert export.export(df, names, nodes, ("SEC07",)).count() == 1


def test_files_to_retrieval_chunks(spark, tmp_path):
    from docloom import pipeline

    steps = "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>" + "".join(f"<w:tr>{a}</w:tr>" for a in (tc(p("Step")) + tc(p("Owner")), tc(p("Part A"), '<w:gridSpan w:val="2"/>'), tc(p("open file")) + tc(p("clerk")), tc(p("close file")) + tc(p("head")))) + "</w:tbl>"
    body = p("The purpose is order.") + steps + p("...")
    parsed = ooxml.parse(spark.createDataFrame([("Policy_20240101_101010", docx(body))], "doc_id string, content binary"))
    parsed.write.parquet(str(tmp_path / "parsed"))
    out = pipeline.run(spark.read.parquet(str(tmp_path / "parsed")), models.RuleModel((("SEC07", ("purpose",)), ("SEC12", ("step",)))))
    assert [(r.labels, r.skipped) for r in out["labels"].orderBy("idx").collect()] == [(["SEC07"], False), (["SEC12"], False), ([], True)]
    rows = out["chunks"].orderBy("file_name").collect()
    assert [(r.file_name, r.hierarchy_path) for r in rows] == [("0001_purpose.txt", "Purpose"), ("0002_procedure_01_01.txt", "Procedures / Workflow Steps > Part A"), ("0003_procedure_01_02.txt", "Procedures / Workflow Steps > Part A")]
    assert rows[1].text.endswith("Step:\nopen file\n\nOwner:\nclerk") and "Document: Policy\n" in rows[1].text


def test_chunk_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    from docloom.sources import files

    for name, text in {"a/0001_text.txt": "x", "a/b/0000_table.txt": "y", "a/0002_nested_1.txt": "n", "a/_c/0003.txt": "hidden", ".d/0.txt": "hidden", "e/0.json": "{}", "top.txt": "é"}.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text, encoding="utf-8")
    monkeypatch.setattr(DataFrameReader, "load", lambda *_: pytest.fail("the driver lists no files"))
    found = files.text_chunks(spark, f"file://{tmp_path}/r").collect()
    assert sorted((r["doc_id"], r["file_name"], r["chunk_index"], r["content"]) for r in found) == [("a", "0001_text.txt", 0, "x"), ("b", "0000_table.txt", 0, "y"), ("r", "top.txt", 0, "é")]
