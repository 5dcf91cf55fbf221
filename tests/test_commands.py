"""Commands end to end, cuts against a plain search, drawings of resolved tables."""

import random

import pytest
from pyspark.sql import functions as F

import docloom.__main__ as commands
from docloom.operators import export, models, rag
from docloom.sources import store


def test_commands_read_what_others_wrote(spark, tmp_path):
    from test_documents import docx, p

    root = tmp_path / "docs"
    for name, text in (("a", "purpose of this"), ("b", "النماذج")):
        (root / name).mkdir(parents=True)
        table = f"<w:tbl><w:tr><w:tc>{p('الخطوات')}</w:tc><w:tc>{p('المكلف بالتنفيذ')}</w:tc></w:tr><w:tr><w:tc>{p('procedure step x')}</w:tc><w:tc>{p('clerk')}</w:tc></w:tr></w:tbl>"
        (root / name / "source.docx").write_bytes(docx(p(text) + table + p("end")))
    go = lambda *a: commands.main([a[0], *(str(tmp_path / x) for x in a[1:])])
    for command in (("parse", "docs", "parsed"), ("chunks", "docs", "chunks"), ("maps", "parsed", "maps"), ("labels", "chunks", "labels"), ("cues", "chunks", "cues"), ("headers", "parsed", "headings"), ("sections", "parsed", "sections"), ("export", "parsed", "export"), ("split", "chunks", "parts")):
        go(*command)
    read = lambda x: spark.read.parquet(str(tmp_path / x))
    assert read("parsed").count() == 2 and read("chunks").count() == 6 and read("labels").count() == 6 and read("parts").count() == 6
    labels = {(r["doc_id"], r["chunk_index"]): (r["labels"], r["evidence"]) for r in read("cues").collect()}
    assert labels["b", 0] == (["SEC19"], "heading") and labels["a", 1] == (["SEC12", "SEC13"], "column")
    kept = store.DocumentFiles({"path": str(tmp_path / "maps"), "folders": "plain"})
    assert {x.name for x in kept.reader(None).partitions()} == {"a", "b"}
    assert {r["section"] for r in read("headings").collect()} == {"SEC12"} and read("headings").where("valid_column_order is not null").count() == 2
    assert read("sections").where("section_id = 'SEC12' and section_json like '%CL000004%'").count() == 2
    assert read("export").where("section_id = 'SEC12' and text like '%clerk%'").count() == 2


def test_settings_choose_the_client():
    assert isinstance(commands.client(models.Settings.from_env({})), models.RuleModel)
    with pytest.raises(RuntimeError):
        commands.client(models.Settings.from_env({"DOCLOOM_BASE_URL": "http://127.0.0.1:9", "DOCLOOM_MODEL": "m"}))


def cuts_by_hand(words, target, trigger, least):
    total, n, out = sum(words), len(words), []
    parts = min(-(-total // target), n)
    if total <= trigger:
        return []
    for k in range(1, parts):
        low = out[-1] + 1 if out else 0
        high = min(max(n - (parts - k) - 1, low), n - 1)
        fit = [i for i in range(low, high + 1) if k < parts - 1 or total - sum(words[: i + 1]) >= least]
        out.append(min(fit, key=lambda i: (abs(sum(words[: i + 1]) - total * k / parts), i), default=low))
    return out


def test_cuts_equal_a_plain_search(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0, 0, 1, 5, 40, 200]) for _ in range(rng.randint(0, 30))]) for i in range(400)] + [(400, None), (401, [700]), (402, [0] * 9 + [600])]
    got = spark.createDataFrame(rows, "id int, words array<int>").select("id", rag.cuts(F.col("words"), 40, 50, 10).alias("c")).collect()
    for r in got:
        assert r["c"] == cuts_by_hand(rows[r["id"]][1] or [], 40, 50, 10), rows[r["id"]]
    assert len(rag.cut_places([3] * 100_000, 400, 500, 100)) == 749


def test_tables_in_rings_and_over_spans(spark):
    kind = "doc_id string, cell_id string, table_id string, row int, col int, rowspan int, colspan int, text string, nested_table_ids array<string>"
    rows = [
        ("d", "CL000001", "TB000001", 1, 1, 2, 1, "a", []), ("d", "CL000002", "TB000001", 1, 2, 1, 1, "see CL000009", []), ("d", "CL000003", "TB000001", 2, 2, 1, 1, None, None),
        ("d", "CL000004", "TB000002", 1, 1, 1, 1, "<TB000003> b", []), ("d", "CL000005", "TB000003", 1, 1, 1, 1, "c", ["TB000002"]), ("e", "CL000001", "TB000001", 1, 1, 1, 1, "other", []),
    ]
    got = {(r["doc_id"], r["table_id"]): r["text"] for r in export.table_texts(spark.createDataFrame(rows, kind)).collect()}
    assert got["d", "TB000001"] == "+---+----------+\n| a | see      |\n|   | CL000009 |\n+---+----------+\n|   |          |\n+---+----------+"
    assert got["e", "TB000001"] == "+-------+\n| other |\n+-------+"
    assert set(got) == {("d", "TB000001"), ("d", "TB000002"), ("d", "TB000003"), ("e", "TB000001")} and "c" in got["d", "TB000003"] and "b" in got["d", "TB000002"]
    assert export.table_texts(spark.createDataFrame([], kind)).count() == 0
