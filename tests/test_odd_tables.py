"""Queries against their SQL on small tables of odd rows."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.operators import rag
from test_queries import rows


@pytest.fixture
def same(spark, tmp_path):
    """Checks a query against its SQL over tables given as DuckDB selects."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
            con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
        got, want = entry.queries()[name](spark, str(tmp_path)), con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        found = rows(got.columns, [tuple(r) for r in got.collect()])
        assert found and found == rows(columns, want.fetchall())

    return run


def test_prompt_whose_text_says_leave(same):
    same("sec_prompt", documents="select * from (values (1::bigint, 'they leave early', 'a'), (2, 'x', 'b'), (3, 'Leave', 'c')) t(doc_id, text, source)")


#: Words that cancel in 64 and in 16 places, white space of several kinds.
_BLANKS = "select * from (values (1::bigint, 'aab aca', 'a'), (2, 'aaa acd', 'a'), (3, chr(9) || chr(10), 'b'), (4, '  ', 'b'), (5, chr(160) || ' ', 'b'), (6, '', 'c'), (7, 'one word', 'c')) t(doc_id, text, source)"


def test_hashed_words_that_cancel_leave_a_vector(same):
    same("vec_hash_embed", documents=_BLANKS)


def test_ingested_words_that_cancel_leave_a_vector(same):
    same("vec_ingest_table", documents=f"{_BLANKS} union all select 8, null, 'd'")


def test_numbers_of_more_than_two_and_four_digits_stay_whole(spark, same):
    same("rag_export_instructions", nation="select 7::int as n_nationkey, 'N' as n_name", customer="select i::bigint as c_custkey, 7::int as c_nationkey, 'c' || i as c_name, 'm' || i as c_mktsegment from range(1, 121) r(i)")
    numbers = spark.range(1).select(*(rag.padded(F.lit(x), 4).alias(str(x)) for x in (7, 1234, 12345, 123456))).first()
    assert list(numbers) == ["0007", "1234", "12345", "123456"]


def exported(spark, section, english, text):
    """Seconds and (file_name, text) of one document of one section."""
    import time

    from docloom.operators import export

    start = time.perf_counter()
    df = spark.createDataFrame([("d", 1, section, english, "resolved", text)], "doc_id string, sec_no int, section_id string, section_english string, status string, section_json string")
    out = export.export(df, spark.createDataFrame([("d", "Name")], "doc_id string, document_name string")).orderBy("file_name").select("file_name", "text").collect()
    return time.perf_counter() - start, [tuple(r) for r in out]


def test_time_of_a_workflow_grows_with_its_entries(spark):
    entries = [{"type": "group_header", "heading": "H", "level": "deep"}] + [{"type": "step", "Do": f"do {i}", "Who": "me"} for i in range(6000)]
    seconds, out = exported(spark, "SEC12", "Procedures", json.dumps({"entries": entries, "columns": ["<u>Do</u>", "Who"]}))
    assert len(out) == 6000 and out[1234][0].startswith("1235_procedure_01_1235") and out[1234][1].endswith("Do:\ndo 1234\n\nWho:\nme")
    assert seconds < 120


def test_time_of_a_content_grows_with_its_rows(spark):
    rows = [[f"a{i}", f"b{i}"] for i in range(6000)]
    seconds, out = exported(spark, "SEC07", "Purpose", json.dumps({"content": "c", "columns": ["A", "B"], "rows": rows}))
    text = "\n\n".join(t.split("--- END RAG METADATA ---\n\n")[1] for _, t in out)
    assert text == "Content:\nc\n\nRows:\n" + "\n\n".join(f"Row {i + 1}:\nA: a{i}\nB: b{i}" for i in range(6000))
    assert seconds < 120


def test_time_of_instructions_grows_with_their_number(spark):
    entries = [{"type": "subsection", "level": "1", "heading": f"h{i}", "values": [f"v{i}", f"w{i}"]} for i in range(6000)]
    seconds, out = exported(spark, "SEC11", "General Instructions", json.dumps({"entries": entries}))
    assert len(out) == 12000 and max(out)[1].endswith("h4999:\nv4999") and ("12000_general_instruction_6000_02.txt" in dict(out))
    assert seconds < 120
