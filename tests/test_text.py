import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import text_udf as U


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_collapse_sees_unicode_spaces(spark):
    assert one(spark, T.collapse, " a  \n b ", None) == ["a b", None]


def test_preview_limits(spark):
    short, long = "x" * 220, "y" * 221
    assert one(spark, T.preview, short, long) == [short, "y" * 217 + "..."]
    assert one(spark, lambda x: T.clip(x, 5), "abcde", "abcdef") == ["abcde", "abcd>"]


def test_normalize_variants(spark):
    assert one(spark, T.normalize, "\r\n a  b \r\n\r\n\r\n\tc\t\n") == ["a b\n\nc"]
    assert one(spark, T.normalize_indented, "\n  a   b  \n\n\n   \n c") == ["  a b\n\n c"]
    table = "+--+\n| a   b |\nplain   text"
    assert one(spark, lambda x: T.normalize_indented(x, True), table) == ["+--+\n| a   b |\nplain text"]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=" \t\n\rab|+", max_size=40))
def test_normalizing_twice_changes_nothing(spark, x):
    for f in (T.normalize, T.normalize_indented, lambda c: T.normalize_indented(c, True)):
        once = one(spark, f, x)
        assert one(spark, f, *once) == once


def test_mojibake(spark):
    arabic = "مرحبا"
    broken = arabic.encode().decode("latin1")
    assert one(spark, T.repair, broken, arabic, "café", "a b", " x") == [arabic, arabic, "café", "a b", "• x"]


def test_direction_boundaries(spark):
    a = "م"
    cases = {"": "ltr", "abc": "ltr", a: "rtl", a * 2 + "abcd": "rtl", "abcdefghij" * 10 + a * 44: "ltr", "abcdefghij" * 10 + a * 45: "rtl", a + "b" * 90: "rtl"}
    assert one(spark, T.dominant_direction, *cases) == list(cases.values())


def test_labels_and_colours(spark):
    assert one(spark, T.normalize_label, "<b>A / B</b>  c_1!") == ["abc_1"]
    assert one(spark, T.display_color, "a [#00ff00] b [#112233]", "none") == ["#112233", None]
    assert one(spark, T.contrast_color, "#000000", "#ffffff", "red") == ["#ffffff", "#243746", "#243746"]
    assert one(spark, T.strip_fences, '```json\n{"a": 1}\n```', " x ") == ['{"a": 1}', "x"]
    assert one(spark, T.sop_code, "SOP-0012 x", "sop 77", "SOAP 1") == ["0012", "77", ""]


def test_numbers(spark):
    df = spark.createDataFrame([(0, "upperRoman"), (1994, "upperRoman"), (27, "lowerLetter"), (703, "upperLetter"), (5, "decimalZero")], "n long, k string")
    assert [r[0] for r in df.select(T.number_label(F.col("n"), F.col("k"))).collect()] == ["0", "MCMXCIV", "aa", "AAA", "5"]


def test_natural_key_orders_numbers(spark):
    names = ["doc10", "Doc2", "doc1b", "doc01a"]
    keys = one(spark, T.natural_key, *names)
    assert sorted(names, key=dict(zip(names, keys)).get) == ["doc01a", "doc1b", "Doc2", "doc10"]


def test_departments_keep_first_spelling(spark):
    df = spark.createDataFrame([([" Risk,", "risk", "", "IT  Ops;"],)], "x array<string>")
    assert df.select(T.departments(F.col("x"))).first()[0] == ["Risk", "IT Ops"]


@pytest.mark.parametrize("a,b,want", [("", "x", 0.0), ("Owner", "owner!", 1.0), ("Step owner", "owner", 0.9), ("abcd", "abxd", 0.75)])
def test_similarity(a, b, want):
    assert U.similarity(a, b) == pytest.approx(want)


def test_plain_text(spark):
    x = "<strong>a &amp; b</strong> [#112233] <HL:http://x.y>li<u>nk</u></HL>"
    assert one(spark, U.plain_content, x)[0].split() == ["a", "&", "b", "<HL:http://x.y>link</HL>"]
    assert one(spark, U.plain_label, x) == ["a & b [link](http://x.y)"]


def test_safe_double(spark):
    assert one(spark, T.safe_double, "1.5", "NaN", "Infinity", "x", None) == [1.5, None, None, None, None]


def test_tables_of_the_same_boxes_share_their_layout():
    import time

    from docloom.functions import canvas

    boxes, start = ((0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1)), time.perf_counter()
    for n in range(20000):
        drawn = canvas.draw_boxes(boxes, 2, 3, {0: ["k1"], 1: [f"name {n}"], 2: ["a", "b"], 3: ["9"]})
    assert time.perf_counter() - start < 6
    want = ["+----+------------+", "| k1 | name 19999 |", "+    +------+-----+", "|    | a    | 9   |", "|    | b    |     |", "+----+------+-----+"]
    assert drawn == "\n".join(want)
    through = canvas.draw_boxes(boxes, 2, 3, {1: ["x"]}, through=True)
    assert through == canvas.draw(canvas.owners(boxes, 2, 3), {1: ["x"]}, True) and through.split("\n")[2] == "+---+---+---+"
