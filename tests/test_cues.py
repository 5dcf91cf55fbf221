"""Labels by cues where evidence conflicts."""

import pytest

from docloom.operators import cues

CASES = {
    "heading": ("<strong>7. الهدف من الوثيقة</strong>\nCL000001", "SEC07", "heading"),
    "spelling": ("ضبط الاصدار", "SEC05", "heading"),
    "marks": ("المسؤُوليّات", "SEC09", "heading"),
    "longest wins": ("| النماذج المستخدمة |\n| CL000004 |", "SEC17", "heading"),
    "forms alone": ("النماذج\nCL000004", "SEC19", "heading"),
    "both in a heading": ("8 مجال التطبيق والمسؤوليات", "SEC08,SEC09", "heading"),
    "slash": ("التعريفات / المختصرات", "SEC18", "heading"),
    "control beats step columns": ("الإجراءات الرقابية\n| الخطوات | المكلف بالتنفيذ |\n| a | b |", "SEC13", "heading"),
    "step columns": ("| الخطوات | المكلف بالتنفيذ |\n| a | b |", "SEC12,SEC13", "column"),
    "columns of approval": ("+--+--+\n| الاعداد | المراجعة | الموافقة |", "SEC04", "column"),
    "one column is not all": ("| رقم الاصدار | تاريخه |", "SEC99", "none"),
    "contents": ("قائمة المحتويات\nالهدف من الوثيقة 3\nمجال التطبيق 4", "SEC06", "contents"),
    "contents without a title": ("1 الهدف من الوثيقة .... 3\n2 مجال التطبيق .... 4\n3 المسؤوليات .... 5", "SEC06", "contents"),
    "stubs are not contents": ("1 الهدف من الوثيقة\nCL000001\n2 مجال التطبيق\nCL000002\n3 المراجع\nCL000003", "SEC07,SEC08,SEC10", "heading"),
    "stubs beside a title of contents": ("جدول المحتويات\n1 الهدف من الوثيقة CL000001\n2 مجال التطبيق CL000002", "SEC07,SEC08", "heading"),
    "custom title": ("مسؤوليات قسم الحسابات\nCL000001", "SEC99", "none"),
    "keyword in a sentence": ("تطبق التعليمات العامة على كل الفروع دون استثناء", "SEC99", "none"),
    "masthead": ("EM000001", "SEC01", "masthead"),
    "title card": ("إجراءات فتح الحسابات (101)\nالحسابات", "SEC02", "masthead"),
    "both cards": ("EM000001\nإجراءات فتح الحسابات (101)", "SEC01,SEC02", "masthead"),
    "an asset in a long text": ("EM000001 " + "كلمة " * 30, "SEC99", "none"),
    "body": ("يعد الموظف كشف الحساب ثم تقرير الشهر لكل عميل", "SEC14", "body"),
    "one word is not enough": ("this is AML text", "SEC99", "none"),
    "body tie": ("AML and KYC for تقرير and كشف", "SEC99", "none"),
    "empty": ("", "SEC99", "none"),
    "null": (None, "SEC99", "none"),
    "borders": ("+---+\n|   |\n+---+", "SEC99", "none"),
}


@pytest.fixture(scope="module")
def labels(spark):
    texts = spark.createDataFrame([(k, x) for k, (x, _, _) in CASES.items()] + [(None, "النماذج")], "name string, content string")
    return {r["name"]: (",".join(r["labels"]), r["evidence"]) for r in cues.label_by_cues(texts, ["name"], "content").collect()}


@pytest.mark.parametrize("name", CASES)
def test_conflicts(labels, name):
    assert labels[name] == CASES[name][1:]


def test_edges(spark, labels):
    assert labels[None] == ("SEC19", "heading")
    assert cues.label_by_cues(spark.createDataFrame([], "name string, content string"), ["name"], "content").count() == 0
