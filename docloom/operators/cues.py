"""Section labels by cues: headings, column titles and words of a text, matched all at once and weighed by kind.

Texts are cut into lines and cells; runs of their words meet the cue table in one broadcast join. Of the runs found in
a cell the longest win, and of the kinds of evidence in a text the strongest: a heading that fills a cell, then a line
that has all column titles of a known order, then words of the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_markup
from ..schema import HEADERS, OTHER

#: Headings of sections; a text may have them with numbers, and joined by "and".
HEADINGS = (
    ("SEC03", "ضبط الوثيقة"), ("SEC04", "إقرار الوثيقة"), ("SEC05", "ضبط الإصدار"), ("SEC06", "قائمة المحتويات"), ("SEC06", "جدول المحتويات"), ("SEC07", "الهدف من الوثيقة"),
    ("SEC08", "مجال التطبيق"), ("SEC09", "المسؤوليات"), ("SEC10", "المراجع الرئيسية"), ("SEC10", "المراجع"), ("SEC11", "التعليمات العامة"), ("SEC12", "الإجراء"),
    ("SEC12", "الإجراءات"), ("SEC13", "الإجراءات الرقابية"), ("SEC14", "التقارير والكشوفات"), ("SEC15", "الملفات ومدد الحفظ"), ("SEC16", "الملاحق"), ("SEC17", "النماذج المستخدمة"),
    ("SEC18", "التعريفات"), ("SEC18", "المختصرات"), ("SEC18", "المصطلحات"), ("SEC19", "النماذج"),
)
#: Words in the body of sections.
BODY = (
    ("SEC09", "موظف"), ("SEC09", "مدير"), ("SEC09", "رئيس"), ("SEC11", "تعليمات الامتثال"), ("SEC11", "تعليمات حسابات القصر"), ("SEC14", "تقرير"), ("SEC14", "كشف"), ("SEC14", "قائمة"),
    ("SEC16", "ملحق"), ("SEC17", "استمارة"), ("SEC17", "نموذج طلب"), ("SEC18", "KYC"), ("SEC18", "AML"), ("SEC18", "FATCA"), ("SEC18", "BPM"), ("SEC18", "T24"),
)
CONTENTS, MASTHEAD, TITLE_CARD = "SEC06", "SEC01", "SEC02"
#: Listed sections that make a table of contents, headings with cells of their own that make none, body cues that make a section.
LISTED, STUBS, BODY_CUES = 3, 2, 2


def normalized(text: Column) -> Column:
    """Lower case without markup and Arabic marks; forms of alef, ya and ta marbuta are one."""
    plain = F.regexp_replace(strip_markup(text), "[ً-ٰٟـ]", "")
    return F.lower(F.translate(plain, "أإآٱىة", "اااايه"))


def words(text: Column) -> Column:
    """The words of a normalized text: runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def cue_table(spark: SparkSession, headings=HEADINGS, columns=HEADERS, body=BODY) -> DataFrame:
    """(phrase, first, n, section, kind, known, titles): a row per cue; known numbers an order of column titles, titles counts them."""
    rows = [("heading", s, x, None, None) for s, x in headings] + [("body", s, x, None, None) for s, x in body]
    rows += [("column", s, x, i, len(set(order))) for i, (s, order) in enumerate(columns) for x in order]
    cues = spark.createDataFrame(rows, "kind string, section string, cue string, known int, titles int")
    parts = cues.withColumn("words", words(normalized(F.col("cue"))))
    return parts.select(F.array_join("words", " ").alias("phrase"), F.get("words", F.lit(0)).alias("first"), F.size("words").alias("n"), "section", "kind", "known", "titles").distinct()


def found_cues(texts: DataFrame, key: list[str], text: str, cues: DataFrame) -> DataFrame:
    """A row per cell of a text in which cues stand: key, line, n_words, listed (a page number ends it), coded (a cell id stands in this line or the next), found."""
    known = cues.agg(F.collect_set("first").alias("firsts"), F.max("n").alias("longest")).first()  # bounded by the cue table
    lines = texts.select(*key, F.split(text, "\n").alias("lines")).select(*key, "lines", F.posexplode("lines").alias("line", "raw"))
    code = r"\bCL\d{6}\b"
    coded = F.col("raw").rlike(code) | F.coalesce(F.get("lines", F.col("line") + 1).rlike(code), F.lit(False))
    cells = lines.select(*key, "line", coded.alias("coded"), F.posexplode(F.split("raw", r"\|")).alias("cell", "raw")).withColumn("tokens", words(normalized(F.col("raw"))))
    said = F.filter("tokens", lambda x: ~x.rlike(r"^(?:\p{N}+|(?:cl|em|tb)\d{6})$"))
    bare = F.transform(said, lambda x: F.regexp_replace(x, r"^و(?=ال)", ""))  # "and" is written on to a word
    # Cue phrases are made of words as they stand, and of those without the "and" in front of the first.
    rows = cells.select(*key, "line", "cell", "coded", said.alias("words"), bare.alias("bare"), F.coalesce(F.element_at("tokens", -1).rlike(r"^\p{N}+$"), F.lit(False)).alias("listed")).where(F.size("words") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(F.lit(known["firsts"]), F.get("bare", i)) | F.array_contains(F.lit(known["firsts"]), F.get("words", i)))
    at = rows.select(*key, "line", "cell", "coded", "listed", "words", "bare", F.explode(starts).alias("i"))
    runs = at.select(*key, "line", "cell", "coded", "listed", "words", "bare", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(known["longest"]), F.size("words") - F.col("i")))).alias("n"))
    rest = F.slice("words", F.col("i") + 2, F.col("n") - 1)
    phrase = lambda first: F.array_join(F.concat(F.array(F.get(first, F.col("i"))), rest), " ")
    runs = runs.select(*key, "line", "cell", "coded", "listed", F.size("words").alias("n_words"), "i", "n", F.explode(F.array_distinct(F.array(phrase("words"), phrase("bare")))).alias("phrase"))
    hits = runs.join(F.broadcast(cues.drop("first", "n")), "phrase")
    return hits.groupBy(*key, "line", "cell").agg(*(F.first(c).alias(c) for c in ("n_words", "listed", "coded")), F.collect_list(F.struct("i", "n", "phrase", "section", "kind", "known", "titles")).alias("found"))


def evidence(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, headings, listed, stubs, columns, body): sections by kind of evidence; stubs counts headings with a cell of their own."""
    # A cue inside a longer one of its kind does not count: "forms" in "forms used".
    free = F.filter("found", lambda x: ~F.exists("found", lambda y: (y["kind"] == x["kind"]) & (y["n"] > x["n"]) & (y["i"] <= x["i"]) & (y["i"] + y["n"] >= x["i"] + x["n"])))
    c = cells.select(*key, "line", "cell", "n_words", "listed", "coded", free.alias("found"))
    covered = F.array_distinct(F.flatten(F.transform(F.filter("found", lambda x: x["kind"] == "heading"), lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1))))
    c = c.withColumn("filled", F.size(covered) == F.col("n_words")).select(*key, "line", "n_words", "listed", "coded", "filled", F.explode("found").alias("x"))
    title = (F.col("x.kind") == "column") & (F.col("x.n") == F.col("n_words"))
    lines = c.groupBy(*key, "line", "x.section", "x.known").agg(
        F.size(F.collect_set(F.when(title, F.col("x.phrase")))).alias("seen"), F.max("x.titles").alias("titles"), F.max(F.when((F.col("x.kind") == "heading") & F.col("filled"), F.struct("listed", "coded"))).alias("heading"),
        F.collect_set(F.when(F.col("x.kind") == "body", F.col("x.phrase"))).alias("body"),
    )
    head, listed = F.col("heading").isNotNull(), F.col("heading.listed") & ~F.col("heading.coded")
    section = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("section"))))
    body = lines.groupBy(*key, "section").agg(
        F.max(head & ~listed).alias("head"), F.max(listed).alias("listed"), F.max(F.col("heading.coded")).alias("stub"), F.max(F.col("seen") >= F.col("titles")).alias("column"),
        F.size(F.array_distinct(F.flatten(F.collect_list("body")))).alias("n_body"),
    )
    return body.groupBy(*key).agg(
        section(F.col("head")).alias("headings"), section(F.col("listed")).alias("listed"), F.sum(F.coalesce(F.col("stub"), F.lit(False)).cast("int")).alias("stubs"), section(F.col("column")).alias("columns"),
        F.array_sort(F.collect_list(F.when(F.col("n_body") >= BODY_CUES, F.struct((-F.col("n_body")).alias("n"), "section")))).alias("body"),
    )


def label_by_cues(texts: DataFrame, key: list[str], text: str, cues: DataFrame | None = None) -> DataFrame:
    """(key, labels, evidence): sections of every text in order of the catalog, and the kind of evidence that decided.

    contents: a table of contents is that alone, unless several headings have cells of their own; heading: headings
    stand for themselves, columns and words do not count beside them; masthead: an asset mark makes the masthead, a
    number in brackets after a title the title card; column: a line with all titles of a known order; body: the section of
    most distinct words, of two at least, if there is one. Otherwise the label is that of other text (none). Null and
    empty texts have no cues. A key stands for one text; an empty table gives an empty result.
    """
    cues = cue_table(texts.sparkSession) if cues is None else cues
    plain = normalized(F.coalesce(F.col(text), F.lit("")))
    em, card = F.col(text).rlike(r"\bEM\d{6}\b"), plain.rlike(r"(?:^|[^\p{L}])(?:ال)?اجراءات [^\n|]*[|\s]*\(\s*\p{N}{2,4}\s*\)")
    marks = texts.select(*key, F.coalesce(em, F.lit(False)).alias("em"), F.coalesce(card, F.lit(False)).alias("card"), (F.size(words(plain)) <= 12).alias("short"))
    found = evidence(found_cues(texts, key, text, cues), key)
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    j = marks.alias("m").join(found.alias("f"), on, "left")
    none = F.array().cast("array<string>")
    heads, columns = F.coalesce("headings", none), F.coalesce("columns", none)
    stubs = F.coalesce("stubs", F.lit(0)) >= STUBS
    contents = ~stubs & (F.array_contains(heads, CONTENTS) | (F.size(F.coalesce("listed", none)) >= LISTED))
    heads = F.array_remove(heads, CONTENTS)
    one, two = F.get("body", F.lit(0)), F.get("body", F.lit(1))
    best = F.when(one.isNotNull() & (two.isNull() | (two["n"] > one["n"])), F.array(one["section"]))
    masthead = F.array_compact(F.array(F.when(F.col("em") & (F.col("card") | F.col("short")), F.lit(MASTHEAD)), F.when(F.col("card"), F.lit(TITLE_CARD))))
    # The first kind of evidence that names a section decides.
    arms = (("contents", F.when(contents, F.array(F.lit(CONTENTS)))), ("heading", F.when(F.size(heads) > 0, heads)), ("masthead", F.when(F.size(masthead) > 0, masthead)), ("column", F.when(F.size(columns) > 0, columns)), ("body", best), ("none", F.array(F.lit(OTHER))))
    decided = F.coalesce(*(F.when(labels.isNotNull(), F.struct(labels.alias("labels"), F.lit(kind).alias("evidence"))) for kind, labels in arms))
    return j.select(*(F.col(f"m.{k}").alias(k) for k in key), decided.alias("x")).select(*key, "x.labels", "x.evidence")
