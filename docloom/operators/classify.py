"""Labels of chunks: what to skip, what a model is told, how its answers are checked, rules instead of a model, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OTHER, SECTION_IDS
from .windows import before, ordered

#: Our own cues of the rule-based labels: (section, words).
CUES = (
    ("SEC02", ("document header", "document no")),
    ("SEC05", ("version", "edition")),
    ("SEC07", ("purpose", "objective")),
    ("SEC08", ("scope", "applies to")),
    ("SEC09", ("responsib",)),
    ("SEC10", ("reference",)),
    ("SEC12", ("procedure", "step ")),
    ("SEC13", ("control",)),
    ("SEC14", ("report",)),
    ("SEC18", ("definition", "abbreviation")),
)


def is_empty(text: Column, sentinel: str = "(empty table)") -> Column:
    """Blank, the sign of an empty table, or no letter or digit."""
    return text.isNull() | (F.trim(text) == sentinel) | ~text.rlike(r"(?U)[\p{L}\p{N}]")


def prior_context(rows: DataFrame, doc: str, order: str, name: str, labels: str, skipped: str, n: int = 8) -> DataFrame:
    """Adds seen (distinct labels of earlier rows, first-seen order) and recent (the last n earlier rows as name:labels).

    Skipped rows get a context but are in no other row's.
    """
    w = ordered([doc], [order])
    # Rows count by the shown ones before them, so that the last n of those are a range, however many skipped rows lie between.
    r = rows.withColumn("__before", F.coalesce(F.sum(F.when(F.col(skipped), 0).otherwise(1)).over(before(w)), F.lit(0)))
    shown = F.when(~F.col(skipped), F.concat(F.col(name).cast("string"), F.lit(":"), F.array_join(labels, "+")))
    recent = F.collect_list(shown).over(ordered([doc], ["__before"]).rangeBetween(-n, -1))
    # A label is seen from the row on where it stands first; a document has few labels, and a row takes those before it.
    each = rows.where(~F.col(skipped)).select(F.col(doc).alias("__doc"), F.col(order).alias("o"), F.posexplode(labels).alias("p", "label"))
    first = each.groupBy("__doc", "label").agg(F.min(F.struct("o", "p")).alias("at"))
    known = first.groupBy("__doc").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("__known"))
    r = r.withColumn("recent", recent).drop("__before").join(known, F.col(doc).eqNullSafe(F.col("__doc")), "left")
    seen = F.transform(F.filter("__known", lambda x: x["at"]["o"] < F.col(order)), lambda x: x["label"])
    return r.withColumn("seen", F.coalesce(seen, F.array().cast("array<string>"))).drop("__doc", "__known").select(*rows.columns, "seen", "recent")


def parse_labels(payload: Column, valid: tuple[str, ...] = SECTION_IDS) -> Column:
    """struct<labels, error> of a model's answer: an object with only `sections`, a list of known ids, not empty.

    Repeats go, the model's order stays.
    """
    v = F.try_parse_json(payload)
    text = F.to_json(v)
    keys = F.json_object_keys(text)
    kind = F.schema_of_variant(v)
    array = F.try_variant_get(v, "$.sections", "array<string>")
    labels = F.array_distinct(F.transform(array, lambda x: F.trim(x)))
    unknown = F.array_except(labels, F.array(*map(F.lit, valid)))
    error = (
        F.when(v.isNull(), "not JSON")
        .when(~kind.startswith("OBJECT"), "not an object")
        .when(F.array_contains(keys, "sections") == F.lit(False), "no sections")
        .when(F.size(keys) > 1, "unexpected keys")
        .when(array.isNull() | ~F.get_json_object(text, "$.sections").startswith("["), "sections is not a list of strings")
        .when(F.size(labels) == 0, "no labels")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown labels: "), F.array_join(unknown, ", ")))
    )
    return F.struct(F.when(error.isNull(), labels).alias("labels"), error.alias("error"))


def rule_labels(text: Column, cues=CUES) -> Column:
    """Labels by cues, in catalog order; the label of other text if no cue is found."""
    low = F.lower(text)
    found = F.filter(F.array(*(F.when(F.greatest(*(F.instr(low, w) for w in [*words, words[0]])) > 0, s) for s, words in cues)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit(OTHER)))


def summary(rows: DataFrame, doc: str, skipped: Column, retries: Column, failed: Column) -> DataFrame:
    """Per document: chunks, skipped and failed ones, and retries."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy(doc).agg(F.count(F.lit(1)).alias("n_chunks"), n(skipped).alias("n_skipped"), n(failed).alias("n_failed"), F.sum(retries).alias("retries"))


def apply_review(rows: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Labels after review, with what the model said and what the reviewer did.

    updates has key, sections and approved. Every row that is not skipped needs an approved update with at least one
    known label; `error` says what is wrong otherwise. Order of labels stays, repeats go.
    """
    u = updates.select(*key, F.array_distinct("sections").alias("reviewed"), "approved", F.lit(True).alias("has_update"))
    j = rows.join(u, key, "left")
    unknown = F.array_except("reviewed", F.array(*map(F.lit, SECTION_IDS)))
    error = (
        F.when(F.col("skipped"), None)
        .when(F.col("has_update").isNull(), "missing update")
        .when(~F.coalesce("approved", F.lit(False)), "not approved")
        .when(F.coalesce(F.size("reviewed"), F.lit(0)) == 0, "no labels")
        .when(F.size(unknown) > 0, "unknown label")
    )
    action = F.when(F.col("skipped"), "skipped").when(F.col("reviewed") != F.col("labels"), "modified").otherwise("confirmed")
    return j.select(
        *key, "skipped", F.col("labels").alias("llm_labels"), F.when(F.col("skipped"), F.col("labels")).otherwise(F.col("reviewed")).alias("labels"),
        action.alias("review_action"), error.alias("error"), F.array_except("reviewed", "labels").alias("added"), F.array_except("labels", "reviewed").alias("removed"),
    )


def parse_id_list(x: Column) -> Column:
    """Ids typed by a reviewer: split at commas and semicolons, upper case, known ones, in order."""
    ids = F.transform(F.split(x, "[,;]"), lambda v: F.upper(F.trim(v)))
    return F.array_distinct(F.filter(ids, lambda v: v.isin(*SECTION_IDS)))


def by_catalog(ids: Column) -> Column:
    """Ids in catalog order, unknown ones last."""
    order = F.create_map(*(y for i, x in enumerate(SECTION_IDS) for y in (F.lit(x), F.lit(i))))
    keyed = F.transform(ids, lambda x: F.struct(F.coalesce(F.try_element_at(order, x), F.lit(999)).alias("o"), x.alias("id")))
    return F.transform(F.array_sort(keyed), lambda x: x["id"])


#: What a reviewer types to accept all rows, and to give up; rows on a page.
ACCEPT, GIVE_UP, PAGE = ("", "ok", "done", "confirm", "yes", "y", "s", "save"), ("q", "quit", "exit"), 25


def review_pages(rows: DataFrame, doc: str, order: str, skipped: str = "skipped", size: int = PAGE) -> DataFrame:
    """Rows that are reviewed, with their number in the document and the page that shows it, both from 1."""
    r = rows.where(~F.coalesce(F.col(skipped), F.lit(False))).withColumn("number", F.row_number().over(ordered([doc], [order])))
    return r.withColumn("page", F.floor((F.col("number") - 1) / size).cast("int") + 1)


def replay_review(rows: DataFrame, typed: DataFrame, doc: str, order: str, at: str = "at", said: str = "said", ids: str = "ids") -> DataFrame:
    """rows (doc, order, labels, skipped) after what a reviewer typed: labels, llm_labels, review_action, human_reviewed.

    typed has for each document, in order of `at`, what was typed and for a row's number the ids for it. The last ids of a row count
    if some are known and all came before an accepting word; a word that gives up, or none, leaves all labels as they were (and
    the rows confirmed, as nobody changed them). Other words and numbers without a row do nothing.
    """
    word = F.lower(F.trim(said))
    t = typed.select(F.col(doc).alias("__doc"), F.col(at).alias("__at"), word.alias("__word"), parse_id_list(F.col(ids)).alias("__ids"))
    ends = t.where(F.col("__word").isin(*ACCEPT, *GIVE_UP)).groupBy("__doc").agg(F.min_by(F.col("__word").isin(*ACCEPT), "__at").alias("__accepted"), F.min("__at").alias("__end"))
    edits = t.join(ends.where("__accepted"), "__doc").where((F.col("__at") < F.col("__end")) & F.col("__word").rlike(r"^\d{1,9}$") & (F.size("__ids") > 0))
    edits = edits.groupBy("__doc", F.col("__word").cast("int").alias("__number")).agg(F.max_by("__ids", "__at").alias("__new"))
    numbered = review_pages(rows, doc, order).select(F.col(doc).alias("__d"), F.col(order).alias("__o"), "number")
    r = rows.join(numbered, F.col(doc).eqNullSafe(F.col("__d")) & (F.col(order) == F.col("__o")), "left")
    r = r.join(edits, (F.col(doc) == F.col("__doc")) & (F.col("number") == F.col("__number")), "left").drop("__doc").join(ends, F.col(doc) == F.col("__doc"), "left")
    new = F.coalesce("__new", "labels")
    action = F.when(F.col("number").isNull(), "skipped").when(new != F.col("labels"), "modified").otherwise("confirmed")
    return r.select(doc, order, "skipped", new.alias("labels"), F.col("labels").alias("llm_labels"), action.alias("review_action"), F.coalesce("__accepted", F.lit(False)).alias("human_reviewed"))
