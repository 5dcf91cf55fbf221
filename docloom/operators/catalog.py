"""Listings of documents and their departments, logs, assets, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, name_candidates, natural_key


def history(docs: DataFrame, parts: dict[str, DataFrame], doc: str, mtime: str = "mtime") -> DataFrame:
    """Documents with a flag and a count for each kind of part, and the latest change of any; newest first."""
    out, times = docs, [F.col(mtime)]
    for name, df in parts.items():
        g = df.groupBy(doc).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max(mtime).alias(f"__{name}"))
        out = out.join(g, doc, "left").withColumn(f"has_{name}", F.col(f"n_{name}").isNotNull()).withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
        times.append(F.col(f"__{name}"))
    return out.withColumn("updated", F.greatest(*times)).drop(*(f"__{n}" for n in parts)).orderBy(F.col("updated").desc(), doc)


def departments(docs: DataFrame, by_name: DataFrame, name: str, own: str) -> DataFrame:
    """Adds departments: a document's own if it has any, else those listed under its name or its name without a run suffix."""
    keyed = docs.withColumn("__c", name_candidates(F.col(name)))
    exact = by_name.select(F.col("name").alias("__n0"), F.col("departments").alias("__d0"))
    bare = by_name.select(F.col("name").alias("__n1"), F.col("departments").alias("__d1"))
    j = keyed.join(exact, F.element_at("__c", 1) == F.col("__n0"), "left").join(bare, F.element_at("__c", -1) == F.col("__n1"), "left")
    has = lambda c: F.when(F.size(c) > 0, F.col(c))
    return j.withColumn("departments", F.coalesce(has(own), has("__d0"), has("__d1"), F.array().cast("array<string>"))).drop("__c", "__n0", "__n1", "__d0", "__d1")


def department_catalog(rows: DataFrame, value: str, source: str, order: str) -> DataFrame:
    """(department, key): spellings that differ only in case are one; the first by source, then order, stands."""
    clean = F.regexp_replace(collapse(F.col(value)), r"^[ ,;]+|[ ,;]+$", "")
    r = rows.withColumn("__v", clean).where("__v <> ''").withColumn("key", F.lower("__v"))
    return r.groupBy("key").agg(F.min_by("__v", F.struct(source, order)).alias("department"))


def search(rows: DataFrame, query: str, name: str, others: str | None = None, ascending: bool = True) -> DataFrame:
    """Rows whose name, or one of the other values, holds the query, without case; numbers in names sort by value."""
    q = query.lower()
    hit = F.contains(F.lower(name), F.lit(q))
    if others:
        hit = hit | F.exists(others, lambda x: F.contains(F.lower(x), F.lit(q)))
    key = natural_key(F.col(name))
    return rows.where(hit).withColumn("sort_key", key).orderBy(key.asc() if ascending else key.desc())


def read_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects of a log, one per line; blank lines and lines that do not parse go."""
    v = F.try_parse_json(F.col(column))
    return lines.where(F.trim(column) != "").withColumn("entry", v).where(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))


def log_filter(entries: DataFrame, stage: str | None, failed_only: bool, stage_column: str = "stage", success: str = "success") -> DataFrame:
    out = entries.where(F.col(stage_column) == stage) if stage else entries
    return out.where(~F.coalesce(F.col(success), F.lit(False))) if failed_only else out


def assets(known: DataFrame, texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, asset_id): the assets of the map and those that the JSON mentions."""
    found = texts.select(doc, F.explode(F.regexp_extract_all(F.col(text), F.lit("EM[0-9]{6}"), F.lit(0))).alias("asset_id"))
    return known.select(doc, "asset_id").union(found).distinct()


def chunk_listing(chunks: DataFrame, classified: DataFrame, key: list[str]) -> DataFrame:
    """Chunks with their labels; skipped ones are left out."""
    c = classified.select(*key, "labels", "skipped", F.lit(True).alias("classified"))
    return chunks.join(c, key, "left").where(~F.coalesce("skipped", F.lit(False))).drop("skipped")


def select_documents(wanted: DataFrame, existing: DataFrame, doc: str) -> DataFrame:
    """Wanted ids once each, in order, with what is wrong with each: unknown, or without a manifest."""
    w = wanted.groupBy(doc).agg(F.min("pos").alias("pos"))
    j = w.join(existing.select(doc, "has_manifest"), doc, "left")
    return j.withColumn("error", F.when(F.col("has_manifest").isNull(), "unknown document").when(~F.col("has_manifest"), "no manifest"))


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The table with updated rows in place of those of the same key."""
    return current.join(updates, key, "left_anti").unionByName(updates)


def asset_name(display: Column, original: Column, stored: Column, asset_id: Column) -> Column:
    """The first name that is not blank: shown, original, stored without its old id prefix, the id."""
    named = lambda c: F.when(F.trim(c) != "", c)
    name = F.coalesce(named(display), named(original), F.regexp_replace(named(stored), r"^EM[0-9]{6}_", ""), asset_id)
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[\r\n]+", " "), r"^.*/", ""))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
