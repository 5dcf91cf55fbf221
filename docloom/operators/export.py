"""Section JSON to retrieval chunks: every value is a leaf row, resolved, put in blocks, placed in its hierarchy, cut and named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, normalize, normalize_indented, slug, strip_markup, strip_run_suffix
from ..schema import FILE_PREFIXES, WORKFLOW_LEVELS
from . import grid, rag
from .storage import stored

WORKFLOWS, INSTRUCTIONS, HEADER = ("SEC12", "SEC13"), ("SEC11", "SEC18"), "SEC02"
_LEAF = "array<struct<label: string, value: string, row: int>>"
_ENTRY = f"struct<level: int, title: string, chunk_type: string, leaves: {_LEAF}>"
#: Keys of a section that are not content.
_OWN_KEYS = ("section_id", "section_heading", "columns", "header_cell_ids", "format", "status", "content", "rows", "entries")


def _array(json: Column) -> Column:
    """A JSON array as texts, values that are no texts as JSON; null if it is no array."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, "array<string>"))


def _map(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def _leaf(label: Column, value: Column, row: Column | None = None) -> Column:
    return F.struct(label.cast("string").alias("label"), value.cast("string").alias("value"), (F.lit(None) if row is None else row).cast("int").alias("row"))


def _entry(level: Column | None, title: Column | None, kind: str, leaves: Column | None) -> Column:
    null = F.lit(None)
    none = F.array().cast(_LEAF)
    return F.struct((null if level is None else level).cast("int").alias("level"), (null if title is None else title).cast("string").alias("title"), F.lit(kind).alias("chunk_type"), (none if leaves is None else leaves).cast(_LEAF).alias("leaves"))


def _without_type(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != "type")


def _level(m: Column, default: Column) -> Column:
    level = F.try_element_at(m, F.lit("level"))
    number = F.when(level.rlike(r"^[^\pL]*[0-9][^\pL]*$"), level.try_cast("int"))  # a cast that fails is slow
    return F.greatest(F.coalesce(number, default), F.lit(1))


def _workflow_columns(json: Column, listed: Column) -> Column:
    """A workflow's declared columns, else the keys of its first step with two or more."""
    declared = F.filter(F.transform(_array(F.get_json_object(json, "$.columns")), lambda c: strip_markup(c)), lambda c: c != "")
    steps = F.filter(F.transform(listed, lambda e: _map(e)), lambda m: F.try_element_at(m, F.lit("type")) == "step")
    keys = F.filter(F.transform(steps, lambda m: F.map_keys(_without_type(m))), lambda k: F.size(k) >= 2)
    own = F.coalesce(F.try_element_at(keys, F.lit(1)), F.array(F.lit("Step"), F.lit("Owner")))
    return F.transform(F.array(declared), lambda d: F.when(F.size(d) >= 2, d).otherwise(own))[0]


def _workflow(m: Column, columns: Column) -> Column:
    """A header, a step with a value for each column (by name, else by place), or content; other types are left out."""
    kind, values = F.try_element_at(m, F.lit("type")), F.map_values(_without_type(m))
    default = F.try_element_at(F.create_map(*(x for k, v in WORKFLOW_LEVELS.items() for x in (F.lit(k), F.lit(v)))), kind)
    step = _entry(None, None, "workflow_step", F.transform(columns, lambda c, i: _leaf(c, F.coalesce(F.try_element_at(m, c), F.try_element_at(values, i + 1)))))
    content = _entry(None, None, "workflow_content", F.array(_leaf(F.lit("Content"), F.try_element_at(m, F.lit("value")))))
    header = _entry(_level(m, default), F.try_element_at(m, F.lit("heading")), "header", None)
    found = F.when(default.isNotNull(), header).when(kind == "step", step).when(kind == "content", content)
    return F.array_compact(F.array(found))


def _instructions(m: Column, text: Column) -> Column:
    """A subsection as a header, and every value of an entry as an item under its heading."""
    get = lambda k: F.try_element_at(m, F.lit(k))
    kind = F.coalesce(get("type"), F.lit("content"))
    heading = F.coalesce(get("heading"), F.lit(""))
    label = F.when(heading != "", heading).when(~kind.isin("content", "subsection"), kind).otherwise("Instruction")
    own = F.array_compact(F.concat(F.array(get("value")), F.coalesce(_array(get("values")), F.array().cast("array<string>"))))
    rest = F.transform(F.map_entries(_without_type(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    has = F.map_contains_key(m, "value") | F.map_contains_key(m, "values")
    values = F.when(m.isNull(), F.array(text)).when(has, own).otherwise(F.array(F.array_join(rest, "\n")))
    items = F.transform(values, lambda v: _entry(None, None, "general_instruction", F.array(_leaf(label, v))))
    header = F.array(_entry(_level(m, F.lit(1)), heading, "header", None))
    return F.when(kind == "subsection", F.concat(header, items)).otherwise(items)


def _content(m: Column, json: Column, columns: Column) -> Column:
    """One item: content, rows (numbered), and what else the section holds."""
    get = lambda k: F.try_element_at(m, F.lit(k))
    none = F.array().cast(_LEAF)
    name = lambda i: F.coalesce(F.try_element_at(columns, i + 1), F.concat(F.lit("Column "), (i + 1).cast("string")))

    def row(text: Column, n: Column) -> Column:
        r = F.when(F.ltrim(text).startswith("{"), _map(text))
        listed = F.coalesce(_array(F.try_element_at(r, F.lit("cells"))), _array(text))
        by_place = F.transform(listed, lambda v, i: _leaf(name(i), v, n + 1))
        by_key = F.transform(F.map_entries(_without_type(r)), lambda e: _leaf(e["key"], e["value"], n + 1))
        return F.coalesce(by_place, by_key, F.array(_leaf(F.lit(""), text, n + 1))).cast(_LEAF)

    rows = F.coalesce(F.flatten(F.transform(_array(get("rows")), row)), none)
    others = F.coalesce(F.transform(F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*_OWN_KEYS)), lambda e: _leaf(e["key"], e["value"])), none)
    content = F.array(_leaf(F.lit("Content"), F.when(m.isNull(), json).otherwise(get("content"))))
    return F.array(_entry(None, None, "section_content", F.concat(content.cast(_LEAF), rows, others.cast(_LEAF))))


def entries(sections: DataFrame, include: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, sec_no, section_id, section_heading, prefix, ord, level, title, chunk_type, leaves) of resolved sections.

    sections: doc_id, sec_no, section_id, section_english, status, section_json (text). The document's header, sections
    that were not found and, if `include` is given, all others are left out. A section's JSON is read once, and each of its entries
    once, in a row of its own; ord grows with the entry and with the place in it.
    """
    json = F.col("section_json")
    s = sections.where((F.col("status") == "resolved") & (F.col("section_id") != HEADER) & (F.coalesce(F.get_json_object(json, "$.status"), F.lit("")) != "not_found"))
    if include is not None:
        s = s.where(F.col("section_id").isin(*include))
    prefix = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FILE_PREFIXES.items() for x in kv)), F.col("section_id")), slug(F.col("section_english")))
    heading = F.coalesce(F.nullif(strip_markup(F.get_json_object(json, "$.section_heading")), F.lit("")), F.col("section_english"))
    listed = F.when(F.col("section_id").isin(*WORKFLOWS, *INSTRUCTIONS), _array(F.get_json_object(json, "$.entries")))
    s = s.select("doc_id", "sec_no", "section_id", heading.alias("section_heading"), prefix.alias("prefix"), json.alias("json"), listed.alias("listed"))
    kind = F.when(F.col("listed").isNull(), "content").when(F.col("section_id").isin(*WORKFLOWS), "workflow").otherwise("instructions")
    s = s.withColumn("kind", kind).withColumn("columns", F.when(F.col("kind") == "workflow", _workflow_columns(F.col("json"), F.col("listed"))))
    # Outer, as Spark would look into what it explodes a second time, for a filter; what is empty goes afterwards.
    e = s.select("doc_id", "sec_no", "section_id", "section_heading", "prefix", "kind", "columns", F.posexplode_outer(F.coalesce("listed", F.array("json"))).alias("at", "text")).where("at is not null")
    m, text, columns = F.col("m"), F.col("text"), F.col("columns")
    e = e.withColumn("m", F.when(F.ltrim(text).startswith("{"), _map(text)))
    declared = F.coalesce(F.transform(_array(F.try_element_at(m, F.lit("columns"))), lambda c: strip_markup(c)), F.array().cast("array<string>"))
    e = e.withColumn("columns", F.when(F.col("kind") == "content", declared).otherwise(columns))
    found = F.when(F.col("kind") == "workflow", _workflow(m, columns)).when(F.col("kind") == "instructions", _instructions(m, text)).otherwise(_content(m, text, columns))
    e = e.select("doc_id", "sec_no", "section_id", "section_heading", "prefix", "at", F.posexplode_outer(found.cast(f"array<{_ENTRY}>")).alias("part", "e")).where("part is not null")
    return e.select("doc_id", "sec_no", "section_id", "section_heading", "prefix", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("part")).alias("ord"), "e.*")


def resolve_leaves(found: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Entries with the references in their values expanded; nodes (doc_id, id, text) are cells and tables by document.

    Each value with a reference is the root of its own expansion.
    """
    if nodes is None:
        return found
    spark = found.sparkSession
    leaf = found.select("doc_id", "sec_no", "ord", F.posexplode("leaves").alias("k", "leaf")).where(F.col("leaf.value").rlike(rag.REFERENCE))
    key = F.concat_ws("|", "doc_id", "sec_no", "ord", "k")
    roots = leaf.select("doc_id", key.alias("id"), F.col("leaf.value").alias("text"), F.lit(True).alias("is_root"))
    resolved = rag.resolve_by_document(spark, roots.unionByName(nodes.select("doc_id", "id", "text", F.lit(False).alias("is_root"))))
    named = leaf.select("doc_id", "sec_no", "ord", "k", key.alias("root")).join(resolved.select("doc_id", "root", "text"), ["doc_id", "root"])
    texts = named.groupBy("doc_id", "sec_no", "ord").agg(F.map_from_entries(F.collect_list(F.struct("k", "text"))).alias("texts"))
    j = found.join(texts, ["doc_id", "sec_no", "ord"], "left")
    replaced = F.transform("leaves", lambda x, i: _leaf(x["label"], F.coalesce(F.try_element_at("texts", i), x["value"]), x["row"]))
    return j.withColumn("leaves", F.when(F.col("texts").isNotNull(), replaced).otherwise(F.col("leaves"))).drop("texts")


def cell_text(cells: DataFrame) -> Column:
    """What stands for a cell: its text, else what it shows, and the nested tables that this does not name, each on a line."""
    shown = F.nullif(F.col("display_text"), F.lit("")) if "display_text" in cells.columns else F.lit(None).cast("string")
    own = F.coalesce(F.nullif(F.col("text"), F.lit("")), shown, F.lit(""))
    nested = F.coalesce("nested_table_ids", F.array().cast("array<string>")) if "nested_table_ids" in cells.columns else F.array().cast("array<string>")
    marks = F.filter(F.transform(nested, lambda t: F.concat(F.lit("<"), t, F.lit(">"))), lambda m: ~F.contains(own, m))
    return F.array_join(F.filter(F.concat(F.array(own), marks), lambda x: x != ""), "\n")


def labelled_lines(entry: Column) -> Column:
    """An entry (a map of texts) as lines of label and text, in its own order; what belongs to the section and blank texts are left out."""
    full = F.filter(F.map_entries(entry), lambda e: ~e["key"].isin("type", "section_id", "header_cell_ids") & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    label = lambda e: F.when(strip_markup(e["key"]) != "", F.concat(strip_markup(e["key"]), F.lit(": "))).otherwise("")
    return F.array_join(F.transform(full, lambda e: F.concat(label(e), F.trim(e["value"]))), "\n")


def table_texts(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, text): tables drawn from what their cells say, with references expanded and nested tables drawn in place.

    cells: doc_id, cell_id, table_id, row, col, rowspan, colspan, text, nested_table_ids. A nested table that the text
    does not name follows it. Tables are drawn before those that refer to them, level by level: one that takes in more tables comes
    later. A table that would hold itself has no text there; what is unknown stays as it is written.
    """
    spark = cells.sparkSession
    text = cell_text(cells)
    c = stored(cells.withColumn("text", text))
    own = c.select("doc_id", F.col("cell_id").alias("id"), "text")
    # What a table takes in, over all its cells: the tables on the paths of their references.
    listed = c.groupBy("doc_id", F.col("table_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("cell_id")), " ").alias("text"))
    walked = rag.walk(own.withColumn("is_root", F.lit(True)).union(listed.withColumn("is_root", F.lit(False))))
    inside = walked.select("doc_id", F.col("root").alias("cell_id"), F.explode("path").alias("t")).where(F.col("t").startswith("TB"))
    takes = c.select("doc_id", "table_id", "cell_id").join(inside, ["doc_id", "cell_id"], "left").groupBy("doc_id", "table_id").agg(F.size(F.collect_set(F.when(F.col("t") != F.col("table_id"), F.col("t")))).alias("level"), F.max(F.coalesce(F.col("t") == F.col("table_id"), F.lit(False))).alias("ring"))
    takes = stored(takes)
    known = listed.select("doc_id", F.col("id").alias("table_id"))
    drawn = None
    for (level,) in sorted(map(tuple, takes.select("level").distinct().collect())):  # as many as tables nest
        now = c.join(takes.where(F.col("level") == level).select("doc_id", "table_id"), ["doc_id", "table_id"], "left_semi")
        ready = known.withColumn("text", F.lit("")) if drawn is None else known.join(drawn, ["doc_id", "table_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
        roots = now.select("doc_id", F.col("cell_id").alias("id"))
        nodes = own.join(roots.withColumn("is_root", F.lit(True)), ["doc_id", "id"], "left").withColumn("is_root", F.coalesce("is_root", F.lit(False))).select("doc_id", "id", "text", "is_root")
        said = rag.resolve_by_document(spark, nodes.union(ready.select("doc_id", F.col("table_id").alias("id"), "text", F.lit(False).alias("is_root"))))
        shown = now.drop("text").join(said.select("doc_id", F.col("root").alias("cell_id"), "text"), ["doc_id", "cell_id"], "left")
        texts = grid.spanned(shown, ["doc_id", "table_id"], "row", "col", "rowspan", "colspan", "text", "cell_id", through=True).withColumnRenamed("rendered", "text")
        drawn = stored(texts if drawn is None else drawn.union(texts))
    return cells.select("doc_id", "table_id").distinct().withColumn("text", F.lit("")) if drawn is None else drawn


def with_body(found: DataFrame) -> DataFrame:
    """found with `body` for its leaves: blocks of those with text, rows together as `Rows`, each as its number and lines of label and value."""
    full = F.filter("leaves", lambda x: F.trim(F.coalesce(x["value"], F.lit(""))) != "")
    f = found.withColumn("__full", full).drop("leaves")
    plain = F.transform(F.filter("__full", lambda x: x["row"].isNull()), lambda x: F.struct(collapse(x["label"]).alias("label"), normalize_indented(x["value"], True).alias("value")))
    f = f.withColumn("__rows", F.filter("__full", lambda x: x["row"].isNotNull())).withColumn("__plain", plain)
    # Leaves of a row stand together: one goes on a line of its own, the first of a row after the row's number.
    begins = lambda x, i: (i == 0) | (F.get("__rows", i - 1)["row"] != x["row"])
    head = lambda x, i: F.when(begins(x, i), F.concat(F.when(i == 0, "").otherwise("\n\n"), F.lit("Row "), x["row"].cast("string"), F.lit(":\n"))).otherwise("\n")
    line = lambda x: F.when(x["label"] != "", F.concat(x["label"], F.lit(": "), x["value"])).otherwise(x["value"])
    rows = F.array_join(F.transform("__rows", lambda x, i: F.concat(head(x, i), line(x))), "")
    first = F.filter("__plain", lambda b: b["label"] == "Content")
    rest = F.filter("__plain", lambda b: b["label"] != "Content")
    block = F.when(F.size("__rows") > 0, F.array(F.struct(F.lit("Rows").alias("label"), rows.alias("value")))).otherwise(F.array().cast("array<struct<label: string, value: string>>"))
    return f.withColumn("__blocks", F.concat(first, block, rest)).withColumn("body", rag.content_body(F.col("__blocks"))).drop("__full", "__rows", "__plain", "__blocks")


def document_header(sections: DataFrame) -> DataFrame:
    """(doc_id, document_header): the rows of the first resolved header section, its cells joined by bars, else its content."""
    s = sections.where((F.col("section_id") == HEADER) & (F.col("status") == "resolved"))
    s = s.groupBy("doc_id").agg(F.min_by("section_json", "sec_no").alias("j"))
    row = lambda r: F.array_join(F.filter(F.coalesce(_array(F.get_json_object(r, "$.cells")), _array(r), F.map_values(_without_type(_map(r)))), lambda v: F.trim(v) != ""), " | ")
    rows = F.array_join(F.filter(F.transform(_array(F.get_json_object("j", "$.rows")), row), lambda x: x != ""), "\n")
    return s.select("doc_id", normalize(F.coalesce(F.nullif(rows, F.lit("")), F.get_json_object("j", "$.content"), F.lit(""))).alias("document_header"))


def export(sections: DataFrame, names: DataFrame, nodes: DataFrame | None = None, include: tuple[str, ...] | None = None) -> DataFrame:
    """Retrieval chunks of documents: file_name, chunk_id, section_id, chunk_type, hierarchy_path, text, content_character_count.

    names: doc_id, document_name (stands in for a missing header, without its run suffix). Items without text do not
    count. Files are numbered per document in order of section, entry and part.
    """
    found = entries(sections, include)
    found = with_body(found if nodes is None else resolve_leaves(stored(found), nodes))
    found = stored(found).where(F.col("level").isNotNull() | (F.col("body") != ""))  # read twice; a filter before it would make each body twice
    placed = rag.hierarchy(found.withColumn("__scope", F.struct("doc_id", "sec_no")), "__scope", "ord", "level", "title").where("level is null")
    single = F.col("chunk_type") == "section_content"
    base = F.concat(F.col("prefix"), F.when(single, "").otherwise(F.concat(F.lit("_"), rag.number_path(F.col("numbers")))))
    titles = F.concat(F.array("section_heading"), F.transform("titles", lambda t: strip_markup(t)))
    own = F.struct("doc_id", "sec_no", "ord", "section_id", "section_heading", "chunk_type", "body", base.alias("base"), rag.title_path(titles).alias("path"))
    # A body of so few characters has no more words than one part may have.
    whole = F.length("body") <= 2 * rag.TRIGGER
    parts = rag.split(placed.select(own.alias("own"), F.when(whole, F.array("body")).otherwise(rag.segments(F.col("body"))).alias("segments")), "own", "segments")
    p = parts.select("own.*", "part_num", F.col("text").alias("part"))
    h = names.join(document_header(sections), "doc_id", "left").select("doc_id", F.coalesce(F.nullif("document_header", F.lit("")), strip_run_suffix(F.col("document_name"))).alias("header"))
    p = p.join(h, "doc_id", "left")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_no", "ord", "part_num"))
    n_parts = F.max("part_num").over(Window.partitionBy("doc_id", "sec_no", "ord"))
    stem = F.concat(rag.padded(number, 4), F.lit("_"), F.col("base"))
    body = F.when(n_parts > 1, F.col("part")).otherwise(F.col("body"))
    text = F.concat(rag.metadata_header(F.coalesce("header", F.lit("")), F.col("section_heading"), F.col("path")), F.lit("\n\n"), body)
    p = p.withColumn("file_name", rag.part_name(stem, F.col("part_num"), n_parts)).withColumn("text", text).withColumn("text", normalize_indented(F.col("text"), True))
    return p.select(
        "doc_id", "file_name", F.regexp_replace("file_name", r"\.txt$", "").alias("chunk_id"), "section_id", "chunk_type", F.col("path").alias("hierarchy_path"), "text",
        F.length("text").cast("long").alias("content_character_count"),
    )
