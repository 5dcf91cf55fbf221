"""Retrieval export: references resolved, hierarchies numbered, texts cut into balanced parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import REFERENCE, is_grid_line, word_count
from .storage import stored
from .windows import before, ordered, previous_smaller

TARGET, TRIGGER, LEAST = 400, 500, 100


def tokens(text: Column) -> Column:
    """References of a text in order: cells, tables in angle brackets, assets in angle brackets."""
    return F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))


def pieces(text: Column) -> Column:
    """array<struct<text, is_ref>>: a text cut at its references, which are kept; empty pieces go."""
    between = F.split(text, REFERENCE, -1)
    zipped = F.arrays_zip(between.alias("t"), tokens(text).alias("r"))
    pairs = F.transform(zipped, lambda x: F.array(F.struct(x["t"].alias("text"), F.lit(False).alias("is_ref")), F.struct(x["r"].alias("text"), F.lit(True).alias("is_ref"))))
    return F.filter(F.flatten(pairs), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def walk(nodes: DataFrame) -> DataFrame:
    """(doc_id, root, node, path, place, text, state): the leaves below each root node, of nodes (doc_id, id, text, is_root).

    References are followed level by level within a document, each level a join on the node's id. A node that is on its own
    path is a cycle and gives no text; state is text, asset, unresolved (no such node) or cycle, node the one that the
    leaf is written in. Paths only grow and hold a node once, so that the levels end; each is a written table, and there is no bound on depth or rows.
    """
    n = nodes.select("doc_id", "id", F.posexplode(pieces(F.col("text"))).alias("pos", "p")).select("doc_id", "id", "pos", "p.text", "p.is_ref")
    target = F.when(F.col("is_ref") & ~F.col("text").startswith("<EM"), F.regexp_replace("text", "[<>]", ""))
    known = nodes.select(F.col("doc_id").alias("__doc"), F.col("id").alias("__known")).distinct()
    n = n.withColumn("target", target)
    n = n.join(known, (F.col("doc_id") == F.col("__doc")) & (F.col("target") == F.col("__known")), "left")
    n = stored(n.select(F.col("doc_id").alias("__doc"), F.col("id").alias("__id"), "pos", "text", "target", F.col("__known").isNotNull().alias("there")))
    on_path = F.array_contains("path", F.col("target"))
    state = (
        F.when(F.col("target").isNull(), F.when(F.col("text").startswith("<EM"), "asset").otherwise("text"))
        .when(~F.col("there"), "unresolved").when(on_path, "cycle").otherwise("open")
    )
    front = nodes.where("is_root").select("doc_id", F.col("id").alias("root"), F.col("id").alias("node"), F.array("id").alias("path"), F.expr("cast(array() as array<int>)").alias("place"))
    leaves = None
    while True:
        step = front.join(n, (F.col("doc_id") == F.col("__doc")) & (F.col("node") == F.col("__id"))).withColumn("state", state)
        step = stored(step.select("doc_id", "root", "node", "path", F.concat("place", F.array("pos")).alias("place"), F.coalesce("target", "text").alias("text"), "state"))
        done = step.where("state <> 'open'")
        leaves = done if leaves is None else leaves.union(done)
        front = step.where("state = 'open'").select("doc_id", "root", F.col("text").alias("node"), F.concat("path", F.array("text")).alias("path"), "place")
        if not front.take(1):
            return leaves


def in_place(value: Column) -> Column:
    """Aggregates the values of leaves into an array in the order of their places, arrays of numbers, of any size and depth."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("place").alias("o"), value.alias("v")))), lambda x: x["v"])


def resolve(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """resolve_by_document() for nodes of one document: (root, text, used, unresolved)."""
    return resolve_by_document(spark, nodes.withColumn("doc_id", F.lit(0))).drop("doc_id")


def resolve_by_document(spark: SparkSession, nodes: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(doc_id, root, text, used, unresolved): the text of each root node with its references expanded.

    nodes has doc_id, id, text and is_root. References expand depth first in the order of the text, to any depth: a node
    that is on its own path gives no text, an unknown cell or table stays as it is written and is unresolved, assets
    always stay; with a table of assets (doc_id, asset_id) those it lacks are unresolved too.
    """
    found = walk(nodes)
    bare = F.regexp_replace("text", "[<>]", "")
    lost = F.when(F.col("state") == "unresolved", F.col("text"))
    if assets is not None:
        known = assets.select(F.col("doc_id").alias("__doc"), F.col("asset_id").alias("__asset")).distinct()
        found = found.join(known, (F.col("doc_id") == F.col("__doc")) & (bare == F.col("__asset")), "left")
        lost = F.when((F.col("state") == "unresolved") | ((F.col("state") == "asset") & F.col("__asset").isNull()), bare)
    text = F.when(F.col("state") != "cycle", F.trim("text"))
    parts = F.filter(in_place(text), lambda t: F.coalesce(t, F.lit("")) != "")
    return found.groupBy("doc_id", "root").agg(
        F.array_join(parts, "\n").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("path")))).alias("used"), F.array_sort(F.collect_set(lost)).alias("unresolved")
    )


def hierarchy(entries: DataFrame, doc: str, order: str, level: str, title: str, depth: int | None = None) -> DataFrame:
    """Entries with their header (head), number path (numbers) and title path (titles); level is null for items, 1 or more for headers.

    Levels may be any numbers: in each document they count by their order among its own, so that the plan has as many
    steps as a document has different levels. depth is the most of these; without one it is looked up.

    The stack of open headers at an entry: for each smaller level the last header before it, if that is later than
    those of all smaller levels. A header's parent is the last of its stack. Headers are numbered under their parent,
    items under their header. Only windows: one running maximum per level, no recursion and no join.
    """
    if depth is None:
        depth = max(1, int(entries.groupBy(doc).agg(F.count_distinct(level).alias("n")).agg(F.max("n")).first()[0] or 1))
    w = ordered([doc], [order])
    is_head = F.col(level).isNotNull()
    given, level = level, "__level"
    e = entries.withColumn(level, F.when(is_head, F.dense_rank().over(Window.partitionBy(doc, is_head).orderBy(given))))
    is_head = F.col(level).isNotNull()
    e = e.withColumn("__parent", F.when(is_head, previous_smaller(F.col(level), F.col(order), w, depth + 1)))
    e = e.withColumn("__number", F.when(is_head, F.row_number().over(Window.partitionBy(doc, is_head, "__parent").orderBy(order))))
    me = F.struct(F.col(order).alias("o"), F.col(title).alias("t"), F.col("__number").alias("n"))
    last = [F.max(F.when(F.col(level) == k, me)).over(before(w)) for k in range(1, depth + 1)]
    e = e.withColumn("__last", F.array(*last))
    below = F.transform("__last", lambda x, i: F.when(~is_head | (i + 1 < F.col(level)), x))
    e = e.withColumn("__last", below)
    open_ = F.filter("__last", lambda x, i: x.isNotNull() & F.forall(F.slice("__last", F.lit(1), i), lambda y: y.isNull() | (y["o"] < x["o"])))
    e = e.withColumn("__open", F.when(is_head, F.concat(open_, F.array(me))).otherwise(open_))
    e = e.withColumn("head", F.try_element_at("__open", F.lit(-1))["o"])
    item = F.row_number().over(Window.partitionBy(doc, "head", is_head).orderBy(order))
    e = e.withColumn("item", F.when(~is_head, item))
    numbers = F.transform("__open", lambda x: x["n"])
    e = e.withColumn("numbers", F.when(is_head, numbers).otherwise(F.concat(numbers, F.array("item")))).withColumn("titles", F.transform("__open", lambda x: x["t"]))
    return e.drop("__level", "__parent", "__number", "__last", "__open")


def padded(number: Column, width: int) -> Column:
    """A number with zeros before it up to a width; longer ones stay whole, which lpad would cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def number_path(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: padded(F.greatest(x, F.lit(0)), 2)), "_")


def title_path(titles: Column) -> Column:
    return F.array_join(F.filter(F.transform(titles, lambda x: F.trim(x)), lambda x: x != ""), " > ")


def segments(text: Column, boundary: str = r"\n\n+", trigger: int = TRIGGER) -> Column:
    """The atomic segments of a body: cut at blank lines; drawn tables are whole; long others are cut before numbered items.

    A first item stays with the lines before it. The item rule marks item lines but the first with a character that
    cuts, so that it needs no fold.
    """

    def items(seg: Column) -> Column:
        lines = F.split(seg, "\n")
        hit = lambda x: x.rlike(r"^\s*[0-9]+\.\s")
        first = F.array_position(F.transform(lines, hit), True)
        marked = F.transform(lines, lambda x, i: F.when(hit(x) & (i + 1 > first), F.concat(F.lit("\0"), x)).otherwise(x))
        return F.filter(F.split(F.array_join(marked, "\n"), "\n?\0"), lambda x: F.trim(x) != "")

    trimmed = F.filter(F.transform(F.split(text, boundary), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    # More words than the trigger need more than twice as many characters: most segments need no count.
    return F.flatten(F.transform(trimmed, lambda x: F.when((F.length(x) > 2 * trigger) & ~is_grid_line(F.substring_index(x, "\n", 1)) & (word_count(x) > trigger), items(x)).otherwise(F.array(x))))


def cut_places(words: np.ndarray, target: int, trigger: int, least: int) -> list[int]:
    """cuts() of one body: running totals once, and each cut by a binary search among them."""
    upto = np.cumsum(words)
    n, total = len(words), int(upto[-1]) if len(words) else 0
    parts = min(-(-total // target), n)
    out: list[int] = []
    if total <= trigger:
        return out
    for k in range(1, parts):
        low = out[-1] + 1 if out else 0
        high = min(max(n - (parts - k) - 1, low), n - 1)
        if k == parts - 1:  # the last part keeps `least` words, if any place leaves them
            high = min(high, int(np.searchsorted(upto, total - least, "right")) - 1)
        if high < low:
            out.append(low)
            continue
        ideal = total * k / parts
        after = min(max(int(np.searchsorted(upto, ideal)), low), high)
        best = min((x for x in (after - 1, after) if x >= low), key=lambda x: (abs(int(upto[x]) - ideal), x))
        out.append(max(low, int(np.searchsorted(upto, upto[best]))))  # the first of those with the same total
    return out


def cuts(words: Column, target: int = TARGET, trigger: int = TRIGGER, least: int = LEAST) -> Column:
    """After which segments (from 0) to cut, given the words of each; empty if the body is short enough.

    Parts are as many as the target asks for, or segments there are. Cut k goes after the segment whose running total
    is nearest to k shares, the first of equal ones, after the cut before and with a segment left for each later part.
    The last cut leaves at least `least` words if it can. Counts alone go to Python, in Arrow batches; time grows with their number.
    """

    def run(many: pa.Array) -> pa.Array:
        counts = many.values.to_numpy(zero_copy_only=False) if len(many.values) else np.zeros(0, int)
        ends = many.offsets.to_numpy()
        return pa.array([cut_places(counts[a:b], target, trigger, least) for a, b in zip(ends, ends[1:])], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(F.coalesce(words, F.array().cast("array<int>")))


def split(docs: DataFrame, key: str, segs: str) -> DataFrame:
    """(key, part_num, n_words, text): the parts of each body, of which segs are the segments."""
    d = docs.withColumn("__words", F.transform(segs, lambda s: word_count(s).cast("int"))).withColumn("__cuts", cuts(F.col("__words")))
    ends = F.concat("__cuts", F.array(F.size(segs) - 1))
    d = d.select(key, segs, "__words", F.posexplode(ends).alias("k", "end"), F.col("__cuts").alias("c"))
    d = d.withColumn("begin", F.when(F.col("k") > 0, F.try_element_at("c", F.col("k")) + 1).otherwise(F.lit(0)))
    size = F.col("end") - F.col("begin") + 1
    part = F.slice(segs, F.col("begin") + 1, size)
    words = F.aggregate(F.slice("__words", F.col("begin") + 1, size), F.lit(0), lambda a, b: a + b)
    return d.where("end >= 0").select(key, (F.col("k") + 1).alias("part_num"), words.alias("n_words"), F.array_join(part, "\n\n").alias("text"))


def part_name(stem: Column, part: Column, parts: Column, suffix: str = ".txt") -> Column:
    """The file name of a part; a body in one part keeps its plain name."""
    return F.when(parts > 1, F.concat(stem, F.lit("~p"), padded(part, 2), F.lit(suffix))).otherwise(F.concat(stem, F.lit(suffix)))


def unique_names(rows: DataFrame, scope: list[str], order: list[str], base: str) -> DataFrame:
    """Adds file_name: a four-digit number in order, and the base name, with _02 and so on where it repeats."""
    number = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    again = F.row_number().over(Window.partitionBy(*scope, base).orderBy(*order))
    name = F.concat(F.col(base), F.when(again > 1, F.concat(F.lit("_"), F.lpad(again.cast("string"), 2, "0"))).otherwise(""))
    return rows.withColumn("file_name", F.concat(F.lpad(number.cast("string"), 4, "0"), F.lit("_"), name))


def metadata_header(document: Column, section: Column, path: Column) -> Column:
    one_line = F.trim(F.regexp_replace(document, r"(?U)\s+", " "))
    return F.concat_ws("\n", F.lit("--- RAG METADATA ---"), F.trim(F.concat(F.lit("Document: "), one_line)), F.concat(F.lit("Section: "), section), F.concat(F.lit("Hierarchy: "), path), F.lit("--- END RAG METADATA ---"))


def content_body(blocks: Column) -> Column:
    """Text of array<struct<label, value>>: each with text as its label and a colon, its value, and a blank line."""
    full = F.filter(blocks, lambda b: F.trim(b["value"]) != "")
    return F.array_join(F.transform(full, lambda b: F.when(F.trim(b["label"]) != "", F.concat(b["label"], F.lit(":\n"), b["value"])).otherwise(b["value"])), "\n\n")


def manifest(chunks: DataFrame, doc: str) -> DataFrame:
    """Per document: chunks, characters and the sections in the export."""
    return chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("content_character_count").alias("n_chars"), F.array_join(F.array_sort(F.collect_set("section_id")), ",").alias("sections"))


def shift(entries: DataFrame, targets: DataFrame, doc: str, order: str, level: str) -> DataFrame:
    """Moves one header of each document (targets: doc, target, delta of -1 or 1), and all below it, in or out.

    Out stops at level 1; in stops at one more than the header before, which may be less than the level it had.
    """
    w = ordered([doc], [order])
    last = F.last(level, ignorenulls=True).over(before(w))
    e = entries.withColumn("__prev", F.coalesce(last, F.lit(0))).join(targets.select(F.col(doc), F.col("target").alias("__at"), F.col("delta").alias("__by")), doc, "left")
    new = F.when(F.col("__by") > 0, F.least(F.col(level) + 1, F.col("__prev") + 1)).otherwise(F.greatest(F.col(level) - 1, F.lit(1)))
    here = e.where(F.col(order) == F.col("__at")).select(F.col(doc).alias("__doc"), F.col(level).alias("__old"), new.alias("__new"))
    e = e.join(here, F.col(doc) == F.col("__doc"), "left")
    stop = F.min(F.when((F.col(order) > F.col("__at")) & (F.col(level) <= F.col("__old")), F.col(order))).over(Window.partitionBy(doc))
    inside = (F.col(order) >= F.col("__at")) & (F.col(order) < F.coalesce(stop, F.lit(2**62)))
    moved = F.when(inside & F.col(level).isNotNull(), F.col(level) + F.col("__new") - F.col("__old")).otherwise(F.col(level))
    return e.withColumn("new_level", moved).drop("__doc", "__prev", "__old", "__new", "__at", "__by")


def under_path(entries: DataFrame, doc: str, order: str, level: str, titles: str, want: str) -> DataFrame:
    """Items whose header path is the wanted one, and the headers along it that stand before one of them.

    Header paths are those of hierarchy(); an empty wanted path means items above all headers.
    """
    e = entries.withColumn("__leaf", F.col(level).isNull() & (F.col(titles) == F.col(want)))
    e = e.withColumn("__last", F.max(F.when(F.col("__leaf"), F.col(order))).over(Window.partitionBy(doc)))
    on_path = F.col(level).isNotNull() & (F.slice(want, F.lit(1), F.size(titles)) == F.col(titles)) & (F.col(order) < F.col("__last"))
    return e.where(F.col("__leaf") | on_path).drop("__leaf", "__last")
