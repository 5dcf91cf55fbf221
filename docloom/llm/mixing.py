"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every document enters the queue of its source once per pass, in an order shuffled by a hash. Its virtual finish time
is the number of its source's words up to and with it, divided by the source's target. The mix takes all entries by
virtual finish time until the budget is full; the last one is cut.

Prefix sums are exact and have no global window: entries fall in slots by their hash (or finish time), slots are
summed before the shuffle, the small table of slots is summed up, and within a slot a window runs. A source with a
third of all rows is spread over all its slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_of, written

#: Weights of the sources in code-point order, null last; they repeat.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: Slots of the prefix sums; more slots make smaller windows.
SLOTS = 4096
#: Entries around the cut that are sorted together; ranges of finish times are narrowed until they hold no more.
FEW = 10_000


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with target: weights share SHARE of all sizes, no target is above PASSES times its size.

    Handing the excess on by weight until nobody is above its cap ends where every target is min(cap, level * weight)
    with one level for all. Sources sorted by cap / weight reach their caps in that order, so the level follows from
    prefix sums. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", (PASSES * F.col("source_size")).cast("long"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "source", "source_size", "weight", "cap",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("used"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left"),
        (F.lit(SHARE) * F.sum("source_size").over(everyone)).alias("budget"),
    )
    level = (F.col("budget") - F.col("used")) / F.col("left")  # if just those before this one are capped; the largest level that leaves its own source open holds
    open_ = F.when(F.col("cap") >= level * F.col("weight"), level)
    s = s.withColumn("level", F.max(open_).over(everyone))
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def sized(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, place); size is the number of words of the whole text, 0 for null."""
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), place(id_column, text).alias("place"))


def words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(id_column: str, text: str):
    """The place of a document in the shuffled order: 48 bits of a hash of its id, or of its text if it has no id."""
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("-"), text_of(text)))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")


def mix(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, size, place), as sized() has them, with source_size, target and taken.

    Null sources are one source, the last. Null ids are allowed: texts place them in the shuffled order. Ties of places
    go by id, then size. Rows that are equal in all columns are interchangeable; null and empty texts have size 0. Documents without words
    take 0. An empty table gives an empty result. Both passes run through the same order, so a document never takes
    more than PASSES times its size.
    """
    sources = written(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))))
    named = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = named.select(F.col("source").alias("__source"), "source_no", "source_size", "target")
    queue = sizes.join(s, sizes["source"].eqNullSafe(s["__source"])).drop("__source")
    queue = queue.withColumn("slot", F.shiftrightunsigned("place", 36).cast("int"))

    # Exact prefix sums by source: at most SLOTS sums per source, then a window within each slot.
    ahead = Window.partitionBy("source_no").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = queue.groupBy("source_no", "slot").agg(F.sum("size").alias("amount"))
    slots = slots.select("source_no", "slot", F.coalesce(F.sum("amount").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source_no", "slot").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.withColumn("own", F.sum("size").over(inside)).join(slots, ["source_no", "slot"])
    queue = queue.withColumn("cum", F.col("own") + F.col("ahead")).drop("own", "ahead", "slot")
    queue = written(queue)

    found = sources.agg(F.round(F.sum("target")).cast("long"), F.max(F.when(F.col("target") > 0, PASSES * F.col("source_size") / F.col("target")))).first()  # one row
    budget, end = found
    if budget is None:
        return queue.select(*KEPT, F.lit(0).cast("long").alias("taken"))
    entries = [_entry(i).alias(f"e{i}") for i in range(PASSES)]
    cut = _cut(queue.where("size > 0").select(F.explode(F.array(*entries)).alias("e")), budget, end or 0.0)
    taken = F.lit(0).cast("long")
    for i in range(PASSES):
        whole = F.col("size")
        if cut is not None:
            at = F.struct(*(F.lit(cut[x]).cast(t).alias(x) for x, t in KEY))
            mine = F.struct(*(_entry(i)[x].alias(x) for x, _ in KEY))
            whole = F.when(mine < at, F.col("size")).when(mine == at, F.lit(cut["part"])).otherwise(F.lit(0))
        taken = taken + F.when(F.col("size") > 0, whole).otherwise(F.lit(0))
    return queue.select(*KEPT, taken.cast("long").alias("taken"))


KEPT = ("doc_id", "source", "size", "place", "source_size", "target")
#: Order of the entries of all queues.
KEY = (("finish", "double"), ("source_no", "int"), ("pass", "int"), ("place", "long"), ("id", "long"), ("size", "long"))


def _entry(i: int):
    """The entry of a document's pass i, with its virtual finish time."""
    return F.struct(
        ((F.col("cum") + i * F.col("source_size")) / F.col("target")).alias("finish"), F.col("source_no").cast("int").alias("source_no"), F.lit(i).alias("pass"),
        F.col("place"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.col("size"),
    )


def _cut(entries: DataFrame, budget: int, end: float) -> dict | None:
    """The entry at which the budget is full, and how much of it is taken; None if all entries fit.

    Sums by range of finish time, from 0 to end, find the range in which the budget fills up; that range is cut into finer ones until
    it holds FEW entries, or one finish time only, which a source has once a pass. Only that range is sorted.
    """
    low, high, ahead = 0.0, float(end), 0
    finish = F.col("e.finish")
    while True:
        inside = entries.where(finish.between(low, high))
        width = (high - low) / SLOTS
        lane = F.least(F.floor((finish - low) / width), F.lit(SLOTS - 1)).cast("int") if width > 0 else F.lit(0)
        sums = inside.groupBy(lane.alias("lane")).agg(F.sum("e.size").alias("amount"), F.count(F.lit(1)).alias("n"), F.min(finish).alias("low"), F.max(finish).alias("high"))
        upto = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("amount").over(upto) + F.lit(ahead))  # at most SLOTS rows
        full = sums.where(F.col("upto") >= budget).orderBy("lane").first()
        if full is None:
            return None
        ahead = full["upto"] - full["amount"]
        narrower = (full["low"], full["high"]) != (low, high)
        low, high = full["low"], full["high"]
        if full["n"] <= FEW or low == high or not narrower:
            break
    order = Window.orderBy(*(F.col(f"e.{x}") for x, _ in KEY)).rowsBetween(Window.unboundedPreceding, 0)
    last = entries.where(finish.between(low, high)).withColumn("total", F.sum("e.size").over(order) + F.lit(ahead))
    row = last.where(F.col("total") >= budget).orderBy("total", "e").first()
    return {**row["e"].asDict(), "part": row["e"]["size"] - (row["total"] - budget)}


def take(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it whole, and the cut one as far as it is taken.

    Returns docs' own columns, whatever their names. Repeats of a document are repeated rows; of the one document that
    the budget cuts, its first words stand (with the white space between them). Null and empty texts take part with no
    words and go. Of repeated rows of one id, source and size all stay as often as the one that is taken most. Null ids
    go by their texts. An empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key = {x: names[docs.columns.index(x)] for x in (text, source, id_column)}
    sizes = written(sized(plain, key[text], key[source], key[id_column]))
    plan = mix(sizes).where("taken > 0").groupBy("doc_id", "source", "size", "place").agg(F.max("taken").alias("taken"))
    p = plan.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("place").alias("__at"), "taken")
    own = plain.withColumn("__n", words(key[text])).withColumn("__place", place(key[id_column], key[text]))
    same = F.col(key[id_column]).eqNullSafe(F.col("__id")) & F.col(key[source]).eqNullSafe(F.col("__source")) & (F.col("__n") == F.col("__size")) & (F.col("__place") == F.col("__at"))
    joined = own.join(p, same)
    copies = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("__n"))), lambda i: F.least(F.col("__n"), F.col("taken") - i * F.col("__n"))))
    joined = joined.select(*names, "__n", copies.alias("__take"))
    parts = F.regexp_extract_all(F.col(key[text]), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("__take").cast("int")), "")
    body = F.when(F.col("__take") < F.col("__n"), cut).otherwise(F.col(key[text])).alias(key[text])
    return joined.select(*(body if x == key[text] else F.col(x) for x in names)).toDF(*docs.columns)


def query(spark, sf_dir):
    """op5: whole `documents`."""
    sizes = written(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLE = r"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '-')), 1, 12))::bigint as place
    from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) as source_no from s0),
s2 as (select *, case (source_no - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from s1),
s3 as (
    select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as used,
           (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0))::bigint as rest,
           1.5::double * (sum(source_size) over ())::double as budget
    from s2 window o as (order by cap::double / weight, source nulls last)),
s4 as (select *, (budget - used) / rest as lv from s3),
s5 as (select *, max(case when cap >= lv * weight then lv end) over () as level from s4),
s as (select source, source_no, source_size, coalesce(least(cap::double, level * weight), cap::double) as target from s5),
q as (
    select d.doc_id, d.source, d.size, d.place, s.source_no, s.source_size, s.target,
           sum(d.size) over (partition by s.source_no order by d.place, d.doc_id, d.size rows unbounded preceding)::bigint as cum
    from d join s on d.source is not distinct from s.source),
e as (
    select *, p as pass, (cum + p * source_size)::double / target as finish from q, (values (0), (1)) v(p) where size > 0),
t as (
    select *, sum(size) over (order by finish, source_no, pass, place, doc_id, size rows unbounded preceding)::bigint as total,
           (select round(sum(target))::bigint from s) as budget
    from e),
k as (select doc_id, sum(greatest(0, least(size, budget - (total - size))))::bigint as taken from t group by doc_id)
select q.doc_id, q.size, q.source_size::bigint as source_size, q.target, coalesce(k.taken, 0)::bigint as taken, q.source
from q left join k on q.doc_id = k.doc_id
"""
