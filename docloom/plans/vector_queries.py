"""Groups H, I and J: vectors, catalog and progress over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog, vectors
from ..operators.storage import stored
from ..streaming import progress
from .base import Registry, table
from .rag_queries import _SQL_SPLIT, parts

query = Registry()

_SMALL = {"source": 4, "lang": 8, "text": 3000}


@query(
    "vec_validate",
    """select doc_id, concat_ws(',', case when length(source) > 4 then 'source' end, case when length(text) > 3000 then 'text' end, case when strlen(text) > 3000 then 'text_bytes' end) as violations,
        regexp_matches(source, '^[A-Za-z_][A-Za-z0-9_]{0,254}$') as valid_name from documents""",
)
def validate(spark, sf_dir):
    """Fields over lowered limits."""
    v = vectors.violations(table(spark, sf_dir, "documents"), _SMALL)
    return v.select("doc_id", F.array_join("violations", ",").alias("violations"), vectors.valid_collection(F.col("source")).alias("valid_name"))


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_SCORED = "q as (select embedding::double[] as q from embeddings where vec_id = 0), s as (select vec_id, label, list_cosine_similarity(embedding::double[], q) as c from embeddings, q)"


@query("vec_cosine_topk", f"with {_SCORED} select vec_id, round(c, 6) as score, row_number() over (order by c desc, vec_id) as rank from s order by c desc, vec_id limit 12")
def topk(spark, sf_dir):
    out = vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))
    return out.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vec_cosine_filtered", f"with {_SCORED} select vec_id, label, round(c, 6) as score from s where label in (1, 3) order by c desc, vec_id limit 12")
def filtered(spark, sf_dir):
    out = vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), only=("label", [1, 3]))
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("vec_single_filter_bypass", "select vec_id, label, null::double as score, row_number() over (order by vec_id) as rank from embeddings where label = 2")
def bypass(spark, sf_dir):
    """One filter value: no search, all its rows."""
    out = vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), only=("label", [2]))
    return out.select("vec_id", "label", "score", F.col("rank").cast("long").alias("rank"))


_QUESTION = "the of and thing with er"


@query(
    "vec_rerank_topn",
    rf"""with h as (select doc_id, text, row_number() over (order by doc_id) as rank from documents),
    s as (select *, len(list_filter(list_distinct(regexp_split_to_array(trim(lower(text)), '\s+')), lambda x: list_contains(['the', 'of', 'and', 'thing', 'with', 'er'], x))) / 6.0::double as sc from h)
    select doc_id, round(sc, 6) as reranker_score from s order by sc desc, rank limit 5""",
)
def rerank(spark, sf_dir):
    """All documents reranked by the words they share with a question."""
    h = table(spark, sf_dir, "documents").withColumn("rank", F.col("doc_id"))
    out = vectors.rerank(h, vectors.overlap_score(_QUESTION, F.col("text")))
    return out.select("doc_id", F.round("reranker_score", 6).alias("reranker_score"))


@query(
    "vec_stitch",
    f"""with {_SQL_SPLIT}, p as (select g.doc_id, part_num, sum(w) as nw, string_agg(t, chr(10) || chr(10) order by i) as t from g group by all),
    h as (select p.*, (doc_id * 7 + part_num) % 11 / 10.0::double as sc, row_number() over (partition by doc_id order by part_num desc) as rank from p where (doc_id + part_num) % 3 = 0)
    select h.doc_id, max(sc) as reranker_score, string_agg(h.part_num::varchar, ',' order by rank) as files, (select count(*) from p where p.doc_id = h.doc_id) as part_count,
        (select md5(string_agg(trim(t, ' ' || chr(10)), chr(10) || chr(10) order by p.part_num)) from p where p.doc_id = h.doc_id) as text_md5
    from h group by h.doc_id""",
)
def stitch(spark, sf_dir):
    """Hits among the parts of documents, put together with their siblings."""
    p = stored(parts(spark, sf_dir)).withColumn("file", F.col("part_num").cast("string"))  # read twice
    w = Window.partitionBy("doc_id").orderBy(F.col("part_num").desc())
    h = p.where("(doc_id + part_num) % 3 = 0").withColumn("reranker_score", (F.col("doc_id") * 7 + F.col("part_num")) % 11 / 10).withColumn("vector_score", F.lit(None).cast("double")).withColumn("rank", F.row_number().over(w))
    out = vectors.stitch(h, p, "doc_id", [], "file", "part_num", "text")
    return out.select("doc_id", "reranker_score", F.array_join("retrieved_files", ",").alias("files"), "part_count", F.md5("text").alias("text_md5"))


@query("vec_hash_embed", "select doc_id, case when trim(text) = '' then 0.0 else 1.0 end::double as norm from documents")
def hash_embed(spark, sf_dir):
    """Norms of hashed unit vectors of documents; no text but one of spaces has a zero vector."""
    v = vectors.embed(F.col("text"), 64, directed=True)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(vectors.norm(v), 4).alias("norm"))


@query(
    "vec_hash_embed_values",
    r"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[^\s]+')) as w from documents),
    h as (select doc_id, ('0x' || substr(md5(w), 1, 2))::int % 16 as place, case when ('0x' || substr(md5(w), 15, 2))::int >= 128 then 1 else -1 end as sign from w),
    v as (select doc_id, place, sum(sign)::double as x from h group by all),
    n as (select doc_id, sqrt(sum(x * x)) as n from v group by doc_id)
    select doc_id, p.place::int as place, (case when n > 0 then coalesce(x, 0) / n else 0 end)::float::double as value from documents cross join range(16) p(place) left join n using (doc_id) left join v using (doc_id, place)""",
)
def hash_embed_values(spark, sf_dir):
    """The 16 values of hashed vectors of whole documents."""
    v = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.embed(F.col("text"), 16)).alias("place", "x"))
    return v.select("doc_id", "place", F.col("x").cast("double").alias("value"))


@query(
    "vec_stitch_metadata",
    """with c as (select c_custkey, c_nationkey, c_mktsegment, c_name, c_custkey % 4 as k from customer),
    g as (select c_nationkey, c_mktsegment, count(*) as part_count, string_agg(case when rank = 1 then '--- RAG METADATA ---' || chr(10) || 'Document: d' || c_nationkey || chr(10) || 'Section: ' || c_mktsegment || chr(10) || 'Hierarchy: ' || c_mktsegment || ' > x' || chr(10) || '--- END RAG METADATA ---' || chr(10) || chr(10) || c_name else c_name end, chr(10) || chr(10) order by c_custkey) as text
        from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as rank from c) group by all),
    h as (select c_nationkey, c_mktsegment, max(c_custkey % 10 / 10.0) as sc, string_agg(c_custkey::varchar, ',' order by c_custkey desc) as files from c where c_custkey % 9 = 0 group by all)
    select c_nationkey as doc_id, c_mktsegment as section, part_count, round(sc, 6)::double as reranker_score, files, md5(text) as text_md5 from h join g using (c_nationkey, c_mktsegment)""",
)
def stitch_metadata(spark, sf_dir):
    """Customers as parts whose texts name their document, section and hierarchy: hits come with all parts of the same."""
    c = table(spark, sf_dir, "customer")
    head = F.concat(F.lit("--- RAG METADATA ---\nDocument: d"), F.col("c_nationkey").cast("string"), F.lit("\nSection: "), "c_mktsegment", F.lit("\nHierarchy: "), "c_mktsegment", F.lit(" > x\n--- END RAG METADATA ---\n\n"))
    p = c.select(F.col("c_nationkey").alias("doc_id"), "c_custkey", F.concat(head, "c_name").alias("text"), F.col("c_custkey").cast("string").alias("file"))
    key = ["section_line", "hierarchy_line", "document_line"]
    p = p.select("*", *vectors.metadata_key(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy(F.col("c_custkey").desc())
    h = p.where("c_custkey % 9 = 0").withColumn("reranker_score", F.col("c_custkey") % 10 / 10).withColumn("vector_score", F.lit(None).cast("double")).withColumn("rank", F.row_number().over(w))
    out = vectors.stitch(h, p, "doc_id", key, "file", "c_custkey", "text", "--- END RAG METADATA ---")
    return out.select("doc_id", F.col("section_line").alias("section"), "part_count", F.round("reranker_score", 6).alias("reranker_score"), F.array_join("retrieved_files", ",").alias("files"), F.md5("text").alias("text_md5"))


@query(
    "vec_metadata_key",
    """select n_nationkey, n_name as document_line, r_name as section_line, r_name || ' > ' || n_name as hierarchy_line from nation join region on n_regionkey = r_regionkey""",
)
def metadata_key(spark, sf_dir):
    from .rag_queries import metadata

    return metadata(spark, sf_dir).select("n_nationkey", *vectors.metadata_key(F.concat("header", F.lit("\n\nDocument: not this\n"), "body")))


@query(
    "cat_history_listing",
    """with o as (select o_custkey, count(*) filter (o_orderpriority like '1%') as n, count(*) filter (o_orderpriority not like '1%') as m, max(o_orderdate) as t from orders group by all)
    select c_custkey, coalesce(n, 0) as n_urgent, coalesce(n, 0) > 0 as has_urgent, coalesce(m, 0) as n_others, coalesce(m, 0) > 0 as has_others, greatest(timestamp '1990-01-01' + c_custkey * interval 1 day, coalesce(o.t, timestamp '1990-01-01')) as updated
    from customer left join o on o_custkey = c_custkey""",
)
def history(spark, sf_dir):
    """Customers stand for documents, their urgent and other orders for two kinds of parts."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("timestamp_ntz '1990-01-01' + make_dt_interval(cast(c_custkey as int))").alias("mtime"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("mtime"), F.col("o_orderpriority").startswith("1").alias("urgent"))
    kinds = {"urgent": o.where("urgent"), "others": o.where("not urgent")}
    return catalog.history(c, kinds, "c_custkey").select("c_custkey", "n_urgent", "has_urgent", "n_others", "has_others", "updated")


@query(
    "cat_departments",
    """with v as (select c_custkey, case c_custkey % 3 when 0 then ' ' || lower(c_mktsegment) || ',' when 1 then c_mktsegment else left(c_mktsegment, 1) || lower(substr(c_mktsegment, 2)) || ' ;' end as s from customer),
    n as (select c_custkey, trim(s, ' ,;') as d from v)
    select lower(d) as key, arg_min(d, (c_custkey % 2, c_custkey)) as department from n where d <> '' group by all""",
)
def departments(spark, sf_dir):
    k, s = F.col("c_custkey") % 3, F.col("c_mktsegment")
    v = F.when(k == 0, F.concat(F.lit(" "), F.lower(s), F.lit(","))).when(k == 1, s).otherwise(F.concat(F.substring(s, 1, 1), F.lower(F.substring(s, 2, 100)), F.lit(" ;")))
    c = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"), (F.col("c_custkey") % 2).alias("src"))
    return catalog.department_catalog(c, "v", "src", "c_custkey")


@query(
    "cat_department_lookup",
    """select o_orderkey, case when o_orderkey % 4 = 0 then 'own' when o_custkey % 10 = 3 then 'exact' when o_custkey % 10 = 5 then 'bare' else '' end as departments from orders""",
)
def department_lookup(spark, sf_dir):
    """Names are a customer's key with a run suffix; some are listed with it, some without."""
    o = table(spark, sf_dir, "orders")
    bare = F.concat(F.lit("doc"), (F.col("o_custkey") % 10).cast("string"))
    own = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>"))
    docs = o.select("o_orderkey", F.concat(bare, F.lit("_20240131_101500")).alias("name"), own.alias("own"))
    listed = spark.createDataFrame([("doc3_20240131_101500", ["exact"]), ("doc5", ["bare"]), ("doc5_20240131_101500", [])], "name string, departments array<string>")
    return catalog.departments(docs, listed, "name", "own").select("o_orderkey", F.array_join("departments", ",").alias("departments"))


@query("cat_search_natural_sort", """select s_suppkey, lower(regexp_extract(s_name, '^(\\D*)', 1)) || lpad(regexp_extract(s_name, '(\\d+)', 1), 20, '0') as sort_key from supplier where contains(lower(s_name), '1')""")
def natural_sort(spark, sf_dir):
    return catalog.search(table(spark, sf_dir, "supplier"), "1", "s_name").select("s_suppkey", "sort_key")


@query(
    "cat_log_filter",
    """select event_id, user_id from events where event_type = 'purchase' and not (value > 20) and event_id % 7 not in (0, 1)""",
)
def log_filter(spark, sf_dir):
    """Events as log lines, some blank or broken; failed calls of one stage."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 7 == 0, " ").when(F.col("event_id") % 7 == 1, "{broken").otherwise(
        F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("stage"), (F.col("value") > 20).alias("success")))
    )
    log = catalog.read_log(e.select(line.alias("value")))
    rows = log.select(*(F.try_variant_get("entry", f"$.{k}", t).alias(k) for k, t in (("event_id", "long"), ("user_id", "long"), ("stage", "string"), ("success", "boolean"))))
    return catalog.log_filter(rows, "purchase", True).select("event_id", "user_id")


@query(
    "cat_chunk_listing",
    """select o_orderkey, case when o_custkey % 3 <> 0 then o_orderstatus end as labels from orders where not (o_custkey % 3 <> 0 and o_orderkey % 5 = 0)""",
)
def chunk_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.where("o_custkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("labels"), (F.col("o_orderkey") % 5 == 0).alias("skipped"))
    return catalog.chunk_listing(o.select("o_orderkey"), c, ["o_orderkey"]).select("o_orderkey", "labels")


@query(
    "cat_assets",
    """select distinct o_custkey, 'EM' || lpad(k::varchar, 6, '0') as asset_id from (select o_custkey, o_orderkey % 5 as k from orders union all select o_custkey, o_orderkey % 7 from orders)""",
)
def assets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = lambda n: F.concat(F.lit("EM"), F.lpad((F.col("o_orderkey") % n).cast("string"), 6, "0"))
    return catalog.assets(o.select("o_custkey", e(5).alias("asset_id")), o.select("o_custkey", F.concat(F.lit('{"v": "<'), e(7), F.lit('>"}')).alias("t")), "o_custkey", "t")


@query("stream_latest_snapshot", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def latest(spark, sf_dir):
    return progress.snapshots(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"])


@query(
    "stream_progress_pct",
    """select event_id, case when event_id % 17 = 0 then 0 else least(100, greatest(0, round_even(100.0 * (event_id % 41) / (event_id % 17), 0)))::int end as pct from events""",
)
def pct(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", progress.percent(F.col("event_id") % 41, F.col("event_id") % 17).alias("pct"))


@query("stream_recent_messages", "select user_id, event_id, back from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc)::bigint as back from events) where back <= 80")
def recent(spark, sf_dir):
    out = progress.recent(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return out.select("user_id", "event_id", F.col("back").cast("long").alias("back"))


_STATUS = "case event_id % 4 when 0 then 'running' when 1 then 'done' when 2 then 'paused' else 'warning' end"


@query(
    "stream_step_state",
    f"""with b as (select user_id, max((value > 95)::int) as broken from events group by all), l as (select user_id, event_type as step, arg_max({_STATUS}, event_id) as s from events group by all)
    select user_id, step, case when broken = 1 and s in ('running', 'paused') then 'error' else s end as status from l join b using (user_id)""",
)
def step_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("step"), F.expr(_STATUS).alias("st"), "event_id", "value")
    return progress.step_states(e, "user_id", "step", "st", "event_id", F.col("value") > 95)


@query("stream_windowed_counts", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n_events, round(sum(value), 4) as total from events group by all")
def windowed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = progress.windowed_counts(e, "ts", "event_type", "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


@query("stream_stage_steps", """select event_id, case event_id % 6 when 0 then 'validate' when 1 then 'model' when 2 then 'collection' when 3 then 'ingest' when 4 then 'ingest' end as runs,
    case event_id % 6 when 0 then 'select' when 1 then 'validate' when 2 then 'model' when 3 then 'collection' when 4 then 'collection' end as finishes from events""")
def stage_steps(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, ("validate", "model", "connect", "embed", "insert", "other"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", progress.stage_step(stage).alias("s")).select("event_id", "s.*")
