"""Jobs around documents: approval, admission, stored files, counts of a run, folder names, deletion, models of workers."""

from pyspark.sql import functions as F

from ..operators import runs
from ..operators.storage import scratch, stored
from ..sources import store
from ..streaming import gate
from .base import Registry, table

query = Registry()


@query(
    "stream_gate_decisions",
    """with r as (select * from events where event_type = 'signup'), a as (select * from events where event_type = 'purchase')
    select coalesce(r.user_id, a.user_id) as job, r.ts as asked, a.ts as decided, a.event_id as approval, case when r.ts is null then 'unasked' when a.ts is null then 'timed_out' else 'approved' end as outcome
    from r full join a on r.user_id = a.user_id and a.ts >= r.ts and a.ts <= r.ts + interval 20 hours""",
)
def gate_decisions(spark, sf_dir):
    """Signups ask, purchases of the same user approve within twenty hours."""
    e = table(spark, sf_dir, "events")
    found = gate.decisions(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "20 hours")
    return found.withColumnRenamed("by", "approval")


@query(
    "stream_admission",
    """with e as (select *, event_type not in ('purchase', 'error') as asks from events),
    n as (select *, sum((not asks)::int) over (partition by user_id order by ts, asks, event_id rows unbounded preceding) as run from e),
    k as (select *, row_number() over w as k, first_value(event_id) over w as active from n where asks window w as (partition by user_id, run order by ts, event_id))
    select user_id, event_id, ts, case when k = 1 then 'admitted' else 'rejected' end as outcome, active from k""",
)
def admission(spark, sf_dir):
    """One job of a user at a time; purchases and errors end what runs."""
    kind = F.when(F.col("event_type").isin("purchase", "error"), gate.FINISH).otherwise(gate.REQUEST)
    return gate.admitted(table(spark, sf_dir, "events").withColumn("kind", kind), "user_id", "event_id", "kind", "ts")


@query(
    "sink_document_files",
    """with p as (select p_brand, replace(p_type, ' ', '_') as stem, p_name || p_partkey as content from part),
    n as (select *, row_number() over (partition by p_brand, stem order by sha256(content)) as n from p)
    select p_brand as doc_id, stem || case when n > 1 then '_' || n else '' end || '.txt' as file_name, sha256(content) as sha256 from n""",
)
def document_files(spark, sf_dir):
    """Parts as files of their brand under the name of their type, written to a store of files and read again."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("doc_id"), F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".txt")).alias("file_name"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("content"))
    path = scratch(spark, "files")
    store.save(rows, path)
    return stored(store.load(spark, path).select("doc_id", "file_name", F.sha2("content", 256).alias("sha256")))


@query(
    "obs_run_counts",
    """with d as (select text is null or trim(text) = '' as blank, length(text) > 2000 as long, lang from documents)
    select 'export' as job, step, metric, value::bigint as value from (select 'all' as step, 'n_rows' as metric, count(*) as value from d union all select 'all', 'blank', count(*) filter (blank) from d union all select 'all', 'long', count(*) filter (long) from d
        union all select 'english', 'n_rows', count(*) from d where lang = 'en' union all select 'english', 'long', count(*) filter (long) from d where lang = 'en')""",
)
def run_counts(spark, sf_dir):
    """Documents counted as they pass two steps of one run."""
    long = F.length("text") > 2000
    rows, every = runs.observed(table(spark, sf_dir, "documents"), "all", blank=F.col("text").isNull() | (F.trim("text") == ""), long=long)
    some, english = runs.observed(stored(rows).where("lang = 'en'"), "english", long=long)
    some.write.format("noop").mode("overwrite").save()
    return runs.progress_table(spark, "export", {"all": every, "english": english})


@query(
    "cat_unique_names",
    """with w as (select o_orderkey, o_orderdate, 'c' || o_custkey % 100 as name from orders),
    x as (select distinct 'c' || o_custkey % 100 as name from orders where o_custkey % 100 % 7 = 0 union select distinct 'c' || o_custkey % 100 || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') from orders where o_custkey % 3 = 0),
    n as (select w.*, row_number() over (partition by w.name order by o_orderdate, o_orderkey) = 1 and x.name is null as first from w left join x on x.name = w.name),
    s as (select n.*, n.name || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') as stamped, row_number() over (partition by first, n.name, o_orderdate order by o_orderkey) as k from n)
    select o_orderkey, case when first then s.name else stamped || case when k + (x.name is not null)::int > 1 then '_' || (k + (x.name is not null)::int) else '' end end as folder from s left join x on x.name = stamped""",
)
def unique_names(spark, sf_dir):
    """Orders as uploads under the name of a group of customers, at their date; some names and some with dates exist."""
    o = table(spark, sf_dir, "orders").withColumn("name", F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string")))
    stamped = F.concat("name", F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"))
    existing = o.where("o_custkey % 100 % 7 = 0").select("name").union(o.where("o_custkey % 3 = 0").select(stamped))
    return runs.unique_names(o.select("o_orderkey", "o_orderdate", "name"), existing, "name", "o_orderdate", ["o_orderkey"]).select("o_orderkey", "folder")


@query(
    "cat_delete_documents",
    """with d as (select distinct c_mktsegment || '/' || c_nationkey as doc from customer), j as (select distinct c_mktsegment || '/' || c_nationkey as doc from customer where c_acctbal > 9500),
    w as (select distinct c_mktsegment || '/' || (c_nationkey + 5) as doc from customer)
    select w.doc, case when d.doc is null then 'missing' when j.doc is not null then 'refused' else 'deleted' end as outcome, coalesce(n, 0)::bigint as n_left
    from w left join d using (doc) left join j using (doc) left join (select c_mktsegment || '/' || c_nationkey as doc, count(*) as n from customer group by 1) c on c.doc = w.doc and (j.doc is not null)""",
)
def delete_documents(spark, sf_dir):
    """Customers as chunks of a segment and nation, in folders: some groups have a running job, some do not exist."""
    c = table(spark, sf_dir, "customer")
    name = lambda n: F.concat("c_mktsegment", F.lit("/"), n.cast("string")).alias("doc")
    path = scratch(spark, "documents")
    chunks = c.select("c_custkey", name(F.col("c_nationkey")))
    chunks.repartition("doc").write.partitionBy("doc").parquet(path)
    jobs = c.select(name(F.col("c_nationkey")), F.when(F.col("c_acctbal") > 9500, "running").otherwise("done").alias("status"))
    out = runs.delete_documents(c.select(name(F.col("c_nationkey") + 5)), path, jobs, "doc")
    left = spark.read.parquet(path).groupBy("doc").agg(F.count(F.lit(1)).alias("n_left"))
    return stored(out.join(left, "doc", "left").select("doc", "outcome", F.coalesce("n_left", F.lit(0)).alias("n_left")))


@query("vec_worker_models", "select doc_id, length(text)::bigint * 3 as value from documents")
def worker_models(spark, sf_dir):
    """A model that workers load once, over all texts."""
    lengths = table(spark, sf_dir, "documents").select("doc_id", runs.modelled(F.col("text"), "lengths", 3, lambda k: lambda texts: [k * len(x) for x in texts], "long").alias("x"))
    return lengths.select("doc_id", "x.value")
