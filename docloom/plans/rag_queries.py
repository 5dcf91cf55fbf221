"""Group G: references, hierarchies and balanced parts over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import rag
from .base import LINES, Registry, lines, table

query = Registry()


@query(
    "ref_tokens",
    r"""with t as (select o_orderkey, 'see CL' || lpad((o_orderkey % 1000000)::varchar, 6, '0') || ' and <TB' || lpad((o_custkey % 1000000)::varchar, 6, '0') || '> ' || o_orderpriority || ' <EM000001>' || case when o_orderkey % 2 = 0 then ' CL12' else ' CL000009x' end as t from orders)
    select o_orderkey, array_to_string(regexp_extract_all(t, 'CL[0-9]{6}|<TB[0-9]{6}>|<EM[0-9]{6}>'), ' ') as refs, len(regexp_extract_all(t, 'CL[0-9]{6}|<TB[0-9]{6}>|<EM[0-9]{6}>'))::bigint as n_refs from t""",
)
def tokens(spark, sf_dir):
    pad = lambda c: F.lpad((F.col(c) % 1000000).cast("string"), 6, "0")
    t = F.concat(F.lit("see CL"), pad("o_orderkey"), F.lit(" and <TB"), pad("o_custkey"), F.lit("> "), "o_orderpriority", F.lit(" <EM000001>"), F.when(F.col("o_orderkey") % 2 == 0, " CL12").otherwise(" CL000009x"))
    found = rag.tokens(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, " ").alias("refs"), F.size(found).cast("long").alias("n_refs"))


def _reference_nodes(spark, sf_dir):
    """Regions as cells that refer to their nations, nations to customers' segments; one nation refers back, one to nothing."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    pad = lambda c, p: F.concat(F.lit(p), F.lpad(c.cast("string"), 6, "0"))
    nation_id = pad(F.col("n_nationkey") + 100, "CL")
    refs = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: pad(k + 100, "CL")), " then ").alias("refs"))
    regions = r.join(refs, r["r_regionkey"] == refs["n_regionkey"]).select(pad(F.col("r_regionkey"), "CL").alias("id"), F.concat("r_name", F.lit(": "), "refs").alias("text"), F.lit(True).alias("is_root"))
    more = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit(" back "), pad(F.col("n_regionkey"), "CL"))).when(F.col("n_nationkey") % 5 == 1, " <TB999999>").when(F.col("n_nationkey") % 5 == 2, " <EM000003>").otherwise("")
    nations = n.select(nation_id.alias("id"), F.concat("n_name", more).alias("text"), F.lit(False).alias("is_root"))
    return regions.union(nations)


@query(
    "ref_resolve_recursive",
    """with n as (select n_regionkey, n_nationkey, n_name || case n_nationkey % 5 when 0 then ' back' when 1 then chr(10) || 'TB999999' when 2 then chr(10) || '<EM000003>' else '' end as t,
            row_number() over (partition by n_regionkey order by n_nationkey) as k from nation)
    select 'CL' || lpad(r_regionkey::varchar, 6, '0') as root, r_name || ':' || chr(10) || string_agg(case when k > 1 then 'then' || chr(10) else '' end || t, chr(10) order by k) as text,
        string_agg('CL' || lpad((n_nationkey + 100)::varchar, 6, '0'), ',' order by n_nationkey) as used,
        case when bool_or(n_nationkey % 5 = 1) then 'TB999999' else '' end as unresolved
    from n join region on r_regionkey = n_regionkey group by r_regionkey, r_name""",
)
def resolve(spark, sf_dir):
    """Texts of regions; `used` are the cells below the root."""
    out = rag.resolve(spark, _reference_nodes(spark, sf_dir))
    used = F.filter("used", lambda x: (x != F.col("root")) & x.startswith("CL"))
    return out.select("root", "text", F.array_join(used, ",").alias("used"), F.array_join("unresolved", ",").alias("unresolved"))


#: Lines as entries: headers of levels 1 to 3, and items.
_LEVEL = "case when l_partkey % 3 = 0 then 1 + l_suppkey % 3 end"


def entries(spark, sf_dir):
    return lines(spark, sf_dir).select("l_orderkey", "pos", F.expr(_LEVEL).cast("int").alias("level"), F.concat(F.lit("h"), F.col("pos").cast("string")).alias("title"))


_SQL_HIERARCHY = f"""recursive e as (select l_orderkey, pos, {_LEVEL} as level from {LINES}),
    p as (select a.l_orderkey, a.pos, a.level, (select max(b.pos) from e b where b.l_orderkey = a.l_orderkey and b.pos < a.pos and b.level < a.level) as parent from e a where a.level is not null),
    n as (select *, row_number() over (partition by l_orderkey, parent order by pos) as number from p),
    w(l_orderkey, pos, numbers, titles) as (select l_orderkey, pos, lpad(number::varchar, 2, '0'), 'h' || pos from n where parent is null
        union all select n.l_orderkey, n.pos, w.numbers || '_' || lpad(n.number::varchar, 2, '0'), w.titles || ' > h' || n.pos from n join w on w.l_orderkey = n.l_orderkey and w.pos = n.parent),
    i as (select e.*, case when level is not null then pos else (select max(b.pos) from e b where b.l_orderkey = e.l_orderkey and b.pos < e.pos and b.level is not null) end as head from e),
    k as (select *, row_number() over (partition by l_orderkey, head, level is null order by pos) as item from i)"""


@query(
    "rag_hierarchy_path",
    f"""with {_SQL_HIERARCHY}
    select k.l_orderkey, k.pos, concat_ws('_', w.numbers, case when level is null then lpad(item::varchar, 2, '0') end) as number_path, coalesce(w.titles, '') as title_path
    from k left join w on w.l_orderkey = k.l_orderkey and w.pos = k.head""",
)
def hierarchy(spark, sf_dir):
    h = rag.hierarchy(entries(spark, sf_dir), "l_orderkey", "pos", "level", "title", depth=3)
    return h.select("l_orderkey", "pos", rag.number_path(F.col("numbers")).alias("number_path"), rag.title_path(F.col("titles")).alias("title_path"))


@query(
    "rag_segments",
    r"""with s as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as p from documents)
    select doc_id, row_number() over (partition by doc_id order by p) - 1 as seg, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''))::bigint as n_words, length(trim(t)) as n_chars
    from s where trim(t) <> ''""",
)
def segments(spark, sf_dir):
    """Segments of documents, whose lines stand for blocks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(rag.segments(F.col("text"), r"\n+")).alias("seg", "t"))
    return d.select("doc_id", F.col("seg").cast("long").alias("seg"), word_count(F.col("t")).cast("long").alias("n_words"), F.length("t").cast("long").alias("n_chars"))


def parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", rag.segments(F.col("text"), r"\n+").alias("segs"))
    return rag.split(d, "doc_id", "segs")


_SQL_SPLIT = r"""recursive s0 as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as p from documents),
    s as (select doc_id, row_number() over (partition by doc_id order by p) - 1 as i, trim(t) as t, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''))::int as w from s0 where trim(t) <> ''),
    c as (select *, sum(w) over (partition by doc_id order by i rows unbounded preceding)::int as upto from s),
    d as (select doc_id, sum(w)::int as total, count(*)::int as n, case when sum(w) > 500 then least(ceil(sum(w) / 400.0)::int, count(*)::int) else 1 end as parts from s group by doc_id),
    k(doc_id, k, cut) as (
        select doc_id, 0, -1 from d
        union all
        select k.doc_id, k.k + 1, coalesce((select arg_min(c.i, (abs(c.upto - d.total * (k.k + 1) / d.parts::double), c.i)) from c
                where c.doc_id = k.doc_id and c.i >= k.cut + 1 and c.i <= least(greatest(d.n - (d.parts - (k.k + 1)) - 1, k.cut + 1), d.n - 1)
                and (k.k + 1 < d.parts - 1 or d.total - c.upto >= 100)), k.cut + 1)
        from k join d on d.doc_id = k.doc_id where k.k + 1 < d.parts),
    g as (select c.*, (select count(*) from k where k.doc_id = c.doc_id and k.k > 0 and k.cut < c.i) + 1 as part_num from c)"""


@query(
    "rag_balanced_split",
    f"""with {_SQL_SPLIT} select doc_id, part_num, doc_id::varchar || case when max(part_num) over (partition by doc_id) > 1 then '~p' || lpad(part_num::varchar, 2, '0') else '' end || '.txt' as chunk_id,
        n_words, length(t) as n_chars, md5(t) as text_md5
    from (select doc_id, part_num, sum(w)::bigint as n_words, string_agg(t, chr(10) || chr(10) order by i) as t from g group by all)""",
)
def balanced_split(spark, sf_dir):
    """Parts of documents of more than 500 words, about 400 words each; lines are the segments."""
    p = parts(spark, sf_dir)
    n = F.max("part_num").over(Window.partitionBy("doc_id"))
    return p.select(
        "doc_id", F.col("part_num").cast("long").alias("part_num"), rag.part_name(F.col("doc_id").cast("string"), F.col("part_num"), n).alias("chunk_id"), F.col("n_words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


@query(
    "rag_manifest",
    f"""with {_SQL_SPLIT}, q as (select g.doc_id, part_num, sum(w) as nw, length(string_agg(t, chr(10) || chr(10) order by i)) as nc from g group by all)
    select source, count(*) as chunk_count, sum(nc)::bigint as n_chars, string_agg(distinct lang, ',' order by lang) as sections from q join documents using (doc_id) group by source""",
)
def manifest(spark, sf_dir):
    """A manifest of the parts of each source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("section_id"))
    c = parts(spark, sf_dir).withColumn("content_character_count", F.length("text").cast("long")).join(d, "doc_id")
    return rag.manifest(c, "source")


@query(
    "rag_unique_names",
    """select p_partkey, lpad(row_number() over (partition by p_size order by p_partkey)::varchar, 4, '0') || '_' || p_brand
        || case when row_number() over b > 1 then '_' || lpad((row_number() over b)::varchar, 2, '0') else '' end as file_name
    from part window b as (partition by p_size, p_brand order by p_partkey)""",
)
def unique_names(spark, sf_dir):
    return rag.unique_names(table(spark, sf_dir, "part"), ["p_size"], ["p_partkey"], "p_brand").select("p_partkey", "file_name")


@query(
    "rag_metadata",
    r"""select n_nationkey, '--- RAG METADATA ---' || chr(10) || 'Document: ' || n_name || chr(10) || 'Section: ' || r_name || chr(10) || 'Hierarchy: ' || r_name || ' > ' || n_name || chr(10) || '--- END RAG METADATA ---' as header,
        'Name:' || chr(10) || n_name || case when n_nationkey % 2 = 0 then chr(10) || chr(10) || r_name else '' end as body
    from nation join region on n_regionkey = r_regionkey""",
)
def metadata(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    block = lambda a, b: F.struct(F.lit(a).alias("label"), b.alias("value"))
    blocks = F.array(block("Name", F.col("n_name")), block("", F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise("  ")))
    document = F.concat(F.lit(" "), F.col("n_name"), F.lit("\n"))
    return j.select("n_nationkey", rag.metadata_header(document, F.col("r_name"), rag.title_path(F.array("r_name", F.lit(" "), "n_name"))).alias("header"), rag.content_body(blocks).alias("body"))


@query(
    "hierarchy_shift",
    f"""with e as (select l_orderkey, pos, {_LEVEL} as level from {LINES}),
    t as (select l_orderkey, max(pos) filter (where level is not null and pos <= 4) as target, case when l_orderkey % 2 = 0 then 1 else -1 end as delta from e group by l_orderkey),
    h as (select t.*, e.level as old, coalesce((select arg_max(b.level, b.pos) from e b where b.l_orderkey = e.l_orderkey and b.pos < e.pos and b.level is not null), 0) as prev from t join e on e.l_orderkey = t.l_orderkey and e.pos = t.target),
    n as (select *, case when delta > 0 then least(old + 1, prev + 1) else greatest(old - 1, 1) end as new,
          (select min(b.pos) from e b where b.l_orderkey = h.l_orderkey and b.pos > target and b.level <= old) as stop from h)
    select e.l_orderkey, e.pos, (e.level + case when e.pos >= n.target and e.pos < coalesce(n.stop, 1000) then n.new - n.old else 0 end)::bigint as new_level from e left join n using (l_orderkey)""",
)
def hierarchy_shift(spark, sf_dir):
    """The last header among the first four lines moves, in for even orders, out for odd ones."""
    e = entries(spark, sf_dir)
    t = e.groupBy("l_orderkey").agg(F.max(F.when(F.col("level").isNotNull() & (F.col("pos") <= 4), F.col("pos"))).alias("target"))
    t = t.withColumn("delta", F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1))
    return rag.shift(e, t, "l_orderkey", "pos", "level").select("l_orderkey", "pos", F.col("new_level").cast("long").alias("new_level"))


@query(
    "hierarchy_filter",
    f"""with {_SQL_HIERARCHY}, m as (select k.*, coalesce(w.titles, '') as titles from k left join w on w.l_orderkey = k.l_orderkey and w.pos = k.head),
    tg as (select l_orderkey, arg_max(titles, pos) as want from m where level is null group by l_orderkey),
    leaf as (select m.* from m join tg using (l_orderkey) where level is null and titles = want),
    anc as (select distinct m.l_orderkey, m.pos from m join leaf l on m.l_orderkey = l.l_orderkey and m.level is not null and m.pos < l.pos and (l.titles = m.titles or l.titles like m.titles || ' > %'))
    select l_orderkey, pos from leaf union all select l_orderkey, pos from anc""",
)
def hierarchy_filter(spark, sf_dir):
    """The entries under the header path of an order's last item, with the headers that lead there."""
    h = rag.hierarchy(entries(spark, sf_dir), "l_orderkey", "pos", "level", "title", depth=3)
    m = h.select("l_orderkey", "pos", "level", "titles")
    want = m.where("level is null").groupBy("l_orderkey").agg(F.max_by("titles", "pos").alias("want"), F.max_by("pos", "pos").alias("last"))
    return rag.under_path(m.join(want, "l_orderkey"), "l_orderkey", "pos", "level", "titles", "want").select("l_orderkey", "pos")
