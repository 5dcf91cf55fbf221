"""Section JSON over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import render, sections, spans
from .base import LINES, Registry, lines, table

query = Registry()


@query(
    "sec_inspection_lookup",
    f"""with s as (select l_orderkey, l_returnflag as section, l_linestatus, list(distinct l_partkey % 50) as files from {LINES} group by all),
    i as (select l_orderkey, l_returnflag as section, l_suppkey % 3 as ord, list(distinct l_suppkey % 50) as files, min(l_suppkey) % 4 = 0 as skip from {LINES} group by all)
    select s.l_orderkey, s.section, s.l_linestatus, min(i.ord) as inspection from s left join i on i.l_orderkey = s.l_orderkey and i.section = s.section and not skip and list_has_any(s.files, i.files) group by all""",
)
def lookup(spark, sf_dir):
    """Lines by flag and status stand for spans, by flag and supplier group for inspections."""
    l = lines(spark, sf_dir)
    s = l.groupBy("l_orderkey", F.col("l_returnflag").alias("section"), "l_linestatus").agg(F.collect_set(F.col("l_partkey") % 50).alias("files"))
    i = l.groupBy("l_orderkey", F.col("l_returnflag").alias("section"), (F.col("l_suppkey") % 3).alias("inspection")).agg(F.collect_set(F.col("l_suppkey") % 50).alias("files"), F.when(F.min("l_suppkey") % 4 == 0, "skipped").otherwise("resolved").alias("status"))
    return sections.inspection_for(s, i, ["l_orderkey", "l_linestatus"], "files", "inspection").select("l_orderkey", "section", "l_linestatus", "inspection")


def order_tables(spark, sf_dir):
    """Orders as tables: two lines make a row, an order's last line alone a title; every third order has fills."""
    l = lines(spark, sf_dir)
    text = F.when(F.col("l_suppkey") % 9 == 0, "Procedures / Workflow Steps").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    text = F.when((F.col("l_suppkey") % 9 != 0) & (F.col("l_orderkey") % 3 == 0), F.concat(text, F.lit(" [#222a35]"))).otherwise(text)
    c = l.select(
        "l_orderkey", F.floor((F.col("pos") - 1) / 2).alias("row"), ((F.col("pos") - 1) % 2 + 1).alias("col"), F.concat(F.lit("CL"), F.col("pos").cast("string")).alias("cell_id"), F.lit(1).alias("colspan"), text.alias("text"), text.alias("display_text"), F.lit(2).alias("n"),
    )
    r = spans.table_rows(c, ["l_orderkey"], "n")
    empty = F.array().cast("array<string>")
    return r.withColumn("section", F.when(F.col("l_orderkey") % 2 == 0, "SEC12").otherwise("SEC09")).withColumn("columns", empty).withColumn("header_ids", empty)


@query(
    "sec_table_fallback",
    f"""with c as (select l_orderkey, (pos - 1) // 2 as row, (pos - 1) % 2 + 1 as col, 'CL' || pos as id, pos,
            case when l_suppkey % 9 = 0 then 'Procedures / Workflow Steps' else 'p' || l_partkey || case when l_orderkey % 3 = 0 then ' [#222a35]' else '' end end as t,
            case when l_suppkey % 9 = 0 then 'Procedures / Workflow Steps' else 'p' || l_partkey end as label, l_orderkey % 2 = 0 as wf from {LINES}),
    r as (select l_orderkey, row, wf, count(*) as n, list(id order by col) as ids, list(label order by col) as labels, arg_min(t, col) as v, list(regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') order by col) as keys from c group by all),
    h as (select l_orderkey, arg_min(ids, row) as hids, arg_min(labels, row) as cols, arg_min(keys, row) as hkeys, arg_min(n, row) as hn from r where n >= case when wf then 1 else 1 end group by l_orderkey),
    k as (select r.*, h.cols from r join h using (l_orderkey) where not (list_has_all(r.ids, h.hids) or (r.n >= h.hn and r.keys[1:h.hn] = h.hkeys))),
    s as (select l_orderkey, min(row) as sr from k where n = 1 and wf and contains(v, 'Procedures') group by all)
    select k.l_orderkey, k.row, case when n > 1 then case when wf then 'step' else 'row' end when wf then case when contains(v, '#222a35') then 'group_header' else 'subgroup_header' end else 'value' end as kind,
        case when n = 1 and wf then v end as heading,
        case when n > 1 then array_to_string(list_transform(range(1, least(n, len(cols)) + 1), lambda i: cols[i] || '=' || ids[i]), ';') when not wf then cols[1] || '=' || v end as fields
    from k left join s using (l_orderkey) where s.sr is null or s.sr <> k.row""",
)
def fallback(spark, sf_dir):
    e = sections.table_entries(order_tables(spark, sf_dir), ["l_orderkey"], F.col("section").isin("SEC12", "SEC13"))
    return e.select("l_orderkey", "row", "kind", "heading", F.array_join("fields", ";").alias("fields"))


@query(
    "sec_validate",
    """select event_id, case event_id % 7 when 1 then 'not JSON' when 2 then 'wrong section' when 3 then 'not an array' when 4 then 'empty array' when 5 then 'unknown format' end as error from events""",
)
def validate(spark, sf_dir):
    """Seven kinds of answers."""
    cases = (("SEC07", '{"section_id": "SEC07", "content": "x"}'), ("SEC07", "{x"), ("SEC07", '{"section_id": "SEC08"}'), ("SEC99", '{"format": "matrix"}'), ("SEC99", "[]"), ("SEC99", '[{"format": "list"}]'), ("SEC99", '[{"format": "matrix"}, {"format": "other"}]'))
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in cases)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", sections.validate(pick(1), pick(0)).alias("error"))


@query(
    "rnd_fill_down",
    f"""with c as (select l_orderkey, pos, case when l_returnflag = 'R' then 'CL' || pos end as v, 1 + l_quantity::int % 3 as s from {LINES}),
    f as (select a.l_orderkey, a.pos, (select b.v from c b where b.l_orderkey = a.l_orderkey and b.v is not null and b.pos <= a.pos order by b.pos desc limit 1) as v,
            (select b.pos + b.s from c b where b.l_orderkey = a.l_orderkey and b.v is not null and b.pos <= a.pos order by b.pos desc limit 1) as e from c a),
    g as (select l_orderkey, pos, case when e > pos then v end as filled from f),
    n as (select *, filled is null or filled is distinct from lag(filled) over (partition by l_orderkey order by pos) as new from g)
    select l_orderkey, pos, filled, sum(new::int) over (partition by l_orderkey order by pos rows unbounded preceding)::bigint as run from n""",
)
def fill_down(spark, sf_dir):
    """Returned lines carry their id down as far as their span."""
    c = lines(spark, sf_dir).select("l_orderkey", "pos", F.lit(1).alias("c"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("CL"), F.col("pos").cast("string"))).alias("v"), (F.col("l_quantity").cast("int") % 3 + 1).alias("s"))
    return sections.fill_down(c, ["l_orderkey"], "pos", "c", "v", "s").select("l_orderkey", "pos", "filled", F.col("run").cast("long").alias("run"))


@query(
    "rnd_matrix",
    """select n_regionkey, '<table><tr><th>name</th><th>key</th></tr>' || string_agg('<tr><td class="text-ltr">' || n_name || '</td><td class="text-ltr" style="background:#00000' || (n_nationkey % 10) || ';color:#ffffff">' || n_nationkey || '</td></tr>', '' order by n_nationkey) || '</table>' as html
    from nation group by n_regionkey""",
)
def matrix(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    row = F.array("n_name", F.concat(F.col("n_nationkey").cast("string"), F.lit(" [#00000"), (F.col("n_nationkey") % 10).cast("string"), F.lit("]")))
    g = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    return g.select("n_regionkey", render.matrix(F.array(F.lit("name"), F.lit("key")), F.col("rows")).alias("html"))
