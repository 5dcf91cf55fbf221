"""Groups D, E and F: labels, review, spans and table headings over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text_udf import label_similarity
from ..operators import classify, headers, spans
from .base import LINES, Registry, lines, table

query = Registry()

#: Conversations labelled by a cue: (letter in the text) -> section; none: other text; short turns are skipped.
_TURNS = """select conv_id, row_number() over (partition by conv_id order by turn, role, text) as idx, text,
    length(text) < 40 as skipped,
    {array}((case when contains(lower(text), 'tion') then 'SEC12' end), (case when contains(lower(text), 'ble') then 'SEC07' end), (case when not contains(lower(text), 'tion') and not contains(lower(text), 'ble') then 'SEC99' end)) as raw from conversations"""
_SQL_TURNS = f"""t0 as ({_TURNS.replace("{array}", "list_value")}), t as (select conv_id, idx, text, skipped, case when skipped then [] else list_filter(raw, lambda x: x is not null) end as labels from t0),
    e as (select conv_id, idx, unnest(labels) as section from t)"""


def turns(spark, sf_dir):
    """Turns of conversations as labelled chunks: conv_id, idx (from 1, without gaps), text, skipped, labels."""
    c = table(spark, sf_dir, "conversations")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    low = F.lower("text")
    a, b = F.contains(low, F.lit("tion")), F.contains(low, F.lit("ble"))
    labels = F.array_compact(F.array(F.when(a, "SEC12"), F.when(b, "SEC07"), F.when(~a & ~b, "SEC99")))
    skipped = F.length("text") < 40
    return c.select("conv_id", idx.alias("idx"), "text", skipped.alias("skipped"), F.when(skipped, F.array().cast("array<string>")).otherwise(labels).alias("labels"))


@query(
    "cls_skip_empty",
    r"""with v as (select conv_id, turn, role, case turn % 4 when 0 then ' ' when 1 then '(empty table)' when 2 then '-- ... !' else text end as t from conversations)
    select conv_id, turn, role, trim(t) = '(empty table)' or not regexp_matches(t, '[\pL\pN]') as skipped from v""",
)
def skip_empty(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 4
    t = F.when(k == 0, " ").when(k == 1, "(empty table)").when(k == 2, "-- ... !").otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", classify.is_empty(t).alias("skipped"))


_CUES = (("SEC07", ("there", "dann")), ("SEC12", ("hand", "pour")), ("SEC18", ("idiot",)))


@query(
    "cls_rule_labels",
    """select doc_id, case when l = '' then 'SEC99' else l end as labels from (select doc_id, concat_ws(',', case when contains(lower(text), 'there') or contains(lower(text), 'dann') then 'SEC07' end,
        case when contains(lower(text), 'hand') or contains(lower(text), 'pour') then 'SEC12' end, case when contains(lower(text), 'idiot') then 'SEC18' end) as l from documents)""",
)
def rule_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(classify.rule_labels(F.col("text"), _CUES), ",").alias("labels"))


@query(
    "cls_label_payload",
    """select event_id, case event_id % 6 when 0 then 'SEC12,SEC07' when 1 then 'SEC01' end as labels,
        case event_id % 6 when 2 then 'no labels' when 3 then 'unknown labels: SEC77' when 4 then 'unexpected keys' when 5 then 'not JSON' end as error from events""",
)
def label_payload(spark, sf_dir):
    """Six kinds of model answers, checked."""
    answers = ('{"sections": ["SEC12", "SEC07", "SEC12"]}', '{"sections": ["SEC01"]}', '{"sections": []}', '{"sections": ["SEC77"]}', '{"sections": ["SEC01"], "why": 1}', "{sections")
    answer = F.element_at(F.array(*map(F.lit, answers)), (F.col("event_id") % 6 + 1).cast("int"))
    p = classify.parse_labels(answer)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(p["labels"], ",").alias("labels"), p["error"].alias("error"))


@query(
    "cls_prior_context",
    f"""with {_SQL_TURNS},
    k as (select conv_id, idx, idx::varchar || ':' || array_to_string(labels, '+') as s, row_number() over (partition by conv_id order by idx) as n from t where not skipped),
    p as (select a.conv_id, a.idx, (select count(*) from k where k.conv_id = a.conv_id and k.idx < a.idx) as n from t a),
    f as (select a.conv_id, a.idx, e.section, min((e.idx, list_position(b.labels, e.section))) as o from t a join e on e.conv_id = a.conv_id and e.idx < a.idx join t b on b.conv_id = e.conv_id and b.idx = e.idx group by all)
    select p.conv_id, p.idx, coalesce((select string_agg(k.s, ';' order by k.n) from k where k.conv_id = p.conv_id and k.n <= p.n and k.n > p.n - 8), '') as recent,
           coalesce((select string_agg(f.section, ',' order by f.o) from f where f.conv_id = p.conv_id and f.idx = p.idx), '') as seen
    from p""",
)
def prior_context(spark, sf_dir):
    out = classify.prior_context(turns(spark, sf_dir), "conv_id", "idx", "idx", "labels", "skipped")
    return out.select("conv_id", "idx", F.array_join("recent", ";").alias("recent"), F.array_join("seen", ",").alias("seen"))


@query(
    "cls_summary",
    """select user_id, count(*) as n_chunks, sum((event_type = 'view')::int)::bigint as n_skipped, sum((value < 10)::int)::bigint as n_failed, sum(event_id % 3)::bigint as retries
    from events group by user_id""",
)
def summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return classify.summary(e, "user_id", F.col("event_type") == "view", F.col("event_id") % 3, F.col("value") < 10)


@query(
    "review_apply",
    f"""with {_SQL_TURNS},
    r as (select *, case when idx % 5 = 0 then null else case when idx % 3 = 0 then ['SEC07', 'SEC99'] when idx % 7 = 0 then ['SEC77'] else labels end end as rev, idx % 11 <> 0 as ok from t)
    select conv_id, idx, array_to_string(case when skipped then labels else rev end, ',') as labels,
        case when skipped then 'skipped' when rev <> labels then 'modified' else 'confirmed' end as review_action,
        case when skipped then null when rev is null then 'missing update' when not ok then 'not approved' when len(rev) = 0 then 'no labels' when list_contains(rev, 'SEC77') then 'unknown label' end as error,
        array_to_string(list_sort(list_filter(rev, lambda x: not list_contains(labels, x))), ',') as added, case when rev is not null then array_to_string(list_sort(list_filter(labels, lambda x: not list_contains(rev, x))), ',') end as removed
    from r""",
)
def review(spark, sf_dir):
    """Review of labelled turns; every fifth turn has no update."""
    t = turns(spark, sf_dir)
    sections = F.when(F.col("idx") % 3 == 0, F.array(F.lit("SEC07"), F.lit("SEC99"))).when(F.col("idx") % 7 == 0, F.array(F.lit("SEC77"))).otherwise(F.col("labels"))
    updates = t.where("idx % 5 <> 0").select("conv_id", "idx", sections.alias("sections"), (F.col("idx") % 11 != 0).alias("approved"))
    out = classify.apply_review(t, updates, ["conv_id", "idx"])
    join = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return out.select("conv_id", "idx", F.array_join("labels", ",").alias("labels"), "review_action", "error", join("added"), join("removed"))


_SPANS = f"""{_SQL_TURNS},
    g as (select *, case when section = 'SEC99' then idx else idx - row_number() over (partition by conv_id, section order by idx) end as run from e),
    s as (select *, dense_rank() over (partition by conv_id, section order by run) as span_index from g)"""


@query("span_islands", f"with {_SPANS} select conv_id, section, span_index, min(idx) as first_row, max(idx) as last_row, count(*) as n_rows from s where section <> 'SEC99' group by all")
def span_islands(spark, sf_dir):
    return spans.span_table(spans.spans(turns(spark, sf_dir), "conv_id", "idx", "labels"), "conv_id", "idx").where("section <> 'SEC99'")


@query("span_other_singletons", f"with {_SPANS} select conv_id, section, span_index, min(idx) as first_row, max(idx) as last_row, count(*) as n_rows from s where section = 'SEC99' group by all")
def span_singletons(spark, sf_dir):
    return spans.span_table(spans.spans(turns(spark, sf_dir), "conv_id", "idx", "labels"), "conv_id", "idx").where("section = 'SEC99'")


@query(
    "span_merge_nonadjacent",
    f"""with {_SPANS}, m as (select conv_id, section, case when section = 'SEC99' then span_index else 1 end as span_index, string_agg(idx::varchar, ',' order by idx) as members, min(idx) as first_row from s group by all),
    p as (select m.*, list_position(t.labels, m.section) as place from m join t on t.conv_id = m.conv_id and t.idx = m.first_row)
    select conv_id, section, span_index, members, row_number() over (partition by conv_id order by first_row, place, section, span_index) as span_order from p""",
)
def merge_spans(spark, sf_dir):
    t = turns(spark, sf_dir)
    m = spans.merge_nonadjacent(spans.spans(t, "conv_id", "idx", "labels"), "conv_id", "idx")
    out = spans.extraction_order(m, t, "conv_id", "idx")
    return out.select("conv_id", "section", F.col("span_index").cast("long").alias("span_index"), "members", F.col("span_order").cast("long").alias("span_order"))


@query(
    "span_co_sections",
    f"""with {_SPANS} select s.conv_id, s.section, s.span_index, coalesce(string_agg(distinct e.section, ',' order by e.section) filter (where e.section <> s.section), '') as others
    from s join e using (conv_id, idx) group by all""",
)
def co_sections(spark, sf_dir):
    t = turns(spark, sf_dir)
    out = spans.co_sections(spans.spans(t, "conv_id", "idx", "labels"), t, "conv_id", "idx", "labels")
    return out.select("conv_id", "section", "span_index", F.array_join("others", ",").alias("others"))


@query(
    "table_run_components",
    f"""with f as (select l_orderkey, pos, l_quantity, l_returnflag = 'R' as tab, lag(l_returnflag = 'R') over (partition by l_orderkey order by pos) as prev from {LINES}),
    c as (select *, sum((not tab or not coalesce(prev, false))::int) over (partition by l_orderkey order by pos rows unbounded preceding) as component from f)
    select l_orderkey, component::bigint as component, case when bool_or(tab) then 'table_group' else 'text' end as kind, count(*) as n_rows, sum(l_quantity)::bigint as quantity from c group by all""",
)
def table_runs(spark, sf_dir):
    """Consecutive returned lines of an order stand for tables that are merged."""
    c = spans.components(lines(spark, sf_dir), ["l_orderkey"], "pos", F.col("l_returnflag") == "R")
    return c.groupBy("l_orderkey", F.col("component").cast("long").alias("component")).agg(F.max("component_kind").alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(
    "chunk_table_join",
    """select o_orderkey as doc_id, o_orderkey::varchar || case when o_orderkey % 2 = 0 then '_table.txt' else '_text.txt' end as file_name,
        case when l.l_orderkey is not null then 'table' when o_orderkey % 2 = 1 then 'text' else 'unknown' end as kind, l.t as table_id,
        case when o_orderkey % 3 = 0 then o_orderpriority else coalesce(l.r, '') end as content
    from orders left join (select l_orderkey, 'TB' || max(l_partkey)::varchar as t, sum(l_linenumber)::bigint::varchar as r from lineitem group by l_orderkey) l on l.l_orderkey = o_orderkey and o_orderkey % 2 = 0""",
)
def chunk_table(spark, sf_dir):
    """Orders as chunks; some have a table, some a text file."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_table.txt").otherwise("_text.txt"))
    classified = o.select(F.col("o_orderkey").alias("doc_id"), name.alias("file_name"))
    texts = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), name.alias("file_name"), F.col("o_orderpriority").alias("content"))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("TB"), F.max("l_partkey").cast("string")).alias("table_id"), F.sum("l_linenumber").cast("string").alias("rendered_table"))
    t = t.withColumn("chunk_file_name", F.concat(F.col("doc_id").cast("string"), F.lit("_table.txt")))
    return spans.chunk_records(classified, t, texts).select("doc_id", "file_name", "kind", "table_id", "content")


#: Tables of any number of columns made of part names: a table is a brand, a row a size, its cells the parts of that size.
_NAMES = """select p_brand, p_size as row, p_partkey, p_name, row_number() over (partition by p_brand, p_size order by p_partkey) as col from part"""
_ORDERS = (("SEC04", 0, ["hot gear", "new anvil"]), ("SEC04", 1, ["large bolt", "hot anvil", "new rod"]), ("SEC04", 2, ["hot", "new"]))
_SQL_ORDERS = "o(order_no, n, p, label) as (values (0, 2, 1, 'hotgear'), (0, 2, 2, 'newanvil'), (1, 3, 1, 'largebolt'), (1, 3, 2, 'hotanvil'), (1, 3, 3, 'newrod'), (2, 2, 1, 'hot'), (2, 2, 2, 'new'))"


def part_tables(spark, sf_dir):
    """Brands as tables (p_brand, row, n_cells, is_title, cells, section_id)."""
    p = table(spark, sf_dir, "part")
    col = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    shown = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("CL"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    p = p.withColumn("col", col)
    cells = p.select("p_brand", F.col("p_size").alias("row"), "col", F.concat(F.lit("CL"), F.col("p_partkey").cast("string")).alias("cell_id"), F.lit(1).alias("colspan"), F.col("p_name").alias("text"), shown.alias("display_text"), (F.max("col").over(Window.partitionBy("p_brand")) + 1).alias("n"))
    return spans.table_rows(cells, ["p_brand"], "n").withColumn("section_id", F.lit("SEC04"))


def _orders(spark):
    return spark.createDataFrame(list(_ORDERS), "section_id string, order_no int, labels array<string>")


_SQL_SCORES = f"""n as ({_NAMES}), k as (select p_brand, row, col, p_partkey, regexp_replace(lower(p_name), '[^\\pL\\pN_]+', '', 'g') as t from n),
    w as (select *, row_number() over (partition by p_brand order by row) as place from (select p_brand, row, count(*) as n from k group by all)),
    {_SQL_ORDERS},
    c as (select k.p_brand, k.row, o.order_no, case when k.t = '' then 0.0 when k.t = o.label then 1.0 when contains(k.t, o.label) or contains(o.label, k.t) then 0.9 else 0.0 end::double as s
          from k join w using (p_brand, row) join o on o.n = w.n and o.p = k.col where w.place <= 8),
    sc as (select p_brand, row, order_no, (min(s) + avg(s)) / 2 as score from c group by all)"""


@query(
    "hdr_best_match",
    f"""with {_SQL_SCORES}, b as (select *, row_number() over (partition by p_brand order by score desc, row, order_no) as n from sc where score > 0)
    select p_brand, row::bigint as row, order_no::bigint as order_no, round(score, 6) as score from b where n = 1""",
)
def best_match(spark, sf_dir):
    b = headers.best_match(headers.match_scores(part_tables(spark, sf_dir), _orders(spark), ["p_brand"]), ["p_brand"])
    return b.select("p_brand", F.col("row").cast("long").alias("row"), F.col("order_no").cast("long").alias("order_no"), F.round("score", 6).alias("score"))


@query("hdr_similarity_fuzzy")
def fuzzy(spark, sf_dir):
    """Similarity of part names with their type, by matching blocks where no label holds the other; checked by tests."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(label_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query(
    "hdr_heuristic",
    f"""with {_SQL_SCORES}, b as (select *, row_number() over (partition by p_brand order by score desc, row, order_no) as n from sc where score > 0),
    lc as (select p_brand, max(n) as lc from w group by all),
    sh as (select p_brand, row, bool_and(p_partkey % 7 <> 0) as shown, string_agg(p_name, '|' order by col) as labels from n group by all),
    m as (select b.p_brand, b.row, b.order_no, sh.shown from b join sh using (p_brand, row) where b.n = 1 and b.score >= 0.9),
    d as (select w.p_brand, min_by(sh.labels, w.row) as labels, min(w.row) as row from w join sh using (p_brand, row) join lc using (p_brand) where w.place <= 8 and w.n = lc.lc and sh.shown group by all)
    select lc.p_brand, case when m.row is not null and m.shown then 'visible_valid' when m.row is not null then 'hidden_valid' when d.row is not null then 'visible_valid' else 'missing' end as header_state,
        case when m.row is not null then ['hot gear|new anvil', 'large bolt|hot anvil|new rod', 'hot|new'][m.order_no + 1] when d.row is not null then d.labels
             when lc.lc in (2, 3) then ['hot gear|new anvil', 'large bolt|hot anvil|new rod'][lc.lc - 1] else array_to_string(list_transform(range(1, lc.lc + 1), lambda i: 'Column ' || i), '|') end as columns,
        coalesce(m.row, d.row)::bigint as header_row
    from lc left join m using (p_brand) left join d using (p_brand)""",
)
def heuristic(spark, sf_dir):
    rows, orders = part_tables(spark, sf_dir), _orders(spark)
    tables = spans.logical_columns(rows, ["p_brand"]).withColumn("section_id", F.lit("SEC04"))
    seen = headers.visible_header(rows.join(tables.drop("section_id"), "p_brand"), ["p_brand"], "logical_columns")
    best = headers.best_match(headers.match_scores(rows, orders, ["p_brand"]), ["p_brand"])
    out = headers.resolve(tables, best, seen, rows, orders, ["p_brand"])
    return out.select("p_brand", "header_state", F.array_join("valid_column_order", "|").alias("columns"), F.col("header_row").cast("long").alias("header_row"))


@query(
    "hdr_primary_group",
    f"""with c as (select l_orderkey, l_returnflag, l_linestatus, count(*) as n_rows, min(pos) as position, max(l_quantity)::int % 4 as logical_columns, (max(l_partkey) % 5) / 5.0::double as score from {LINES} group by all),
    r as (select *, row_number() over (partition by l_orderkey, l_linestatus order by score desc, n_rows desc, position) as n from c where logical_columns >= 1)
    select l_orderkey, l_linestatus, l_returnflag, n_rows, position from r where n = 1""",
)
def primary(spark, sf_dir):
    """An order's lines by flag stand for the table groups of a span."""
    g = lines(spark, sf_dir).groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("position"), (F.max("l_quantity").cast("int") % 4).alias("logical_columns"), ((F.max("l_partkey") % 5) / 5).alias("score"),
    )
    return headers.primary_table(g, ["l_orderkey", "l_linestatus"]).select("l_orderkey", "l_linestatus", "l_returnflag", "n_rows", "position")


@query(
    "hdr_validate",
    """select event_id, case event_id % 5 when 1 then 'not JSON' when 2 then 'wrong keys' when 3 then 'inspection_required against state' when 4 then 'not all cells of one row' end as error from events""",
)
def validate(spark, sf_dir):
    """Five kinds of answers on a table of one row CL000001, CL000002."""
    good = '{"status": "resolved", "inspection_required": %s, "header_state": "visible_valid", "valid_column_order": ["a", "b"], "actual_header_row_exists": true, "actual_header_row_index": 1, "actual_header_cell_ids": [%s], "brief_description": "x"}'
    both = '"CL000001", "CL000002"'
    answers = (good % ("false", both), "{", '{"status": "resolved"}', good % ("true", both), good % ("false", '"CL000001"'))
    answer = F.element_at(F.array(*map(F.lit, answers)), (F.col("event_id") % 5 + 1).cast("int"))
    ids = F.array(F.lit("CL000001"), F.lit("CL000002"))
    return table(spark, sf_dir, "events").select("event_id", headers.validate(answer, ids, F.create_map(F.lit(1), ids)).alias("error"))


@query(
    "hdr_summary",
    """with s as (select distinct o_custkey, o_orderkey from orders), r as (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then 'llm' else 'heuristic' end as who, o_orderkey % 5 = 0 as req from orders where o_orderstatus <> 'O')
    select s.o_custkey, count(*) as n_spans, sum((r.who is null)::int)::bigint as n_skipped, sum((r.who = 'llm' and r.who is not null)::int)::bigint as n_llm, sum(coalesce(r.who = 'heuristic', false)::int)::bigint as n_fallback, sum(coalesce(req, false)::int)::bigint as n_required
    from s left join r using (o_custkey, o_orderkey) group by s.o_custkey""",
)
def header_summary(spark, sf_dir):
    """Orders stand for spans; open ones have no table."""
    o = table(spark, sf_dir, "orders")
    resolved = o.where("o_orderstatus <> 'O'").select("o_custkey", "o_orderkey", F.lit("resolved").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "llm").otherwise("heuristic").alias("resolved_by"), (F.col("o_orderkey") % 5 == 0).alias("inspection_required"))
    return headers.summary(headers.with_skipped(o, resolved, ["o_custkey", "o_orderkey"]), "o_custkey")
