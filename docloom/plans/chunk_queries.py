"""Groups B and C: chunks, numbering, assets and grids over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import chunks, grid
from ..operators.windows import forward_fill, ordered
from .base import LINES, Registry, lines, table

query = Registry()


@query(
    "doc_text_islands",
    r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
    k as (select *, regexp_matches(t, '[0-9]') as tab from l where trim(t) <> '' or regexp_matches(t, '[0-9]')),
    f as (select *, tab or coalesce(lag(tab) over w, true) as first from k window w as (partition by doc_id order by pos)),
    n as (select *, sum(first::int) over (partition by doc_id order by pos rows unbounded preceding) - 1 as chunk_index from f)
    select doc_id, chunk_index::bigint as chunk_index, case when bool_or(tab) then 'table' else 'text' end as chunk_type, count(*) as n_blocks,
           string_agg(rtrim(t), chr(10) || chr(10) order by pos) as content
    from n group by all""",
)
def text_islands(spark, sf_dir):
    """Chunks of documents whose lines with a digit stand for tables."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    out = chunks.assemble(d.withColumn("is_table", F.col("text").rlike("[0-9]")))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", "n_blocks", "content")


_ITEMS = "(pos + l_partkey) % 3"


@query(
    "list_numbering",
    f"""with i as (select l_orderkey, pos, {_ITEMS} as lv from {LINES}),
    b as (select a.l_orderkey, a.pos, a.lv, k, coalesce(max(r.pos), 0) as since
          from i a cross join (values (0), (1), (2)) v(k) left join i r on r.l_orderkey = a.l_orderkey and r.pos <= a.pos and r.lv < k
          group by all),
    m as (select b.l_orderkey, b.pos, b.lv, k, count(i.pos) as n
          from b left join i on i.l_orderkey = b.l_orderkey and i.lv = b.k and i.pos > b.since and i.pos <= b.pos group by all),
    n as (select *, case when k > lv then 1 else greatest(1, n) end as v from m)
    select l_orderkey, pos, lv::bigint as level, string_agg(v::varchar, '.' order by k) filter (where k <= lv) || '.' as label
    from n group by l_orderkey, pos, lv""",
)
def list_numbering(spark, sf_dir):
    """Labels of three-level lists: an order is a list, its lines are items."""
    i = lines(spark, sf_dir).select("l_orderkey", "pos", F.expr(_ITEMS).cast("int").alias("level"))
    v = chunks.list_values(i, "l_orderkey", "pos", "level", 3)
    label = F.concat(F.array_join(F.slice(F.array("v0", "v1", "v2"), F.lit(1), F.col("level") + 1), "."), F.lit("."))
    return v.select("l_orderkey", "pos", F.col("level").cast("long").alias("level"), label.alias("label"))


@query(
    "asset_dedup_first",
    f"""with f as (select l_orderkey, l_partkey % 5 as source_part, min(pos) as first_pos from {LINES} group by all)
    select l_orderkey, source_part, first_pos, 'EM' || lpad((row_number() over (partition by l_orderkey order by first_pos))::varchar, 6, '0') as asset_id from f""",
)
def asset_dedup(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", "pos", (F.col("l_partkey") % 5).alias("source_part"))
    return chunks.first_seen_ids(rows, "l_orderkey", "pos", "source_part")


@query(
    "asset_row_label",
    f"""with c as (select l_orderkey, (pos - 1) // 3 as r, pos as c, case when l_partkey % 4 = 0 then '' else p_name end as t,
                         case when l_suppkey % 3 = 0 then l_partkey % 2 end as asset from {LINES} join part on l_partkey = p_partkey)
    select a.l_orderkey, a.asset, min_by(b.t, (a.r, a.c, b.c)) as label from c a join c b using (l_orderkey, r)
    where a.asset is not null and b.t <> '' and a.c <> b.c group by all""",
)
def asset_row_label(spark, sf_dir):
    """An asset is named by the first other cell of its row."""
    l, p = lines(spark, sf_dir), table(spark, sf_dir, "part")
    c = l.join(p, l["l_partkey"] == p["p_partkey"]).select(
        "l_orderkey", F.floor((F.col("pos") - 1) / 3).alias("r0"), F.col("pos").alias("c0"),
        F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.col("p_name")).alias("t"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey") % 2).alias("a"),
    )
    return chunks.row_labels(c, ["l_orderkey"], "r0", "c0", "t", "a")


_CELLS = f"""select l_orderkey, (pos - 1) // 2 as r, pos, 1 + l_quantity::int % 3 as span, l_returnflag = 'R' as cont from {LINES}"""


@query(
    "grid_occupancy",
    f"""with c as ({_CELLS}),
    s as (select *, coalesce(sum(span) over (partition by l_orderkey, r order by pos rows between unbounded preceding and 1 preceding), 0) as start from c),
    wd as (select l_orderkey, max(start + span) as width from s group by all),
    g as (select r.l_orderkey, r.r, unnest(range(width::bigint)) as c from (select distinct l_orderkey, r from c) r join wd using (l_orderkey)),
    f as (select g.l_orderkey, g.r, g.c, s.pos, s.cont from g left join s on s.l_orderkey = g.l_orderkey and s.r = g.r and g.c >= s.start and g.c < s.start + s.span),
    t as (select a.*, (select max(b.r) from f b where b.l_orderkey = a.l_orderkey and b.c = a.c and b.r <= a.r and coalesce(b.cont, false) = false) as top from f a)
    select t.l_orderkey, t.r, t.c, case when not coalesce(t.cont, false) then t.pos else coalesce(
        (select f.pos from f where f.l_orderkey = t.l_orderkey and f.c = t.c and f.r = t.top),
        (select min(f.pos) from f where f.l_orderkey = t.l_orderkey and f.c = t.c and f.cont and f.r <= t.r and f.r > coalesce(t.top, -1))) end as anchor
    from t""",
)
def occupancy(spark, sf_dir):
    """Which line item each position of an order's grid shows; those returned continue the one above."""
    c = lines(spark, sf_dir).select(
        "l_orderkey", F.floor((F.col("pos") - 1) / 2).alias("row"), "pos", (F.col("l_quantity").cast("int") % 3 + 1).cast("long").alias("span"), (F.col("l_returnflag") == "R").alias("cont"),
    )
    return grid.occupancy(c, "l_orderkey", "row", "pos", "span", "cont")


@query(
    "grid_trim_blank",
    f"""with c as (select l_orderkey, (pos - 1) // 3 as r, (pos - 1) % 3 as c, case when l_partkey % 3 = 0 then l_shipdate::date::varchar else '<u> </u>' end as t from {LINES}),
    k as (select *, max((l_t)::int) over (partition by l_orderkey, r) as kr, max((l_t)::int) over (partition by l_orderkey, c) as kc from (select *, t not like '<u>%' as l_t from c))
    select l_orderkey, dense_rank() over (partition by l_orderkey order by r) - 1 as new_row, dense_rank() over (partition by l_orderkey order by c) - 1 as new_col, t as text
    from k where kr = 1 and kc = 1""",
)
def trim_blank(spark, sf_dir):
    l = lines(spark, sf_dir)
    c = l.select(
        "l_orderkey", F.floor((F.col("pos") - 1) / 3).alias("r"), ((F.col("pos") - 1) % 3).alias("c"),
        F.when(F.col("l_partkey") % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("<u> </u>").alias("text"),
    )
    out = grid.trim(c, "l_orderkey", "r", "c", "text")
    return out.select("l_orderkey", F.col("new_row").cast("long").alias("new_row"), F.col("new_col").cast("long").alias("new_col"), "text")


@query(
    "grid_display_text",
    f"""with c as (select l_orderkey, pos, 'CL' || lpad((l_orderkey % 10000 * 10 + pos)::varchar, 6, '0') as cell_id, case when l_partkey % 5 = 0 then '' else l_shipdate::date::varchar end as t,
                         case when l_returnflag = 'R' and pos = 2 then '#222A35' end as color from {LINES})
    select l_orderkey, pos, case when t = '' then '' when color is not null then t || ' [' || color || ']' when max((color is not null)::int) over (partition by l_orderkey) = 1 then cell_id else t end as display_text
    from c""",
)
def display_text(spark, sf_dir):
    """In orders with a filled cell, the others show their ids."""
    c = lines(spark, sf_dir).select(
        "l_orderkey", "pos", F.concat(F.lit("CL"), F.lpad((F.col("l_orderkey") % 10000 * 10 + F.col("pos")).cast("string"), 6, "0")).alias("cell_id"),
        F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("t"), F.when((F.col("l_returnflag") == "R") & (F.col("pos") == 2), "#222A35").alias("color"),
    )
    return grid.display(c, ["l_orderkey"], "cell_id", "t", "color").select("l_orderkey", "pos", "display_text")


@query(
    "grid_col_widths",
    """select r_name as t, 0::bigint as col, max(length(n_name))::bigint as width from nation join region on n_regionkey = r_regionkey group by all
    union all select r_name, 1, max(length(n_nationkey::varchar)) from nation join region on n_regionkey = r_regionkey group by all""",
)
def col_widths(spark, sf_dir):
    """Widths of a table of nations for each region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    cells = both.select(F.col("r_name").alias("t"), F.posexplode(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("col", "text"))
    out = grid.widths(cells, "t", "col", "text")
    return out.select("t", F.col("col").cast("long").alias("col"), F.col("width").cast("long").alias("width"))


@query(
    "vmerge_forward_fill",
    f"""with c as (select l_orderkey, pos, case when l_returnflag <> 'R' then l_partkey end as v from {LINES})
    select l_orderkey, pos, last_value(v ignore nulls) over (partition by l_orderkey order by pos rows unbounded preceding) as filled from c""",
)
def ffill(spark, sf_dir):
    c = lines(spark, sf_dir).select("l_orderkey", "pos", F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("v"))
    return c.select("l_orderkey", "pos", forward_fill(F.col("v"), ordered(["l_orderkey"], ["pos"])).alias("filled"))


@query(
    "grid_render",
    r"""with c as (select r_name as t, n_nationkey as row, unnest([0, 1]) as col, unnest([n_name, n_nationkey::varchar]) as text from nation join region on n_regionkey = r_regionkey),
    w as (select t, col, max(length(text)) as width from c group by all),
    b as (select t, '+' || string_agg(repeat('-', (width + 2)::int) || '+', '' order by col) as border from w group by t),
    l as (select t, row, '|' || string_agg(' ' || rpad(text, width::int, ' ') || ' |', '' order by col) as line from c join w using (t, col) group by all)
    select t, any_value(border) || chr(10) || string_agg(line || chr(10) || border, chr(10) order by row) as rendered from l join b using (t) group by t""",
)
def render(spark, sf_dir):
    """A drawn table of nations for each region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    cells = both.select(F.col("r_name").alias("t"), F.col("n_nationkey").alias("row"), F.posexplode(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("col", "text"))
    return grid.render(cells, "t", "row", "col", "text")
