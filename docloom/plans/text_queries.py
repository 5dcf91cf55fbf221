"""Group A: text functions over the driver's tables."""

from pyspark.sql import functions as F

from ..functions import text as T
from .base import Registry, table

query = Registry()


@query(
    "txt_preview",
    r"""select doc_id, case when length(f) > 220 then left(f, 217) || '...' else f end as preview
    from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as f from documents)""",
)
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(
    "txt_normalize_lines",
    r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as normalized
    from documents""",
)
def normalize_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(
    "txt_word_stats",
    r"""with w as (
        select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint as n_words,
               len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::bigint as n_segments from documents)
    select doc_id, n_words, n_segments, case when n_words > 500 then least(ceil(n_words / 400.0)::bigint, n_segments) else 1 end as n_parts from w""",
)
def word_stats(spark, sf_dir):
    """Words, lines with text, and the parts that a balanced split makes of them."""
    d = table(spark, sf_dir, "documents")
    segments = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    d = d.select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"), segments.alias("n_segments"))
    parts = F.when(F.col("n_words") > 500, F.least(F.ceil(F.col("n_words") / 400), F.col("n_segments"))).otherwise(F.lit(1))
    return d.withColumn("n_parts", parts.cast("long"))


@query(
    "txt_strip_markup",
    r"""with s as (select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as stripped from pages)
    select page_id, stripped, md5(regexp_replace(translate(lower(stripped), '/', ' '), '[^\pL\pN_]+', '', 'g')) as label_key from s""",
)
def strip_markup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.strip_markup(F.col("html")).alias("stripped"), F.md5(T.normalize_label(F.col("html"))).alias("label_key"))


#: Five Arabic letters, which the corpus lacks.
_ARABIC = "مرحبا"
_MIXED = f"""case doc_id % 4 when 0 then text when 1 then repeat('{_ARABIC}', cast(1 + doc_id % 7 * (1 + length(text) / 64) as int)) || text
             when 2 then text || '{_ARABIC}' else '{_ARABIC}' || text end"""


@query(
    "txt_direction",
    rf"""with m as (select doc_id, {_MIXED} as t from documents),
    c as (select doc_id, t, len(regexp_extract_all(t, '[\x{{0590}}-\x{{08ff}}]')) as r, len(regexp_extract_all(t, '[A-Za-z]')) as l from m)
    select doc_id, case when r = 0 then 'ltr' when l = 0 then 'rtl' when r >= greatest(2, floor(l * 0.45::double)) then 'rtl'
        when regexp_matches(regexp_extract(t, '[\x{{0590}}-\x{{08ff}}A-Za-z]'), '[A-Za-z]') then 'ltr' else 'rtl' end as direction
    from c""",
)
def direction(spark, sf_dir):
    """Directions of texts mixed with Arabic in four ways."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MIXED).alias("t"))
    return d.select("doc_id", T.dominant_direction(F.col("t")).alias("direction"))


@query(
    "txt_direction_whole",
    rf"""with m as (select doc_id, case when doc_id % 2 = 0 then text || a else a || text end as t
        from (select doc_id, text, repeat('{_ARABIC}', (length(text) * (doc_id % 13) // 100)::int) as a from documents)),
    c as (select doc_id, t, len(regexp_extract_all(t, '[\x{{0590}}-\x{{08ff}}]')) as r, len(regexp_extract_all(t, '[A-Za-z]')) as l from m)
    select doc_id, case when r = 0 then 'ltr' when l = 0 then 'rtl' when r >= greatest(2, floor(l * 0.45::double)) then 'rtl'
        when regexp_matches(regexp_extract(t, '[\x{{0590}}-\x{{08ff}}A-Za-z]'), '[A-Za-z]') then 'ltr' else 'rtl' end as direction
    from c""",
)
def direction_whole(spark, sf_dir):
    """Directions of whole texts with Arabic before or after them, up to 12 words for every 100 characters."""
    more = f"repeat('{_ARABIC}', cast(length(text) * (doc_id % 13) div 100 as int))"
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"case when doc_id % 2 = 0 then text || {more} else {more} || text end").alias("t"))
    return d.select("doc_id", T.dominant_direction(F.col("t")).alias("direction"))


@query(
    "txt_doc_id_codec",
    """select c_custkey, translate(rtrim(to_base64(encode(c_name)), '='), '+/', '-_') as encoded, c_name as decoded from customer""",
)
def doc_id_codec(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    code = T.encode_id(F.col("c_name"))
    padded = F.rpad(code, ((F.length(code) + 3) / 4).cast("int") * 4, "=")
    return c.select("c_custkey", code.alias("encoded"), T.decode_id(padded).alias("decoded"))


@query(
    "txt_run_suffix_sop_code",
    r"""with n as (select o_orderkey, 'SOP-' || lpad((o_orderkey % 100000)::varchar, greatest(3, length((o_orderkey % 100000)::varchar))::int, '0') || ' Policy_' || strftime(o_orderdate, '%Y%m%d') || '_'
            || lpad((o_custkey % 1000000)::varchar, 6, '0') || case when o_orderkey % 3 = 0 then '_2' else '' end as name from orders)
    select o_orderkey, regexp_replace(name, '(?:[_\s-]+)?[0-9]{8}_[0-9]{6}(?:_[0-9]+)?$', '') as stripped,
           regexp_extract(name, '(?i)\bSOP\W*([0-9]{2,6})\b', 1) as code,
           name || '|' || regexp_replace(name, '(?:[_\s-]+)?[0-9]{8}_[0-9]{6}(?:_[0-9]+)?$', '') as candidates
    from n""",
)
def run_suffix(spark, sf_dir):
    key = F.greatest(F.lit(3), F.length((F.col("o_orderkey") % 100000).cast("string")))
    name = F.concat(
        F.lit("SOP-"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), key, "0"), F.lit(" Policy_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"),
        F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0"), F.when(F.col("o_orderkey") % 3 == 0, "_2").otherwise(""),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    n = F.col("name")
    return o.select("o_orderkey", T.strip_run_suffix(n).alias("stripped"), T.sop_code(n).alias("code"), F.array_join(T.name_candidates(n), "|").alias("candidates"))


@query(
    "txt_color_contrast",
    r"""with c as (select p_partkey, p_name, upper(lpad(printf('%x', (p_partkey * 7919) % 16777216), 6, '0')) as h from part)
    select p_partkey, '#' || h as color, trim(p_name || ' ') as label,
        case when 0.299::double * ('0x' || substr(h, 1, 2))::int + 0.587::double * ('0x' || substr(h, 3, 2))::int + 0.114::double * ('0x' || substr(h, 5, 2))::int < 140 then '#ffffff' else '#243746' end as contrast
    from c""",
)
def color_contrast(spark, sf_dir):
    """The fill of a cell, its text without the fill, and a legible colour on it."""
    h = F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" [#000000] [#"), h, F.lit("]")).alias("t"))
    color = T.display_color(F.col("t"))
    return p.select("p_partkey", color.alias("color"), T.without_color(F.col("t")).alias("label"), T.contrast_color(color).alias("contrast"))


_ROMAN = " || ".join(
    f"(['', {', '.join(repr(x) for x in (a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c))}])[1 + (n // {p}) % 10]"
    for p, a, b, c in ((100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X"))
)


@query(
    "num_format_labels",
    rf"""with v as (select p_partkey, p_partkey % 4000 as n, p_size::bigint as s from part)
    select p_partkey, case when n = 0 then '0' else repeat('M', (n // 1000)::int) || {_ROMAN} end as roman,
        case when n = 0 then '0' when n <= 26 then chr((96 + n)::int) when n <= 702 then chr((96 + (n - 1) // 26)::int) || chr((97 + (n - 1) % 26)::int)
             else chr((96 + ((n - 1) // 26 - 1) // 26)::int) || chr((97 + ((n - 1) // 26 - 1) % 26)::int) || chr((97 + (n - 1) % 26)::int) end as letters,
        s::varchar as plain from v""",
)
def number_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 4000
    return p.select("p_partkey", T.number_label(n, F.lit("upperRoman")).alias("roman"), T.number_label(n, F.lit("lowerLetter")).alias("letters"), T.number_label(F.col("p_size"), F.lit("decimal")).alias("plain"))


@query(
    "txt_mojibake_repair",
    f"""select r_regionkey, repeat('{_ARABIC}', r_regionkey + 1) as repaired, repeat('{_ARABIC}', r_regionkey + 1) as arabic, true as same, -15::bigint * (r_regionkey + 1) as quality from region""",
)
def mojibake_repair(spark, sf_dir):
    """Regions' names in Arabic, read once with the wrong decoding, and repaired; the bad text has 5 signs of that per name."""
    r = table(spark, sf_dir, "region").withColumn("arabic", F.repeat(F.lit(_ARABIC), F.col("r_regionkey") + 1))
    broken = F.decode(F.encode("arabic", "UTF-8"), "ISO-8859-1")
    return r.select("r_regionkey", T.repair(broken).alias("repaired"), "arabic", (T.repair(broken) == F.col("arabic")).alias("same"), T.text_quality(broken).cast("long").alias("quality"))


_CURLY = "replace(replace(translate(text, 'ÁÍÏÐÝ\u00a0', 'AIIDY '), ' a', ' \u2018a'), 'e.', 'e\u2019 \u2013 \u2026')"


@query(
    "txt_mojibake_whole",
    f"""with t as (select doc_id, case when doc_id % 2 = 0 then translate(text, chr(160), ' ') else {_CURLY} end as text from documents)
    select doc_id, text as repaired, length(text)::bigint as n_chars from t""",
)
def mojibake_whole(spark, sf_dir):
    """Whole documents read wrongly, even ids as Latin-1, odd ones (with curly quotes, dashes and dots) as Windows-1252, and repaired: they are what they were."""
    curly = F.replace(F.replace(F.translate("text", "ÁÍÏÐÝ\u00a0", "AIIDY "), F.lit(" a"), F.lit(" \u2018a")), F.lit("e."), F.lit("e\u2019 \u2013 \u2026"))
    d = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\u00a0", " ")).otherwise(curly))
    latin = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    windows = F.translate(latin, "".join(T._WINDOWS.values()), "".join(T._WINDOWS))
    fixed = T.repair(F.when(F.col("doc_id") % 2 == 0, latin).otherwise(windows))
    return d.select("doc_id", fixed.alias("repaired"), F.length(fixed).cast("long").alias("n_chars"))
