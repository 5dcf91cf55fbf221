"""The queries of this subpackage, by the name under which they are registered, and their SQL where there is one."""

from . import conversation_repair, fingerprints, html_extract, importance, language_id, license_scan, mixing, pii, quality_classifier, quality_rules, sentencepiece_nbest, simhash, suffix_dedup

QUERIES = {
    "op7_suffix_dedup": suffix_dedup.query,
    "op1_html_extraction": html_extract.query,
    "op2_quality_classifier": quality_classifier.query,
    "op6_sentencepiece": sentencepiece_nbest.query,
    "op4_pii": pii.query,
    "op3_fingerprints": fingerprints.query,
    "op9_language_id": language_id.query,
    "op5_mixing": mixing.query,
    "op8_simhash": simhash.query,
    "op10_quality_rules": quality_rules.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_importance_resampling": importance.query,
    "op13_license_scan": license_scan.query,
}
ORACLES = {"op5_mixing": mixing.ORACLE, "op12_importance_resampling": importance.ORACLE, "op13_license_scan": license_scan.ORACLE}


def edited_texts(spark, sf_dir):
    """What SQL can say of op3: sizes and edited texts."""
    return fingerprints.query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base_spans(spark, sf_dir):
    """What SQL can say of op4: counts of base spans."""
    return pii.query(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_measures(spark, sf_dir):
    """What SQL can say of op10: the base measures and the base rule."""
    return quality_rules.query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES |= {"llm_edited_texts": edited_texts, "llm_base_spans": base_spans, "llm_base_measures": base_measures}
ORACLES |= {
    "llm_edited_texts": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as next from d)
select doc_id, length(text)::bigint as n_chars, sha256(left(text, length(text) - length(text) // 2) || left(next, length(text) // 2)) as edited_sha256 from n
""",
    "llm_base_spans": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as email, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ip,
    list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as card, list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as phone from d)
select doc_id, len(email)::bigint as n_email,
    len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 or ('0' || ltrim(p, '0'))::bigint > 255)) = 0))::bigint as n_ip,
    len(list_filter(card, lambda x: length(x) between 12 and 19 and list_sum(list_transform(range(1, length(x) + 1), lambda i: case when i % 2 = 1 then substr(reverse(x), i, 1)::int else (2 * substr(reverse(x), i, 1)::int) // 10 + (2 * substr(reverse(x), i, 1)::int) % 10 end)) % 10 = 0))::bigint as n_card,
    len(list_filter(phone, lambda x: length(x) between 9 and 15))::bigint as n_phone from m
""",
    "llm_base_measures": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
t as (select doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] as gram from g),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as n from t) where n > 1),
c as (select doc_id, count(distinct i + k)::bigint as n from r, (values (0), (1), (2)) v(k) group by doc_id),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d)
select w.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(words) < 50 or 100 * coalesce(c.n, 0) > 50 * len(words) as base_failed
from w join l using (doc_id) left join c on c.doc_id = w.doc_id
""",
}
