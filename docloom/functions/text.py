"""Text functions as column expressions. Regular expressions are Unicode-aware where Python's would be."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters without width, and direction marks.
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060\ufeff]"
MARKUP = r"<[^>]+>"
COLOR_TOKEN = r"\s*\[#([0-9A-Fa-f]{6})\]\s*"
REFERENCE = r"CL[0-9]{6}|<TB[0-9]{6}>|<EM[0-9]{6}>"
#: Letters written right to left (Hebrew to Arabic blocks and presentation forms), and left to right.
RTL = "[\u0590-\u08ff\ufb1d-\ufdfd\ufe70-\ufefc]"
LTR = "[A-Za-z]"


def collapse(x: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")


def preview(x: Column, limit: int = 220) -> Column:
    """Collapsed text, cut to limit with three dots."""
    flat = collapse(x)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def clip(x: Column, width: int) -> Column:
    """Collapsed text, cut to width with a `>` as the last character."""
    flat = collapse(x)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, max(width - 1, 0)), F.lit(">"))).otherwise(flat)


def _line_ends(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def normalize(x: Column) -> Column:
    """Lines trimmed, spaces and tabs collapsed, at most one blank line in a row, none at the ends."""
    flat = F.regexp_replace(_line_ends(x), r"[ \t]+", " ")
    flat = F.regexp_replace(flat, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    return F.regexp_replace(F.regexp_replace(flat, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def is_grid_line(line: Column) -> Column:
    """Whether a line is a border or a row of a drawn table."""
    return F.regexp_replace(line, r"(?U)\s+$", "").rlike(r"^(?:\+.*\+|\|.*\|)$")


#: White space but spaces and line feeds.
_OTHER_SPACE = "[\\t\\x0B\\f\\r\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def normalize_indented(x: Column, keep_tables: bool = False) -> Column:
    """Like normalize, but each line keeps its leading spaces and tabs; drawn tables keep their inner spacing if asked."""

    def clean(line: Column) -> Column:
        lead = F.regexp_extract(line, r"^([ \t]*)", 1)
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^[ \t]*", ""), r"[ \t]+", " "), r"(?U)\s+$", "")
        plain = F.when(F.regexp_replace(line, r"(?U)\s+", "") == "", F.lit("")).otherwise(F.concat(lead, rest))
        return F.when(is_grid_line(line), F.regexp_replace(line, r"(?U)\s+$", "")).otherwise(plain) if keep_tables else plain

    lines = F.array_join(F.transform(F.split(_line_ends(x), "\n"), clean), "\n")
    full = F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    # Most texts have nothing to clean, which a few searches tell.
    found = [F.contains(x, F.lit(y)) for y in ("  ", " \n", "\n\n\n")] + [x.startswith("\n"), x.endswith("\n"), x.endswith(" "), x.rlike(_OTHER_SPACE)]
    return F.when(~functools.reduce(lambda a, b: a | b, found), x).otherwise(full)


def word_count(x: Column) -> Column:
    """Number of words between Unicode white space."""
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def strip_markup(x: Column) -> Column:
    """Tags become spaces, white space collapses."""
    return collapse(F.regexp_replace(x, MARKUP, " "))


def normalize_label(x: Column) -> Column:
    """Lower-case letters, digits and underscores of a label, for comparison."""
    flat = F.translate(F.lower(strip_markup(x)), "/", " ")
    return F.regexp_replace(flat, r"(?U)[^\w]+", "")


def text_quality(x: Column) -> Column:
    """Arabic letters for, signs of a wrong decoding and replacement characters against a text."""
    arabic = F.regexp_count(x, F.lit("[\u0600-\u06ff]"))
    wrong = F.regexp_count(x, F.lit("[ØÙÃÂâ]"))
    return arabic * 4 - wrong * 3 - F.regexp_count(x, F.lit("�")) * 8


#: What Windows-1252 has where Latin-1 has control characters; five of these have nothing.
_WINDOWS = {c: chr(b) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def _read_again(x: Column, extra: str = "") -> Column:
    """The text whose UTF-8 was read as Latin-1, or as Windows-1252 if extra has its own characters; null if it is none."""
    bytes_ = F.encode(F.translate(x, extra, "".join(_WINDOWS[c] for c in extra)) if extra else x, "ISO-8859-1")
    fits = x.rlike(rf"^[\x00-\x7F\xA0-\xFF{extra}]*$") & x.rlike(f"[{extra}]") if extra else x.rlike(r"^[\x00-\xFF]*$") & x.rlike(r"[\x80-\xFF]")
    return F.when(fits, F.try_validate_utf8(bytes_.cast("string")))


def repair(x: Column, bullets: tuple[str, str] = ("•", "▪")) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252 is read again if that makes the text better; private bullets and hard spaces go.

    Only texts whose characters all fit the encoding are tried, as encode() raises on others; bytes that are not UTF-8
    leave the text as it is.
    """
    best = x
    for again in (_read_again(x), _read_again(x, "".join(_WINDOWS))):
        best = F.when(again.isNotNull() & (text_quality(again) > text_quality(best)), again).otherwise(best)
    return F.translate(best, "\uf0b7\uf0a7\u00a0", bullets[0] + bullets[1] + " ")


def dominant_direction(x: Column) -> Column:
    """rtl or ltr: right-to-left letters win from two, or 45 % of the Latin ones, on; below that the first letter decides."""
    bare = F.regexp_replace(x, r"</?(?:strong|em|u)>|</?HL[^>]*>", "")
    rtl, ltr = F.regexp_count(bare, F.lit(RTL)), F.regexp_count(bare, F.lit(LTR))
    first = F.regexp_extract(bare, f"({RTL}|{LTR})", 1)
    return (
        F.when(rtl == 0, "ltr")
        .when(ltr == 0, "rtl")
        .when(rtl >= F.greatest(F.lit(2), F.floor(ltr * F.lit(0.45)).cast("int")), "rtl")
        .when(first.rlike(RTL), "rtl")
        .otherwise("ltr")
    )


def display_color(x: Column) -> Column:
    """The last fill token of a cell, as #RRGGBB; null if there is none."""
    found = F.regexp_extract_all(x, F.lit(COLOR_TOKEN), F.lit(1))
    return F.when(F.size(found) > 0, F.concat(F.lit("#"), F.try_element_at(found, F.lit(-1))))


def without_color(x: Column) -> Column:
    """A cell's text without fill tokens."""
    flat = F.regexp_replace(F.regexp_replace(x, COLOR_TOKEN, " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(flat, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def contrast_color(color: Column) -> Column:
    """White on dark fills, dark on light ones and where there is no valid colour."""
    part = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("int")
    luminance = part(2) * F.lit(0.299) + part(4) * F.lit(0.587) + part(6) * F.lit(0.114)
    return F.when(color.rlike("^#[0-9A-Fa-f]{6}$") & (luminance < 140), "#ffffff").otherwise("#243746")


def encode_id(x: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.translate(F.rtrim(F.base64(F.encode(x, "UTF-8")), F.lit("=")), "+/", "-_")


def decode_id(x: Column) -> Column:
    """The text of encode_id; null for what is not such an id."""
    return F.try_validate_utf8(F.unbase64(F.translate(x, "-_", "+/")).cast("string"))


def strip_run_suffix(x: Column) -> Column:
    """A name without the time stamp of its run."""
    return F.regexp_replace(x, r"(?:[_\s-]+)?[0-9]{8}_[0-9]{6}(?:_[0-9]+)?$", "")


def sop_code(x: Column) -> Column:
    """The digits of a procedure's code; empty if there is none."""
    return F.regexp_extract(x, r"(?i)\bSOP\W*([0-9]{2,6})\b", 1)


def name_candidates(x: Column) -> Column:
    """The name, and the name without its run suffix if that differs."""
    return F.array_distinct(F.array(x, strip_run_suffix(x)))


def slug(x: Column, fallback: str = "section") -> Column:
    """Lower-case words of letters and digits joined by underscores."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", fallback).otherwise(s)


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(x, r'[\\/:*?"<>|]+', "_")


def excerpt(x: Column, lines: int = 28) -> Column:
    """The first lines of a text; what is left out is marked by a line of dots."""
    all_ = F.split(x, "\n")
    return F.when(F.size(all_) > lines, F.concat(F.array_join(F.slice(all_, 1, lines), "\n"), F.lit("\n..."))).otherwise(x)


def strip_fences(x: Column) -> Column:
    """A model's answer without the lines of a code fence around it."""
    trimmed = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.split(trimmed, "\n"), lambda line: ~F.regexp_replace(line, r"(?U)^\s+", "").startswith("```"))
    return F.when(trimmed.startswith("```"), F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")).otherwise(trimmed)


def natural_key(x: Column) -> Column:
    """A key that sorts numbers in names by value and letters without case."""
    padded = F.regexp_replace(F.lower(x), r"([0-9]+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*([0-9]{20})(?![0-9])", "$1")


def safe_double(x: Column, default: float | None = None) -> Column:
    """A finite number of a string, or the default."""
    v = F.expr("cast(null as double)") if x is None else x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default).cast("double")).otherwise(v)


def list_value(v: Column) -> Column:
    """The texts of a VARIANT: those of a list that are not blank, a single value trimmed, none for null or a blank one."""
    texts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    one = F.trim(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit("")))
    single = F.when(one.isin("", "null"), F.array().cast("array<string>")).otherwise(F.array(one))
    return F.coalesce(F.filter(texts, lambda x: F.trim(x) != ""), single)


def departments(x: Column) -> Column:
    """Names of an array: spaces collapsed, edge punctuation gone, the first spelling of each kept in order."""
    clean = F.filter(F.transform(x, lambda v: F.regexp_replace(collapse(v), r"^[ ,;]+|[ ,;]+$", "")), lambda v: v != "")
    keys = F.transform(clean, lambda v: F.lower(v))
    return F.filter(clean, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


#: Characters of a file name that stay as they are besides letters, digits, space and -._*
CLIENT_SAFE = {"~": "%7E", "!": "%21", "(": "%28", ")": "%29", "'": "%27"}


def content_disposition(name: Column, fallback: str = "asset") -> Column:
    """An attachment header with an ASCII name and the full one percent-encoded."""
    suffix = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    ascii_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^\x20-\x7e]", "_"), r"\s+", " "), r"^[ .]+|[ .]+$", "")
    stem = F.regexp_replace(F.regexp_replace(ascii_, r"\.[^.]+$", ""), r"^[ ._]+|[ ._]+$", "")
    shown = F.when(stem == "", F.concat(F.lit(fallback), suffix)).otherwise(ascii_)
    full = F.replace(F.url_encode(name), F.lit("+"), F.lit(" "))
    for plain, code in CLIENT_SAFE.items():
        full = F.replace(full, F.lit(code), F.lit(plain))
    return F.concat(F.lit('attachment; filename="'), shown, F.lit("\"; filename*=UTF-8''"), full)


# ---------------------------------------------------------------- numbers as labels


def _letters(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA: digits without a zero."""
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        on = acc["left"] > 0
        rest = F.when(on, F.floor((acc["left"] - 1) / 26)).otherwise(F.lit(0)).cast("long")
        return F.struct(rest.alias("left"), F.when(on, F.concat(F.char(F.lit(65) + (acc["left"] - 1) % 26), acc["out"])).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"])  # 14 letters hold any long


def _roman(n: Column) -> Column:
    digit = lambda v, one, five, ten: F.element_at(F.array(*map(F.lit, ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))), (v % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(F.floor(n / 100), "C", "D", "M"), digit(F.floor(n / 10), "X", "L", "C"), digit(n, "I", "V", "X"))


def number_label(n: Column, kind: Column) -> Column:
    """A list item's number in the given format; letters and numerals of less than one are 0."""
    letters, roman = F.when(n > 0, _letters(n)).otherwise("0"), F.when(n > 0, _roman(n)).otherwise("0")
    return (
        F.when(kind == "lowerLetter", F.lower(letters)).when(kind == "upperLetter", letters)
        .when(kind == "lowerRoman", F.lower(roman)).when(kind == "upperRoman", roman).otherwise(n.cast("string"))
    )


def bullet(x: Column) -> Column:
    """Bullets of symbol fonts as the characters they show."""
    return F.when(x == "\uf0b7", "\u2022").when(x == "\uf0a7", "\u25aa").when(x == "o", "\u25cb").otherwise(x)
