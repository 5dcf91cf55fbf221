"""Text functions that need Python: character references and edit-based similarity. All run over Arrow batches."""

from __future__ import annotations

import difflib
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INVISIBLE = re.compile("[\u200b-\u200f\u202a-\u202e\u2060\ufeff]")
_LINK = re.compile(r"<HL:([^>]*)>(.*?)</HL>", re.S)
_TAG = re.compile(r"<[^>]+>")
_COLOR = re.compile(r"\[#[0-9A-Fa-f]{6}\]")


def unescape(x: Column) -> Column:
    """Character references decoded."""
    return F.pandas_udf(lambda s: s.map(html.unescape, na_action="ignore"), "string")(x)


def _label_key(x: str) -> str:
    return re.sub(r"\W+", "", " ".join(_TAG.sub(" ", x).split()).lower().replace("/", " "))


def similarity(a: str | None, b: str | None) -> float:
    """0 if a label is empty, 1 if equal, 0.9 if one holds the other, else the share of matching blocks."""
    x, y = _label_key(a or ""), _label_key(b or "")
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    return 0.9 if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio()


def label_similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda s, t: pd.Series([similarity(x, y) for x, y in zip(s, t)], dtype=float), "double")(a, b)


def plain(text: str | None, markdown: bool = False) -> str:
    """Text without fill tokens, tags and invisible characters, references decoded; links stay, or become Markdown."""

    def link(m: re.Match) -> str:
        url, inner = html.unescape(m[1]), _INVISIBLE.sub("", html.unescape(_TAG.sub("", m[2]))).strip()
        kept.append(f"[{inner}]({url})" if markdown else f"<HL:{url}>{inner}</HL>")
        return f"\x00{len(kept) - 1}\x00"

    kept: list[str] = []
    out = _LINK.sub(link, _COLOR.sub(" ", text or ""))
    out = _INVISIBLE.sub("", html.unescape(_TAG.sub("", out)))
    return re.sub("\x00([0-9]+)\x00", lambda m: kept[int(m[1])], out)


def plain_content(x: Column) -> Column:
    """Content of a cell as plain text; links keep their markup, lines their indentation."""
    from .text import normalize_indented, repair

    return normalize_indented(F.pandas_udf(lambda s: s.map(plain), "string")(repair(x, ("-", "-"))))


def plain_label(x: Column) -> Column:
    """A label as plain text with Markdown links."""
    from .text import normalize, repair

    return normalize(F.pandas_udf(lambda s: s.map(lambda t: plain(t, True)), "string")(repair(x, ("-", "-"))))
