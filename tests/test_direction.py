"""Directions of whole texts."""

import re

import __spark_entry__ as entry


def test_direction_reads_whole_texts(spark, data):
    got = {r.doc_id: r.direction for r in entry.queries()["txt_direction_whole"](spark, data).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    short = 0
    for i, text in texts.items():
        more = "مرحبا" * (len(text) * (i % 13) // 100)

        def by_hand(text):
            t = text + more if i % 2 == 0 else more + text
            rtl, ltr = len(re.findall("[֐-ࣿ]", t)), len(re.findall("[A-Za-z]", t))
            if not rtl or not ltr:
                return "rtl" if rtl else "ltr"
            return "rtl" if rtl >= max(2, int(ltr * 0.45)) or not re.search("[֐-ࣿA-Za-z]", t)[0].isascii() else "ltr"

        assert got[i] == by_hand(text), i
        short += by_hand(text) != by_hand(text[:60])
    assert short and len(got) == len(texts)  # what follows the first 60 characters decides for some
