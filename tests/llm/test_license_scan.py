"""License scans against plain Python (every block with every template), and at their edges."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import license_scan as scan

DOCS = "doc_id long, text string"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(text, templates=scan.TEMPLATES, threshold=scan.THRESHOLD):
    words = words_of(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base, found, best = {label for _, label in places}, set(), 0.0
    for paragraph in re.split(r"\n(?:[ \t\x0b\f\r]*\n)+", text or ""):
        for block in [*paragraph.split("\n"), paragraph]:
            have = set(words_of(block))
            for label, template in templates:
                need = set(words_of(template))
                if len(have & need) >= math.ceil(threshold * len(need)):
                    found.add(label)
                    best = max(best, len(have & need) / len(need))
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else best


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    filler = "the of and to software License under work public by mit GNU x9 Ünïcode this is version 0 reserved all rights".split()
    line = lambda: " ".join(rng.choice(filler) for _ in range(rng.randint(0, 14)))
    texts = [None, "", "\n\n", "Kelvin K license", "MIT-License", "xmit license", "mit licenses", "CC BY CC BY-SA", "apache\n\n license", "gnu general public mit license", "GNU\x00General, public (LICENSE)"]
    for _, template in scan.TEMPLATES:
        words = template.split()
        cut = words[:]
        cut.pop(rng.randrange(len(cut)))
        texts += [template, template.upper(), line() + "\n" + template + "\n" + line(), "\n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4)), " ".join(cut), " ".join(rng.sample(words, len(words)))]
    texts += ["\n".join(line() + rng.choice(["", "\n", ", All rights.. reserved"]) for _ in range(8)) for _ in range(60)]
    texts += ["word " * 60_000 + "mit license " + "word " * 60_000, ("line of words\n" * 9000) + "Released under the MIT License."]
    return list(enumerate(texts)) + [(None, texts[12]), (12, texts[12]), (3, texts[20])] + [(500, texts[30])] * 50


def got(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=str)


def test_equals_plain_python(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(((i, *by_hand(x)) for i, x in rows), key=str)
    assert got(scan.scan(docs)) == want
    clash = docs.withColumns({c: F.lit("1") for c in ("digest", "found", "of", "more", "spread", "words", "word", "label", "base", "containment", "license")})
    assert got(scan.scan(clash)) == want
    marked = scan.label(clash)
    assert marked.columns == [*clash.columns, "_license"]
    assert sorted(((r["doc_id"], r["_license"] or "") for r in marked.collect()), key=str) == sorted(((r[0], r[6]) for r in want), key=str)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_no_filter_loses_a_block(spark, rows, threshold):
    """Lower thresholds have longer prefixes: what the filters let through must still hold every block."""
    templates = (*scan.TEMPLATES[:6], ("short", "of the"))
    docs = spark.createDataFrame(rows, DOCS)
    assert got(scan.scan(docs, templates=templates, threshold=threshold)) == sorted(((i, *by_hand(x, templates, threshold)) for i, x in rows), key=str)


def test_edges(spark, rows):
    assert scan.scan(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "plain words here"), (2, None)], DOCS)
    assert got(scan.scan(docs)) == [(1, 3, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0)]
    assert "Python" not in scan.scan(docs)._jdf.queryExecution().executedPlan().toString()


def test_only_texts_that_may_hold_a_template_are_cut(spark):
    """Most texts of a corpus cannot meet a template: they are told by substrings, and none that meets one is lost."""
    rng = random.Random(4)
    common = "this work is under the version 3 all rights you may not use file of and to for with".split()
    texts = [" ".join(rng.choice(common) for _ in range(80)) for _ in range(200)]
    odd = [("x", "Ünïcodé öne"), ("y", "\u212aelvin ÄÖÜ"), ("z", "éé")]
    texts += [t.upper() for _, t in scan.TEMPLATES] + ["Ünïcodé öne", "ünïcodé öne", "\u212aelvin ÄÖÜ", "kelvin äöü", "éé", "İ ALL RIGHTS RESERVED İ", " \t\n", "\n\none", "one..", "a\x00b C-D"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    templates = (*scan.TEMPLATES, *odd)
    assert got(scan.scan(docs, templates=templates)) == sorted(((i, *by_hand(x, templates)) for i, x in enumerate(texts)), key=str)
    told = {r.doc_id for r in docs.where(scan.may_hold(F.col("text"), scan.needed(scan.TEMPLATES, scan.THRESHOLD))).collect()}
    assert not told & set(range(200)) and told >= set(range(200, 200 + len(scan.TEMPLATES)))
    for label, template in scan.TEMPLATES:  # whichever words are left out
        words = scan._words(template)
        for _ in range(20):
            kept = set(rng.sample(words, math.ceil(scan.THRESHOLD * len(words))))
            assert kept & set(scan.needed([(label, template)], scan.THRESHOLD))
