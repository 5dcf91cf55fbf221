"""What counts as evidence of furniture on a host."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import html_extract


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_copies_of_a_page_are_one_page(spark):
    copy, other = "<body><div class=post><p>the same words</p></div></body>", "<body><div class=post><p>other words</p></div></body>"
    got = texts(spark, [("http://copies.example/", copy)] * 50 + [(None, copy)] * 20 + [(None, other)])
    assert got == ["the same words"] * 70 + ["other words"]


def test_furniture_inside_main_is_cut(spark):
    page = "<body><main><div class=box><p>box of every page</p></div><div class=story><p>own words {}</p></div></main></body>"
    got = texts(spark, [(f"http://site.example/{i}", page.format(f"no {i}")) for i in range(40)])
    assert got == [f"own words no {i}" for i in range(40)]


def test_a_small_article_is_not_the_whole_text(spark):
    body = "the long story that stands beside the teaser " * 10
    got = texts(spark, [("http://teaser.example/", f"<body><article><p>read more</p></article><div class=x2><p>{body}</p></div></body>")])
    assert body.strip() in got[0]


def site(rng, n):
    """Pages of three hosts: boxes that all pages share, that some share, and that differ, inside and outside of main."""
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(n):
        some = rng.choice(("one kind", "another kind"))
        body = f"<div class=top><p>site words</p></div><div class=mid><p>{some}</p></div><main><div class=box><p>box words</p></div><div class=s{rng.randint(1, 3)}><p>{word()} {word()}</p></div></main><div class=own><p>{word()}</p></div>"
        rows.append((f"http://h{i % 3}.example/{i}", f"<html><body>{body}</body></html>"))
    return rows + rows[:5]  # copies


def importances(rows):
    """(host, path) -> importance by the formulas, page by page."""
    seen, content, shape, inside = set(), defaultdict(Counter), defaultdict(Counter), {}
    for url, page in rows:
        host = html_extract.host_of(url)
        if (host, page) in seen:
            continue
        seen.add((host, page))
        for path, (c, s, _, i) in html_extract.Page(page).nodes.items():
            content[host, path][c] += 1
            shape[host, path][s] += 1
            inside[host, path] = i

    def relative(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 1.0

    out = {}
    for k in content:
        n = sum(content[k].values())
        e = html_extract.GAMMA * relative(content[k]) + (1 - html_extract.GAMMA) * relative(shape[k])
        out[k] = (n * e + html_extract.PRIOR_PAGES * (html_extract.PRIOR_INSIDE if inside[k] else html_extract.PRIOR)) / (n + html_extract.PRIOR_PAGES)
    return out


def test_importances_and_texts_against_brute_force(spark):
    rows = site(random.Random(7), 120)
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    want = importances(rows)
    got = {(r.host, r.path): r.importance for r in html_extract.style_tree(html_extract.parsed(df)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    out = [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]
    for text, (u, h) in zip(out, rows):
        p = html_extract.Page(h)
        cut = {path for path, n in p.nodes.items() if not n[2] and want[html_extract.host_of(u), path] < html_extract.CUT}
        assert text == p.text(cut) and cut and text != p.text()  # the tree decides


def test_pages_at_the_edges(spark):
    """Empty tables, clashing columns, repeated rows, and a page of over a million characters."""
    long = "<article>" + "".join(f"<p>part {i} of a very long page</p>" for i in range(40000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a.example/", long), (None, None, None), (2, "", ""), (2, "", "")], "page_id long, url string, html string")
    df = df.withColumns({x: F.lit("x") for x in ("host", "nodes", "blocks", "copy", "cuts", "of", "text", "__p")})
    got = html_extract.extract(df).collect()
    assert sorted((r.page_id or 0, len(r.text), r.n_chars) for r in got) == sorted([(1, n := len("\n\n".join(f"part {i} of a very long page" for i in range(40000))), n), (0, 0, 0), (2, 0, 0), (2, 0, 0)])
    assert html_extract.extract(df.limit(0)).count() == 0
