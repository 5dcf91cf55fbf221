"""Operators of inspection, rendering and models that have no SQL, against values by hand."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import cells, grid, models, rag, render, vectors
from docloom.sources import files


def test_headers_of_any_level(spark):
    """Header paths by a stack, levels up to 14."""
    rng = random.Random(3)
    rows = [(d, i, rng.randint(1, 14) if rng.random() < 0.6 else None) for d in range(6) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc int, pos long, level int").withColumn("title", F.concat(F.lit("h"), F.col("pos").cast("string")))
    got = {(r.doc, r.pos): r.titles for r in rag.hierarchy(df, "doc", "pos", "level", "title").collect()}
    for d in range(6):
        stack = []
        for doc, pos, level in rows:
            if doc == d:
                if level is not None:
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                    stack.append((level, f"h{pos}"))
                assert got[d, pos] == [t for _, t in stack]


def test_unknown_assets_are_unresolved(spark):
    nodes = spark.createDataFrame([(1, "CL000001", "a <EM000001> <EM000002> CL000002", True), (1, "CL000002", "b CL000001", False)], "doc_id int, id string, text string, is_root boolean")
    assets = spark.createDataFrame([(1, "EM000001")], "doc_id int, asset_id string")
    r = rag.resolve_by_document(spark, nodes, assets).first()
    assert (r.text, r.unresolved, r.used) == ("a\n<EM000001>\n<EM000002>\nb", ["EM000002"], ["CL000001", "CL000002"])
    assert rag.resolve_by_document(spark, nodes.limit(0)).count() == 0


def drawn_by_hand(rows, n):
    """rows of (col, colspan, text)."""
    wide = [1] * n
    for row in rows:
        for col, span, text in row:
            lack = max(map(len, text.split("\n"))) - sum(wide[col - 1 : col - 1 + span]) - 3 * (span - 1) if text else 0
            for k in range(span):
                wide[col - 1 + k] += max(lack, 0) // span + (k < max(lack, 0) % span)
    border = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    out = [border]
    for row in rows:
        for k in range(max(len(t.split("\n")) for *_, t in row)):
            cells = [(t.split("\n") + [""] * 9)[k].ljust(sum(wide[c - 1 : c - 1 + s]) + 3 * (s - 1)) for c, s, t in row]
            out.append("|" + "".join(f" {x} |" for x in cells))
        out.append(border)
    return "\n".join(out)


def test_virtual_tables_with_spans(spark):
    rng = random.Random(8)
    tables, rows = {}, []
    for t in range(12):
        n = rng.randint(1, 5)
        tables[t] = (n, [])
        for r in range(rng.randint(1, 5)):
            line, col = [], 1
            while col <= n:
                span = rng.randint(1, n - col + 1)
                line.append((col, span, "\n".join("x" * rng.randint(0, 14) for _ in range(rng.randint(1, 3))).strip("\n")))
                rows.append((t, r, *line[-1], n))
                col += span
            tables[t][1].append(line)
    df = spark.createDataFrame(rows, "t int, r int, c int, s int, text string, n int")
    got = {x.t: x.rendered for x in grid.virtual(df, ["t"], "r", "c", "s", "text", "n").collect()}
    for t, (n, lines) in tables.items():
        assert got[t] == drawn_by_hand(lines, n)


def test_windows_1252_is_repaired(spark):
    good = ["it\u2019s \u2013 \u201cx", "caf\u00e9 \u2026", "\u0645\u0631\u062d\u0628\u0627", "na\u00efve", "plain"]
    for encoding in ("latin1", "cp1252"):
        bad = []
        for x in good:
            try:
                bad.append((x, x.encode().decode(encoding)))
            except UnicodeDecodeError:
                continue
        df = spark.createDataFrame(bad, "good string, bad string")
        assert [r.x for r in df.select(T.repair(F.col("bad")).alias("x")).collect()] == [x for x, _ in bad]
    left = ["it\u2019s fine", "\u00e2", "\u00c3", "5 \u20ac", "", "\u4e2d\u00e2\u20ac\u2122"]
    assert [r.x for r in spark.createDataFrame([(x,) for x in left], "x string").select(T.repair(F.col("x")).alias("x")).collect()] == left


def test_sources_and_batches(spark):
    assert vectors.source_names(["YWJj", " YWJj ", "no id!", "ZMOpw", ""]) == ["abc", "no id!", "ZMOpw"]
    sizes = []
    vectors_ = vectors.embed(F.col("id").cast("string"), embedder=lambda texts: [[float(len(texts))]] * len(texts), batch=10)
    sizes = [r.v[0] for r in spark.range(0, 25, 1, 1).select(vectors_.alias("v")).collect()]
    assert sizes == [10.0] * 20 + [5.0] * 5


def test_search_of_all_queries_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(90, [0.0] * 6), (91, [1.0] * 6), (92, [2.0] * 6), (93, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.where("vec_id % 3 = 0 and embedding is not null").select(F.col("vec_id").alias("query"), "embedding")
    want = sorted(map(tuple, vectors.search_all(e, q, 5).collect()))
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, vectors.search_all(e, q, 5).collect())) == want and len(want) == 5 * q.count()
    one = vectors.search(e.where("embedding is not null"), rows[30][1], 5).collect()
    assert [r.vec_id for r in one] == [w[1] for w in sorted((w for w in want if w[0] == 30), key=lambda w: w[3])]
    assert vectors.search_all(e, q.limit(0)).count() == 0


class Endpoint(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, body["model"], self.headers.get("Authorization")))
        there = self.path == "/v1/chat/completions"
        self.send_response(200 if there else self.server.code)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}).encode() if there else b"{}")

    def log_message(self, *args):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    server.seen, server.code = [], 404
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_model_endpoint(endpoint, tmp_path):
    url = f"http://127.0.0.1:{endpoint.server_port}"
    client = models.connect(url + "/", "m", "key")
    assert client.base_url == url + "/v1" and client.complete([{"role": "user", "content": "abc"}]) == "ABC"
    assert [x[0] for x in endpoint.seen] == ["/chat/completions", "/v1/chat/completions", "/v1/chat/completions"] and endpoint.seen[0][2] == "Bearer key"
    endpoint.code = 401
    with pytest.raises(RuntimeError, match="refused"):
        models.connect(url, "m")
    with pytest.raises(RuntimeError, match="reached"):
        models.connect("http://127.0.0.1:9", "m", timeout=2)
    with pytest.raises(ValueError):
        models.base_urls(" / ")
    assert models.base_urls("http://x/v1/") == ["http://x/v1", "http://x"]
    assert models.Settings.from_env({"DOCLOOM_MODEL": "m", "DOCLOOM_ATTEMPTS": "2"}) == models.Settings(model="m", attempts=2)
    (tmp_path / "SEC01.txt").write_text("one")
    (tmp_path / "notes.txt").write_text("no")
    assert models.section_prompts(str(tmp_path)) == {"SEC01": "one"}


def test_paths_stay_inside(tmp_path):
    assert files.inside(str(tmp_path), "a/../b.txt") == str(tmp_path.resolve() / "b.txt")
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            files.inside(str(tmp_path), bad)


def test_payloads_by_shape(spark):
    cases = {
        '{"status": "not_found"}': "",
        '{"section_heading": "H", "columns": ["a", "b"], "rows": [{"a": "1", "b": "<2>", "type": "x"}]}': "<th>a</th><th>b</th>",
        '{"rows": [["p", "q"]]}': '<td class="text-ltr">p</td><td class="text-ltr">q</td>',
        '{"rows": [{"type": "x", "k": "v"}]}': "<th>k</th>",
        '{"content": "one\\n\\ntwo"}': '<p class="text-ltr">one</p><p class="text-ltr">two</p>',
        '{"purpose": "why", "section_id": "SEC05"}': "<b>purpose</b> why",
        '[{"format": "titled_item", "section_heading": "T", "content": "c"}, {"format": "empty"}, {"format": "not_found"}]': '<div class="other"><h3>T</h3><p class="text-ltr">c</p></div><p>Empty table</p>',
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    got = {r.j: r.h for r in df.select("j", render.payload(F.lit("SEC05"), F.col("j"), F.lit("Name")).alias("h")).collect()}
    for k, want in cases.items():
        assert (got[k] == want) if not want else want in got[k], (k, got[k])
    hits = spark.createDataFrame([(1, "SEC05"), (2, "SEC05")], "doc int, sec string")
    sections = spark.createDataFrame([(1, "SEC05", 2, "late"), (1, "SEC05", 1, "first")], "doc int, sec string, n int, html string")
    assert sorted((r.doc, r.section_html) for r in render.with_html(hits, sections, "doc", "sec", "n").collect()) == [(1, "first"), (2, None)]
