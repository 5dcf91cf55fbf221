"""Group posteriors: against a plain computation, and what they change."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import quality_classifier

WORDS = "the of and to in is that was for with on are this by at from thing other nation river".split()


def text(rng, kind, n=70):
    """Good texts are plain, bad ones full of signs, mixed ones half way."""
    sign = {"good": 0.02, "mixed": 0.22, "bad": 0.5}[kind]
    return " ".join(rng.choice("#%&|") if rng.random() < sign else rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Hosts of good and of bad texts, each with mixed ones, and hosts of one mixed text each."""
    rng = random.Random(9)
    rows = []
    for host, kind in (("fine", "good"), ("spam", "bad"), ("plain", "good"), ("junk", "bad")):
        rows += [(f"{host}.example", f"p{rng.randint(0, 2)}", text(rng, kind)) for _ in range(60)]
        rows += [(f"{host}.example", f"p{rng.randint(0, 2)}", text(rng, "mixed")) for _ in range(25)]
    rows += [(f"lone{i}.example", "p0", text(rng, "mixed")) for i in range(25)]
    rows = [(i, h, p, t) for i, (h, p, t) in enumerate(rows)]
    labels = [(i, int(h[0] in "fp")) for i, h, _, _ in rows if i % 2 and h[0] in "fpsj"]
    return spark.createDataFrame(rows, "doc_id long, host string, path string, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), rows


@pytest.fixture(scope="module")
def result(corpus):
    docs, labels, _ = corpus
    return {r.doc_id: r for r in quality_classifier.classify(docs, labels, F.col("host"), F.col("path")).collect()}


def strength(groups, means):
    """Moments, over groups of (n, sum, sum of squares) around the given means."""
    n = sum(g[0] for g in groups)
    spread = sum(g[0] * (g[1] / g[0] - m) ** 2 for g, m in zip(groups, means))
    within = sum(max(g[2] - g[1] ** 2 / g[0], 0) for g in groups)
    if n <= len(groups):
        return 10.0
    noise = within / (n - len(groups))
    return min(max(noise / max((spread - len(groups) * noise) / n, 1e-9), 1.0), 1e6)


def test_posteriors_by_hand(corpus, result):
    _, _, rows = corpus
    p = {i: result[i].doc_prob for i, *_ in rows}
    paths, hosts = defaultdict(lambda: [0, 0.0, 0.0]), defaultdict(lambda: [0, 0.0, 0.0])
    for i, h, path, _ in rows:
        for g in (paths[h, path], hosts[h]):
            g[0], g[1], g[2] = g[0] + 1, g[1] + p[i], g[2] + p[i] ** 2
    overall = sum(p.values()) / len(p)
    by_host = strength(list(hosts.values()), [overall] * len(hosts))
    of_host = {h: (by_host * overall + g[1]) / (by_host + g[0]) for h, g in hosts.items()}
    by_path = strength(list(paths.values()), [of_host[h] for h, _ in paths])
    odds = lambda x: math.log(x / (1 - x))
    for i, h, path, _ in rows:
        n, s, _ = paths[h, path]
        of_path = min(max((by_path * of_host[h] + s - p[i]) / (by_path + n - 1), 1e-6), 1 - 1e-6)
        score = 1 / (1 + math.exp(-(odds(p[i]) + odds(of_path) - odds(overall))))
        assert result[i].host_posterior == pytest.approx(of_host[h], abs=1e-6) and result[i].path_posterior == pytest.approx(of_path, abs=1e-6)
        assert result[i].score == pytest.approx(score, abs=1e-6) and result[i].kept == (score >= 0.5)


def test_groups_move_verdicts(corpus, result):
    """Mixed texts follow their hosts, which their own evidence alone does not do; hosts of one text stay near the global prior."""
    _, _, rows = corpus
    mixed = [(h, result[i]) for i, h, _, t in rows if 0.1 < sum(c in "#%&|" for c in t) / 70 < 0.36 and h[0] in "fpsj"]
    right = np.mean([r.kept == (h[0] in "fp") for h, r in mixed])
    alone = np.mean([(r.doc_prob >= 0.5) == (h[0] in "fp") for h, r in mixed])
    assert right > alone + 0.1 and sum(r.kept != (r.doc_prob >= 0.5) for _, r in mixed) > 5
    spread = lambda names: np.ptp([result[i].host_posterior for i, h, *_ in rows if h[:4] in names])
    assert spread(("lone",)) < spread(("fine", "spam")) / 2


def test_a_labelled_id_of_many_rows(spark):
    rows = [(1, "good words " * 30)] * 3000 + [(2, "# % & " * 30), (None, None), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("x") for x in ("host", "path", "group", "of", "p", "n", "s")})
    r = quality_classifier.classify(d, spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int"), F.col("host"), F.col("path")).collect()
    assert len(r) == len(rows) and len({x.score for x in r if x.doc_id == 1}) == 1
