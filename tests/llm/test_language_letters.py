"""What counts as a letter, and the network against a forward pass written out position by position."""

import numpy as np
import pytest

from docloom.llm import language_id


@pytest.mark.parametrize("text,letter", [("\u00bd \u00be \u00b2", False), ("\u2460\u2461", False), ("\u0301\u0308", False), ("12 _ !", False), ("", False), (None, False), ("\u0663", False), ("\u2167", False), ("1\u00aa", True), ("\u00e9", True), ("\u4e2d", True), ("1 a", True)])
def test_texts_without_a_letter(spark, text, letter):
    net = language_id.Net(2)
    names, scores = language_id.predict(net, ["de", "en"], [text])
    assert (names[0] != "und") == letter and (scores[0] > 0) == letter
    if not letter:
        rows = [(1, "plain words", "en"), (3, "more words", "en"), (4, text, None)]
        got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id = 4").first()
        assert (got.lang_pred, got.score) == ("und", 0.0)


def test_positions_are_those_of_the_plain_network():
    """Gates by their formulas, one position and one row at a time, both directions, rows of any length."""
    net = language_id.Net(3, hidden=4, seed=2)
    rng = np.random.default_rng(1)
    x, length = rng.integers(0, 256, (6, 9)), np.array([9, 1, 4, 9, 8, 2])
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    k = net.hidden
    for row, n, got in zip(x, length, net.positions(x, length)):
        states = np.zeros((2, n, k))
        for d in (0, 1):
            h = np.zeros(k)
            for t in range(n) if d == 0 else range(n - 1, -1, -1):
                gx, gh = net.p[f"x{d}"][row[t]].astype(float), h @ net.p[f"u{d}"].astype(float)
                z, r = sigmoid(gx[:k] + gh[:k]), sigmoid(gx[k : 2 * k] + gh[k : 2 * k])
                new = np.tanh(gx[2 * k :] + r * gh[2 * k :])
                h = (1 - z) * new + z * h
                states[d, t] = h
        logit = np.concatenate([states[0], states[1]], 1) @ net.p["v"] + net.p["c"]
        p = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
        assert np.allclose(got, p.sum(0), atol=1e-4)
