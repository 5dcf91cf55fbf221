"""Language identification with a bidirectional gated recurrent network over bytes.

Trained here in numpy by backpropagation through time, on the driver, from a bounded sample: SAMPLE documents of each
language, the smallest by a hash of their id, SNIPPETS pieces of SNIPPET characters of each. Applied to every byte of
every text: texts are cut into windows of WINDOW bytes, both directions run over each window, every position gets
probabilities, and a document's are their mean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_table, small_batches, utf8

HIDDEN = 10
WINDOW = 96
SAMPLE = 400
SNIPPETS = 4
SNIPPET = 64
STEPS = 260
BATCH = 128
RATE = 0.02
BLOCK = 2048


def _cell(gx: np.ndarray, h: np.ndarray, u: np.ndarray, hidden: int):
    """One step; the gates' weights are halved beforehand, so that one tanh gives both sigmoids."""
    gh = h @ u
    gates = gx[:, : 2 * hidden] + gh[:, : 2 * hidden]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    z, r = gates[:, :hidden], gates[:, hidden:]
    inner = gh[:, 2 * hidden :]
    new = gx[:, 2 * hidden :] + r * inner
    np.tanh(new, out=new)
    return z, r, inner, new, new + z * (h - new)


class Net:
    """The parameters: for each direction byte weights and recurrent weights, then the output layer."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {f"x{d}": f(256, 3 * hidden, scale=0.3) for d in (0, 1)} | {f"u{d}": f(hidden, 3 * hidden, scale=0.3) for d in (0, 1)}
        self.p |= {"v": f(2 * hidden, classes, scale=0.3), "c": np.zeros(classes, np.float32)}

    def _scaled(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        s = np.ones(3 * self.hidden, np.float32)
        s[: 2 * self.hidden] = 0.5
        return self.p[f"x{d}"] * s, self.p[f"u{d}"] * s

    def positions(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sums over positions of the class probabilities, one row for each row of x (bytes, of which length count)."""
        n, steps = x.shape
        hidden = self.hidden
        states = np.empty((2, steps, n, hidden), np.float32)
        short = np.flatnonzero(length < steps)
        for d in (0, 1):
            wx, u = self._scaled(d)
            h = np.zeros((n, hidden), np.float32)
            for t in range(steps) if not d else range(steps - 1, -1, -1):
                h = _cell(wx[x[:, t]], h, u, hidden)[4]
                if d and len(short):
                    h[short[length[short] <= t]] = 0
                states[d, t] = h
        v = self.p["v"]
        logit = states[0].reshape(-1, hidden) @ v[:hidden] + states[1].reshape(-1, hidden) @ v[hidden:] + self.p["c"]
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        prob = logit.reshape(steps, n, -1)
        if len(short):
            prob[np.arange(steps)[:, None] >= length[None, :]] = 0
        return prob.sum(0)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all positions of full windows x with labels y."""
        n, steps = x.shape
        hidden = self.hidden
        tape, states = ([], []), np.empty((2, steps, n, hidden), np.float32)
        for d in (0, 1):
            wx, u = self._scaled(d)
            h = np.zeros((n, hidden), np.float32)
            for t in range(steps) if not d else range(steps - 1, -1, -1):
                z, r, inner, new, out = _cell(wx[x[:, t]], h, u, hidden)
                tape[d].append((t, h, z, r, inner, new))
                states[d, t] = h = out
        v = self.p["v"]
        flat = [states[d].reshape(-1, hidden) for d in (0, 1)]
        logit = flat[0] @ v[:hidden] + flat[1] @ v[hidden:] + self.p["c"]
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(prob)), np.tile(y, steps)] -= 1
        prob /= len(prob)
        g = {"v": np.concatenate([f.T @ prob for f in flat]), "c": prob.sum(0)}
        for d in (0, 1):
            back = (prob @ v[d * hidden : (d + 1) * hidden].T).reshape(steps, n, hidden)
            u = self.p[f"u{d}"]
            gu, gx = np.zeros_like(u), np.zeros((256, 3 * hidden), np.float32)
            carry = np.zeros((n, hidden), np.float32)
            for t, h, z, r, inner, new in reversed(tape[d]):
                dh = back[t] + carry
                dnew = dh * (1 - z) * (1 - new * new)
                da = np.concatenate([dh * (h - new) * z * (1 - z), dnew * inner * r * (1 - r)], 1)
                dgh = np.concatenate([da, dnew * r], 1)
                gu += h.T @ dgh
                np.add.at(gx, x[:, t], np.concatenate([da, dnew], 1))
                carry = dh * z + dgh @ u.T
            g[f"u{d}"], g[f"x{d}"] = gu, gx
        return g


def train(windows: np.ndarray, labels: np.ndarray, classes: int, steps: int = STEPS, seed: int = 7) -> Net:
    """Adam over random batches, classes equally likely."""
    net, rng = Net(classes, seed=seed), np.random.default_rng(seed)
    by_class = [np.flatnonzero(labels == k) for k in range(classes)]
    m, s = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    for i in range(1, steps + 1):
        pick = rng.integers(0, classes, BATCH)
        rows = np.array([by_class[k][rng.integers(0, len(by_class[k]))] for k in pick])
        rate = RATE * min(1.0, 2 * (1 - (i - 1) / steps))
        for k, g in net.step(windows[rows], labels[rows]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame) -> DataFrame:
    """(lang, snippets): at most SAMPLE documents of each language of the training part (doc_id, text, lang)."""
    place = F.md5(F.col("doc_id").cast("string"))
    start = lambda i: (1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - SNIPPET + 1, F.lit(1)))).cast("int")
    snippets = F.array(*(F.substring(F.col("text"), start(i), F.lit(SNIPPET)) for i in range(SNIPPETS)))
    rows = docs.where("lang is not null and text is not null").select("lang", place.alias("place"), snippets.alias("snippets"))
    # A share of each language that has about twice SAMPLE rows goes on, so that no language is ranked in one task whole.
    share = rows.groupBy(F.col("lang").alias("of")).agg((F.lit(2.0 * SAMPLE) / F.count(F.lit(1))).alias("share"))
    at = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    some = join_table(rows, share, "lang", "of", spread="place").where(at < F.col("share"))
    ranked = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place", "snippets"))).where(F.col("n") <= SAMPLE)
    return ranked.select("lang", "n", "snippets")


#: The last network, by its sample: the same sample always gives the same one.
_TRAINED: dict[str, Net] = {}


def fit(docs: DataFrame) -> tuple[list[str], Net | None]:
    """Languages in code-point order and the trained network (None if there is nothing to learn from)."""
    rows = sorted((r["lang"], r["n"], list(r["snippets"])) for r in sample(docs).collect())  # bounded by SAMPLE per language
    data = [(lang, utf8(s)[:SNIPPET]) for lang, _, snippets in rows for s in snippets]
    data = [(lang, (b * (SNIPPET // len(b) + 1))[:SNIPPET]) for lang, b in data if b]
    langs = sorted({lang for lang, _ in data})
    if len(langs) < 1:
        return [], None
    key = hashlib.sha256(repr(data).encode()).hexdigest()
    if key not in _TRAINED:
        windows = np.frombuffer(b"".join(b for _, b in data), np.uint8).reshape(-1, SNIPPET)
        _TRAINED.clear()
        _TRAINED[key] = train(windows, np.array([langs.index(lang) for lang, _ in data]), len(langs))
    return langs, _TRAINED[key]


def predict(net: Net, langs: list[str], texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text; `und` and 0 for null texts and texts without a letter."""
    raw = [utf8(x) if x is not None and any(map(str.isalpha, x)) else b"" for x in texts]
    total = np.zeros((len(raw), len(langs)))
    pieces, owner, lengths = [], [], []

    def flush() -> None:
        x = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, WINDOW)
        np.add.at(total, np.array(owner), net.positions(x, np.array(lengths)))
        pieces.clear(), owner.clear(), lengths.clear()

    for i, b in enumerate(raw):
        for at in range(0, len(b), WINDOW):
            part = b[at : at + WINDOW]
            pieces.append(part if len(part) == WINDOW else part.ljust(WINDOW, b"\0"))
            owner.append(i)
            lengths.append(len(part))
            if len(pieces) == BLOCK:
                flush()
    if pieces:
        flush()
    best = total.argmax(1)
    size = np.array([max(len(b), 1) for b in raw])
    score = np.clip(total[np.arange(len(raw)), best] / size, 0, 1)
    return [langs[k] if b else "und" for k, b in zip(best, raw)], [float(s) if b else 0.0 for s, b in zip(score, raw)]


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; learns only from rows outside the held-out fold.

    The fold is crc32 of the id as text, modulo folds; a null id counts as the empty text. Null and empty texts and
    texts without a letter (a character of a Unicode category L; digits, fractions, circled numbers and marks are none)
    are `und` with score 0, and so is everything if there is nothing to learn from. Very long texts are read whole,
    in windows. Of equally likely languages the first in code-point order wins. Repeated rows stay and are judged
    alike. Extra columns are dropped, whatever their names. An empty table gives an empty result.
    """
    d = small_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    fold = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % folds
    d = d.withColumn("held_out", fold == held_out)
    langs, net = fit(d.where(~F.col("held_out")))

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = predict(net, langs, list(texts)) if net else (["und"] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return d.withColumn("found", label("text")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def query(spark, sf_dir):
    """op9: whole `documents`."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
