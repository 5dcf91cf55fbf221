"""Repeated passages: long texts, what the index decides, and frames at the edges."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import suffix_dedup

W = suffix_dedup.WIDTH


def by_hand(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, windows by a table of their hashes."""
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - W + 1):
            h = hash(b[i : i + W])
            count[h] = count.get(h, 0) + 1
    out = []
    for b in raw:
        at = np.array([i for i in range(len(b) - W + 1) if count[hash(b[i : i + W])] > 1], int)
        depth = np.zeros(len(b) + 1, int)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + W, -1)
        gone = np.cumsum(depth)[:-1] > 0 if len(b) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = suffix_dedup.query(spark, str(folder)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    return [got[i] for i in range(len(texts))]


def noise(rng, n):
    return "".join(rng.choices("abcdefghij klmnop qrstuv", k=n))


def test_texts_beyond_a_section(spark, tmp_path):
    """Repeats before, across and after the seam of two sections, and between a long and a short text."""
    rng = random.Random(1)
    n = suffix_dedup.SECTION
    a, b, c = noise(rng, 900), noise(rng, 700), noise(rng, 450)
    long = noise(rng, n - 1500) + b + noise(rng, 350) + a + noise(rng, 500) + c + noise(rng, 2000)
    assert long.index(a) < n < long.index(a) + len(a)
    texts = [long, "x " + a[100:] + " y", b[:W] + "!", c[: W - 1], noise(rng, 300) + c + long[n - 1400 : n - 900]]
    assert run(spark, tmp_path, texts) == by_hand(texts)


def test_the_index_decides(spark, tmp_path, monkeypatch):
    """With an index that finds nothing no byte of different texts goes."""
    rng = random.Random(2)
    passage = noise(rng, 2000)
    texts = [noise(rng, 200) + passage + noise(rng, 200) for _ in range(4)] + [noise(rng, 800)] * 2
    assert run(spark, tmp_path / "on", texts) == by_hand(texts)
    rows = suffix_dedup.texts_of(spark.createDataFrame([(t,) for t in texts], "text string"))
    monkeypatch.setattr(suffix_dedup, "indexed", lambda rows: spark.createDataFrame([], "one long, two long, a long, b long"))
    assert suffix_dedup.repeated(rows).count() == 0


def test_one_passage_in_many_texts(spark, tmp_path, monkeypatch):
    """Groups far over the bound of a task, at every level down to single windows."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 3000)
    rng = random.Random(3)
    passage = noise(rng, 600)
    texts = [noise(rng, rng.randint(0, 90)) + passage[rng.randint(0, 90) : 600 - rng.randint(0, 90)] + noise(rng, rng.randint(0, 90)) for _ in range(60)]
    assert run(spark, tmp_path, texts) == by_hand(texts)


def test_frames(spark):
    """Nulls, empty texts, repeated rows and columns named as the operator names its own."""
    t = noise(random.Random(4), 500)
    rows = [(None, 1), ("", 2), (t, 3), (t, 3), ("short", 4), ("short", 5), (t + "more", 6)]
    df = spark.createDataFrame(rows, "text string, h long").withColumns({x: F.lit(1) for x in ("g", "copies", "spans", "windows", "a", "b", "key", "one")})
    got = {r.text: (r.copies, [tuple(s) for s in r.spans]) for r in suffix_dedup.dedup(df).collect()}
    assert got == {"": (2, []), t: (2, [(0, 500)]), "short": (2, []), t + "more": (1, [(0, 500)])}
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def words_by_hand(texts, width):
    """Words of each text in windows of `width` words that another row holds too."""
    words = [(t or "").encode().split() for t in texts]
    rows = {}
    for i, w in enumerate(words):
        for a in range(len(w) - width + 1):
            rows.setdefault(tuple(w[a : a + width]), set()).add(i)
    return [len({a + j for a in range(len(w) - width + 1) if len(rows[tuple(w[a : a + width])]) > 1 for j in range(width)}) for w in words]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))


def told(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = suffix_dedup.query(spark, str(folder)).collect()
    got = {r.doc_id: (r.n_shared_words, r.n_removed) for r in rows}
    return [got[i] for i in range(len(texts))]


def test_passages_below_the_width(spark, tmp_path):
    """Passages of 49 to 80 words and under 400 bytes: they stay, and are told where other texts hold 50 words of them."""
    rng = random.Random(5)
    short = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 4))) for _ in range(n)) for n in (49, 50, 51, 80)]
    assert all(len(p) < W for p in short)
    texts = [f"{prose(rng, 60)} {p} {prose(rng, 70)}" for p in short for _ in range(3)]
    texts += [prose(rng, 300), f"{short[3]}\n{prose(rng, 5)}\t{short[3]}", short[2].replace(" ", "\n\t"), prose(rng, 60)]
    twice = prose(rng, 55)
    texts += [f"{twice} {prose(rng, 9)} {twice}", "w " * 400, "w " * 90 + "end", None, "", prose(rng, 49)]
    texts += [texts[-1], texts[12], " ".join(short[1].split()[:30] + short[0].split()[:30])]
    got = told(spark, tmp_path, texts)
    assert [n for n, _ in got] == words_by_hand(texts, suffix_dedup.WORDS)
    assert [n for n, _ in got][:12] == [0] * 3 + [50] * 3 + [51] * 3 + [80] * 3
    assert [gone for _, gone in got][:12] == [0] * 12


def test_passages_over_pieces_and_blocks(spark, tmp_path, monkeypatch):
    """Texts longer than a piece and than a section, a word longer than a section, and many cuts of one passage."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    rng = random.Random(6)
    passage = prose(rng, 150).split()
    texts = [f"{prose(rng, 20)} {' '.join(passage[rng.randint(0, 60) : 150 - rng.randint(0, 60)])} {prose(rng, 20)}" for _ in range(40)]
    wide = "x" * (suffix_dedup.SECTION + 9)
    texts += [f"{prose(rng, 30)} {wide} {prose(rng, 40)}", f"{prose(rng, 200)} {' '.join(passage[:70])} {prose(rng, 300)}"]
    texts.append(texts[40][:-1] + "!")
    assert [n for n, _ in told(spark, tmp_path / "small", texts)] == words_by_hand(texts, suffix_dedup.WORDS)
    long = prose(rng, suffix_dedup.SECTION // 4)
    assert len(long) > suffix_dedup.SECTION
    assert [n for n, _ in told(spark, tmp_path / "long", [long + " " + " ".join(passage[:60]), " ".join(passage), "a b c"])] == [60, 60, 0]
