"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import fingerprints, near_copies, simhash


def shingles(text):
    w = [x.encode().lower() for x in (text or "").split()]
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_hand(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("block", [700, 400_000])
def test_stage_is_brute_force_jaccard(spark, data, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    n = max(texts) + 1
    for _ in range(8):  # chains and stars of edits, near and beyond the bound
        base = [word() for _ in range(rng.randint(50, 150))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts[n], n = " ".join(copy), n + 1
            base = copy if rng.random() < 0.2 else base
    texts |= {n: None, n + 1: "", n + 2: "one", n + 3: "ONE"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = by_hand(texts)
    assert {r.doc_id: r.component_id for r in near_copies.components(df).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, df, data).collect()} == set(want.values())


def test_links_connect_what_is_similar():
    """All sets of a task against brute force, for any lead, among them sets that link to no lead."""
    rng = random.Random(5)
    for _ in range(60):
        base = [rng.sample(range(60), 30) for _ in range(3)]
        sets = [np.unique(rng.sample(rng.choice(base), rng.randint(20, 30)) + rng.sample(range(60, 90), rng.randint(0, 4))) for _ in range(rng.randint(2, 25))]
        lead, root = rng.randrange(len(sets)), list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        got = near_copies.links(sets, lead)
        near = lambda a, b: 10 * len(set(sets[a]) & set(sets[b])) >= 8 * len(set(sets[a]) | set(sets[b]))
        assert all(near(a, b) for a, b in got) and len(got) <= 2 * len(sets)
        for a, b in got:
            root[find(a)] = find(b)
        for a, b in itertools.combinations(range(len(sets)), 2):
            assert not near(a, b) or find(a) == find(b)


@pytest.mark.parametrize("radius", [2, 5])
def test_covering_masks_of_any_radius(radius):
    masks = list(simhash.masks(radius).values())
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 32
    rng = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(not m & flips for m in masks)


def test_fingerprints_find_all_within_the_radius(spark, monkeypatch):
    """With min-hashing switched off, SimHash alone links every similar pair of up to RADIUS bits, and no other kind of pair."""
    monkeypatch.setattr(near_copies, "bands", lambda h: np.zeros(0, np.int64))
    rng = random.Random(11)
    texts = {}
    for k in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 300))]
        for i in range(6):
            copy = list(base)
            for _ in range(min(i, 2)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            texts[10 * k + i] = " ".join(copy)
    texts |= {1000: "one two", 1001: "ONE\ntwo", 1002: None, 1003: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.components(df).collect()}
    sets, prints = {i: shingles(t) for i, t in texts.items()}, {i: simhash.majority(fingerprints.terms(t)[0]) for i, t in texts.items()}
    whole, found = by_hand(texts), 0
    for a, b in itertools.combinations(texts, 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and (prints[a] ^ prints[b]).bit_count() <= near_copies.RADIUS:
            assert got[a] == got[b], (a, b)
            found += sets[a] != sets[b]
    assert found > 50 and all(whole[i] == whole[got[i]] for i in texts)
