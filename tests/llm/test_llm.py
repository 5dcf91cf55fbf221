"""The training-data operators against brute force, and at their edges: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from test_near_copies import by_hand as jaccard_by_hand
from docloom.llm import common, fingerprints, html_extract, language_id, mixing, pii, quality_classifier, quality_rules, sentencepiece_nbest, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that was for with on are this by at from thing other nation river".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts at the edges: null, empty, white space, one word, repeats, a long text and a long word."""
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(55, 120)) + "." for _ in range(25)]
    near = base[0].split()
    near[3] = "changed"
    texts = [None, "", " \n\t ", "word", *base, base[1], base[1], " ".join(near), base[2] + "\n" + base[3], sentence(rng, 6000), "x" * 30000, "a b c d e f " * 300, "Ünïcödé ☃ 😀 " + base[4], "123 456 !!"]
    rows = [(i, t, ("en", "fr", None)[i % 3] if t else None, ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, base[5], "en", None, 0))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).cache()


@pytest.fixture(scope="module")
def clashing(spark, corpus):
    """The same with more columns, named as operators name theirs."""
    df = spark.createDataFrame(corpus, DOCS)
    extra = {x: F.lit(i) for i, x in enumerate(("measures", "pattern", "fp", "h", "spans", "size", "target", "taken", "piece_ids", "kept", "base_spans", "slice", "Text_hash"))}
    return df.withColumns(extra).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_tables_are_broadcast_only_within_a_bound(spark, monkeypatch):
    big = spark.createDataFrame([(i, f"k{i % 3}") for i in range(50)], "id long, k string")
    small = spark.createDataFrame([("k0", 1), ("k1", 2)], "of string, v int")
    want = sorted(map(str, common.join_table(big, small, "k", "of", "left", "id").collect()))
    assert "BroadcastHashJoin" in common.join_table(big, small, "k", "of")._jdf.queryExecution().toString()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    salted = common.join_table(big, small, "k", "of", "left", "id")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, salted.collect())) == want and salted.columns == ["id", "k", "of", "v"]
    monkeypatch.setattr(common, "DEAL_ROWS", 4)  # each key's 16 or 17 rows in five parts
    assert sorted(map(str, common.join_table(big, small, "k", "of", "left", "id").collect())) == want


# ---------------------------------------------------------------- quality rules


def base_measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark, docs, corpus):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for doc_id, text, *_ in corpus:
        m = base_measures(text)
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_weak_supervision_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.85
    votes = np.where(truth[:, None], np.where(rng.random((4000, quality_rules.N_RULES)) < 0.98, 1, -1), np.where(rng.random((4000, quality_rules.N_RULES)) < 0.45, -1, 1))
    votes[rng.random(votes.shape) < 0.2] = 0
    posterior, model = quality_rules.fit(dict(Counter(map(tuple, votes.tolist()))))
    said = np.array([posterior[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (said == truth).mean() > 0.93 and 0.75 < model["prior"] < 0.95


def test_quality_keeps_columns(docs, clashing):
    kept = quality_rules.keep_good(clashing)
    assert kept.columns == clashing.columns
    want = Counter(r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_quality_agrees_with_labels(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality_rules.quality_rules(d).join(lab, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert np.mean([x.kept == (x.quality == 1) for x in r]) > 0.97


# ---------------------------------------------------------------- SimHash


def hash_by_hand(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_texts(docs, corpus):
    prints = {d: hash_by_hand(t) for d, t, *_ in corpus if d is not None}
    comp = components_by_hand(prints)
    rows = simhash.simhash(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id == comp[9]  # the document with the same text
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", comp[r.doc_id])


def test_simhash_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('one two three')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_components_of_random_fingerprints(spark):
    rng = random.Random(9)
    prints = {}
    for i in range(400):
        x = prints[rng.randrange(i)] if i and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    centre = rng.getrandbits(64)
    for i in range(400, 460):  # one crowded ball: many members of one bucket
        prints[i] = centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    df = spark.createDataFrame([(i, x - 2**64 if x >> 63 else x) for i, x in prints.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
    assert got == components_by_hand(prints)


def test_covering_masks_miss_no_pair():
    masks = list(simhash.masks().values())
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_simhash_edges(spark, clashing):
    assert simhash.simhash(empty(spark)).count() == 0
    one = simhash.keep_one(clashing)
    assert one.columns == clashing.columns
    ids = [r.doc_id for r in one.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {r.component_id for r in simhash.simhash(clashing).where("doc_id is not null").collect()}


# ---------------------------------------------------------------- PII


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def spans_by_hand(text):
    out = []
    for no, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (no == 0) or (no == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (no == 2 and 12 <= len(digits) <= 19 and luhn(digits)) or (no == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), no, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_is_exact(spark):
    rng = random.Random(8)
    pick = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    texts = [None, "", "1 " * 20000, "a." * 20000 + "@" + "b." * 20000, "a" * 50000, "9" * 50000]
    texts += [pick("0123456789 -.+()@aé\x01\x02_", rng.randint(0, 50)) for _ in range(400)]
    texts += [pick(["a", "b.", "c@", "x.y", "@", ".", "1", "1.2", " ", "..", "-", "é"], rng.randint(0, 25)) for _ in range(400)]
    texts += [pick(["12", "4111 1111 1111 1111", "1111-1111", "255", ".", "+1 ", "(555) ", "555-1234", "😀", " ", "300"], rng.randint(0, 10)) for _ in range(400)]
    got = {r.doc_id: r for r in pii.pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = spans_by_hand(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [want.count(f"{k}:") for k in pii.KINDS]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_pii_adds_and_redacts(spark, clashing):
    t = "mail joe (at) site (dot) org, call 555-123-4567 or a@b.de. At the. End 12.50 on 2024-01-31."
    df = spark.createDataFrame([(1, t, len(t)), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in pii.redact(df).collect()}
    assert rows[1].text == "mail [EMAIL], call [PHONE] or [EMAIL]. At the. End 12.50 on 2024-01-31." and rows[1].n_chars == len(rows[1].text)
    assert (rows[2].text, rows[3].text) == (None, "clean")
    assert pii.redact(clashing).columns == clashing.columns and pii.pii(empty(spark)).count() == 0


def test_pii_leaves_clean_documents_alone(spark):
    """Without base spans only the planted keys are spans, and all of them are."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = F.col("text").rlike('token = "[0-9a-f]{40}"')
    r = pii.pii(d).join(d.select("doc_id", planted.alias("planted")), "doc_id")
    assert r.where("not planted and n_email + n_ip + n_card + n_phone = 0 and spans <> ''").count() == 0
    assert r.where("planted and spans not like '%secret:%'").count() == 0 < r.where("planted").count()


def test_pii_is_native(docs):
    plan = pii.pii(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- mixing


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= set(over)
    return target


def test_mixing(spark, docs, corpus):
    r = mixing.mix(mixing.sized(docs)).collect()
    assert len(r) == len(corpus)
    sizes, taken = Counter(), Counter()
    for x in r:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size
    want = targets_by_hand(sizes)
    longest = max(x.size for x in r)
    for x in r:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
    for s in want:
        assert abs(taken[s] - want[s]) <= longest
    assert abs(sum(taken.values()) - sum(want.values())) <= 1
    assert sorted(map(str, r)) == sorted(map(str, mixing.mix(mixing.sized(docs.repartition(7))).collect()))


def test_mixed_corpus_holds_what_was_taken(spark, docs, clashing):
    plan = {(x.doc_id, x.source, x.size): x.taken for x in mixing.mix(mixing.sized(docs)).collect()}
    out = mixing.take(clashing)
    assert out.columns == clashing.columns
    got = Counter()
    for x in out.collect():
        got[x.doc_id, x.source] += len([w for w in re.split(r"[\x20\x09-\x0D]+", x.text or "") if w])
    copies = Counter((x.doc_id, x.source) for x in docs.collect())
    want = {(d, s): t * copies[d, s] for (d, s, _), t in plan.items() if t}
    assert got == want
    assert mixing.mix(mixing.sized(empty(spark))).count() == 0 and mixing.take(empty(spark)).count() == 0


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentencepiece_nbest.Model(sentencepiece_nbest.read_model(), 4)


def test_n_best_of_words(model):
    rng = random.Random(2)

    def paths(edges, b):
        if b == 0:
            yield 0.0, ()
        for a, w, i in edges[b] if b else ():
            for s, p in paths(edges, a):
                yield s + w, p + i

    for _ in range(150):
        u = " " + "".join(rng.choice("theronéa😀z▁") for _ in range(rng.randint(1, 7)))
        every = sorted(paths(model._edges(u)[0], len(u)), key=lambda x: -x[0])
        got = model.search(u)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:4]]) and len({p for _, p in got}) == len(got)
        raw, best, gap = model.forward([u])
        assert tuple(np.frombuffer(raw[0], "<i4").tolist()) == got[0][1] and best[0] == pytest.approx(got[0][0])
        assert gap[0] == pytest.approx(every[0][0] - every[1][0]) if len(every) > 1 else np.isinf(gap[0])


def test_n_best_of_texts(model):
    import itertools

    for text in ("the nation of it", "on  and\nthe", "aé"):
        units = sentencepiece_nbest._UNIT.findall(" " + text)
        best = sorted((sum(s for s, _ in c) for c in itertools.product(*(model.search(u) for u in units))), reverse=True)[:4]
        got = model.encode(text)
        assert [s for s, _ in got] == pytest.approx(best)
        assert all(model.decode(p) == text for _, p in got)


@pytest.mark.parametrize("text", ["", " ", "  x  ", "▁ literal ▁▁", "a\nb\n\n", "\U0010fffe", "é😀" * 50, "word" * 3000, "tab\tand\x00nul", " hard"])
def test_round_trip(model, text):
    assert model.decode(model.encode(text)[0][1]) == text


def test_sentencepiece_frames(spark, docs, clashing, corpus):
    out, at = sentencepiece_nbest.digests(clashing)
    for r in out.select("text", at).collect():
        text = r.text or ""
        assert r[1].round_trip and r[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r[1].n_best_scores == sorted(r[1].n_best_scores, reverse=True)
    p = sentencepiece_nbest.pieces(docs)
    assert all(r.n_pieces == len(r.piece_ids) for r in p.collect()) and p.count() == len(corpus)
    back, name = sentencepiece_nbest.decode(p)
    assert Counter(r[0] for r in back.select(name).collect()) == Counter(t or "" for _, t, *_ in corpus)
    assert sentencepiece_nbest.pieces(empty(spark)).count() == 0


# ---------------------------------------------------------------- fingerprints


def jaccard(a, b):
    def bag(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        n = min(5, len(w))
        return Counter(zip(*(w[i:] for i in range(n)))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collision_rate_is_the_similarity():
    rng = random.Random(5)
    errors = []
    for _ in range(60):
        a = sentence(rng, 200).split()
        b = a[: rng.randint(0, 200)] + sentence(rng, 100).split()
        a, b = " ".join(a) * rng.randint(1, 3), " ".join(b)
        errors.append(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_edited_texts(docs, corpus):
    order = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    likeness, signature = fingerprints.likeness, fingerprints.signature
    rows = sorted(fingerprints.fingerprints(docs).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert len(rows) == len(corpus)
    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = rows[i]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == signature(t).astype(">u2").tobytes().hex()
        assert r.edited_fingerprint == signature(edited).astype(">u2").tobytes().hex()
        assert r.near_edited == pytest.approx(likeness(signature(t), signature(edited)))
        assert r.near_next == pytest.approx(likeness(signature(t), signature(nxt)))


def test_fingerprint_edges(spark):
    assert fingerprints.fingerprints(empty(spark)).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    nulls = fingerprints.fingerprints(spark.createDataFrame([(None, "a"), (None, "b c")], "doc_id long, text string"))
    assert nulls.count() == 2


@pytest.mark.parametrize("n_ids,base", [(0, 0), (1, 0), (400, 0), (400, (1 << 62) + 1)])
def test_fingerprints_of_many_null_ids(spark, n_ids, base):
    """Null ids follow the ids in the order of their texts' hashes, over all slices, with repeated rows and clashing names."""
    rows = [(None, f"null {i} " * (i % 7 + 1)) for i in range(300)] + [(None, "again")] * 3 + [(base + i, f"text {i} of some words") for i in range(n_ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({x: F.lit("x") for x in ("mark", "slice", "guest", "row", "fingerprint", "n_chars")})
    keyed = df.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 16)).alias("m")).collect()
    order = [r.text for r in sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -(r.m or 0), r.text))]
    want = Counter()
    for i, t in enumerate(order):
        nxt = order[(i + 1) % len(order)]
        want[hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in fingerprints.fingerprints(df).collect()) == want


# ---------------------------------------------------------------- repeats


def removal_by_hand(texts):
    w = suffix_dedup.WIDTH
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + w] for b in raw for i in range(len(b) - w + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = True
        out.append((len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("group_bytes", [1 << 20, 2000])
def test_repeats_are_removed(spark, tmp_path, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    rng = random.Random(6)
    passage = sentence(rng, 130)
    texts = [None, "", "short", passage, passage[:399], passage[1:401], "ab" * 900, "é" * 500]
    texts += [f"{sentence(rng, rng.randint(1, 60))} {passage[rng.randint(0, 60):]} {sentence(rng, rng.randint(1, 60))}" for _ in range(25)]
    texts += [sentence(rng, 150) for _ in range(5)]
    texts += texts[-2:]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.query(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == removal_by_hand(texts)


def test_index_on_small_alphabets(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDTH", 5)
    rng = random.Random(5)
    for _ in range(200):
        c = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        seen = Counter(x[i : i + 5] for x in c for i in range(len(x) - 4))
        want = [[seen[x[i : i + 5]] > 1 for i in range(len(x) - 4)] for x in c]
        assert [f.tolist() for f in suffix_dedup.repeats(c)] == want


def test_repeats_of_rows_and_null_ids(spark, tmp_path):
    rng = random.Random(3)
    t = sentence(rng, 120)
    spark.createDataFrame([(1, t), (1, t), (None, sentence(rng, 120))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = suffix_dedup.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, len(t)), (1, len(t))]
    empty(spark).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert suffix_dedup.query(spark, str(tmp_path / "e")).count() == 0


# ---------------------------------------------------------------- languages


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Net(3, hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 4, (5, 6)), rng.integers(0, 3, 5)

    def loss():
        states = np.zeros((2, 6, 5, 3))
        for d in (0, 1):
            wx, u = net._scaled(d)
            h = np.zeros((5, 3))
            for t in range(6) if not d else range(5, -1, -1):
                h = language_id._cell(wx[x[:, t]].astype(float), h, u.astype(float), 3)[4]
                states[d, t] = h
        logit = states[0] @ net.p["v"][:3] + states[1] @ net.p["v"][3:] + net.p["c"]
        p = np.exp(logit) / np.exp(logit).sum(-1, keepdims=True)
        return -np.mean(np.log(p[:, np.arange(5), y]))

    g = net.step(x, y)
    for k, i in (("u0", (1, 2)), ("u1", (0, 7)), ("x0", (int(x[0, 0]), 4)), ("x1", (int(x[1, 2]), 8)), ("v", (2, 1)), ("c", (0,))):
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        down = loss()
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.language_id(d).join(d.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r)
    held = [x for x in r if x.held_out]
    assert np.mean([x.lang == x.lang_pred for x in held]) > 0.97 and all(0 <= x.score <= 1 for x in r)


def test_language_edges(spark, clashing):
    r = {x.doc_id: x for x in language_id.language_id(clashing).collect()}
    assert r[0].lang_pred == r[1].lang_pred == r[2].lang_pred == "und" and r[0].score == 0
    assert r[3].lang_pred in ("en", "fr")
    assert r[len(r) - 2].lang_pred == "und"  # digits and signs only
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(none).first().lang_pred == "und"
    assert language_id.language_id(empty(spark)).count() == 0


# ---------------------------------------------------------------- pages

LAYOUT = (
    "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=x>menu</a></nav><div id='cookie-notice'>cookies</div>"
    "<div class='page'>{}</div><aside>side</aside><div class=\"ad big\">buy</div><form><input>find</form><div class='comments'><p>first!</p></div><footer>&copy; f</footer></body></html>"
)


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (LAYOUT.format("<article><h1>A &lt;b&gt;</h1><p>one<br>two &nbsp; three<p>four <b>five<p>six</article>"), "A <b>\n\none two three\n\nfour five\n\nsix"),
        (LAYOUT.format("<h2>Plain</h2><ul><li>i<li>j</ul><!-- no --><table><tr><td>c<td>d</table>"), "Plain\n\ni\n\nj\n\nc\n\nd"),
        ("<article><p>a</p><section id=comments><article>hey</article></section><p>b &quo; &am", "a\n\nb &quo; &am"),
        ("<article><p>go <span class=ad>buy <b>now</b></span> on <a class='btn shareLink'>tweet</a>.<p>b<span hidden>x<p>c", "go on .\n\nb\n\nc"),
        ("<div class='layout has-sidebar'><div class=header>Site</div><div class=mainNav>m</div><div class=post><h2 class=header>T</h2>x</div><div id=commentList>c</div></div>", "T\n\nx"),
        ("<p>open<div>next<p cl", "open\n\nnext"),
        ("<main><p>x &#8364; &#x41;</p><style>p{}</style><div hidden>no</div></main><p>out</p>", "x € A"),
    ],
)
def test_page_text(page, want):
    assert html_extract.Page(page).text() == want


def test_style_tree_cuts_what_every_page_of_a_host_has(spark):
    rng = random.Random(1)
    rows = [(i, f"http://Host.example/{i}", f"<body><div class=box>always the same words</div><div class=text><p>{sentence(rng, 20)}</p></div></body>") for i in range(60)]
    rows += [(100, "http://small.example/", "<body><div class=box>always the same words</div></body>"), (101, None, None), (100, "http://small.example/", "<body><div class=box>always the same words</div></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("cuts", F.lit(1))
    r = html_extract.extract(df).collect()
    assert len(r) == len(rows)
    assert all("always" not in x.text and x.text for x in r if x.page_id < 60)
    assert [x.text for x in r if x.page_id == 100] == ["always the same words"] * 2
    assert next(x for x in r if x.page_id == 101).n_chars == 0
    tree = {x.path: x for x in html_extract.style_tree(html_extract.parsed(df.select("url", "html"))).where("host = 'host.example'").collect()}
    assert tree["body/div.box"].importance < 0.25 < tree["body/div.text"].importance
    assert html_extract.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- classifier


def test_classifier_shrinks_sparse_groups(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality_classifier.classify(d, lab, F.col("source"), F.concat_ws("/", "source", "lang")).join(lab, "doc_id").collect()
    assert np.mean([x.kept == (x.quality == 1) for x in r]) > 0.95
    rows = [(i, f"{sentence(random.Random(i), 60)}", "big" if i < 200 else f"lone{i}") for i in range(210)]
    few = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {x.doc_id: x for x in quality_classifier.classify(few, lab.limit(0), F.col("source"), F.col("source")).collect()}
    assert len(out) == 210 and all(x.doc_prob == 0.5 and x.kept for x in out.values())


def test_classifier_edges(spark, clashing, corpus):
    lab = spark.createDataFrame([(4, 1), (5, 1), (3, 0), (3, 0), (2, 0), (None, 1), (6, None)], "doc_id long, quality int")
    r = quality_classifier.classify(clashing, lab, F.col("source"), F.col("lang")).collect()
    assert len(r) == len(corpus) and all(0 <= x.score <= 1 for x in r)
    assert quality_classifier.classify(empty(spark), lab, F.col("source"), F.col("lang")).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.written(stage(spark, docs, data))
        if k < 4:
            assert docs.columns == columns, name
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "simhash_dedup":
            comp = jaccard_by_hand({d: texts[d] for d in kept})  # the stage's rule: 5 words, 0.8; op8 alone has 3 words and 2 bits
            assert {r.doc_id for r in docs.collect()} == set(comp.values())
        if name == "pii_redaction":
            assert docs.count() == before.count() and not any(spans_by_hand(r.text) for r in docs.collect())
        if name == "source_mixing":
            assert 1.4 < docs.select(F.sum(F.regexp_count("text", F.lit(common.WORD)))).first()[0] / before.select(F.sum(F.regexp_count("text", F.lit(common.WORD)))).first()[0] <= 1.51
    back, at = sentencepiece_nbest.decode(docs)
    assert Counter(r[0] for r in back.select(at).collect()) == Counter(r.text for r in before.collect())
    json.dumps([n for n, _ in corpus_pipeline.STAGES])


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_at_the_edges(spark, clashing, corpus, data, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, clashing, data)
    rows = out.collect()
    assert stage(spark, clashing.limit(0), data).count() == 0
    if k < 4:
        assert out.columns == clashing.columns
        assert all(r.measures == 0 and r.kept == 9 for r in rows)  # the columns that look like the operators' own
    texts, before = [r.text for r in rows] if k < 4 else [], Counter((r[0], r[1]) for r in corpus)
    if name == "quality_rules":
        assert all(t and len(t.split()) >= 50 for t in texts) and not Counter((r.doc_id, r.text) for r in rows) - before
    if name == "simhash_dedup":
        assert sum(not (t or "").strip() for t in texts) == 1 and Counter(r.doc_id for r in rows)[None] == 1
        assert max(n for i, n in Counter(r.doc_id for r in rows).items() if i is not None) == 1
    if name == "pii_redaction":
        assert len(rows) == len(corpus) and sum(t is None for t in texts) == 1 and sum(t == "" for t in texts) == 1
    if name == "source_mixing":
        assert all(t and t.strip() for t in texts) and {r.source for r in rows} <= {"s1", "s2", None}
    if name == "sentencepiece":
        assert len(rows) == len(corpus) and all((r.n_pieces == 0) == (r.piece_ids == []) and r.n_best_scores == sorted(r.n_best_scores, reverse=True) for r in rows)
