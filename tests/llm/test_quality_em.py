"""What estimation adds to the rules: learned rates, verdicts that differ from the start, posteriors against a plain computation."""

from collections import Counter

import numpy as np

from docloom.llm import quality_rules

N = quality_rules.N_RULES


def planted(rng, n):
    """Votes of three sharp rules, three that often err about good documents, and three that say nothing."""
    truth = rng.random(n) < 0.7
    right_on_good = np.array([0.99, 0.99, 0.99, 0.6, 0.6, 0.6, 0.5, 0.5, 0.5])
    right_on_bad = np.array([0.9, 0.85, 0.9, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5])
    right = np.where(truth[:, None], rng.random((n, N)) < right_on_good, rng.random((n, N)) < right_on_bad)
    votes = np.where(right == truth[:, None], 1, -1)
    votes[rng.random((n, N)) < 0.1] = 0
    return truth, votes, right_on_good, right_on_bad


def test_rates_are_learned_and_change_verdicts():
    truth, votes, good, bad = planted(np.random.default_rng(3), 20000)
    counts = dict(Counter(map(tuple, votes.tolist())))
    posterior, model = quality_rules.fit(counts)
    start, _ = quality_rules.fit(counts, rounds=0)
    said, first = (np.array([p[tuple(v)] >= 0.5 for v in votes.tolist()]) for p in (posterior, start))
    all_pass = (votes >= 0).all(1)
    assert (said == truth).mean() > 0.97 > 0.9 > (first == truth).mean()
    assert (said == truth).mean() > (all_pass == truth).mean() + 0.3
    assert np.abs(np.array(model["good"]) - good).max() < 0.03 and np.abs(np.array(model["bad"]) - bad).max() < 0.05 and abs(model["prior"] - 0.7) < 0.02


def test_rates_have_no_bounds():
    """Rules may be worse than a coin, or almost always right."""
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.3
    right = np.where(truth[:, None], rng.random((20000, N)) < 0.75, rng.random((20000, N)) < np.array([0.02, 0.999] + [0.9] * 7))
    votes = np.where(right == truth[:, None], 1, -1)
    _, model = quality_rules.fit(dict(Counter(map(tuple, votes.tolist()))))
    assert model["bad"][0] < 0.05 and model["bad"][1] > 0.98 and max(model["good"]) < 0.8 and model["prior"] < 0.35


def by_hand(votes, rounds=200):
    """Posteriors document by document, by Bayes' rule with plain products."""
    good, bad, prior = [quality_rules.START[0]] * N, [quality_rules.START[1]] * N, quality_rules.START[2]

    def posterior(v):
        g, b = prior, 1 - prior
        for x, r, s in zip(v, good, bad):
            g *= r if x == 1 else 1 - r if x == -1 else 1
            b *= 1 - s if x == 1 else s if x == -1 else 1
        return g / (g + b)

    w = quality_rules.WORTH
    for _ in range(rounds):
        p = [posterior(v) for v in votes]
        for_good, for_bad = [], []
        for i in range(N):
            right, cast = sum(q for q, v in zip(p, votes) if v[i] == 1), sum(q for q, v in zip(p, votes) if v[i])
            for_good.append((right + quality_rules.START[0] * w) / (cast + w))
            right, cast = sum(1 - q for q, v in zip(p, votes) if v[i] == -1), sum(1 - q for q, v in zip(p, votes) if v[i])
            for_bad.append((right + quality_rules.START[1] * w) / (cast + w))
        prior = (sum(p) + quality_rules.START[2] * w) / (len(p) + w)
        good, bad = for_good, for_bad
    return [posterior(v) for v in votes]


def test_query_against_the_plain_computation(spark, data):
    """kept of the registered query: base rule, then votes by the rules' own numbers and posteriors by hand."""
    rows = quality_rules.quality_rules(spark.read.parquet(f"{data}/documents.parquet")).collect()
    share = lambda a, b: a / max(b, 1)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    votes = [
        (
            vote(r.n_words < 50, r.n_words >= 100),
            vote(not 2.2 <= share(r.word_chars, r.n_words) <= 14, 3 <= share(r.word_chars, r.n_words) <= 10),
            vote(share(r.n_symbols, r.n_words) > 0.15, share(r.n_symbols, r.n_words) < 0.03),
            vote(share(r.n_dup_lines, r.n_lines) > 0.4 and r.n_lines > 3, r.n_dup_lines <= 1),
            vote(share(r.n_repeat_words, r.n_words) > 0.4, share(r.n_repeat_words, r.n_words) < 0.15),
            vote(share(r.n_function, r.n_words) < 0.02 and r.n_words >= 20, share(r.n_function, r.n_words) > 0.08),
            vote(share(r.n_upper, r.n_letters) > 0.5 and r.n_letters > 20, share(r.n_upper, r.n_letters) < 0.2),
            vote(share(r.n_loud, r.n_words) > 0.2, r.n_loud <= 2),
            vote(share(r.n_bare, r.n_words) > 0.2, share(r.n_bare, r.n_words) < 0.05),
        )
        for r in rows
    ]
    want = by_hand(votes)
    got = {r.doc_id: r for r in quality_rules.query(spark, data).collect()}
    for r, p in zip(rows, want):
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert abs(got[r.doc_id].posterior - p) < 1e-6 and got[r.doc_id].base_failed == failed and got[r.doc_id].kept == (not failed and p >= 0.5)
