"""Conversation repair against a plain dynamic program over single turns, and at its edges."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from docloom.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string"


def solid(text):
    return re.sub(r"[\x20\x09-\x0D]+$", "", text)


def damage_by_hand(rows):
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def cheapest_by_hand(symbols):
    """(cost, audit, roles) over single turns: symbols are (initial, must go, cut off)."""

    @lru_cache(maxsize=None)
    def best(i, made, inserted=0):
        # made: the last initial made, "" for none; inserted: insertions just before
        options = []
        if i == len(symbols):
            if made in ("", "a"):
                options.append((0, "", ()))
        else:
            initial, gone, cut = symbols[i]
            cost, audit, roles = best(i + 1, made)
            options.append((4 + cost, "D" + audit, (None, *roles)))
            if not gone:
                for letter, price, after in [("K", 0, initial)] + [("R", 3, x) for x in "ua"]:
                    if (made, after) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        cost, audit, roles = best(i + 1, after)
                        options.append((price + 3 * cut + cost, letter + audit, (after, *roles)))
        for x in "ua":
            if (made, x) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} and inserted < 3:
                cost, audit, roles = best(i, x, inserted + 1)
                options.append((3 + cost, "I" + audit, (x, *roles)))
        return min(options, default=(10**9, "", ()))

    return best(0, "")


def by_hand(rows, damage=True):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}"""
    rows = [tuple(r) for r in rows]
    out = {}
    after = list(damage_by_hand(rows)) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in turns:
            fault = "blank" if not solid(text) else "duplicate" if (role, text) in seen else "truncated" if solid(text)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [t for _, t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit, made = cheapest_by_hand(tuple(symbols))
        kept, source = [], iter(turns)
        for letter, initial in zip(audit, made):
            turn = next(source) if letter != "I" else None
            if letter != "D":
                role = turn[2] if letter == "K" else {"u": "user", "a": "assistant"}[initial]
                kept.append(f"{role}:{turn[3] if turn else ''}")
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def reported(frame):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def hard():
    """Conversations of all kinds: any roles, blank, cut off and repeated texts, equal, missing and far turns, repeated rows."""
    rng = random.Random(11)
    rows = []
    for conv in range(300):
        for i in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "User", None])
            text = rng.choice(["", " \n", None, "Yes.", "No!", "Well", "Why?", f"Words {i}.", f"Words {i} ", "Ünï☃", "😀."])
            turn = rng.choice([None, i, i, i, rng.randint(-3, 40)])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 2])
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (301, None, "user", "A."), (301, None, "assistant", "B.")]
    return rows


def test_reports_equal_a_plain_program(spark, hard):
    frame = spark.createDataFrame(hard, ROWS)
    assert reported(repair.reports(repair.damaged(frame))) == by_hand(hard)
    assert reported(repair.reports(repair.as_is(frame))) == by_hand(hard, damage=False)


def test_query_equals_a_plain_program(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert reported(repair.query(spark, data)) == by_hand(rows)


def test_runs_equal_single_turns():
    rng = random.Random(5)
    alphabet = [0, 1, 2, 3, 4, 5, 6, 7, repair.GONE]
    for _ in range(300):
        runs = tuple((rng.choice(alphabet), rng.randint(1, 4)) for _ in range(rng.randint(0, 4)))
        single = tuple((("sua"[s & 3] if s & 3 < 3 else "x") if s != repair.GONE else "u", s == repair.GONE, bool(s & 4) and s != repair.GONE) for s, n in runs for _ in range(n))
        assert repair.solve(runs) == cheapest_by_hand(single)[:2]


def test_long_runs_by_powers():
    cost, audit = repair.solve(((1, 100_000),))  # all of the user: an answer is inserted after each
    assert cost == 150_000 and len(audit) == 100_000 and set(audit) == {"K", "R"}
    assert repair.solve(((repair.GONE, 70_000),)) == (280_000, "D" * 70_000)
    assert repair.before_run(1, 12345, (0, 1, 2, 3)) == repair.before_run(1, 12344, repair.before_run(1, 1, (0, 1, 2, 3)))


def test_a_conversation_over_many_ranges(spark):
    """One conversation with all rows, in more ranges than one, gives what it gives in one."""
    rng = random.Random(3)
    rows = [(7, t // 2, rng.choice(["user", "assistant"]), rng.choice([f"Say {t}.", f"Say {t}", "Again.", ""])) for t in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, ROWS)
        assert repair._segments(repair._light(repair.as_is(frame))).count() > 1
        got = reported(repair.reports(repair.as_is(frame)))[7]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = reported(repair.reports(repair.as_is(frame)))[7]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == one and got[0] == 0
    import sys

    sys.setrecursionlimit(20_000)
    assert got == by_hand(rows, damage=False)[7]


def test_repaired_turns_and_edges(spark, hard):
    frame = spark.createDataFrame(hard, ROWS)
    turns = {}
    for r in sorted(repair.repaired(repair.damaged(frame)).collect(), key=lambda r: r["place"]):
        turns.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for conv, want in by_hand(hard).items():
        kept = turns.get(conv, [])
        assert [p for p, _, _ in kept] == list(range(len(kept)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode()).hexdigest() == want[-1]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for _, r, _ in kept))
    none = spark.createDataFrame([], ROWS)
    assert repair.reports(repair.damaged(none)).count() == 0 and repair.repaired(repair.damaged(none)).count() == 0
    from pyspark.sql import functions as F

    clash = frame.withColumns({c: F.lit(1) for c in ("part", "runs", "digest", "copies", "n", "seen", "last", "first", "audit")})
    assert reported(repair.reports(repair.damaged(clash))) == by_hand(hard)
    dropped = next(c for c in range(10**4) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = reported(repair.reports(repair.damaged(spark.createDataFrame([(dropped, 0, "user", "Hi.")], ROWS))))
    assert gone == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = spark.createDataFrame([(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "Ok.")], ROWS)
    assert repair.reports(repair.as_is(long)).first()["audit"] == "KK"
