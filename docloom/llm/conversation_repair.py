"""Repair of conversation structure by a min-plus dynamic program over runs of equal symbols.

A turn's symbol is the initial of its role and whether it must go (blank, or a copy) or ends cut off. Four states tell
which initials a repaired conversation may have next, so that a symbol is a 4 x 4 min-plus matrix and a run of n equal
symbols that matrix's n-th power, put together from cached binary powers. The cheapest audit is unrolled from there.

Symbols are gathered without texts, over ranges of (conversation, turn), so that a conversation of very many turns is
read by several tasks; only its runs come together. Its texts then stream through one task in turn order, turn by turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches, written

#: What each edit costs; the last is added for a cut-off turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Pairs of role initials that may stand next to each other.
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\f\r"
NEVER = 1 << 60

# States: nothing yet, after the system turn, after a user turn, after an assistant turn. A conversation may end in the first and last.
ENDS = (0, NEVER, NEVER, 0)
#: The state that a turn of each initial leads to, by the state before.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Where the one new or changed role that fits leads, and its role.
FITTING = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

# A symbol is one byte: the initial's place in "sua" (3: any other) + 4 if cut off, or 8: must go.
GONE = 8
FAULTS = ("blank", "duplicate", "truncated", "illegal")
COUNTS = ("n_rows", "turns", *FAULTS)
SUMMARY = "part int, runs binary, lengths array<long>, first_turn long, last_turn long, first_initial string, last_initial string, " + ", ".join(f"{c} long" for c in COUNTS)


def times(a: tuple, b: tuple) -> tuple:
    """The min-plus product of two matrices, rows of tuples."""
    columns = tuple(zip(*b))
    return tuple(tuple(min(x + y for x, y in zip(row, column)) for column in columns) for row in a)


def applied(a: tuple, values: tuple) -> tuple:
    """The min-plus product of a matrix and the costs to go."""
    return tuple(min(x + y for x, y in zip(row, values)) for row in a)


def _inserts() -> tuple:
    """Costs of reaching each state from each by insertions alone."""
    out = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for i in range(4):
        state, cost = i, 0
        for _ in range(3):
            state, cost = FITTING[state][0], cost + INSERT
            out[i][state] = min(out[i][state], cost)
    return tuple(map(tuple, out))


INSERTS = _inserts()


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial of the edit, its cost, state after it) of what can be done with a turn, insertions aside, in order of the initials."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        extra = CUT_OFF if symbol & 4 else 0
        after = NEXT.get("sua?"[symbol & 3], {}).get(state)
        if after is not None:
            out.append(("K", KEEP + extra, after))
        out.append(("R", REROLE + extra, FITTING[state][0]))
    return out


@lru_cache(maxsize=1024)
def power(symbol: int, k: int) -> tuple:
    """The min-plus transition of 2 ** k turns of one symbol, each with the insertions before it."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    step = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in edits(symbol, state):
            step[state][after] = min(step[state][after], cost)
    return times(INSERTS, tuple(map(tuple, step)))


def before_run(symbol: int, length: int, values: tuple) -> tuple:
    """Costs to go before a run of `length` equal symbols, given those after it: one product for each binary digit."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            values = applied(power(symbol, k), values)
    return values


def _unroll(symbol: int, length: int, state: int, after: tuple) -> tuple[str, int]:
    """The least audit of a run from a state to the costs `after` it, and the state it ends in."""
    if length > 64:  # halves, so that few cost vectors are held at a time
        half = length // 2
        left, state = _unroll(symbol, half, state, before_run(symbol, length - half, after))
        right, state = _unroll(symbol, length - half, state, after)
        return left + right, state
    values = [after]
    for _ in range(length):
        values.append(applied(power(symbol, 0), values[-1]))
    out = []
    for left in range(length, 0, -1):
        to_go, then = values[left], values[left - 1]
        need = to_go[state]
        while True:
            # Deleting comes before inserting, inserting before keeping and changing, as D < I < K < R.
            choices = [(x, cost, s) for x, cost, s in edits(symbol, state) if cost + then[s] == need]
            if choices and choices[0][0] == "D":
                break
            inserted = FITTING[state][0]
            if INSERT + to_go[inserted] == need:
                out.append("I")
                state, need = inserted, to_go[inserted]
                continue
            break
        letter, _, state = choices[0]
        out.append(letter)
    return "".join(out), state


def solve(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    """(cost, audit) of runs (symbol, length): the cheapest edits, and of those the least string of initials."""
    return _short(runs) if len(runs) <= 32 else _solved(runs)


@lru_cache(maxsize=1 << 14)
def _short(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    return _solved(runs)


def _solved(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    after = [applied(INSERTS, ENDS)]
    for symbol, length in reversed(runs):
        after.append(before_run(symbol, length, after[-1]))
    cost, state, audit = after.pop()[0], 0, []
    for (symbol, length), values in zip(runs, reversed(after)):
        letters, state = _unroll(symbol, length, state, values)
        audit.append(letters)
    while ENDS[state]:
        state = FITTING[state][0]
        audit.append("I")
    return cost, "".join(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage by crc32 of `conv_id:turn` modulo 20.

    0: no copy is left, 1: empty text, 2: no [.!?], 3: two copies, 4: role user. A null counts as one space in the hash, and as
    role and text; conv_id and turn themselves stay null.
    """
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def as_is(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows as they are, null roles and texts as one space."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def _light(rows: DataFrame) -> DataFrame:
    """Distinct turns without their texts: how often each stands there, its initial, and its first copy's fault."""
    # The last character that is not white space: a text without one is blank.
    solid = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    there = F.col("copies") > 0
    seen = rows.select(
        "conv_id", there.alias("there"), *(F.when(there, F.col(c)).alias(c) for c in ("turn", "role")), F.when(there, F.sha2("text", 256)).alias("digest"), "copies", F.when(there, solid).alias("last"),
    )
    turns = written(seen.groupBy("conv_id", "there", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("last").alias("last")))
    # Nulls are least in comparisons of structures, as in the order of turns.
    again = turns.where("there").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    joined = turns.alias("t").join(again.alias("a"), F.expr("t.conv_id <=> a.conv_id and t.role = a.role and t.digest = a.digest"), "left")
    return joined.select(F.expr("t.conv_id"), "turn", "t.role", "t.digest", "n", "last", F.expr("first is not null and not (first.turn <=> turn)").alias("seen"))


ORDER = ("conv_id", "turn", "role", "digest")


def _shape(rows: DataFrame, columns: str) -> tuple[str, pa.Schema]:
    """A result's columns after conv_id, as DDL and for Arrow."""
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {columns}"
    return ddl, to_arrow_schema(T.StructType.fromDDL(ddl))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, its rows) of sorted batches, a conversation at a time and a row at a time."""
    return groupby((row for batch in batches for row in batch.to_pylist()), key=itemgetter("conv_id"))


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most 1,000 rows, and of few rows where texts are long."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row.get("text", ""))
        if len(out) == 1000 or size > 1 << 24:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def _summary(conv_id, turns: Iterator[dict]) -> dict:
    """The runs and counts of consecutive distinct turns of one conversation."""
    runs, lengths, count = bytearray(), [], dict.fromkeys(COUNTS, 0)
    start = before = first = last = None  # initials and turn numbers

    for row in turns:
        n, initial, turn = row["n"], row["role"][:1] if row["role"] else "", row["turn"]
        if not n:
            continue
        blank, again, cut = not row["last"], row["seen"], row["last"] not in (".", "!", "?")
        own = GONE if blank or again else ("sua".find(initial) if initial and initial in "sua" else 3) + (4 if cut else 0)
        _extend(runs, lengths, [(own, 1), (GONE, n - 1)])
        if blank:
            count["blank"] += n
        else:
            count["duplicate"] += n - 1 + again
            count["truncated"] += not again and cut
        # Copies stand next to their equals, and no initial may follow itself.
        count["illegal"] += n - 1 + (before is not None and before + initial not in LEGAL)
        count["n_rows"] += n
        start, before = initial if start is None else start, initial
        if turn is not None and turn != last:
            count["turns"] += 1
            first, last = turn if first is None else first, turn
    return {"conv_id": conv_id, "runs": bytes(runs), "lengths": lengths, "first_turn": first, "last_turn": last, "first_initial": start, "last_initial": before, **count}


def _extend(runs: bytearray, lengths: list[int], more) -> None:
    """Adds runs, joining those of one symbol."""
    for symbol, length in more:
        if length and runs and runs[-1] == symbol:
            lengths[-1] += length
        elif length:
            runs.append(symbol)
            lengths.append(length)


def _segments(light: DataFrame) -> DataFrame:
    """Runs and counts of the turns of each conversation in each range of ORDER; of most conversations there is one."""
    ddl, schema = _shape(light, SUMMARY)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield from _batches(({"part": part, **_summary(conv_id, turns)} for conv_id, turns in _stream(batches)), schema)

    return light.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(gather, ddl)


def _joined(segments: list[dict]) -> tuple[dict, str]:
    """(counts, audit) of one conversation from its segments in order."""
    runs, lengths, total = bytearray(), [], dict.fromkeys(COUNTS, 0)
    first = last = before = None
    for s in segments:
        _extend(runs, lengths, zip(s["runs"], s["lengths"]))
        for k in COUNTS:
            total[k] += s[k]
        if s["n_rows"]:
            total["illegal"] += before is not None and before + s["first_initial"] not in LEGAL
            before = s["last_initial"]
        if s["first_turn"] is not None:
            total["turns"] -= last == s["first_turn"]
            first, last = s["first_turn"] if first is None else first, s["last_turn"]
    cost, audit = solve(tuple(zip(runs, lengths)))
    gaps = 0 if first is None else last - first + 1 - total["turns"]
    return {"gaps": gaps, **{k: total[k] for k in FAULTS}, "cost": cost}, audit


def _streamed(rows: DataFrame) -> DataFrame:
    """Each conversation's segments and then its turns, in order and in one task."""
    segments = _segments(_light(rows))
    own = [c for c in segments.columns if c != "conv_id"]
    turns = rows.where("copies > 0").withColumn("digest", F.sha2("text", 256))
    order = ("conv_id", F.col("part").asc_nulls_last(), *ORDER[1:])
    nulls = {c: F.lit(None).cast(segments.schema[c].dataType) for c in own}
    return small_batches(segments.unionByName(turns.withColumns(nulls), allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, counts, audit, turns of the repaired conversation) of what _streamed() gives; turns are (role, text, edit)."""
    for conv_id, rows in _stream(batches):
        segments, turn = [], None
        for turn in rows:
            if turn["part"] is None:
                break
            segments.append(turn)
        counts, audit = _joined(segments)
        yield conv_id, counts, audit, _edited(audit, chain([turn] if turn["part"] is None else [], rows))


def _edited(audit: str, turns: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    copies = (turn for turn in turns for _ in range(turn["copies"]))
    state = 0
    for edit in audit:
        role, text = None, ""
        if edit != "I":
            turn = next(copies)
            role, text = turn["role"], turn["text"]
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[role[0]][state]
        else:
            state, role = FITTING[state]
        yield role, text, edit


def reports(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text, copies): gaps, faults, cost, audit, repaired_sha256.

    Turns are taken in order of turn (nulls first), role and the SHA-256 of the text; a row of several copies, and equal rows, stand next to
    each other. A conversation without a copy left has zeros, an empty audit and the hash of the empty string. A null conv_id
    is a conversation; an empty table gives an empty result. An empty role has no initial, so that it is never kept. Texts are
    hashed as they stream by, however long a text or a conversation is; other columns are left out.
    """
    ddl, schema = _shape(rows, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, counts, audit, turns in _walk(batches):
            digest, between = hashlib.sha256(), ""
            for role, text, _ in turns:
                digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            yield {"conv_id": conv_id, **counts, "audit": audit, "repaired_sha256": digest.hexdigest()}

    return _streamed(rows).mapInArrow(lambda batches: _batches(told(batches), schema), ddl)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I), rows as in reports().

    Conversations of which nothing stays have no rows.
    """
    ddl, schema = _shape(rows, "place long, role string, text string, edit string")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, _, _, turns in _walk(batches):
            for place, (role, text, edit) in enumerate(turns):
                yield {"conv_id": conv_id, "place": place, "role": role, "text": text, "edit": edit}

    return _streamed(rows).mapInArrow(lambda batches: _batches(told(batches), schema), ddl)


def query(spark, sf_dir):
    """op11: whole `conversations`, damaged as the contract says."""
    return reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
