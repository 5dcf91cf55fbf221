"""Removal of long repeated byte strings with run-length-compressed Burrows-Wheeler indexes.

A byte goes if a string of WIDTH bytes that covers it also starts anywhere else, in the same or another document.

An index over all text in one place does not scale, so windows of WIDTH bytes are first dealt out by an anchor: the
position in the window with the smallest hash of GRAM bytes. Equal windows have equal anchors at equal offsets, so
all repeats of a window carry one anchor hash. Neighbouring windows share anchors; a run of windows with one anchor
is one row (about one per 185 bytes), with a hash of all the bytes that the run spans.

1. Equal texts are one text; a text that occurs more than once is a repeat as a whole.
2. Runs of one anchor and the same bytes are one class. Of each class whose anchor occurs more than once, one context
   goes to the anchor's group, or two if the class has several runs; contexts whose windows share their common bytes
   (by ranges of offsets) with no other are left out, as they can match nothing.
3. Groups are packed into batches. Over a batch's text a suffix order is built by ranks of ever longer prefixes, its
   Burrows-Wheeler transform is cut into runs, and the length of the match with the preceding suffix is taken directly
   only at the starts of runs: elsewhere it is one less than that of the text position before. Streaming over the text
   gives matching statistics, and a window is a repeat where they reach WIDTH. What holds for the context of a class
   holds for all its runs.
4. A group too large for one task is dealt out again by finer ranges of offsets and the bytes that all windows of a
   range share, down to single windows; each of these smaller groups is indexed in the same way.

Hashes only bring together what may be equal; the index compares the bytes and decides. (That all members of a class
have the same bytes rests on 128 bits of hashes, those of the anchor and of the run.)

Passages of WORDS words and more are often shorter than WIDTH bytes. They stay, but passages() tells of those that stand
in other texts too, by anchors of PART words; here windows are equal if their hashes of 64 bits are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, mix64, small_batches, text_of, utf8, word_spans, written

WIDTH = 400
GRAM = 32
SECTION = 1 << 20
#: Bytes of the first key of a suffix.
PACK = 7
#: Bytes of contexts of a group that one task may index, and of a batch of smaller groups: what sorts within a core's cache.
GROUP_BYTES = 1 << 20
BATCH_BYTES = 48_000
#: Words of the passages that n_shared_words tells of, words of their anchors, and windows of words that are cut into runs at a time.
WORDS, PART = 50, 8
PIECE = 1 << 18
#: Offsets of windows of words before their anchor that are told from others at once, by the words that all of them share.
NEAR = 11
#: Offsets in a range, by level; the first is all there are.
RANGES = (WIDTH, 46, 6, 1)
#: Offsets in a range of the filter before the index.
COARSE = 62
_BASE = 0xD6E8FEB86659FD93
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _TABLES:
        n = SECTION + WIDTH + 2
        with np.errstate(over="ignore"):
            for b in (_BASE, pow(_BASE, -1, 1 << 64)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                _TABLES.append(np.cumprod(x, dtype=np.uint64))
    return _TABLES


class Hashes:
    """Hashes of all substrings of at most SECTION + WIDTH bytes, or of so many hashes of words."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _tables()
        value = _VALUE[data] if data.dtype == np.uint8 else data
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(data)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _GOLD)

    def all(self, size: int) -> np.ndarray:
        """The hashes of all substrings of one size, in order; without copies, as this is most of the work on texts."""
        with np.errstate(over="ignore"):
            x = self.sums[size:] - self.sums[:-size]
            x *= self.inverse[: len(x)]
            x += np.uint64(size) * _GOLD
            rest = np.empty_like(x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):  # mix64
                np.right_shift(x, np.uint64(shift), out=rest)
                x ^= rest
                if factor:
                    x *= np.uint64(factor)
        return x


def _anchors(part: np.ndarray, width: int, size: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of `width` elements with one anchor of `size`: first and last window, the anchor's place, its hash, the elements' hash.

    Windows over elements of several owners belong to no run.
    """
    grams = width - size + 1
    h = Hashes(part)
    gram = h.all(size)
    n = len(gram)
    low = np.uint64((1 << 21) - 1)
    key = np.full(-(-n // grams) * grams, np.iinfo(np.uint64).max, np.uint64)
    np.bitwise_and(gram, ~low, out=key[:n])
    key[:n] |= np.arange(n, dtype=np.uint64)
    block = key.reshape(-1, grams)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(part) - width + 1
    m = np.minimum(behind[:windows], ahead[grams - 1 : grams - 1 + windows])
    m &= low
    m = m.view(np.int64)
    edge = m[1:] != m[:-1]
    if own is not None:
        inside = own[:windows] == own[width - 1 :]
        edge |= np.diff(inside)
    edge = np.flatnonzero(edge) + 1
    a, b = np.concatenate([[0], edge]), np.concatenate([edge, [windows]]) - 1
    if own is not None:
        a, b = a[inside[a]], b[inside[a]]
    place = m[a]
    with np.errstate(over="ignore"):
        whole = mix64(h(a, b + width) + (place - a).astype(np.uint64) * _GOLD)
    return a, b, place, gram[place], whole


def runs(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By section: its first byte, and of each run the first and last window, the anchor's place, its hash, the bytes' hash."""
    for first in range(0, len(data) - WIDTH + 1, SECTION):
        yield first, *_anchors(data[first : first + SECTION + WIDTH - 1], WIDTH, GRAM)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word, and a hash of each word, however long the words."""
    starts, ends = word_spans(data)
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SECTION, "right")), i + 1)
        first, end = starts[i], ends[j - 1]
        if end - first > SECTION:  # one word
            out.append(np.array([xxhash.xxh64_intdigest(data[first:end].tobytes())], np.uint64))
        else:
            out.append(Hashes(data[first:end])(starts[i:j] - first, ends[i:j] - first))
        i = j
    return starts, np.concatenate(out)


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys and their ranks, equal keys with equal ranks."""
    order = np.argsort(key)
    ordered = key[order]
    step = np.zeros(len(key), np.int64)
    np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return order, rank


def repeats(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, for each of its windows, whether the window's bytes start elsewhere in any of the contexts.

    The run-length index: see the module's text. Separators sort by context and are all different.
    """
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    n = len(text)
    own = np.repeat(np.arange(len(contexts)), sizes + 1)
    # Suffix order by prefixes of PACK bytes, then three (or two) times as long, and so on; the ranks of each length stay, to compare suffixes with.
    at = np.arange(n)
    gap = ends[own] - at  # bytes before the separator
    key = np.zeros(n, np.int64)
    for i in range(PACK):
        key = key * 257
        inside = gap > i
        key[inside] += text[at[inside] + i]
    rank = _dense(key)[1]
    order, rank = _dense(rank * (len(contexts) + 1) + np.where(gap < PACK, own + 1, 0))
    grow = 3 if (n + 1) ** 3 < 1 << 63 else 2  # a key holds that many ranks
    ranks, h = [rank.astype(np.int32)], PACK
    while int(rank[order[-1]]) < n - 1:
        key = rank * (n + 1) ** (grow - 1)
        for i in range(1, grow):
            if i * h < n:
                key[: -i * h] += (rank[i * h :] + 1) * (n + 1) ** (grow - 1 - i)
        order, rank = _dense(key)
        h *= grow
        ranks.append(rank.astype(np.int32))
    del key, rank
    # Runs of the transform: a suffix at the start of a run is sampled, the others follow from the text before them.
    last = text[order - 1]
    sampled = np.ones(n, bool)
    sampled[1:] = (last[1:] != last[:-1]) | (last[1:] == 0)
    heads = np.flatnonzero(sampled)
    heads = heads[heads > 0]
    x, y = order[heads], order[heads - 1]
    match = np.zeros(len(heads), np.int64)
    for level in [x for x in range(len(ranks) - 1, -1, -1) for _ in range(grow - 1)]:
        inside = np.flatnonzero((x + match < n) & (y + match < n))
        same = inside[ranks[level][(x + match)[inside]] == ranks[level][(y + match)[inside]]]
        match[same] += PACK * grow**level
    for _ in range(PACK - 1):  # what is left is shorter than PACK
        inside = np.flatnonzero((x + match < n) & (y + match < n))
        same = inside[(text[(x + match)[inside]] == text[(y + match)[inside]]) & (text[(x + match)[inside]] > 0)]
        if not len(same):
            break
        match[same] += 1
    known = np.full(n, -1, np.int64)
    known[order[0]] = 0
    known[x] = match
    source = np.maximum.accumulate(np.where(known >= 0, at, 0))
    before = np.maximum(known[source] - (at - source), 0)  # match with the preceding suffix, by text position
    # A suffix matches the one that follows it as that one matches it.
    both = before.copy()
    follows = np.zeros(n, np.int64)
    follows[order[:-1]] = before[order[1:]]
    np.maximum(both, follows, out=both)
    start = ends - sizes
    return [both[s : s + max(size - WIDTH + 1, 0)] >= WIDTH for s, size in zip(start, sizes)]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


#: Columns that name a distinct text: two independent 64-bit hashes.
ID = ("h", "g")
#: Columns that name a context: its class, and which of the class's members it is (0, or 1 for a second).
ROLE = ("one", "two", "copy")
_ID = "h long, g long"


def texts_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, g, text, copies): the distinct texts of docs (null: empty) in a table bucketed by (h, g).

    Equal texts meet here once, so that all later work follows the amount of distinct text. The buckets spare the
    later joins by (h, g) their shuffles of texts.
    """
    d = docs.select(*names(text), text_of(text).alias("text"))
    return bucketed(d.groupBy(*ID).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), *ID)


def names(text: str = "text") -> list:
    """The columns h and g of a text."""
    return [F.xxhash64(text_of(text)).alias("h"), F.xxhash64(F.lit("second"), text_of(text)).alias("g")]


def anchored(texts: DataFrame) -> DataFrame:
    """One row per run of each (h, g, text): anchor, whole, and its windows a to b and the anchor's place, in bytes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, text in enumerate(rows["text"]):
                for first, a, b, place, anchor, whole in runs(np.frombuffer(utf8(text), np.uint8)):
                    out.append((np.full(len(a), i), anchor.view(np.int64), whole.view(np.int64), first + a, first + b, first + place))
            if out:
                i, anchor, whole, a, b, place = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"h": rows["h"].to_numpy()[i], "g": rows["g"].to_numpy()[i], "anchor": anchor, "whole": whole, "a": a, "b": b, "place": place})

    return texts.select(*ID, "text").mapInPandas(cut, f"{_ID}, anchor long, whole long, a long, b long, place long")


def cores(context: bytes, off: int) -> list[int]:
    """For each range of COARSE offsets that has windows in the context, a hash of the bytes that all its windows share."""
    out = []
    for q in range((off - (len(context) - WIDTH)) // COARSE, off // COARSE + 1):
        core = context[off - q * COARSE : off - q * COARSE - COARSE + 1 + WIDTH]
        out.append(xxhash.xxh64_intdigest(core, q) - (1 << 63))
    return out


def paired(rows: DataFrame) -> DataFrame:
    """The contexts that share the core of some range with another one: no window of the rest is a repeat."""
    core = rows.select("key", F.explode("cores").alias("core"), *ROLE)
    twice = core.groupBy("key", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "core")
    some = core.join(twice, ["key", "core"]).select("key", *ROLE).distinct()
    return rows.join(some, ["key", *ROLE]).drop("cores")


def contexts(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The bytes that the chosen runs of each class span: ROLE, key, offset of the first window before the anchor, bytes.

    The key is the anchor; a class of several runs sends two of them, as different texts or places hold its bytes.
    """
    runs = classes.select("anchor", "whole", F.posexplode(F.when(F.col("c") > 1, F.array("first", "last")).otherwise(F.array("first"))).alias("copy", "r"))
    wanted = runs.groupBy("r.h", "r.g").agg(F.collect_list(F.struct("anchor", "whole", "copy", "r.a", "r.b", "r.place")).alias("runs"))

    @F.pandas_udf("array<struct<one: long, two: long, copy: int, key: long, off: long, context: binary, cores: array<long>>>")
    def slices(texts: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, rows):
            data, mine = utf8(text), []
            for r in found:
                c, off = data[r["a"] : r["b"] + WIDTH], r["place"] - r["a"]
                mine.append({"one": r["anchor"], "two": r["whole"], "copy": r["copy"], "key": r["anchor"], "off": off, "context": c, "cores": cores(c, off)})
            out.append(mine)
        return pd.Series(out)

    return texts.join(wanted, [*ID]).select(F.explode(slices("text", "runs")).alias("c")).select("c.*")


def indexed(rows: DataFrame) -> DataFrame:
    """Repeated windows (one, two, a, b) of the classes of the contexts, by indexes over batches of whole groups of one key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def result() -> pd.DataFrame:
            out = []
            for (one, two, copy, _), flags in zip(held, repeats([x[3] for x in held])):
                if copy == 0:
                    out.extend((one, two, a, b) for a, b in _spans(flags))
            return pd.DataFrame(out, columns=["one", "two", "a", "b"]).astype("int64")

        last = None
        for rows in batches:
            for key, one, two, copy, c in zip(*(rows[x].tolist() for x in ("key", *ROLE, "context"))):
                if key != last and size >= BATCH_BYTES:
                    yield result()
                    held, size = [], 0
                last = key
                held.append((one, two, copy, bytes(c)))
                size += len(c) + 1
        if held:
            yield result()

    placed = rows.repartition("key").sortWithinPartitions("key", *ROLE)
    return placed.select("key", *ROLE, "context").mapInPandas(run, "one long, two long, a long, b long")


def finer(rows: DataFrame, width: int) -> DataFrame:
    """The contexts dealt out by ranges of `width` offsets: the new key holds the bytes that all windows of a range share, `part` all its bytes."""

    @F.pandas_udf("array<struct<key: long, part: long, off: long, start: long, context: binary>>")
    def deal(keys: pd.Series, offs: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for key, off, c in zip(keys.tolist(), offs.tolist(), data):
            c = bytes(c)
            h = Hashes(np.frombuffer(c, np.uint8))
            low = off - (len(c) - WIDTH)  # offset of the last window
            mine = []
            for q in range(low // width, off // width + 1):
                a, b = off - min(off, q * width + width - 1), off - max(low, q * width)  # windows of the range
                core = off - q * width, off - (q * width + width - 1) + WIDTH
                both = h(np.array([core[0], a]), np.array([core[1], b + WIDTH]))
                with np.errstate(over="ignore"):
                    new, part = mix64(np.array([np.uint64(key & (2**64 - 1)) * _GOLD + both[0] + np.uint64(q), both[1] + np.uint64(off - a)])).astype(np.int64).tolist()
                mine.append({"key": new, "part": part, "off": off - a, "start": a, "context": c[a : b + WIDTH]})
            out.append(mine)
        return pd.Series(out)

    return rows.select(*ROLE, F.explode(deal("key", "off", "context")).alias("c")).select(*ROLE, "c.*")


def settled(rows: DataFrame, level: int = 0) -> DataFrame:
    """Repeated windows (one, two, a, b) of the classes of the contexts, whatever the size of a group.

    Groups over GROUP_BYTES are dealt out by ranges of offsets. Equal parts of contexts are classes again, of which two
    members go on, so that groups shrink; in the last level a group is a single window, twice at most. What the index
    says of a class of parts holds for all contexts that have it.
    """
    if level + 1 == len(RANGES):
        return indexed(rows)
    sizes = rows.groupBy("key").agg(F.sum(F.length("context")).alias("bytes"))
    large = written(sizes.where(F.col("bytes") > GROUP_BYTES).select("key"))
    if not large.take(1):
        return indexed(rows)
    small = indexed(rows.join(large, "key", "left_anti"))
    parts = written(finer(rows.join(large, "key", "left_semi"), RANGES[level + 1]))
    me = F.struct(*ROLE, "start", "off", "context")
    classes = parts.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.min(me).alias("first"), F.max(me).alias("last"))
    both = F.posexplode(F.when(F.col("c") > 1, F.array("first", "last")).otherwise(F.array("first")))
    chosen = classes.select("key", "part", both.alias("copy", "r")).select(F.col("key").alias("one"), F.col("part").alias("two"), "copy", "key", "r.off", "r.context")
    found = written(settled(written(chosen), level + 1)).select(F.col("one").alias("key"), F.col("two").alias("part"), "a", "b")
    again = parts.where("copy = 0").select("one", "two", "start", "key", "part").join(found, ["key", "part"])
    return small.union(again.select("one", "two", F.col("start") + F.col("a"), F.col("start") + F.col("b")))


def repeated(texts: DataFrame) -> DataFrame:
    """Runs of windows (h, g, a, b) that are repeats, of distinct texts (h, g, text)."""
    rows = written(anchored(texts))
    run = F.struct(*ID, "a", "b", "place")
    classes = rows.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(run).alias("first"), F.max(run).alias("last"))
    anchors = classes.groupBy("anchor").agg(F.sum("c").alias("n")).where("n > 1").select("anchor")
    shared = written(classes.join(anchors, "anchor"))
    found = written(settled(written(paired(written(contexts(texts, shared))))))
    found = found.select(F.col("one").alias("anchor"), F.col("two").alias("whole"), F.col("a").alias("from"), F.col("b").alias("to"))
    return rows.join(found, ["anchor", "whole"]).select(*ID, (F.col("a") + F.col("from")).alias("a"), (F.col("a") + F.col("to")).alias("b"))


def _blocks(rows: pd.DataFrame) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (h, text) of texts in blocks of SECTION bytes or one text: places of the rows, first word of each, hashes of all words, the text of each word."""
    held, size = [], 0
    texts = [utf8(t) for t in rows["text"]]
    for i, t in enumerate(texts):
        if len(t) >= 2 * WORDS - 1:
            held.append(i)
            size += len(t) + 1
        if held and (size >= SECTION or i + 1 == len(texts)):
            starts, words = word_hashes(np.frombuffer(b" ".join(texts[j] for j in held), np.uint8))
            first = np.cumsum([0, *(len(texts[j]) + 1 for j in held[:-1])])
            yield held, np.searchsorted(starts, first), words, np.searchsorted(first, starts, "right") - 1
            held, size = [], 0


def worded(texts: DataFrame) -> DataFrame:
    """One row per run of windows of WORDS words of each (h, text): anchor, whole, and `at`, its first window, further windows and the anchor's offset."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = rows["h"].to_numpy()
            for held, base, words, own in _blocks(rows):
                for first in range(0, len(words) - WORDS + 1, PIECE):
                    a, b, place, anchor, whole = _anchors(words[first : first + PIECE + WORDS - 1], WORDS, PART, own[first : first + PIECE + WORDS - 1])
                    mine = own[first + a]
                    at = ((first + a - base[mine]) << 12) + ((b - a) << 6) + place - a
                    yield pd.DataFrame({"h": ids[held][mine], "anchor": anchor.astype(np.int64), "whole": whole.astype(np.int64), "at": at})

    return texts.select("h", "text").mapInPandas(cut, "h long, anchor long, whole long, at long")


def windowed(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The windows of wanted runs (h, g, runs): h, core, first window and the windows' hashes, by ranges of NEAR offsets.

    The core is a hash of the words that all windows of a range share.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids, found = rows["h"].to_numpy(), rows["runs"].tolist()
            for held, base, words, own in _blocks(rows):
                at = np.concatenate([found[j] for j in held]).astype(np.int64)
                first = np.repeat(base, [len(found[j]) for j in held])
                a, more, off = (at >> 12) + first, (at >> 6) & 63, at & 63
                run = np.repeat(np.arange(len(at)), more + 1)
                w = np.arange(len(run)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1) + a[run]
                near = (a + off)[run] - w
                near //= NEAR
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(run) != 0) | (np.diff(near) != 0)]))
                start, q, place = w[edge], near[edge], (a + off)[run[edge]]
                core, window = np.zeros(len(edge), np.uint64), np.zeros(len(w), np.uint64)
                for piece in range(0, len(words), PIECE):  # each window and core in the piece where it starts
                    h = Hashes(words[piece : piece + PIECE + WORDS])
                    x, y = (np.flatnonzero((v >= piece) & (v < piece + PIECE)) for v in (w, place - q * NEAR))
                    window[x] = h(w[x] - piece, w[x] - piece + WORDS)
                    c = (place - q * NEAR)[y] - piece
                    with np.errstate(over="ignore"):
                        core[y] = mix64(h(c, c + WORDS - NEAR + 1) + q[y].astype(np.uint64) * _GOLD)
                mine = own[start]
                yield pd.DataFrame({"h": ids[held][mine], "core": core.astype(np.int64), "start": start - base[mine], "windows": np.split(window.astype(np.int64), edge[1:])})

    return texts.join(wanted, [*ID]).select("h", "text", "runs").mapInPandas(cut, "h long, core long, start long, windows array<long>")


def passages(texts: DataFrame) -> DataFrame:
    """(h, g, windows): of the distinct texts (h, g, text) those that share WORDS words in a row with another, and stretches of such windows (first and last, in words).

    Runs of one anchor and the same words in several texts are shared as they are. Of other runs with an anchor of
    several texts the windows are compared, if the words common to a range of them are in several texts. Every step is a
    count by a hash and a join with the written hashes that count, which Spark splits where one has many rows, so that no
    group has to fit a task. Other texts are told by h alone.
    """
    several = F.min("h") != F.max("h")
    rows = written(worded(texts))
    anchors = written(rows.groupBy("anchor").agg(several.alias("several")).where("several").select("anchor"))
    some = written(rows.join(anchors, "anchor"))
    run = F.struct("h", "at")
    classes = written(some.groupBy("anchor", "whole").agg(several.alias("several"), F.min(run).alias("first"), F.max(run).alias("last")))
    settled = some.join(classes.where("several").select("anchor", "whole"), ["anchor", "whole"]).select("h", "at")
    # Runs that no other text has as a whole; they may share windows with each other and with two runs of each settled class.
    alone = some.join(classes.where("not several").select("anchor", "whole"), ["anchor", "whole"]).select("h", "at")
    mixed = written(classes.groupBy("anchor").agg(F.min("several").alias("all")).where("not all").select("anchor"))
    members = classes.where("several").join(mixed, "anchor").select(F.explode(F.array("first", "last")).alias("r")).select("r.*")
    ids = texts.select(*ID)
    wanted = alone.union(members).join(ids, "h").groupBy(*ID).agg(F.collect_list("at").alias("runs"))
    ranges = written(windowed(texts, wanted))
    cores = written(ranges.groupBy("core").agg(several.alias("several")).where("several").select("core"))
    windows = written(ranges.join(cores, "core").select("h", "start", F.posexplode("windows").alias("i", "window")).select("h", (F.col("start") + F.col("i")).alias("a"), "window"))
    shared = written(windows.groupBy("window").agg(several.alias("several")).where("several").select("window"))
    single = windows.join(shared, "window").select("h", "a", F.col("a").alias("b"))
    first = F.shiftright("at", 12)
    found = settled.select("h", first.alias("a"), (first + F.shiftright("at", 6).bitwiseAND(63)).alias("b")).union(single)
    return found.groupBy("h").agg(F.collect_list(F.struct("a", "b")).alias("windows")).join(ids, "h").select(*ID, "windows")


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct text of docs: h and g (see names()), text, copies, and spans, the bytes to remove as array<struct<start, end>> in order and apart, ends exclusive.

    Also shared, the spans of words that stand WORDS or more in a row in another row of docs, as such an array in words.

    Null texts are empty; texts of fewer than WIDTH bytes hold no repeat. A text that docs holds more than once repeats
    itself as a whole. Very long texts are anchored in sections of SECTION bytes that overlap by a window. Rows and
    ids play no part, so null ids, ties, repeated rows and clashing column names are harmless. An empty table gives
    an empty result.
    """
    texts = texts_of(small_batches(docs), text)
    lists = written(repeated(texts).groupBy(*ID).agg(F.collect_list(F.struct("a", "b")).alias("windows")))

    @F.pandas_udf("array<struct<start: long, end: long>>")
    def spans(sizes: pd.Series, copies: pd.Series, windows: pd.Series) -> pd.Series:
        out = []
        for n, c, w in zip(sizes.tolist(), copies.tolist(), windows):
            found = [(0, n)] if c > 1 and n >= WIDTH else removed(w) if w is not None else []
            out.append([{"start": a, "end": b} for a, b in found])
        return pd.Series(out)

    @F.pandas_udf("array<struct<start: long, end: long>>")
    def shared(copied: pd.Series, windows: pd.Series) -> pd.Series:
        out = []
        for t, w in zip(copied, windows):
            n = len(word_spans(np.frombuffer(utf8(t), np.uint8))[0]) if t is not None else 0
            found = [(0, n)] if n >= WORDS else removed(w, WORDS) if w is not None else []
            out.append([{"start": a, "end": b} for a, b in found])
        return pd.Series(out)

    size = F.octet_length(F.encode("text", "UTF-8"))
    out = texts.join(lists, [*ID], "left").withColumn("spans", spans(size, "copies", "windows")).drop("windows")
    told = written(passages(texts))
    return out.join(told, [*ID], "left").withColumn("shared", shared(F.when(F.col("copies") > 1, F.col("text")), "windows")).drop("windows")


def removed(windows, width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal spans (end exclusive) covered by windows of `width` bytes or words, given as (first, last) pairs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((w["a"], w["b"] + width) for w in windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def keep(data: bytes, spans) -> bytes:
    """data without the spans."""
    at, out = 0, []
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    out.append(data[at:])
    return b"".join(out)


def query(spark, sf_dir):
    """op7: whole `documents`; n_shared_words counts the words that stand WORDS or more in a row in another document too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long")
    def report(texts: pd.Series, spans: pd.Series, shared: pd.Series) -> pd.DataFrame:
        rows = []
        for t, found, words in zip(texts, spans, shared):
            data = utf8(t)
            rows.append((len(data), sum(s["end"] - s["start"] for s in found), len(found), hashlib.sha256(keep(data, found)).hexdigest(), sum(s["end"] - s["start"] for s in words)))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"])

    r = dedup(docs).select(*ID, report("text", "spans", "shared").alias("r"))
    return docs.select("doc_id", *names()).join(r, [*ID]).select("doc_id", "r.*")
