"""SentencePiece encoding and decoding with N-best segmentation.

A text with a space before it is a lattice of the vocabulary's pieces, whose U+2581 stands for a space; characters
without a piece, U+2581 itself among them, are byte pieces. A forward Viterbi pass gives every position the best score of a path that reaches it. Those
scores are exact heuristics for an A-star search from the end backwards, which so pops whole paths in order of score
and gives the N best segmentations without visiting others.

No piece goes on over a line feed or from a character into a following space (checked when a model is loaded), so the
lattice of a text is a chain of small lattices, one per word with the spaces before it. The forward pass runs over all
words of a batch at once and also keeps the second-best score of each position. Only the N - 1 words of a text whose
second path is closest to their best can differ in its N best paths: these are searched backwards, and the text's
paths are merged from theirs by their distance to the best.

The vocabulary file is not trained or copied: its path is a parameter, read once on the driver, and its bytes (under
a megabyte) go to the executors with the function.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, release_memory, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
SPACE = "▁"
#: A byte piece costs this much more than the worst piece.
BYTE_PENALTY = 10.0
_BASE, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 17
_UNIT = re.compile(r" *[^ \n]+| +|\n")
#: Words kept per worker, those kept with their N best paths, and the longest word of the batched pass.
CACHE = 120_000
SEARCHED = 10_000
LONGEST = 40
#: Texts whose new words are looked up together hold about so many characters.
GROUP = 1_000_000


class Model:
    """The pieces of a model with their scores, and the search."""

    def __init__(self, content: bytes, n_best: int = N_BEST):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.n_best, size = n_best, sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = [0] * 256
        self.piece: dict[str, tuple[int, float, tuple[int, ...]]] = {}
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                p = p.replace(SPACE, " ")
                self.piece[p] = (i, sp.get_score(i), (i,))
                self.bytes[i] = p.encode()
        scores = [s for _, s, _ in self.piece.values() if s > -1e8]
        # Runs of spaces have no rank of their own (-1e9); they count as the worst piece.
        worst = min(scores, default=0.0)
        self.piece = {p: (i, max(w, worst), ids) for p, (i, w, ids) in self.piece.items()}
        self.byte_score = worst - BYTE_PENALTY
        if any("\n" in p or re.search("[^ ] ", p) for p in self.piece):
            raise ValueError("a piece goes on over a word boundary; this vocabulary needs one lattice per text")
        self.longest = max(map(len, self.piece), default=1)
        self.table = np.array(self.bytes, object)
        self._forget()
        self.searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self._index()

    def _forget(self) -> None:
        """An empty cache: number of a word; by number ids (32-bit, little-endian) and score of its best path, distance of its second."""
        self.cache: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.best, self.gap = np.zeros(0), np.zeros(0)

    def _index(self) -> None:
        """The pieces by a hash of their characters, in a table and, where a place is taken, in a second one."""
        names = list(self.piece)
        codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64)
        length = np.array([len(x) for x in names], np.int64)
        end = np.cumsum(length)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(self.longest + 1, _BASE, np.uint64), dtype=np.uint64)
            key = np.zeros(len(names), np.uint64)
            for i in range(self.longest):
                use = length > i
                key[use] = key[use] * _BASE + codes[(end - length)[use] + i] + np.uint64(1)
        if len(np.unique(key)) < len(key):
            raise ValueError("two pieces share a hash")
        self.power = power
        # A slot holds the hash and the number of one piece; where others fell in the same slot, they are in the next table.
        self.tables = []
        rest = np.arange(len(names))
        while len(rest):
            slot = self._slot(key[rest], len(self.tables))
            keys, at, more = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32), np.zeros(_SLOTS, bool)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], at[slot[first]] = key[rest[first]], rest[first]
            over = np.setdiff1d(np.arange(len(rest)), first)
            more[slot[over]] = True
            self.tables.append((keys, at, more))
            rest = rest[over]
        self.ids = np.array([self.piece[x][0] for x in names] + [-1], np.int32)
        self.scores = np.array([self.piece[x][1] for x in names] + [-np.inf])

    @staticmethod
    def _slot(key: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * _SPREAD) >> np.uint64(46 - 5 * table) & np.uint64(_SLOTS - 1)).astype(np.intp)

    def _find(self, key: np.ndarray, table: int = 0) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        keys, at, more = self.tables[table]
        slot = self._slot(key, table)
        hit = keys[slot] == key
        out = np.where(hit, at[slot], np.int32(-1))
        if table + 1 < len(self.tables) and len(rest := np.flatnonzero(more[slot] & ~hit)):
            out[rest] = self._find(key[rest], table + 1)
        return out

    def forward(self, units: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids and score of the best path of each unit and the distance of its second, by one Viterbi pass over all."""
        order = sorted(range(len(units)), key=lambda i: -len(units[i]))
        length = np.array([len(units[i]) for i in order], np.int64)
        codes = np.frombuffer("".join(units[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.cumsum(length) - length
        inside = np.arange(len(codes)) - np.repeat(start, length)
        span = min(self.longest, int(length[0]))
        number = np.full((span, len(codes)), -1, np.int32)  # [l - 1, p]: the piece of l characters that ends at p
        key = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, span + 1):
                at = np.flatnonzero(inside >= size - 1)
                # A piece of one more character to the left.
                key[at] = (codes[at - (size - 1)] + np.uint64(1)) * (self.power[size - 2] if size > 1 else np.uint64(1)) + key[at]
                number[size - 1, at] = self._find(key[at])
        score = self.scores[number]
        lost = np.flatnonzero(number[0] < 0)
        if len(lost):  # byte pieces
            c = codes[lost]
            score[0, lost] = self.byte_score * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        node = start + np.arange(len(units))  # place of a unit's first node; nodes are one more than characters
        one, two = np.zeros(len(codes) + len(units)), np.full(len(codes) + len(units), -np.inf)
        back = np.zeros(len(codes) + len(units), np.int8)
        for b in range(1, int(length[0]) + 1):
            n = int(np.searchsorted(-length, -b, side="right"))  # units of at least b characters
            size = np.arange(1, min(b, span) + 1)[:, None]
            here = node[:n] + b
            w = score[: len(size), start[:n] + b - 1]
            c = one[here - size] + w
            arg, cols = c.argmax(0), np.arange(n)
            one[here], back[here] = c[arg, cols], arg + 1
            other = two[here - arg - 1] + w[arg, cols]
            c[arg, cols] = -np.inf
            two[here] = np.maximum(c.max(0), other)
        # All best paths backwards, step by step.
        left, total = length.copy(), node + length
        steps = np.empty((len(units), int(length[0])), np.int32)
        for k in range(int(length[0])):
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            size = back[node[on] + left[on]].astype(np.int64)
            steps[on, steps.shape[1] - 1 - k] = self.ids[number[size - 1, start[on] + left[on] - 1]]
            left[on] -= size
        taken = self._counts(back, node, length)
        broken = set(np.repeat(np.arange(len(units)), length)[lost].tolist())
        every, width = steps.astype("<i4").tobytes(), 4 * steps.shape[1]
        raw: list = [b""] * len(units)
        for row, (i, k) in enumerate(zip(order, taken.tolist())):
            raw[i] = every[(row + 1) * width - 4 * k : (row + 1) * width]
            if row in broken:
                raw[i] = self._with_bytes(units[i], np.frombuffer(raw[i], "<i4").tolist())
        place = np.empty(len(units), np.int64)
        place[order] = np.arange(len(units))
        return raw, one[total][place], (one[total] - two[total])[place]

    def _counts(self, back: np.ndarray, node: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of pieces of each unit's best path."""
        left, out = length.copy(), np.zeros(len(length), np.int64)
        while len(on := np.flatnonzero(left > 0)):
            left[on] -= back[node[on] + left[on]]
            out[on] += 1
        return out

    def _with_bytes(self, unit: str, ids: list[int]) -> bytes:
        """ids of a unit's path with each -1, a character without a piece, spelled in bytes."""
        out, at = [], 0
        for i in ids:
            if i < 0:
                out.extend(map(self.byte_id.__getitem__, unit[at].encode("utf-8", "surrogatepass")))
                at += 1
            else:
                out.append(i)
                at += len(self.bytes[i].decode())
        return array("i", out).tobytes()

    def _edges(self, s: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For each end position the pieces that end there (start, score, ids), and the forward Viterbi scores."""
        n, find, longest = len(s), self.piece.get, self.longest
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[]]
        best = [0.0]
        for b in range(1, n + 1):
            here, top = [], -np.inf
            for a in range(max(b - longest, 0), b):
                x = find(s[a:b])
                if x is not None:
                    w = x[1]
                    here.append((a, w, x[2]))
                    if best[a] + w > top:
                        top = best[a] + w
            if s[b - 1] not in self.piece:
                raw = s[b - 1].encode("utf-8", "surrogatepass")
                w = self.byte_score * len(raw)
                here.append((b - 1, w, tuple(map(self.byte_id.__getitem__, raw))))
                top = max(top, best[b - 1] + w)
            edges.append(here)
            best.append(top)
        return edges, best

    def search(self, s: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations of one unit, best first; of equal ones that whose last step was met last."""
        edges, best = self._edges(s)
        # Agenda: minus (score so far from the end + best to get here), serial number, position, score so far, path.
        agenda: list = [(-best[-1], 0, len(s), 0.0, None)]
        serial, out, pop, push = 0, [], heapq.heappop, heapq.heappush
        left = [self.n_best] * (len(s) + 1)
        while agenda:
            _, _, b, score, path = pop(agenda)
            while b and left[b]:  # once the N best through a position are on their way, no other matters
                left[b] -= 1
                # The best step keeps the total: it is followed at once, the others wait.
                goal, on = best[b], None
                for a, w, i in reversed(edges[b]):  # of equal ones the shortest, as in the forward pass
                    if on is None and best[a] + w == goal:
                        on = (a, w, i)
                    elif left[a]:
                        serial -= 1  # of equal totals the path met last goes first, so that plateaus do not fan out
                        push(agenda, (-(score + w + best[a]), serial, a, score + w, (i, path)))
                b, score, path = on[0], score + on[1], (on[2], path)
            if not b:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((score, tuple(ids)))
                if len(out) == self.n_best:
                    break
        return out

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Puts the words of the texts into the cache and returns them text by text."""
        split = [_UNIT.findall(" " + t) if t else [] for t in texts]
        every = set().union(*split)
        new = every - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self._forget()
            new = every
        order = sorted(new)  # any order will do; sorted, runs are alike
        short, long_ = [u for u in order if len(u) <= LONGEST], [u for u in order if len(u) > LONGEST]
        for i in range(0, len(short), 20_000):
            self._add(short[i : i + 20_000], *self.forward(short[i : i + 20_000]))
        for u in long_:
            p = self.paths(u)
            self._add([u], [array("i", p[0][1]).tobytes()], np.array([p[0][0]]), np.array([p[0][0] - p[1][0] if len(p) > 1 else np.inf]))
        return split

    def _add(self, units: list[str], raw: list[bytes], best: np.ndarray, gap: np.ndarray) -> None:
        self.cache.update(zip(units, range(len(self.raw), len(self.raw) + len(units))))
        self.raw += raw
        self.best, self.gap = np.concatenate([self.best, best]), np.concatenate([self.gap, gap])

    def paths(self, u: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best paths of one word."""
        found = self.searched.get(u)
        if found is None:
            found = self.search(u)
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            if len(u) <= LONGEST:
                self.searched[u] = found
        return found

    def encode(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        """The N best segmentations of a whole text: score and ids, best first; null and empty texts have one, empty."""
        return [(w, np.frombuffer(r, "<i4")) for w, r in self.packed(self.prepare([text or ""])[0])]

    def packed(self, units: list[str]) -> list[tuple[float, bytes]]:
        """The N best segmentations of a text of the given words, which are in the cache; ids as 32-bit numbers."""
        if not units:
            return [(0.0, b"")]
        number = list(map(self.cache.__getitem__, units))
        raw = list(map(self.raw.__getitem__, number))
        at = np.array(number)
        out = [(float(self.best[at].sum()), b"".join(raw))]
        if self.n_best < 2:
            return out
        gap = self.gap[at]
        close = np.argsort(gap, kind="stable")[: self.n_best - 1].tolist()
        combined: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for i in sorted(i for i in close if gap[i] < np.inf):
            p = self.paths(units[i])
            more = [(d + p[0][0] - p[k][0], c + ((i, k),)) for d, c in combined for k in range(1, len(p))]
            combined = heapq.nsmallest(self.n_best, combined + more)
        for d, c in combined[1:]:
            changed = raw.copy()
            for i, k in c:
                changed[i] = array("i", self.paths(units[i])[k][1]).tobytes()
            out.append((out[0][0] - d, b"".join(changed)))
        return out

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding put in front goes."""
        return b"".join(self.table[np.asarray(ids, np.intp)].tolist()).decode("utf-8", "surrogatepass")[1:]


_MODELS: dict[tuple[str, int], Model] = {}


def loaded(content: bytes, n_best: int) -> Model:
    """One model per Python worker, so that its cache outlives a batch."""
    key = (hashlib.sha256(content).hexdigest(), n_best)
    if key not in _MODELS:
        _MODELS[key] = Model(content, n_best)
    return _MODELS[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def groups(texts) -> Iterator[list[str]]:
    """The texts (null: empty) in runs of about GROUP characters."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= GROUP:
            yield run
            run, size = [], 0
    if run:
        yield run


def digests(docs: DataFrame, text: str = "text", model: str = MODEL, n_best: int = N_BEST) -> tuple[DataFrame, str]:
    """docs with a struct column on the N best segmentations of each text, and the column's name.

    n_pieces, score and ids_sha256 (of little-endian 32-bit ids) of the best path, n_best_scores, n_best_sha256,
    decoded_sha256 of the text decoded from the best path, round_trip: whether that is the text.
    Null texts are empty: no ids, score 0. Very long texts are encoded whole. Columns and repeated rows of docs stay; an
    empty table gives an empty result.
    """
    content = read_model(model)
    at = fresh(docs.columns, "encoded")
    kind = "n_pieces long, score double, n_best_scores array<double>, ids_sha256 string, n_best_sha256 string, decoded_sha256 string, round_trip boolean"

    def sha(content: bytes) -> str:
        return hashlib.sha256(content).hexdigest()

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = loaded(content, n_best)
        for texts in batches:
            rows = []
            for group in groups(texts):
                for t, units in zip(group, m.prepare(group)):
                    paths = m.packed(units)
                    raw = [r for _, r in paths]
                    back = m.decode(np.frombuffer(raw[0], "<i4"))
                    rows.append((len(raw[0]) // 4, paths[0][0], [s for s, _ in paths], sha(raw[0]), sha(b"|".join(raw)), sha(back.encode("utf-8", "surrogatepass")), back == t))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

    return small_batches(docs).withColumn(at, run(F.col(text))), at


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """docs with piece_ids, the ids of each text's best segmentation, in place of the text, and n_best_scores of its N best.

    Null and empty texts have no ids and the one score 0. Of equally good segmentations the search decides, always alike.
    Very long texts are encoded whole. Other columns and repeated rows stay; new names give way to columns that there are.
    An empty table gives an empty result. Rows leave in runs of about GROUP characters, so that a worker holds the ids
    of few texts at a time.
    """
    content = read_model(model)
    others = [c for c in docs.columns if c != text]
    at = fresh(others, "piece_ids")
    scores_at = fresh([*others, at], "n_best_scores")
    kind = T.StructType([T.StructField(at, T.ArrayType(T.IntegerType())) if f.name == text else f for f in docs.schema.fields] + [T.StructField(scores_at, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(content, n_best)
        for batch in batches:
            k, done = batch.schema.names.index(text), 0
            for group in groups(batch.column(k).to_pylist()):
                raw, scores = [], []
                for units in m.prepare(group):
                    paths = m.packed(units)
                    raw.append(paths[0][1])
                    scores.append([x for x, _ in paths])
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                part = batch.slice(done, len(group))
                done += len(group)
                columns = [ids if i == k else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.list_(pa.float64()))], [*(at if i == k else n for i, n in enumerate(part.schema.names)), scores_at])
        m._forget()
        m.searched.clear()
        release_memory()

    return small_batches(docs).mapInArrow(run, kind)


def decode(docs: DataFrame, ids: str = "piece_ids", model: str = MODEL) -> tuple[DataFrame, str]:
    """docs with the text of the ids in an array column (null: null), and the name of the text's column.

    Empty arrays give empty texts. Columns and repeated rows of docs stay; an empty table gives an empty result.
    """
    content = read_model(model)
    at = fresh(docs.columns, "decoded")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = loaded(content, 1)
        for rows in batches:
            yield pd.Series([None if r is None else m.decode(r) for r in rows], dtype=object)

    return docs.withColumn(at, run(F.col(ids))), at


def pieces(docs: DataFrame, text: str = "text", id_column: str = "doc_id", model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces and piece_ids of each document's best segmentation, to train on, and the scores of its N best.

    Rows are handled as encode() does; extra columns are dropped, whatever their names. Null ids stay.
    """
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return encode(plain, model=model).select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "n_best_scores")


def query(spark, sf_dir):
    """op6: whole `documents`; ids appear as digests."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, at = digests(d)
    scores = F.array_join(F.transform(f"{at}.n_best_scores", lambda x: F.round(x, 3).cast("string")), ",")
    return out.select("doc_id", f"{at}.n_pieces", f"{at}.ids_sha256", f"{at}.score", scores.alias("n_best_scores"), f"{at}.n_best_sha256", f"{at}.decoded_sha256", f"{at}.round_trip")
