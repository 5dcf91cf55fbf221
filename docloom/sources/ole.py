"""Compound files (OLE containers): their streams, and the payload of an embedded object.

A compound file is a small file system: sectors in chains, a second allocation table of 64-byte sectors for short
streams, and a directory whose entries form a binary tree for each storage. Containers are read one by one in Arrow
batches; each needs memory in proportion to itself. `compound` writes one.
"""

from __future__ import annotations

import mimetypes
import posixpath
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: first bytes, free and special sector numbers, the size below which a stream is short, short sectors.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST, FREE, OWN_TABLE, TABLE_OF_TABLES, NOBODY = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC, 0xFFFFFFFF
SHORT, SHORT_SECTOR, ENTRY, IN_HEADER = 4096, 64, 128, 109
STORAGE, STREAM, ROOT = 1, 2, 5
#: The streams that hold an embedded file, and suffixes that say nothing of what is in a file.
NATIVE, CONTENTS = "\x01Ole10Native", "CONTENTS"
VAGUE = frozenset((".bin", ".ole", ".dat", ".tmp"))


class CompoundFile:
    """The streams of a container by path; a damaged one raises ValueError."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC or len(content) < 512:
            raise ValueError("not a compound file")
        self._data = content
        self._sector = 1 << struct.unpack_from("<H", content, 30)[0]
        directory, self._cutoff, short_first = struct.unpack_from("<I4xII", content, 48)
        more, tables = struct.unpack_from("<I", content, 68)[0], np.frombuffer(content, "<u4", IN_HEADER, 76)
        if not 128 <= self._sector <= 1 << 16:
            raise ValueError("no such sector size")
        seen = 0
        while more < TABLE_OF_TABLES:
            numbers = np.frombuffer(self._at(more), "<u4")
            tables, more, seen = np.concatenate([tables, numbers[:-1]]), int(numbers[-1]), seen + 1
            if seen * self._sector > len(content):
                raise ValueError("sectors in a ring")
        self._next = np.frombuffer(b"".join(self._at(int(x)) for x in tables if x < TABLE_OF_TABLES), "<u4")
        entries = self._chained(directory)
        self._entries = [entries[i : i + ENTRY] for i in range(0, len(entries) - ENTRY + 1, ENTRY)]
        self._short_next = np.frombuffer(self._chained(short_first), "<u4") if short_first < TABLE_OF_TABLES else np.zeros(0, "<u4")
        first, size = self._place(self._entries[0]) if self._entries else (LAST, 0)
        self._short = self._chained(first)[:size]
        self.streams = dict(self._listed())

    def _at(self, number: int) -> bytes:
        start = (number + 1) * self._sector
        if start >= len(self._data):
            raise ValueError("sector beyond the end")
        return self._data[start : start + self._sector].ljust(self._sector, b"\0")

    @staticmethod
    def _numbers(following: np.ndarray, first: int) -> list[int]:
        """The sectors of a chain; a chain cannot be longer than its table."""
        out = []
        while first < TABLE_OF_TABLES:
            if first >= len(following) or len(out) > len(following):
                raise ValueError("broken chain of sectors")
            out.append(first)
            first = int(following[first])
        return out

    def _chained(self, first: int) -> bytes:
        return b"".join(map(self._at, self._numbers(self._next, first)))

    def _place(self, entry: bytes) -> tuple[int, int]:
        """First sector and size; files of 512-byte sectors have sizes of 32 bits, and maybe rubbish above."""
        first, size = struct.unpack_from("<IQ", entry, 116)
        return first, size & 0xFFFFFFFF if self._sector == 512 else size

    def _listed(self) -> Iterator[tuple[tuple[str, ...], bytes]]:
        """(path, entry) of all streams, each storage in the order of its tree."""
        seen: set[int] = set()
        todo: list[tuple[int, tuple[str, ...], bool]] = []
        if self._entries:
            todo.append((struct.unpack_from("<I", self._entries[0], 76)[0], (), False))
        while todo:
            number, folder, visit = todo.pop()
            if number >= len(self._entries):
                continue
            entry = self._entries[number]
            left, right, child = struct.unpack_from("<III", entry, 68)
            if not visit:
                if number in seen:
                    raise ValueError("directory in a ring")
                seen.add(number)
                todo += [(right, folder, False), (number, folder, True), (left, folder, False)]
                continue
            path = (*folder, entry[: max(0, min(64, struct.unpack_from("<H", entry, 64)[0]) - 2)].decode("utf-16-le", "replace"))
            if entry[66] == STREAM:
                yield path, entry
            elif entry[66] == STORAGE:
                todo.append((child, path, False))

    def read(self, path: tuple[str, ...]) -> bytes:
        first, size = self._place(self.streams[path])
        if size >= self._cutoff:
            out = self._chained(first)[:size]
        else:
            out = b"".join(self._short[x * SHORT_SECTOR : (x + 1) * SHORT_SECTOR] for x in self._numbers(self._short_next, first))[:size]
        if len(out) < size:
            raise ValueError("stream cut short")
        return out


def native(stream: bytes, sized: bool) -> tuple[str, bytes] | None:
    """(file name, bytes) of an object's native stream, with or without its size in front; null for a link or another layout."""
    at = 6 if sized else 2
    names = []
    for skip in (0, 0, 8):  # the file's name, where it came from, and after eight bytes where it was put
        at += skip
        end = stream.find(b"\0", at)
        if end < 0:
            return None
        names.append(stream[at:end].decode("cp1252", "replace"))
        at = end + 1
    if at + 4 > len(stream):
        return None
    size = struct.unpack_from("<I", stream, at)[0]
    return names[0], stream[at + 4 : at + 4 + size]


def safe_name(name: str) -> str:
    """A file name without characters that file systems refuse."""
    return re.sub(r'[\\/:*?"<>|]+', "_", posixpath.basename(name.rstrip("/"))).strip() or "asset.bin"


def _split(name: str) -> tuple[str, str]:
    """Stem and last suffix; a name of a dot and letters alone, or ending in a dot, has no suffix."""
    stem, dot, last = name.rpartition(".")
    return (stem, dot + last) if stem.strip(".") and last else (name, "")


def free_name(name: str, taken, tried: dict[str, int] | None = None) -> str:
    """The name, or with _2, _3, ... before all its suffixes the first that is not taken.

    tried remembers how far a name was looked for, as long as what is taken only grows.
    """
    stem, suffixes = re.fullmatch(r"(\.*[^.]*)(.*)", name, re.S).groups()
    made = lambda n: name if n == 1 else f"{stem or 'asset'}_{n}{suffixes}"
    n = 1 if tried is None else tried.get(name, 1)
    while made(n) in taken:
        n += 1
    if tried is not None:
        tried[name] = n
    return made(n)


def with_suffix(name: str, suffix: str | None, fallback: str) -> str:
    """The safe name of a payload: a known suffix takes the place of none (after the fallback's stem) or of a vague one."""
    name = safe_name(name)
    stem, own = _split(name)
    if not suffix or (own and own.lower() not in VAGUE):
        return name
    return safe_name((stem if own else _split(posixpath.basename(fallback))[0]) + suffix)


def payload(content: bytes, fallback: str, sniff: Callable[[bytes], tuple[str | None, str | None]]) -> tuple[str, bytes, str | None] | None:
    """(name, bytes, content type) of the file in a container: of its native stream, else of CONTENTS; null without one.

    A container that cannot be read, a link and an empty file have none. sniff gives suffix and type by first bytes.
    """
    try:
        box = CompoundFile(content)
        own = next((p for p in box.streams if p[-1] == NATIVE), None)
        plain = next((p for p in box.streams if p[-1].upper() == CONTENTS), None)
        found = [(fallback, box.read(plain))] if own is None and plain is not None else []
        if own is not None:
            stream = box.read(own)
            # The flags (2) stand first, or after a size.
            sized = stream[4:6] == b"\2\0" or stream[:2] != b"\2\0"
            found = [x for x in (native(stream, sized),) if x and x[1]]
    except ValueError:
        return None
    if not found:
        return None
    name, body = found[0]
    suffix, kind = sniff(body)
    name = with_suffix(name or fallback, suffix, fallback)
    return name, body, kind or mimetypes.guess_type(name, strict=False)[0]


def payloads(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """files with payload_name, payload_type and payload (all null where a file carries no other); other columns stay.

    One row in, one row out; null contents carry nothing. Files are held one batch at a time.
    """
    from .ooxml import sniff

    def unwrap(names: pa.Array, contents: pa.Array) -> pa.Array:
        rows = []
        for label, body in zip(names.to_pylist(), contents):
            found = payload(body.as_py(), posixpath.basename(label or "") or "asset.bin", sniff) if body.is_valid else None
            rows.append(None if found is None else dict(zip(("payload_name", "payload", "payload_type"), found)))
        return pa.array(rows, pa.struct([("payload_name", pa.string()), ("payload", pa.binary()), ("payload_type", pa.string())]))

    read = F.arrow_udf(unwrap, "struct<payload_name: string, payload: binary, payload_type: string>")
    found = files.withColumn("__payload", read(F.col(name).cast("string"), F.col(content).cast("binary")))
    return found.select(*files.columns, "__payload.*")


def compound(streams: dict[tuple[str, ...], bytes], sector: int = 512) -> bytes:
    """A container of streams by path; folders of a path become storages."""
    # Entries in breadth order; the children of a storage hang to the right of each other.
    tree: dict[tuple[str, ...], list[tuple[str, ...]]] = {(): []}
    for path in streams:
        for k in range(len(path)):
            siblings = tree.setdefault(path[:k], [])
            if path[: k + 1] not in siblings:
                siblings.append(path[: k + 1])
    order = [()]
    for folder in order:
        order += sorted(tree.get(folder, ()), key=lambda p: (len(p[-1]), p[-1].upper()))
    number = {p: i for i, p in enumerate(order)}

    following: list[int] = []
    body: list[bytes] = []

    def put(data: bytes, mark: int | None = None) -> int:
        """Adds sectors; a chain, or sectors all marked alike. The first one's number."""
        first, n = len(following), -(-len(data) // sector)
        following.extend([mark] * n if mark is not None else [*range(first + 1, first + n), LAST] if n else [])
        body.append(data.ljust(n * sector, b"\0"))
        return first if n else LAST

    places, short, short_next = {}, bytearray(), []
    for path, data in streams.items():
        if len(data) >= SHORT:
            places[path] = put(data)
        else:
            n, first = -(-len(data) // SHORT_SECTOR), len(short_next)
            short += data.ljust(n * SHORT_SECTOR, b"\0")
            short_next += [*range(first + 1, first + n), LAST] if n else []
            places[path] = first if n else LAST
    short_first = put(bytes(short))
    entries = b""
    for path in order:
        kind = ROOT if not path else STREAM if path in streams else STORAGE
        children = sorted(tree.get(path, ()), key=number.get)
        siblings = sorted(tree.get(path[:-1], ()), key=number.get) if path else []
        after = siblings[siblings.index(path) + 1 :] if path else []
        label = (path[-1] if path else "Root Entry").encode("utf-16-le")
        start, size = (short_first, len(short)) if not path else (places.get(path, 0), len(streams.get(path, b"")))
        links = NOBODY, number[after[0]] if after else NOBODY, number[children[0]] if children and kind != STREAM else NOBODY
        entries += label.ljust(64, b"\0") + struct.pack("<HBB3I36xIQ", len(label) + 2, kind, 1, *links, start, size)
    directory = put(entries)
    short_table = put(struct.pack(f"<{len(short_next)}I", *short_next).ljust(-(-len(short_next) * 4 // sector) * sector, b"\xff"))
    # The tables describe their own sectors too, so that their number is found step by step.
    each = sector // 4
    tables = beyond = 0
    while True:
        need = -(-(len(following) + tables + beyond) // each)
        further = -(-max(0, need - IN_HEADER) // (each - 1))
        if (need, further) == (tables, beyond):
            break
        tables, beyond = need, further
    first = len(following)
    every = [*following, *[OWN_TABLE] * tables, *[TABLE_OF_TABLES] * beyond]
    body.append(struct.pack(f"<{len(every)}I", *every).ljust(tables * sector, b"\xff"))
    numbers = [*range(first, first + tables)]
    rest = numbers[IN_HEADER:]
    for k in range(beyond):
        mine = rest[k * (each - 1) : (k + 1) * (each - 1)]
        body.append(struct.pack(f"<{each}I", *mine, *[FREE] * (each - 1 - len(mine)), first + tables + k + 1 if k + 1 < beyond else LAST))
    head = numbers[:IN_HEADER] + [FREE] * (IN_HEADER - len(numbers[:IN_HEADER]))
    start = MAGIC + bytes(16) + struct.pack("<5H6xIIIIIIIIII", 0x3E, 3 if sector == 512 else 4, 0xFFFE, sector.bit_length() - 1, 6, 0, tables, directory, 0, SHORT, short_table, -(-len(short_next) * 4 // sector), first + tables if beyond else LAST, beyond, head[0])
    return (start + struct.pack(f"<{IN_HEADER - 1}I", *head[1:])).ljust(sector, b"\0") + b"".join(body)


def native_stream(name: str, body: bytes, sized: bool = True) -> bytes:
    """An embedded file as an object's native stream."""
    label = name.encode("cp1252") + b"\0"
    out = b"\2\0" + label + label + struct.pack("<II", 0x30000, len(label)) + label + struct.pack("<I", len(body)) + body
    return struct.pack("<I", len(out)) + out if sized else out
