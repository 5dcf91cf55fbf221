"""Tables drawn with ASCII lines from the owner of each position."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import numpy as np


def owners(boxes: Iterable[tuple[int, int, int, int]], n_rows: int, n_cols: int) -> np.ndarray:
    """The number of the box that stands at each position: boxes are (row, col, rowspan, colspan) from 0, later ones in front.

    What sticks out is cut, a box without a position owns none, and each position left over is a box of its own (-1, -2, ...).
    """
    own = -1 - np.arange(n_rows * n_cols).reshape(n_rows, n_cols)
    for k, (row, col, down, across) in enumerate(boxes):
        own[row : row + down, col : col + across] = k
    return own


def _edges(own: np.ndarray, axis: int) -> np.ndarray:
    """Where an owner ends, before each position of an axis and after the last."""
    ends = [(0, 0), (0, 0)]
    ends[axis] = (1, 1)
    return np.pad(np.diff(own, axis=axis) != 0, ends, constant_values=True)


@dataclass(frozen=True)
class Layout:
    """A table without its texts, for all tables of the same boxes.

    places: (number, row, col, columns) of each box in reading order; edges: by line between rows, the corner before each column and at the end,
    and what lies between them; segments: by row, (col, columns) of what stands between two bars.
    """

    n_cols: int
    places: list[tuple[int, int, int, int]]
    edges: list[tuple[list[str], list[str]]]
    segments: list[list[tuple[int, int]]]


def layout(own: np.ndarray, through: bool = False) -> Layout:
    """The layout of the owners. No line runs through a box, or with `through` those between rows run through all."""
    n_rows, n_cols = own.shape
    if not own.size:
        return Layout(0, [], [], [])
    beside, above = _edges(own, 1), _edges(own, 0) | through
    numbers, first = np.unique(own, return_index=True)
    starts = sorted((*divmod(int(at), n_cols), int(k)) for k, at in zip(numbers, first))
    places = [(k, row, col, 1 + int(np.argmax(beside[row, col + 1 :]))) for row, col, k in starts]
    # A bar beside a row ends in a corner on the line above it and on the one below; elsewhere lines run on.
    barred, lined = np.zeros((n_rows + 1, n_cols + 1), bool), np.zeros((n_rows + 1, n_cols + 1), bool)
    barred[:-1], lined[:, :-1] = beside, above
    barred[1:] |= beside
    lined[:, 1:] |= above
    corners = np.where(barred, "+", np.where(lined, "-", " ")).tolist()
    between = np.where(above, "-", " ").tolist()
    segments = []
    for row in beside:
        at = np.flatnonzero(row).tolist()
        segments.append([(a, b - a) for a, b in zip(at, at[1:])])
    return Layout(n_cols, places, list(zip(corners, between)), segments)


def fill(table: Layout, shown: Mapping[int, list[str]]) -> str:
    """The table with the lines of text of each box at its first position in reading order.

    A column is as wide as its texts need: each box in turn spreads what it lacks over its columns, the leftmost getting
    the rest. A row is as high as the texts that begin in it.
    """
    if not table.n_cols:
        return ""
    width, height, begun = [1] * table.n_cols, [1] * len(table.segments), {}
    for k, row, col, span in table.places:
        lines = shown.get(k) or [""]
        lack = max(map(len, lines)) - sum(width[col : col + span]) - 3 * (span - 1)
        if lack > 0:
            each, rest = divmod(lack, span)
            for j in range(span):
                width[col + j] += each + (j < rest)
        height[row] = max(height[row], len(lines))
        begun[row, col] = lines
    line = lambda i: "".join([c + m * (w + 2) for c, m, w in zip(*table.edges[i], width)]) + table.edges[i][0][-1]
    out = []
    for row, segments in enumerate(table.segments):
        out.append(line(row))
        parts = [(begun.get((row, col), ()), sum(width[col : col + span]) + 3 * (span - 1)) for col, span in segments]
        for n in range(height[row]):
            out.append("".join(["| " + (lines[n] if n < len(lines) else "").ljust(inner) + " " for lines, inner in parts]) + "|")
    out.append(line(len(table.segments)))
    return "\n".join(out)


def draw(own: np.ndarray, shown: Mapping[int, list[str]], through: bool = False) -> str:
    """The table of the owners with the texts of their boxes."""
    return fill(layout(own, through), shown)


@functools.lru_cache(maxsize=1024)
def _known(boxes: tuple, n_rows: int, n_cols: int, through: bool) -> Layout:
    return layout(owners(boxes, n_rows, n_cols), through)


def draw_boxes(boxes: tuple[tuple[int, int, int, int], ...], n_rows: int, n_cols: int, shown: Mapping[int, list[str]], through: bool = False) -> str:
    """draw() of boxes as in owners(); the layouts of small tables are kept, as many tables have the same."""
    made = _known if n_rows * n_cols <= 64 and len(boxes) <= 64 else _known.__wrapped__
    return fill(made(boxes, n_rows, n_cols, through), shown)
