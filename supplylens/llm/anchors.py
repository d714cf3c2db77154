"""Winnowed anchors: which q-gram each window of a text stands on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from supplylens.llm import textarrays as T

_LOW = np.uint64(0xFFFFFF)


@dataclass
class Blocks:
    """Runs of neighbouring windows that stand on one anchor.

    ``anchor`` is the place of the q-gram, ``first`` and ``last`` the starts of the windows,
    ``row`` the row of the chunk.
    """
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray


def blocks(grams: np.ndarray, row: np.ndarray, q: int, k: int) -> Blocks:
    """Blocks of all windows of ``k`` symbols, given the hash of each ``q``-gram by its start.

    A window stands on the first of its q-grams with the least hash (upper 40 bits), which
    depends on nothing but the window's own symbols: equal windows stand on equal anchors at
    equal distances. ``row`` has the row of each symbol; windows lie within a row.
    """
    n = len(row) - k + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return Blocks(empty, empty, empty, empty)
    if len(grams) > int(_LOW):
        return _long_blocks(grams, row, q, k)
    order = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    least = T.sliding_min(order, k - q + 1)
    inside = np.flatnonzero(row[:n] == row[k - 1:])
    return _runs((least[inside] & _LOW).astype(np.int64), inside, row)


def _runs(anchor: np.ndarray, start: np.ndarray, row: np.ndarray) -> Blocks:
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
    return Blocks(anchor[first], start[first], start[last], row[start[first]])


def _long_blocks(grams: np.ndarray, row: np.ndarray, q: int, k: int) -> Blocks:
    """The same for a chunk with more symbols than 24 bits count: in overlapping pieces."""
    step, found = int(_LOW) - k, []
    for at in range(0, len(row) - k + 1, step):
        part = slice(at, min(at + step + k - 1, len(row)))
        piece = blocks(grams[at:at + step + k - q], row[part], q, k)
        found.append((piece.anchor + at, piece.first + at, piece.last + at, piece.row))
    anchor, first, last, rows = (np.concatenate(x) for x in zip(*found, strict=True))
    return Blocks(anchor, first, last, rows)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the spans."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n]) > 0


def own(hashes: np.ndarray, row: np.ndarray, sets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which hashes are in their row's set; ``sets`` has all sets in turn and their bounds."""
    values, bounds = sets
    if not len(values) or not len(hashes):
        return np.zeros(len(hashes), bool)
    salt = T.mix(np.arange(1, len(bounds), dtype=np.uint64))
    wanted = np.sort(values.view(np.uint64) ^ np.repeat(salt, np.diff(bounds)))
    sought = hashes ^ salt[row]
    at = np.searchsorted(wanted, sought)
    at[at == len(wanted)] = 0
    return wanted[at] == sought
