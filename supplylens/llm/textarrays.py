"""Text columns of Arrow batches as numpy arrays: chunks, word bounds and span hashes.

Everything here works on UTF-8 bytes. A chunk is a run of whole rows with about
``limit`` bytes, so memory does not grow with the batch; one longer row is a chunk of
its own. Hashes are two polynomials modulo the prime 2**31 - 1 over symbols of their own,
finished by a mixing step: 62 bits that no pattern of repeated blocks cancels, as it can in a
polynomial modulo a power of two. Equal spans have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_140_671_485, 742_938_285)
CHUNK_BYTES = 512 << 10
SPACES = b" \t\n\v\f\r"


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same rest modulo the prime; twice from any product: below 2**31 + 2."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _rest(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    x[x >= _PRIME] -= _PRIME
    return x


def _power_array(base: int, n: int) -> np.ndarray:
    """The first powers of ``base`` modulo the prime."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, _rest(have * np.uint64(pow(base, len(have), int(_PRIME))))])
    _powers[base] = have
    return have[:n]


def _lanes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """31 bits of each symbol for either polynomial."""
    return symbols & _PRIME, symbols >> np.uint64(33)


_BYTE_LANES = _lanes(_BYTES)


class Rolling:
    """Hashes of any span of a sequence of 64-bit symbols in constant time."""

    def __init__(self, symbols: np.ndarray):
        self._set(_lanes(symbols))

    def _set(self, lanes: tuple[np.ndarray, np.ndarray]) -> None:
        n = len(lanes[0])
        self._sums, self._inverse = [], []
        for lane, base in zip(lanes, _BASES):
            lane *= _power_array(base, n)
            high = lane >> np.uint64(31)
            lane &= _PRIME
            lane += high  # below 2**32, so sums of as many do not pass 64 bits
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(lane, out=sums[1:])
            self._sums.append(sums)
            self._inverse.append(_power_array(pow(base, -1, int(_PRIME)), n + 1))

    def _hash(self, starts, ends) -> np.ndarray:
        first, second = (_rest(_fold(_fold(sums[ends] - sums[starts])) * inverse[starts]) for sums, inverse in zip(self._sums, self._inverse))
        return mix(first << np.uint64(31) | second)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._hash(starts, ends)

    def windows(self, length: int) -> np.ndarray:
        """The hash of each span of ``length`` symbols, by start."""
        n = len(self._sums[0]) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        return self._hash(slice(0, n), slice(length, None))


def of_bytes(data: np.ndarray) -> Rolling:
    out = Rolling.__new__(Rolling)
    out._set((_BYTE_LANES[0][data], _BYTE_LANES[1][data]))
    return out


#: an odd base and its inverse modulo 2**64
_ODD = 0x9E3779B97F4A7C15
_wrapping: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class ShortRolling:
    """Hashes of spans of bytes by one polynomial modulo 2**64: faster, and as good for spans of up to
    some hundred bytes. In longer ones two patterns can be built that cancel; do not decide by it there."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_wrapping[0]) < n:
            for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
                steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
                steps[0] = 1
                _wrapping[k] = np.cumprod(steps, dtype=np.uint64)
        self._inverse = _wrapping[1][:n]
        self._sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[data] * _wrapping[0][:n - 1], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])

    def windows(self, length: int) -> np.ndarray:
        n = len(self._sums) - length
        return self.spans(slice(0, n), slice(length, None)) if n > 0 else np.empty(0, np.uint64)


def separators(of: bytes) -> np.ndarray:
    """A table that is true for the bytes of words."""
    table = np.ones(256, bool)
    table[np.frombuffer(of, np.uint8)] = False
    return table


@dataclass
class Chunk:
    """Rows ``first`` to ``first + n`` of a batch: their bytes and bounds within ``data``."""
    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Word bounds in a chunk; the words of row r are ``first[r]`` to ``first[r + 1]``."""
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield Chunk(row, data[at[row]:at[stop]], at[row:stop + 1] - at[row])
        row = stop


def words(chunk: Chunk, letters: np.ndarray) -> Words:
    inside = letters[chunk.data]
    if not len(inside):
        empty = np.empty(0, np.int64)
        return Words(empty, empty, np.zeros(chunk.n + 1, np.int64))
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cuts = chunk.bounds[1:-1]
    before[cuts[cuts < len(inside)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.bounds))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by the first one's place."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def packed(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one after another with their bounds."""
    bounds = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=bounds[1:])
    return (np.concatenate(values) if values else np.empty(0, np.int64)), bounds


def binary_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of raw bytes: ``values`` cut at ``bounds`` (in items)."""
    values = np.ascontiguousarray(values)
    at = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])
