"""Vectorised text primitives for Arrow batches: words, span hashes, shingles.

Every helper works on a slice of a string column seen as one flat byte array, so no Python object is
made per word. Words are maximal runs of bytes that a 256-entry table admits; as all separators used
here are ASCII, byte runs and code point runs are the same thing in UTF-8.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_libc = ctypes.CDLL(None)
U = np.uint64
SLICE_BYTES = 1 << 20
#: Spans of so many bytes are hashed by BLAKE2 as well: long ones can be made so that their polynomials agree modulo 2**64.
LONG_SPAN = 256


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose low bits depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` makes ``x`` of."""
    x = (x ^ (x >> U(31)) ^ (x >> U(62))) * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> U(27)) ^ (x >> U(54))) * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U(30)) ^ (x >> U(60))


BYTES = _splitmix(256, 0x51ED)
_lower = np.arange(256)
_lower[0x41:0x5B] += 0x20
BYTES_LOWER = BYTES[_lower]
LANES = _splitmix(64, 0xA11CE) | U(1)

SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
#: Letters, digits and all non-ASCII bytes; to be used after lower-casing A-Z, so A-Z count as a-z.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_BASE, _powers = 0x2545F4914F6CDD1D, [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(max(n, SLICE_BYTES + 1), base, U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


class Texts:
    """Texts i..j of a column: ``data`` their bytes, ``start`` the n+1 byte offsets."""

    def __init__(self, data: np.ndarray, start: np.ndarray, first: int):
        self.data, self.start, self.first, self.n = data, start, first, len(start) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte within each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.start[1:]] - total[self.start[:-1]]

    def words(self, admit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the n+1 word offsets of the texts."""
        n = len(self.data)
        inside = admit[self.data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cut = self.start[:-1][self.start[:-1] < n]
            before[cut] = False
            after[cut[cut > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.start)

    def sums(self, table: np.ndarray = BYTES_LOWER) -> np.ndarray:
        """The prefix sums that ``hashes`` takes; for several calls over one text they can be made once."""
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum(table[self.data] * _tables(len(self.data) + 1)[0][: len(self.data)], out=total[1:])
        return total

    def grams(self, size: int, sums: np.ndarray) -> np.ndarray:
        """``hashes`` of all spans of ``size`` bytes (fewer than LONG_SPAN), by their ``sums``."""
        return mix((sums[size:] - sums[:-size]) * _tables(len(self.data) + 1)[1][: len(sums) - size])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES_LOWER, sums: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans: a polynomial over a random table, taken by prefix sums, with BLAKE2 for long spans."""
        _, inverse = _tables(len(self.data) + 1)
        total = self.sums(table) if sums is None else sums
        out = mix((total[ends] - total[starts]) * inverse[starts])
        for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
            out[i] ^= U(int.from_bytes(hashlib.blake2b(table[self.data[starts[i] : ends[i]]].tobytes(), digest_size=8).digest(), "little"))
        return out


def slices(column: pa.Array, target: int = SLICE_BYTES) -> Iterator[Texts]:
    """A string column (null: empty) cut into runs of texts of about ``target`` bytes; no text is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(start, start[i] + target, "right")) - 1)
        yield Texts(data[start[i] : start[j]], start[i : j + 1] - start[i], i)
        i = j


def windows(words: np.ndarray, offset: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and the index of each run's first word."""
    total = len(words)
    if total < k:
        return np.empty(0, U), np.empty(0, np.int64)
    out = words[: total - k + 1] * LANES[0]
    for j in range(1, k):
        out += words[j : total - k + 1 + j] * LANES[j]
    inside = np.zeros(total + 1, np.int32)
    length = np.diff(offset)
    long = length >= k
    np.add.at(inside, offset[:-1][long], 1)
    np.add.at(inside, offset[1:][long] - k + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:total]) > 0)
    return mix(out[at] + U(k)), at


def shingles(words: np.ndarray, offset: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a shorter text is one shingle, an empty one none."""
    hashed, at = windows(words, offset, k)
    cut = np.searchsorted(at, offset)
    out = []
    for i in range(len(offset) - 1):
        a, b = offset[i], offset[i + 1]
        if 0 < b - a < k:
            whole = (words[a:b] * LANES[: b - a]).sum(dtype=U) + U(b - a)
            out.append(mix(np.array([whole], U)))
        else:
            out.append(np.unique(hashed[cut[i] : cut[i + 1]]))
    return out


def repeats(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether its key occurs again in its group, and whether it occurred before."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    joint = mix(keys ^ mix(group.astype(U) + U(1)))
    order = np.argsort(joint, kind="stable")
    same = joint[order[1:]] == joint[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, before


def mapped(df, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str):
    """``df.mapInArrow`` for a function of one batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(trimmed(run), schema)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, and after its last batch the memory it no longer needs goes back to the system: Spark keeps Python workers
    for later stages, whose needs would otherwise come on top of it."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
