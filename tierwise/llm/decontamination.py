"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are runs of 13 words of a benchmark item (a shorter item is one pattern). The search reads a
text through a window as long as the shortest pattern of a set: the hash of the window's last two words
looks up a shift table; a positive shift skips positions where no pattern can end, a zero shift selects
a bucket of patterns by the same two words, and a direct comparison of all words, by their 64-bit hashes, confirms.
Many texts move through the table in step, so the work is vectorised.

A benchmark of more than ``part_words`` words is searched part by part, each part a pass over the documents; hit
intervals and items of all parts are united for each document before anything is counted, so parts change
nothing in the result. Of a part only texts with hits leave the tasks.

Null texts and texts without words have no hits; an item without words has no pattern; repeated items
keep their own ids; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from . import text as tx

U = np.uint64
SHIFT_BITS = 18
PIECE = 1024


class Patterns:
    """Patterns of one length with Wu-Manber's shift table and suffix buckets."""

    def __init__(self, rows: np.ndarray, owners: list[np.ndarray]):
        self.m = rows.shape[1]
        self.block = min(2, self.m)
        self.rows, self.owners = rows, owners
        top = self.m - self.block + 1
        self.shift = np.full(1 << SHIFT_BITS, top, np.int32)
        for end in range(self.block - 1, self.m):  # the block that ends here allows this shift
            np.minimum.at(self.shift, self._slot(self._block(rows, end)), self.m - 1 - end)
        suffix = self._block(rows, self.m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, first = np.unique(suffix[self.order], return_index=True)
        self.bucket = np.concatenate((first, [len(rows)]))

    def _block(self, words: np.ndarray, end) -> np.ndarray:
        out = words[..., end] * tx.LANES[0]
        if self.block == 2:
            out = out + words[..., end - 1] * tx.LANES[1]
        return tx.mix(out)

    @staticmethod
    def _slot(hashed: np.ndarray) -> np.ndarray:
        return (hashed >> U(64 - SHIFT_BITS)).astype(np.int64)

    def find(self, words: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern number of every occurrence inside the pieces [left, right) of words."""
        m, starts, which = self.m, [], []
        cur = left + m - 1
        live = np.flatnonzero(cur < right)
        cur, right = cur[live], right[live]
        while len(cur):
            hashed = self._block(words, cur)
            shift = self.shift[self._slot(hashed)]
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                at, key = cur[zero], hashed[zero]
                b = np.minimum(np.searchsorted(self.suffix, key), len(self.suffix) - 1)
                hit = self.suffix[b] == key
                at, b = at[hit], b[hit]
                size = self.bucket[b + 1] - self.bucket[b]
                each = np.repeat(np.arange(len(at)), size)
                inner = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                pattern, begin = self.order[self.bucket[b][each] + inner], at[each] - m + 1
                for j in range(m):
                    same = words[begin + j] == self.rows[pattern, j]
                    pattern, begin = pattern[same], begin[same]
                starts.append(begin)
                which.append(pattern)
            cur = cur + np.maximum(shift, 1)
            live = cur < right
            cur, right = cur[live], right[live]
        none = np.empty(0, np.int64)
        return (np.concatenate(starts), np.concatenate(which)) if starts else (none, none)


def compiled(items: list[tuple[object, str | None]], window: int = 13) -> list[Patterns]:
    """Pattern sets of the items, one for each length, longest first; equal patterns are one with several owners."""
    rows: dict[int, list[np.ndarray]] = defaultdict(list)
    owners: dict[int, list[np.ndarray]] = defaultdict(list)
    for t in tx.slices(pa.array([x[1] for x in items], pa.large_string())):
        starts, ends, offset = t.words(tx.ALNUM_WORDS)
        words = t.hashes(starts, ends)
        for i in range(t.n):
            own = words[offset[i] : offset[i + 1]]
            if m := min(window, len(own)):
                rows[m].append(np.lib.stride_tricks.sliding_window_view(own, m))
                owners[m].append(np.full(len(own) - m + 1, t.first + i))
    out = []
    for m in sorted(rows, reverse=True):
        pattern, which = np.concatenate(rows.pop(m)), np.concatenate(owners[m])
        order = np.lexsort((which, *pattern.T[::-1]))
        pattern, which = pattern[order], which[order]
        first = np.flatnonzero(np.concatenate(([True], (pattern[1:] != pattern[:-1]).any(1))))
        out.append(Patterns(np.ascontiguousarray(pattern[first]), [np.unique(x) for x in np.split(which, first[1:])]))
    return out


def intervals(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scanned(batch_text, ids: list, sets: list[Patterns]):
    """For each slice of a text column: the slice, word offsets, which words are hit, and the item ids of each text."""
    for t in tx.slices(batch_text):
        starts, ends, offset = t.words(tx.ALNUM_WORDS)
        words = t.hashes(starts, ends)
        n_words = np.diff(offset)
        hit = np.zeros(len(words) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for p in sets:
            # texts are searched in overlapping pieces, so that one long text does not run alone
            pieces = np.maximum(1, -(-(n_words - p.m + 1) // PIECE))
            owner = np.repeat(np.arange(t.n), pieces)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = offset[:-1][owner] + inner * PIECE
            right = np.minimum(left + PIECE + p.m - 1, offset[1:][owner])
            begin, which = p.find(words, left, right)
            np.add.at(hit, begin, 1)
            np.add.at(hit, begin + p.m, -1)
            owner = np.searchsorted(offset, begin, "right") - 1
            for o, k in set(zip(owner.tolist(), which.tolist())):
                items.setdefault(o, set()).update(ids[x] for x in p.owners[k].tolist())
        yield t, offset, np.cumsum(hit[: len(words)]) > 0, items


def per_text(hit: np.ndarray, offset: np.ndarray) -> np.ndarray:
    covered = np.concatenate(([0], np.cumsum(hit)))
    return covered[offset[1:]] - covered[offset[:-1]]


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, part_words: int) -> Iterator:
    """The compiled benchmark as broadcasts of (ids, pattern sets), one for about each ``part_words`` words."""
    text = F.coalesce(F.col(item_text_col), F.lit(""))
    size = benchmark.agg(F.sum(F.size(F.split(text, r"[^0-9A-Za-z\x80-\x{10FFFF}]+"))).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // part_words))
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    for k in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else rows
        items = [(r[0], r[1]) for r in own.collect()]
        yield parts, benchmark.sparkSession.sparkContext.broadcast(([str(x[0]) for x in items], compiled(items, window)))


def _united(docs: DataFrame, parts: Iterator) -> DataFrame:
    """(key, hash, hits, items): hit intervals and items over all parts of each text that has any, by id and text hash."""
    found = None
    for _, shared in parts:

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            names, sets = shared.value
            for batch in batches:
                keys, hashes, rows = batch.column(0), batch.column(1), []
                for t, offset, hit, items in scanned(batch.column(2), names, sets):
                    for i in items:
                        begin, end = intervals(hit[offset[i] : offset[i + 1]])
                        rows.append((keys[t.first + i].as_py(), hashes[t.first + i].as_py(), begin.tobytes() + end.tobytes(), sorted(items[i])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((keys.type, pa.int64(), pa.binary(), pa.list_(pa.string())))], names=["key", "hash", "hits", "items"])

        kind = docs.schema["key"].dataType.simpleString()
        one = written(docs.select("key", "hash", "text").mapInArrow(tx.trimmed(run), f"key {kind}, hash long, hits binary, items array<string>").distinct(), "hits")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("key", "hash").agg(F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _hit_words(lists: list[bytes]) -> int:
    """Words in the union of the intervals of all parts."""
    cut = [np.frombuffer(x, np.int64).reshape(2, -1) for x in lists]
    low, high = (np.concatenate([c[k] for c in cut]) for k in range(2))
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    before = np.concatenate(([0], np.maximum.accumulate(high)[:-1]))
    return int(np.maximum(high - np.maximum(low, before), 0).sum())


def _contaminated(n_words: np.ndarray, n_hit: np.ndarray, share: int) -> np.ndarray:
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, part_words: int = 500_000) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated. No shuffle if the benchmark is one part."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    parts = _parts(benchmark, item_col, item_text_col, window, part_words)
    many, first = next(parts)

    def judged(keys: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, found: list[list[str]]) -> pa.RecordBatch:
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in found], pa.int64()), pa.array(digests, pa.string()), pa.array(_contaminated(n_words, n_hit, share))],
            names=names,
        )

    if many == 1:

        def whole(batch: pa.RecordBatch):
            ids, sets = first.value
            for t, offset, hit, items in scanned(batch.column(1), ids, sets):
                yield judged(batch.column(0).slice(t.first, t.n), np.diff(offset), per_text(hit, offset), [sorted(items.get(i, ())) for i in range(t.n)])

        return tx.mapped(docs.select(F.col(id_col), F.col(text_col)), whole, schema)

    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    hits = _united(rows, chain([(many, first)], parts))

    def counted(batch: pa.RecordBatch):
        for t, offset, _, _ in scanned(batch.column(2), [], []):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), batch.column(1).slice(t.first, t.n), pa.array(np.diff(offset).astype(np.int64))], names=["key", "hash", "n"])

    def summed(batch: pa.RecordBatch):
        lists, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
        return judged(batch.column("key"), batch.column("n").to_numpy(), np.array([_hit_words(x) if x else 0 for x in lists], np.int64), [sorted(x or []) for x in items])

    sizes = tx.mapped(rows, counted, f"key {kind}, hash long, n long").alias("d")
    met = sizes.join(hits.alias("h"), F.expr("d.key <=> h.key and d.hash = h.hash"), "left").select("d.key", "d.n", "h.hits", "h.items")
    return tx.mapped(met, summed, schema)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, part_words: int = 500_000) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged. Rows are judged where they are read if the
    benchmark is one part."""
    parts = _parts(benchmark, item_col, item_text_col, window, part_words)
    many, first = next(parts)
    at = docs.columns.index(text_col)
    if many == 1:

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, sets = first.value
            keep = np.ones(len(batch), bool)
            for t, offset, hit, _ in scanned(batch.column(at), names, sets):
                keep[t.first : t.first + t.n] = ~_contaminated(np.diff(offset), per_text(hit, offset), share)
            return batch.filter(pa.array(keep))

        return tx.mapped(docs, of, docs.schema)

    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(hashed.alias("key"), hashed.alias("hash"), F.col(text_col).alias("text"))
    hits = _united(rows, chain([(many, first)], parts)).select("key", "hits")
    sizes = rows.select("key", "text").distinct().join(hits, "key")

    def bad(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, keep = batch.column(2).to_pylist(), np.zeros(len(batch), bool)
        for t, offset, _, _ in scanned(batch.column(1), [], []):
            n_hit = np.array([_hit_words(x) for x in lists[t.first : t.first + t.n]], np.int64)
            keep[t.first : t.first + t.n] = _contaminated(np.diff(offset), n_hit, share)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["bad"])

    gone = tx.mapped(sizes, bad, "bad long").distinct()
    return docs.join(gone, hashed == gone["bad"], "left_anti")
