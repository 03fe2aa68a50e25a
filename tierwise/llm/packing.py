"""Packing: bounded-space online best-fit of tokenised documents into windows of fixed length.

Each partition keeps a fixed number of open windows. A document's remainder goes into the open window it
fills best; when it fits in none, the fullest window is filled to the brim with the first part of it and
emitted, and the rest is placed again. Full windows of a long document are emitted at once. What stays
open at the end of the partitions is merged by the same rule in a second, small stage, whose last window
is cut into power-of-two sequences, so that nothing is padded.

Null and empty texts are one end token. Rows are packed one by one: repeated rows are packed again, null
ids are kept. A text of any length is one document; its tokens are held in memory by one task.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from ..sources.storage import written

_encoders: dict[object, Encoder] = {}
_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_alnum = np.zeros(256, bool)
_alnum[0x30:0x3A] = _alnum[0x41:0x5B] = _alnum[0x61:0x7B] = True
_mark = np.zeros(256, bool)
_mark[0x21:0x7F] = True
_mark &= ~_alnum
_mark[ord("'")] = False
_wide_white = np.zeros(256, bool)  # first bytes of the white space characters beyond ASCII
_wide_white[[0xC2, 0xE1, 0xE2, 0xE3]] = True
SLOTS = 1 << 21


class Encoder:
    """A byte-level BPE of the tokenizers library behind a table of the chunks it has met.

    Texts are cut where a pre-token always ends: before a lone space between two non-spaces, before an
    ASCII mark that follows a letter or digit, and after a lone line end. Chunks are found by hash, so a text
    costs a few array operations; only new chunks are encoded. The table is emptied at ``limit`` chunks or four times
    as many ids.
    """

    table = tx.BYTES

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(SLOTS, -1, np.int32)
        self.rest: dict[int, int] = {}
        self.keys, self.start, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.known, self.used = np.zeros(1 << 18, np.uint16), 0, 0

    def _grown(self, array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate((array, np.zeros(max(len(array), size - len(array)), array.dtype)))

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        k, n = self.known, len(found)
        self.keys, self.start, self.size = (self._grown(x, k + n) for x in (self.keys, self.start, self.size))
        if flat.max(initial=0) > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        self.ids = self._grown(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.keys[k : k + n], self.size[k : k + n] = hashes, size
        self.start[k : k + n] = self.used + np.cumsum(size) - size
        self.known, self.used = k + n, self.used + len(flat)
        place = (hashes % np.uint64(SLOTS)).astype(np.int64)
        number = np.arange(k, k + n, dtype=np.int32)
        first = np.unique(place, return_index=True)[1]
        first = first[self.slot[place[first]] < 0]
        self.slot[place[first]] = number[first]
        late = np.ones(n, bool)
        late[first] = False
        self.rest.update(zip(hashes[late].tolist(), number[late].tolist()))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Chunk numbers, -1 for unknown ones."""
        at = self.slot[(hashes % np.uint64(SLOTS)).astype(np.int64)]
        other = np.flatnonzero((at >= 0) & (self.keys[np.maximum(at, 0)] != hashes))
        at[other] = [self.rest.get(h, -1) for h in hashes[other].tolist()]
        return at

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def cuts(t: tx.Texts) -> np.ndarray:
        """Byte offsets at which the texts of a slice can be cut, their own starts included."""
        data = np.concatenate((np.zeros(3, np.uint8), t.data, np.zeros(1, np.uint8)))
        here, after, before, two, three = data[3:-1], data[4:], data[2:-2], data[1:-3], data[:-4]
        wide_before = (before >= 0x80) & (((two == 0xC2) & ((before == 0x85) | (before == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & (two <= 0x9A)))
        space = (here == 0x20) & ~_white[before] & ~wide_before & ~_white[after] & ~_wide_white[after]
        latin = (two == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        mark = _mark[here] & (_alnum[before] | latin)
        line = (before == 0x0A) & (two > 0x20) & (two < 0x7F) & ~_white[here] & ~_wide_white[here]
        cut = space | mark | line
        inner = np.flatnonzero(cut)
        starts = t.start[:-1]
        edge = np.zeros(len(here) + 1, bool)
        edge[t.start] = True
        last = np.flatnonzero(edge[1:])  # a cut at a text's last byte saw the next text's first one
        inner = inner[~edge[inner] & ~(np.isin(inner, last) & (here[inner] == 0x20))]
        return np.sort(np.concatenate((inner, np.unique(starts[np.diff(t.start) > 0]))))

    def spans(self, t: tx.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks of a slice."""
        cut = self.cuts(t)
        return cut, np.append(cut[1:], len(t.data))

    def encode(self, t: tx.Texts) -> list[np.ndarray]:
        """The ids of each text of a slice."""
        if self.known > self.limit or self.used > 4 * self.limit:
            self.clear()
        cut, ends = self.spans(t)
        hashes = t.hashes(cut, ends, self.table)
        at = self._find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            own, first = np.unique(hashes[new], return_index=True)
            raw = t.data.tobytes()
            self._learn(own, [raw[cut[i] : ends[i]].decode() for i in new[first]])
            at[new] = self._find(hashes[new])
        n = self.size[at].astype(np.int64)
        index = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ids = self.ids[index].astype(np.uint32)
        total = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(cut, t.start)]
        out = [ids[a:b] for a, b in zip(total[:-1], total[1:])]
        special = np.flatnonzero((t.data[:-1] == 0x3C) & (t.data[1:] == 0x7C))
        for i in np.unique(np.searchsorted(t.start, special, "right") - 1).tolist():
            out[i] = self.whole(t.data[t.start[i] : t.start[i + 1]].tobytes().decode())
        return out


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Fixed value: a pre-tokenizer's pattern that takes letters, digits and marks apart, but for contractions.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder(Encoder):
    """The same for a tokenizer that drops white space: chunks are the words between it.

    Words are also cut between ASCII letters or digits and marks other than the apostrophe where the pre-tokenizer does, and
    are told without regard to ASCII case where the normalizer lowers it. Texts with special-token strings are encoded whole,
    as are all where the pre-tokenizer is not of that kind.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        super().__init__(path, limit)
        shape = json.loads(self.tokenizer.to_str())
        normal = [n for n in [shape["normalizer"]] if n for n in n.get("normalizers", [n])]
        steps = [p for p in [shape["pre_tokenizer"]] if p for p in p.get("pretokenizers", [p])]
        self.drops_space = self._drops_space(shape, steps)
        self.cuts_marks = self.drops_space and steps[0]["pattern"] == {"Regex": APART} and all(n["type"] in ("NFC", "Lowercase", "Replace") for n in normal)
        self.table = tx.BYTES_LOWER if any(n["type"] == "Lowercase" for n in normal) else tx.BYTES

    def _drops_space(self, shape: dict, steps: list[dict]) -> bool:
        """Whether no token reaches over white space: an inverted split that is removed and whose pattern matches none."""
        split = bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        special = all(s["content"].startswith("<|") for s in shape["added_tokens"])
        pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a b\tc\nd\ve\ff\rg")] if split else []
        return split and special and "".join(pieces) == "abcdefg" and shape["post_processor"] is None

    def spans(self, t: tx.Texts) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, _ = t.words(tx.SPACE_WORDS)
        if not self.cuts_marks or not len(t.data):
            return starts, ends
        cut = np.zeros(len(t.data), bool)
        cut[1:] = _mark[t.data[1:]] & _alnum[t.data[:-1]] | _alnum[t.data[1:]] & _mark[t.data[:-1]]
        cut[t.start[:-1][t.start[:-1] < len(cut)]] = False
        cut = np.flatnonzero(cut)
        return np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))

    def encode(self, t: tx.Texts) -> list[np.ndarray]:
        if self.drops_space:
            return super().encode(t)
        return [self.whole(t.data[a:b].tobytes().decode()) for a, b in zip(t.start[:-1], t.start[1:])]


def word_encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    if (path, "words") not in _encoders:
        _encoders[path, "words"] = WordEncoder(path)
    return _encoders[path, "words"]


class Packer:
    """Open windows of one task. A piece is (id, start, ids, doc_tokens)."""

    def __init__(self, length: int, keep: int, first: int):
        self.length, self.keep, self.next = length, keep, first
        self.open: list[list] = []  # [used, pieces]
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for key, start, ids, total in pieces:
            self.done.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, None))
            at += len(ids)
        self.next += 1

    def add(self, key, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self._close([(key, start, ids[: self.length], total)])
            ids, start = ids[self.length :], start + self.length
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.length]
            if fits:
                window = max(fits, key=lambda w: w[0])
                take = len(ids)
            elif len(self.open) < self.keep:
                window, take = [0, []], len(ids)
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                take = self.length - window[0]
            window[1].append((key, start, ids[:take], total))
            window[0] += take
            ids, start = ids[take:], start + take
            if window[0] == self.length:
                self._close(window[1])
                self.open = [w for w in self.open if w is not window]

    def left(self) -> list[tuple]:
        """The pieces of the windows still open, with their ids, for the merging stage."""
        return [(k, s, len(i), 0, n, w, 0, i.astype("<u4").tobytes()) for w, (_, pieces) in enumerate(self.open) for k, s, i, n in pieces]

    def finish(self) -> None:
        """Ends all windows: joined, cut to full ones, the last one to powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        room = sum(len(p[2]) for p in rest)
        size = self.length if room >= self.length else 1 << max(room, 1).bit_length() - 1
        now: list = []
        used = 0
        for key, start, ids, total in rest:
            while len(ids):
                take = min(len(ids), size - used)
                now.append((key, start, ids[:take], total))
                ids, start, used = ids[take:], start + take, used + take
                if used == size:
                    self._close(now)
                    room -= used
                    now, used = [], 0
                    size = self.length if room >= self.length else 1 << max(room, 1).bit_length() - 1


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def packing(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, open_windows: int = 16, merge_windows: int = 4096) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The first stage's rows are written to the shared folder, so that a document is tokenised once and a
    sequence number is never given twice. A merging task takes ``merge_windows`` windows at most.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {COLUMNS}"

    def out(rows: list, types) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[id_col, *(x.split()[0] for x in COLUMNS.split(", "))])

    def pack(batches: Iterator[pa.RecordBatch]):
        own = encoder(tokenizer_path)
        packer = Packer(length, open_windows, (TaskContext.get().partitionId() + 1) << 32)
        types = None
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.binary()]
            for t in tx.slices(batch.column(1)):
                keys = batch.column(0).slice(t.first, t.n).to_pylist()
                for key, ids in zip(keys, own.encode(t)):
                    ids = np.append(ids, np.uint32(end_id))
                    packer.add(key, 0, ids, len(ids))
                if len(packer.done) > 20_000:
                    yield out(packer.done, types)
                    packer.done = []
        if packer.done:
            yield out(packer.done, types)
        if rows := packer.left():
            yield out(rows, types)

    def merge(batches: Iterator[pa.RecordBatch]):
        packer = Packer(length, open_windows, (1 << 62) + (TaskContext.get().partitionId() << 32))
        types = None
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.binary()]
            for key, start, total, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 7))):
                packer.add(key, start, np.frombuffer(ids, "<u4"), total)
        packer.finish()
        if packer.done:
            yield out(packer.done, types)

    first = written(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tx.trimmed(pack), schema), "packing")
    left = first.filter("ids is not null")
    size = left.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, -(-size // (merge_windows * length)))
    rest = left.repartition(tasks).mapInArrow(tx.trimmed(merge), schema)
    return first.filter("ids is null").unionByName(rest).drop("ids")
