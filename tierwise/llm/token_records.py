"""Token ids as length-delimited binary records, with a separate offset index for reads in any order.

A folder holds record files, an index beside each, and one manifest:

* **record**: length of the payload (8 bytes), masked CRC-32C of these 8 bytes (4), payload, masked CRC-32C of the
  payload (4); all little-endian. This is the framing of TFRecord files, so their readers can read the files.
* **payload**: width of an id in bytes (1), whether there is a key (1), the key (8), the ids.
* **index** (``.index``): 24 bytes a record: offset of the record, ids of the file's records before it, the key.
  Entry k lies at 24 k, so a record is found by its number with one small read.
* **manifest** (``MANIFEST.json``): files in order with their records, ids, bytes, and the CRC-32C of each index.

The files are written by the tasks of a Spark data source, each under a name of its own attempt; the manifest is
written last, by the driver, and names only what committed tasks wrote. So a lost executor or a repeated task leaves
at most files that nobody reads. Reads are dealt over tasks by record numbers; every checksum is compared.
"""

from __future__ import annotations

import functools
import json
import math
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegralType

from . import text as tx
from ..sources.storage import fresh_path
from .packing import word_encoder

MANIFEST, FORMAT = "MANIFEST.json", "token_records"
HEAD, PAYLOAD, ENTRY = struct.Struct("<QI"), struct.Struct("<BBq"), np.dtype([("offset", "<u8"), ("before", "<u8"), ("key", "<i8")])
BLOCK = 256
READ_BYTES, SPLIT_BYTES = 1 << 22, 1 << 26


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of CRC-32C: tables for eight bytes at once, and for a state moved past BLOCK zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)
    eight = [one]
    for _ in range(7):
        eight.append((eight[-1] >> 8) ^ one[eight[-1] & 0xFF])
    past = np.stack([np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)])
    for _ in range(BLOCK):
        past = (past >> 8) ^ one[past & 0xFF]
    return np.stack(eight[::-1]), past


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32C of spans of at least 4 bytes each, all spans and blocks side by side.

    A state of zero ignores zero bytes in front, so spans are filled up in front to whole blocks; the blocks' values
    are then joined span by span. The initial value is the same as its bits flipped in the first four bytes.
    """
    eight, past = _tables()
    size = (end - start).astype(np.int64)
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    flat = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    to = (first + blocks) * BLOCK - size
    for a, b, t in zip(start.tolist(), end.tolist(), to.tolist()):
        flat[t : t + b - a] = data[a:b]
    flat[(to[:, None] + np.arange(4)).ravel()] ^= 0xFF
    words = flat.view("<u4").reshape(-1, BLOCK // 4)
    state = np.zeros(len(words), np.uint32)
    for k in range(0, BLOCK // 4, 2):
        low, high = words[:, k] ^ state, words[:, k + 1]
        state = eight[0][low & 0xFF] ^ eight[1][low >> 8 & 0xFF] ^ eight[2][low >> 16 & 0xFF] ^ eight[3][low >> 24]
        state ^= eight[4][high & 0xFF] ^ eight[5][high >> 8 & 0xFF] ^ eight[6][high >> 16 & 0xFF] ^ eight[7][high >> 24]
    order = np.argsort(-blocks, kind="stable")
    many, begin, whole = blocks[order], first[order], np.zeros(len(size), np.uint32)
    for k in range(int(blocks.max(initial=0))):
        n = int(np.searchsorted(-many, -k, "left"))  # spans of more than k blocks
        s = whole[:n]
        whole[:n] = past[0][s & 0xFF] ^ past[1][s >> 8 & 0xFF] ^ past[2][s >> 16 & 0xFF] ^ past[3][s >> 24] ^ state[begin[:n] + k]
    out = np.empty(len(size), np.uint32)
    out[order] = ~whole
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum that can itself be checksummed: turned by 15 bits, plus a constant."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def framed(keys: list, ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some records, and where each begins."""
    size = np.array([PAYLOAD.size + len(x) * width for x in ids], np.int64)
    at = np.concatenate(([0], np.cumsum(size + HEAD.size + 4)))
    out = np.zeros(int(at[-1]), np.uint8)
    for key, x, a, n in zip(keys, ids, at.tolist(), size.tolist()):
        PAYLOAD.pack_into(out, a + HEAD.size, width, key is not None, key or 0)
        out[a + HEAD.size + PAYLOAD.size : a + HEAD.size + n] = x.astype(f"<u{width}").view(np.uint8)
        out[a : a + 8] = np.frombuffer(struct.pack("<Q", n), np.uint8)
    at, start = at[:-1], at[:-1] + HEAD.size
    for place, crc in ((at + 8, crc32c(out, at, at + 8)), (start + size, crc32c(out, start, start + size))):
        out[(place[:, None] + np.arange(4)).ravel()] = masked(crc).astype("<u4").view(np.uint8)
    return out, at


def parsed(data: np.ndarray, at: np.ndarray, what: str) -> tuple[list, list[np.ndarray]]:
    """(keys, ids) of the records at ``at``. Raises ValueError where a length or a checksum is wrong."""
    word = lambda p, n: data[(p[:, None] + np.arange(n)).ravel()].view(f"<u{n}")
    size = word(at, 8).astype(np.int64)
    start, most = at + HEAD.size, len(data) - at - HEAD.size - 4
    if (word(at + 8, 4) != masked(crc32c(data, at, at + 8))).any() or (size < PAYLOAD.size).any() or (size > most).any():
        raise ValueError(f"{what}: a record's length is damaged")
    if (word(start + size, 4) != masked(crc32c(data, start, start + size))).any():
        raise ValueError(f"{what}: a record's payload is damaged")
    keys, ids = [], []
    for a, n in zip(start.tolist(), size.tolist()):
        width, has, key = PAYLOAD.unpack_from(data, a)
        keys.append(key if has else None)
        ids.append(data[a + PAYLOAD.size : a + n].view(f"<u{width}"))
    return keys, ids


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder in it."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    records: int
    tokens: int
    bytes: int
    index_crc32c: int


class RecordWriter(DataSourceArrowWriter):
    """Rows (key long, ids binary: little-endian unsigned 32-bit), one file a task, in the order in which they come."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = opened(self.path)
        part = TaskContext.get().partitionId()
        name, entries, bytes_, tokens, records = f"part-{part:06d}-{uuid.uuid4().hex}.rec", [], 0, 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            records = records or files.open_output_stream(f"{folder}/{name}")
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                keys, ids = some.column(0).to_pylist(), [np.frombuffer(x, "<u4") for x in some.column(1).to_pylist()]
                data, at = framed(keys, ids, self.width)
                records.write(data.data)
                n = np.array([len(x) for x in ids], np.int64)
                entry = np.empty(len(ids), ENTRY)
                entry["offset"], entry["before"], entry["key"] = bytes_ + at, tokens + np.cumsum(n) - n, [k or 0 for k in keys]
                entries.append(entry)
                bytes_, tokens = bytes_ + len(data), tokens + int(n.sum())
        if records is None:
            return Written(part, "", 0, 0, 0, 0)
        records.close()
        index = np.concatenate(entries).view(np.uint8)
        with files.open_output_stream(f"{folder}/{name}.index") as out:
            out.write(index.data)
        return Written(part, name, sum(map(len, entries)), tokens, bytes_, int(crc32c(index, np.array([0]), np.array([len(index)]))[0]))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = opened(self.path)
        found = sorted((m for m in messages if m and m.records), key=lambda m: m.part)
        told = [{"file": m.name, "records": m.records, "tokens": m.tokens, "bytes": m.bytes, "index_crc32c": m.index_crc32c} for m in found]
        files.create_dir(folder)
        with files.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps({"width": self.width, "files": told}).encode())
        files.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = opened(self.path)
        for m in messages:
            for name in (m.name, f"{m.name}.index") if m and m.records else ():
                files.delete_file(f"{folder}/{name}")


@dataclass
class Records(InputPartition):
    """Places low..high of the order of reading, which is that of the files, or a shuffled one."""

    low: int
    high: int


class RecordReader(DataSourceReader):
    """(key, number, start, n_tokens, ids) of all records. With ``seed`` the places are dealt by a permutation of the
    record numbers that needs no memory: multiplication by a number that has no factor in common with the count."""

    def __init__(self, path: str, seed: int | None):
        self.path, self.seed = path, seed
        files, folder = opened(path)
        with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
            self.files = json.loads(f.read())["files"]
        self.first = [0, *accumulate(f["records"] for f in self.files)]
        self.before = [0, *accumulate(f["tokens"] for f in self.files)]

    def partitions(self) -> list[InputPartition]:
        total, tasks = self.first[-1], max(1, -(-sum(f["bytes"] for f in self.files) // SPLIT_BYTES))
        cuts = sorted({total * k // tasks for k in range(tasks + 1)} | (set() if self.seed is not None else set(self.first)))
        return [Records(a, b) for a, b in zip(cuts[:-1], cuts[1:])] or [Records(0, 0)]

    def _step(self) -> tuple[int, int]:
        total = max(self.first[-1], 1)
        rng = np.random.default_rng(self.seed)
        step, shift = int(rng.integers(total)) | 1, int(rng.integers(total))
        while math.gcd(step, total) > 1:
            step += 1
        return step, shift

    def _index(self, files: fs.FileSystem, folder: str, k: int, a: int, b: int) -> np.ndarray:
        with files.open_input_file(f"{folder}/{self.files[k]['file']}.index") as f:
            return np.frombuffer(f.read_at((b - a) * ENTRY.itemsize, a * ENTRY.itemsize), ENTRY)

    def _batch(self, numbers: list[int], before: np.ndarray, data: np.ndarray, at: np.ndarray, what: str) -> pa.RecordBatch:
        keys, ids = parsed(data, at, what)
        n = np.array([len(x) for x in ids], np.int64)
        arrays = [pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), pa.array(before.astype(np.int64)), pa.array(n), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "number", "start", "n_tokens", "ids"])

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        files, folder = opened(self.path)
        if self.seed is not None:
            yield from self._shuffled(files, folder, partition)
        elif partition.low < partition.high:
            k = bisect_right(self.first, partition.low) - 1
            a, b = partition.low - self.first[k], partition.high - self.first[k]
            index, told = self._index(files, folder, k, a, b), self.files[k]
            end = told["bytes"] if b == told["records"] else int(self._index(files, folder, k, b, b + 1)["offset"][0])
            offset = np.append(index["offset"].astype(np.int64), end)
            with files.open_input_file(f"{folder}/{told['file']}") as f:
                i = 0
                while i < b - a:
                    j = max(i + 1, int(np.searchsorted(offset, offset[i] + READ_BYTES, "right")) - 1)
                    data = np.frombuffer(f.read_at(int(offset[j] - offset[i]), int(offset[i])), np.uint8)
                    yield self._batch(list(range(partition.low + i, partition.low + j)), index["before"][i:j] + np.uint64(self.before[k]), data, offset[i:j] - offset[i], told["file"])
                    i = j

    def _shuffled(self, files: fs.FileSystem, folder: str, partition: Records) -> Iterator[pa.RecordBatch]:
        """Record after record at its offset, wherever the permutation leads."""
        (step, shift), total, handles = self._step(), self.first[-1], {}
        for place in range(partition.low, partition.high):
            number = (place * step + shift) % total
            k = bisect_right(self.first, number) - 1
            if k not in handles:
                if len(handles) == 64:
                    for h in handles.pop(next(iter(handles))):
                        h.close()
                handles[k] = tuple(files.open_input_file(f"{folder}/{self.files[k]['file']}{e}") for e in ("", ".index"))
            own = number - self.first[k]
            entry = np.frombuffer(handles[k][1].read_at(ENTRY.itemsize, own * ENTRY.itemsize), ENTRY)[0]
            offset = int(entry["offset"])
            size = HEAD.unpack(handles[k][0].read_at(HEAD.size, offset))[0]
            data = np.frombuffer(handles[k][0].read_at(min(size, self.files[k]["bytes"]) + HEAD.size + 4, offset), np.uint8)
            yield self._batch([number], np.array([int(entry["before"]) + self.before[k]]), data, np.array([0]), self.files[k]["file"])


class TokenRecords(DataSource):
    """Spark data source of such folders; options ``width`` (writing) and ``seed`` (reading in shuffled order)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key long, number long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        seed = self.options.get("seed")
        return RecordReader(self.options["path"], None if seed is None else int(seed))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        files, folder = opened(self.options["path"])
        if not overwrite and files.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{folder} holds token records already")
        files.create_dir(folder)
        return RecordWriter(self.options["path"], int(self.options.get("width", "4")))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Writes each text's ids and ``end_id`` to ``path`` in ascending order of integer ids, nulls first.

    Null and empty texts are the end id alone. Rows of equal ids are kept, in the order in which they are read. Ids that
    are no integers raise TypeError. Texts are dealt by ranges of (id, place in the input), so that an id that many rows
    have is dealt over several tasks. A text of any length is one record; its ids are held in memory by one task.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be an integer column")
    spark = docs.sparkSession
    spark.dataSource.register(TokenRecords)
    width = 2 if max(word_encoder(tokenizer_path).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = word_encoder(tokenizer_path)
        for t in tx.slices(batch.column(1)):
            ids = [np.append(x, np.uint32(end_id)).astype("<u4").tobytes() for x in own.encode(t)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), pa.array(ids, pa.binary())], names=["key", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc_nulls_first("key"), F.asc("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    tx.mapped(rows, encode, "key long, ids binary").write.format(FORMAT).option("width", width).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """(key, number, start, n_tokens, ids) of a folder: number and start count the records and ids before. ``seed`` gives a shuffled order."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format(FORMAT)
    return (reader if seed is None else reader.option("seed", seed)).load(path)


def token_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Per document, from files written and read back: id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, id_col, text_col, end_id)
    back = read_tokens(docs.sparkSession, path)
    return back.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
