"""JSON envelopes, a few fields around one large array or object, read by many tasks.

A file that is one JSON value cannot be split by Spark's reader. Here a task per file walks over its bytes once, in pieces,
following only quotes and brackets with array operations, and notes ranges of whole entries of the wanted field. The
ranges are then dealt over all tasks, which read their bytes, and Spark parses each range as a JSON value of its own. So
memory is bounded by a range and its largest entry, and what is slow, the parsing, runs in parallel.

Field names and text may hold any character, escapes and brackets included. Files are UTF-8. A file without the field, or
with null or an empty value for it, has no parts. Text that ends early raises ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import opened

PIECE_BYTES, RANGE_BYTES = 1 << 22, 1 << 23
QUOTE, BACKSLASH = ord('"'), ord("\\")
_delta = np.zeros(256, np.int64)
_delta[[ord("{"), ord("[")]], _delta[[ord("}"), ord("]")]] = 1, -1


class Walk:
    """State of a walk over the bytes of one file."""

    def __init__(self, field: str, range_bytes: int):
        self.field, self.range_bytes = field, range_bytes
        self.at = self.depth = self.slashes = 0
        self.inside = self.wanted = False
        self.first, self.rest, self.ranges = 0, bytearray(), []

    def _named(self) -> bool:
        """Whether what has been read of the envelope ends in the wanted field's name."""
        text = bytes(self.rest).rstrip(b" \t\r\n")
        if not text.endswith(b":"):
            return False
        text = text[:-1].rstrip(b" \t\r\n")
        low = text.rfind(b'"', 0, len(text) - 1)
        while low > 0 and (low - len(text[:low].rstrip(b"\\"))) % 2:  # an escaped quote inside the name
            low = text.rfind(b'"', 0, low)
        return json.loads(text[low:]) == self.field

    def _depths(self, b: np.ndarray) -> np.ndarray:
        """The depth after each byte; brackets inside strings do not count."""
        i = np.arange(len(b))
        other = np.maximum.accumulate(np.where(b != BACKSLASH, i, -1 - self.slashes))
        run = np.empty(len(b), np.int64)  # backslashes in a row right before each byte
        run[0], run[1:] = self.slashes, i[:-1] - other[:-1]
        quotes = (b == QUOTE) & (run % 2 == 0)
        inside = (np.cumsum(quotes) + self.inside) % 2 == 1
        depth = self.depth + np.cumsum(np.where(inside, 0, _delta[b]))
        self.inside, self.depth, self.slashes = bool(inside[-1]), int(depth[-1]), int(len(b) - 1 - other[-1])
        return depth

    def feed(self, data: bytes) -> None:
        b, before = np.frombuffer(data, np.uint8), self.depth
        depth = self._depths(b)
        step = np.diff(depth, prepend=before)
        # the field opens where depth 2 is reached from 1 and closes where it falls back to 1
        edges = np.flatnonzero((step > 0) & (depth == 2) | (step < 0) & (depth == 1))
        ends = np.flatnonzero((step < 0) & (depth == 2)) + 1  # right behind an entry that is an object or array
        low = 0
        for e in [*edges.tolist(), len(b)]:
            if self.wanted:
                for end in ends[np.searchsorted(ends, low) : np.searchsorted(ends, e, "right")].tolist():
                    if self.at + end - self.first >= self.range_bytes:
                        self._close(self.at + end)
                if e < len(b):
                    self._close(self.at + e)
                    self.wanted = False
                    low = e
            else:
                self.rest += data[low : e + 1]
                low = e + 1
                if e < len(b) and step[e] > 0:
                    self.rest.pop()
                    self.wanted = self._named()
                    self.rest.append(b[e])
                    self.first = self.at + e + 1
        self.at += len(b)

    def _close(self, end: int) -> None:
        if end > self.first:
            self.ranges.append((self.first, end))
        self.first = end

    def envelope(self) -> str:
        """What is around the field, as JSON."""
        if self.depth or self.inside:
            raise ValueError("the JSON value ends early")
        text = self.rest.decode("utf-8-sig")
        json.loads(text or "null")
        return text


def walked(uri: str, field: str, range_bytes: int, piece_bytes: int = PIECE_BYTES) -> tuple[str, list[tuple[int, int]]]:
    system, path = opened(uri)
    walk = Walk(field, range_bytes)
    with system.open_input_stream(path) as f:
        while data := f.read(piece_bytes):
            walk.feed(data)
    return walk.envelope(), walk.ranges


def envelope_parts(spark: SparkSession, path: str, field: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, envelope, entries): ranges of ``field`` parsed by ``schema``, an array or a map, beside the rest of their file.

    ``envelope`` is the JSON text of the file with the field empty. Entries that do not fit the schema raise an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # the content is not read
    is_map = schema.lstrip().lower().startswith("map")
    pair = (b"{", b"}") if is_map else (b"[", b"]")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                envelope, ranges = walked(uri, field, range_bytes)
                if ranges:
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(ranges), pa.string()), pa.array([envelope] * len(ranges), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*ranges))], names=["file", "envelope", "low", "high"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, envelope, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = opened(uri)
                with system.open_input_file(path) as f:
                    text = f.read_at(high - low, low).lstrip(b", \t\r\n")
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (uri, envelope, pair[0] + text + pair[1])], names=["file", "envelope", "text"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranges = files.mapInArrow(walk, "file string, envelope string, low long, high long").repartition(tasks)
    parts = ranges.mapInArrow(read, "file string, envelope string, text string")
    return parts.select("file", "envelope", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("entries"))
