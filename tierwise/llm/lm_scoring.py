"""LM scoring with a probabilistic suffix tree over words.

The alphabet is the words of the training texts and one end token. States are contexts of 1 to ``depth`` words; before
the first word of a text stands an end token. A context is a candidate if it occurs ``context_count`` times in the
training texts, and lists the next words that follow it ``entry_count`` times: absolute counts over all documents, so the
tree gets wider and deeper as the corpus grows. A candidate stays if the divergence of its next-word distribution from
that of its longest kept suffix, times its count, exceeds the cost of its list (half the list's length times the
logarithm of the count). Listed probabilities are counts less a discount; the rest of the mass follows the longest kept
suffix, down to the smoothed word frequencies. A token is scored in the longest kept suffix of what precedes it.

One code path serves every length. Runs of n words are counted only where the run without its last word may be a
candidate and the run without its first may be listed; bitmaps of a bit for each 32 bytes of text, at most
``2**filter_bits`` bits, tell, and what they let through by mistake is dropped by exact joins. Nothing else that grows with the
corpus is broadcast or collected, but for the names of blocks: texts are written in blocks of about ``block_bytes``, the tree
in buckets, which are ranges of keys. Blocks are scored in rounds, about ``rounds`` of them where there are enough blocks for
all cores: a block asks each bucket for the distinct words and runs that it holds, and a task that has the answers reads
and scores the block. A round's shuffle files go when it ends, and the tree's steps go when the tree is written, so the disk
holds the texts, the tree and one round.

Null texts are empty: one end token. Rows with a null id are training rows. Repeated rows count again in
training and get equal scores. Without training tokens all probabilities are those of the smoothing. Words and runs are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.storage import deleted, fresh_path, opened, run_folder, shuffles_dropped, written
from . import text as tx

U = np.uint64
END = U(0x0E4D0F7E87000001)
HOLD = 3_000_000
DISCOUNT = 0.75
PACKED = "bucket int, keys binary, counts binary, contexts binary"
FOUND = "bucket int, word boolean, keys binary, value binary, weight binary"
BUCKET_BYTES = 1 << 24  # bytes of text for each bucket of counts
PARTS = 3  # runs of two words, the most numerous, are counted in so many parts
LINE_BITS, MARKS = 9, 3  # a key sets so many bits of a line of 2**LINE_BITS bits in a bitmap


class Index:
    """Positions of 64-bit keys in a sorted array by a direct table, by search where two keys share a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(10, int(2 * len(keys)).bit_length())
        self.shift = U(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[(tx.mix(keys) >> self.shift).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self.slot[(tx.mix(keys) >> self.shift).astype(np.int64)].astype(np.int64)
        other = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        if len(other):
            k = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            at[other] = np.where(self.keys[k] == keys[other], k, -1)
        return at


def tokens(t: tx.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice with an end token after each text, and the n+1 offsets of the texts."""
    starts, ends, offset = t.words(tx.SPACE_WORDS)
    words = t.hashes(starts, ends)
    out = np.empty(len(words) + t.n, U)
    end = offset[1:] + np.arange(t.n)
    mask = np.ones(len(out), bool)
    mask[end] = False
    out[mask] = words
    out[end] = END
    return out, np.concatenate(([0], end + 1))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The ranges of 64-bit keys."""
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort: np.unique puts numbers into a hash table first, which takes many times as long."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def pack(x: np.ndarray) -> bytes:
    """Items of 8 bytes, first byte of all, second byte of all and so on: of sorted keys and of logarithms some compress well."""
    items = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
    out = np.empty((8, len(items)), np.uint8)
    for i in range(8):
        out[i] = items[:, i]
    return out.tobytes()


def unpack(x: bytes, kind: type = U) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of the columns of ``schema``."""
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[name for name, _ in fields])


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One column of ``rows`` for each value of their first line, in order, and the sums of its counts."""
    order = np.argsort(rows[0])
    rows, counts = rows[:, order], counts[order]
    cut = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))) if len(counts) else np.empty(0, np.int64)
    return rows[:, cut], np.add.reduceat(counts, cut) if len(cut) else counts


def counted(docs: DataFrame, rows_of: Callable[[np.ndarray, np.ndarray], np.ndarray], buckets: int, least: int = 1, parts: int = 1) -> DataFrame:
    """Written and packed (bucket, keys, counts of ``least`` and more, contexts) of what ``rows_of`` makes of the tokens of all training texts.

    Its first line are keys, the second, if any, those of the runs without their last token. A bucket is a range of keys, and so
    is each of the parts that are counted one after the other.
    """

    def count(batches: Iterator[pa.RecordBatch], part: int):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def out():
            rows, counts = summed(np.concatenate([r for r, _ in held], axis=1), np.concatenate([c for _, c in held]))
            cut = np.searchsorted(bucket_of(rows[0], buckets), np.arange(buckets + 1))
            return batch_of([(b, pack(rows[0, x:y]), counts[x:y].astype(np.uint32).tobytes(), rows[1:, x:y].tobytes()) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x], PACKED)

        for batch in batches:
            for t in tx.slices(batch.column(0)):
                rows = rows_of(*tokens(t))
                if parts > 1:
                    rows = rows[:, bucket_of(rows[0], parts) == part]
                held.append(summed(rows, np.ones(rows.shape[1], np.int64)))
                total += len(held[-1][1])
                if total > HOLD:
                    yield out()
                    held, total = [], 0
        if total:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]):
        got = [r for batch in batches for r in zip(*(x.to_pylist() for x in batch.columns))]
        for bucket in sorted({r[0] for r in got}):
            own = [r for r in got if r[0] == bucket]
            rows = np.concatenate([np.stack((unpack(k), np.frombuffer(x, U))) if x else unpack(k)[None] for _, k, _, x in own], axis=1)
            rows, counts = summed(rows, np.concatenate([np.frombuffer(c, np.uint32) for _, _, c, _ in own]).astype(np.int64))
            rows, counts = rows[:, counts >= least], counts[counts >= least]
            if len(counts):
                yield batch_of([(bucket, pack(rows[0]), counts.tobytes(), rows[1:].tobytes())], PACKED)

    path = fresh_path(docs.sparkSession, "counts")
    for part in range(parts):
        rows = docs.filter("not held_out").select("text").mapInArrow(tx.trimmed(functools.partial(count, part=part)), PACKED)
        rows.repartition(buckets, "bucket").mapInArrow(tx.trimmed(add), PACKED).write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(PACKED).parquet(path)


def runs(words: np.ndarray, offset: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place of each token in its text, and keys of the runs of 1 to ``most`` tokens that end there.

    An end token is put before each text, at place 0. A key of n tokens means nothing at places below n - 1. It is made of
    the keys of the run without its last and of the run without its first token, so that one of them gives the other.
    """
    n = len(offset) - 1
    start = offset[:-1] + np.arange(n)
    padded = np.full(len(words) + n, END)
    inner = np.ones(len(padded), bool)
    inner[start] = False
    padded[inner] = words
    place = np.arange(len(padded)) - np.repeat(start, np.diff(offset) + 1)
    keys = [tx.mix(padded + U(1))]
    for k in range(1, most):
        keys.append(tx.mix(earlier(keys[-1]) * tx.LANES[k] + keys[-1] + U(k + 1)))
    return place, keys


def without_first(keys: np.ndarray, contexts: np.ndarray, k: int) -> np.ndarray:
    """The keys of runs of k + 1 tokens without their first, from those without their last."""
    return tx.unmix(keys) - contexts * tx.LANES[k] - U(k + 1)


def earlier(keys: np.ndarray) -> np.ndarray:
    """The key of the run that ends one token before."""
    return np.concatenate((keys[:1], keys[:-1]))


def places(keys: np.ndarray, bits: int, mark: int) -> np.ndarray:
    """The bit of each key for one of ``MARKS``: leading bits choose a line, others the bit in it."""
    return ((keys >> U(64 - bits + LINE_BITS)) << U(LINE_BITS)) | ((keys >> U(LINE_BITS * mark)) & U((1 << LINE_BITS) - 1))


class Bits:
    """A set of keys by a few bits of each: it may hold a key by mistake and misses none."""

    def __init__(self, bits: int, parts: list[tuple[int, bytes]]):
        self.bits, self.byte = bits, np.zeros(1 << (bits - 3), np.uint8)
        for first, part in parts:
            self.byte[first : first + len(part)] |= np.frombuffer(part, np.uint8)

    def among(self, keys: np.ndarray) -> np.ndarray:
        """The positions of keys that may be in the set."""
        left = np.arange(len(keys))
        for mark in range(MARKS):
            at = places(keys[left], self.bits, mark)
            left = left[(self.byte[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) > 0]
        return left


def marked(table: DataFrame, bits: int, sets: int, sets_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> list[Bits]:
    """So many sets, of the keys that ``sets_of`` gives for rows of buckets. Buckets are ranges, so all parts of a set together are
    as long as its bitmap."""

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for which, keys in sets_of(batch):
            at = np.concatenate([places(keys, bits, m) for m in range(MARKS)]).astype(np.int64)
            if len(at):
                first = int(at.min()) >> 3
                flags = np.zeros(((int(at.max()) >> 3) - first + 1) * 8, np.uint8)
                flags[at - 8 * first] = 1
                out.append((which, first, np.packbits(flags, bitorder="little").tobytes()))
        return batch_of(out, "which int, first long, part binary")

    rows = tx.mapped(table, mark, "which int, first long, part binary").collect()
    return [Bits(bits, [(r["first"], bytes(r["part"])) for r in rows if r["which"] == w]) for w in range(sets)]


def unpacked(table: DataFrame, k: int) -> DataFrame:
    """Rows (g, n, c, s) of packed counts of runs of k + 1 tokens: c without their last, s without their first; null for words."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, g, n, c in zip(*(column.to_pylist() for column in batch.columns)):
            g, c = unpack(g), np.frombuffer(c, U)
            links = [c, without_first(g, c, k)] if k else []
            columns = [pa.array(x.view(np.int64)) for x in (g, np.frombuffer(n, np.int64), *links)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(g), pa.int64())] * (4 - len(columns))], names=["g", "n", "c", "s"])

    return tx.mapped(table, rows, "g long, n long, c long, s long")


def dealt(own: DataFrame, kind: str, block_bytes: int, blocks: int) -> str:
    """The folder to which ``own`` is written once, with a folder for each block of about ``block_bytes`` of text."""

    def deal(batches: Iterator[pa.RecordBatch]):
        base, done = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            after = done + np.cumsum(size + 1)
            if len(after):
                yield pa.RecordBatch.from_arrays([pa.array(base + (after - size - 1) // block_bytes), *batch.columns], names=["block", "id", "held_out", "text"])
                done = int(after[-1])

    path = fresh_path(own.sparkSession, "blocks")
    rows = own.coalesce(blocks).mapInArrow(tx.trimmed(deal), f"block long, id {kind}, held_out boolean, text string")
    rows.write.options(**{"compression": "zstd", "parquet.block.size": 1 << 24}).partitionBy("block").parquet(path)
    return path


def texts_of(path: str, block: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A block's rows."""
    return folder_rows(f"{path}/block={block}", columns)


def folder_rows(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a folder's Parquet files, from the shared folder; none where the folder is absent."""
    system, folder = opened(path)
    for info in sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet") and not info.base_name.startswith((".", "_")):
            with system.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(batch_size=1024, columns=columns, use_threads=False)


def asked(blocks: DataFrame, names: list[int], path: str, shared, depth: int, buckets: int) -> DataFrame:
    """(bucket, block, keys): the distinct words and runs of a block that the tree may tell of, for rows of positions in ``names``."""

    def ask(batches: Iterator[pa.RecordBatch]):
        known = shared.value
        for block in (names[i] for batch in batches for i in batch.column(0).to_pylist()):
            held, total = [], 0
            for batch in texts_of(path, block, ["text"]):
                for t in tx.slices(batch.column(0)):
                    place, keys = runs(*tokens(t), depth + 1)
                    for k, g in enumerate(keys):
                        g = g[place >= max(k, 1)]
                        held.append(distinct(g[known.among(g)] if k else g))
                        total += len(held[-1])
                if total > HOLD:
                    held, total = [distinct(np.concatenate(held))], 0
            keys = distinct(np.concatenate([np.empty(0, U), *held]))
            cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            own = [(b, block, pack(keys[x:y])) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
            for x in range(0, len(own), 256):
                yield batch_of(own[x : x + 256], "bucket int, block long, keys binary")

    return blocks.mapInArrow(tx.trimmed(ask), "bucket int, block long, keys binary")


def tree(counts: list[DataFrame], norm: float, context_count: int, entry_count: int) -> Iterator[DataFrame]:
    """Frames of (g, word, v, a), all words and runs in turn: ``v`` the log10 probability of the last word in its context, if that is a state, or
    of a word alone; ``a`` the log10 weight of the shorter context, if the run is a state itself. Keys are unique on one side of each
    join, and a partition of them is small, so they are hashed there and nothing is sorted."""
    below = unpacked(counts[0], 0).select("g", "n").withColumn("q", (F.col("n") + 0.1) / F.lit(norm)).withColumn("v", F.log10("q"))
    for k, packed in enumerate(counts[1:], 1):
        up = below.filter(F.col("n") >= entry_count).select(F.col("g").alias("s"), F.col("q").alias("up"))  # a run is no more frequent than its end
        context = below.filter(F.col("n") >= context_count).select(F.col("g").alias("c"), F.col("n").alias("size"))
        entries = unpacked(packed, k).join(up.hint("shuffle_hash"), "s").join(context.hint("shuffle_hash"), "c")
        step = fresh_path(packed.sparkSession, "entries")
        entries = written(entries.select("g", "c", "n", "size", "up", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.1)) / F.col("size")).alias("p")), "entries", path=step)
        state = entries.groupBy("c").agg(
            F.greatest(1 - F.sum("p"), F.lit(1e-9)).alias("rest"), F.greatest(1 - F.sum("up"), F.lit(1e-9)).alias("rest_up"),
            F.sum(F.col("p") * F.log(F.col("p") / F.col("up"))).alias("part"), F.count(F.lit(1)).alias("listed"), F.min("size").alias("size"),
        )
        gain = F.col("size") * (F.col("part") + F.col("rest") * F.log(F.col("rest") / F.col("rest_up")))
        state = state.filter(F.round(gain - 0.5 * F.col("listed") * F.log(F.greatest("size", F.lit(2))), 6) > 0)
        state = written(state.select("c", F.log10(F.col("rest") / F.col("rest_up")).alias("a")), "states")
        own = below.filter(F.col("n") >= context_count).join(state.withColumnRenamed("c", "g").hint("shuffle_hash"), "g", "left").unionByName(below.filter(F.col("n") < context_count), allowMissingColumns=True)
        yield own.select("g", F.lit(k == 1).alias("word"), "v", "a").filter("v is not null or a is not null")
        is_state = F.col("a").isNotNull()
        below = entries.join(state.hint("shuffle_hash"), "c", "left").select("g", "n", F.when(is_state, F.col("p")).otherwise(F.col("up")).alias("q"), F.when(is_state, F.log10("p")).alias("v"))
        below = written(below, "level")
        deleted(step)
    yield below.select("g", F.lit(False).alias("word"), "v", F.lit(None).cast("double").alias("a")).filter("v is not null")


def packed_tree(found: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``FOUND``: a bucket's words and its runs, with not a number where there is no value or weight."""

    def by_bucket(batches: Iterator[pa.RecordBatch]):
        got = [[column.to_numpy(zero_copy_only=False) for column in batch.columns] for batch in batches]
        if not got:
            return
        bucket, word, g, v, a = (np.concatenate(c) for c in zip(*got))
        kind = bucket.astype(np.int64) * 2 + word
        g = g.view(U)
        order = np.lexsort((g, kind))
        for own in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            yield batch_of([(int(bucket[own[0]]), bool(word[own[0]]), pack(g[own]), pack(v[own].astype(float)), pack(a[own].astype(float)))], FOUND)

    high = F.shiftrightunsigned("g", 32) * F.lit(buckets).cast("long")
    return found.select(F.shiftrightunsigned(high, 32).cast("int").alias("bucket"), "word", "g", "v", "a").repartition(buckets, "bucket").mapInArrow(tx.trimmed(by_bucket), FOUND)


ANSWERS = "block long, kind int, keys binary, value binary, is_state binary, weight binary"


def answered(asks: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows of ``ANSWERS``: what the tree at ``path`` tells of the keys that blocks ask its buckets for."""

    def answer(batches: Iterator[pa.RecordBatch]):
        bucket, index, value, weight = -1, None, None, None
        for batch in batches:
            out = []
            for b, block, asked_for in zip(*(column.to_pylist() for column in batch.columns)):
                if b != bucket:
                    rows = [r for part in folder_rows(f"{path}/bucket={b}", ["keys", "value", "weight"]) for r in zip(*(c.to_pylist() for c in part.columns))]
                    keys, value, weight = (np.concatenate([np.empty(0, t), *[unpack(r[i], t) for r in rows]]) for i, t in enumerate((U, float, float)))
                    order = np.argsort(keys)
                    bucket, index, value, weight = b, Index(keys[order]), value[order], weight[order]
                keys = unpack(asked_for)
                at = index.find(keys)
                keys, at = keys[at >= 0], at[at >= 0]
                is_state = ~np.isnan(weight[at])
                if len(at):
                    out.append((block, 0, pack(keys), pack(value[at]), np.packbits(is_state).tobytes(), weight[at][is_state].tobytes()))
            yield batch_of(out, ANSWERS)

    return asks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tx.trimmed(answer), ANSWERS)


class Answers:
    """What a block was told about its words and runs, by rows of ``ANSWERS``."""

    def __init__(self, rows: list[dict]):
        keys, value = (np.concatenate([np.empty(0, t), *[unpack(r[c], t) for r in rows]]) for c, t in (("keys", U), ("value", float)))
        weight = np.full(len(keys), np.nan)
        is_state = [np.unpackbits(np.frombuffer(r["is_state"], np.uint8), count=len(r["keys"]) // 8) for r in rows]
        weight[np.flatnonzero(np.concatenate(is_state)) if rows else []] = np.frombuffer(b"".join(r["weight"] for r in rows), float)
        order = np.argsort(keys)  # a key is in one bucket, so it is answered once
        self.index, self.value, self.weight = Index(keys[order]), np.append(value[order], np.nan), np.append(weight[order], np.nan)

    def logs(self, words: np.ndarray, offset: np.ndarray, depth: int, unseen: float, known_runs: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: if it is known, its log10 probability alone and in the longest state before it."""
        place, keys = runs(words, offset, depth + 1)
        at = [self.index.find(keys[0])]  # -1 is the last item, which is not a number
        for k in keys[1:]:
            some = known_runs.among(k)
            at.append(np.full(len(k), -1, np.int64))
            at[-1][some] = self.index.find(k[some])
        root = self.value[at[0]]
        known = ~np.isnan(root)
        root = np.where(known, root, unseen)
        out, open_ = np.zeros(len(place)), place > 0
        for k in range(depth, 0, -1):
            weight = self.weight[earlier(at[k - 1])]
            here = np.flatnonzero(open_ & (place >= k) & ~np.isnan(weight))
            value = self.value[at[k][here]]
            listed = ~np.isnan(value)
            out[here] += np.where(listed, value, weight[here])
            open_[here[listed]] = False
        out[open_] += root[open_]
        token = place > 0
        return known[token], root[token], out[token]


def lm_scoring(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, context_count: int = 32, entry_count: int = 4, filter_bits: int = 27, block_bytes: int = 1 << 25, buckets: int | None = None, rounds: int = 8
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. See the module for the method.

    ``context_count`` has to be at least ``entry_count``. ``filter_bits``, ``block_bytes``, ``buckets`` and ``rounds`` change no result.
    """
    if not 1 <= entry_count <= context_count or depth < 1 or rounds < 1:
        raise ValueError("1 <= entry_count <= context_count, depth >= 1 and rounds >= 1 are needed")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    path = fresh_path(spark, "scores")
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    own = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    with run_folder(spark), shuffles_dropped(spark):
        size = own.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
        buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        filter_bits = max(10, min(filter_bits, (size // 32).bit_length()))
        blocks = dealt(own, kind, block_bytes, max(1, size // block_bytes))
        texts = spark.read.schema("held_out boolean, text string, block long").parquet(blocks)
        found = fresh_path(spark, "found")
        with run_folder(spark):
            total, norm = grown(texts, found, depth, context_count, entry_count, filter_bits, buckets)

        def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            for word, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not word:
                    yield 0, unpack(keys)

        shared = spark.sparkContext.broadcast(marked(spark.read.schema("word boolean, keys binary").parquet(found), filter_bits, 1, runs_of)[0])
        names = sorted(r["block"] for r in texts.select("block").distinct().collect())
        rounds = max(1, min(rounds, len(names) // spark.sparkContext.defaultParallelism))
        for i in range(rounds):
            part = names[i::rounds]
            asks = asked(spark.range(0, len(part), 1, max(1, len(part))), part, blocks, shared, depth, buckets)
            ends = spark.createDataFrame([(b, 1, b"", b"", b"", b"") for b in part], ANSWERS)
            both = answered(asks, found, buckets).unionByName(ends).repartition(buckets, "block").sortWithinPartitions("block", "kind")
            scored(both, shared, blocks, schema, to_arrow_type(docs.schema[id_col].dataType), depth, total, norm).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).withColumnRenamed("id", id_col)


def grown(texts: DataFrame, path: str, depth: int, context_count: int, entry_count: int, filter_bits: int, buckets: int) -> tuple[int, float]:
    """The tree of the training texts is written to ``path`` by buckets; the number of training tokens, and what smoothed
    counts of words are divided by."""
    spark = texts.sparkSession

    def words(hashes: np.ndarray, offset: np.ndarray) -> np.ndarray:
        place, keys = runs(hashes, offset, 1)
        return keys[0][place > 0][None]

    counts = [counted(texts, words, buckets)]
    sums = tx.mapped(
        counts[0],
        lambda b: batch_of([(len(k.as_py()) // 8, int(np.frombuffer(c.as_py(), np.int64).sum())) for k, c in zip(b.column(1), b.column(2))], "n long, total long"),
        "n long, total long",
    ).agg(F.sum("n").alias("distinct"), F.sum("total").alias("total")).first()
    total, distinct = int(sums["total"] or 0), int(sums["distinct"] or 0)
    norm = total + 0.1 * (distinct + 1)

    def frequent(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for which, least in enumerate((context_count, entry_count)):
                yield which, unpack(k)[np.frombuffer(c, np.int64) >= least]

    for k in range(1, depth + 1):
        shared = spark.sparkContext.broadcast(marked(counts[-1], filter_bits, 2, frequent))

        def longer(hashes: np.ndarray, offset: np.ndarray, k: int = k, shared=shared) -> np.ndarray:
            may_be_context, may_be_listed = shared.value
            place, keys = runs(hashes, offset, k + 1)
            at = np.flatnonzero(place >= k)
            at = at[may_be_context.among(keys[k - 1][at - 1])]
            at = at[may_be_listed.among(keys[k - 1][at])]
            return np.stack((keys[k][at], keys[k - 1][at - 1]))

        counts.append(counted(texts, longer, buckets, entry_count, PARTS if k == 1 else 1))
    for found in tree(counts, norm, context_count, entry_count):
        packed_tree(found, buckets).write.options(compression="zstd").mode("append").partitionBy("bucket").parquet(path)
    return total, norm


def scored(answers: DataFrame, shared, path: str, schema: str, id_type: pa.DataType, depth: int, total: int, norm: float) -> DataFrame:
    """The scores of blocks, in whose order ``answers`` come, each block's row of kind 1 last."""
    unseen = float(np.log10(0.1 / norm))

    def score(batches: Iterator[pa.RecordBatch]):
        told: list[dict] = []
        for row in (row for batch in batches for row in batch.to_pylist()):
            if row["kind"] == 0:
                told.append(row)
                continue
            model, told = Answers(told), []
            for rows in texts_of(path, row["block"], ["id", "held_out", "text"]):
                for t in tx.slices(rows.column(2)):
                    hashes, offset = tokens(t)
                    known, root, logs = model.logs(hashes, offset, depth, unseen, shared.value)
                    sums = [np.add.reduceat(v, offset[:-1]) for v in (known.astype(np.int64), root, logs)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).slice(t.first, t.n).cast(id_type), rows.column(1).slice(t.first, t.n), pa.array(np.diff(offset).astype(np.int64)), pa.array(sums[0]), pa.array(np.full(t.n, total)), pa.array(sums[1]), pa.array(sums[2])],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    return answers.mapInArrow(tx.trimmed(score), schema)
