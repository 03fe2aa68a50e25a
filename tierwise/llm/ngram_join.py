"""N-gram Jaccard join: the product of the document by n-gram incidence matrix with its transpose, in blocks.

Rows are the distinct shingle sets (equal sets are one class from the start), columns are shingles in one
global order, rare ones first. Two sets can only reach the threshold if they share a column among each
one's first columns; how many follows from their sizes. Those first entries say which cells of the product are
worth having, and are looked at in two turns:

1. In each column the entry with the smallest position, that is the row with the fewest rarer columns, is
   the centre; its cells with the others are asked for. These grow with the entries, not with their square.
2. Entries of different components that still meet in a column are paired in full. Copies of one text are
   one component by then, so this turn finds what the centres missed, and leaves no pair out.

Cells whose sizes and positions rule out the threshold are not asked for. The others are computed block by block:
the columns are dealt into ``SET_BLOCKS`` blocks, a task multiplies the part of a centre's row that lies in one block
with the parts of its partners there, and the partial overlap counts are summed over the blocks. A pair whose sum
stays below what the two sizes ask for is discarded; the others are links, and are joined to components. No more
than a block of a row is ever compared at once, and a centre of many partners is dealt over several tasks.

The order of columns comes from counts in a table of fixed size over all documents; any order gives the same
result, a good one gives fewer pairs.

Shingles are 64-bit hashes. The product compares the lowest 40 bits of them inside a block, which the highest bits
name: with 4 blocks two different shingles of a pair of sets count as equal if 42 bits are.
Null, empty and blank texts have no shingles and link with nothing; a text of fewer than k words is one
shingle. Repeated rows are one class. Null ids are kept and never become a component's name unless all
ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.storage import written
from . import text as tx

U = np.uint64
BLOCK_BITS = 14
BYTES_PER_SHINGLE = 5
SET_BLOCKS = 4


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of each text of a column."""
    for t in tx.slices(column):
        starts, ends, offset = t.words(tx.SPACE_WORDS)
        for i, s in enumerate(tx.shingles(t.hashes(starts, ends), offset, k)):
            yield t.first + i, s


def digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = int(tx.mix(s).sum(dtype=U)) + len(s)
    return int(tx.mix(np.array([total & (1 << 64) - 1], U)).astype(np.int64)[0])


class Bounds:
    """Bounds on sizes, positions and overlaps that follow from 100 * shared >= percent * united."""

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, n):
        """Smallest size, and smallest overlap, of a partner of a set of n."""
        return -(-self.percent * n // 100)

    def kept(self, n):
        """Entries of a set of n that have to be looked at."""
        return n - self.least(n) + 1

    def overlap(self, a, b):
        return -(-self.percent * (a + b) // (100 + self.percent))

    def possible(self, a, i, b, j):
        """Whether sets of a and b can still match if their first common column is at i and j."""
        need = self.overlap(a, b)
        return (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)) & (i <= a - need) & (j <= b - need)

    def possible_sql(self) -> str:
        need = f"ceil({self.percent} * (x.n + y.n) / {100 + self.percent}D)"
        return f"100 * least(x.n, y.n) >= {self.percent} * greatest(x.n, y.n) and x.pos <= x.n - {need} and y.pos <= y.n - {need}"


def _surveyed(docs: DataFrame, id_col: str, text_col: str, k: int, bits: int) -> DataFrame:
    """Rows of two kinds: (id, text hash, n, digest) of each document, and blocks of the table of shingle counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        table = np.zeros(1 << bits, np.uint32)
        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            n, name = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, s in sets_of(batch.column(1), k):
                n[i], name[i] = len(s), digest(s)
                np.add.at(table, (s >> U(64 - bits)).astype(np.int64), 1)
            nothing = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(name), nothing, pa.nulls(len(batch), pa.binary())], names=NAMES)
        if types is not None:
            step = 1 << min(BLOCK_BITS, bits)
            blocks = [table[b : b + step].tobytes() for b in range(0, len(table), step)]
            m = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, types), *[pa.nulls(m, pa.int64())] * 3, pa.array(np.arange(m, dtype=np.int32)), pa.array(blocks, pa.binary())], names=NAMES)

    NAMES = ["id", "hash", "n", "digest", "block", "counts"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    return rows.mapInArrow(tx.trimmed(run), f"id {kind}, hash long, n long, digest long, block int, counts binary")


def _counted(survey: DataFrame, bits: int) -> np.ndarray:
    """The table of shingle counts over all documents: 2**bits numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(counts, np.uint32).astype(np.uint64)
                total[block] = total[block] + own if block in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])

    rows = survey.filter("block is not null").select("block", "counts")
    salted = rows.repartition("block", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(tx.trimmed(add), "block int, counts binary")

    def finish(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(counts, np.uint64)
                total[block] = total[block] + own if block in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])

    found = salted.repartition("block").mapInArrow(tx.trimmed(finish), "block int, counts binary").collect()
    out = np.zeros(1 << bits, np.uint32)
    for r in found:
        own = np.frombuffer(r["counts"], np.uint32)
        out[r["block"] * len(own) : (r["block"] + 1) * len(own)] = own
    return out


def _products(docs: DataFrame, text_col: str, k: int, bits: int, counts, bounds: Bounds, blocks: int) -> DataFrame:
    """Turn 1 of every block: centre pairs (a, b), and the entries of columns with several rows."""

    def entries(batches: Iterator[pa.RecordBatch]):
        table = counts.value
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def out():
            column, name, n, pos, block = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(block, kind="stable")
            cut = np.searchsorted(block[order], np.arange(blocks + 1))
            parts = [[x[order][a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])] for x in (column, name, n, pos)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), *(pa.array(p, pa.binary()) for p in parts)], names=["block", "column", "name", "n", "pos"])

        for batch in batches:
            for _, s in sets_of(batch.column(0), k):
                if not len(s) or (name := digest(s)) in seen:
                    continue
                seen.add(name)
                heavy = table[(s >> U(64 - bits)).astype(np.int64)]
                m = bounds.kept(len(s))
                order = np.lexsort((s, heavy))[:m]
                column = s[order]
                # a column with very many entries is dealt over several blocks; turn 2 joins it again
                shard = (heavy[order] >> 20).astype(U)
                block = tx.mix(column + np.where(shard > 0, U(name & 0xFFFF) % (shard + U(1)), U(0))) % U(blocks)
                held.append((column, np.full(m, name, np.int64), np.full(m, len(s), np.int32), np.arange(m, dtype=np.int32), block.astype(np.int32)))
                size += m
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def multiply(batches: Iterator[pa.RecordBatch]):
        parts: list[list[bytes]] = [[], [], [], []]
        for batch in batches:
            for i in range(4):
                parts[i] += batch.column(i + 1).to_pylist()
        column, name, n, pos = (np.frombuffer(b"".join(p), t) for p, t in zip(parts, (U, np.int64, np.int32, np.int32)))
        if not len(column):
            return
        order = np.lexsort((name, n, pos, column))
        column, name, n, pos = column[order], name[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        fresh = np.ones(len(column), bool)
        fresh[1:] = (column[1:] != column[:-1]) | (name[1:] != name[:-1])  # equal sets met in several tasks
        heavy = counts.value[(column >> U(64 - bits)).astype(np.int64)] >> 20 > 0
        run_start = np.concatenate(([True], column[1:] != column[:-1]))
        column, name, n, pos, heavy = column[fresh], name[fresh], n[fresh], pos[fresh], heavy[fresh]
        run_start = np.concatenate(([True], column[1:] != column[:-1]))
        run = np.cumsum(run_start) - 1
        several = (np.bincount(run)[run] > 1) | heavy
        column, name, n, pos, run = column[several], name[several], n[several], pos[several], run[several]
        left, pairs = np.arange(len(column)), []
        while len(left):
            starts = np.concatenate(([True], run[left[1:]] != run[left[:-1]]))
            centre = left[np.maximum.accumulate(np.where(starts, np.arange(len(left)), 0))]
            near = 100 * np.minimum(n[centre], n[left]) >= bounds.percent * np.maximum(n[centre], n[left])
            ok = near & (centre != left) & bounds.possible(n[centre], pos[centre], n[left], pos[left])
            pairs.append(np.stack((name[centre[ok]], name[left[ok]]), 1))
            left = left[~near]
        pair = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
        for i in range(0, len(pair), 1 << 16):
            p = pair[i : i + (1 << 16)]
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1])), none, none, none], names=FOUND)
        for i in range(0, len(column), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(name[s]), pa.nulls(len(name[s]), pa.int64()), pa.array(column[s].view(np.int64)), pa.array(n[s]), pa.array(pos[s])], names=FOUND)

    FOUND = ["a", "b", "column", "n", "pos"]
    dealt = docs.select(F.col(text_col)).mapInArrow(tx.trimmed(entries), "block int, column binary, name binary, n binary, pos binary")
    return dealt.repartition(blocks, "block").mapInArrow(tx.trimmed(multiply), "a long, b long, column long, n long, pos long")


def _accumulated(docs: DataFrame, text_col: str, k: int, pairs: DataFrame, classes: DataFrame, bounds: Bounds, broadcast_rows: int, per_task: int = 4096) -> DataFrame:
    """Those of the pairs (centre, other) whose accumulated overlap reaches the threshold, as nodes (a, b).

    Only texts of classes in the pairs are cut into shingles again, and a set is sent once for each centre
    it is compared with. A centre of more than ``per_task`` pairs is sent to several tasks.
    """
    pairs = pairs.select("centre", "other")
    shards = pairs.groupBy("centre").agg(F.floor(F.count(F.lit(1)) / per_task).alias("top"))
    asked = (
        pairs.join(shards, "centre").select(F.col("other").alias("digest"), F.struct(F.col("centre"), F.pmod(F.col("other"), F.col("top") + 1).alias("shard"), F.lit(False).alias("leads")).alias("to"))
        .unionByName(shards.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top")))).select(F.col("centre").alias("digest"), F.struct("centre", "shard", F.lit(True).alias("leads")).alias("to")))
        .groupBy("digest").agg(F.collect_set("to").alias("to"))
    )
    wanted = written(asked.join(classes, "digest").select("hash", "digest", "first", "to"), "wanted")
    small = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    NAMES = ["centre", "shard", "block", "leads", "digest", "first", "n", "held"]
    kind = classes.schema["first"].dataType.simpleString()
    sizes = "a long, b long, a_first {0}, b_first {0}, shared long, a_n long, b_n long".format(kind)

    def packed(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        rows: list[tuple] = []
        held, types = 0, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=NAMES)

        for batch in batches:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), batch.schema.field(2).type, pa.int64(), pa.binary())
            asked, first, to = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for i, s in sets_of(batch.column(0), k):
                if asked[i] in seen or digest(s) != asked[i]:
                    continue
                seen.add(asked[i])
                cut = np.searchsorted(s, [U(b << 62) for b in range(SET_BLOCKS)])
                for block, part in enumerate(np.split(s, cut[1:])):
                    if not len(part) and block:  # the first block is always sent, so that each pair is met
                        continue
                    short = np.unique(part & U((1 << 40) - 1))
                    blob = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES_PER_SHINGLE].tobytes()
                    for x in to[i].as_py():
                        rows.append((x["centre"], x["shard"], block, x["leads"], asked[i], first[i], len(s), blob))
                        held += len(blob) + 64
                if held > 8 << 20:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    def full(blob: bytes) -> np.ndarray:
        out = np.zeros((len(blob) // BYTES_PER_SHINGLE, 8), np.uint8)
        out[:, :BYTES_PER_SHINGLE] = np.frombuffer(blob, np.uint8).reshape(-1, BYTES_PER_SHINGLE)
        return out.view("<u8").ravel()

    def multiply(batches: Iterator[pa.RecordBatch]):
        """Partial overlap counts of one block after another; a centre's own part comes first, if it has one in the block.

        Copies of a text that lay in several tasks send the same part again; it is counted once.
        """
        centre, own, last = None, None, None
        for batch in batches:
            found = []
            for c, shard, block, leads, name, first, m, blob in zip(*(batch.column(x).to_pylist() if x != "held" else batch.column(x) for x in NAMES)):
                if last == (last := (c, shard, block, leads, name)):
                    continue
                if leads:
                    centre, own, n, centre_first = (c, shard, block), full(blob.as_py()), m, first
                elif centre == (c, shard, block):
                    found.append((c, name, centre_first, first, len(np.intersect1d(own, full(blob.as_py()), assume_unique=True)), n, m))
                elif block == 0:
                    raise RuntimeError(f"the set {c} that others are to be compared with did not arrive")
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), batch.column("first").type, batch.column("first").type, *[pa.int64()] * 3))], names=["a", "b", "a_first", "b_first", "shared", "a_n", "b_n"])

    sets = rows.join(F.broadcast(wanted) if small else wanted, "hash").select("text", "digest", "first", "to")
    sets = sets.mapInArrow(tx.trimmed(packed), f"centre long, shard long, block int, leads boolean, digest long, first {kind}, n long, held binary")
    met = sets.repartition("centre", "shard", "block").sortWithinPartitions("centre", "shard", "block", F.desc("leads"), "digest")
    partial = met.mapInArrow(tx.trimmed(multiply), sizes).withColumnsRenamed({"a_first": "a1", "b_first": "b1"})
    total = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("a_n").alias("a_n"), F.max("b_n").alias("b_n"), F.max("a1").alias("a1"), F.max("b1").alias("b1"))
    links = total.filter(100 * F.col("shared") >= bounds.percent * (F.col("a_n") + F.col("b_n") - F.col("shared")))
    return links.select(_node("a1", "a").alias("a"), _node("b1", "b").alias("b"))


def _node(first: str, name: str):
    """A class as a node: ordered by its smallest id, classes without one last."""
    return F.struct(F.col(first).isNull().alias("none"), F.col(first).alias("first"), F.col(name).alias("name"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, table_bits: int = 20, blocks: int | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable through links, its own included).

    ``blocks`` is the number of column blocks, by default the session's shuffle partitions; a block has to
    fit a task. A list of classes is broadcast only if it has at most ``broadcast_rows`` rows.
    """
    spark = docs.sparkSession
    bounds = Bounds(percent)
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    survey = written(_surveyed(docs, id_col, text_col, k, table_bits), "survey")
    rows = survey.filter("block is null").select("id", "hash", "n", "digest")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("first"), F.min("hash").alias("hash"))
    counts = spark.sparkContext.broadcast(_counted(survey, table_bits))
    found = written(_products(docs, text_col, k, table_bits, counts, bounds, blocks), "products")

    pairs = found.filter("b is not null").select(F.col("a").alias("centre"), F.col("b").alias("other")).distinct()
    links = written(_accumulated(docs, text_col, k, pairs, classes, bounds, broadcast_rows), "links")
    part = written(connected_components(links, "a", "b").select(F.col("node.name").alias("node"), "component"), "parts")
    entry = found.filter("b is null").select(F.col("a").alias("name"), "column", "n", "pos")
    entry = entry.join(part.select("node", F.col("component.name").alias("part")), entry["name"] == part["node"], "left").select("name", "column", "n", "pos", F.coalesce("part", "name").alias("part"))
    mixed = entry.groupBy("column").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("column")
    entry = written(entry.join(mixed, "column"), "entries")
    x, y = entry.alias("x"), entry.alias("y")
    rest = x.join(y, F.expr(f"x.column = y.column and x.part < y.part and {bounds.possible_sql()}")).select(F.col("x.name").alias("centre"), F.col("y.name").alias("other")).distinct()
    more = written(_accumulated(docs, text_col, k, rest, classes, bounds, broadcast_rows), "links")
    # the first turn's components stand for its links
    known = part.join(more.select(F.explode(F.array("a.name", "b.name")).alias("node")).distinct(), "node", "left_semi")
    named = classes.select(F.col("digest").alias("node"), _node("first", "digest").alias("own"))
    known = known.join(named, "node").select(F.col("own").alias("a"), F.col("component").alias("b"))
    joined = connected_components(more.unionByName(known), "a", "b").withColumnsRenamed({"node": "old", "component": "new"})
    lone = joined.join(part.select("node"), F.col("old.name") == F.col("node"), "left_anti").select(F.col("old.name").alias("digest"), F.col("new.first").alias("component_id"))
    part = part.join(joined, part["component"] == joined["old"], "left").select(F.col("node").alias("digest"), F.coalesce("new.first", "component.first").alias("component_id"))
    named = part.unionByName(lone)
    rows = rows.join(classes.select("digest", F.col("first").alias("own")), "digest", "left").join(named, "digest", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "own")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id names their component, all columns unchanged; of rows with one id all stay."""
    lead = ngram_components(docs, id_col, text_col, **options).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__lead")).distinct()
    return docs.join(lead, docs[id_col].eqNullSafe(lead["__lead"]), "left_semi")
