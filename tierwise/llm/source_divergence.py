"""Source divergence audit: how the words of each source of a language differ from every other source's, exactly.

A language keeps the terms that are in at least ``min_docs`` of its documents. With c a term's count in a group (language,
source) and N the group's count of kept terms, p = 1 + floor(10**9 (c + 5) / (N + 5 V)); the distance of two groups is
the sum of |p - q| over the V kept terms.

**Run-length columns.** A group's counts over the vocabulary are a column. p depends on the count alone, so the
vocabulary is put in an order that brings equal counts together: terms are sorted by their counts over the sources, as
sparse vectors, and dealt by ranges of that order into blocks. Each group's column of a block is kept as runs of equal
counts; groups without a term of the block have one run of zeros. The distance of a pair in a block is |p - q| at
each piece between the run boundaries of both columns, times the piece's length. Columns meet in tiles of ``TILE`` by
``TILE`` sources of a block, so no task holds more than two tiles of one block, and blocks' sums are added.

Terms are told by 64-bit hashes inside a task and by their text across tasks. Counts are taken over all documents; sums
are made before the shuffle. The arithmetic is of integers, beyond 64 bits where a count needs it.

Null texts, languages and sources are empty strings; a group without terms has p = 1 + floor(10**9 * 5 / (5 V)) for all terms,
or no distance where V is 0. An empty table gives no rows; other columns are ignored; repeated rows count again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from ..sources.storage import written

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
SCALE, MORE = 10**9, 5
#: A block's terms, its entries at most before it is closed, and the sources of a tile as expected; they change no result.
BLOCK_TERMS, BLOCK_ENTRIES, TILE = 1 << 15, 1 << 20, 32
#: Entries that a task counts before it sends them on, the bytes of text counted at once, and the rows of a batch sent.
HELD, SLICE, SENT = 400_000, 1 << 21, 1 << 15


def p_of(count: str, total: str, terms: str) -> Column:
    """p in decimal, as the product outgrows 64 bits from 9 * 10**9 occurrences on."""
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {MORE} as decimal(20,0))) div cast({total} + {MORE} * {terms} as decimal(20,0)) as long)")


def p_array(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    if count.max(initial=0) + MORE < (1 << 63) // SCALE:
        return 1 + SCALE * (count + MORE) // (total + MORE * terms)
    return np.array([1 + SCALE * (int(c) + MORE) // (total + MORE * terms) for c in count], np.int64)


def word_hashes(t: tx.Texts, starts: np.ndarray, ends: np.ndarray, most: int = tx.SLICE_BYTES) -> np.ndarray:
    """The hashes of a slice's words, by pieces of about ``most`` bytes: hashing takes some forty bytes for each byte it sees at once."""
    out = np.empty(len(starts), tx.U)
    cut = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(t.data), most)), len(starts)))
    for a, b in zip(cut[:-1], cut[1:]):
        low = starts[a]
        piece = t.data[low : ends[b - 1]]
        out[a:b] = tx.Texts(piece, np.array([0, len(piece)]), 0).hashes(starts[a:b] - low, ends[a:b] - low)
    return out


def _terms(t: tx.Texts, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a slice: (group, term, occurrences, documents) of each term of each group; ``group`` is per text."""
    starts, ends, offset = t.words(LETTERS)
    doc = np.repeat(np.arange(t.n), np.diff(offset))
    joint = tx.mix(word_hashes(t, starts, ends) ^ tx.mix(group[doc].astype(tx.U) + tx.U(1)))
    order = np.argsort(joint, kind="stable")  # documents ascend inside a term
    joint, doc = joint[order], doc[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = joint[1:] != joint[:-1]
    other = fresh.copy()
    other[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(fresh)
    docs = np.add.reduceat(other.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    a, size = starts[order[at]], (ends - starts)[order[at]]
    end = np.cumsum(size)
    data = _lower[t.data[np.repeat(a - (end - size), size) + np.arange(int(size.sum()))]]
    names = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], end)).astype(np.int64)), pa.py_buffer(data))
    return group[doc[at]], names, np.diff(np.append(at, len(order))), docs


COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch], most: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) as counts, with a row without a term for every group."""
    held: list[pa.Table] = []
    rows = 0

    def joined() -> pa.Table:
        t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])

    for batch in batches:
        groups = pa.table([pc.fill_null(batch.column(k), "") for k in (0, 1)], names=["lang", "source"])
        key = groups.append_column("row", pa.array(np.arange(len(groups))))
        first = key.group_by(["lang", "source"]).aggregate([("row", "min")])
        names = first.select(["lang", "source"]).append_column("code", pa.array(np.arange(len(first))))
        group = key.join(names, ["lang", "source"]).sort_by("row").column("code").to_numpy()
        mark = len(first)
        held.append(pa.table([*names.select(["lang", "source"]).columns, pa.nulls(mark, pa.large_string()), pa.array(np.zeros(mark, np.int64)), pa.array(np.zeros(mark, np.int64))], names=["lang", "source", "term", "n", "docs"]))
        rows += mark
        for t in tx.slices(batch.column(2), slice_bytes):
            code, term, n, docs = _terms(t, group[t.first : t.first + t.n])
            own = names.select(["lang", "source"]).take(pa.array(code))
            held.append(pa.table([*own.columns, term, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"]))
            rows += len(n)
            if rows > most:
                held = [joined()]
                rows = len(held[0])
                if rows > most // 2:
                    yield from held[0].cast(_COUNTS).to_batches(SENT)
                    held, rows = [], 0
    if held:
        yield from joined().cast(_COUNTS).to_batches(SENT)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def kept_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30) -> DataFrame:
    """(lang, source, term, n, total) of each kept term in the groups that have it, ``total`` its count in the language, and
    one row without a term for every group."""
    rows = docs.select(*[F.col(c).cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = rows.mapInArrow(tx.trimmed(partial(_counted, most=HELD, slice_bytes=SLICE)), COUNTS)
    counts = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = W.partitionBy("lang", "term")
    known = counts.withColumns({"total": F.sum("n").over(by_term), "in_docs": F.sum("docs").over(by_term)})
    return written(known.filter(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).select("lang", "source", "term", "n", "total"), "terms")


RUNS = "lang string, block long, source string, size int, ends array<int>, counts array<long>"


def runs_of(place: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and counts of the runs of a column that has ``count`` at the ascending places ``place`` and 0 elsewhere."""
    edge = np.unique(np.concatenate((place, place + 1, [0, size])))
    value = np.zeros(len(edge) - 1, np.int64)
    value[np.searchsorted(edge, place)] = count
    last = np.append(value[1:] != value[:-1], True) if len(value) else np.zeros(0, bool)
    return edge[1:][last], value[last]


def _columns(batches: Iterator[pa.RecordBatch], most_terms: int, most_entries: int) -> Iterator[pa.RecordBatch]:
    """Terms in order (part, lang, entries) as blocks: one row without a source for its size, one for each source in it."""
    number, held, size, entries, now = None, [], 0, 0, None

    def close() -> pa.RecordBatch:
        nonlocal number, held, size, entries
        names = pa.concat_arrays([h[0] for h in held]).dictionary_encode() if held else pa.array([], pa.string()).dictionary_encode()
        code, place, count = names.indices.to_numpy(), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        order = np.lexsort((place, code))
        cut = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
        rows = [(now, number, None, size, [], [])]
        for k, name in enumerate(names.dictionary.to_pylist()):
            own = order[cut[k] : cut[k + 1]]
            ends, values = runs_of(place[own], count[own], size)
            rows.append((now, number, name, size, ends, values))
        number, held, size, entries = number + 1, [], 0, 0
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in RUNS.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        if number is None:
            number = batch.column(0)[0].as_py() << 33
        langs, lists = batch.column(1).to_pylist(), batch.column(2)
        flat, offset = lists.flatten(), lists.offsets.to_numpy()
        offset = offset - offset[0]
        names, counts = flat.field(0).cast(pa.string()), flat.field(1).to_numpy()
        i = 0
        while i < len(langs):
            if size and (langs[i] != now or size >= most_terms or entries >= most_entries):
                yield close()
            now, j = langs[i], i
            while j < len(langs) and langs[j] == now and size + j - i < most_terms and entries + offset[j] - offset[i] < most_entries:
                j += 1
            a, b = offset[i], offset[j]
            held.append((names[a:b], size + np.repeat(np.arange(j - i), np.diff(offset[i : j + 1])), counts[a:b]))
            size, entries, i = size + j - i, entries + int(b - a), j
    if size:
        yield close()


def blocks_of(kept: DataFrame) -> DataFrame:
    """Run-length columns of ``kept_counts``: (lang, block, source, size, ends, counts), and a row without a source per block."""
    terms = kept.filter("term is not null").groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("entries"))
    # bounds of ranges go through the driver, so the vector's first entries are put in few bytes; its hash keeps equal ones together
    head = F.flatten(F.transform(F.slice("entries", 1, 4), lambda e: F.array(F.hash(e["source"]).cast("long"), e["n"])))
    order = [F.col("lang"), head.alias("head"), F.xxhash64("entries").alias("vector"), F.xxhash64("term").alias("tie")]
    keyed = terms.select(*order, "entries")
    dealt = keyed.repartitionByRange("lang", "head", "vector", "tie").sortWithinPartitions("lang", "head", "vector", "tie")
    return written(dealt.select(F.spark_partition_id().alias("part"), "lang", "entries").mapInArrow(tx.trimmed(partial(_columns, most_terms=BLOCK_TERMS, most_entries=BLOCK_ENTRIES)), RUNS), "columns")


def distance(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum of |p - q| of two columns (ends, p) of one block, piece by piece between the boundaries of both."""
    ends = np.union1d(x[0], y[0])
    p, q = (c[1][np.searchsorted(c[0], ends)] for c in (x, y))
    return int((np.abs(p - q) * np.diff(ends, prepend=0)).sum())


def _tile(rows: pa.Table) -> pa.Table:
    """Distances inside a tile, or between the columns of two tiles, of one block."""
    columns = []
    lists = [[None if x.values is None else x.values.to_numpy().astype(np.int64) for x in rows.column(n)] for n in ("ends", "counts")]
    for size, ends, counts, total, terms in zip(rows.column("size").to_pylist(), *lists, *(rows.column(n).to_pylist() for n in ("total", "terms"))):
        ends, counts = (np.array([size]), np.array([0])) if ends is None else (ends, counts)
        columns.append((ends, p_array(counts, total, terms) if size else counts))
    names, sides, lang, i, j = (rows.column(n).to_pylist() for n in ("source", "tile", "lang", "i", "j"))
    # a pair is named in one order in all blocks, in whatever order the rows of a group come
    pairs = [(a, b) if names[a] < names[b] else (b, a) for a, b in combinations(range(len(names)), 2) if i[0] == j[0] or sides[a] != sides[b]]
    out = [lang[:1] * len(pairs), [names[a] for a, _ in pairs], [names[b] for _, b in pairs], [distance(columns[a], columns[b]) for a, b in pairs]]
    return pa.table([pa.array(c, t) for c, t in zip(out, (*[pa.string()] * 3, pa.int64()))], names=["lang", "a", "b", "value"])


def groups_of(kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms): every group with N, and V of its language."""
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"))
    return written(per.join(known, "lang"), "groups")


def pair_distances(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, source, other, value) of all ordered pairs of different sources of a language, exact."""
    headers = blocks.filter("source is null").select("lang", "block", "size")
    dense = groups.join(headers, "lang", "left").withColumns({"block": F.coalesce("block", F.lit(-1)), "size": F.coalesce("size", F.lit(0))})
    dense = dense.join(blocks.filter("source is not null").select("block", "source", "ends", "counts"), ["block", "source"], "left")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    dense = dense.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    dealt = dense.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
    sums = dealt.select("lang", "block", "source", "size", "ends", "counts", "total", "terms", "tile", "i", "j").groupBy("lang", "block", "i", "j").applyInArrow(_tile, "lang string, a string, b string, value long")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).withColumn("way", F.explode(F.array(F.lit(False), F.lit(True))))
    return pairs.select("lang", F.when(F.col("way"), F.col("b")).otherwise(F.col("a")).alias("source"), F.when(F.col("way"), F.col("a")).otherwise(F.col("b")).alias("other"), "value")


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source, farthest first; ``term`` rows for the
    ``top`` terms that are most over-represented against the language. Ties by UTF-8 bytes of the item."""
    kept = kept_counts(docs, lang, source, text, min_docs)
    groups = groups_of(kept)
    pairs = pair_distances(groups, blocks_of(kept)).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"))
    terms = kept.filter("n > 0").withColumnsRenamed({"total": "in_lang"}).join(groups, ["lang", "source"]).join(whole, "lang")
    over = terms.withColumn("value", p_of("n", "total", "terms") - p_of("in_lang", "whole", "terms")).filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = lambda df: df.withColumn("rank", F.row_number().over(order))
    return rank(pairs).unionByName(rank(over).filter(F.col("rank") <= top))
