"""Connected components of an undirected edge list: contraction inside partitions, star rounds for what is left.

1. Every task unites the edges of its partition (union-find over arrays, no shuffle) and keeps a forest: an edge from
   each node to the smallest node that it reaches there.
2. A node of several partitions has several such roots. Its least root becomes its name, and an edge from each of
   the others to it is all that is left of the graph. Nodes of one partition are done.
3. Where no more than ``task_edges`` edges are left, one task unites them; this bound does not grow with the graph.
   Else large-star and small-star steps run over the edges between roots; each only groups and joins edges, their number
   never grows, and the number of rounds grows with the square of the logarithm of the graph at most.

Every step is written to the shared folder, so lineage stays short and a lost executor repeats one step at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

#: Edges that a task unites at once, and that one task may finish.
TASK_EDGES = 1 << 19


def order_codes(values: pa.Array) -> np.ndarray:
    """Integers in the order of ``values``, equal for equal ones; structs are ordered field by field, nulls first."""
    if pa.types.is_struct(values.type):
        code = np.zeros(len(values), np.int64)
        for field in values.flatten():
            own = order_codes(field)
            code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
        return code
    if pa.types.is_integer(values.type) and not values.null_count:
        return np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    named = values.dictionary_encode()
    rank = np.empty(len(named.dictionary), np.int64)
    rank[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(1, len(rank) + 1)
    return np.where(named.indices.is_valid(), rank[pc.fill_null(named.indices, 0).to_numpy()] if len(rank) else 0, 0)


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1 the smallest one that each is connected with.

    A root hooks to the least root beside it, then all paths are shortened to their end. Of two roots side by side one
    hooks at least, so the roots that still have neighbours are halved each time.
    """
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            next_ = root[root]
            if (next_ == root).all():
                break
            root = next_


def _forest(edges: pa.Table, names: tuple[str, str], trees: bool) -> pa.Table:
    """An edge from each node to its root, those of the roots themselves only with ``trees``."""
    ends = pa.concat_arrays([edges.column(k).combine_chunks() for k in (0, 1)])
    code, at = order_codes(ends), None
    found, at, code = np.unique(code, return_index=True, return_inverse=True)
    root = roots(code[: len(edges)], code[len(edges) :], len(found))
    own = np.flatnonzero((root != np.arange(len(root))) | trees)
    return pa.table([ends.take(pa.array(at[own])), ends.take(pa.array(at[root[own]]))], names=list(names))


def _united(batches: Iterator[pa.RecordBatch], most: int, names: tuple[str, str] = ("u", "v"), whole: bool = False) -> Iterator[pa.RecordBatch]:
    """The forest of a partition's edges, of about ``most`` edges at a time unless it is to be ``whole``.

    A forest that alone is half as large goes out, and a new one is begun.
    """
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]).rename_columns(["u", "v"]))
            rows += batch.num_rows
        if rows > most and not whole:
            held = [_forest(pa.concat_tables(held), ("u", "v"), False)]
            rows = len(held[0])
            if rows > most // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from _forest(pa.concat_tables(held), names, whole).to_batches()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node points to one other at most, and none that is pointed to points on: nothing is left to join."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1").isEmpty()


def _star_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    now = edges
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "components")
        if _stars(now):
            ends = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without another end are not listed.

    Null ends and self edges are ignored; repeated edges count once; an empty edge list gives no rows. Nodes are of any type
    that has an order, structs of such included. Raises RuntimeError if ``max_rounds`` star rounds do not suffice, rather
    than give a partial result. ``task_edges`` changes the way only, not the result.
    """
    kind = edges.schema[src].dataType.simpleString()
    plain = edges.select(F.col(src).alias("u"), F.col(dst).cast(kind).alias("v")).filter("u <> v")
    forest = written(plain.mapInArrow(partial(_united, most=task_edges), f"u {kind}, v {kind}"), "forest")
    one = lambda e: e.coalesce(1).mapInArrow(partial(_united, most=task_edges, names=("node", "component"), whole=True), f"node {kind}, component {kind}")
    if forest.count() <= task_edges:
        return one(forest)
    trees = forest.unionByName(forest.select(F.col("v").alias("u"), "v"))
    least = trees.groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("roots"))  # a root per partition at most
    named = written(least.select("node", F.array_min("roots").alias("root"), F.when(F.size("roots") > 1, F.col("roots")).alias("others")), "named")
    left = named.filter("others is not null").select(F.explode("others").alias("u"), F.col("root").alias("v")).filter("u <> v")
    left = written(left.mapInArrow(partial(_united, most=task_edges), f"u {kind}, v {kind}"), "roots")
    n = left.count()
    if not n:
        return named.select("node", F.col("root").alias("component"))
    found = (one(left) if n <= task_edges else _star_rounds(left.distinct(), max_rounds)).withColumnsRenamed({"node": "name", "component": "least"})
    return named.join(found, named["root"] == found["name"], "left").select("node", F.coalesce("least", "root").alias("component"))
