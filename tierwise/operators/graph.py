"""Adjacency graphs from shared arcs, and groups of connected atoms.

Edges are (src, dst) in both directions. Groups are connected inside a key (unit, category, band), so
edges between keys go before components are sought.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components


def adjacency(incidence: DataFrame, arc: str, atom: str, max_owners: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Edges between all atoms that share an arc, and the arcs of more than ``max_owners`` atoms.

    The edges are quadratic in the owners of an arc; a boundary has two. An arc beyond the bound is dealt over
    several tasks, each with about ``max_owners`` of its atoms as sources, and is also returned for the caller
    to judge. Where only connected groups are sought, ``links`` is linear.
    """
    own = incidence.select(F.col(arc).alias("arc"), F.col(atom).alias("atom")).filter("arc is not null and atom is not null").distinct()
    n = own.groupBy("arc").agg(F.count(F.lit(1)).alias("owners"))
    shared = own.join(n.filter("owners > 1").withColumn("parts", F.ceil(F.col("owners") / max_owners).cast("int")), "arc")
    src = shared.select("arc", F.pmod(F.xxhash64("atom"), F.col("parts")).cast("int").alias("part"), F.col("atom").alias("src"))
    dst = shared.select("arc", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("atom").alias("dst"))
    edges = src.join(dst, ["arc", "part"]).filter("src <> dst").select("src", "dst").distinct()
    return edges, n.filter(F.col("owners") > max_owners)


def links(incidence: DataFrame, arc: str, atom: str, members: DataFrame, keys: Sequence[str], once: bool = False) -> DataFrame:
    """Edges that connect what ``adjacency`` connects inside each key: from each atom of an arc to the smallest one.

    As many as there are owners at most, and in the place of ``adjacency`` for connected groups inside ``keys`` only.
    With ``once`` they come in one direction and may be repeated, which is all that components need.
    """
    own = incidence.select(F.col(arc).alias("arc"), F.col(atom).alias("atom")).filter("arc is not null and atom is not null")
    own = own.join(members.select("atom", F.struct(*keys).alias("__key")), "atom")
    least = own.groupBy("arc", "__key").agg(F.min("atom").alias("dst"))
    out = own.join(least, ["arc", "__key"]).filter("atom <> dst").select(F.col("atom").alias("src"), "dst")
    return out if once else out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def graph_problems(edges: DataFrame, roster: DataFrame, incidence: DataFrame | None = None) -> DataFrame:
    """(kind, node, detail): unknown and missing nodes, self, duplicate and asymmetric edges, arcs of over two owners."""
    e = edges.select("src", "dst")
    ends = e.select(F.col("src").alias("atom")).union(e.select("dst")).distinct()
    text = lambda c: F.col(c).cast("string")
    out = ends.join(roster, "atom", "left_anti").select(F.lit("unknown").alias("kind"), text("atom").alias("node"), F.lit("").alias("detail"))
    out = out.union(roster.join(ends, "atom", "left_anti").select(F.lit("missing"), text("atom"), F.lit("")))
    out = out.union(e.filter("src = dst").select(F.lit("self"), text("src"), text("dst")))
    out = out.union(e.groupBy("src", "dst").count().filter("count > 1").select(F.lit("duplicate"), text("src"), text("dst")))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = out.union(e.join(back, ["src", "dst"], "left_anti").distinct().select(F.lit("asymmetric"), text("src"), text("dst")))
    if incidence is not None:
        out = out.union(incidence.groupBy("arc").agg(F.count_distinct("atom").alias("n")).filter("n > 2").select(F.lit("owners"), text("arc"), text("n")))
    return out


def components_within(edges: DataFrame, members: DataFrame, keys: Sequence[str], inner: bool = False) -> DataFrame:
    """``members`` (atom, keys) with ``component``, the smallest atom that is reachable without leaving the key.

    ``inner`` says that no edge leaves its key, as with ``links``, so that keys need not be looked up.
    """
    if not inner:
        a = members.select(F.col("atom").alias("src"), F.struct(*keys).alias("__a"))
        b = members.select(F.col("atom").alias("dst"), F.struct(*keys).alias("__b"))
        edges = edges.join(a, "src").join(b, "dst").filter("__a = __b").select("src", "dst")
    found = connected_components(edges)
    return members.join(found, members["atom"] == found["node"], "left").withColumn("component", F.coalesce("component", "atom")).drop("node")


def contiguity(edges: DataFrame, members: DataFrame, keys: Sequence[str], inner: bool = False) -> DataFrame:
    """Per key its pieces, whether it is one, and the sizes of its pieces, largest first."""
    pieces = components_within(edges, members, keys, inner).groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), F.col("component"))))
    return pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("pieces"), order.alias("o")).select(*keys, "pieces", (F.col("pieces") == 1).alias("contiguous"), F.transform("o", lambda x: -x["neg"]).alias("sizes"))


def detached(edges: DataFrame, members: DataFrame, keys: Sequence[str], inner: bool = False) -> DataFrame:
    """Atoms outside the largest piece of their key (of equals the one with the smallest atom)."""
    c = components_within(edges, members, keys, inner)
    size = c.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    main = size.groupBy(*keys).agg(F.min_by("component", F.struct(-F.col("size"), F.col("component"))).alias("main"))
    return c.join(main, list(keys)).filter("component <> main").drop("main")


def grouped(edges: DataFrame, members: DataFrame, keys: Sequence[str], population: str, inner: bool = False) -> DataFrame:
    """Connected groups of one key: size, population and principal atom (the most populous, then the smallest)."""
    c = components_within(edges, members, keys, inner)
    return c.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("size"), F.sum(population).alias("population"), F.min_by("atom", F.struct(-F.col(population), F.col("atom"))).alias("principal")
    )


@dataclass(frozen=True)
class Regions:
    """Regions of a scope; atoms without a category; atoms that the rule must not place, with the reason."""

    regions: DataFrame
    unassigned: DataFrame
    refused: DataFrame


def category_regions(scope: DataFrame, facts: DataFrame, edges_of: Callable[[DataFrame], DataFrame], inner: bool = False) -> Regions:
    """Connected groups of one category over ``scope`` (atom), from ``facts`` (atom, category, population).

    Regions (category, component, size, population, principal, name) are named by their category, with the principal
    atom where a category has several. Atoms whose category is null are unassigned. Atoms that the scope names twice, that
    the facts do not reach, or that have no population are refused: they are no part of any region, and a caller that
    wants all or nothing passes ``refused`` to ``rows.strict``. ``edges_of`` gives the edges among (atom, category) rows.
    """
    named = scope.groupBy("atom").agg(F.count(F.lit(1)).alias("times")).join(facts.withColumn("known", F.lit(True)), "atom", "left")
    reason = F.when(F.col("times") > 1, "named twice").when(F.col("known").isNull(), "no facts").when(F.col("population").isNull(), "no population")
    judged = named.withColumn("reason", reason)
    members = judged.filter("reason is null and category is not null").select("atom", "category", "population")
    groups = grouped(edges_of(members), members, ["category"], "population", inner)
    several = groups.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("n") > 1, F.concat("category", F.lit(" ("), F.col("principal").cast("string"), F.lit(")"))).otherwise(F.col("category"))
    regions = groups.join(several, "category").withColumn("name", name).drop("n")
    return Regions(regions, judged.filter("reason is null and category is null").select("atom"), judged.filter("reason is not null").select("atom", "reason"))


def not_sole(groups: DataFrame, category: str) -> DataFrame:
    """Categories that are not exactly one group."""
    return groups.groupBy(category).agg(F.count(F.lit(1)).alias("groups")).filter("groups <> 1")
