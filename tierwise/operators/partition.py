"""Partitions of atoms into units: grown by a rule, validated, scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_name, slug
from . import aggregates as A
from .graph import components_within
from .growth import Rule, grown  # noqa: F401
from .joins import folded
from .windows import free_short_names


def rule_problems(atoms: DataFrame, edges: DataFrame, rule: Rule) -> DataFrame:
    """(atom, problem) of atoms (atom, frame, population, score, lon, lat, seat) that a rule cannot use."""
    dup = atoms.groupBy("atom").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("atom", F.lit("duplicate").alias("problem"))
    checks = [("no frame", F.col("frame").isNull()), ("no population", F.col("population").isNull()), ("no score", F.col("score").isNull()), ("no place", F.col("lon").isNull() | F.col("lat").isNull()), ("over the ceiling", F.col("population") > rule.ceiling), ("score outside 0 to 1", ~F.col("score").between(0, 1))]
    found = atoms.select("atom", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in checks]))).alias("problem"))
    lone = atoms.select("atom").distinct().join(edges.select(F.col("src").alias("atom")), "atom", "left_anti").withColumn("problem", F.lit("not in the graph"))
    return dup.unionByName(found).unionByName(lone)


def grown_problems(atoms: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, problem): atoms without unit, and units in several pieces."""
    lost = atoms.select("atom").join(units, "atom", "left_anti").select(F.col("atom").cast("string").alias("what"), F.lit("unplaced").alias("problem"))
    pieces = components_within(edges, units.select("atom", "centre"), ["centre"]).groupBy("centre").agg(F.count_distinct("component").alias("n")).filter("n > 1")
    return lost.unionByName(pieces.select(F.col("centre").cast("string").alias("what"), F.lit("not contiguous").alias("problem")))


def unit_list(units: DataFrame, short: Column) -> DataFrame:
    """(unit, name, centre, population, place): ids from names that are short where that is unambiguous, largest first."""
    u = units.groupBy("centre", "centre_kind").agg(F.sum("population").alias("population"), F.count(F.lit(1)).alias("atoms"))
    named = free_short_names(u.withColumn("full", F.col("centre").cast("string")), "full", short)
    return named.select(slug(F.col("shown")).alias("unit"), F.col("shown").alias("name"), "centre", "centre_kind", "population", "atoms").orderBy(F.desc("population"), "name")


def resolved_claims(claims: DataFrame, roster: DataFrame, folds: DataFrame) -> DataFrame:
    """Claims (variant, unit, claim, kind) with atom and folded_from; kind is claim or exclude."""
    return folded(claims, "claim", roster.select("atom"), folds)


def claim_problems(claims: DataFrame, units: DataFrame, universe: DataFrame) -> DataFrame:
    """(variant, unit, rule, detail) of resolved claims that do not make a partition of (variant, atom).

    Two children that fold into one parent are one claim of it; the same claim twice is not allowed.
    """
    text = lambda c: F.col(c).cast("string")
    make = lambda df, rule, unit, detail: df.select("variant", unit.alias("unit"), F.lit(rule).alias("rule"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    own = claims.filter("kind = 'claim' and atom is not null").select("variant", "unit", "atom").distinct()
    out = make(claims.filter("atom is null"), "unknown", text("unit"), text("claim"))
    out = out.union(make(claims.groupBy("variant", "unit", "claim", "kind").count().filter("count > 1"), "claimed twice", text("unit"), text("claim")))
    both = claims.filter("kind = 'exclude'").select("variant", "atom").join(own.select("variant", "atom").distinct(), ["variant", "atom"])
    out = out.union(make(both.distinct(), "claimed and excluded", none, text("atom")))
    out = out.union(make(own.groupBy("variant", "atom").agg(F.count_distinct("unit").alias("n")).filter("n > 1"), "overlap", none, text("atom")))
    out = out.union(make(own.join(universe, ["variant", "atom"], "left_anti"), "outside", text("unit"), text("atom")))
    covered = claims.filter("atom is not null").select("variant", "atom").distinct()
    out = out.union(make(universe.join(covered, ["variant", "atom"], "left_anti"), "gap", none, text("atom")))
    return out.union(make(units.groupBy("variant", "unit").count().filter("count > 1"), "unit twice", text("unit"), text("unit")))


def forbidden_claims(claims: DataFrame, units: DataFrame, forbidden: DataFrame, promoted: DataFrame, withheld: DataFrame) -> DataFrame:
    """Claims of forbidden atoms (atom, frame), unless the unit is a territory, an exact promotion, or its variant withholds figures."""
    rows = claims.filter("kind = 'claim'").join(forbidden, "atom").join(units.filter("kind = 'territory'").select("variant", "unit"), ["variant", "unit"], "left_anti")
    return rows.join(promoted, ["variant", "unit"], "left_anti").join(withheld.select("variant"), "variant", "left_anti").select("variant", "unit", "atom", "frame")


def metadata_problems(variants: DataFrame, badges: Sequence[str]) -> DataFrame:
    """(variant, rule): badges outside the vocabulary, blank vintage, missing opposition or source, derived without its badge or the other way round."""
    known = F.array(*[F.lit(b) for b in badges])
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = [("badge", F.size(F.array_except("badges", known)) > 0), ("vintage", blank("vintage")), ("opposition", blank("opposition")), ("source", blank("source")), ("derived", F.col("derived") != F.array_contains("badges", "derived"))]
    return variants.select("variant", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("rule"))


def inherited(own: Column, basis: Column, general: Column) -> tuple[Column, Column]:
    """The first filled of own, basis and general, and which it was."""
    filled = [F.when(F.trim(c) != "", c) for c in (own, basis, general)]
    origin = F.when(filled[0].isNotNull(), "own").when(filled[1].isNotNull(), "basis").when(filled[2].isNotNull(), "general")
    return F.coalesce(*filled), origin


def valid_variants(variants: DataFrame, problems: DataFrame) -> DataFrame:
    """Variants without problems and with a name of their own."""
    once = variants.groupBy("variant").count().filter("count = 1").select("variant")
    return variants.join(once, "variant", "left_semi").join(problems.select("variant").distinct(), "variant", "left_anti")


def scorecards(members: DataFrame, policies: DataFrame) -> DataFrame:
    """One row per variant of members (variant, unit, name, atom, origin, population, area) and policies (variant, policy).

    Population is null where it is withheld; units wholly without figures are set aside, units partly
    without withhold the variant's. Area counts fully measured units. An atom moved if its origin is not
    what its unit is called.
    """
    key = F.struct("variant", "unit")
    pop = A.complete_sums(members.withColumn("u", key), "u", "atom", "population").select("u.variant", "u.unit", "total", "lacking", "members")
    area = A.complete_sums(members.withColumn("u", key), "u", "atom", "area").select("u.variant", F.col("total").alias("area"))
    names = members.groupBy("variant", "unit").agg(F.min("name").alias("name"))
    withheld = A.withholding(pop.join(policies, "variant"), "variant", "policy")
    spread = A.spread(pop.join(names, ["variant", "unit"]), ["variant"], "name", "total").withColumnRenamed("units", "counted")
    moved = A.moved(members, normalize_name(F.col("name")), normalize_name(F.col("origin"))).groupBy("variant").agg(F.count(F.lit(1)).alias("moved"))
    base = members.groupBy("variant").agg(F.count_distinct("unit").alias("units"), F.count(F.lit(1)).alias("atoms"))
    out = base.join(withheld, "variant").join(spread, "variant", "left").join(moved, "variant", "left").join(area.groupBy("variant").agg(F.sum("area").alias("area")), "variant", "left")
    shown = {c: F.when(F.col("withheld").isNull(), F.col(c)) for c in ("counted", "total", "largest", "smallest", "ratio")}
    return out.withColumns(shown).withColumn("moved", F.coalesce("moved", F.lit(0)))
