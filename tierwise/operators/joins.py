"""Joins that account for every row: resolved, unmatched and missing are all outputs.

The roster, aliases and folds are dimensions; Spark broadcasts them when it measures them as small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import normalize_name, strip_suffix
from ..sources.storage import written
from .rows import sides


def dictionary(roster: DataFrame, *layers: DataFrame) -> DataFrame:
    """(norm_key, atom) of alias layers (norm_key, canonical), the first first, and of the roster's own names last."""
    parts = [x.select("norm_key", F.col("canonical").alias("atom"), F.lit(k).alias("rank")) for k, x in enumerate(layers)]
    parts.append(roster.select(normalize_name(F.col("atom")).alias("norm_key"), "atom", F.lit(len(layers)).alias("rank")))
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    return all_rows.groupBy("norm_key").agg(F.min_by("atom", F.struct("rank", "atom")).alias("atom"))


def resolved(df: DataFrame, name: str, roster: DataFrame, *layers: DataFrame) -> DataFrame:
    """``df`` with ``atom``: the canonical name, null if none answers."""
    return df.withColumn("norm_key", normalize_name(F.col(name))).join(dictionary(roster, *layers), "norm_key", "left").drop("norm_key")


def folded(df: DataFrame, name: str, roster: DataFrame, folds: DataFrame, *layers: DataFrame) -> DataFrame:
    """As ``resolved``, then a child (child, parent) of an atom stands for its parent; ``folded_from`` names the child."""
    f = folds.select(normalize_name(F.col("child")).alias("fold_key"), "parent")
    out = resolved(df, name, roster, *layers).withColumn("fold_key", normalize_name(F.col(name))).join(f, "fold_key", "left")
    through = F.col("atom").isNull() & F.col("parent").isNotNull()
    return out.withColumns({"folded_from": F.when(through, F.col(name)), "atom": F.coalesce("atom", "parent")}).drop("fold_key", "parent")


def classified(relations: DataFrame, roster: DataFrame, aliases: DataFrame, folds: DataFrame, dropped: DataFrame, overrides: DataFrame, pinned: DataFrame) -> DataFrame:
    """(id, name) rows with kind, atom and reason: dropped, override, pinned name under another id, name, fold, unclassified."""
    r = folded(relations, "name", roster, folds, aliases).withColumnsRenamed({"atom": "named"})
    r = r.join(dropped.select("id", "reason"), "id", "left").join(overrides.select("id", F.col("atom").alias("override")), "id", "left")
    r = r.join(pinned.select(F.col("atom").alias("pin_atom"), F.col("id").alias("pin_id")), F.col("named") == F.col("pin_atom"), "left")
    direct = F.col("named").isNotNull() & F.col("folded_from").isNull()
    clash = direct & F.col("pin_id").isNotNull() & (F.col("pin_id") != F.col("id"))
    kind = F.when(F.col("reason").isNotNull(), "dropped").when(F.col("override").isNotNull(), "unit").when(clash, "unclassified").when(direct, "unit").when(F.col("named").isNotNull(), "folded").otherwise("unclassified")
    return r.withColumn("kind", kind).select("id", "name", "kind", F.when(F.col("kind").isin("unit", "folded"), F.coalesce("override", "named")).alias("atom"), F.when(F.col("kind") == "dropped", F.col("reason")).alias("reason"))


def classified_tier(df: DataFrame, name: str, folds: DataFrame, aliases: DataFrame, suffix: str = "Division") -> DataFrame:
    """A tier's name: its fold's parent, else the alias of the name without suffix, else that name."""
    f = folds.select(normalize_name(F.col("child")).alias("fold_key"), "parent")
    a = aliases.select(F.col("norm_key").alias("alias_key"), "canonical")
    bare = strip_suffix(F.col(name), suffix)
    out = df.withColumns({"fold_key": normalize_name(F.col(name)), "bare": bare, "alias_key": normalize_name(bare)})
    return out.join(f, "fold_key", "left").join(a, "alias_key", "left").withColumn("tier", F.coalesce("parent", "canonical", "bare")).drop("fold_key", "alias_key", "bare", "parent", "canonical")


@dataclass(frozen=True)
class Reconciled:
    assignments: DataFrame
    dropped: DataFrame
    folded: DataFrame
    unclassified: DataFrame
    uncovered: DataFrame


def reconciled(kinds: DataFrame, roster: DataFrame) -> Reconciled:
    """The outputs of ``classified`` apart, and the atoms that no row covers."""
    used = kinds.filter(F.col("atom").isNotNull())
    return Reconciled(kinds.filter("kind = 'unit'"), kinds.filter("kind = 'dropped'"), kinds.filter("kind = 'folded'"), kinds.filter("kind = 'unclassified'"), roster.join(used, "atom", "left_anti"))


@dataclass(frozen=True)
class Joined:
    ok: DataFrame
    unmatched: DataFrame
    missing: DataFrame
    duplicates: DataFrame
    misplaced: DataFrame


def facts_to_roster(facts: DataFrame, roster: DataFrame, frame: str) -> Joined:
    """Facts with ``atom`` (null: unmatched) and their own ``frame`` against roster (atom, frame)."""
    placed = facts.filter(F.col("atom").isNotNull())
    r = roster.select("atom", F.col("frame").alias("roster_frame"))
    both = placed.join(r, "atom")
    return Joined(
        both.filter(F.col(frame).eqNullSafe(F.col("roster_frame"))).drop("roster_frame"),
        facts.filter(F.col("atom").isNull()),
        roster.join(placed, "atom", "left_anti"),
        placed.groupBy("atom").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"),
        both.filter(~F.col(frame).eqNullSafe(F.col("roster_frame"))),
    )


#: What a row of ``tagged_facts`` can be.
FACT_TAGS = ["ok", "misplaced", "unmatched", "missing"]


def tagged_facts(facts: DataFrame, roster: DataFrame, frame: str, salts: int = 64) -> DataFrame:
    """Facts with ``atom`` (null: unmatched) against roster (atom, frame) as one frame with ``tag``, from one join.

    Every fact is ``ok``, ``misplaced`` (its own frame is another) or ``unmatched`` (no atom, or one that the roster
    lacks); atoms without a fact are rows with tag ``missing`` and null facts. A fact's frame stays, the roster's comes as
    ``roster_frame``. Facts without an atom are dealt over ``salts`` keys, as they may be many.
    """
    salt = F.when(F.col("atom").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0)
    f = facts.withColumns({"__salt": salt, "__fact": F.lit(True)})
    r = roster.select(F.col("atom").alias("__atom"), F.col("frame").alias("roster_frame"), F.lit(0).cast("long").alias("__zero"), F.lit(True).alias("__known"))
    both = f.join(r, (F.col("atom") == F.col("__atom")) & (F.col("__salt") == F.col("__zero")), "full_outer")
    tag = F.when(F.col("__fact").isNull(), "missing").when(F.col("__known").isNull(), "unmatched").when(F.col(frame).eqNullSafe(F.col("roster_frame")), "ok").otherwise("misplaced")
    return both.withColumns({"tag": tag, "atom": F.coalesce("atom", "__atom")}).drop("__salt", "__fact", "__atom", "__zero", "__known")


def apart(rows: DataFrame, tags: list[str]) -> dict[str, DataFrame]:
    """Rows of each tag, written once by tag, so that the plan behind ``rows`` runs once however many are read."""
    kept = written(rows, "tagged", by=["tag"])
    return {t: kept.filter(F.col("tag") == t).drop("tag") for t in tags}


def collisions(df: DataFrame, atom: str, name: str) -> DataFrame:
    """Atoms reached under several published names, all of them listed."""
    return df.groupBy(atom).agg(F.array_sort(F.collect_set(name)).alias("names")).filter(F.size("names") > 1)


def totals_off(ours: DataFrame, theirs: DataFrame, key: str, summed: str = "summed", published: str = "published") -> DataFrame:
    """Keys whose totals differ or stand on one side only, with ``delta`` = ours - theirs."""
    both = ours.select(key, summed).join(theirs.select(key, published), key, "full_outer")
    return both.filter(~F.col(summed).eqNullSafe(F.col(published))).withColumn("delta", F.col(summed) - F.col(published))


def totals_off_but(ours: DataFrame, theirs: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """As ``totals_off`` with known differences (key, delta) added to ours first."""
    known = ours.select(key, "summed").join(pinned.select(key, F.col("delta").alias("known")), key, "left")
    return totals_off(known.select(key, (F.col("summed") + F.coalesce("known", F.lit(0))).alias("summed")), theirs, key)


def coverage(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, problem): expected keys that are missing and present keys that are unexpected."""
    lone = lambda own, other, problem: F.when(F.col(own) & (~F.col(other) | F.col(key).isNull()), F.lit(problem))
    problems = F.array_compact(F.array(lone("in_a", "in_b", "missing"), lone("in_b", "in_a", "unexpected")))
    return sides(expected, present, key).select(key, F.explode(problems).alias("problem"))


def disagreements(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    return a.select(key, left).join(b.select(key, right), key).filter(F.col(left) != F.col(right))


def excesses(counted: DataFrame, limit: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Rows counted above their limit, the largest excess first."""
    both = disagreements(counted, limit, key, left, right).filter(F.col(left) > F.col(right))
    return both.withColumn("excess", F.col(left) - F.col(right)).orderBy(F.desc("excess"), key)


def shared_keys(near: DataFrame, far: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Near rows whose key is also far, the first row of each key in ``order``."""
    first = W.partitionBy(key).orderBy(*order)
    return near.join(far.select(key).distinct(), key, "left_semi").withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")


def memberships(rows: DataFrame, child: str, parent: str, is_fold: Column, order: str) -> DataFrame:
    """One parent a child: rows that are not folds first, folds fill gaps; ``conflict`` marks children of several first-class parents."""
    w = W.partitionBy(child).orderBy("__fold", order, parent)
    per = W.partitionBy(child)
    out = rows.withColumn("__fold", is_fold.cast("int")).withColumn("__k", F.row_number().over(w)).withColumn("conflict", F.size(F.collect_set(F.when(F.col("__fold") == 0, F.col(parent))).over(per)) > 1)
    return out.filter("__k = 1").withColumn("folded", F.col("__fold") == 1).drop("__fold", "__k")


def assembled(roster: DataFrame, key: str, parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One nested row per key with a struct of each part, and (key, part) of what is absent."""
    out = roster
    for name, part in parts.items():
        own = [c for c in part.columns if c != key]
        out = out.join(part.select(key, F.struct(*own).alias(name)), key, "left")
    absent = out.select(key, F.explode(F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in parts]))).alias("part"))
    return out, absent


def owners(units: DataFrame, members: str = "atoms") -> DataFrame:
    """(atom, unit) of units (unit, pos, atoms): the later unit wins."""
    return units.select("unit", "pos", F.explode(members).alias("atom")).groupBy("atom").agg(F.max_by("unit", F.struct("pos", "unit")).alias("unit"))


def unknown_references(rows: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(F.col(key).alias(ref)), ref, "left_anti")


def statuses(roster: DataFrame, facts: DataFrame, key: str, category: str) -> DataFrame:
    """Every atom as category, no-dominant (counted, none named) or no-data (not covered)."""
    f = facts.select(key, F.col(category).alias("category"), F.lit(True).alias("__covered"))
    status = F.when(F.col("__covered").isNull(), "no-data").when(F.col("category").isNull(), "no-dominant").otherwise("category")
    return roster.join(f, key, "left").withColumn("status", status).drop("__covered")


def reason(not_covered: Column, withheld: Column, unnamed: Column) -> Column:
    """The first reason that applies, null if none does."""
    return F.when(not_covered, "not covered").when(withheld, "withheld").when(unnamed, "unnamed")


def listed(rows: DataFrame, key: str, item: str, roster: DataFrame) -> DataFrame:
    """The sorted items of each key of the roster, null for none."""
    return roster.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")), key, "left")


def chain_lookup(relations: DataFrame, units: DataFrame, nodes: DataFrame, node_type: str, role: str) -> DataFrame:
    """Relation (id, code, members) -> unit by code -> first member of a type and role -> node (id, name).

    ``problem`` is null, "no unit", "no member", "missing node" or "unnamed node".
    """
    first = F.try_element_at(F.filter("members", lambda m: (m["type"] == node_type) & (m["role"] == role)), F.lit(1))
    out = relations.withColumn("ref", first["ref"]).drop("members").join(units.select("code", "unit"), "code", "left")
    out = out.join(nodes.select(F.col("id").alias("ref"), F.col("name").alias("node_name"), F.lit(True).alias("__found")), "ref", "left")
    problem = F.when(F.col("unit").isNull(), "no unit").when(F.col("ref").isNull(), "no member").when(F.col("__found").isNull(), "missing node").when(F.coalesce(F.trim("node_name"), F.lit("")) == "", "unnamed node")
    return out.withColumn("problem", problem).drop("__found")
