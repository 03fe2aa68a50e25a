"""Windows and set operations with stated ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import Split, sides

from ..functions.names import letters


def seats(df: DataFrame, tier: Sequence[str], atom: str, tier_name: str, size: str, tie: Sequence[str] = ()) -> DataFrame:
    """The seat of each tier: the atom named as the tier is, else the largest; ties to the smaller name, of equal names by ``tie``."""
    eponymous = F.coalesce(letters(F.col(atom)) == letters(F.col(tier_name)), F.lit(False))
    w = W.partitionBy(*tier).orderBy(F.desc("__own"), F.desc(F.when(~F.col("__own"), F.col(size))), F.col(atom), *tie)
    return df.withColumn("__own", eponymous).withColumn("__k", F.row_number().over(w)).filter("__k = 1").withColumnRenamed("__own", "eponymous").drop("__k")


def top(df: DataFrame, by: str, name: str, n: int, group: Sequence[str] = ()) -> DataFrame:
    """The n largest, of each group if given; equals by name."""
    order = [F.desc(by), F.col(name)]
    if not group:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def kind_rank(c: Column, kinds: Sequence[str]) -> Column:
    """Place in a list of kinds; unknown kinds come last."""
    return F.coalesce(*[F.when(c == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(len(kinds)))


def ring_neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Next and previous name in each group's order, the ends joined."""
    w = W.partitionBy(*group).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumns({"next": F.coalesce(F.lead(name).over(w), F.first(name).over(whole)), "previous": F.coalesce(F.lag(name).over(w), F.last(name).over(whole))})


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of several rows, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__k = 1").drop("__k")


def free_short_names(df: DataFrame, full: str, short: Column, scope: Sequence[str] = ()) -> DataFrame:
    """``shown``: the short name if it is the only one of its set, else the full one. Counts are joined, not windowed, as a set may be everything."""
    named = df.withColumn("__short", short)
    n = named.groupBy(*scope, "__short").agg(F.count(F.lit(1)).alias("__n"))
    return named.join(n, [*scope, "__short"]).withColumn("shown", F.when(F.col("__n") == 1, F.col("__short")).otherwise(F.col(full))).drop("__short", "__n")


def qualified(df: DataFrame, category: str, principal: str) -> DataFrame:
    """``shown``: the category, with the principal member where the category repeats."""
    n = df.groupBy(category).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(n, category).withColumn("shown", F.when(F.col("__n") > 1, F.concat(F.col(category), F.lit(" ("), F.col(principal), F.lit(")"))).otherwise(F.col(category))).drop("__n")


def paired(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row with the ``next_`` values of its group; the last row of a group has none and goes."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).withColumn("__last", F.lead(F.lit(1)).over(w)).filter("__last = 1").drop("__last")


def compared_sets(claimed: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """(key, side): shared, claimed only, derived only."""
    side = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "claimed").otherwise("derived")
    return sides(claimed, derived, key).select(key, side.alias("side"))


def remainder(members: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    return members.join(claimed.select(key).distinct(), key, "left_anti")


def remainders(roster: DataFrame, frames: DataFrame, claimed: DataFrame, frame: str, key: str) -> Split:
    """What claims leave of the wanted ``frames``, and as rejected (frame, problem) those that give no unit.

    ``claimed`` has the resolved keys; a claim that resolved to nothing (null) takes nothing. A frame that is not in the
    roster is no frame, and one of which nothing is left is to be written as itself; ``rows.strict`` refuses both.
    """
    wanted = frames.select(frame).distinct()
    rows = remainder(roster.join(wanted, frame, "left_semi"), claimed, key)
    known = wanted.join(roster.select(frame).distinct().withColumn("known", F.lit(True)), frame, "left").join(rows.select(frame).distinct().withColumn("left", F.lit(True)), frame, "left")
    problem = F.when(F.col("known").isNull(), "not in the roster").when(F.col("left").isNull(), "nothing left")
    return Split(rows, known.select(frame, problem.alias("problem")).filter("problem is not null"))


def same_sets(a: DataFrame, b: DataFrame, name: str, member: str) -> DataFrame:
    """Names under which both sides hold the same members."""
    sets = lambda df: df.groupBy(name).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets(a).join(sets(b), [name, "members"]).select(name)


def outline_problems(drawn: DataFrame, boundary: DataFrame, interior: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arcs drawn though inside (survived), drawn though not the unit's own (foreign), not drawn though boundary (lost)."""
    k = list(keys)
    survived = drawn.join(interior, k, "left_semi").withColumn("problem", F.lit("survived"))
    foreign = drawn.join(boundary, k, "left_anti").join(interior, k, "left_anti").withColumn("problem", F.lit("foreign"))
    lost = boundary.join(drawn, k, "left_anti").withColumn("problem", F.lit("lost"))
    return survived.unionByName(foreign).unionByName(lost)
