"""Aggregates that tell absence from zero, with named offenders and deterministic ties."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import written
from .rows import Split


def sums_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def tiers(df: DataFrame, levels: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums of every tier and the grand total in one pass; ``level`` is the number of tiers in a row's key."""
    grouped = df.rollup(*levels).agg(F.grouping_id().alias("__gid"), *[F.sum(m).alias(m) for m in measures])
    return grouped.withColumn("level", F.lit(len(levels)) - F.bit_count("__gid")).drop("__gid")


def indicator_sums(df: DataFrame, key: str, indicator: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """Per key the sum of each indicator (null cells as 0) and whether it was there at all."""
    cols = []
    for w in wanted:
        hit = F.col(indicator) == w
        cols += [F.sum(F.when(hit, F.coalesce(F.col(value), F.lit(0)))).alias(w), F.coalesce(F.bool_or(hit), F.lit(False)).alias(f"has_{w}")]
    return df.groupBy(key).agg(*cols)


def category_pivot(df: DataFrame, key: str, category: str, value: str, categories: Sequence[str]) -> DataFrame:
    """A column per category of the fixed list, 0 where a key has none."""
    return df.groupBy(key).pivot(category, list(categories)).agg(F.sum(value)).fillna(0, list(categories))


def category_join(roster: DataFrame, df: DataFrame, key: str, category: str, value: str, categories: Sequence[str]) -> DataFrame:
    """Counts per category of every roster row; ``empty`` says that all its cells were null, which is not zero."""
    per = df.groupBy(key).agg(*[F.count_if(F.col(category) == c).alias(c) for c in categories], (F.count(value) == 0).alias("empty"))
    return roster.join(per, key, "left").fillna(0, list(categories)).withColumn("empty", F.coalesce("empty", F.lit(True)))


def row_total(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def dominant(named: Sequence[str], residual: str) -> Column:
    """The named category with the largest value, the first of equals; null if the residual is strictly larger."""
    best = F.greatest(*[F.col(c) for c in named])
    first = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in named])
    return F.when(F.col(residual) <= best, first)


def share_of(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total)


def index_of(rates: Sequence[str]) -> Column:
    """The mean of the rates to six decimals, null unless all are within 0 and 1."""
    sound = reduce(lambda a, b: a & b, [F.coalesce(F.col(r).between(0, 1) & ~F.isnan(F.col(r)), F.lit(False)) for r in rates])
    return F.when(sound, F.round(reduce(lambda a, b: a + b, [F.col(r) for r in rates]) / len(rates), 6))


#: Cuts that go into a plan as a literal array; more are dealt into ranges between so many of them.
PLAN_CUTS = 4096


def last_at_most(value: Column, cuts: Column, steps: Column) -> Column:
    """How many of the ascending cuts are at most ``value``, by binary search in descending powers of two."""
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


def search_steps(n: int) -> Column:
    return F.lit([1 << b for b in range(max(n, 1).bit_length() - 1, -1, -1)])


def banded(df: DataFrame, value: str, bands: DataFrame, plan_cuts: int = PLAN_CUTS) -> DataFrame:
    """``band`` of bands (band, from, to) with from <= value < to, null where no band holds the value.

    Bands are disjoint; overlapping ones raise an error, empty ones and those without a bound hold nothing. Up to
    ``plan_cuts`` bands are searched as arrays in the plan. More are dealt by ranges between quantiles of their cuts,
    so that a row meets one short array, whatever the number of bands; the rows of a range are joined by its number.
    """
    b = bands.select("band", "from", "to").filter("`from` < `to`")
    few = b.orderBy("from").limit(plan_cuts + 1).collect()  # bounded
    if not few:
        return df.withColumn("band", F.lit(None).cast(bands.schema["band"].dataType))
    if len(few) <= plan_cuts:
        if any(x["to"] > y["from"] for x, y in zip(few, few[1:])):
            raise ValueError("bands overlap: " + ", ".join(f"{x['band']} and {y['band']}" for x, y in zip(few, few[1:]) if x["to"] > y["from"]))
        at = last_at_most(F.col(value), F.lit([r["from"] for r in few]), search_steps(len(few))) - 1
        return df.withColumn("__at", at).withColumn("band", F.when((F.col("__at") >= 0) & (F.col(value) < F.get(F.lit([r["to"] for r in few]), "__at")), F.get(F.lit([r["band"] for r in few]), "__at"))).drop("__at")
    cuts = sorted(set(b.agg(F.percentile_approx("from", [i / plan_cuts for i in range(plan_cuts)], 10 * plan_cuts)).first()[0]) | {few[0]["from"]})
    of = lambda c: last_at_most(F.col(c), F.lit(cuts), search_steps(len(cuts)))
    ranges = b.withColumn("__range", of("from")).groupBy("__range").agg(F.array_sort(F.collect_list(F.struct("from", "to", "band"))).alias("s"))
    ranges = ranges.select("__range", F.col("s.from").alias("__froms"), F.col("s.to").alias("__tos"), F.col("s.band").alias("__names"))
    later = F.concat(F.slice("__froms", 2, F.size("__froms")), F.array_compact(F.array(F.get(F.lit(cuts), "__range"))))
    clash = F.exists(F.arrays_zip(F.slice("__tos", 1, F.size(later)).alias("t"), later.alias("f")), lambda x: x["t"] > x["f"])
    bits = F.floor(F.log2(F.size("__froms"))).cast("int")
    ranges = ranges.withColumns({"__tos": F.when(clash, F.raise_error(F.lit("bands overlap"))).otherwise(F.col("__tos")), "__steps": F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda x: F.call_function("shiftleft", F.lit(1), x))})
    found = df.withColumn("__range", of(value)).join(ranges, "__range", "left")
    at = last_at_most(F.col(value), F.col("__froms"), F.col("__steps")) - 1
    found = found.withColumn("__at", at).withColumn("band", F.when(F.col(value) < F.get("__tos", "__at"), F.get("__names", "__at")))
    return found.drop("__range", "__froms", "__tos", "__names", "__steps", "__at")


def split_by_band(df: DataFrame, value: str, bands: DataFrame) -> Split:
    """Rows with their band, and those whose value is null or in no band, for ``rows.strict`` to refuse."""
    rows = banded(df, value, bands)
    return Split(rows.filter("band is not null"), rows.filter("band is null").drop("band"))


def band_counts(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows per band in band order, empty bands included."""
    return bands.select("band", "from").join(df.groupBy("band").agg(F.count(F.lit(1)).alias("rows")), "band", "left").withColumn("rows", F.coalesce("rows", F.lit(0))).orderBy("from")


def extremes(df: DataFrame, atom: str, measures: Sequence[str]) -> DataFrame:
    """(measure, lowest, highest): the atoms at either end, ties to the smaller name."""
    long = df.select(atom, F.stack(F.lit(len(measures)), *[x for m in measures for x in (F.lit(m), F.col(m).cast("double"))]).alias("measure", "v")).filter("v is not null")
    return long.groupBy("measure").agg(F.min_by(atom, F.struct("v", atom)).alias("lowest"), F.min_by(atom, F.struct(-F.col("v"), F.col(atom))).alias("highest"))


def complete_sums(df: DataFrame, unit: str, atom: str, value: str) -> DataFrame:
    """The sum per unit, null if a member has no value; the members that lack one; how many members there are."""
    lacking = F.array_sort(F.collect_list(F.when(F.col(value).isNull(), F.col(atom))))
    return df.groupBy(unit).agg(F.when(F.count(value) == F.count(F.lit(1)), F.sum(value)).alias("total"), lacking.alias("lacking"), F.count(F.lit(1)).alias("members"))


def moved(members: DataFrame, unit_name: Column, origin: Column) -> DataFrame:
    """Members whose origin is not what their unit is called (both normalised by the caller)."""
    return members.filter(origin.isNotNull() & (origin != unit_name))


def spread(df: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """Count, total, largest (first of equals), smallest (last of equals) and their ratio, null for fewer than two."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"), F.sum(v).alias("total"), F.min_by(name, F.struct(-v, F.col(name))).alias("largest"), F.max_by(name, F.struct(-v, F.col(name))).alias("smallest"),
        F.when(F.count(F.lit(1)) >= 2, F.round(F.max(v) / F.min(v), 1)).alias("ratio"),
    )


def withholding(units: DataFrame, variant: str, policy: str) -> DataFrame:
    """Per variant why its population is withheld: its policy, a partly covered unit, or nothing counted; else null.

    ``units`` has members, lacking (array) and total per unit; wholly uncovered units are set aside by name.
    """
    n, gone = F.col("members"), F.size("lacking")
    return units.groupBy(variant).agg(
        F.when(F.bool_or(F.col(policy)), "variant").when(F.bool_or((gone > 0) & (gone < n)), "incomplete").when(F.count("total") == 0, "uncounted").alias("withheld"),
        F.array_sort(F.collect_list(F.when(gone == n, F.col("unit")))).alias("set_aside"),
    )


def incidence_counts(df: DataFrame, arc: str, owner: str) -> DataFrame:
    return df.groupBy(arc).agg(F.count_distinct(owner).alias("owners"), F.count(F.lit(1)).alias("uses"))


def arcs_by_side(df: DataFrame, unit: str, arc: str) -> DataFrame:
    """Arcs of a unit: used once they bound it, used more often they are inside."""
    return df.groupBy(unit, arc).agg(F.count(F.lit(1)).alias("uses")).withColumn("side", F.when(F.col("uses") == 1, "boundary").otherwise("interior"))


def composition(df: DataFrame, unit: str, category: str) -> DataFrame:
    """Counts and shares of categories in a unit."""
    n = df.groupBy(unit, category).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(W.partitionBy(unit)), 6))


def framed_units(df: DataFrame, variant: str, unit: str, frame: str) -> DataFrame:
    """(variant, unit, frame) of those variants whose units lie in one frame each."""
    per = df.groupBy(variant, unit).agg(F.min(frame).alias("frame"), (F.count_distinct(frame) == 1).alias("one"))
    ok = per.groupBy(variant).agg(F.bool_and("one").alias("all_one")).filter("all_one")
    return per.join(ok, variant, "left_semi").drop("one")


def subset_deviation(df: DataFrame, value: str, subsets: dict[str, Column], published: dict[str, float]) -> DataFrame:
    """(subset, ours, published, percent): sums of named subsets and their signed deviation."""
    one = df.agg(*[F.sum(F.when(c, F.col(value))).alias(n) for n, c in subsets.items()])
    pairs = [x for n in subsets for x in (F.lit(n), F.col(n), F.lit(float(published[n])))]
    return one.select(F.stack(F.lit(len(subsets)), *pairs).alias("subset", "ours", "published")).withColumn("percent", F.round((F.col("ours") / F.col("published") - 1) * 100, 4))


def changes(df: DataFrame, key: str, before: str, after: str, more_than: float) -> DataFrame:
    g = df.groupBy(key).agg(F.sum(before).alias("before"), F.sum(after).alias("after")).withColumn("change", F.col("after") - F.col("before"))
    return g.filter(F.abs("change") > more_than).orderBy("change", key)


def kept_fraction_cut(df: DataFrame, group: str, weight: str, fraction: float, task_weights: int = 1_000_000, cuts: int = 1000) -> DataFrame:
    """The weight at index floor((1 - fraction) * (n - 1)) of each group's sorted weights; nulls are no weights.

    Equal weights are counted together first. While a group has more than ``task_weights`` distinct weights, they are counted
    between ``cuts`` quantiles of it, and only the range that holds the index stays: exact, as the counts are, whatever
    the quantiles. What is left of a group is then ranked by one task.
    """
    w = df.filter(F.col(weight).isNotNull()).groupBy(F.col(group).alias("g"), F.col(weight).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    w = written(w, "weights")
    total = w.groupBy("g").agg((F.floor(F.lit(1 - fraction) * (F.sum("n") - 1)) + 1).alias("at"), F.count(F.lit(1)).alias("size"))
    while (total.agg(F.max("size").alias("most")).first()["most"] or 0) > task_weights:
        found = w.groupBy("g").agg(F.array_distinct(F.percentile_approx("w", [i / cuts for i in range(cuts)], 10 * cuts)).alias("cuts"))
        ranged = w.join(found.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).withColumn("range", last_at_most(F.col("w"), F.col("cuts"), search_steps(cuts))).select("g", "w", "n", "range")
        counts = ranged.groupBy("g", "range").agg(F.sum("n").alias("in_range")).join(total.select(F.col("g").alias("h"), "at"), F.col("g").eqNullSafe(F.col("h")))
        counts = counts.withColumn("before", F.sum("in_range").over(W.partitionBy("g").orderBy("range")) - F.col("in_range"))  # at most cuts + 1 rows a group
        here = counts.filter((F.col("before") < F.col("at")) & (F.col("at") <= F.col("before") + F.col("in_range"))).select("h", F.col("range").alias("own"), (F.col("at") - F.col("before")).alias("at"))
        w = written(ranged.join(here, F.col("g").eqNullSafe(F.col("h")) & (F.col("range") == F.col("own"))).select("g", "w", "n", "at"), "weights")
        total = w.groupBy("g").agg(F.first("at").alias("at"), F.count(F.lit(1)).alias("size"))
        w = w.select("g", "w", "n")
    upto = F.sum("n").over(W.partitionBy("g").orderBy("w"))
    ranked = w.withColumn("upto", upto).join(total.select(F.col("g").alias("h"), "at"), F.col("g").eqNullSafe(F.col("h")))
    return ranked.filter("upto >= at").groupBy(F.col("g").alias(group)).agg(F.min("w").alias("cut"))


def presence(categories: DataFrame, dominants: DataFrame, category: str) -> DataFrame:
    """Every category in list order with whether it dominates anywhere."""
    d = dominants.select(category).distinct().withColumn("dominates", F.lit(True))
    return categories.join(d, category, "left").withColumn("dominates", F.coalesce("dominates", F.lit(False)))
