"""Row checks: rows that fail are an output, absence is null."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    ok: DataFrame
    rejected: DataFrame


def is_count(c: Column) -> Column:
    """Whether a cell is a whole number of at least 0; null is not."""
    return F.coalesce((c >= 0) & (c == F.floor(c)), F.lit(False))


def is_optional_count(c: Column) -> Column:
    return c.isNull() | is_count(c)


def is_text(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def split_rows(df: DataFrame, ok: Column) -> Split:
    """Rows by a condition; null counts as failed, so no row is lost."""
    sure = F.coalesce(ok, F.lit(False))
    return Split(df.filter(sure), df.filter(~sure))


def strict(rejected: DataFrame, what: str, show: int = 20) -> None:
    """Raises ValueError naming up to ``show`` rows if there are any."""
    found = [str(tuple(r)) for r in rejected.limit(show).collect()]
    if found:
        raise ValueError(f"{what}: " + "; ".join(found))


def tagged(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rows with ``tag``: the first rule that a row breaks (null counts as broken), or ``ok``; one pass, no row lost."""
    return df.withColumn("tag", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()], F.lit("ok")))


def observed(df: DataFrame, tags: list[str], name: str | None = None) -> tuple[DataFrame, Observation]:
    """``df`` and its number of rows by ``tag``, which the first action on it counts on the way; other tags count as ``other``."""
    seen = Observation(name or f"tags-{uuid.uuid4().hex}")
    counts = [F.count_if(F.col("tag") == t).alias(t) for t in tags]
    return df.observe(seen, *counts, F.count_if(~F.col("tag").isin(tags)).alias("other")), seen


def refusing(df: DataFrame, what: str) -> DataFrame:
    """Rows tagged ``ok`` without their tag; any other row fails the job that meets it, naming its values."""
    shown = F.to_json(F.struct(*df.columns))
    return df.filter(F.when(F.col("tag") == "ok", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), shown)).cast("boolean"))).drop("tag")


def only(df: DataFrame, column: str, values: list) -> DataFrame:
    """A filter that the scan can use."""
    return df.filter(F.col(column).isin(values))


#: Rows of a task where their number is to follow the input.
TASK_ROWS = 1 << 20


def sides(a: DataFrame, b: DataFrame, key: str, task_rows: int | None = None) -> DataFrame:
    """(key, in_a, in_b) of each key of either side, once; null is a key.

    Rows are dealt over as many tasks as they need at about ``task_rows`` each, so a task's memory does not grow with the input.
    """
    rows = a.select(key, F.lit(True).alias("in_a")).unionByName(b.select(key, F.lit(False).alias("in_a")))
    tasks = max(-(-rows.count() // (task_rows or TASK_ROWS)), int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, key).groupBy(key).agg(F.bool_or("in_a").alias("in_a"), F.bool_or(~F.col("in_a")).alias("in_b"))


def without_rollups(df: DataFrame, is_total: Column) -> DataFrame:
    """Rows that are not published totals of other rows; a null condition keeps the row."""
    return df.filter(~F.coalesce(is_total, F.lit(False)))


def inside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).between(low, high) for c, (low, high) in bounds.items()]))


def guarded_ratio(df: DataFrame, num: str, den: str) -> DataFrame:
    """``ratio`` where den > 0 and 0 <= num <= den; other rows are marked ``impossible`` and keep null."""
    sound = F.coalesce((F.col(den) > 0) & F.col(num).between(F.lit(0), F.col(den)), F.lit(False))
    return df.withColumns({"ratio": F.when(sound, F.col(num) / F.col(den)), "impossible": ~sound})


def parts_off(df: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Rows whose parts do not add up to their total."""
    return df.filter(reduce(lambda a, b: a + b, [F.col(p) for p in parts]) != F.col(total))


def withheld(measure: Column, policy: Column) -> Column:
    """The measure, null where the policy withholds it; the row stays."""
    return F.when(~F.coalesce(policy, F.lit(False)), measure)
