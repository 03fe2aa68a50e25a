"""Column functions over names, numbers and dates. Null in, null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say what kind of place a name is of.
KIND_WORDS = ("district", "division", "tehsil", "agency")
EARTH_KM = 6371.0


def normalize_name(c: Column) -> Column:
    """Lower case, without kind words, all but letters and digits one space."""
    bare = F.regexp_replace(F.lower(c), rf"\b({'|'.join(KIND_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def group_digits(c: Column) -> Column:
    """Thousands grouped by commas, decimals cut off."""
    return F.format_number(c.cast("long"), 0)


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def short_name(c: Column, prefix: str, short: str) -> Column:
    """``short`` for names that start with ``prefix``."""
    return F.when(c.startswith(prefix), F.lit(short)).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?i)\s+{suffix}$", ""))


def preferred_name(tags: Column, keys: tuple[str, ...] = ("name:en", "name")) -> Column:
    """The first key that a tag map has, else the empty string."""
    return F.coalesce(*[F.element_at(tags, k) for k in keys], F.lit(""))


def haversine_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    h = half(lat_b - lat_a) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_b - lon_a)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def readable_date(c: Column) -> Column:
    """``d Month yyyy`` of an ISO date; anything else as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "d MMMM yyyy"), c)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def sentence_list(items: Column) -> Column:
    """A, B and C."""
    size = F.size(items)
    return F.when(size <= 1, F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), size - 1), ", "), F.lit(" and "), F.element_at(items, -1))
    )


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def arc_id(index: Column) -> Column:
    """A negative index is its complement: the same arc walked backwards."""
    return F.when(index < 0, F.bitwise_not(index)).otherwise(index)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.when(F.trim(c) != "", c) for c in columns])
