"""Queries of the spatial operators. A user's events are a path; a nation is a cell of a grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as S
from ..registry import Tables, query


def path(t: Tables):
    """A vertex per event: x in minutes of its hour, y its value."""
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", seq.alias("seq"), F.minute("ts").cast("double").alias("x"), (F.least("value", F.lit(80.0))).alias("y"))


_PATH = "select user_id, row_number() over (partition by user_id order by ts, event_id) as seq, cast(minute(ts) as double) as x, least(value, 80) as y from events"
_EDGE = f"select *, lead(x) over w as nx, lead(y) over w as ny, lead(1) over w as l from ({_PATH}) window w as (partition by user_id order by seq)"


@query("ag23_doubled_area", f"select user_id, round(sum(x * ny - nx * y), 2) as doubled from ({_EDGE}) where l = 1 group by 1")
def ag23(t: Tables):
    return S.doubled_areas(path(t), ["user_id"]).withColumn("doubled", F.round("doubled", 2))


@query("ag24_length", f"select user_id, round(sum(sqrt(pow(radians(nx - x) * cos(radians((y + ny) / 2)), 2) + pow(radians(ny - y), 2))) * 6371, 2) as km from ({_EDGE}) where l = 1 group by 1")
def ag24(t: Tables):
    return S.lengths_km(path(t), ["user_id"]).withColumn("km", F.round("km", 2))


@query("sc17_spherical_area", f"select user_id, round(abs(sum(radians(nx - x) * (2 + sin(radians(y)) + sin(radians(ny)))) * 6371.0 * 6371.0 / 2), 0) as km2 from ({_EDGE}) where l = 1 group by 1")
def sc17(t: Tables):
    return S.spherical_areas(path(t), ["user_id"]).withColumn("km2", F.round("km2", 0))


@query("ag25_bounds", f"select user_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from ({_PATH}) group by 1")
def ag25(t: Tables):
    return S.bounds(path(t), ["user_id"])


def cells(t: Tables):
    """Nation k is the square at (k mod 5, k div 5); nations divisible by 4 have a hole in the middle."""
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")

    def ring(n: int, low: float, high: float):
        corner = [(low, low), (high, low), (high, high), (low, high), (low, low)]
        return [F.struct(F.lit(n).alias("ring"), F.lit(i).alias("seq"), (x + a).alias("x"), (y + b).alias("y")) for i, (a, b) in enumerate(corner)]

    rows = F.when(k % 4 == 0, F.array(*ring(0, 0.0, 1.0), *ring(1, 0.25, 0.75))).otherwise(F.array(*ring(0, 0.0, 1.0)))
    return t.nation.select(F.col("n_name").alias("geom"), F.explode(rows).alias("v")).select("geom", "v.*")


def spots(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), ((k * 37 % 1201) / 200.0 + 0.0013).alias("x"), ((k * 53 % 1103) / 200.0 + 0.0017).alias("y"))


_SPOTS = "select c_custkey as id, (c_custkey * 37 % 1201) / 200.0 + 0.0013 as x, (c_custkey * 53 % 1103) / 200.0 + 0.0017 as y from customer"


_LOCATED = f"""select id, n_name as geom from ({_SPOTS}) left join nation on floor(x) = n_nationkey % 5 and x < 5 and floor(y) = n_nationkey // 5
and not (n_nationkey % 4 = 0 and x - floor(x) between 0.25 and 0.75 and y - floor(y) between 0.25 and 0.75)"""


@query("jn23_located", _LOCATED)
def jn23(t: Tables):
    return S.located(spots(t), cells(t), t.nation.select(F.col("n_name").alias("geom"), F.col("n_nationkey").alias("pos")), 1.0).select("id", "geom")


@query("jn23_dense", _LOCATED)
def jn23_dense(t: Tables):
    """The same with a grid that follows the points."""
    return S.located(spots(t), cells(t), t.nation.select(F.col("n_name").alias("geom"), F.col("n_nationkey").alias("pos"))).select("id", "geom")


@query("ag22_parity", f"select id, n_name as geom from ({_SPOTS}) join nation on floor(x) = n_nationkey % 5 and x < 5 and floor(y) = n_nationkey // 5")
def ag22(t: Tables):
    return S.points_in_rings(spots(t), cells(t).filter("ring = 0"), ["geom"], 1.0)


def ways(t: Tables):
    """Orders of a customer follow one another: a way runs from one order to the next."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select(F.col("o_orderkey").alias("ref"), F.col("o_orderkey").alias("first"), F.coalesce(F.lead("o_orderkey").over(w), F.when(F.col("o_custkey") % 4 == 0, F.first("o_orderkey").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))), -F.col("o_orderkey") - 1).alias("last"))


@query("g18_directed_chains", "select o_orderkey as ref, min(o_orderkey) over (partition by o_custkey) as chain, row_number() over (partition by o_custkey order by o_orderkey) - 1 as rank, o_custkey % 4 = 0 as closed from orders")
def g18(t: Tables):
    return S.directed_chains(ways(t))[0]


@query("g17_chains", "select o_orderkey as ref, min(o_orderkey) over (partition by o_custkey) as chain, case when o_custkey % 4 = 0 then -1 else row_number() over (partition by o_custkey order by o_orderkey) - 1 end as rank, o_custkey % 4 = 0 as closed from orders")
def g17(t: Tables):
    """Ranks around a ring depend on the direction taken, so they are shown for open chains only."""
    flip = F.col("ref") % 2 == 0
    w = ways(t).select("ref", F.when(flip, F.col("last")).otherwise(F.col("first")).alias("first"), F.when(flip, F.col("first")).otherwise(F.col("last")).alias("last"))
    return S.undirected_chains(w)[0].withColumn("rank", F.when(F.col("closed"), F.lit(-1)).otherwise(F.col("rank")).cast("long"))


@query("g19_hole_owners", "select n_name as hole, n_name as outer from nation where n_nationkey % 4 = 0")
def g19(t: Tables):
    c = cells(t)
    owned = S.hole_owners(c.filter("ring = 1"), c.filter("ring = 0"), ["geom", "ring"], 1.0)
    return owned.select(F.col("id.geom").alias("hole"), F.col("outer.geom").alias("outer"))


_OPEN = "n_nationkey % 5 = 4"


@query("g19_stitched", f"select n_name as geom, case when {_OPEN} then 0 else 1 end as rings, case when {_OPEN} then 1 else 0 end as unclosed, case when {_OPEN} then 0.0 else 1.0 end as area from nation")
def g19_stitched(t: Tables):
    """Each outline in three fragments, the second one reversed; some lack their last fragment."""
    n = t.nation.select(F.col("n_name").alias("geom"), F.col("n_nationkey").alias("k"))
    c = cells(t).filter("ring = 0").join(n, "geom")
    part = lambda i, low, high: c.filter(F.col("seq").between(low, high)).select("geom", (F.col("k") * 3 + i).alias("ref"), (F.lit(high) - F.col("seq") if i == 1 else F.col("seq") - low).alias("seq"), "x", "y", "k")
    fragments = part(0, 0, 1).unionByName(part(1, 1, 3)).unionByName(part(2, 3, 4).filter("k % 5 <> 4")).drop("k")
    rings, counts, _ = S.stitched(fragments, ["geom"])
    area = S.doubled_areas(rings, ["geom", "ring"]).groupBy("geom").agg(F.sum(F.abs("doubled") / 2).alias("area"))
    return counts.join(area, "geom", "left").select("geom", F.col("rings").cast("int").alias("rings"), F.col("unclosed").cast("int").alias("unclosed"), F.coalesce("area", F.lit(0.0)).alias("area"))


@query("g20_sides", "select n_name as geom, 'island' as side from nation where n_nationkey % 5 <= 2 and n_nationkey % 2 = 0 union all select n_name, 'water' from nation where n_nationkey % 5 <= 2 and n_nationkey % 2 = 1")
def g20(t: Tables):
    odd = t.nation.select(F.col("n_name").alias("geom"), F.col("n_nationkey"))
    c = cells(t).filter("ring = 0").join(odd, "geom").withColumn("seq", F.when(F.col("n_nationkey") % 2 == 1, 4 - F.col("seq")).otherwise(F.col("seq")))
    return S.sides_of_land(c.select("geom", "seq", "x", "y"), ["geom"], (0.0, 2.5, 0.0, 9.0)).select("geom", "side")


@query("ag23b_oriented", "select n_name as geom, 2.0 as doubled from nation")
def ag23b(t: Tables):
    odd = t.nation.select(F.col("n_name").alias("geom"), F.col("n_nationkey"))
    c = cells(t).filter("ring = 0").join(odd, "geom").withColumn("seq", F.when(F.col("n_nationkey") % 2 == 1, 4 - F.col("seq")).otherwise(F.col("seq")))
    return S.doubled_areas(S.oriented(c.select("geom", "seq", "x", "y"), ["geom"]), ["geom"])
