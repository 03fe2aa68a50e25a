"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..registry import Tables, query

NAMED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
RESIDUAL = "4-NOT SPECIFIED"


def placed_customers(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))


def placed_lines(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey"))


_PLACED = "lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@query("ag1_sum_by_tier", "select r_name, n_name, count(*) as people, round(sum(c_acctbal), 2) as c_acctbal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def ag1(t: Tables):
    rows = placed_customers(t).withColumn("people", F.lit(1).cast("long"))
    return A.sums_by(rows, ["r_name", "n_name"], ["people", "c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("ag2_sum_by_frame", "select r_name, round(sum(s_acctbal), 2) as s_acctbal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where n_nationkey < 20 group by 1")
def ag2(t: Tables):
    roster = t.nation.filter("n_nationkey < 20").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.supplier.join(roster, F.col("s_nationkey") == F.col("n_nationkey"))
    return A.sums_by(rows, ["r_name"], ["s_acctbal"]).withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("ag3_categories_by_frame", "select user_id % 5 as frame, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'purchase') as purchase from events group by 1")
def ag3(t: Tables):
    users = A.category_pivot(t.events.withColumn("one", F.lit(1).cast("long")), "user_id", "event_type", "one", ["click", "view", "purchase"])
    return A.sums_by(users.withColumn("frame", F.col("user_id") % 5), ["frame"], ["click", "view", "purchase"])


@query("ag4_measures_by_frame", f"select n_name, round(sum(l_quantity), 2) as l_quantity, round(sum(l_extendedprice), 2) as l_extendedprice, round(sum(l_tax), 2) as l_tax from {_PLACED} group by 1")
def ag4(t: Tables):
    m = ["l_quantity", "l_extendedprice", "l_tax"]
    return A.sums_by(placed_lines(t), ["n_name"], m).withColumns({c: F.round(c, 2) for c in m})


@query("ag5_tiers", f"select r_name, n_name, round(sum(l_quantity), 2) as l_quantity, cast(2 - (grouping(r_name) + grouping(n_name)) as integer) as level from {_PLACED} group by rollup(r_name, n_name)")
def ag5(t: Tables):
    return A.tiers(placed_lines(t), ["r_name", "n_name"], ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 2))


@query("ag6_indicator_sums", "select user_id, round(sum(case when event_type = 'click' then coalesce(value, 0) end), 2) as click, coalesce(bool_or(event_type = 'click'), false) as has_click, round(sum(case when event_type = 'refund' then coalesce(value, 0) end), 2) as refund, coalesce(bool_or(event_type = 'refund'), false) as has_refund from events group by 1")
def ag6(t: Tables):
    return A.indicator_sums(t.events, "user_id", "event_type", "value", ["click", "refund"]).withColumns({c: F.round(c, 2) for c in ("click", "refund")})


@query("ag7_category_pivot", "select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'refund') as refund from events group by 1")
def ag7(t: Tables):
    return A.category_pivot(t.events.withColumn("one", F.lit(1).cast("long")), "user_id", "event_type", "one", ["click", "refund"])


@query("ag8_row_total", "select user_id, count(*) filter (event_type in ('click', 'view')) as total from events group by 1")
def ag8(t: Tables):
    p = A.category_pivot(t.events.withColumn("one", F.lit(1).cast("long")), "user_id", "event_type", "one", ["click", "view"])
    return p.select("user_id", A.row_total(["click", "view"]).alias("total"))


def by_priority(t: Tables):
    return A.category_pivot(t.orders.withColumn("one", F.lit(1).cast("long")), "o_custkey", "o_orderpriority", "one", [*NAMED, RESIDUAL])


def dominants(t: Tables):
    return by_priority(t).withColumn("dominant", A.dominant([f"`{c}`" for c in NAMED], f"`{RESIDUAL}`")).withColumn("dominant", F.translate("dominant", "`", ""))


_DOM = """select o_custkey, a, b, c, d, r, greatest(a, b, c, d) as best, case when r <= greatest(a, b, c, d) then case greatest(a, b, c, d) when a then '1-URGENT' when b then '2-HIGH' when c then '3-MEDIUM' else '5-LOW' end end as dominant from (
select o_custkey, count(*) filter (o_orderpriority = '1-URGENT') as a, count(*) filter (o_orderpriority = '2-HIGH') as b, count(*) filter (o_orderpriority = '3-MEDIUM') as c, count(*) filter (o_orderpriority = '5-LOW') as d, count(*) filter (o_orderpriority = '4-NOT SPECIFIED') as r from orders group by 1)"""


@query("ag9_dominant", f"select o_custkey, dominant from ({_DOM})")
def ag9(t: Tables):
    return dominants(t).select("o_custkey", "dominant")


@query("ag10_dominant_share", f"select o_custkey, case when dominant is not null then round(best / (a + b + c + d + r), 6) end as share, round(r / (a + b + c + d + r), 6) as residual from ({_DOM})")
def ag10(t: Tables):
    d = dominants(t)
    total = A.row_total([f"`{c}`" for c in [*NAMED, RESIDUAL]])
    best = F.greatest(*[F.col(f"`{c}`") for c in NAMED])
    return d.select("o_custkey", F.round(F.when(F.col("dominant").isNotNull(), A.share_of(best, total)), 6).alias("share"), F.round(A.share_of(F.col(f"`{RESIDUAL}`"), total), 6).alias("residual"))


@query("ag11_collisions", "select p_brand, string_agg(distinct p_type, ',' order by p_type) as names from part group by 1 having count(distinct p_type) > 1")
def ag11(t: Tables):
    return J.collisions(t.part, "p_brand", "p_type").select("p_brand", F.array_join("names", ",").alias("names"))


_RATES = "select p_partkey as atom, p_size / 50.0 as a, (p_partkey % 97) / 96.0 as b, case when p_partkey % 101 = 0 then 1.5 else (p_partkey % 31) / 30.0 end as c from part"


def rates(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(k.alias("atom"), (F.col("p_size") / 50.0).alias("a"), ((k % 97) / 96.0).alias("b"), F.when(k % 101 == 0, 1.5).otherwise((k % 31) / 30.0).alias("c"))


_BANDS = "(values ('low', 0.0, 0.35), ('middle', 0.35, 0.5), ('high', 0.5, 0.8), ('top', 0.8, 0.95), ('peak', 0.95, 1.0000001)) b(band, f, t)"


def bands(t: Tables):
    return t.spark.createDataFrame([("low", 0.0, 0.35), ("middle", 0.35, 0.5), ("high", 0.5, 0.8), ("top", 0.8, 0.95), ("peak", 0.95, 1.0000001)], "band string, `from` double, `to` double")


def indexed(t: Tables):
    return rates(t).withColumn("score", A.index_of(["a", "b", "c"]))


_INDEX = f"select atom, case when a between 0 and 1 and b between 0 and 1 and c between 0 and 1 then round((a + b + c) / 3, 6) end as score from ({_RATES})"


@query("ag12_index", _INDEX)
def ag12(t: Tables):
    return indexed(t).select("atom", "score")


@query("ag13_index_rejects", f"select atom, a, b, c from ({_RATES}) where not (a between 0 and 1 and b between 0 and 1 and c between 0 and 1)")
def ag13(t: Tables):
    return indexed(t).filter("score is null").select("atom", "a", "b", "c")


@query("ag14_bands", f"select atom, score, band from ({_INDEX}) left join {_BANDS} on score >= f and score < t")
def ag14(t: Tables):
    return A.banded(indexed(t).select("atom", "score"), "score", bands(t))


@query("ag14_outside", f"select atom, score from ({_INDEX}) where not exists (select 1 from {_BANDS} where score >= f and score < t)")
def ag14_outside(t: Tables):
    """Rows that no band holds, as an output; ``rows.strict`` makes them an error."""
    return A.split_by_band(indexed(t).select("atom", "score"), "score", bands(t)).rejected


@query("ag15_band_counts", f"select band, count(score) as rows from {_BANDS} left join ({_INDEX}) on score >= f and score < t group by 1")
def ag15(t: Tables):
    return A.band_counts(A.banded(indexed(t), "score", bands(t)), bands(t)).select("band", "rows")


@query("ag16_extremes", f"""with l as (select atom, 'a' as measure, a as v from ({_RATES}) union all select atom, 'b', b from ({_RATES}))
select measure, first(atom order by v, atom) as lowest, first(atom order by v desc, atom) as highest from l group by 1""")
def ag16(t: Tables):
    return A.extremes(rates(t), "atom", ["a", "b"])


UNITS = "select s_suppkey as atom, s_suppkey % 7 as unit, case when s_suppkey % 7 = 6 or s_suppkey = 8 then null else s_suppkey + 1 end as v, s_nationkey % 5 as frame, s_nationkey from supplier"


def units(t: Tables):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("atom"), (k % 7).alias("unit"), F.when((k % 7 == 6) | (k == 8), None).otherwise(k + 1).alias("v"), (F.col("s_nationkey") % 5).alias("frame"), "s_nationkey")


_SUMS = f"select unit, case when count(v) = count(*) then cast(sum(v) as bigint) end as total, coalesce(string_agg(case when v is null then cast(atom as varchar) end, ',' order by atom), '') as lacking, count(*) as members, count(*) - count(v) as gone from ({UNITS}) group by 1"


@query("ag17_complete_sums", f"select unit, total, lacking, members from ({_SUMS})")
def ag17(t: Tables):
    return A.complete_sums(units(t), "unit", "atom", "v").withColumn("lacking", F.array_join(F.col("lacking").cast("array<string>"), ","))


@query("ag18_moved", f"select frame as origin, count(*) as moved from ({UNITS}) where frame <> unit % 5 group by 1")
def ag18(t: Tables):
    return A.moved(units(t), F.col("unit") % 5, F.col("frame")).groupBy(F.col("frame").alias("origin")).agg(F.count(F.lit(1)).alias("moved"))


@query("ag19_spread", f"select count(*) as units, cast(sum(total) as bigint) as total, first(unit order by total desc, unit) as largest, last(unit order by total desc, unit) as smallest, case when count(*) >= 2 then round(max(total) / min(total), 1) end as ratio from ({_SUMS}) where total is not null")
def ag19(t: Tables):
    return A.spread(A.complete_sums(units(t), "unit", "atom", "v"), [], "unit", "total")


@query("ag20_withholding", f"""with v as (select x as variant, u.*, x = 2 as policy from ({_SUMS}) u, (values (0), (1), (2), (3)) n(x) where x <> 1 or unit <> 1 and x <> 3 or x = 3 and unit = 6)
select variant, case when bool_or(policy) then 'variant' when bool_or(gone > 0 and gone < members) then 'incomplete' when count(total) = 0 then 'uncounted' end as withheld, coalesce(string_agg(case when gone = members then cast(unit as varchar) end, ',' order by unit), '') as set_aside
from v where variant <> 3 or unit = 6 group by 1""")
def ag20(t: Tables):
    v = A.complete_sums(units(t), "unit", "atom", "v").withColumn("variant", F.explode(F.array(*[F.lit(x) for x in range(4)])))
    v = v.filter("not (variant = 1 and unit = 1) and (variant <> 3 or unit = 6)").withColumn("policy", F.col("variant") == 2)
    return A.withholding(v, "variant", "policy").withColumn("set_aside", F.array_join(F.col("set_aside").cast("array<string>"), ","))


@query("ag21_measured_area", f"select count(total) as units, cast(sum(total) as bigint) as total from ({_SUMS})")
def ag21(t: Tables):
    return A.complete_sums(units(t), "unit", "atom", "v").agg(F.count("total").alias("units"), F.sum("total").alias("total"))


@query("ag26_incidence_counts", "select l_partkey, count(distinct l_orderkey) as owners, count(*) as uses from lineitem group by 1")
def ag26(t: Tables):
    return A.incidence_counts(t.lineitem, "l_partkey", "l_orderkey")


@query("ag27_sides", "select l_suppkey % 7 as unit, l_partkey, count(*) as uses, case when count(*) = 1 then 'boundary' else 'interior' end as side from lineitem group by 1, 2")
def ag27(t: Tables):
    return A.arcs_by_side(t.lineitem.withColumn("unit", F.col("l_suppkey") % 7), "unit", "l_partkey")


@query("ag30_units_per_frame", f"select frame, count(distinct unit) as units from ({UNITS}) group by 1")
def ag30(t: Tables):
    return units(t).select("frame", "unit").distinct().groupBy("frame").agg(F.count(F.lit(1)).alias("units"))


@query("ag31_composition", "select c_nationkey, c_mktsegment, count(*) as rows, round(count(*) / sum(count(*)) over (partition by c_nationkey), 6) as share from customer group by 1, 2")
def ag31(t: Tables):
    return A.composition(t.customer, "c_nationkey", "c_mktsegment")


@query("ag32_framed_units", "select 1 as variant, s_nationkey as unit, min(n_regionkey) as frame from supplier join nation on s_nationkey = n_nationkey group by 2")
def ag32(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.lit(1).alias("variant"), F.col("s_nationkey").alias("unit"), F.col("n_regionkey").alias("frame")).unionByName(s.select(F.lit(2).alias("variant"), (F.col("s_nationkey") % 3).alias("unit"), F.col("n_regionkey").alias("frame")))
    return A.framed_units(rows, "variant", "unit", "frame")


@query("ag33_conditional_counts", f"select count(distinct unit) as units, count(distinct case when unit < 3 then unit end) as proposed, count(*) filter (v is not null) as claimed from ({UNITS})")
def ag33(t: Tables):
    return units(t).agg(F.count_distinct("unit").alias("units"), F.count_distinct(F.when(F.col("unit") < 3, F.col("unit"))).alias("proposed"), F.count_if(F.col("v").isNotNull()).alias("claimed"))


@query("ag34_frame_counts", "select n_regionkey as frame, count(*) as ours, cast(case when n_regionkey = 0 then 4 else 5 end as bigint) as published, count(*) = case when n_regionkey = 0 then 4 else 5 end as agrees from nation group by 1")
def ag34(t: Tables):
    ours = t.nation.groupBy(F.col("n_regionkey").alias("frame")).agg(F.count(F.lit(1)).alias("ours"))
    theirs = t.region.select(F.col("r_regionkey").alias("frame"), F.when(F.col("r_regionkey") == 0, 4).otherwise(5).cast("long").alias("published"))
    return ours.join(theirs, "frame", "full_outer").withColumn("agrees", F.col("ours").eqNullSafe(F.col("published")))


@query("ag35_subset_deviation", "select 'young' as subset, round(sum(s_acctbal) filter (s_suppkey < 50), 2) as ours, 250000.0 as published, round((sum(s_acctbal) filter (s_suppkey < 50) / 250000.0 - 1) * 100, 4) as percent from supplier union all select 'even', round(sum(s_acctbal) filter (s_suppkey % 2 = 0), 2), 200000.0, round((sum(s_acctbal) filter (s_suppkey % 2 = 0) / 200000.0 - 1) * 100, 4) from supplier")
def ag35(t: Tables):
    k = F.col("s_suppkey")
    return A.subset_deviation(t.supplier, "s_acctbal", {"young": k < 50, "even": k % 2 == 0}, {"young": 250000, "even": 200000}).withColumn("ours", F.round("ours", 2))


@query("ag36_changes", "select l_orderkey, round(sum(l_quantity), 2) as before, round(sum(l_quantity * (1 - l_discount)), 2) as after, round(sum(l_quantity * (1 - l_discount)) - sum(l_quantity), 2) as change from lineitem group by 1 having abs(sum(l_quantity * (1 - l_discount)) - sum(l_quantity)) > 1.00001")
def ag36(t: Tables):
    rows = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("b"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("a"))
    return A.changes(rows, "l_orderkey", "b", "a", 1.00001).withColumns({c: F.round(c, 2) for c in ("before", "after", "change")})


@query("ag37_fraction_cut", "with r as (select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice) as k, count(*) over (partition by l_returnflag) as n from lineitem) select l_returnflag, l_extendedprice as cut from r where k = floor(0.3 * (n - 1)) + 1")
def ag37(t: Tables):
    return A.kept_fraction_cut(t.lineitem, "l_returnflag", "l_extendedprice", 0.7)


@query("ag38_presence", f"select category, category in (select dominant from ({_DOM}) where dominant is not null) as dominates from (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('5-LOW'), ('6-NEVER')) c(category)")
def ag38(t: Tables):
    listed = t.spark.createDataFrame([(c,) for c in [*NAMED, "6-NEVER"]], "category string")
    return A.presence(listed, dominants(t).select(F.col("dominant").alias("category")), "category")


@query("ag39_no_dominant", f"select o_custkey, round(r / (a + b + c + d + r), 6) as residual from ({_DOM}) where dominant is null")
def ag39(t: Tables):
    total = A.row_total([f"`{c}`" for c in [*NAMED, RESIDUAL]])
    return dominants(t).filter("dominant is null").select("o_custkey", F.round(F.col(f"`{RESIDUAL}`") / total, 6).alias("residual")).orderBy(F.desc("residual"), "o_custkey")


@query("ag40_names_by_kind", "select o_orderstatus as kind, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as names, count(*) as heads from orders group by 1")
def ag40(t: Tables):
    g = t.orders.groupBy(F.col("o_orderstatus").alias("kind")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("names"), F.count(F.lit(1)).alias("heads"))
    return g.withColumn("names", F.array_join("names", ","))


@query("jn29_status", f"select c_custkey, dominant as category, case when o_custkey is null then 'no-data' when dominant is null then 'no-dominant' else 'category' end as status from customer left join ({_DOM}) on c_custkey = o_custkey")
def jn29(t: Tables):
    d = dominants(t).select(F.col("o_custkey").alias("c_custkey"), "dominant")
    return J.statuses(t.customer.select("c_custkey"), d, "c_custkey", "dominant")
