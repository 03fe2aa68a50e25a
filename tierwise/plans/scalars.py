"""Queries of the scalar functions and the row operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import rows as R
from ..registry import Tables, query

_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '\\b(district|division|tehsil|agency)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("sc1_normalize_name", f"select s_suppkey, {_NORM.format(chr(39) + 'The ' + chr(39) + ' || s_name || ' + chr(39) + ' District' + chr(39))} as norm from supplier")
def sc1(t: Tables):
    return t.supplier.select("s_suppkey", N.normalize_name(F.concat(F.lit("The "), "s_name", F.lit(" District"))).alias("norm"))


@query("sc2_letters", "select p_partkey, regexp_replace(lower(p_name || p_brand), '[^a-z]', '', 'g') as letters from part")
def sc2(t: Tables):
    return t.part.select("p_partkey", N.letters(F.concat("p_name", "p_brand")).alias("letters"))


@query("sc3_slug", "select p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from part")
def sc3(t: Tables):
    return t.part.select("p_partkey", N.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("sc4_group_digits", "select o_orderkey, format('{:,}', cast(trunc(o_totalprice) as bigint)) as shown from orders")
def sc4(t: Tables):
    return t.orders.select("o_orderkey", N.group_digits(F.col("o_totalprice")).alias("shown"))


@query("sc5_percent", "select c_custkey, printf('%.1f%%', ((c_custkey % 1000) / 1000.0 + 0.0003) * 100) as shown from customer")
def sc5(t: Tables):
    return t.customer.select("c_custkey", N.percent((F.col("c_custkey") % 1000) / 1000.0 + 0.0003).alias("shown"))


@query("sc6_short_name", "select p_partkey, case when starts_with(p_name, 'red ') then 'Red' else p_name end as short from part")
def sc6(t: Tables):
    return t.part.select("p_partkey", N.short_name(F.col("p_name"), "red ", "Red").alias("short"))


@query("sc7_strip_suffix", r"select s_suppkey, trim(regexp_replace(s_name || '  DIVISION', '\s+Division$', '', 'i')) as bare from supplier")
def sc7(t: Tables):
    return t.supplier.select("s_suppkey", N.strip_suffix(F.concat("s_name", F.lit("  DIVISION")), "Division").alias("bare"))


@query("sc8_preferred_name", "select s_suppkey, case when s_suppkey % 3 = 0 then 'En ' || s_name when s_suppkey % 3 = 1 then s_name else '' end as name from supplier")
def sc8(t: Tables):
    key = F.col("s_suppkey") % 3
    tags = F.map_filter(
        F.create_map(F.lit("name:en"), F.when(key == 0, F.concat(F.lit("En "), "s_name")), F.lit("name"), F.when(key <= 1, F.col("s_name"))), lambda k, v: v.isNotNull()
    )
    return t.supplier.select("s_suppkey", N.preferred_name(tags).alias("name"))


@query(
    "sc9_haversine",
    """with p as (select s_suppkey, 60 + (s_suppkey * 37 % 200) / 10.0 as x, 24 + (s_suppkey * 53 % 130) / 10.0 as y from supplier)
select s_suppkey, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(30 - y) / 2), 2) + cos(radians(y)) * cos(radians(30)) * pow(sin(radians(70 - x) / 2), 2)))), 4) as km from p""",
)
def sc9(t: Tables):
    x, y = 60 + (F.col("s_suppkey") * 37 % 200) / 10.0, 24 + (F.col("s_suppkey") * 53 % 130) / 10.0
    return t.supplier.select("s_suppkey", F.round(N.haversine_km(x, y, F.lit(70.0), F.lit(30.0)), 4).alias("km"))


@query(
    "sc10_readable_date",
    "select o_orderkey, case when o_orderkey % 10 = 0 then 'unknown' else strftime(o_orderdate, '%-d %B %Y') end as shown from orders",
)
def sc10(t: Tables):
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", N.readable_date(text).alias("shown"))


@query(
    "sc11_sentence_list",
    """with n as (select n_regionkey, list(n_name order by n_name) as a from nation group by 1)
select n_regionkey, case when len(a) = 1 then a[1] else array_to_string(a[1:len(a) - 1], ', ') || ' and ' || a[len(a)] end as names,
len(a) || case when len(a) = 1 then ' nation' else ' nations' end as size from n""",
)
def sc11(t: Tables):
    n = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("a"))
    return n.select("n_regionkey", N.sentence_list(F.col("a")).alias("names"), N.plural(F.size("a"), "nation").alias("size"))


@query(
    "sc12_arithmetic",
    "select p_partkey, round(least(greatest(p_retailprice, 950), 1500), 2) as clamped, cast(floor(p_retailprice / 7) as bigint) as whole, round(sqrt(p_retailprice), 6) as root, abs(p_size - 25) as away from part",
)
def sc12(t: Tables):
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", F.round(N.clamp(price, 950.0, 1500.0), 2).alias("clamped"), F.floor(price / 7).alias("whole"), F.round(F.sqrt(price), 6).alias("root"), F.abs(F.col("p_size") - 25).alias("away"))


@query(
    "sc13_arrays",
    """with a as (select n_regionkey, list(distinct n_nationkey % 4 order by n_nationkey % 4) as d from nation group by 1)
select n_regionkey, array_to_string(d, ',') as distinct_sorted, list_contains(d, 2) as has_two, d[1] as first, array_to_string(d[2:3], ',') as part from a""",
)
def sc13(t: Tables):
    a = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.array_distinct(F.collect_list(F.col("n_nationkey") % 4))).alias("d"))
    return a.select("n_regionkey", F.array_join(F.col("d").cast("array<string>"), ",").alias("distinct_sorted"), F.array_contains("d", 2).alias("has_two"), F.element_at("d", 1).alias("first"), F.array_join(F.slice("d", 2, 2).cast("array<string>"), ",").alias("part"))


@query("sc14_arc_id", "select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 2 = 0 then l_partkey else l_partkey end as arc from lineitem")
def sc14(t: Tables):
    index = F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).otherwise(F.bitwise_not(F.col("l_partkey")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.arc_id(index).alias("arc"))


@query(
    "sc15_maps",
    "select n_regionkey, min(case when n_nationkey = n_regionkey then n_name end) as looked_up, count(*) as entries from nation group by 1",
)
def sc15(t: Tables):
    m = t.nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return m.select("n_regionkey", F.try_element_at("m", F.col("n_regionkey")).alias("looked_up"), F.size(F.map_entries("m")).cast("long").alias("entries"))


@query("sc16_json", "select event_id, cast(props->>'$.k' as bigint) as k, '{\"k\":' || (props->>'$.k') || '}' as emitted from events")
def sc16(t: Tables):
    parsed = F.from_json("props", "struct<k: long>")
    return t.events.select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("emitted"))


@query("prj1_required_count", "select l_orderkey, l_linenumber, l_partkey, l_quantity, l_quantity is not null and l_quantity >= 0 and l_quantity = floor(l_quantity) as ok from lineitem")
def prj1(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", R.is_count(F.col("l_quantity")).alias("ok"))


@query("prj2_optional_count", "select l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) is null or (l_discount * 100 >= 0 and round(l_discount * 100, 6) % 2 = 0) as ok from lineitem")
def prj2(t: Tables):
    half = F.round(F.nullif("l_discount", F.lit(0.0)) * 100, 6) / 2
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", R.is_optional_count(half).alias("ok"))


@query("prj3_required_text", "select count(*) filter (length(trim(p_name)) > 0) as kept, count(*) filter (coalesce(length(trim(p_name)), 0) = 0) as rejected from part")
def prj3(t: Tables):
    split = R.split_rows(t.part, R.is_text(F.col("p_name")))
    sides = split.ok.select(F.lit(True).alias("ok")).unionByName(split.rejected.select(F.lit(False).alias("ok")))
    return sides.agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("rejected"))


@query("prj3_tagged", "select p_partkey, case when not coalesce(p_size - 1 >= 0 and p_size - 1 = floor(p_size - 1), false) then 'size' when not coalesce(length(trim(p_name)) > 0, false) then 'name' when not coalesce(p_brand <> 'Brand#13', false) then 'brand' when floor(p_retailprice) < 0 then 'price' else 'ok' end as tag from part")
def prj3_tagged(t: Tables):
    """Each part with the first rule that it breaks, in one pass over the table."""
    rules = {"size": R.is_count(F.col("p_size") - 1), "name": R.is_text(F.col("p_name")), "brand": F.col("p_brand") != "Brand#13", "price": R.is_optional_count(F.floor("p_retailprice"))}
    return R.tagged(t.part, rules).select("p_partkey", "tag")


@query("prj4_scan_filter", "select event_id, event_type, value from events where event_type in ('click', 'view')")
def prj4(t: Tables):
    return R.only(t.events, "event_type", ["click", "view"]).select("event_id", "event_type", "value")


@query("prj5_drop_rollups", "select o_orderkey, o_orderpriority from orders where o_orderpriority <> '4-NOT SPECIFIED' and not (o_orderstatus = 'P' and o_orderpriority <> '1-URGENT')")
def prj5(t: Tables):
    total = (F.col("o_orderpriority") == "4-NOT SPECIFIED") | ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") != "1-URGENT"))
    return R.without_rollups(t.orders, total).select("o_orderkey", "o_orderpriority")


@query("prj6_bounds", "select min(value) as least, count(*) as inside from events where value between 5 and 20 and user_id between 3 and 40")
def prj6(t: Tables):
    return R.inside(t.events, {"value": (5, 20), "user_id": (3, 40)}).agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("inside"))


_PARTS = "select l_partkey as atom, count(*) filter (l_returnflag = 'R') as num, count(*) - case when l_partkey % 50 = 0 then count(*) when l_partkey % 51 = 0 then greatest(count(*) - 1, 0) else 0 end as den from lineitem group by 1"


def _parts(t: Tables):
    den = F.count(F.lit(1)) - F.when(F.col("atom") % 50 == 0, F.count(F.lit(1))).when(F.col("atom") % 51 == 0, F.greatest(F.count(F.lit(1)) - 1, F.lit(0))).otherwise(0)
    return t.lineitem.groupBy(F.col("l_partkey").alias("atom")).agg(F.count_if(F.col("l_returnflag") == "R").alias("num"), den.alias("den"))


@query("prj7_guarded_ratio", f"select atom, num, den, case when den > 0 and num between 0 and den then num / den end as ratio, not (den > 0 and num between 0 and den) as impossible from ({_PARTS})")
def prj7(t: Tables):
    return R.guarded_ratio(_parts(t), "num", "den")


@query(
    "prj8_parts_sum",
    "select l_partkey as atom, count(*) filter (l_returnflag = 'R') as r, count(*) filter (l_returnflag = 'A') as a, count(*) as total from lineitem group by 1 having count(*) filter (l_returnflag in ('R', 'A')) <> count(*)",
)
def prj8(t: Tables):
    p = t.lineitem.groupBy(F.col("l_partkey").alias("atom")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count(F.lit(1)).alias("total"))
    return R.parts_off(p, ["r", "a"], "total")


@query("prj9_rounding", "select atom, round(num / 7.0, 6) as share, round(num / 3.0, 1) as ratio from (select l_partkey as atom, count(*) as num from lineitem group by 1)")
def prj9(t: Tables):
    p = t.lineitem.groupBy(F.col("l_partkey").alias("atom")).agg(F.count(F.lit(1)).alias("num"))
    return p.select("atom", F.round(F.col("num") / 7.0, 6).alias("share"), F.round(F.col("num") / 3.0, 1).alias("ratio"))


@query("prj10_withheld", "select o_orderkey, o_orderstatus, case when o_orderstatus <> 'P' then o_totalprice end as shown from orders")
def prj10(t: Tables):
    return t.orders.select("o_orderkey", "o_orderstatus", R.withheld(F.col("o_totalprice"), F.col("o_orderstatus") == "P").alias("shown"))
