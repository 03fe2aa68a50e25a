"""Queries of the windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as O
from ..registry import Tables, query
from .aggregates import units

_S = "select s_suppkey, s_nationkey, s_acctbal, case when s_suppkey % 17 = 0 then 'Nation ' || s_nationkey else s_name end as atom, n_name from supplier join nation on s_nationkey = n_nationkey"
_LETTERS = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"


def _seats(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("s_suppkey", "s_nationkey", "s_acctbal", F.when(F.col("s_suppkey") % 17 == 0, F.concat(F.lit("Nation "), "s_nationkey")).otherwise(F.col("s_name")).alias("atom"), "n_name")
    return O.seats(s, ["s_nationkey"], "atom", "n_name", "s_acctbal", ["s_suppkey"])


_SEATS = f"""select s_nationkey, atom, s_acctbal, own as eponymous from (select *, row_number() over (partition by s_nationkey order by own desc, case when not own then s_acctbal end desc, atom) as k
from (select *, {_LETTERS.format('atom')} = {_LETTERS.format('n_name')} as own from ({_S}))) where k = 1"""


@query("wn1_seats", f"select s_nationkey, atom, eponymous from ({_SEATS})")
def wn1(t: Tables):
    return _seats(t).select("s_nationkey", "atom", "eponymous")


@query("wn2_top", "select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part) where k <= 3")
def wn2(t: Tables):
    return O.top(t.part.select("p_brand", "p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 3, ["p_brand"])


@query("wn3_candidates", f"select s_nationkey, atom, round(s_acctbal, 2) as s_acctbal from ({_SEATS}) where s_acctbal >= 5000")
def wn3(t: Tables):
    return _seats(t).filter("s_acctbal >= 5000").orderBy(F.desc("s_acctbal"), "atom").select("s_nationkey", "atom", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("wn4_kind_order", "select o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_orderkey) as place from orders")
def wn4(t: Tables):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy(O.kind_rank(F.col("o_orderstatus"), ["P", "O"]), "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("wn5_walk_order", "select c_custkey, c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey order by r_name, n_name, c_name")
def wn5(t: Tables):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", "c_name", "n_name", "r_name").orderBy("r_name", "n_name", "c_name")


@query("wn6_ring", """select n_name, coalesce(lead(n_name) over w, first(n_name) over (partition by n_regionkey order by n_name rows between unbounded preceding and unbounded following)) as next,
coalesce(lag(n_name) over w, last(n_name) over (partition by n_regionkey order by n_name rows between unbounded preceding and unbounded following)) as previous from nation window w as (partition by n_regionkey order by n_name)""")
def wn6(t: Tables):
    return O.ring_neighbours(t.nation, ["n_regionkey"], ["n_name"], "n_name").select("n_name", "next", "previous")


@query("wn7_repeated", "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1")
def wn7(t: Tables):
    return O.repeated(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("wn8_first_seen", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1")
def wn8(t: Tables):
    return O.first_seen(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("wn9_short_names", "select p_partkey, case when count(*) over (partition by p_brand, split_part(p_name, ' ', 1)) = 1 then split_part(p_name, ' ', 1) else p_name end as shown from part")
def wn9(t: Tables):
    return O.free_short_names(t.part, "p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), ["p_brand"]).select("p_partkey", "shown")


@query("wn10_qualified", "select s_suppkey, case when count(*) over (partition by s_nationkey) > 1 then s_nationkey || ' (' || s_name || ')' else cast(s_nationkey as varchar) end as shown from supplier")
def wn10(t: Tables):
    return O.qualified(t.supplier.withColumn("tier", F.col("s_nationkey").cast("string")), "tier", "s_name").select("s_suppkey", "shown")


@query("wn11_rank_ends", "select p_brand, first(p_partkey order by p_retailprice desc, p_partkey) as largest, last(p_partkey order by p_retailprice desc, p_partkey) as smallest from part group by 1")
def wn11(t: Tables):
    return A.spread(t.part, ["p_brand"], "p_partkey", "p_retailprice").select("p_brand", "largest", "smallest")


@query("wn13_paired", "select user_id, event_id, round(nv - value, 4) as step from (select *, lead(value) over (partition by user_id order by ts, event_id) as nv, lead(1) over (partition by user_id order by ts, event_id) as l from events) where l = 1")
def wn13(t: Tables):
    return O.paired(t.events, ["user_id"], ["ts", "event_id"], ["value"]).select("user_id", "event_id", F.round(F.col("next_value") - F.col("value"), 4).alias("step"))


_P = "select distinct l_partkey from lineitem where l_suppkey % 10 = {0}"


@query("st1_compared", f"select l_partkey, 'shared' as side from ({_P.format(1)} intersect {_P.format(2)}) union all select l_partkey, 'claimed' from ({_P.format(1)} except {_P.format(2)}) union all select l_partkey, 'derived' from ({_P.format(2)} except {_P.format(1)})")
def st1(t: Tables):
    return O.compared_sets(t.lineitem.filter("l_suppkey % 10 = 1"), t.lineitem.filter("l_suppkey % 10 = 2"), "l_partkey")


@query("st2_remainder", "select s_suppkey, s_nationkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49 and l_orderkey % 97 = 0)")
def st2(t: Tables):
    return O.remainder(t.supplier.select("s_suppkey", "s_nationkey"), t.lineitem.filter("l_quantity > 49 and l_orderkey % 97 = 0").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")


_TAKEN = "select l_suppkey as s_suppkey from lineitem where l_quantity > 49 and l_orderkey % 97 = 0 union select s_suppkey from supplier where s_nationkey % 4 = 1"


def _remainders(t: Tables):
    """All nations as frames: some have no supplier, others lose all of theirs."""
    taken = t.lineitem.filter("l_quantity > 49 and l_orderkey % 97 = 0").select(F.col("l_suppkey").alias("s_suppkey")).unionByName(t.supplier.filter("s_nationkey % 4 = 1").select("s_suppkey"))
    return O.remainders(t.supplier.select("s_suppkey", "s_nationkey"), t.nation.select(F.col("n_nationkey").alias("s_nationkey")), taken, "s_nationkey", "s_suppkey")


@query("st2_left", f"select s_suppkey, s_nationkey from supplier where s_suppkey not in ({_TAKEN})")
def st2_left(t: Tables):
    return _remainders(t).ok


@query("st2_refused", f"select n_nationkey as s_nationkey, case when n_nationkey in (select s_nationkey from supplier) then 'nothing left' else 'not in the roster' end as problem from nation where n_nationkey not in (select s_nationkey from supplier where s_suppkey not in ({_TAKEN}))")
def st2_refused(t: Tables):
    return _remainders(t).rejected


@query("st3_intact_frame", "select s_suppkey, 'Frame ' || n_regionkey as unit, 'intact' as kind from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1 and s_suppkey % 3 <> 0")
def st3(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).filter("n_regionkey = 1")
    rest = O.remainder(s.select("s_suppkey", "n_regionkey"), t.supplier.filter("s_suppkey % 3 = 0"), "s_suppkey")
    return rest.select("s_suppkey", F.concat(F.lit("Frame "), "n_regionkey").alias("unit"), F.lit("intact").alias("kind"))


@query("st4_union_of_keys", "select l_orderkey as k from lineitem where l_quantity > 40 union select o_orderkey from orders where o_totalprice > 300000")
def st4(t: Tables):
    return t.lineitem.filter("l_quantity > 40").select(F.col("l_orderkey").alias("k")).union(t.orders.filter("o_totalprice > 300000").select("o_orderkey")).distinct()


@query("st5_universe", "select s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey in (0, 1, 2)")
def st5(t: Tables):
    return t.supplier.join(t.nation.filter(F.col("n_regionkey").isin(0, 1, 2)), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("st6_uncovered", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def st6(t: Tables):
    return O.remainder(t.customer.select("c_custkey"), t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("st7_same_sets", "with a as (select n_regionkey as name, string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey) as m from nation group by 1), b as (select n_regionkey as name, string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey) as m from nation where n_nationkey <> 7 group by 1) select name from a join b using (name, m)")
def st7(t: Tables):
    n = t.nation.select(F.col("n_regionkey").alias("name"), F.col("n_nationkey").alias("member"))
    return O.same_sets(n, n.filter("member <> 7"), "name", "member")


_SIDES = "select l_suppkey % 7 as unit, l_partkey as arc, count(*) as uses from lineitem group by 1, 2"
_DRAWN = "select distinct l_suppkey % 7 as unit, l_partkey as arc from lineitem where l_quantity < 20 union select 0, 1 - l_partkey from lineitem where l_partkey < 5 and l_partkey > 1"


def _outline(t: Tables):
    sides = A.arcs_by_side(t.lineitem.select((F.col("l_suppkey") % 7).alias("unit"), F.col("l_partkey").alias("arc")), "unit", "arc")
    drawn = t.lineitem.filter("l_quantity < 20").select((F.col("l_suppkey") % 7).alias("unit"), F.col("l_partkey").alias("arc"))
    drawn = drawn.union(t.lineitem.filter("l_partkey < 5 and l_partkey > 1").select(F.lit(0).cast("long"), 1 - F.col("l_partkey"))).distinct()
    return drawn, sides.filter("side = 'boundary'").select("unit", "arc"), sides.filter("side = 'interior'").select("unit", "arc")


@query("st8_outline_problems", f"""with s as ({_SIDES}), d as ({_DRAWN})
select unit, arc, 'survived' as problem from d join s using (unit, arc) where uses > 1 union all select unit, arc, 'foreign' from d anti join s using (unit, arc) union all select unit, arc, 'lost' from s anti join d using (unit, arc) where uses = 1""")
def st8(t: Tables):
    return O.outline_problems(*_outline(t), ["unit", "arc"])


@query("st9_arcs_without", f"select unit, arc from ({_SIDES}) where uses = 1 and arc not in (select l_partkey from lineitem where l_suppkey % 7 = 3)")
def st9(t: Tables):
    stop = t.lineitem.filter("l_suppkey % 7 = 3").select(F.col("l_partkey").alias("arc"))
    return O.remainder(_outline(t)[1], stop, "arc").select("unit", "arc")


@query("st10_append", "select cast(unit as varchar) as unit, cast(count(*) as bigint) as n from (select s_suppkey % 7 as unit from supplier) group by 1 union all select n_name, cast(1 as bigint) from nation where n_nationkey < 3")
def st10(t: Tables):
    own = units(t).groupBy(F.col("unit").cast("string").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(t.nation.filter("n_nationkey < 3").select(F.col("n_name").alias("unit"), F.lit(1).cast("long").alias("n")))


@query("st11_below_floor", f"select s_nationkey, atom from ({_SEATS}) where s_acctbal < 5000 and not eponymous")
def st11(t: Tables):
    return _seats(t).filter("s_acctbal < 5000 and not eponymous").select("s_nationkey", "atom")
