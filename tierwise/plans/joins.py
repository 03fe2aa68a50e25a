"""Queries of the joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import rows as R
from ..operators.spatial import box_pairs, near_pairs
from ..registry import Tables, query

_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '\\b(district|division|tehsil|agency)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_SRC = "select n_nationkey as id, case n_nationkey % 4 when 0 then n_name when 1 then lower(n_name) || ' District' when 2 then 'N.' || n_nationkey else 'Unknown ' || n_nationkey end as name from nation"
_ALIAS = "select 'n ' || n_nationkey as norm_key, n_name as canonical from nation where n_nationkey < 20"


def _roster(t: Tables):
    r = t.region.select("r_regionkey", F.col("r_name").alias("frame"))
    return t.nation.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("atom"), "frame")


def _source(t: Tables):
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lower("n_name"), F.lit(" District"))).when(k % 4 == 2, F.concat(F.lit("N."), k)).otherwise(F.concat(F.lit("Unknown "), k))
    return t.nation.select(k.cast("long").alias("id"), name.alias("name"))


def _aliases(t: Tables):
    return t.nation.filter("n_nationkey < 20").select(F.concat(F.lit("n "), "n_nationkey").alias("norm_key"), F.col("n_name").alias("canonical"))


_RESOLVED = f"select s.id, s.name, coalesce(a.canonical, n.n_name) as atom from ({_SRC}) s left join ({_ALIAS}) a on {_NORM.format('s.name')} = a.norm_key left join nation n on {_NORM.format('s.name')} = {_NORM.format('n.n_name')}"


@query("flagship", """
with c as (select n_name as atom, r_name as frame, sum(case when c_acctbal > 0 then 1 else 0 end) as summed, count(*) as people from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2),
p as (select r_name as frame, count(*) as published from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1)
select frame, cast(sum(c.people) as bigint) as people, cast(sum(summed) as bigint) as summed, published, cast(sum(summed) as bigint) - published as delta from c join p using (frame) group by frame, published having sum(summed) <> published""")
def flagship(t: Tables):
    """Names to the roster, facts to atoms, atoms to frames, frames against independent totals."""
    roster = _roster(t)
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", F.concat(F.lower("n_name"), F.lit(" District")).alias("name"))
    facts = J.resolved(named, "name", roster).join(roster, "atom")
    joined = J.facts_to_roster(facts, roster, "frame")
    ours = joined.ok.groupBy("frame").agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("c_acctbal") > 0).alias("summed"))
    theirs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("frame")).agg(F.count(F.lit(1)).alias("published"))
    return J.totals_off(ours, theirs, "frame").join(ours.select("frame", "people"), "frame").select("frame", "people", "summed", "published", "delta")


@query("jn1_resolve", _RESOLVED)
def jn1(t: Tables):
    return J.resolved(_source(t), "name", _roster(t), _aliases(t)).select("id", "name", "atom")


@query("jn2_resolve_layers", f"select id, name, case when {_NORM.format('name')} = 'nation 5' then 'NATION_6' else atom end as atom from ({_RESOLVED})")
def jn2(t: Tables):
    own = t.spark.createDataFrame([("nation 5", "NATION_6")], "norm_key string, canonical string")
    return J.resolved(_source(t), "name", _roster(t), own, _aliases(t)).select("id", "name", "atom")


@query("jn3_categories", "select event_type, count(*) as rows, event_type in ('click', 'view', 'purchase') as known from events group by 1")
def jn3(t: Tables):
    listed = t.spark.createDataFrame([("click",), ("view",), ("purchase",)], "atom string")
    types = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    return J.resolved(types, "event_type", listed).select("event_type", "rows", F.col("atom").isNotNull().alias("known"))


_FOLDED = "select n_nationkey as id, n_name as name, case when n_nationkey >= 20 then 'NATION_' || (n_nationkey - 20) else n_name end as atom, case when n_nationkey >= 20 then n_name end as folded_from from nation"


@query("jn4_fold", _FOLDED)
def jn4(t: Tables):
    roster = _roster(t).filter(~F.col("atom").isin([f"NATION_{k}" for k in range(20, 25)]))
    folds = t.nation.filter("n_nationkey >= 20").select(F.col("n_name").alias("child"), F.concat(F.lit("NATION_"), F.col("n_nationkey") - 20).alias("parent"))
    return J.folded(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "name", roster, folds).select("id", "name", "atom", "folded_from")


_KINDS = """select s_suppkey as id, 'NATION_' || (s_suppkey % 30) as name,
case when s_suppkey % 11 = 0 then 'dropped' when s_suppkey % 13 = 0 then 'unit' when s_suppkey % 30 = 7 and s_suppkey <> 7 then 'unclassified' when s_suppkey % 30 < 20 then 'unit' when s_suppkey % 30 < 25 then 'folded' else 'unclassified' end as kind,
case when s_suppkey % 11 = 0 then null when s_suppkey % 13 = 0 then 'NATION_1' when s_suppkey % 30 = 7 and s_suppkey <> 7 then null when s_suppkey % 30 < 20 then 'NATION_' || (s_suppkey % 30) when s_suppkey % 30 < 25 then 'NATION_' || (s_suppkey % 30 - 20) end as atom,
case when s_suppkey % 11 = 0 then 'listed' end as reason from supplier"""


def _kinds(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 30).alias("name"))
    roster = t.nation.filter("n_nationkey < 20").select(F.col("n_name").alias("atom"))
    folds = t.nation.filter("n_nationkey >= 20").select(F.col("n_name").alias("child"), F.concat(F.lit("NATION_"), F.col("n_nationkey") - 20).alias("parent"))
    none = t.spark.createDataFrame([], "norm_key string, canonical string")
    dropped = s.filter("id % 11 = 0").select("id", F.lit("listed").alias("reason"))
    overrides = s.filter("id % 13 = 0").select("id", F.lit("NATION_1").alias("atom"))
    pinned = t.spark.createDataFrame([("NATION_7", 7)], "atom string, id long")
    return J.classified(s, roster, none, folds, dropped, overrides, pinned), roster


@query("jn5_classify", _KINDS)
def jn5(t: Tables):
    return _kinds(t)[0]


@query("jn6_classify_tier", "select p_partkey, case when p_type = 'SMALL' then 'STANDARD' when p_type = 'ECONOMY' then 'Economy' else p_type end as tier from part")
def jn6(t: Tables):
    folds = t.spark.createDataFrame([("SMALL Division", "STANDARD")], "child string, parent string")
    alias = t.spark.createDataFrame([("economy", "Economy")], "norm_key string, canonical string")
    p = t.part.select("p_partkey", F.concat("p_type", F.lit(" Division")).alias("name"))
    return J.classified_tier(p, "name", folds, alias).select("p_partkey", "tier")


@query("jn7_reconcile", f"""with k as ({_KINDS}) select kind, count(*) as rows from k group by 1
union all select 'uncovered', count(*) from nation where n_nationkey < 20 and n_name not in (select atom from k where atom is not null)""")
def jn7(t: Tables):
    kinds, roster = _kinds(t)
    r = J.reconciled(kinds, roster)
    parts = r.assignments.select("kind").unionByName(r.dropped.select("kind")).unionByName(r.folded.select("kind")).unionByName(r.unclassified.select("kind"))
    return parts.groupBy("kind").agg(F.count(F.lit(1)).alias("rows")).unionByName(r.uncovered.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("uncovered").alias("kind"), "rows"))


@query("jn8_facts_to_roster", """with c as (select c_custkey, case when c_nationkey < 22 then 'NATION_' || c_nationkey end as atom, case when c_custkey % 97 = 0 then 'elsewhere' else r_name end as frame from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
r as (select n_name as atom, r_name as frame from nation join region on n_regionkey = r_regionkey)
select 'ok' as part, count(*) as rows from c join r using (atom) where c.frame = r.frame
union all select 'unmatched', count(*) from c where atom is null
union all select 'missing', count(*) from r where atom not in (select atom from c where atom is not null)
union all select 'duplicates', count(*) from (select atom from c where atom is not null group by 1 having count(*) > 1)
union all select 'misplaced', count(*) from c join r using (atom) where c.frame <> r.frame""")
def jn8(t: Tables):
    roster = _roster(t)
    j = J.facts_to_roster(_facts(t), roster, "frame")
    n = lambda df, part: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(part).alias("part"), "rows")
    return n(j.ok, "ok").unionByName(n(j.unmatched, "unmatched")).unionByName(n(j.missing, "missing")).unionByName(n(j.duplicates, "duplicates")).unionByName(n(j.misplaced, "misplaced"))

_CUSTOMERS = """with c as (select c_custkey, case when c_nationkey < 22 then n_name end as atom, case when c_custkey % 97 = 0 then 'elsewhere' else r_name end as frame from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
r as (select n_name as atom, r_name as roster_frame from nation join region on n_regionkey = r_regionkey)"""


def _facts(t: Tables):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", F.when(F.col("c_nationkey") < 22, F.col("n_name")).alias("atom"), F.when(F.col("c_custkey") % 97 == 0, F.lit("elsewhere")).otherwise(F.col("r_name")).alias("frame"))


@query("jn8_tagged", f"""{_CUSTOMERS} select c_custkey, coalesce(c.atom, r.atom) as atom, frame, roster_frame,
case when c_custkey is null then 'missing' when r.atom is null then 'unmatched' when frame = roster_frame then 'ok' else 'misplaced' end as tag from c full join r on c.atom = r.atom""")
def jn8_tagged(t: Tables):
    """Every customer and every atom without one in a frame of its own tag, from one join."""
    return J.tagged_facts(_facts(t), _roster(t), "frame")


@query("jn8_tag_counts", f"""{_CUSTOMERS}, j as (select case when c_custkey is null then 'missing' when r.atom is null then 'unmatched' when frame = roster_frame then 'ok' else 'misplaced' end as tag from c full join r on c.atom = r.atom)
select k as tag, count(tag) as rows from (values ('ok'), ('misplaced'), ('unmatched'), ('missing')) v(k) left join j on k = tag group by 1""")
def jn8_tag_counts(t: Tables):
    """Rows by tag, counted while the tagged rows are written, and each part read back alone."""
    rows, seen = R.observed(J.tagged_facts(_facts(t), _roster(t), "frame"), J.FACT_TAGS)
    parts = J.apart(rows, J.FACT_TAGS)
    counted = seen.get
    out = [parts[k].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("tag"), F.when(F.col("rows") == counted[k], F.col("rows")).alias("rows")) for k in J.FACT_TAGS]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("jn9_collisions", "select n_name as atom, string_agg(distinct published, ',' order by published) as names from (select n_name, case when s_suppkey % 7 = 0 then upper(n_name) || '*' else n_name end as published from supplier join nation on s_nationkey = n_nationkey) group by 1 having count(distinct published) > 1")
def jn9(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("atom"), F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.upper("n_name"), F.lit("*"))).otherwise(F.col("n_name")).alias("published"))
    return J.collisions(s, "atom", "published").select("atom", F.array_join("names", ",").alias("names"))


_CATS = ["click", "view", "purchase", "error"]


@query("jn10_category_join", f"""select u.user_id as atom, {', '.join(f"cast(coalesce(sum(case when event_type = '{c}' then 1 else 0 end), 0) as bigint) as {c}" for c in _CATS)}, min(value) is null as empty
from (select distinct user_id from events) u left join events e on u.user_id = e.user_id and event_type <> 'signup' group by 1""")
def jn10(t: Tables):
    users = t.events.select(F.col("user_id").alias("atom")).distinct()
    kept = t.events.filter("event_type <> 'signup'").select(F.col("user_id").alias("atom"), "event_type", "value")
    return A.category_join(users, kept, "atom", "event_type", "value", _CATS)


@query("jn11_three_tables", """with l as (select l_suppkey as k, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as a from lineitem where l_suppkey % 10 <> 3 group by 1),
s as (select s_suppkey as k, s_nationkey as b from supplier where s_suppkey % 10 <> 4), r as (select s_suppkey as k from supplier), p as (select p_partkey as k, p_size as c from part where p_partkey % 10 <> 5)
select r.k as atom, x.part from r, (values ('returns'), ('places'), ('sizes')) x(part)
where (part = 'returns' and r.k not in (select k from l)) or (part = 'places' and r.k not in (select k from s)) or (part = 'sizes' and r.k not in (select k from p))""")
def jn11(t: Tables):
    roster = t.supplier.select(F.col("s_suppkey").alias("atom"))
    returns = t.lineitem.filter("l_suppkey % 10 <> 3").groupBy(F.col("l_suppkey").alias("atom")).agg(F.count_if(F.col("l_returnflag") == "R").alias("a"))
    places = t.supplier.filter("s_suppkey % 10 <> 4").select(F.col("s_suppkey").alias("atom"), F.col("s_nationkey").alias("b"))
    sizes = t.part.filter("p_partkey % 10 <> 5").select(F.col("p_partkey").alias("atom"), F.col("p_size").alias("c"))
    return J.assembled(roster, "atom", {"returns": returns, "places": places, "sizes": sizes})[1]


_OURS = "select l_orderkey as k, count(*) as summed from lineitem group by 1"
_THEIRS = "select o_orderkey as k, cast(o_orderkey % 7 as bigint) as published from orders"


def _totals(t: Tables):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("summed")), t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7).alias("published"))


@query("jn12_totals_off", f"select coalesce(a.k, b.k) as k, summed, published, summed - published as delta from ({_OURS}) a full join ({_THEIRS}) b on a.k = b.k where summed is distinct from published")
def jn12(t: Tables):
    return J.totals_off(*_totals(t), "k")


@query("jn13_totals_off_but", f"select coalesce(a.k, b.k) as k, a.summed + case when a.k in (0, 1, 2, 3) then 2 else 0 end as summed, published, a.summed + case when a.k in (0, 1, 2, 3) then 2 else 0 end - published as delta from ({_OURS}) a full join ({_THEIRS}) b on a.k = b.k where a.summed + case when a.k in (0, 1, 2, 3) then 2 else 0 end is distinct from published")
def jn13(t: Tables):
    pinned = t.spark.createDataFrame([(k, 2) for k in range(4)], "k long, delta long")
    ours, theirs = _totals(t)
    return J.totals_off_but(ours, theirs, pinned, "k")


@query("jn14_coverage", "select o_orderkey as k, 'missing' as problem from orders where o_orderkey not in (select l_orderkey from lineitem) union all select distinct l_orderkey, 'unexpected' from lineitem where l_orderkey not in (select o_orderkey from orders)")
def jn14(t: Tables):
    return J.coverage(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k")


@query("jn15_disagreements", "select k, a, b from (select l_suppkey as k, count(*) as a, count(*) filter (l_linestatus = 'F') * 2 as b from lineitem group by 1) where a <> b")
def jn15(t: Tables):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("k"))
    return J.disagreements(g.agg(F.count(F.lit(1)).alias("a")), g.agg((F.count_if(F.col("l_linestatus") == "F") * 2).alias("b")), "k", "a", "b")


@query("jn16_excesses", "select l_orderkey as k, a, b, a - b as excess from (select l_orderkey, count(*) as a from lineitem group by 1) join (select o_orderkey, cast(o_orderkey % 5 as bigint) as b from orders) on l_orderkey = o_orderkey where a > b")
def jn16(t: Tables):
    ours = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    return J.excesses(ours, t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("b")), "k", "a", "b")


@query("jn17_shared_keys", "select l_partkey, min(l_orderkey) as l_orderkey from lineitem where l_suppkey % 10 = 1 and l_partkey in (select l_partkey from lineitem where l_suppkey % 10 = 2) group by 1")
def jn17(t: Tables):
    near = t.lineitem.filter("l_suppkey % 10 = 1").select("l_partkey", "l_orderkey")
    return J.shared_keys(near, t.lineitem.filter("l_suppkey % 10 = 2").select("l_partkey"), "l_partkey", ["l_orderkey"])


@query("jn18_chain_lookup", """with r as (select s_suppkey as id, s_nationkey as code, case when s_suppkey % 5 = 0 then null else s_suppkey * 2 end as ref from supplier),
n as (select s_suppkey as id, case when s_suppkey % 6 = 0 then ' ' else s_name end as name from supplier)
select r.id, code, n_name as unit, ref, n.name as node_name, case when n_name is null then 'no unit' when ref is null then 'no member' when n.id is null then 'missing node' when trim(coalesce(n.name, '')) = '' then 'unnamed node' end as problem
from r left join (select * from nation where n_nationkey < 20) on code = n_nationkey left join n on r.ref = n.id""")
def jn18(t: Tables):
    k = F.col("s_suppkey")
    member = lambda kind, role, ref: F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), ref.alias("ref"))
    members = F.array(member("way", "outer", k), member("node", "label", k + 1), member("node", "admin_centre", k * 2), member("node", "admin_centre", k * 3))
    relations = t.supplier.select(k.alias("id"), F.col("s_nationkey").alias("code"), F.when(k % 5 == 0, F.slice(members, 1, 2)).otherwise(members).alias("members"))
    nodes = t.supplier.select(k.alias("id"), F.when(k % 6 == 0, F.lit(" ")).otherwise(F.col("s_name")).alias("name"))
    units = t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("unit"))
    return J.chain_lookup(relations, units, nodes, "node", "admin_centre").select("id", "code", "unit", "ref", "node_name", "problem")


@query("jn19_memberships", """with m as (select l_partkey as child, l_suppkey % 10 as parent, min(l_orderkey) as seq, bool_and(l_quantity > 10) as fold from lineitem group by 1, 2),
k as (select *, row_number() over (partition by child order by fold, seq, parent) as k, count(*) filter (not fold) over (partition by child) as n from m)
select child, parent, fold as folded, n > 1 as conflict from k where k = 1""")
def jn19(t: Tables):
    m = t.lineitem.groupBy(F.col("l_partkey").alias("child"), (F.col("l_suppkey") % 10).alias("parent")).agg(F.min("l_orderkey").alias("seq"), F.bool_and(F.col("l_quantity") > 10).alias("fold"))
    return J.memberships(m, "child", "parent", F.col("fold"), "seq").select("child", "parent", "folded", "conflict")


@query("jn20_assemble", """select c_custkey as atom, n_name as nation, r_name as region, round(total, 2) as total, orders is null as lacks_orders from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
left join (select o_custkey, sum(o_totalprice) as total, count(*) as orders from orders group by 1) on c_custkey = o_custkey""")
def jn20(t: Tables):
    roster = t.customer.select(F.col("c_custkey").alias("atom"))
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("atom"), "n_name", "r_name")
    money = t.orders.groupBy(F.col("o_custkey").alias("atom")).agg(F.sum("o_totalprice").alias("total"))
    wide, absent = J.assembled(roster, "atom", {"place": place, "money": money})
    lacks = absent.filter("part = 'money'").select("atom", F.lit(True).alias("lacks_orders"))
    return wide.join(lacks, "atom", "left").select("atom", F.col("place.n_name").alias("nation"), F.col("place.r_name").alias("region"), F.round("money.total", 2).alias("total"), F.coalesce("lacks_orders", F.lit(False)).alias("lacks_orders"))


@query("jn21_owners", "select atom, max(unit) as unit from (select s_suppkey as atom, s_suppkey % 7 as unit from supplier union all select s_suppkey, s_suppkey % 5 from supplier where s_suppkey % 3 = 0) group by 1")
def jn21(t: Tables):
    both = t.supplier.select(F.col("s_suppkey").alias("atom"), (F.col("s_suppkey") % 7).alias("unit")).unionByName(t.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("atom"), (F.col("s_suppkey") % 5).alias("unit")))
    return J.owners(both.groupBy("unit").agg(F.collect_list("atom").alias("atoms")).withColumn("pos", F.col("unit")))


_BOX = "select user_id as id, min(value) as x0, min(value) + 3 as x1, min(extract(hour from ts)) * 1.0 as y0, min(extract(hour from ts)) + 2.0 as y1 from events group by 1"


@query("jn22_boxes", f"with b as ({_BOX}) select a.id as a, b.id as b from b a join b on a.id < b.id and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1")
def jn22(t: Tables):
    b = t.events.groupBy(F.col("user_id").alias("id")).agg(F.min("value").alias("x0"), (F.min("value") + 3).alias("x1"), (F.min(F.hour("ts")) * 1.0).alias("y0"), (F.min(F.hour("ts")) + 2.0).alias("y1"))
    return box_pairs(b, b, 5.0, ordered=True)


@query("jn24_near_pairs", """with p as (select s_suppkey as id, 60 + (s_suppkey * 37 % 200) / 10.0 as x, 24 + (s_suppkey * 53 % 130) / 10.0 as y from supplier)
select a.id as a, b.id as b from p a join p b on a.id < b.id and 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 150""")
def jn24(t: Tables):
    p = t.supplier.select(F.col("s_suppkey").alias("id"), (60 + (F.col("s_suppkey") * 37 % 200) / 10.0).alias("lon"), (24 + (F.col("s_suppkey") * 53 % 130) / 10.0).alias("lat"))
    return near_pairs(p, 150.0).select("a", "b")


@query("jn25_frames", "select n_name as atom, r_name as frame from nation join region on n_regionkey = r_regionkey")
def jn25(t: Tables):
    return _roster(t)


@query("jn26_references", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0)")
def jn26(t: Tables):
    return J.unknown_references(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.filter("c_custkey % 10 <> 0"), "c_custkey").select("o_orderkey", "o_custkey")


_TOTAL = "select o_custkey, sum(case when o_orderpriority <> '4-NOT SPECIFIED' then 1 else 0 end) as named, count(*) as n from orders group by 1"


@query("jn27_profile", f"select c_custkey as atom, c_mktsegment as unit, cast(n as bigint) as figure, case when n is null then 'not covered' when c_mktsegment = 'BUILDING' then 'withheld' when named < n / 2 then 'unnamed' end as reason from customer left join ({_TOTAL}) on c_custkey = o_custkey")
def jn27(t: Tables):
    totals = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("named"), F.count(F.lit(1)).alias("n"))
    c = t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("atom"), F.col("c_mktsegment").alias("unit"), F.col("n").alias("figure"), J.reason(F.col("n").isNull(), F.col("c_mktsegment") == "BUILDING", F.col("named") < F.col("n") / 2).alias("reason"))


@query("jn28_listed", "select c_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as items from customer left join orders on c_custkey = o_custkey group by 1")
def jn28(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.listed(rows, "c_custkey", "o_orderkey", t.customer.select("c_custkey")).select("c_custkey", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))
