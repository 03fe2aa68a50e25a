"""Queries of the partition operators. Suppliers are atoms, regions are frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import partition as P
from ..registry import Tables, query
from ..sources.storage import written
from .graphs import atoms, components_sql, edges

RULE = P.Rule(ceiling=60_000, km=900.0, floor=0.3)


def rule_atoms(t: Tables):
    k = F.col("atom")
    seat = F.row_number().over(_per_nation()) == 1
    return atoms(t).withColumns({"lon": 60 + (k * 37 % 200) / 10.0, "lat": 24 + (k * 53 % 130) / 10.0, "score": (k % 97) / 96.0}).withColumn("seat", seat).select("atom", "frame", "population", "score", "lon", "lat", "seat")


def _per_nation():
    from pyspark.sql import Window as W

    return W.partitionBy("s_nationkey").orderBy(F.desc("population"), "atom")


_A = "select s_suppkey as atom, n_regionkey as frame, cast(floor(s_acctbal) as bigint) as population, (s_suppkey % 97) / 96.0 as score, 60 + (s_suppkey * 37 % 200) / 10.0 as lon, 24 + (s_suppkey * 53 % 130) / 10.0 as lat from supplier join nation on s_nationkey = n_nationkey"
_E = "select distinct a.l_suppkey as src from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_shipdate = b.l_shipdate and a.l_suppkey <> b.l_suppkey"


@query("g7_grown")
def g7(t: Tables):
    return P.grown(rule_atoms(t), edges(t), RULE)


@query("g8_rule_problems", f"""with a as ({_A}), x as (select atom, case when atom % 40 = 1 then null else frame end as frame, case when atom % 40 = 2 then null else population end as population, case when atom % 40 = 3 then 1.5 else score end as score, lon, case when atom % 40 = 4 then null else lat end as lat from a union all select * from a where atom = 5)
select atom, 'duplicate' as problem from x group by 1 having count(*) > 1 union all select atom, 'no frame' from x where frame is null union all select atom, 'no population' from x where population is null
union all select atom, 'no place' from x where lat is null union all select atom, 'over the ceiling' from x where population > 9000 union all select atom, 'score outside 0 to 1' from x where score not between 0 and 1
union all select distinct atom, 'not in the graph' from x where atom not in ({_E})""")
def g8(t: Tables):
    a = rule_atoms(t)
    k = F.col("atom") % 40
    broken = a.withColumns({"frame": F.when(k != 1, F.col("frame")), "population": F.when(k != 2, F.col("population")), "score": F.when(k == 3, 1.5).otherwise(F.col("score")), "lat": F.when(k != 4, F.col("lat"))}).unionByName(a.filter("atom = 5"))
    return P.rule_problems(broken, edges(t), P.Rule(9000, 300.0, 0.3))


_U = "select s_suppkey as atom, s_suppkey % 4 as centre from supplier where s_suppkey % 13 <> 0"


@query("g9_grown_problems", components_sql(_U, "centre") + """ select cast(s_suppkey as varchar) as what, 'unplaced' as problem from supplier where s_suppkey % 13 = 0
union all select cast(centre as varchar), 'not contiguous' from c join m using (atom) group by centre having count(distinct component) > 1""")
def g9(t: Tables):
    """Units that the rule would not make: some atoms have none, and neighbours are torn apart."""
    k = F.col("atom")
    units = rule_atoms(t).filter(k % 13 != 0).select("atom", (k % 4).alias("centre"))
    return P.grown_problems(rule_atoms(t), units, edges(t))


@query("g10_unit_list")
def g10(t: Tables):
    return P.unit_list(P.grown(rule_atoms(t), edges(t), RULE), F.concat(F.lit("group "), F.substring(F.col("centre").cast("string"), 1, 1)))


_CLAIMS = """select v as variant, 'u' || (s_suppkey % 7) as unit, case when s_suppkey % 31 = 5 and v = 0 then 'nobody ' || s_suppkey else 'S ' || s_suppkey end as claim, 'claim' as kind from supplier, (values (0), (1), (2)) x(v) where not (v = 0 and s_suppkey % 29 = 3)
union all select 0, 'u6', 'S ' || s_suppkey, 'claim' from supplier where s_suppkey % 23 = 1
union all select 0, 'u' || (s_suppkey % 7), 'S ' || s_suppkey, 'claim' from supplier where s_suppkey % 41 = 2
union all select 0, 'u0', 'S ' || s_suppkey, 'exclude' from supplier where s_suppkey % 37 = 4
union all select 2, 'u' || (s_suppkey % 7), 'Child ' || s_suppkey, 'claim' from supplier where s_suppkey % 19 = 0"""


def claims(t: Tables):
    k = F.col("s_suppkey")
    each = t.supplier.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in range(3)])))
    name = lambda p: F.concat(F.lit(p), k)
    unit = F.concat(F.lit("u"), k % 7)
    base = each.filter(~((F.col("variant") == 0) & (k % 29 == 3))).select("variant", unit.alias("unit"), F.when((k % 31 == 5) & (F.col("variant") == 0), name("nobody ")).otherwise(name("S ")).alias("claim"), F.lit("claim").alias("kind"))
    more = lambda v, cond, u, p, kind: t.supplier.filter(cond).select(F.lit(v).alias("variant"), u.alias("unit"), name(p).alias("claim"), F.lit(kind).alias("kind"))
    rows = base.unionByName(more(0, k % 23 == 1, F.lit("u6"), "S ", "claim")).unionByName(more(0, k % 41 == 2, unit, "S ", "claim")).unionByName(more(0, k % 37 == 4, F.lit("u0"), "S ", "exclude")).unionByName(more(2, k % 19 == 0, unit, "Child ", "claim"))
    roster = t.supplier.select(name("S ").alias("atom"), F.col("s_nationkey"))
    folds = t.supplier.filter(k % 19 == 0).select(name("Child ").alias("child"), name("S ").alias("parent"))
    return P.resolved_claims(rows, roster, folds), roster


def problems(t: Tables):
    c, roster = claims(t)
    units = c.select("variant", "unit").distinct()
    universe = roster.select("atom", F.explode(F.array(*[F.lit(v) for v in range(3)])).alias("variant"))
    return P.claim_problems(c, units, universe)


_PROBLEMS = f"""with c0 as ({_CLAIMS}), c as (select variant, unit, claim, kind, case when claim like 'S %' then claim when claim like 'Child %' then 'S ' || substr(claim, 7) end as atom from c0),
u as (select v as variant, 'S ' || s_suppkey as atom from supplier, (values (0), (1), (2)) x(v)), o as (select distinct variant, unit, atom from c where kind = 'claim' and atom is not null),
p as (select variant, unit, 'unknown' as rule, claim as detail from c where atom is null
union all select variant, unit, 'claimed twice', claim from c group by variant, unit, claim, kind having count(*) > 1
union all select distinct variant, null, 'claimed and excluded', atom from c where kind = 'exclude' and (variant, atom) in (select variant, atom from o)
union all select variant, null, 'overlap', atom from o group by variant, atom having count(distinct unit) > 1
union all select variant, unit, 'outside', atom from o where (variant, atom) not in (select variant, atom from u)
union all select variant, null, 'gap', atom from u where (variant, atom) not in (select variant, atom from c where atom is not null))"""


@query("g11_claim_problems", _PROBLEMS + " select * from p")
def g11(t: Tables):
    return problems(t)


@query("g15_valid_variants", _PROBLEMS + " select v as variant from (values (0), (1), (2)) x(v) where v not in (select variant from p)")
def g15(t: Tables):
    return P.valid_variants(t.spark.createDataFrame([(0,), (1,), (2,)], "variant int"), problems(t))


@query("g12_forbidden", "select v as variant, 'u' || (s_suppkey % 7) as unit, 'S ' || s_suppkey as atom, 'frame ' || s_nationkey as frame from supplier, (values (1)) x(v) where s_nationkey < 3 and s_suppkey % 7 not in (0, 1)")
def g12(t: Tables):
    c, roster = claims(t)
    forbidden = roster.filter("s_nationkey < 3").select("atom", F.concat(F.lit("frame "), "s_nationkey").alias("frame"))
    units = c.select("variant", "unit").distinct().withColumn("kind", F.when(F.col("unit") == "u0", "territory").otherwise("proposed"))
    promoted = units.filter("unit = 'u1'").select("variant", "unit")
    withheld = t.spark.createDataFrame([(0,), (2,)], "variant int")
    return P.forbidden_claims(c, units, forbidden, promoted, withheld)


@query("g13_metadata_problems", """select p_partkey as variant, rule from part, (values ('badge'), ('vintage'), ('source'), ('derived')) r(rule)
where (rule = 'badge' and p_size % 10 = 0) or (rule = 'vintage' and p_size % 10 = 1) or (rule = 'source' and p_size % 10 = 2) or (rule = 'derived' and p_size % 10 = 3)""")
def g13(t: Tables):
    k = F.col("p_size") % 10
    badge = F.when(k == 0, F.array(F.lit("novel"), F.lit("proposed"))).otherwise(F.array(F.lit("proposed")))
    v = t.part.select(F.col("p_partkey").alias("variant"), badge.alias("badges"), F.when(k == 1, " ").otherwise("2023").alias("vintage"), F.lit("none known").alias("opposition"), F.when(k != 2, F.lit("a book")).alias("source"), (k == 3).alias("derived"))
    return P.metadata_problems(v, ["proposed", "historical", "derived"])


@query("g14_inherited", "select p_partkey, case when p_size % 3 = 0 then p_name when p_size % 3 = 1 then p_brand else 'general' end as vintage, case when p_size % 3 = 0 then 'own' when p_size % 3 = 1 then 'basis' else 'general' end as origin from part")
def g14(t: Tables):
    k = F.col("p_size") % 3
    value, origin = P.inherited(F.when(k == 0, F.col("p_name")).otherwise(" "), F.when(k == 1, F.col("p_brand")), F.lit("general"))
    return t.part.select("p_partkey", value.alias("vintage"), origin.alias("origin"))


_MEMBERS = """select v as variant, s_suppkey % 7 as unit, 'Unit ' || (s_suppkey % 7) as name, s_suppkey as atom, 'UNIT ' || (s_nationkey % 7) as origin, case when s_suppkey % 7 = 6 or (v = 2 and s_suppkey = 8) then null else s_suppkey + 1 end as population, case when s_suppkey % 7 <> 5 then s_suppkey * 10 end as area from supplier, (values (0), (1), (2)) x(v)"""


@query("g16_scorecards", f"""with m as ({_MEMBERS}), u as (select variant, unit, min(name) as name, count(*) as n, count(*) - count(population) as gone, case when count(population) = count(*) then cast(sum(population) as bigint) end as total, case when count(area) = count(*) then cast(sum(area) as bigint) end as area from m group by 1, 2),
w as (select variant, case when variant = 1 then 'variant' when bool_or(gone > 0 and gone < n) then 'incomplete' when count(total) = 0 then 'uncounted' end as withheld, coalesce(string_agg(case when gone = n then cast(unit as varchar) end, ',' order by unit), '') as set_aside, count(*) as units, cast(sum(n) as bigint) as atoms, cast(sum(area) as bigint) as area,
 count(total) as counted, cast(sum(total) as bigint) as total, first(name order by total desc nulls last, name) as largest, first(name order by total nulls last, name desc) as smallest, case when count(total) > 1 then round(max(total) / min(total), 1) end as ratio from u group by 1),
d as (select variant, count(*) as moved from m where lower(origin) <> lower(name) group by 1)
select variant, units, atoms, withheld, set_aside, case when withheld is null then counted end as counted, case when withheld is null then total end as total, case when withheld is null then largest end as largest, case when withheld is null then smallest end as smallest, case when withheld is null then ratio end as ratio, coalesce(moved, 0) as moved, area from w left join d using (variant)""")
def g16(t: Tables):
    k = F.col("s_suppkey")
    n = t.spark.createDataFrame([(0, False), (1, True), (2, False)], "variant int, policy boolean")
    m = t.supplier.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in range(3)]))).select(
        "variant", (k % 7).alias("unit"), F.concat(F.lit("Unit "), k % 7).alias("name"), k.alias("atom"), F.concat(F.lit("UNIT "), F.col("s_nationkey") % 7).alias("origin"),
        F.when(~((k % 7 == 6) | (F.col("variant") == 2) & (k == 8)), k + 1).alias("population"), F.when(k % 7 != 5, k * 10).alias("area"),
    )
    return P.scorecards(m, n).withColumn("set_aside", F.array_join(F.col("set_aside").cast("array<string>"), ","))


@query("g21_derived_variants")
def g21(t: Tables):
    """Variants end to end: category regions and grown units, each a partition of all atoms with its leftovers."""
    a, e = atoms(t), written(edges(t), "edges")  # three readers, one self-join
    by_category = a.select("atom", F.concat(F.lit("cat "), F.col("atom") % 3).alias("category"))
    regions = G.components_within(e, by_category, ["category"]).select(F.lit("category").alias("variant"), F.concat("category", F.lit(" of "), "component").alias("unit"), "atom")
    by_rule = P.grown(rule_atoms(t), e, RULE).select(F.lit("rule").alias("variant"), F.concat(F.lit("around "), "centre").alias("unit"), "atom")
    by_band = G.components_within(e, a.select("atom", "frame", F.floor(F.col("s_acctbal") / 4000).alias("band")), ["frame", "band"]).select(F.lit("band").alias("variant"), F.concat_ws(" ", "frame", "band", "component").alias("unit"), "atom")
    return regions.unionByName(by_rule).unionByName(by_band)
