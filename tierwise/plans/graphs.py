"""Queries of the graph operators. Suppliers are atoms; (part, ship date) is the arc they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import graph as G
from ..registry import Tables, query
from .aggregates import dominants

_E = "select distinct a.l_suppkey as src, b.l_suppkey as dst from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_shipdate = b.l_shipdate and a.l_suppkey <> b.l_suppkey"


def incidence(t: Tables):
    return t.lineitem.select(F.struct("l_partkey", "l_shipdate").alias("arc"), F.col("l_suppkey").alias("atom"))


def edges(t: Tables):
    return G.adjacency(incidence(t), "arc", "atom")[0]


def within(t: Tables, members, keys: list[str]):
    """(links, members, keys) of the groups that are connected inside ``keys``."""
    return G.links(incidence(t), "arc", "atom", members, keys, once=True), members, keys


def atoms(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("atom"), F.col("n_regionkey").alias("frame"), "s_nationkey", "s_acctbal", F.floor("s_acctbal").alias("population"))


def components_sql(members: str, keys: str) -> str:
    """SQL of the components of ``members`` (atom, keys...) inside ``keys``."""
    same = " and ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    return f"""with recursive e as ({_E}), m as ({members}),
i as (select src, dst from e join m x on x.atom = src join m y on y.atom = dst where {same}),
r as (select atom as a, atom as b from m union select r.a, i.dst from r join i on r.b = i.src),
c as (select a as atom, min(b) as component from r group by 1)"""


_M = "select s_suppkey as atom, n_regionkey as frame, cast(floor(s_acctbal) as bigint) as population from supplier join nation on s_nationkey = n_nationkey"


@query("g1_adjacency", _E)
def g1(t: Tables):
    return edges(t)


@query("g2_graph_problems", f"""with e as ({_E}), f as (select * from e where src % 10 <> 3 union all select * from e where src = 5 union all select 7, 7 union all select 1, -1), r as (select s_suppkey as atom from supplier), n as (select src as atom from f union select dst from f)
select 'unknown' as kind, cast(atom as varchar) as node, '' as detail from n where atom not in (select atom from r)
union all select 'missing', cast(atom as varchar), '' from r where atom not in (select atom from n)
union all select 'self', cast(src as varchar), cast(dst as varchar) from f where src = dst
union all select 'duplicate', cast(src as varchar), cast(dst as varchar) from f group by src, dst having count(*) > 1
union all select distinct 'asymmetric', cast(f.src as varchar), cast(f.dst as varchar) from f where not exists (select 1 from f g where g.src = f.dst and g.dst = f.src)""")
def g2(t: Tables):
    e = edges(t)
    extra = t.spark.createDataFrame([(7, 7), (1, -1)], "src long, dst long")
    broken = e.filter("src % 10 <> 3").union(e.filter("src = 5")).union(extra)
    return G.graph_problems(broken, t.supplier.select(F.col("s_suppkey").alias("atom")))


@query("g3_contiguity", components_sql(_M, "frame") + """, p as (select frame, component, count(*) as size from c join m using (atom) group by 1, 2)
select frame, count(*) as pieces, count(*) = 1 as contiguous, string_agg(cast(size as varchar), ',' order by size desc, component) as sizes from p group by 1""")
def g3(t: Tables):
    return G.contiguity(*within(t, atoms(t).select("atom", "frame"), ["frame"]), inner=True).withColumn("sizes", F.array_join(F.col("sizes").cast("array<string>"), ","))


@query("wn12_detached", components_sql(_M, "frame") + """, p as (select frame, component, row_number() over (partition by frame order by count(*) desc, component) as k from c join m using (atom) group by 1, 2)
select atom, frame, component from c join m using (atom) join p using (frame, component) where k > 1""")
def wn12(t: Tables):
    return G.detached(*within(t, atoms(t).select("atom", "frame"), ["frame"]), inner=True).select("atom", "frame", "component")


_CAT = f"select m.atom, case when m.atom % 9 <> 0 then 'cat ' || (m.atom % 3) end as category, population from ({_M}) m"
_REGIONS = components_sql(f"select * from ({_CAT}) where category is not null", "category") + """, g as (select category, component, count(*) as size, cast(sum(population) as bigint) as population, first(atom order by population desc, atom) as principal from c join m using (atom) group by 1, 2)"""


def regions(t: Tables):
    m = atoms(t).select("atom", F.when(F.col("atom") % 9 != 0, F.concat(F.lit("cat "), F.col("atom") % 3)).alias("category"), "population")
    return G.grouped(*within(t, m.filter("category is not null"), ["category"]), "population", inner=True)


def _scope(t: Tables) -> G.Regions:
    """All suppliers, some named twice; facts lack some, others have no population."""
    k = F.col("atom")
    scope = t.supplier.select(F.col("s_suppkey").alias("atom"))
    facts = atoms(t).filter(k % 17 != 1).select("atom", F.when(k % 9 != 0, F.concat(F.lit("cat "), k % 3)).alias("category"), F.when(k % 19 != 2, F.col("population")).alias("population"))
    return G.category_regions(scope.unionByName(scope.filter("atom % 23 = 3")), facts, lambda m: within(t, m, ["category"])[0], inner=True)


_SCOPE = f"select m.atom, case when m.atom % 23 = 3 then 'named twice' when m.atom % 17 = 1 then 'no facts' when m.atom % 19 = 2 then 'no population' end as reason, case when m.atom % 9 <> 0 then 'cat ' || (m.atom % 3) end as category, population from ({_M}) m"


@query("g4_category_regions", components_sql(f"select atom, category, population from ({_SCOPE}) where reason is null and category is not null", "category") + """, g as (select category, component, count(*) as size, cast(sum(population) as bigint) as population, first(atom order by population desc, atom) as principal from c join m using (atom) group by 1, 2)
select *, case when count(*) over (partition by category) > 1 then category || ' (' || principal || ')' else category end as name from g""")
def g4(t: Tables):
    return _scope(t).regions


@query("g4_unplaced", f"select atom, coalesce(reason, 'no category') as reason from ({_SCOPE}) where reason is not null or category is null")
def g4_unplaced(t: Tables):
    s = _scope(t)
    return s.refused.unionByName(s.unassigned.withColumn("reason", F.lit("no category")))


@query("g5_not_sole", _REGIONS + " select category, count(*) as groups from g group by 1 having count(*) <> 1")
def g5(t: Tables):
    return G.not_sole(regions(t), "category")


_BAND = "case when s_acctbal < 2500 then 'low' when s_acctbal < 6000 then 'middle' else 'high' end"


@query("g6_band_groups", components_sql(_M.replace("select ", f"select {_BAND} as band, ", 1), "frame, band") + " select frame, band, component, count(*) as size, cast(sum(population) as bigint) as population, first(atom order by population desc, atom) as principal from c join m using (atom) group by 1, 2, 3")
def g6(t: Tables):
    cuts = t.spark.createDataFrame([("low", -1e9, 2500.0), ("middle", 2500.0, 6000.0), ("high", 6000.0, 1e9)], "band string, `from` double, `to` double")
    return G.grouped(*within(t, A.banded(atoms(t), "s_acctbal", cuts).select("atom", "frame", "band", "population"), ["frame", "band"]), "population", inner=True)


@query("ag28_edge_count", f"select (select count(*) from ({_E})) // 2 as edges, (select count(*) from supplier where s_suppkey not in (select src from ({_E}))) as isolated")
def ag28(t: Tables):
    e = edges(t)
    lone = t.supplier.select(F.col("s_suppkey").alias("src")).join(e, "src", "left_anti")
    both = e.select(F.lit(True).alias("edge")).unionByName(lone.select(F.lit(False).alias("edge")))
    return both.agg(F.expr("count_if(edge) div 2").alias("edges"), F.count_if(~F.col("edge")).alias("isolated"))


@query("ag29_component_attributes", components_sql(_M, "frame") + " select component, round(avg(population), 4) as mean, cast(sum(population) as bigint) as population, first(atom order by population desc, atom) as principal from c join m using (atom) group by 1")
def ag29(t: Tables):
    g = G.grouped(*within(t, atoms(t).select("atom", "frame", "population"), ["frame"]), "population", inner=True)
    return g.select("component", F.round(F.col("population") / F.col("size"), 4).alias("mean"), "population", "principal")
