"""Queries of the sources and sinks. Files are written from the tables first, then read by the operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..registry import Tables, query
from ..sources import artifacts as R
from ..sources.storage import fresh_path
from .graphs import edges


def _json(t: Tables, df, name: str) -> str:
    """One file per row, as each file is one JSON value."""
    path = fresh_path(t.spark, name)
    df.write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("src1_elements", "select n_regionkey as id, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as pos, 'node' as type, n_nationkey as ref, 'part' as role, r_name as name from nation join region on n_regionkey = r_regionkey")
def src1(t: Tables):
    """An envelope file per region: an element with its nations as members."""
    n = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("ref"), F.lit("node").alias("type"), F.lit("part").alias("role")))).alias("members"))
    e = n.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("relation").alias("type"), F.col("n_regionkey").alias("id"), F.create_map(F.lit("name"), F.col("r_name")).alias("tags"), "members")
    found = R.read_elements(t.spark, _json(t, e.select(F.array(F.struct("type", "id", "tags", "members")).alias("elements")), "elements"))
    return R.member_rows(found).join(found.select("id", F.element_at("tags", "name").alias("name")), "id").select("id", F.col("pos").cast("long").alias("pos"), "type", "ref", "role", "name")


@query("src2_keyed", "select n_name as key, n_regionkey as region, n_nationkey as number from nation")
def src2(t: Tables):
    keyed = t.nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("number"))))).alias("districts"))
    return R.read_keyed(t.spark, _json(t, keyed.select("districts"), "keyed"), "districts", "region: int, number: int")


@query("src3_published", "select frame, area, published, area - published as delta from (select n_regionkey as frame, cast(sum(n_nationkey) as bigint) as area from nation group by 1) join (select r_regionkey as frame, cast(50 + r_regionkey * 5 as bigint) as published from region) using (frame)")
def src3(t: Tables):
    rows = t.nation.agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("frame"), F.col("n_nationkey").alias("area"))).alias("rows"))
    totals = t.region.agg(F.collect_list(F.struct(F.col("r_regionkey").alias("frame"), (50 + F.col("r_regionkey") * 5).alias("published"))).alias("published"))
    found, published = R.read_published(t.spark, _json(t, rows.withColumn("file", F.lit(1)).join(totals.withColumn("file", F.lit(1)), "file"), "published"), "name: string, frame: int, area: long", "frame: int, published: long")
    return found.groupBy("frame").agg(F.sum("area").alias("area")).join(published, "frame").withColumn("delta", F.col("area") - F.col("published"))


@query("src4_typed", "select l_orderkey, cast(l_quantity as bigint) as l_quantity, cast(l_shipdate as date) as l_shipdate from lineitem")
def src4(t: Tables):
    return R.typed(t.lineitem, {"l_orderkey": "long", "l_quantity": "long", "l_shipdate": "date"})


@query("src5_digests")
def src5(t: Tables):
    return _digests(t)


def _digests(t: Tables):
    return R.digests(t.spark, f"{t.sf_dir}/region.parquet", f"{t.sf_dir}/nation.parquet")


_GATE = """select {0} as source, count(*) filter (event_type = '{1}') as rows, count(*) filter (event_type <> '{1}') as others, round(count(*) filter (event_type = '{1}' and value < {2}) / count(*) filter (event_type = '{1}'), 6) as without, count(*) filter ({3}) as remarks,
count(*) filter (event_type = '{1}') >= {4} and count(*) filter (event_type = '{1}' and value < {2}) <= 0.1 * count(*) filter (event_type = '{1}') and count(*) filter ({3}) = 0 as accepted from events"""


@query("src6_gate", " union all ".join((_GATE.format("'plain'", "click", 1, "false", 100), _GATE.format("'bare'", "click", 30, "false", 100), _GATE.format("'remarked'", "view", 1, "event_type = 'error'", 100), _GATE.format("'short'", "view", 1, "false", 10**9))))
def src6(t: Tables):
    """One source that is fine, one without enough geometry, one with error remarks, one with too few rows."""
    remark = F.when(F.col("event_type") == "error", "runtime error")
    gates = {
        "plain": R.gate(t.events, F.col("event_type"), F.col("value") >= 1, R.Gate("click", 100)),
        "bare": R.gate(t.events, F.col("event_type"), F.col("value") >= 30, R.Gate("click", 100)),
        "remarked": R.gate(t.events, F.col("event_type"), F.col("value") >= 1, R.Gate("view", 100), remark),
        "short": R.gate(t.events, F.col("event_type"), F.col("value") >= 1, R.Gate("view", 10**9)),
    }
    return reduce(lambda a, b: a.unionByName(b), [g.select(F.lit(n).alias("source"), "*") for n, g in gates.items()])


@query("src7_summary", "select coalesce(nullif(case when user_id % 5 = 0 then ' ' else event_type end, ' '), 'untagged') as level, count(*) as rows, count(*) filter (user_id % 3 <> 0) as named from events group by 1")
def src7(t: Tables):
    level = F.when(F.col("user_id") % 5 == 0, F.lit(" ")).otherwise(F.col("event_type"))
    return R.summary(t.events, F.when(F.col("user_id") % 3 != 0, F.lit("x")), level)


@query("src8_other_run", "select 'run ' || n_regionkey as run_id from nation where n_regionkey not in (0, 1) group by 1")
def src8(t: Tables):
    run = F.concat(F.lit("run "), "n_regionkey").alias("run_id")
    return R.other_run(t.nation.filter("n_regionkey < 2").select(run), t.nation.select(run))


@query("snk1_rows", "select c_custkey, c_name from customer")
def snk1(t: Tables):
    path = fresh_path(t.spark, "rows")
    R.write_rows(t.customer.select("c_custkey", "c_name"), path, "c_custkey")
    return t.spark.read.schema("c_custkey long, c_name string").json(path)


@query("snk2_artifact", "select n_name, n_regionkey, 25 as sources from nation")
def snk2(t: Tables):
    rows, stamp = R.read_artifact(t.spark, _artifact(t))
    return rows.withColumn("sources", F.lit(stamp.first()["sources"]))


def _artifact(t: Tables) -> str:
    """Nations, with the digests of the files that they come from, published once."""
    path = fresh_path(t.spark, "artifact")
    R.write_artifact(t.nation.select("n_name", "n_regionkey"), path, "n_name", t.nation.agg(F.count(F.lit(1)).cast("int").alias("sources")), _digests(t))
    return path


@query("snk2_provenance")
def snk2_provenance(t: Tables):
    """The digests of the sources as the artifact tells them."""
    return R.read_artifact(t.spark, _artifact(t))[1].select(F.inline("sources_read"))


@query("snk3_neighbours", """with e as (select distinct a.l_suppkey as src, b.l_suppkey as dst from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_shipdate = b.l_shipdate and a.l_suppkey <> b.l_suppkey)
select s_suppkey as atom, coalesce(string_agg(cast(dst as varchar), ',' order by dst), '') as neighbours, cast(count(dst) as integer) as n from supplier left join e on s_suppkey = src group by 1""")
def snk3(t: Tables):
    out = R.neighbour_lists(edges(t), t.supplier.select(F.col("s_suppkey").alias("atom")))
    path = fresh_path(t.spark, "graph")
    R.write_rows(out, path, "atom")
    return t.spark.read.schema("atom long, neighbours array<long>, n int").json(path).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))
