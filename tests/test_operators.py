"""Small fixtures with literal results, planted faults, order independence and metamorphic checks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tierwise.functions import names as N
from tierwise.operators import aggregates as A
from tierwise.operators import graph as G
from tierwise.operators import joins as J
from tierwise.operators import partition as P
from tierwise.operators import rows as R
from tierwise.operators import spatial as S
from tierwise.operators import windows as O
from tierwise.operators.components import connected_components


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def both(pairs):
    return [*pairs, *[(b, a) for a, b in pairs]]


LINE = both([("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")])


def test_names(spark):
    df = spark.createDataFrame([("  Upper   VALE District ",), ("D.I. Moor",), ("Agencyville",), (None,)], "n string")
    assert [r[0] for r in df.select(N.normalize_name(df.n)).collect()] == ["upper vale", "d i moor", "agencyville", None]
    numbers = spark.createDataFrame([(1234567.9,), (-1234.5,), (0.4,), (None,)], "x double")
    assert [r[0] for r in numbers.select(N.group_digits(numbers.x)).collect()] == ["1,234,567", "-1,234", "0", None]
    lists = spark.createDataFrame([([],), (["A"],), (["A", "B"],), (["A", "B", "C"],)], "a array<string>")
    assert [r[0] for r in lists.select(N.sentence_list(lists.a)).collect()] == ["", "A", "A and B", "A, B and C"]
    dates = spark.createDataFrame([("2023-03-01",), ("soon",), (None,)], "d string")
    assert [r[0] for r in dates.select(N.readable_date(dates.d)).collect()] == ["1 March 2023", "soon", None]
    arcs = spark.createDataFrame([(3,), (-4,), (0,), (-1,)], "i int")
    assert [r[0] for r in arcs.select(N.arc_id(arcs.i)).collect()] == [3, 3, 0, 0]


def test_resolution_and_folds(spark):
    roster = spark.createDataFrame([("Upper Vale", "N"), ("Kelden", "S")], "atom string, frame string")
    alias = spark.createDataFrame([("qelden", "Kelden")], "norm_key string, canonical string")
    folds = spark.createDataFrame([("Surrow", "Kelden")], "child string, parent string")
    names = spark.createDataFrame([("Upper Vale District",), ("Qelden",), ("Surrow",), ("Atlantis",), (None,)], "name string")
    got = {r["name"]: (r["atom"], r["folded_from"]) for r in J.folded(names, "name", roster, folds, alias).collect()}
    assert got == {"Upper Vale District": ("Upper Vale", None), "Qelden": ("Kelden", None), "Surrow": ("Kelden", "Surrow"), "Atlantis": (None, None), None: (None, None)}


def test_facts_keep_every_row(spark):
    roster = spark.createDataFrame([("A", "N"), ("B", "N"), ("C", "S")], "atom string, frame string")
    facts = spark.createDataFrame([("A", "N", 1), ("A", "N", 2), ("B", "S", 3), (None, "N", 4)], "atom string, frame string, v int")
    j = J.facts_to_roster(facts, roster, "frame")
    assert (j.ok.count(), j.unmatched.count(), j.misplaced.count()) == (2, 1, 1)
    assert [r["atom"] for r in j.missing.collect()] == ["C"] and bag(j.duplicates) == [("A", 2)]
    with pytest.raises(ValueError, match="B"):
        R.strict(j.misplaced, "wrong frame")


def test_dominant_residual_and_ties(spark):
    df = spark.createDataFrame([("named", 3, 3, 1), ("tie with rest", 3, 1, 3), ("rest", 1, 2, 3)], "k string, a int, b int, r int")
    got = {x["k"]: x["d"] for x in df.select("k", A.dominant(["a", "b"], "r").alias("d")).collect()}
    assert got == {"named": "a", "tie with rest": "a", "rest": None}


def test_bands_are_half_open(spark):
    bands = spark.createDataFrame([("low", 0.0, 0.5), ("mid", 0.5, 0.65), ("high", 0.65, 0.8), ("top", 0.8, 1.0000001)], "band string, `from` double, `to` double")
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 0.65, 0.8, 1.0, 1.2)], "s double")
    assert {r["s"]: r["band"] for r in A.banded(df, "s", bands).collect()} == {0.0: "low", 0.5: "mid", 0.65: "high", 0.8: "top", 1.0: "top", 1.2: None}
    assert [tuple(r) for r in A.band_counts(A.banded(df.filter("s > 0.6"), "s", bands), bands).select("band", "rows").collect()] == [("low", 0), ("mid", 0), ("high", 1), ("top", 2)]


def test_index_refuses_bad_rates(spark):
    df = spark.createDataFrame([(0.5, 0.6, 0.7), (1.2, 0.5, 0.5), (float("nan"), 0.1, 0.1), (None, 0.1, 0.1)], "a double, b double, c double")
    assert [r[0] for r in df.select(A.index_of(["a", "b", "c"])).collect()] == [0.6, None, None, None]


def test_cut_of_kept_fraction(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 11)] + [("h", float(i)) for i in range(1, 5)] + [("h", None)], "g string, w double")
    assert dict(map(tuple, A.kept_fraction_cut(df, "g", "w", 0.5).collect())) == {"g": 5.0, "h": 2.0}
    assert dict(map(tuple, A.kept_fraction_cut(df, "g", "w", 1.0).collect())) == {"g": 1.0, "h": 1.0}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_adjacency_and_audit(spark):
    inc = spark.createDataFrame([(0, "West"), (1, "West"), (2, "East"), (0, "East"), (3, "Far")], "arc int, atom string")
    edges, crowded = G.adjacency(inc, "arc", "atom")
    assert bag(edges) == [("East", "West"), ("West", "East")] and crowded.count() == 0
    roster = spark.createDataFrame([("West",), ("East",), ("Far",)], "atom string")
    bad = edges.filter("src = 'East'").union(spark.createDataFrame([("West", "West"), ("Nowhere", "East"), ("Nowhere", "East")], "s string, d string"))
    kinds = {(r["kind"], r["node"]) for r in G.graph_problems(bad, roster, inc.union(spark.createDataFrame([(0, "Far")], "arc int, atom string"))).collect()}
    assert kinds == {("unknown", "Nowhere"), ("missing", "Far"), ("self", "West"), ("duplicate", "Nowhere"), ("asymmetric", "East"), ("asymmetric", "Nowhere"), ("owners", "0")}


def test_category_regions_in_any_order(spark):
    members = [("A", "Alpha", 5), ("B", "Alpha", 4), ("C", "Beta", 3), ("D", "Alpha", 2), ("E", "Alpha", 1)]
    want = [("Alpha", "A", 2, 9, "A"), ("Alpha", "D", 2, 3, "D"), ("Beta", "C", 1, 3, "C")]
    for seed in range(2):
        m, e = members[:], LINE[:]
        random.Random(seed).shuffle(m)
        random.Random(seed).shuffle(e)
        g = G.grouped(spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame(m, "atom string, category string, population int"), ["category"], "population")
        assert bag(g) == want
    assert bag(G.not_sole(g, "category")) == [("Alpha", 2)]


def grid(n=5):
    atoms = [(f"a{i}{j}", "f" if i < 3 else "g", 100 * (i * n + j + 1), (i * 7 + j * 3) % 10 / 10, j * 0.5, i * 0.5, (i + j) % 3 == 0) for i, j in itertools.product(range(n), range(n))]
    edges = [(f"a{i}{j}", f"a{x}{y}") for i, j in itertools.product(range(n), range(n)) for x, y in ((i + 1, j), (i, j + 1)) if x < n and y < n]
    return atoms, both(edges)


def test_grown_units(spark):
    atoms, edges = grid()
    schema = "atom string, frame string, population long, score double, lon double, lat double, seat boolean"
    e = spark.createDataFrame(edges, "src string, dst string")

    def units(rule, rows=atoms):
        return P.grown(spark.createDataFrame(rows, schema), e, rule)

    rule = P.Rule(4000, 150.0, 0.3)
    u = units(rule)
    got = bag(u)
    assert sorted(r[1] for r in got) == sorted(a[0] for a in atoms)
    total = {}
    for _, _, centre, _, population in got:
        total[centre] = total.get(centre, 0) + population
    assert max(total.values()) <= 4000
    assert P.grown_problems(spark.createDataFrame(atoms, schema), u, e).count() == 0
    shuffled = atoms[:]
    random.Random(1).shuffle(shuffled)
    assert bag(units(rule, shuffled)) == got
    count = lambda r: len({(x[0], x[2]) for x in bag(units(r))})
    assert count(P.Rule(9000, 150.0, 0.3)) <= count(rule) <= count(P.Rule(4000, 60.0, 0.3))
    assert bag(P.grown(spark.createDataFrame(atoms, schema), e, rule, block_atoms=3)) == got


def test_claims(spark):
    roster = spark.createDataFrame([("Alpha",), ("Bravo",), ("Charlie",), ("Delta",)], "atom string")
    folds = spark.createDataFrame([("Kid One", "Delta"), ("Kid Two", "Delta")], "child string, parent string")
    claims = [("v", "u", "Alpha", "claim"), ("v", "u", "Kid One", "claim"), ("v", "u", "Kid Two", "claim"), ("v", "w", "Alpha", "claim"), ("v", "w", "Bravo", "claim"), ("v", "w", "Bravo", "claim"), ("v", "w", "Nowhere", "claim"), ("v", "w", "Bravo", "exclude")]
    c = P.resolved_claims(spark.createDataFrame(claims, "variant string, unit string, claim string, kind string"), roster, folds)
    units = spark.createDataFrame([("v", "u"), ("v", "w"), ("v", "w")], "variant string, unit string")
    universe = roster.filter("atom <> 'Delta'").selectExpr("'v' as variant", "atom")
    assert {(r["rule"], r["detail"]) for r in P.claim_problems(c, units, universe).collect()} == {("unknown", "Nowhere"), ("claimed twice", "Bravo"), ("claimed and excluded", "Bravo"), ("overlap", "Alpha"), ("outside", "Delta"), ("gap", "Charlie"), ("unit twice", "w")}


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]


def rings(spark):
    rows = [("g", 0, i, float(x), float(y)) for i, (x, y) in enumerate(SQUARE)]
    rows += [("g", 1, i, 1 + x / 2, 1 + y / 2) for i, (x, y) in enumerate(SQUARE)]
    rows += [("h", 0, i, 6.0 + x, float(y)) for i, (x, y) in enumerate(reversed(SQUARE))]
    return spark.createDataFrame(rows, "geom string, ring int, seq int, x double, y double")


def test_rings(spark):
    r = rings(spark)
    assert bag(S.doubled_areas(r, ["geom", "ring"])) == [("g", 0, 32.0), ("g", 1, 8.0), ("h", 0, -32.0)]
    assert all(x["doubled"] > 0 for x in S.doubled_areas(S.oriented(r, ["geom", "ring"]), ["geom", "ring"]).collect())
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 7.0, 1.0), (4, 20.0, 20.0)], "id int, x double, y double")
    order = spark.createDataFrame([("g", 0), ("h", 1)], "geom string, pos int")
    assert {x["id"]: x["geom"] for x in S.located(points, r, order, 1.5).collect()} == {1: "g", 2: None, 3: "h", 4: None}


def chain(got):
    out = {}
    for ref, name, rank, closed in got:
        out.setdefault((name, closed), []).append((rank, ref))
    return {k: [r for _, r in sorted(v)] for k, v in out.items()}


def test_directed_chains(spark):
    ways = [(3, "c", "d"), (1, "a", "b"), (2, "b", "c"), (10, "x", "y"), (11, "y", "z"), (12, "z", "x"), (20, "p", "q"), (21, "r", "q"), (22, "q", "s"), (30, "o", "o")]
    got, clashes = S.directed_chains(spark.createDataFrame(ways, "ref long, first string, last string"))
    assert chain(tuple(r) for r in got.collect()) == {(1, False): [1, 2, 3], (10, True): [10, 11, 12], (20, False): [20], (21, False): [21], (22, False): [22], (30, True): [30]}
    assert bag(clashes) == [("q",)]


def test_undirected_chains_stop_at_branches(spark):
    ways = [(1, "a", "b"), (2, "c", "b"), (3, "c", "d"), (4, "d", "e"), (5, "d", "f"), (10, "x", "y"), (11, "z", "y"), (12, "z", "x")]
    got, branches = S.undirected_chains(spark.createDataFrame(ways, "ref long, first string, last string"))
    c = chain(tuple(r) for r in got.collect())
    assert c[(1, False)] == [1, 2, 3] and c[(4, False)] == [4] and c[(5, False)] == [5]
    assert sorted(c[(10, True)]) == [10, 11, 12] and c[(10, True)][0] == 10
    assert bag(branches) == [("d",)]


def test_arcs_of_many_owners_keep_their_edges(spark):
    owners = list(range(1, 1203))
    inc = spark.createDataFrame([("wide", a) for a in owners] + [("pair", 1202), ("pair", 1300), (None, 1400)], "arc string, atom long")
    edges, crowded = G.adjacency(inc, "arc", "atom")
    assert [tuple(r) for r in crowded.collect()] == [("wide", 1202)]
    assert edges.count() == edges.distinct().count() == 1202 * 1201 + 2
    small = spark.createDataFrame([(f"arc {k % 3}", k) for k in range(20)], "arc string, atom long")
    want = sorted((a, b) for a in range(20) for b in range(20) if a != b and a % 3 == b % 3)
    assert sorted(tuple(r) for r in G.adjacency(small, "arc", "atom", max_owners=2)[0].collect()) == want


def test_links_connect_what_edges_connect(spark):
    rng = random.Random(4)
    inc = spark.createDataFrame([(f"a{rng.randrange(40)}", rng.randrange(60)) for _ in range(90)] + [("wide", k) for k in range(100, 1300)], "arc string, atom long")
    members = spark.createDataFrame([(k, k % 2) for k in [*range(60), *range(100, 1300)]], "atom long, key int")
    own = inc.distinct()
    links = G.links(inc, "arc", "atom", members, ["key"])
    assert links.count() <= 2 * own.count()
    found = G.components_within(links, members, ["key"])
    assert bag(found) == bag(G.components_within(G.adjacency(inc, "arc", "atom")[0], members, ["key"]))
    assert {r["component"] for r in found.filter("atom >= 100").collect()} == {100, 101}


def test_more_than_ten_thousand_bands(spark):
    bands = spark.range(10_500).select(F.concat(F.lit("b"), "id").alias("band"), F.col("id").cast("double").alias("from"), (F.col("id") + 1).cast("double").alias("to"))
    values = spark.range(100, 10_500, 100).select((F.col("id") + 0.5).alias("v"))
    got = A.banded(values, "v", bands).collect()
    assert len(got) == 104 and all(r["band"] == f"b{int(r['v'])}" for r in got)


@pytest.mark.parametrize("plan_cuts", [4096, 300, 3])
def test_banded_against_a_plain_version(spark, plan_cuts):
    """As arrays in the plan and by ranges: gaps, cuts themselves, nulls, empty bands, and values that many rows have."""
    rng = random.Random(1)
    cuts = sorted(rng.uniform(0, 100) for _ in range(301))
    rows = [(f"b{i}", a, b if i % 7 else (a + b) / 2) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [("empty", 5.0, 5.0), ("open", None, 3.0), ("closed", 200.0, None)]
    values = list(enumerate([rng.uniform(-5, 105) for _ in range(300)] + cuts + [None, float("nan"), float("inf"), -float("inf")] + [50.0] * 600))
    df = spark.createDataFrame(values, "id int, v double")
    bands = spark.createDataFrame(rows, "band string, `from` double, `to` double")
    want = {i: next((b for b, f, t in rows if None not in (v, f, t) and f <= v < t), None) for i, v in values}
    out = A.banded(df, "v", bands, plan_cuts)
    assert out.columns == ["id", "v", "band"] and {r["id"]: r["band"] for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_bands_refuse_overlaps_and_name_rows_outside(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 7.0), (3, None), (4, float("nan"))], "id int, v double")
    bands = lambda rows: spark.createDataFrame(rows, "band string, `from` double, `to` double")
    for plan_cuts in (4096, 1):
        with pytest.raises(Exception, match="bands overlap"):
            A.banded(df, "v", bands([("a", 0.0, 2.0), ("b", 1.0, 3.0), ("c", 4.0, 5.0)]), plan_cuts).collect()
    split = A.split_by_band(df, "v", bands([("a", 0.0, 1.0)]))
    assert bag(split.ok) == [(1, 0.5, "a")] and sorted(r["id"] for r in split.rejected.collect()) == [2, 3, 4]
    with pytest.raises(ValueError, match="outside.*7.0"):
        R.strict(split.rejected.filter("v = 7"), "outside")
    assert {r["band"] for r in A.banded(df, "v", bands([])).collect()} == {None}


@pytest.mark.parametrize("bounds", [{}, {"task_weights": 20, "cuts": 4}, {"task_weights": 1, "cuts": 7}])
def test_kept_fraction_cut_by_refined_ranges(spark, bounds):
    rng = random.Random(3)
    rows = [("hot", rng.choice([1.5, rng.uniform(0, 9), rng.gauss(0, 1e6)])) for _ in range(900)] + [("one", 2.0), (None, 1.0), (None, 3.0), ("same", 4.0), ("same", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, w double").repartition(4)
    for fraction in (0.0, 0.77):
        want = {}
        for g in {g for g, w in rows if w is not None}:
            own = sorted(w for x, w in rows if x == g and w is not None)
            want[g] = own[int((1 - fraction) * (len(own) - 1) // 1)]
        assert dict(map(tuple, A.kept_fraction_cut(df, "g", "w", fraction, **bounds).collect())) == want


@pytest.mark.parametrize("task_nodes", [1 << 19, 40])
def test_chains_by_contraction(spark, task_nodes):
    rng = random.Random(4)
    nodes = rng.sample(range(10_000), 300)
    chains, at = [], 0
    while at < len(nodes):
        n = rng.choice([1, 2, 5, 60])
        chains.append(nodes[at : at + n])
        at += n
    rows = [(x, c[i - 1] if i else None) for c in chains for i, x in enumerate(c)]
    rng.shuffle(rows)
    want = sorted((x, c[0], i) for c in chains for i, x in enumerate(c))
    assert sorted(tuple(r) for r in S._ranked(spark.createDataFrame(rows, "node long, prev long"), task_nodes).collect()) == want
    named = spark.createDataFrame([((f"r{a}", a % 2), None if b is None else (f"r{b}", b % 2)) for a, b in rows], "node struct<ref:string,d:int>, prev struct<ref:string,d:int>")
    assert sorted((int(r["node"]["ref"][1:]), int(r["head"]["ref"][1:]), r["rank"]) for r in S._ranked(named, task_nodes).collect()) == want


GROWTH = "atom string, frame string, population long, score double, lon double, lat double, seat boolean"


def grown_plainly(atoms, edges, rule):
    """Unit after unit, over all atoms of a frame."""
    from math import asin, cos, radians, sin, sqrt

    own, near, centre = {a[0]: a for a in atoms}, {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def km(a, b):
        (x, y), (u, v) = (map(radians, own[k][4:6]) for k in (a, b))
        return 2 * 6371.0 * asin(min(1, sqrt(sin((v - y) / 2) ** 2 + cos(y) * cos(v) * sin((u - x) / 2) ** 2)))

    first = {a[0]: bool(a[6]) and a[3] is not None and a[3] >= rule.floor for a in atoms}
    for seats in (True, False):
        for c in sorted(own, key=lambda a: (-own[a][2], a)):
            if c in centre or seats and not first[c]:
                continue
            unit, total = [c], own[c][2]
            centre[c] = (c, "seat" if seats else "fallback")
            while True:
                edge = {b for a in unit for b in near.get(a, ()) if b not in centre and own[b][1] == own[c][1] and km(c, b) <= rule.km and total + own[b][2] <= rule.ceiling}
                if not edge:
                    break
                b = min(edge, key=lambda b: (km(c, b), b))
                centre[b], total = centre[c], total + own[b][2]
                unit.append(b)
    return sorted(((own[a][1], a, *centre[a], own[a][2]) for a in own), key=repr)


def test_grown_against_a_plain_version(spark):
    atoms, edges = grid()
    cut = [(a, b) for a, b in edges if {a[2], b[2]} != {"1", "2"}]  # each frame falls into two pieces
    rows = [(x, None if f == "g" else f, *rest) for x, f, *rest in atoms]
    rule = P.Rule(3000, 200.0, 0.5)
    a, e = spark.createDataFrame(rows, GROWTH), spark.createDataFrame(cut, "src string, dst string")
    for block in (20_000, 4):
        assert bag(P.grown(a, e, rule, block_atoms=block)) == grown_plainly(rows, cut, rule)


@pytest.mark.parametrize("km, ceiling", [(25.0, 900), (60.0, 10**6), (12.0, 400), (400.0, 2500)])
def test_grown_in_blocks_against_a_plain_version(spark, km, ceiling):
    """Many centres a round, over the date line and near a pole, with ties; the blocks change nothing."""
    rng = random.Random(km)
    n = 26
    atoms = []
    for i, j in itertools.product(range(n), range(n)):
        lon, lat = (178 + 0.1 * j, 10 + 0.1 * i) if i < 20 else (15.0 * j, 89.0 + 0.03 * (i - 20))
        atoms.append((f"a{i:02}{j:02}", "f" if j < 23 else "g", rng.choice([50, 50, 100, 300, 301]), rng.random(), lon - 360 * (lon > 180), lat, rng.random() < 0.1))
    edges = both([(f"a{i:02}{j:02}", f"a{x:02}{y:02}") for i, j in itertools.product(range(n), range(n)) for x, y in ((i + 1, j), (i, j + 1), (i + 1, j + 1)) if x < n and y < n and rng.random() < 0.8])
    rule = P.Rule(ceiling, km, 0.4)
    a, e = spark.createDataFrame(atoms, GROWTH), spark.createDataFrame(edges, "src string, dst string")
    want = grown_plainly(atoms, edges, rule)
    assert bag(P.grown(a, e, rule)) == want
    assert bag(P.grown(a, e, rule, block_atoms=40)) == want


def test_grown_of_nothing(spark):
    a, e = spark.createDataFrame([], GROWTH), spark.createDataFrame([], "src string, dst string")
    assert P.grown(a, e, P.Rule(10, 1.0, 0.5)).count() == 0


def test_components_on_each_way(spark):
    """In one task, with the star rounds, and between: paths, cliques and random edges of numbers, names and structs."""
    rng = random.Random(2)
    of = {"long": lambda i: i, "string": lambda i: f"é{i}", "struct<a:boolean,b:bigint,c:string>": lambda i: (i % 3 == 0, i if i % 5 else None, str(i))}
    key = lambda x: (x[0], (x[1] is not None, x[1] or 0), x[2]) if isinstance(x, tuple) else x
    for kind, node in of.items():
        ids = rng.sample(range(400), 400)
        pairs = [(ids[i], ids[i + 1]) for i in range(150) if i % 37] + [(ids[rng.randrange(160, 300)], ids[rng.randrange(160, 300)]) for _ in range(120)]
        pairs += [(ids[300 + 10 * (i // 20) + rng.randrange(10)], ids[300 + 10 * (i // 20) + rng.randrange(10)]) for i in range(200)]
        rows = [(node(a), node(b)) for a, b in pairs] + [(None, node(3)), (node(5), node(5))]
        rng.shuffle(rows)
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in rows:
            if a is not None and a != b:
                a, b = find(key(a)), find(key(b))
                root[max(a, b)] = min(a, b)
        df = spark.createDataFrame(rows, f"src {kind}, dst {kind}").repartition(5)
        plain = lambda x: key(tuple(x)) if isinstance(x, tuple) else x
        for bound in (1 << 19, 150, 15):
            got = {plain(r[0]): plain(r[1]) for r in connected_components(df, task_edges=bound).collect()}
            assert got == {x: find(x) for x in list(root)}


def test_near_pairs_and_boxes_against_all_pairs(spark):
    from math import asin, cos, radians, sin, sqrt

    rng = random.Random(7)
    places = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)] + [(x, y) for x in (-180.0, -179.9, 179.95, 180.0) for y in (-89.99, -60.0, 0.0, 89.5, 90.0)] + [(10.0, 50.0 + k / 40) for k in range(20)] + [(10.0 + k / 20, 50.0) for k in range(20)]
    km = lambda p, q: 2 * 6371.0 * asin(min(1, sqrt(sin(radians(q[1] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[0] - p[0]) / 2) ** 2)))
    for limit in (5.0, 150.0, 4000.0):
        got = S.near_pairs(spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lon double, lat double"), limit)
        want = sorted((i, j) for i, j in itertools.combinations(range(len(places)), 2) if km(places[i], places[j]) <= limit)
        assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    boxes = [(i, x, x + rng.choice((0, 1, 7)), y, y + rng.choice((0, 2, 9))) for i, (x, y) in enumerate((rng.randrange(-20, 20), rng.randrange(-20, 20)) for _ in range(60))]
    b = spark.createDataFrame([(i, *map(float, r)) for i, *r in boxes], "id int, x0 double, x1 double, y0 double, y1 double")
    want = sorted((p[0], q[0]) for p in boxes for q in boxes if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4])
    assert sorted(tuple(r) for r in S.box_pairs(b, b, 3.0).collect()) == want
    assert sorted(tuple(r) for r in S.box_pairs(b, b).collect()) == want


def test_points_in_a_long_ring_against_parity(spark):
    rng = random.Random(9)
    ring = [(float(k), (5.0 if k % 2 else 1.0) + rng.random()) for k in range(40)] + [(39.0, -3.0), (0.0, -3.0)]
    ring.append(ring[0])
    points = [(i, rng.uniform(-1, 40), rng.uniform(-4, 7)) for i in range(200)]
    inside = [i for i, px, py in points if sum((a[1] > py) != (b[1] > py) and px < (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1]) + a[0] for a, b in itertools.pairwise(ring)) % 2]
    v = spark.createDataFrame([("r", i, x, y) for i, (x, y) in enumerate(ring)], "geom string, seq int, x double, y double")
    got = S.points_in_rings(spark.createDataFrame(points, "id int, x double, y double"), v, ["geom"], 1.5)
    assert sorted(r["id"] for r in got.collect()) == inside


def test_stitched_rings(spark):
    def fragment(geom, ref, *points):
        return [(geom, ref, i, float(x), float(y)) for i, (x, y) in enumerate(points)]

    rows = fragment("two", 1, (0, 0), (4, 0), (4, 4)) + fragment("two", 2, (0, 0), (0, 4), (4, 4))
    rows += fragment("one", 3, *SQUARE) + fragment("one", 4, (9, 9))
    rows += fragment("open", 5, (0, 0), (1, 0)) + fragment("open", 6, (2, 0), (1, 0))
    rows += fragment("many", 7, (0, 0), (4, 0)) + fragment("many", 8, (4, 4), (4, 0)) + fragment("many", 9, (0, 4), (4, 4)) + fragment("many", 10, (0, 4), (0, 0)) + fragment("many", 11, (20, 20), (24, 20), (24, 24), (20, 20))
    rows += fragment("star", 12, (0, 0), (1, 0)) + fragment("star", 13, (0, 0), (0, 1)) + fragment("star", 14, (0, 0), (-1, 0))
    random.Random(3).shuffle(rows)
    rings, counts, branches = S.stitched(spark.createDataFrame(rows, "geom string, ref long, seq int, x double, y double"), ["geom"])
    assert bag(counts) == [("many", 2, 0), ("one", 1, 0), ("open", 0, 1), ("star", 0, 3), ("two", 1, 0)]
    assert bag(branches) == [("star", 0.0, 0.0)]
    area = {(r["geom"], r["ring"]): abs(r["doubled"]) / 2 for r in S.doubled_areas(rings, ["geom", "ring"]).collect()}
    assert area == {("two", 1): 16.0, ("one", 3): 16.0, ("many", 7): 16.0, ("many", 11): 8.0}
    ends = rings.groupBy("geom", "ring").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in ends)


def test_category_regions_leave_out_what_they_must_not_place(spark):
    scope = spark.createDataFrame([(x,) for x in "AABCDEFG"], "atom string")
    facts = spark.createDataFrame([("A", "Alpha", 5), ("B", "Alpha", 4), ("C", None, 3), ("D", "Alpha", 9), ("E", "Beta", None), ("F", "Beta", 1), ("Z", "Beta", 1)], "atom string, category string, population int")
    r = G.category_regions(scope, facts, lambda m: spark.createDataFrame(LINE, "src string, dst string"))
    assert bag(r.refused) == [("A", "named twice"), ("E", "no population"), ("G", "no facts")] and bag(r.unassigned) == [("C",)]
    assert {(x["component"], x["name"]) for x in r.regions.collect()} == {("B", "Alpha (B)"), ("D", "Alpha (D)"), ("F", "Beta")}


def test_gate_and_digests(spark, tmp_path):
    import hashlib

    from tierwise.sources import artifacts as SA

    df = spark.createDataFrame([("way", True, None)] * 9 + [("way", False, None), ("node", None, None)], "type string, geometry boolean, remark string")
    tell = lambda d, least, remark=None: tuple(SA.gate(d, F.col("type"), F.col("geometry"), SA.Gate("way", least), remark).first())
    assert tell(df, 10) == (10, 1, 0.1, 0, True) and tell(df, 11)[-1] is False
    assert tell(df, 10, F.col("remark"))[-1] is True
    assert tell(df.union(spark.createDataFrame([("node", True, "timed out")], df.schema)), 10, F.col("remark")) == (10, 2, 0.1, 1, False)
    assert tell(df.limit(0), 1) == (0, 0, None, 0, False)
    (tmp_path / "a.json").write_bytes(b"{}")
    (tmp_path / "b.json").write_bytes(b"\xff\x00" * 1000)
    want = sorted((f.name, f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.glob("*.json"))
    assert bag(SA.digests(spark, str(tmp_path))) == want


def test_envelopes_in_ranges(spark, tmp_path):
    """Brackets, quotes and escapes in text, other fields on both sides, any piece and range size, several files."""
    import json

    from tierwise.sources import artifacts as SA
    from tierwise.sources import envelopes as SE

    rng = random.Random(7)
    odd = ['a"b', "x\\", "}]{[", "é日本", '\\"', "line\nbreak", "", ":", '"elements": [']
    elements = [{"type": "node", "id": i, "tags": {rng.choice(odd): rng.choice(odd)}, "members": [{"type": "way", "ref": i, "role": rng.choice(odd)}] * (i % 3)} for i in range(60)]
    whole = {"note": {"elements": [1, {"a": "]"}]}, 'el"em': [{"x": 1}], "elements": elements, "remark": 'cut "short"', "list": [[], {}]}
    (tmp_path / "a.json").write_text(json.dumps(whole, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"elements": elements[:5]}, indent=2))
    for name, value in (("none", {"remark": "x"}), ("null", {"elements": None}), ("empty", {"elements": []}), ("other", [1])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    for piece in (1, 7, 64, 1 << 20):
        for size in (1, 300, 1 << 20):
            text = (tmp_path / "a.json").read_bytes()
            envelope, ranges = SE.walked(str(tmp_path / "a.json"), "elements", size, piece)
            assert json.loads(envelope) == whole | {"elements": []}
            assert [e for a, b in ranges for e in json.loads(b"[" + text[a:b].lstrip(b", ") + b"]")] == elements
            assert len(ranges) == {1: 60, 1 << 20: 1}.get(size, len(ranges))
    for size in (1, 1 << 20):
        got = SA.read_elements(spark, str(tmp_path), size).select("remark", "id", "tags", F.size("members").alias("n")).collect()
        want = [(r, e["id"], e["tags"], len(e["members"])) for r, own in (('cut "short"', elements), (None, elements[:5])) for e in own]
        assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    keyed = {'k"{' + str(i): {"region": i, "number": -i} for i in range(40)}
    (tmp_path / "keyed").mkdir()
    (tmp_path / "keyed" / "k.json").write_text(json.dumps({"districts": keyed, "z": 1}))
    for size in (1, 1 << 20):
        assert bag(SA.read_keyed(spark, str(tmp_path / "keyed"), "districts", "region: int, number: int", size)) == sorted(((k, v["region"], v["number"]) for k, v in keyed.items()), key=repr)
    (tmp_path / "bad.json").write_text('{"elements": [{"id": 1}, {"id"')
    with pytest.raises(Exception, match="ends early"):
        SA.read_elements(spark, str(tmp_path / "bad.json")).collect()


def test_artifact_is_published_whole(spark, tmp_path):
    """A reader sees the last published run with the digests of its sources; a run that fails leaves it."""
    import hashlib

    from tierwise.sources import artifacts as SA

    path, source = str(tmp_path / "artifact"), tmp_path / "s.bin"
    source.write_bytes(bytes(range(256)) * 50_000)  # longer than a piece
    with pytest.raises(ValueError, match="nothing is published"):
        SA.read_artifact(spark, path)
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    stamp = spark.createDataFrame([("first",)], "built string")
    SA.write_artifact(rows, path, "k", stamp, SA.digests(spark, str(source)))
    SA.write_artifact(rows.filter("k = 'a'"), path, "k", spark.createDataFrame([("second",)], "built string"), SA.digests(spark, str(source)))
    with pytest.raises(Exception, match="by zero|DIVIDE"):
        SA.write_artifact(rows.withColumn("v", F.expr("v div (v - 1)")), path, "k", stamp)
    got, provenance = SA.read_artifact(spark, path)
    assert bag(got) == [("a", 1)] and provenance.first()["built"] == "second"
    want = [("s.bin", 256 * 50_000, hashlib.sha256(source.read_bytes()).hexdigest())]
    assert [tuple(x) for x in provenance.first()["sources_read"]] == want


def test_remainders_are_never_empty(spark):
    from tierwise.operators import windows as WI

    roster = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3), ("h", 4)], "frame string, atom int")
    frames, claims = spark.createDataFrame([("f",), ("g",), ("x",), ("g",)], "frame string"), spark.createDataFrame([(2,), (3,), (None,)], "atom int")
    split = WI.remainders(roster, frames, claims, "frame", "atom")
    assert bag(split.ok.select("frame", "atom")) == [("f", 1)]
    assert bag(split.rejected) == [("g", "nothing left"), ("x", "not in the roster")]
    with pytest.raises(ValueError, match="remainder.*nothing left"):
        R.strict(split.rejected, "remainder")


def test_tagged_rows_are_counted_and_refused_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (None, "b", 1.0), (3, " ", 1.5), (4, None, -1.0), (5, "e", None)], "id int, name string, n double")
    rows = R.tagged(df, {"id": F.col("id").isNotNull(), "name": R.is_text(F.col("name")), "n": R.is_optional_count(F.col("n"))})
    assert [r["tag"] for r in rows.orderBy(F.asc_nulls_first("id")).collect()] == ["id", "ok", "name", "name", "ok"]
    seen_rows, seen = R.observed(rows, ["ok", "id", "n"])
    seen_rows.collect()
    assert seen.get == {"ok": 2, "id": 1, "n": 0, "other": 2}
    assert bag(R.refusing(rows.filter("tag = 'ok'"), "cells")) == [(1, "a", 2.0), (5, "e", None)]
    with pytest.raises(Exception, match='cells: .*"tag":"id"'):
        R.refusing(rows, "cells").collect()


def test_tagged_facts_account_for_every_row(spark):
    """One scan of the facts, a third of them without an atom; the parts are those of the separate joins."""
    rng = random.Random(5)
    facts = [(i, rng.choice([None, "a", "b", "c", "zz"]), rng.choice(["f", "g", None])) for i in range(300)]
    f = spark.createDataFrame(facts, "id int, atom string, frame string")
    r = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", None), ("d", "g")], "atom string, frame string")
    rows = J.tagged_facts(f, r, "frame")
    frame = {"a": "f", "b": "g", "c": None}
    want = [(i, a, x, frame.get(a), "unmatched" if a not in frame else "ok" if x == frame[a] else "misplaced") for i, a, x in facts] + [(None, "d", None, "g", "missing")]
    assert bag(rows.select("id", "atom", "frame", "roster_frame", "tag")) == sorted(want, key=repr)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD[id") == 1
    parts, whole = J.apart(rows, J.FACT_TAGS), J.facts_to_roster(f, r, "frame")
    assert bag(parts["ok"].select("id", "atom")) == bag(whole.ok.select("id", "atom")) and bag(parts["misplaced"].select("id")) == bag(whole.misplaced.select("id"))
    assert bag(parts["missing"].select("atom")) == bag(whole.missing.select("atom"))
    assert J.tagged_facts(f.limit(0), r, "frame").filter("tag = 'missing'").count() == 4


def test_growth_queries_against_a_plain_version(spark):
    """g7, g10 and g21 on the smallest tables: the rule applied one centre after another to the rows of the tables."""
    import duckdb

    from tierwise.plans.partitions import RULE
    from tierwise.registry import QUERIES

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("supplier", "nation", "lineitem"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    atoms = con.execute("""select s_suppkey, n_regionkey, cast(floor(s_acctbal) as bigint), (s_suppkey % 97) / 96.0, 60 + (s_suppkey * 37 % 200) / 10.0, 24 + (s_suppkey * 53 % 130) / 10.0,
        row_number() over (partition by s_nationkey order by floor(s_acctbal) desc, s_suppkey) = 1 from supplier join nation on s_nationkey = n_nationkey""").fetchall()
    edges = con.execute("select distinct a.l_suppkey, b.l_suppkey from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_shipdate = b.l_shipdate and a.l_suppkey <> b.l_suppkey").fetchall()
    want = grown_plainly(atoms, edges, RULE)
    assert bag(QUERIES["g7_grown"](spark, data).select("frame", "atom", "centre", "centre_kind", "population")) == want
    units = {}
    for _, _, centre, kind, population in want:
        total, n, _ = units.get(centre, (0, 0, kind))
        units[centre] = (total + population, n + 1, kind)
    got = QUERIES["g10_unit_list"](spark, data).collect()
    assert sorted((r["centre"], r["population"], r["atoms"], r["centre_kind"]) for r in got) == sorted((c, *v) for c, v in units.items())
    assert len({r["unit"] for r in got}) == len(got) and [r["population"] for r in got] == sorted((r["population"] for r in got), reverse=True)
    rule = {(f"around {centre}", atom) for _, atom, centre, _, _ in want}
    derived = QUERIES["g21_derived_variants"](spark, data)
    assert {(r["unit"], r["atom"]) for r in derived.filter("variant = 'rule'").collect()} == rule


def test_grid_follows_the_points(spark):
    """A third of all points in a place as small as a billionth: cells stay even, and results are those of a fixed grid."""
    rng = random.Random(9)
    points = [(i, 5 + rng.random() * 1e-9, 5 + rng.random() * 1e-9) if i % 3 == 0 else (i, rng.uniform(-100, 100), rng.uniform(-100, 100)) for i in range(3000)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)]
    p = spark.createDataFrame(points, "id int, x double, y double")
    grid = S.DenseGrid(p, "x", "y", 16)
    sizes = p.filter("id >= 0").withColumn("cx", grid.x(F.col("x"))).withColumn("cy", grid.y(F.col("y"), F.col("cx"))).groupBy("cx", "cy").count()
    assert sizes.count() > 200 and sizes.agg(F.max("count")).first()[0] < 40
    ring = lambda g, x, y, r: [(g, i, x + a * r, y + b * r) for i, (a, b) in enumerate(((-1, -1), (1, -1), (1.1, 0.3), (0, 1), (-1, -1)))]
    v = spark.createDataFrame([*ring("all", 0.0, 0.0, 90.0), *ring("tiny", 5.0, 5.0, 5e-10), *ring("far", 300.0, 300.0, 1.0)], "geom string, seq int, x double, y double")
    got = sorted(tuple(r) for r in S.points_in_rings(p, v, ["geom"]).collect())
    assert got == sorted(tuple(r) for r in S.points_in_rings(p, v, ["geom"], 20.0).collect()) and len({g for _, g in got}) == 2
    assert S.points_in_rings(p.limit(0), v, ["geom"]).count() == 0


def test_run_folder_is_deleted(spark):
    import os

    from tierwise.sources.storage import fresh_path, run_folder, shared_folder, written

    base = shared_folder(spark).removeprefix("file://")
    with run_folder(spark) as outer:
        a = written(spark.range(5), "a")
        with pytest.raises(KeyError), run_folder(spark) as inner:
            assert inner.startswith(outer) and written(spark.range(3), "b").count() == 3
            raise KeyError
        assert not os.path.exists(inner.removeprefix("file://")) and a.count() == 5
    assert not os.path.exists(outer.removeprefix("file://"))
    assert fresh_path(spark, "c").removeprefix("file://").startswith(f"{base}/c-")
    with run_folder(spark):
        pass


def test_boxes_of_one_cell_are_dealt_over_tasks(spark):
    b = spark.range(60).selectExpr("cast(id as int) as id", "id / 100 as x0", "id / 100 + 3 as x1", "0.0D as y0", "2.0D as y1")
    for cell in (5.0, None):
        pairs = S.box_pairs(b, b, cell, part_boxes=8).withColumn("task", F.spark_partition_id())
        assert pairs.count() == 3600 and pairs.select("a", "b").distinct().count() == 3600
        assert pairs.select("task").distinct().count() > 3


def test_boxes_of_large_cells_meet_as_in_sql(spark):
    rng = random.Random(5)
    coarse = lambda k: [rng.randrange(k) / 2 for _ in range(4)]
    rows = [(i, x, x + w, y, y + h) for i, (x, y, w, h) in enumerate(coarse(12) for _ in range(150))]
    rows += [(200, 1.0, float("nan"), 0.0, 1.0), (201, 2.0, 1.0, 0.0, 3.0), (202, 0.0, 2.0, -0.0, 0.0), (None, 0.0, 9.0, 0.0, 9.0), (203, None, 1.0, 0.0, 1.0)]
    boxes = spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double").filter("not isnan(x1)")
    other = boxes.filter("id % 3 = 0 or id is null")
    kinds = {"long": "id", "string": "concat('k', id)", "decimal(9,2)": "cast(id / 4 as decimal(9,2))"}
    for kind, own in kinds.items():
        a, b = (df.selectExpr(f"{own} as id", *(f"cast({c} as {'decimal(9,2)' if kind != 'long' else 'double'}) as {c}" for c in ("x0", "x1", "y0", "y1"))).filter("x0 <= x1") for df in (boxes, other))
        met = a.alias("p").join(b.alias("q"), F.expr("p.x0 <= q.x1 and q.x0 <= p.x1 and p.y0 <= q.y1 and q.y0 <= p.y1")).selectExpr("p.id as a", "q.id as b").cache()
        for cell in (50.0, 3.0) if kind == "long" else (50.0,):
            assert bag(S.box_pairs(a, b, cell, part_boxes=40)) == bag(met)
            assert bag(S.box_pairs(a, b, cell, part_boxes=40, ordered=True)) == bag(met.filter("a < b"))
    assert bag(S.box_pairs(boxes, other, 3.0, part_boxes=30)) == bag(S.box_pairs(boxes, other, 3.0, part_boxes=10**6))


def test_pairs_of_large_cells_take_little_room(spark, tmp_path):
    """All boxes overlap: their pairs come in an order in which files pack them."""
    b = spark.range(1500).selectExpr("id * 7919 % 1500 as id", "id / 1000 as x0", "id / 1000 + 3 as x1", "0.0D as y0", "2.0D as y1")
    S.box_pairs(b, b, 5.0, part_boxes=256).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 1500 * 1500
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1500 * 1500 / 2


def test_seats_of_equal_names_go_by_key(spark):
    rows = [(k, 1, float(k % 7), "Nation 1", "NATION_1") for k in range(40)]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, 40), "k long, tier int, size double, atom string, name string").repartition(4)
        assert [r["k"] for r in O.seats(df, ["tier"], "atom", "name", "size", ["k"]).collect()] == [0]


def test_sides_are_dealt_over_tasks_by_their_rows(spark):
    a, b = spark.range(0, 1000).withColumnRenamed("id", "k"), spark.range(400, 1500).union(spark.range(500, 600)).withColumnRenamed("id", "k")
    got = R.sides(a, b, "k", task_rows=100).withColumn("task", F.spark_partition_id())
    assert bag(got.select("k", "in_a", "in_b")) == sorted([(k, k < 1000, k >= 400) for k in range(1500)], key=repr)
    assert got.select("task").distinct().count() == 22
    none = spark.createDataFrame([(None,), (1,)], "k long")
    assert bag(J.coverage(none, none, "k")) == [(None, "missing"), (None, "unexpected")]


def test_chains_of_small_components_need_no_rounds(spark, monkeypatch):
    rng = random.Random(4)
    refs, rows, want, at = rng.sample(range(10**6), 400), [], {}, 0
    for size in [1, 2, 3, 5, 9, 40] * 6:
        own, closed = refs[at : at + size], size in (1, 3, 9) and at % 2 == 0
        at += size
        if closed:  # a ring is cut at its smallest ref
            low = own.index(min(own))
            own = own[low:] + own[:low]
        nodes = [10 * r for r in own] + [10 * own[0] if closed else -own[-1] - 1]
        rows += [(r, nodes[k], nodes[k + 1]) for k, r in enumerate(own)]
        want |= {r: (own[0], k, closed) for k, r in enumerate(own)}
    ways = spark.createDataFrame(rng.sample(rows, len(rows)), "ref long, first long, last long").repartition(5)
    got = lambda df: {r["ref"]: (r["chain"], r["rank"], r["closed"]) for r in df.collect()}
    for bound in (6, 1):
        assert got(S.directed_chains(ways, bound)[0]) == want
    open_ends = {r["ref"]: (r["chain"], r["closed"]) for r in S.undirected_chains(ways, 6)[0].collect()}
    names = {}
    for r, (head, _, _) in want.items():
        names[head] = min(names.get(head, r), r)
    assert open_ends == {r: (names[head], closed) for r, (head, _, closed) in want.items()}
    monkeypatch.setattr(S, "_ranked", lambda *_: pytest.fail("ranked in rounds"))
    assert got(S.directed_chains(ways)[0]) == want


def test_derived_variants_make_their_edges_once(spark, monkeypatch):
    from tierwise.plans import partitions as PP
    from tierwise.registry import QUERIES

    names, plain = [], PP.written
    monkeypatch.setattr(PP, "written", lambda df, name: names.append(name) or plain(df, name))
    assert QUERIES["g21_derived_variants"](spark, "/root/testdata/sf0.001").count() > 0 and names == ["edges"]
