"""Units grown by a rule, many at once: the same units as if one centre were grown after another.

In the plain order a centre is the largest qualifying seat that is free, later the largest atom that is, and takes the
nearest free neighbour of its unit that keeps both limits until there is none. A unit stays within ``km`` of its
centre, so two centres more than 2 km apart never meet, and a centre may grow as soon as no better-ranked free atom
is left within 2 km of it: whatever is still to happen happens elsewhere or later.

Atoms are therefore dealt by cubes of space (points of the sphere in three dimensions, where the distance is never longer
than on the sphere, and which has neither poles nor a date line), with everything within 2 km beside a cube. A task goes
through the free atoms of its cube by rank; those beside it, whose own neighbourhood it does not see, stay open, and so do
all that are within 2 km behind an open one. Every other decision is final, whichever task makes it. What stays open goes
into the next round, with cubes in other places. The best-ranked free atom is decided in each round, so rounds end.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

EARTH_KM = 6371.0
UNITS = "frame {frame}, atom {atom}, centre {atom}, centre_kind string, population {population}"


@dataclass(frozen=True)
class Rule:
    """No unit above ``ceiling``, no member farther than ``km`` from its centre, no seat below ``floor`` as a first centre."""

    ceiling: int
    km: float
    floor: float


def _chord(km: float) -> float:
    """An upper bound of the straight distance of points ``km`` apart, rounding included."""
    return min(km, 2 * EARTH_KM) * (1 + 1e-9) + 1e-6


class _Open:
    """Places of open atoms in cells as wide as the distance that matters."""

    def __init__(self, reach: float):
        self.reach, self.cells = reach, defaultdict(list)

    def _cell(self, p) -> tuple[int, int, int]:
        return tuple(math.floor(c / self.reach) for c in p)

    def add(self, p) -> None:
        self.cells[self._cell(p)].append(p)

    def near(self, p) -> bool:
        if not self.cells:
            return False
        x, y, z = self._cell(p)
        around = (self.cells.get((x + i, y + j, z + k), ()) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))
        return any((a - p[0]) ** 2 + (b - p[1]) ** 2 + (c - p[2]) ** 2 <= self.reach**2 for cell in around for a, b, c in cell)


def _grow(rule: Rule):
    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("atom")
        names = rows.column("atom").to_pylist()
        population, lon, lat = rows.column("population").to_pylist(), *(np.radians(rows.column(c).to_numpy().astype(float)) for c in ("lon", "lat"))
        place = {a: i for i, a in enumerate(names)}
        near = [np.array([place[b] for b in own if b in place], np.int64) for own in rows.column("neighbours").to_pylist()]
        first, inside = rows.column("first").to_pylist(), rows.column("inside").to_pylist()
        points = list(zip(*(rows.column(c).to_pylist() for c in "xyz")))
        order = sorted(range(len(names)), key=lambda i: (not first[i], -population[i], i))
        centre, open_ = np.full(len(names), -1), _Open(_chord(2 * rule.km))
        for c in order:
            if centre[c] >= 0:
                continue
            if not inside[c] or open_.near(points[c]):
                open_.add(points[c])
                continue
            edge: list[tuple[float, int]] = []
            seen, total, take = {c}, population[c], c
            while True:
                centre[take] = c
                free = near[take][centre[near[take]] < 0]
                h = np.sin((lat[free] - lat[c]) / 2) ** 2 + np.cos(lat[free]) * np.cos(lat[c]) * np.sin((lon[free] - lon[c]) / 2) ** 2
                for km, j in zip((2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))).tolist(), free.tolist()):
                    if km <= rule.km and j not in seen:
                        seen.add(j)
                        heapq.heappush(edge, (km, j))
                while edge and total + population[edge[0][1]] > rule.ceiling:
                    heapq.heappop(edge)  # totals only rise, so what does not fit now never will
                if not edge:
                    break
                take = heapq.heappop(edge)[1]
                total += population[take]
        done = np.flatnonzero(centre >= 0)
        at = pa.array(centre[done])
        taken = rows.take(pa.array(done))
        kind = pa.array(["seat" if first[i] else "fallback" for i in centre[done]], pa.string())
        return pa.table([taken.column("frame"), taken.column("atom"), rows.column("atom").take(at), kind, taken.column("population")], names=["frame", "atom", "centre", "centre_kind", "population"])

    return grow


def _with_neighbours(atoms: DataFrame, edges: DataFrame, rule: Rule) -> DataFrame:
    """Atoms with their place in space, whether they may be first centres, and their neighbours of the frame within 2 km."""
    lon, lat = F.radians("lon"), F.radians("lat")
    at = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    own = atoms.select("frame", "atom", "population", "lon", "lat", (F.col("seat") & (F.col("score") >= rule.floor)).alias("first"), *[F.coalesce(EARTH_KM * c, F.lit(0.0)).alias(n) for n, c in at.items()])
    own = own.withColumn("first", F.coalesce("first", F.lit(False)))
    a = own.select(F.col("atom").alias("src"), F.col("frame").alias("fa"), *[F.col(c).alias(f"{c}a") for c in "xyz"])
    b = own.select(F.col("atom").alias("dst"), F.col("frame").alias("fb"), *[F.col(c).alias(f"{c}b") for c in "xyz"])
    apart = sum((F.pow(F.col(f"{c}a") - F.col(f"{c}b"), 2) for c in "xyz"), F.lit(0.0))
    met = edges.select("src", "dst").join(a, "src").join(b, "dst").filter(F.col("fa").eqNullSafe(F.col("fb")) & (apart <= _chord(2 * rule.km) ** 2))
    near = met.groupBy(F.col("src").alias("atom")).agg(F.collect_set("dst").alias("neighbours"))
    return own.join(near, "atom", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(near.schema["neighbours"].dataType)))


def grown(atoms: DataFrame, edges: DataFrame, rule: Rule, block_atoms: int = 20_000) -> DataFrame:
    """Units of each frame as (frame, atom, centre, centre_kind, population), centre_kind ``seat`` or ``fallback``.

    ``atoms`` has atom, frame, population, score, lon, lat, seat; ``edges`` (src, dst) both directions; edges between
    frames do not count. Ties go to the smaller atom. Cubes hold about ``block_atoms`` atoms, and more only where the
    limit of distance itself lets so many atoms compete for one another; the bound does not change the units.
    """
    types = {f.name: f.dataType.simpleString() for f in atoms.schema.fields}
    schema = UNITS.format(**types)
    free = written(_with_neighbours(atoms, edges, rule), "growth")
    size = free.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{w}") for c in "xyz" for w, f in (("0", F.min), ("1", F.max))])
    size = size.agg(F.max("n").alias("n"), F.max(F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"])).alias("wide")).first()
    if not size["n"] or size["n"] <= block_atoms:
        return free.withColumn("inside", F.lit(True)).groupBy("frame").applyInArrow(_grow(rule), schema)
    reach = _chord(2 * rule.km)
    side = max(2 * reach, size["wide"] / math.sqrt(size["n"] / block_atoms))
    units, turn = None, 0
    while True:
        shift = {c: side * math.modf((turn + 1) * k)[0] for c, k in zip("xyz", (0.618034, 0.414214, 0.732051))}
        cell = lambda c, by: F.floor((F.col(c) + by + shift[c]) / side)  # noqa: B023, E731
        dealt = free
        for c in "xyz":
            dealt = dealt.withColumn(f"c{c}", cell(c, 0)).withColumn(f"b{c}", F.explode(F.array_distinct(F.array(cell(c, -reach), cell(c, 0), cell(c, reach)))))
        dealt = dealt.withColumn("inside", (F.col("bx") == F.col("cx")) & (F.col("by") == F.col("cy")) & (F.col("bz") == F.col("cz"))).drop("cx", "cy", "cz")
        found = written(dealt.groupBy("frame", "bx", "by", "bz").applyInArrow(_grow(rule), schema).distinct(), "units")
        units = found if units is None else units.unionByName(found)
        free = written(free.join(found.select("atom"), "atom", "left_anti"), "growth")
        if free.isEmpty():
            return units
        turn += 1
