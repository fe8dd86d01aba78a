"""Distances over contracted graphs against plain shortest ways."""

from __future__ import annotations

import heapq
import random

import pytest
from pelagia.operators import water
from pelagia.sinks.scratch import Scratch


def plain(edges: list[tuple], starts: list[tuple], cutoff: float | None) -> dict:
    beside: dict = {}
    for a, b, km in edges:
        if km is not None:
            beside.setdefault(a, []).append((b, km))
            beside.setdefault(b, []).append((a, km))
    out: dict = {}
    for seed in {s for s, *_ in starts}:
        best: dict = {}
        queue = [(first or 0.0, cell) for s, cell, first in starts if s == seed]
        heapq.heapify(queue)
        while queue:
            d, c = heapq.heappop(queue)
            if c in best or cutoff is not None and d > cutoff:
                continue
            best[c] = d
            for o, km in beside.get(c, ()):
                heapq.heappush(queue, (d + km, o))
        for s, cell, first in sorted(starts, key=lambda x: -(x[2] or 0.0)):
            if s == seed and cell not in best or s == seed and best[cell] > (first or 0.0):
                best[cell] = first or 0.0  # its own cell, however far
        out |= {(seed, c): d for c, d in best.items()}
    return out


EDGES, STARTS = "a long, b long, km double", "seed long, cell long, connector_km double"


@pytest.mark.parametrize(("core", "cutoff"), [(0, None), (5, 9.0), (30, None), (0, 4.0)])
def test_contracted_graphs(spark, monkeypatch, core, cutoff):
    monkeypatch.setattr(water, "CORE", core)  # the rest is relaxed in rounds where contraction ends early
    rng = random.Random(core)
    edges = [(a, b, float(rng.randint(1, 5))) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.09]
    edges += [(b, a, km + 1) for a, b, km in edges[:9]] + [(50, 51, 1.0), (60, 60, 1.0), (61, 62, None)] + [(100 + k, 101 + k, 1.0) for k in range(12)]
    starts = [(1, 0, 0.5), (1, 7, 2.0), (2, 3, None), (3, 50, 1.0), (4, 99, 1.0), (5, 106, 0.0), (6, 50, 30.0), (6, 51, 20.0)]
    got = water.water_distances(spark.createDataFrame(edges, EDGES), spark.createDataFrame(starts, STARTS), cutoff_km=cutoff, core=core).collect()
    assert {(r.seed, r.cell): r.distance for r in got} == plain(edges, starts, cutoff) and len({(r.seed, r.cell) for r in got}) == len(got)


def test_a_dense_core_is_relaxed(spark, monkeypatch):
    monkeypatch.setattr(water, "CORE", 3)
    monkeypatch.setattr(water, "MOST_NEIGHBOURS", 2)
    rng = random.Random(1)
    edges = [(a, b, float(rng.randint(1, 9))) for a in range(9) for b in range(a + 1, 9)] + [(8, 20, 1.0), (20, 21, 1.0)]
    starts = [(1, 0, 0.0), (2, 21, 1.0)]
    got = water.water_distances(spark.createDataFrame(edges, EDGES), spark.createDataFrame(starts, STARTS), core=3).collect()
    assert {(r.seed, r.cell): r.distance for r in got} == plain(edges, starts, None)


def test_rounds_of_a_long_path(spark):
    """10,000 edges in a row: rounds follow the logarithm, and a round writes ways of the cells that it takes out."""
    n = 10_000
    path = spark.range(n).selectExpr("id a", "id + 1 b", "double(id % 3 + 1) km")
    levels, left, many = water.contract(path, Scratch(spark, "test"), core=64)
    assert 2 * len(levels) < 40 and many <= 64 and left.count() == many
    sizes = [up.count() for up in levels]
    assert sum(sizes) <= 2 * n and all(b < a for a, b in zip(sizes, sizes[1:], strict=False))


@pytest.mark.parametrize("cutoff", [None, 13.0])
def test_a_plane_by_blocks(spark, monkeypatch, cutoff):
    """A plane of six neighbours a cell can't be contracted; rounds follow blocks of ten by ten."""
    monkeypatch.setattr(water, "CORE", 10)
    monkeypatch.setattr(water, "SEEDS", 2)
    n = 30
    cells = spark.range(n * n).selectExpr("id", f"id % {n} x", f"id div {n} y")
    edges = cells.selectExpr("id a", f"explode(array(if(x < {n - 1}, id + 1, null), if(y < {n - 1}, id + {n}, null), if(x < {n - 1} and y < {n - 1}, id + {n + 1}, null))) b", "double(1 + (id * 7) % 3) km").where("b is not null")
    starts = [(1, 0, 0.0), (2, 455, 1.0), (3, 899, None), (4, 77, 2.0), (4, 802, 0.0)]
    tables: list[str] = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: tables.append(name) or table(self, df, name))
    got = water.water_distances(edges, spark.createDataFrame(starts, STARTS), cutoff_km=cutoff, core=10, block=lambda c: (c % n / 10).cast("int") * 100 + (c / n / 10).cast("int")).collect()
    assert {(r.seed, r.cell): r.distance for r in got} == plain([tuple(r) for r in edges.collect()], starts, cutoff) and len({(r.seed, r.cell) for r in got}) == len(got)
    assert sum(t.startswith("held-") for t in tables) <= 8


def test_nearest_nodes_need_a_limit(spark):
    seeds = spark.createDataFrame([("s", 0.0, 0.0)], "seed string, x double, y double")
    nodes = spark.createDataFrame([(1, 100.0, 0.0)], "cell long, x double, y double")
    with pytest.raises(TypeError):
        water.nearest_nodes(seeds, nodes)
    with pytest.raises(ValueError):
        water.nearest_nodes(seeds, nodes, 3, 0.0)
