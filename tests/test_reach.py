"""Components, levels and reaching sets against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessaline.operators import closure, reach
from tessaline.operators.kernels import strong_components

from .test_graph import nodes, random_graph
from .test_graph import reach as reached


def plain_components(n, edges):
    from_ = [reached(edges, v) | {v} for v in range(n)]
    return [min(u for u in range(n) if u in from_[v] and v in from_[u]) for v in range(n)]


def plain_levels(component, edges):
    level = {c: 0 for c in component}
    for _ in component:
        for a, b in edges:
            if component[a] != component[b]:
                level[component[b]] = max(level[component[b]], level[component[a]] + 1)
    return level


def test_strong_components_of_random_graphs():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        edges = random_graph(rng, n, rng.randint(0, 20))
        src, dst = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        component, level = strong_components(n, src, dst)
        want = plain_components(n, edges)
        assert all((component[a] == component[b]) == (want[a] == want[b]) for a in range(n) for b in range(n))
        levels = plain_levels(want, edges)
        assert all(level[component[v]] == levels[want[v]] for v in range(n))


@pytest.mark.parametrize("core_edges", [reach.CORE_EDGES, 0])
def test_condensed_by_one_task_and_in_rounds(spark, monkeypatch, core_edges):
    monkeypatch.setattr(reach, "CORE_EDGES", core_edges)
    rng = random.Random(11)
    for n, m in ((14, 22), (6, 20)) if core_edges else ((12, 20),):
        edges = random_graph(rng, n, m)
        found = {r["node"]: (r["component"], r["level"]) for r in reach.condense(spark.createDataFrame(edges, "src long, dst long")).collect()}
        want = plain_components(n, edges)
        levels = plain_levels(want, edges)
        assert found == {v: (want[v], levels[want[v]]) for v in {x for e in edges for x in e}}
    assert reach.condense(spark.createDataFrame([], "src long, dst long")).collect() == []


def plain_counts(edges, roots):
    seen = {r: reached(edges, r) - {r} for r in roots}
    found = {v: sum(v in s for s in seen.values()) for v in {b for _, b in edges}}
    return {v: k for v, k in found.items() if k}


@pytest.mark.parametrize("core_edges", [reach.CORE_EDGES, 0])
def test_reaching_roots_of_random_graphs(spark, monkeypatch, core_edges):
    monkeypatch.setattr(reach, "CORE_EDGES", core_edges)
    monkeypatch.setattr(reach, "COMBINE_BYTES", 8)
    rng = random.Random(7)
    for n, m in ((30, 45), (40, 120)) if core_edges else ((12, 20),):
        edges = random_graph(rng, n, m) + [(n + i, rng.randrange(n)) for i in range(20)]
        roots = [n + i for i in range(0, 20, 2)] + rng.sample(range(n), 5) + [999]
        got = closure.reaching_roots(spark.createDataFrame(edges + edges[:3], "src long, dst long"), spark.createDataFrame([(r,) for r in roots + roots[:2]], "node long"))
        assert {r["node"]: r["n_roots"] for r in got.collect()} == plain_counts(edges, roots)
        if not core_edges:
            continue
        named = [(f"f{a}", f"f{b}") for a, b in edges]
        got = closure.reaching_roots(spark.createDataFrame(named, "src string, dst string"), nodes(spark, *(f"f{r}" for r in roots)))
        assert {r["node"]: r["n_roots"] for r in got.collect()} == {f"f{v}": k for v, k in plain_counts(edges, roots).items()}


def test_sets_of_many_roots(spark):
    """More roots than a block has places, as lists and as bitmaps."""
    edges = [(10 + i, 1) for i in range(70_000)] + [(1, 2), (3, 2), (80_011, 3), (2, 3), (12, 4)]
    got = closure.reaching_roots(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(10 + i,) for i in range(70_000)] + [(80_011,)], "node long"))
    assert {r["node"]: r["n_roots"] for r in got.collect()} == {1: 70_000, 2: 70_001, 3: 70_001, 4: 1}


def test_united_sets():
    rng = np.random.default_rng(1)
    for sizes in ((1, 1), (5, 3000, 2), (4000, 4000), (40_000, 7), (60_000, 50_000), (0, 0)):
        sets = [np.unique(rng.integers(0, 1 << 16, k)) for k in sizes]
        told = pa.table({"node": [1] * len(sets) + [2], "block": [0] * len(sets) + [5], "marks": [*(reach.packed(s) for s in sets), reach.packed(sets[0])]}, pa.schema([("node", pa.int64()), ("block", pa.int64()), ("marks", pa.binary())]))
        got = reach.united(told).to_pylist()
        want = [(1, 0, np.unique(np.concatenate(sets))), (2, 5, sets[0])]
        assert [(r["node"], r["block"], r["n"]) for r in got] == [(a, b, len(m)) for a, b, m in want]
        assert all((reach.unpacked(r["marks"]) == m).all() for r, (_, _, m) in zip(got, want))


def test_roots_are_counted_without_sets_of_roots(spark, monkeypatch):
    """No set of roots goes along the edges between files: products of a block of roots and a block of files are."""
    spread, seen = reach.spread, []
    monkeypatch.setattr(reach, "spread", lambda dag, first: seen.append(first.agg({"n": "max"}).first()[0]) or spread(dag, first))
    monkeypatch.setattr(reach, "PAIRS", 16)
    edges = [(100 + i, i % 7) for i in range(300)] + [(i, 10 + j) for i in range(7) for j in range(i + 1)] + [(10, 20), (20, 21), (21, 20)]
    roots = [100 + i for i in range(300)]
    got = reach.reaching_roots(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(r,) for r in roots], "node long"))
    assert {r["node"]: r["n_roots"] for r in got.collect()} == plain_counts(edges, roots)
    assert seen == [1]
