"""Graph operators and kernels against brute force on small graphs."""

import itertools
import random

import pytest

from tessaline.operators import closure, cuts
from tessaline.operators.kernels import INFINITE, edge_dominated_weights, min_cut
from tessaline.plans import catalog

GRAPH = [
    ("r1.cc", "a.h"), ("r1.cc", "b.h"), ("r2.cc", "b.h"), ("a.h", "c.h"), ("b.h", "c.h"), ("c.h", "d.h"), ("d.h", "c.h"), ("d.h", "d.h"),
    ("out/g.cc", "a.h"), ("c.h", "third_party/libc++/src/include/v"), ("third_party/libc++/src/include/v", "deep.h"), ("x.h", "y.h"),
]


def reach(edges, start, gone=()):
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        for i, (a, b) in enumerate(edges):
            if a == n and i not in gone and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def random_graph(rng, n, m):
    return list({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def test_dominated_edges_by_deletion():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(2, 8)
        edges = random_graph(rng, n, rng.randint(1, 14))
        weight = [rng.randint(0, 3) for _ in range(n)]
        whole = reach(edges, 0) | {0}
        want = [sum(weight[x] for x in whole - reach(edges, 0, {i}) - {0}) for i in range(len(edges))]
        assert edge_dominated_weights(n, edges, 0, weight) == want


def test_min_cut_by_subsets():
    rng = random.Random(6)
    for _ in range(120):
        n = rng.randint(2, 6)
        pairs = [e for e in random_graph(rng, n, rng.randint(1, 9)) if e[0] != e[1]]
        edges = [(a, b, INFINITE if rng.random() < 0.2 else 1.0) for a, b in pairs]
        finite = [i for i, e in enumerate(edges) if e[2] != INFINITE]
        best = INFINITE
        for k in range(len(finite) + 1):
            if any(n - 1 not in reach(pairs, 0, set(c)) for c in itertools.combinations(finite, k)):
                best = k
                break
        value, cut = min_cut(n, edges, 0, n - 1)
        assert value == best
        if value != INFINITE:
            assert len(cut) == best and n - 1 not in reach(pairs, 0, set(cut))


def test_min_cut_is_closest_to_sink():
    assert min_cut(4, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], 0, 3) == (1.0, [2])


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(GRAPH, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_closures(spark, graph):
    for start in ("r1.cc", "c.h", "x.h"):
        got = {r["node"] for r in closure.descendants(graph, nodes(spark, start)).collect()}
        assert got == reach(GRAPH, start) - {start}
    roots = nodes(spark, "r1.cc", "r2.cc", "out/g.cc")
    counts = {r["node"]: r["n_roots"] for r in closure.reaching_roots(graph, roots).collect()}
    assert counts["c.h"] == 3 and counts["a.h"] == 2 and "y.h" not in counts
    got = {(r["target"], r["n_roots"]) for r in closure.root_count(graph, roots, nodes(spark, "c.h", "y.h", "r1.cc")).collect()}
    assert got == {("c.h", 3), ("y.h", 0), ("r1.cc", 0)}


def test_transitive_includes_stop_at_library(spark, graph):
    edges = {(r["src"], r["dst"]) for r in closure.transitive_includes(graph, nodes(spark, "r1.cc")).collect()}
    assert ("c.h", "third_party/libc++/src/include/v") in edges and ("third_party/libc++/src/include/v", "deep.h") not in edges
    full = {(r["src"], r["dst"]) for r in closure.transitive_includes(graph, nodes(spark, "r1.cc"), full=True).collect()}
    assert ("third_party/libc++/src/include/v", "deep.h") in full


def test_unused_edges_and_adds(spark, graph):
    unused = spark.createDataFrame([("c.h", "d.h")], "src string, dst string")
    adds = spark.createDataFrame([("b.h", "y.h"), ("r2.cc", "x.h")], "src string, dst string")
    shown = closure.transitive_includes(graph, nodes(spark, "r2.cc"), unused=unused, adds=adds)
    assert [(r["src"], r["dst"]) for r in shown.collect()] == [("c.h", "d.h")]
    applied = {(r["src"], r["dst"]) for r in closure.transitive_includes(graph, nodes(spark, "r2.cc"), unused=unused, adds=adds, apply_changes=True).collect()}
    assert ("c.h", "d.h") not in applied and ("b.h", "y.h") in applied and ("r2.cc", "x.h") not in applied


def test_shortest_chain(spark, graph):
    steps = [(r["src"], r["dst"]) for r in closure.shortest_chain(graph, "r1.cc", "d.h").orderBy("step").collect()]
    assert steps == [("r1.cc", "a.h"), ("a.h", "c.h"), ("c.h", "d.h")]
    assert closure.shortest_chain(graph, "r1.cc", "x.h").count() == 0
    assert closure.shortest_chain(graph, "r1.cc", "r1.cc").count() == 0


def test_shortest_chains_of_random_graphs(spark):
    rng = random.Random(13)
    for n, m in ((12, 24), (16, 22), (9, 30)):
        pairs = random_graph(rng, n, m)
        depth = {0: 0}
        for level in range(n):
            for a, b in pairs:
                if depth.get(a) == level and b not in depth:
                    depth[b] = level + 1
        e = spark.createDataFrame([(f"f{a:02}", f"f{b:02}") for a, b in pairs], "src string, dst string")
        end = max(depth, key=lambda v: (depth[v], v))
        want, node = [], end
        while node:
            parent = min(a for a, b in pairs if b == node and depth.get(a) == depth[node] - 1)
            want, node = [(f"f{parent:02}", f"f{node:02}")] + want, parent
        assert [(r["src"], r["dst"]) for r in closure.shortest_chain(e, "f00", f"f{end:02}").orderBy("step").collect()] == want


def test_cut_reports(spark, graph):
    roots = nodes(spark, "r1.cc", "r2.cc", "out/g.cc")
    ignores = spark.createDataFrame([("b.h", "*")], "src string, dst string")
    g = cuts.target_graph(graph, "c.h", ignores=ignores)
    assert {(r["src"], r["dst"]): r["cuttable"] for r in g.collect()}[("b.h", "c.h")] is False
    row = cuts.floors(graph, roots, "c.h", ignores=ignores).first()
    assert (row["original"], row["remaining"], row["direct_floor"], row["all_cuts_floor"]) == (3, 3, 2, 0)
    dominated = {(r["src"], r["dst"]): r["dominated"] for r in cuts.dominated_roots(cuts.target_graph(graph, "c.h"), roots, "c.h").collect()}
    assert dominated[("b.h", "c.h")] == 1 and dominated[("a.h", "c.h")] == 0 and dominated[("r2.cc", "b.h")] == 1
    files = spark.createDataFrame([("r2.cc", 1, 2, 3, 4)], "file string, size long, tsize long, asize long, prevalence long")
    assert [(r["includer"], r["included"]) for r in cuts.min_edge_cut(graph, files, "r2.cc", "d.h", 3).collect()] == [("c.h", "d.h")]


def test_dominated_roots_by_the_kernel(spark):
    rng = random.Random(21)
    for n, m in ((9, 20), (14, 30)):
        pairs = random_graph(rng, n, m) + [(n + i, rng.randrange(n)) for i in range(6)] + [(n + 5, rng.randrange(n))]
        back = [(b, a) for a, b in pairs]
        inside = reach(back, 0) | {0}
        pairs = sorted({(a, b) for a, b in pairs if a in inside and b in inside})
        roots = [v for v in inside if v >= n or v % 3 == 1]
        weight = [int(v in roots and v != 0) for v in range(n + 6)]
        want = dict(zip(pairs, edge_dominated_weights(n + 6, [(b, a) for a, b in pairs], 0, weight)))
        g = spark.createDataFrame([(f"f{a}", f"f{b}") for a, b in pairs], "src string, dst string")
        got = cuts.dominated_roots(g, nodes(spark, *(f"f{v}" for v in roots)), "f0")
        assert {(int(r["src"][1:]), int(r["dst"][1:])): r["dominated"] for r in got.collect()} == want


def test_entry_points_need_outer_paths(spark, graph):
    got = closure.entry_points(graph, nodes(spark, "r1.cc", "r2.cc"), nodes(spark, "b.h", "c.h", "d.h"))
    assert sorted(r["node"] for r in got.collect()) == ["b.h", "c.h"]


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert closure.reaching_roots(none, nodes(spark, "a")).count() == 0
    assert closure.includers(none, nodes(spark, "a"), transitive=True).count() == 0


def test_cuts_from_the_includes_of_a_source(spark):
    pairs = [("r.cc", "a.h"), ("r.cc", "b.h"), ("r.cc", "t.h"), ("a.h", "m.h"), ("a.h", "n.h"), ("m.h", "t.h"), ("n.h", "t.h"), ("b.h", "m.h"), ("q.cc", "a.h")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    files = spark.createDataFrame([(x, 50) for x in sorted({y for p in pairs for y in p})], "file string, prevalence int")
    cut = lambda **more: {(r["includer"], r["included"]) for r in cuts.min_edge_cut(e, files, "r.cc", "t.h", 100, **more).collect()}
    assert cut() == {("r.cc", "t.h"), ("m.h", "t.h"), ("n.h", "t.h")}
    assert cut(start_from_source_includes=True) == {("m.h", "t.h"), ("n.h", "t.h")}
    assert cut(threshold=60.0) == set() and cut(start_from_source_includes=True, threshold=60.0) == set()


def test_roots_that_nothing_includes_are_merged_in_cuts(spark):
    pairs = [(f"r{i}.cc", "a.h") for i in range(5)] + [("r5.cc", "a.h"), ("r5.cc", "b.h"), ("r6.cc", "a.h"), ("r6.cc", "b.h"), ("a.h", "c.h"), ("b.h", "c.h"), ("c.h", "t.h"), ("d.h", "d1.h"), ("d.h", "d2.h"), ("d1.h", "t.h"), ("d2.h", "t.h"), ("r7.cc", "d.h"), ("r7.cc", "t.h"), ("out/g.cc", "d.h")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    roots = spark.createDataFrame([(f"r{i}.cc",) for i in range(8)] + [("out/g.cc",)], "node string")
    files = spark.createDataFrame([(x, 1) for x in sorted({y for p in pairs for y in p})], "file string, prevalence int")
    g = cuts.target_graph(e, "t.h")
    got = {(r["src"], r["dst"]): r["dominated"] for r in cuts.dominated_roots(g, roots, "t.h").collect()}
    want = {p: 0 for p in pairs} | {(f"r{i}.cc", "a.h"): 1 for i in range(5)} | {("a.h", "c.h"): 5, ("c.h", "t.h"): 7}
    assert got == want
    indirect = {(r["includer"], r["included"]) for r in cuts.indirect_cuts(g, roots, files, "t.h", 8).collect()}
    assert indirect == {("r7.cc", "d.h")}


def test_entry_points_are_found_by_one_search_of_all_roots(spark, graph, monkeypatch):
    def unused(*_):
        raise AssertionError("roots were told apart")

    monkeypatch.setattr(closure, "reaching_roots", unused)
    got = closure.entry_points(graph, nodes(spark, "r1.cc", "r2.cc"), nodes(spark, "b.h", "c.h", "d.h"))
    assert sorted(r["node"] for r in got.collect()) == ["b.h", "c.h"]


def test_entry_points_that_are_roots_need_another_root(spark):
    rng = random.Random(5)
    for n, m in ((8, 16), (10, 14)):
        pairs = random_graph(rng, n, m) + [(0, 1), (1, 0)]
        roots, subset = {0, 2, 3}, {0, 3, 4, 5}
        outer = [p for p in pairs if not set(p) <= subset]
        want = sorted(v for v in subset if any(v in reach(outer, r) for r in roots - {v}))
        e = spark.createDataFrame([(f"f{a}", f"f{b}") for a, b in pairs], "src string, dst string")
        got = closure.entry_points(e, nodes(spark, *(f"f{v}" for v in roots)), nodes(spark, *(f"f{v}" for v in subset)))
        assert sorted(int(r["node"][1:]) for r in got.collect()) == want


@pytest.mark.parametrize("from_includes", [False, True])
def test_cuts_of_a_source_leave_out_what_it_does_not_reach(spark, monkeypatch, from_includes):
    pairs = [("r.cc", "a.h"), ("a.h", "m.h"), ("a.h", "n.h"), ("m.h", "t.h"), ("n.h", "t.h")] + [(f"q{i}.cc", "a.h") for i in range(100)]
    e = spark.createDataFrame(pairs, "src string, dst string")
    files = spark.createDataFrame([("m.h", 50)], "file string, prevalence int")
    met = []

    def closed(*a, f=closure.closure, **more):
        found = f(*a, **more)
        met.append(found.count())
        return found

    def cut(graph, *a, f=cuts.cut_edges):
        met.append(graph.count())
        return f(graph, *a)

    monkeypatch.setattr(closure, "closure", closed)
    monkeypatch.setattr(cuts, "cut_edges", cut)
    found = cuts.min_edge_cut(e, files, "r.cc", "t.h", 100, start_from_source_includes=from_includes)
    assert {(r["includer"], r["included"]) for r in found.collect()} == ({("m.h", "t.h"), ("n.h", "t.h")} if from_includes else {("r.cc", "a.h")})
    assert max(met) <= 5


def test_uncuttable_sources_need_no_graph_of_the_target(spark, graph, monkeypatch):
    ignores = spark.createDataFrame([("b.h", "*"), ("r2.cc", "b.h")], "src string, dst string")
    want = sorted(r["node"] for r in cuts.uncuttable_sources(cuts.target_graph(graph, "c.h", ignores=ignores), "c.h").collect())
    monkeypatch.setattr(cuts, "target_graph", None)
    got = cuts.uncuttable_sources(cuts.marked_edges(graph, ignores=ignores), "c.h")
    assert sorted(r["node"] for r in got.collect()) == want and "b.h" in want


def test_dominators_of_every_root(spark):
    random.seed(11)
    for trial in range(3):
        n, n_roots = 7, 12
        pairs = {(a, b) for a in range(n_roots, n_roots + n) for b in range(n_roots, n_roots + n) if random.random() < 0.25}
        pairs |= {(r, random.randrange(n_roots, n_roots + n)) for r in range(n_roots - 1) for _ in range(2)}
        pairs |= {(n_roots, 3)} if trial else set()  # a root that something includes
        want = set()
        for r in range(n_roots):
            def reached(gone=None, root=r):
                seen, todo = set(), [root] if root != gone else []
                while todo:
                    at = todo.pop()
                    if at not in seen:
                        seen.add(at)
                        todo += [b for a, b in pairs if a == at and b != gone]
                return seen
            want |= {(r, v, x) for v in reached() for x in reached() if v not in reached(gone=x)}
        got = cuts.dominators(spark.createDataFrame([(f"{a}", f"{b}") for a, b in pairs], "src string, dst string"), nodes(spark, *(str(r) for r in range(n_roots))))
        assert sorted((int(a), int(b), int(c)) for a, b, c in got.collect()) == sorted(want)


def test_the_query_asks_for_dominators_of_all_roots(spark):
    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["g17_dominators"](spark, sf).select("key").distinct().count() == catalog.roots(spark, sf).count()
