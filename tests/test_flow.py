"""Cuts of contracted graphs against the plain kernel on whole graphs, which subsets check."""

import random

import pytest

from tessaline.operators import flow
from tessaline.operators.kernels import INFINITE, min_cut

from .test_graph import random_graph


def plain(edges, sources, target):
    """The cut of the whole graph: the sources hang from one node by edges that can't be cut."""
    n = 1 + max([target, *sources, *(x for e in edges for x in e[:2])])
    rows = [(a, b, 1.0 if c else INFINITE) for a, b, c in edges] + [(n, s, INFINITE) for s in sources]
    value, cut = min_cut(n + 1, rows, n, target)
    return set() if value == INFINITE else {rows[i][:2] for i in cut}


def layered(rng, widths, links):
    """A graph whose flow has to pass several layers, with edges back."""
    first = [sum(widths[:i]) for i in range(len(widths))]
    edges = set()
    for i in range(len(widths) - 1):
        for _ in range(links):
            edges.add((first[i] + rng.randrange(widths[i]), first[i + 1] + rng.randrange(widths[i + 1])))
    for _ in range(links // 2):
        i = rng.randrange(1, len(widths))
        edges.add((first[i] + rng.randrange(widths[i]), first[i - 1] + rng.randrange(widths[i - 1])))
    return list(edges)


@pytest.mark.parametrize(("kernel_edges", "kinds"), [(flow.KERNEL_EDGES, "rlr"), (0, "l")])
def test_cuts_by_the_plain_kernel(spark, monkeypatch, kernel_edges, kinds):
    monkeypatch.setattr(flow, "KERNEL_EDGES", kernel_edges)
    rng = random.Random(kernel_edges + 3)
    cut = 0
    for kind in kinds:
        if kind == "l":
            pairs, sources, target = layered(rng, [2, 3, 3, 1], 7), [0, 1], 8
        else:
            pairs, sources, target = random_graph(rng, 12, 26), rng.sample(range(11), 2), 11
        edges = [(a, b, rng.random() > 0.25) for a, b in pairs if a != b]
        df = spark.createDataFrame(edges + edges[:2], "src long, dst long, cuttable boolean")
        got = [tuple(r) for r in flow.cut_edges(df, spark.createDataFrame([(s,) for s in sources], "node long"), target).collect()]
        want = plain(edges, sources, target)
        assert set(got) == want and len(got) == len(want), (edges, sources, target)
        cut += len(want)
    assert cut


def test_chains_are_cut_next_to_the_target(spark):
    edges = [("s", "a"), ("a", "b"), ("b", "c"), ("c", "t"), ("s", "d"), ("d", "e"), ("e", "t"), ("z", "a"), ("e", "q")]
    fixed = {("e", "t"), ("c", "t"), ("b", "c")}
    df = spark.createDataFrame([(a, b, (a, b) not in fixed) for a, b in edges], "src string, dst string, cuttable boolean")
    source = spark.createDataFrame([("s",)], "node string")
    cut = lambda target: {tuple(r) for r in flow.cut_edges(df, source, target).collect()}
    assert cut("t") == {("a", "b"), ("d", "e")} and cut("q") == {("e", "q")} and cut("nowhere") == set() and cut("s") == set()
    both = spark.createDataFrame([("s",), ("e",)], "node string")
    assert flow.cut_edges(df, both, "t").collect() == []
