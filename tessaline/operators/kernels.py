"""Graph kernels without a relational form: dominator trees and minimum cuts.

Plain iterative functions over integer arrays; Spark calls them per group, on a
subgraph that relational operators have pruned first.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

import numpy as np

INFINITE = float("inf")


def _out_edges(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where every node's targets begin, and the targets."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def _peel(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest path to each node over what no cycle leads to, and which nodes those are."""
    start, to = _out_edges(n, src, dst)
    waiting = np.bincount(dst, minlength=n)
    level, done = np.zeros(n, np.int64), waiting == 0
    front = np.flatnonzero(done)
    at = 0
    while len(front):
        lengths = start[front + 1] - start[front]
        reached = to[np.repeat(start[front] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        np.subtract.at(waiting, reached, 1)
        front = np.unique(reached[waiting[reached] == 0])
        at += 1
        level[front], done[front] = at, True
    return level, done


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every node's strong component, and by component the longest path of components to it.

    What lies before and after all cycles is peeled off in whole layers; depth-first
    search with low links goes over the rest.
    """
    other = src != dst
    s, d = src[other], dst[other]
    _, before = _peel(n, s, d)
    _, after = _peel(n, d, s)
    core = ~(before | after)
    component = np.arange(n)
    inside = core[s] & core[d]
    start, to = _out_edges(n, s[inside], d[inside])
    begin, to = start.tolist(), to.tolist()
    index, low, on_stack, path, count = [-1] * n, [0] * n, [False] * n, [], 0
    for root in np.flatnonzero(core).tolist():
        if index[root] >= 0:
            continue
        work = [(root, begin[root])]
        index[root] = low[root] = count
        count += 1
        path.append(root)
        on_stack[root] = True
        while work:
            node, at = work.pop()
            if at < begin[node + 1]:
                work.append((node, at + 1))
                child = to[at]
                if index[child] < 0:
                    index[child] = low[child] = count
                    count += 1
                    path.append(child)
                    on_stack[child] = True
                    work.append((child, begin[child]))
                elif on_stack[child]:
                    low[node] = min(low[node], index[child])
                continue
            if low[node] == index[node]:
                while True:
                    member = path.pop()
                    on_stack[member] = False
                    component[member] = node
                    if member == node:
                        break
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
    _, component = np.unique(component, return_inverse=True)
    between = component[s] != component[d]
    pairs = np.unique(np.stack([component[s[between]], component[d[between]]], axis=1), axis=0) if between.any() else np.zeros((0, 2), np.int64)
    level, _ = _peel(int(component.max()) + 1 if n else 0, pairs[:, 0], pairs[:, 1])
    return component, level


def immediate_dominators(n: int, successors: Sequence[Sequence[int]], root: int) -> list[int]:
    """Immediate dominator of every node (root: itself; unreachable: -1).

    Iterates over reverse postorder, intersecting along the tree, until stable.
    """
    order, number = [], [-1] * n
    state = [(root, iter(successors[root]))]
    entered = [False] * n
    entered[root] = True
    while state:
        node, it = state[-1]
        for child in it:
            if not entered[child]:
                entered[child] = True
                state.append((child, iter(successors[child])))
                break
        else:
            number[node] = len(order)
            order.append(node)
            state.pop()
    predecessors: list[list[int]] = [[] for _ in range(n)]
    for node in order:
        for child in successors[node]:
            predecessors[child].append(node)
    idom = [-1] * n
    idom[root] = root
    changed = True
    while changed:
        changed = False
        for node in reversed(order):
            if node == root:
                continue
            best = -1
            for p in predecessors[node]:
                if idom[p] < 0:
                    continue
                if best < 0:
                    best = p
                    continue
                a, b = p, best
                while a != b:
                    if number[a] < number[b]:
                        a = idom[a]
                    else:
                        b = idom[b]
                best = a
            if idom[node] != best:
                idom[node] = best
                changed = True
    return idom


def edge_dominated_weights(n: int, edges: Sequence[tuple[int, int]], root: int, weight: Sequence[float]) -> list[float]:
    """For every edge, the weight of nodes that all paths from ``root`` reach through it."""
    return dominated_weights(n, edges, root, weight)[1]


def dominated_weights(n: int, edges: Sequence[tuple[int, int]], root: int, weight: Sequence[float]) -> tuple[list[float], list[float]]:
    """For every node and every edge, the weight of nodes that all paths from ``root``
    reach through it, a node's own included.

    The edges become nodes of a split graph; a value is the weight of a subtree in
    that graph's dominator tree.  What isn't reachable has 0.
    """
    successors: list[list[int]] = [[] for _ in range(n + len(edges))]
    for i, (a, b) in enumerate(edges):
        successors[a].append(n + i)
        successors[n + i].append(b)
    idom = immediate_dominators(n + len(edges), successors, root)
    total = [float(w) for w in weight] + [0.0] * len(edges)
    depth = [-1] * len(idom)
    depth[root] = 0
    for node in range(len(idom)):
        trail = []
        while depth[node] < 0 and idom[node] >= 0:
            trail.append(node)
            node = idom[node]
        at = depth[node]
        if at < 0:
            continue
        for x in reversed(trail):
            at += 1
            depth[x] = at
    for node in sorted((x for x in range(len(idom)) if depth[x] > 0), key=depth.__getitem__, reverse=True):
        total[idom[node]] += total[node]
    found = [t if d >= 0 else 0.0 for t, d in zip(total, depth)]
    return found[:n], found[n:]


def min_cut(n: int, edges: Iterable[tuple[int, int, float]], source: int, sink: int) -> tuple[float, list[int]]:
    """Value and edge numbers of the minimum cut closest to ``sink``: the edges into the sink's side.

    That side is the same for every maximum flow.  An infinite value has no cut.
    """
    given = list(edges)
    value, reaches = _flow(n, given, source, sink)
    if value == INFINITE:
        return INFINITE, []
    return value, [i for i, (a, b, c) in enumerate(given) if c > 0 and reaches[b] and not reaches[a]]


def sink_side(n: int, edges: Sequence[tuple[int, int, float]], source: int, sink: int) -> list[bool]:
    """What still reaches ``sink`` once a maximum flow runs; nothing where that is infinite."""
    value, reaches = _flow(n, edges, source, sink)
    return [False] * n if value == INFINITE else reaches


def _flow(n: int, given: Sequence[tuple[int, int, float]], source: int, sink: int) -> tuple[float, list[bool]]:
    """The maximum flow's value, and what still reaches the sink in the residual graph.

    Augments along shortest residual paths with blocking flows.
    """
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, capacity in given:
        head[a].append(len(to))
        to.append(b)
        room.append(capacity)
        head[b].append(len(to))
        to.append(a)
        room.append(0.0)
    value = 0.0
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for e in head[node]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[node] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        at = [0] * n
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                push = min(room[e] for e in path)
                if push == INFINITE:
                    return INFINITE, [False] * n
                value += push
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, node = [], source
                continue
            while at[node] < len(head[node]):
                e = head[node][at[node]]
                if room[e] > 0 and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            else:
                if node == source:
                    break
                e = path.pop()
                node = to[e ^ 1]
                at[node] += 1
                continue
            path.append(e)
            node = to[e]
    reaches = [False] * n
    reaches[sink] = True
    queue = deque([sink])
    while queue:
        node = queue.popleft()
        for e in head[node]:
            if room[e ^ 1] > 0 and not reaches[to[e]]:
                reaches[to[e]] = True
                queue.append(to[e])
    return value, reaches
