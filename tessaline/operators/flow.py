"""Minimum cuts of large graphs: contraction by joins, then a kernel or rounds of pushes.

The cut wanted is the one closest to the target: the target's side holds just what still
reaches it once a largest flow runs.  Edges that can't be cut force their ends to a side,
so before any flow

* what the sources reach by them becomes the source, and what reaches the target by them
  becomes the target,
* files that reach each other by them become one node,
* edges between the same nodes become one of their sum, and a chain of files with one edge
  in and one out becomes one edge, of its smallest room, cut as near to the target as can be.

What is left and small enough is one task's.  Anything larger is a preflow in waves: heights
are distances to the target, and in each wave every height hands its excess to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize
from .kernels import INFINITE, sink_side
from .reach import as_numbers, condense

#: Contracted graphs of so many edges are one task's.
KERNEL_EDGES = 1_000_000
#: The names of what the sources and the target become; files have numbers from 1.
SOURCE, TARGET = -1, -2


def _reached(edges: DataFrame, nodes: DataFrame, frm: str, to: str, name: str) -> DataFrame:
    """``node``: the given ones and what their edges lead to, stored."""
    newest = materialize(nodes.select("node").distinct(), name)
    seen = newest
    while not newest.isEmpty():
        found = newest.join(edges, F.col("node") == F.col(frm)).select(F.col(to).alias("_to")).distinct()
        newest = materialize(found.join(seen, F.col("_to") == F.col("node"), "left_anti").select(F.col("_to").alias("node")), name)
        seen = seen.unionByName(newest)
    return materialize(seen, name)


def _contracted(edges: DataFrame, sources: DataFrame, target: int) -> tuple[DataFrame, DataFrame] | None:
    """``node, rep`` of the files that matter and ``a, b, room`` between what they become; None where no cut is finite."""
    spark = edges.sparkSession
    fixed = materialize(edges.filter("not cuttable").select("src", "dst"), "cut-fixed")
    begun = _reached(fixed, sources, "src", "dst", "cut-begun")
    ended = _reached(fixed, spark.createDataFrame([(target,)], "node long"), "dst", "src", "cut-ended")
    if not begun.join(ended, "node", "left_semi").isEmpty():
        return None
    below, above = _reached(edges, begun, "src", "dst", "cut-below"), _reached(edges, ended, "dst", "src", "cut-above")
    used = materialize(below.join(above, "node", "left_semi"), "cut-used")
    rest = used.join(begun, "node", "left_anti").join(ended, "node", "left_anti")
    member = lambda n: rest.select(F.col("node").alias(f"_{n}"))
    among = fixed.join(member("s"), F.col("src") == F.col("_s"), "left_semi").join(member("d"), F.col("dst") == F.col("_d"), "left_semi")
    joined = condense(materialize(among, "cut-among")).select(F.col("node").alias("_node"), "component")
    reps = rest.join(joined, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("rep"))
    at = lambda nodes, rep: nodes.join(used, "node", "left_semi").select("node", F.lit(rep).cast("long").alias("rep"))
    reps = materialize(reps.unionByName(at(begun, SOURCE)).unionByName(at(ended, TARGET)), "cut-reps")
    named = lambda n: reps.select(F.col("node").alias(f"_{n}"), F.col("rep").alias(f"_{n}_rep"))
    between = edges.join(named("s"), F.col("src") == F.col("_s")).join(named("d"), F.col("dst") == F.col("_d"))
    between = between.filter((F.col("_s_rep") != F.col("_d_rep")) & (F.col("_d_rep") != SOURCE) & (F.col("_s_rep") != TARGET))
    room = F.when(F.col("cuttable"), F.lit(1.0)).otherwise(F.lit(INFINITE))
    return reps, materialize(between.groupBy(F.col("_s_rep").alias("a"), F.col("_d_rep").alias("b")).agg(F.sum(room).alias("room")), "cut-between")


def _unchained(edges: DataFrame) -> DataFrame:
    """``a, b, room, x, y``: chains as one edge each, which is cut by cutting the edge ``x, y``."""
    edges = edges.select("a", "b", "room", F.col("a").alias("x"), F.col("b").alias("y"))
    while True:
        one = lambda end: edges.groupBy(F.col(end).alias("_n")).agg(F.count("*").alias("_k")).filter("_k = 1").select("_n")
        links = materialize(one("a").intersect(one("b")).filter(~F.col("_n").isin(SOURCE, TARGET)), "cut-links")
        # A chain's first file joins its edges in this round; links on a cycle alone have no first one.
        held = edges.join(links, F.col("b") == F.col("_n"), "left_semi")
        first = held.join(links, F.col("a") == F.col("_n"), "left_anti")
        first = materialize(first.select(*(F.col(c).alias(f"_{c}") for c in ("a", "b", "room", "x", "y"))), "cut-first")
        if first.isEmpty():
            return edges
        into = first.select(F.col("_b").alias("_mid")).distinct()
        near = (F.col("room") <= F.col("_room"))
        merged = first.join(edges, F.col("_b") == F.col("a")).filter(F.col("_a") != F.col("b")).select(
            F.col("_a").alias("a"), "b", F.least("room", "_room").alias("room"), F.when(near, F.col("x")).otherwise(F.col("_x")).alias("x"), F.when(near, F.col("y")).otherwise(F.col("_y")).alias("y")
        )
        kept = edges.join(into, F.col("a") == F.col("_mid"), "left_anti").join(into, F.col("b") == F.col("_mid"), "left_anti")
        edges = materialize(kept.unionByName(merged), "cut-unchained")


def _side_in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(i).to_numpy() for i in range(3)) for b in batches]
        if parts:
            a, b, room = (np.concatenate([p[i] for p in parts]) for i in range(3))
            names, places = np.unique(np.concatenate([[SOURCE, TARGET], a, b]), return_inverse=True)
            m = len(a)
            side = sink_side(len(names), list(zip(places[2 : 2 + m].tolist(), places[2 + m :].tolist(), room.tolist())), int(places[0]), int(places[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names[np.array(side, bool)], pa.int64())], names=["node"])

    return edges.select("a", "b", "room").coalesce(1).mapInArrow(run, "node long")


def _heights(residual: DataFrame) -> tuple[DataFrame, int]:
    """``node, height``: distances to the target where room is left, and the largest."""
    spark, open_ = residual.sparkSession, residual.filter("room > 0")
    newest = seen = materialize(spark.createDataFrame([(TARGET, 0)], "node long, height int"), "cut-heights")
    at = 0
    while True:
        at += 1
        found = newest.join(open_, F.col("node") == F.col("b")).select(F.col("a").alias("_a")).distinct()
        newest = found.join(seen, F.col("_a") == F.col("node"), "left_anti").filter(F.col("_a") != SOURCE).select(F.col("_a").alias("node"), F.lit(at).alias("height"))
        newest = materialize(newest, "cut-heights")
        if newest.isEmpty():
            return materialize(seen, "cut-heights"), at - 1
        seen = seen.unionByName(newest)


def _side_in_waves(edges: DataFrame) -> DataFrame:
    """What still reaches the target once no excess can.

    The preflow starts with all that the source's edges hold.  Excess that can't reach the
    target any more stays where it is: it could only go back, on the source's side.
    """
    both = edges.select("a", "b", "room").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("room")))
    whole = materialize(both.groupBy("a", "b").agg(F.sum("room").alias("room")), "cut-residual")
    excess = materialize(whole.filter((F.col("a") == SOURCE) & (F.col("room") > 0)).select(F.col("b").alias("node"), F.col("room").alias("excess")), "cut-excess")
    sent = excess.select(F.lit(SOURCE).cast("long").alias("a"), F.col("node").alias("b"), F.col("excess").alias("f"))
    residual = _after(whole, sent)
    while True:
        heights, highest = _heights(residual)
        known = heights.select(F.col("node").alias("_n"), F.col("height").alias("_h"))
        live = excess.filter(F.col("node") != TARGET).join(known, F.col("node") == F.col("_n")).select("node", "excess", F.col("_h").alias("height"))
        live = materialize(live, "cut-live")
        if live.isEmpty():
            return heights.select("node")
        lower = heights.select(F.col("node").alias("_to"), F.col("height").alias("_low"))
        falls = residual.filter("room > 0").join(known, F.col("a") == F.col("_n")).join(lower, (F.col("b") == F.col("_to")) & (F.col("_low") == F.col("_h") - 1))
        falls = materialize(falls.select("a", "b", "room", F.col("_h").alias("height")), "cut-falls", partition_by="height")
        moves, came = None, None
        for at in range(highest, 0, -1):
            here = live.filter(F.col("height") == at).select("node", "excess")
            if came is not None:
                here = here.unionByName(came).groupBy("node").agg(F.sum("excess").alias("excess"))
            down = here.join(falls.filter(F.col("height") == at).select("a", "b", "room"), F.col("node") == F.col("a"))
            before = F.coalesce(F.sum("room").over(W.partitionBy("a").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
            pushed = down.withColumn("f", F.least("room", F.greatest(F.col("excess") - before, F.lit(0.0)))).filter("f > 0").select("a", "b", "f")
            pushed = materialize(pushed, "cut-pushed")
            came = pushed.groupBy(F.col("b").alias("node")).agg(F.sum("f").alias("excess"))
            moves = pushed if moves is None else moves.unionByName(pushed)
        change = moves.select(F.col("a").alias("node"), (-F.col("f")).alias("excess")).unionByName(moves.select(F.col("b").alias("node"), F.col("f").alias("excess"))).unionByName(excess)
        excess = materialize(change.groupBy("node").agg(F.sum("excess").alias("excess")).filter("excess > 0"), "cut-excess")
        residual = _after(residual, moves)


def _after(residual: DataFrame, moves: DataFrame) -> DataFrame:
    """The room left once ``f`` went from ``a`` to ``b``."""
    there = moves.select("a", "b", (-F.col("f")).alias("room")).unionByName(moves.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("f").alias("room")))
    return materialize(residual.unionByName(there).groupBy("a", "b").agg(F.sum("room").alias("room")), "cut-residual")


def cut_edges(graph: DataFrame, sources: DataFrame, target) -> DataFrame:
    """``src, dst`` of the smallest set of cuttable edges between all ``sources`` (``node``) and the
    target, of such sets the one closest to the target.

    ``graph``: ``src, dst, cuttable``; repeated edges count once.  There is no row where a
    source is the target or reaches it by edges that can't be cut, or where none reaches it.
    """
    spark, kind = graph.sparkSession, graph.schema["src"].dataType.simpleString()
    edges = graph.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("cuttable").alias("cuttable"))
    edges = materialize(edges, "cut-edges")
    asked = sources.select("node").distinct().withColumn("_is", F.lit("source")).unionByName(spark.createDataFrame([(target, "target")], f"node {kind}, _is string"))
    # A target without edges has no number, and no cut.
    pairs, told, names = as_numbers(edges, asked.select("node"))
    if names is None:
        numbers = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "cuttable")
        begun, goal = sources.select(F.col("node").cast("long").alias("node")), target
    else:
        of = lambda n: names.select(F.col("name").alias(f"_{n}"), F.col("number").alias(f"_{n}_number"))
        numbers = edges.join(of("s"), F.col("src") == F.col("_s")).join(of("d"), F.col("dst") == F.col("_d"))
        numbers = numbers.select(F.col("_s_number").alias("src"), F.col("_d_number").alias("dst"), "cuttable")
        begun = sources.select("node").distinct().join(of("n"), F.col("node") == F.col("_n")).select(F.col("_n_number").alias("node"))
        found = names.filter(F.col("name") == target).first()
        if found is None:
            return spark.createDataFrame([], f"src {kind}, dst {kind}")
        goal = found["number"]
    numbers = materialize(numbers, "cut-numbers")
    contracted = _contracted(numbers, begun, goal)
    if contracted is None:
        return spark.createDataFrame([], f"src {kind}, dst {kind}")
    reps, between = contracted
    small = _unchained(between)
    few = small.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES
    side = materialize(_side_in_one_task(small) if few else _side_in_waves(small), "cut-side")
    here = side.select(F.col("node").alias("_t"))
    cut = small.join(here, F.col("b") == F.col("_t"), "left_semi").join(here, F.col("a") == F.col("_t"), "left_anti").select("x", "y").distinct()
    named = lambda n: reps.select(F.col("node").alias(f"_{n}"), F.col("rep").alias(f"_{n}_rep"))
    spread = numbers.join(named("s"), F.col("src") == F.col("_s")).join(named("d"), F.col("dst") == F.col("_d"))
    spread = materialize(spread.join(cut, (F.col("_s_rep") == F.col("x")) & (F.col("_d_rep") == F.col("y")), "left_semi").select("src", "dst"), "cut-found")
    if names is None:
        return spread.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    spread = spread.join(of("a"), F.col("src") == F.col("_a_number")).join(of("b"), F.col("dst") == F.col("_b_number"))
    return spread.select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
