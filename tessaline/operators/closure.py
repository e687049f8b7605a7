"""Reachability over the include graph by checkpointed frontier joins.

Graphs are cyclic, so closures are loops over distinct pairs, not recursive
CTEs.  ``edges`` has ``src, dst``; seeds have a ``key`` (whose closure it is) and
a ``node``.  Frontiers and the visited set are written to the shared folder, which
cuts lineage and survives executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, part_of, stored
from .filters import filter_changes, resolve_includes
from .reach import reaching_roots


def simple_graph(edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` (G1): parallel edges collapse, cycles and loops stay."""
    return edges.select("src", "dst").distinct()


def without_edges(edges: DataFrame, skips: DataFrame) -> DataFrame:
    """``edges`` less the listed ones (G2, X3); unknown skips are harmless."""
    listed = skips.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    return edges.join(listed, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")


def unknown_skips(edges: DataFrame, skips: DataFrame) -> DataFrame:
    """Skips that name no edge: what the loaders warn about."""
    have = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    return skips.select("src", "dst").distinct().join(have, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")


def closure(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """All distinct ``key, node`` reachable from each key's seeds, seeds included.

    Each round joins only the newest pairs with the edges and drops what was seen;
    it ends when a round finds nothing.  Both sides are joined by shuffle or
    broadcast as their measured size allows.  Edges that aren't stored yet are
    written once, so that rounds don't compute them again.
    """
    frm, to = ("dst", "src") if reverse else ("src", "dst")
    if not getattr(edges, "is_stored", False):
        edges = materialize(edges.select("src", "dst").distinct(), "closure-edges")
    steps = edges.select(F.col(frm).alias("_from"), F.col(to).alias("_to"))
    newest = materialize(seeds.select("key", "node").distinct(), "closure-seeds")
    seen = newest
    while not newest.isEmpty():
        found = newest.join(steps, F.col("node") == F.col("_from")).select("key", F.col("_to").alias("node")).distinct()
        known = seen.select(F.col("key").alias("_k"), F.col("node").alias("_n"))
        newest = materialize(found.join(known, F.col("key").eqNullSafe(F.col("_k")) & (F.col("node") == F.col("_n")), "left_anti"), "closure-front")
        seen = seen.unionByName(newest)
    return materialize(seen, "closure")


def descendants(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``key, node`` reachable from each source by one edge or more, the source itself excluded."""
    sources = sources.select(F.col("node").alias("key")).distinct()
    seeds = sources.join(edges, F.col("key") == F.col("src")).select("key", F.col("dst").alias("node"))
    return closure(edges, seeds).filter("node <> key")


def root_count(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, n_roots`` for a list of targets by reverse closures (G8); 0 where none reaches it."""
    targets = targets.select(F.col("node").alias("target")).distinct()
    above = closure(edges, targets.select(F.col("target").alias("key"), F.col("target").alias("node")), reverse=True).filter("node <> key")
    hits = above.join(roots.select(F.col("node").alias("_root")).distinct(), F.col("node") == F.col("_root"), "left_semi")
    counts = hits.groupBy(F.col("key").alias("_t")).agg(F.count("*").alias("n_roots"))
    return targets.join(counts, F.col("target") == F.col("_t"), "left").select("target", F.coalesce("n_roots", F.lit(0)).cast("long").alias("n_roots"))


def expanded_size(edges: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """``file, expanded_size``: sizes of the source and all it reaches (G7); missing sizes are 0."""
    seeds = sources.select(F.col("node").alias("key"), "node")
    reached = closure(edges, seeds).join(files.select(F.col("file").alias("_f"), "size"), F.col("node") == F.col("_f"), "left")
    return reached.groupBy(F.col("key").alias("file")).agg(F.sum(F.coalesce("size", F.lit(0))).alias("expanded_size"))


def transitive_includes(
    edges: DataFrame,
    start: DataFrame,
    *,
    full: bool = False,
    adds: DataFrame | None = None,
    unused: DataFrame | None = None,
    apply_changes: bool = False,
    ignore_edge: tuple | None = None,
    opaque: str = "third_party/libc++/src/include/",
) -> DataFrame:
    """Edges ``key, src, dst`` reached from each start file.

    ``start`` has ``node``.  Traversal stops at files of the library prefix (unless
    ``full``), at ``ignore_edge``, and with ``apply_changes`` at ``unused`` edges;
    ``adds`` are edges to be traversed too, though a start file's own first hop has
    only its real includes.  Without ``apply_changes`` but with changes, only the
    unused edges reached are returned (F22: an empty ``unused`` returns none).
    """
    def stopped(e: DataFrame) -> DataFrame:
        if not full:
            e = e.filter(~F.col("src").contains(opaque))
        if ignore_edge is not None:
            e = e.filter(~((F.col("src") == ignore_edge[0]) & (F.col("dst") == ignore_edge[1])))
        if apply_changes and unused is not None:
            e = without_edges(e, unused)
        return e

    real = edges.select("src", "dst")
    everything = real if adds is None else real.unionByName(adds.select("src", "dst")).distinct()
    plain = adds is None and (unused is None or not apply_changes)
    first, all_edges = stopped(real), stored(part_of(edges, stopped(everything)) if plain else stopped(everything), "transitive-edges")
    keys = start.select(F.col("node").alias("key")).distinct()
    hop = materialize(keys.join(first, F.col("key") == F.col("src")).select("key", "src", "dst"), "transitive-hop")
    reached = closure(all_edges, hop.select("key", F.col("dst").alias("node")))
    out = hop.unionByName(reached.join(all_edges, F.col("node") == F.col("src")).select("key", "src", "dst")).distinct()
    return out if apply_changes else _listed_only(out, unused)


def transitive_files(reached: DataFrame, files: DataFrame) -> DataFrame:
    """``key, file, tsize, size`` of distinct included files."""
    return (
        reached.select("key", F.col("dst").alias("file")).distinct().join(files.select(F.col("file").alias("_f"), "tsize", "size"), F.col("file") == F.col("_f"), "left").drop("_f")
    )


def _listed_only(found: DataFrame, unused: DataFrame | None) -> DataFrame:
    if unused is None:
        return found
    listed = unused.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    return found.join(listed, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_semi")


def includers(
    edges: DataFrame, targets: DataFrame, transitive: bool = False, opaque: str = "third_party/libc++/src/include/", unused: DataFrame | None = None
) -> DataFrame:
    """Edges ``key, src, dst`` by which files include each target.

    Direct: all edges into the target.  Transitive: includers of includers too,
    where files of the library prefix are neither returned nor expanded.  With
    ``unused``, only those of the edges found (F22).
    """
    keys = targets.select(F.col("node").alias("key")).distinct()
    e = edges.select("src", "dst")
    if not transitive:
        return _listed_only(keys.join(e, F.col("key") == F.col("dst")).select("key", "src", "dst").distinct(), unused)
    e = stored(part_of(edges, e.filter(~F.col("src").contains(opaque))), "includers-edges")
    reached = closure(e, keys.select("key", F.col("key").alias("node")), reverse=True)
    return _listed_only(reached.join(e, F.col("node") == F.col("dst")).select("key", "src", "dst").distinct(), unused)


def recalculated_size(edges: DataFrame, files: DataFrame, start: DataFrame, adds: DataFrame, unused: DataFrame) -> DataFrame:
    """``file, expanded_size`` once the changes are applied.

    Distinct reached (file, size) pairs plus the file's own size, at most ``tsize``.
    """
    reached = transitive_includes(edges, start, full=True, adds=adds, unused=unused, apply_changes=True)
    sizes = files.select(F.col("file").alias("_f"), "size", "tsize")
    pairs = reached.select("key", "dst").distinct().join(sizes, F.col("dst") == F.col("_f"))
    summed = pairs.groupBy("key").agg(F.sum("size").alias("_sum"))
    own = start.select(F.col("node").alias("file")).distinct().join(sizes, F.col("file") == F.col("_f"))
    total = F.coalesce("_sum", F.lit(0)) + F.coalesce("size", F.lit(0))
    return own.join(summed, F.col("file") == F.col("key"), "left").select("file", F.least(total, F.coalesce("tsize", total)).alias("expanded_size"))


def _step(front: DataFrame, seen: DataFrame, e: DataFrame, frm: str, to: str, level: int) -> DataFrame:
    """``node, level``: what the front's edges lead to for the first time."""
    found = front.select("node").join(e, F.col("node") == F.col(frm)).select(F.col(to).alias("_to")).distinct()
    found = found.join(seen.select(F.col("node").alias("_seen")), F.col("_to") == F.col("_seen"), "left_anti")
    return materialize(found.select(F.col("_to").alias("node"), F.lit(level).alias("level")), "chain-front")


def shortest_chain(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Edges ``step, src, dst`` of a shortest path (G11, W4); none if unreachable or equal.

    Searched from both ends, always from the smaller front, until the fronts meet.  Among
    shortest paths, every node has the smallest parent of its level, looked up by one join
    a level over the nodes that lie on such paths.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    none = spark.createDataFrame([], f"step int, src {kind}, dst {kind}")
    if start == end:
        return none
    e = stored(part_of(edges, edges.select("src", "dst")), "chain-edges")
    sides = [{"front": f, "seen": f, "level": 0, "n": 1} for f in (spark.createDataFrame([(x, 0)], f"node {kind}, level int") for x in (start, end))]
    meeting = None
    while meeting is None:
        k = 0 if sides[0]["n"] <= sides[1]["n"] else 1
        side, other = sides[k], sides[1 - k]
        side["level"] += 1
        side["front"] = _step(side["front"], side["seen"], e, *(("src", "dst") if k == 0 else ("dst", "src")), side["level"])
        side["n"] = side["front"].count()
        if not side["n"]:
            return none
        side["seen"] = side["seen"].unionByName(side["front"])
        met = side["front"].select("node").join(other["front"].select("node"), "node")
        if not met.isEmpty():
            meeting = materialize(met, "chain-met")
    # What lies on shortest paths, by its distance from the start: the meeting nodes, and on
    # either side of them what leads there or where they lead, level by level.
    steps, split = sides[0]["level"] + sides[1]["level"], sides[0]["level"]
    on = {split: meeting}
    at = lambda k, level: sides[k]["seen"].filter(F.col("level") == level).select("node")
    for level in range(split - 1, -1, -1):
        into = on[level + 1].join(e, F.col("node") == F.col("dst")).select(F.col("src").alias("_n")).distinct()
        on[level] = materialize(at(0, level).join(into, F.col("node") == F.col("_n"), "left_semi"), "chain-on")
    for level in range(split + 1, steps + 1):
        out = on[level - 1].join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("_n")).distinct()
        on[level] = materialize(at(1, steps - level).join(out, F.col("node") == F.col("_n"), "left_semi"), "chain-on")
    # Backwards along the smallest parents, as a path of one node a level.
    path, node = [], on[steps]
    for level in range(steps, 0, -1):
        parents = node.join(e, F.col("node") == F.col("dst")).join(on[level - 1].select(F.col("node").alias("_on")), F.col("src") == F.col("_on"), "left_semi")
        edge = materialize(parents.groupBy("dst").agg(F.min("src").alias("src")).select(F.lit(level).alias("step"), "src", "dst"), "chain-edge")
        path.append(edge)
        node = edge.select(F.col("src").alias("node"))
    out = path[-1]
    for edge in path[-2::-1]:
        out = out.unionByName(edge)
    return out


def entry_points(edges: DataFrame, roots: DataFrame, subset: DataFrame) -> DataFrame:
    """``node``: subset nodes reachable from a root by edges outside the subset.

    The roots' successors seed the search, so a root in the subset counts only if
    another root reaches it.  All roots are one search; only where it meets roots in
    the subset must theirs be told apart.
    """
    members = materialize(subset.select(F.col("node").alias("_m")).distinct(), "entry-subset")
    end = lambda n: members.select(F.col("_m").alias(f"_{n}"))
    outer = edges.select("src", "dst").join(end("s"), F.col("src") == F.col("_s"), "left").join(end("d"), F.col("dst") == F.col("_d"), "left")
    outer = materialize(outer.filter("_s is null or _d is null").select("src", "dst"), "entry-edges")
    root = roots.select(F.col("node").alias("_root")).distinct()
    first = outer.join(root, F.col("src") == F.col("_root"), "left_semi").filter("dst is not null").select(F.lit(0).alias("key"), F.col("dst").alias("node"))
    # What nothing includes, as most roots are, is never met on the way.
    core = outer.join(outer.select(F.col("dst").alias("_head")).distinct(), F.col("src") == F.col("_head"), "left_semi")
    entries = materialize(closure(core, first).select("node").filter("node is not null").join(members, F.col("node") == F.col("_m"), "left_semi"), "entries")
    own = entries.join(root, F.col("node") == F.col("_root"), "left_semi")
    if own.isEmpty():
        return entries
    by_others = reaching_roots(outer, roots).select(F.col("node").alias("_reached"))
    return entries.join(root, F.col("node") == F.col("_root"), "left_anti").unionByName(own.join(by_others, F.col("node") == F.col("_reached"), "left_semi"))


def suggested_adds(
    changes: DataFrame, files: DataFrame, include_dirs: list[str], gen_prefix: str, sysroot: str, platform: str,
    *, ignores: DataFrame | None = None, mappings: DataFrame | None = None,
) -> DataFrame:
    """``src, dst`` of the additions among include changes, filtered by rules and mappings
    alone, with headers resolved to files (the adds that G24 takes)."""
    adds = filter_changes(changes, ignores=ignores, mappings=mappings, change_type="add").select("includer", F.col("header").alias("include"))
    return resolve_includes(adds, files, include_dirs, gen_prefix, sysroot, platform).select(F.col("includer").alias("src"), F.col("resolved").alias("dst")).distinct()


def adds_needed(edges: DataFrame, adds: DataFrame, file: str, include: str, minimal: bool = False) -> DataFrame:
    """``includer, included`` that must be added before ``include`` leaves ``file``.

    Suggested adds (of :func:`suggested_adds`) from the file or its transitive includers
    to the include or its transitive includes; with ``minimal``, only where the
    included file isn't otherwise reachable once the edge is gone.
    """
    spark = edges.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    down = includers(edges, one(file), transitive=True).select(F.col("src").alias("_x")).unionByName(one(file).withColumnRenamed("node", "_x")).distinct()
    up = one(include).withColumnRenamed("node", "_x")
    if not include.startswith("<"):
        up = up.unionByName(transitive_includes(edges, one(include)).select(F.col("dst").alias("_x"))).distinct()
    wanted = adds.select("src", "dst").distinct().join(down, F.col("src") == F.col("_x"), "left_semi").join(up, F.col("dst") == F.col("_x"), "left_semi")
    wanted = materialize(wanted, "adds-needed")
    if minimal:
        reached = transitive_includes(edges, wanted.select(F.col("src").alias("node")), ignore_edge=(file, include)).select(F.col("key").alias("_k"), F.col("dst").alias("_d")).distinct()
        wanted = wanted.join(reached, (F.col("src") == F.col("_k")) & (F.col("dst") == F.col("_d")), "left_anti")
    return wanted.select(F.col("src").alias("includer"), F.col("dst").alias("included"))
