"""Edge and file metrics (M1-M11), degree counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .filters import keep_filename

METRICS = ("input_size", "expanded_size", "file_size", "prevalence", "centrality", "includer_size")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out, into``: how many different files each file includes and is included by."""
    lists = _includes(edges)
    out = lists.select("node", F.size("includes").cast("long").alias("out"), F.lit(0).cast("long").alias("into"))
    return out.unionByName(_included(lists).select("node", F.lit(0).cast("long").alias("out"), "into")).groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))


def _includes(edges: DataFrame) -> DataFrame:
    """``node, includes``: the different files that each file includes, so that edges are dealt once to be told apart and counted."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.collect_set(F.struct("dst")).alias("includes"))  # as many as a file includes


def _included(lists: DataFrame) -> DataFrame:
    """``node, into``: in how many of the lists each file is."""
    return lists.select(F.inline("includes")).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("into"))


def _centrality(out_of_included: Column, into_includer: Column, n_files: int) -> Column:
    if n_files <= 1:
        return F.lit(100000.0)
    # Degrees times 1 / (n - 1), in this order, so that doubles agree.
    scale = F.lit(1.0 / (n_files - 1))
    return F.lit(100000.0) * (F.coalesce(out_of_included, F.lit(0)) * scale) * (F.coalesce(into_includer, F.lit(0)) * scale)


def centrality(edges: DataFrame, n_files: int) -> DataFrame:
    """``src, dst, centrality`` of distinct edges (M6): out-degree of the included times
    in-degree of the includer, each over ``n_files - 1``.

    Edges of files that nothing includes, as most roots are, have none; only the others
    meet what their included files include.
    """
    lists = _includes(edges)
    into = _included(lists).select(F.col("node").alias("_m"), "into")
    known = stored(lists.join(into, F.col("node") == F.col("_m"), "left").select("node", "includes", "into"), "included-lists")
    edge = lambda lists: lists.select(F.col("node").alias("src"), "into", F.inline("includes"))
    core = known.filter("into is not null")
    out = core.select(F.col("node").alias("_n"), F.size("includes").alias("out"))
    joined = edge(core).join(out, F.col("dst") == F.col("_n"), "left").select("src", "dst", "out", "into")
    joined = joined.unionByName(edge(known.filter("into is null")).select("src", "dst", F.lit(None).cast("int").alias("out"), "into"))
    return joined.select("src", "dst", _centrality(F.col("out"), F.col("into"), n_files).alias("centrality"))


def edge_metric(edges: DataFrame, files: DataFrame, metric: str, n_roots: int, n_files: int) -> DataFrame:
    """``src, dst, weight`` by one of :data:`METRICS` (M1-M8).

    ``edges``: ``src, dst, esize``; ``files``: ``file, size, tsize, prevalence``.
    """
    e = edges.select("src", "dst", "esize")
    if metric == "input_size":
        return e.select("src", "dst", F.col("esize").alias("weight"))
    if metric == "centrality":
        return centrality(edges, n_files).withColumnRenamed("centrality", "weight")
    end, column = {"expanded_size": ("dst", "tsize"), "file_size": ("dst", "size"), "prevalence": ("src", "prevalence"), "includer_size": ("src", "size")}[metric]
    f = files.select(F.col("file").alias("_f"), F.col(column).alias("_v"))
    value = F.lit(100.0) * F.col("_v") / F.lit(n_roots) if metric == "prevalence" else F.col("_v")
    return e.join(f, F.col(end) == F.col("_f"), "left").select("src", "dst", value.alias("weight"))


def edge_metrics(
    edges: DataFrame, files: DataFrame, n_roots: int, n_files: int, metric: str | None = None, threshold: float = 0.0, pattern: str | None = None, generated=False, mojom=False, third_party=False
) -> DataFrame:
    """``file, include, esize, prevalence_pct, tsize, centrality`` per edge of files that are
    analysed (M9, F1), less those whose ``metric`` is below the threshold (F15: 0 filters
    nothing, and an unknown value passes).

    What is known of a file, its degrees included, is put in one row first, so that
    edges are joined twice only.
    """
    f = files.select("file", "prevalence", "tsize").join(degrees(edges), F.col("file") == F.col("node"), "full")
    f = stored(f.select(F.coalesce("file", "node").alias("file"), "prevalence", "tsize", "out", "into"), "file-metrics")
    src = f.select(F.col("file").alias("_s"), F.col("prevalence").alias("_p"), "into")
    dst = f.select(F.col("file").alias("_d"), "tsize", "out")
    kept = edges.select("src", "dst", "esize").filter(keep_filename(F.col("src"), pattern, generated, mojom, third_party))
    joined = kept.join(src, F.col("src") == F.col("_s"), "left").join(dst, F.col("dst") == F.col("_d"), "left")
    out = joined.select(
        F.col("src").alias("file"), F.col("dst").alias("include"), "esize", (F.lit(100.0) * F.col("_p") / F.lit(n_roots)).alias("prevalence_pct"), "tsize",
        _centrality(F.col("out"), F.col("into"), n_files).alias("centrality"),
    )
    return _reaching(out, {"input_size": "esize", "expanded_size": "tsize", "centrality": "centrality", "prevalence": "prevalence_pct"}.get(metric), threshold)


def _reaching(rows: DataFrame, column: str | None, threshold: float) -> DataFrame:
    return rows.filter(F.col(column).isNull() | (F.col(column) >= threshold)) if threshold and column else rows


def file_metrics(files: DataFrame, metric: str | None = None, threshold: float = 0.0, pattern: str | None = None, generated=False, mojom=False, third_party=False) -> DataFrame:
    """``file, asize, prevalence, tsize`` of files that are analysed (M10, F1); the prevalence
    is a count of roots, and a threshold of 0 filters nothing (F15)."""
    kept = files.filter(keep_filename(F.col("file"), pattern, generated, mojom, third_party)).select("file", "asize", "prevalence", "tsize")
    return _reaching(kept, {"input_size": "asize", "expanded_size": "tsize", "prevalence": "prevalence"}.get(metric), threshold)


def edge_stats(edges: DataFrame, roots: DataFrame, generated: str = "out/") -> DataFrame:
    """One row of edge counts (A1, A2): all, from roots, from others, each also without
    generated includers.  Parallel edges count."""
    r = roots.select(F.col("node").alias("_r")).distinct()
    e = edges.select("src").join(r, F.col("src") == F.col("_r"), "left")
    is_root, own = F.col("_r").isNotNull(), ~F.col("src").startswith(generated)
    return e.agg(
        F.count("*").alias("edges"), F.count_if(own).alias("edges_own"),
        F.count_if(is_root).alias("root_edges"), F.count_if(is_root & own).alias("root_edges_own"),
        F.count_if(~is_root).alias("other_edges"), F.count_if(~is_root & own).alias("other_edges_own"),
    )


def included_by_roots(edges: DataFrame, roots: DataFrame, generated: str = "out/") -> DataFrame:
    """``file, n_roots, n_own_roots``: how many roots include each file directly (A3, L3)."""
    r = roots.select(F.col("node").alias("_r")).distinct()
    e = edges.select("src", "dst").join(r, F.col("src") == F.col("_r"), "left_semi")
    return e.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n_roots"), F.count_if(~F.col("src").startswith(generated)).alias("n_own_roots"))


def most_included(edges: DataFrame, roots: DataFrame, top: int, n_roots: int) -> DataFrame:
    """``file, n_roots, prevalence_pct, n_own_roots`` of the ``top`` files that most roots
    include directly; ties by name (L3, K3)."""
    counts = included_by_roots(edges, roots).orderBy(F.desc("n_roots"), "file").limit(top)
    return counts.select("file", "n_roots", (F.lit(100.0) * F.col("n_roots") / F.lit(n_roots)).alias("prevalence_pct"), "n_own_roots")


def list_weights(listed: DataFrame, weights: DataFrame, threshold: float | None = None) -> DataFrame:
    """``listed`` edges with their ``weight`` (null if unknown), less those below ``threshold``
    (F14: 0 is a threshold, and an unknown weight passes; J3)."""
    known = weights.groupBy(F.col("src").alias("_s"), F.col("dst").alias("_d")).agg(F.max("weight").alias("weight"))
    out = listed.join(known, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left").drop("_s", "_d")
    return out if threshold is None else out.filter(F.col("weight").isNull() | (F.col("weight") >= threshold))
