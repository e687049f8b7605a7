from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessaline.operators import closure, cuts, metrics
from tessaline.storage import materialize


def test_names_that_are_small_on_disk_alone_are_not_sent_through_the_driver(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    name = F.concat(F.lit("orders/"), F.col("id").cast("string"), F.lit(".cc"))
    roots = materialize(session.range(0, 2_000_000, 1, 2).select(name.alias("node")), "roots")
    edges = materialize(session.range(0, 4_000_000, 2, 2).select(name.alias("src"), F.lit("a.h").alias("dst")), "edges")
    size = sum(Path(p.removeprefix("file://")).stat().st_size for p in roots.inputFiles())
    assert size < 10 << 20  # a broadcast, by this size
    stats = metrics.edge_stats(edges, roots)
    assert "BroadcastHashJoin" not in stats._jdf.queryExecution().executedPlan().toString()
    assert stats.first()[:3] == (2_000_000, 2_000_000, 1_000_000)
    # Few rows are still broadcast, and so is what a shuffle has counted.
    few = materialize(session.createDataFrame([("orders/4.cc",)], "node string"), "few")
    assert "BroadcastHashJoin" in metrics.included_by_roots(edges, few)._jdf.queryExecution().executedPlan().toString()
    assert session.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10m"


@pytest.fixture(scope="module")
def many(spark):
    """A million roots, and an edge from each to one of two headers that include a third."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    name = F.concat(F.lit("orders/"), F.col("id").cast("string"), F.lit(".cc"))
    roots = materialize(session.range(0, 1_000_000, 1, 2).select(name.alias("node")), "roots")
    first = session.range(0, 1_000_000, 1, 2).select(name.alias("src"), F.concat(F.lit("h"), F.col("id") % 2).alias("dst"))
    return materialize(first.unionByName(session.createDataFrame([("h0", "top"), ("h1", "top")], "src string, dst string")), "edges"), roots


def broadcast_joins(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]


def test_includes_of_many_roots_are_joined_without_a_broadcast(many):
    found = metrics.included_by_roots(*many)
    assert not broadcast_joins(found)
    assert sorted(map(tuple, found.collect())) == [("h0", 500_000, 500_000), ("h1", 500_000, 500_000)]


def test_most_included_of_many_roots_is_found_without_a_broadcast(many):
    found = metrics.most_included(*many, 1, 1_000_000)
    assert not broadcast_joins(found)
    assert list(map(tuple, found.collect())) == [("h0", 500_000, 50.0, 500_000)]


def test_many_roots_are_counted_at_dominating_edges_without_a_broadcast(many):
    edges, roots = many
    graph = materialize(edges.filter("dst = 'top' or src in ('orders/4.cc', 'orders/5.cc', 'orders/7.cc')"), "graph")
    found = cuts.dominated_roots(graph, roots, "top")
    assert not [line for line in broadcast_joins(found) if "_r#" in line]
    counts = {("h0", "top"): 1, ("h1", "top"): 2, ("orders/4.cc", "h0"): 1, ("orders/5.cc", "h1"): 1, ("orders/7.cc", "h1"): 1}
    assert {(r["src"], r["dst"]): r["dominated"] for r in found.collect()} == counts


def test_direct_cuts_count_many_roots_without_a_broadcast(many):
    edges, roots = many
    graph = edges.filter("dst = 'top' or src in ('orders/4.cc', 'orders/5.cc', 'orders/7.cc')").withColumn("cuttable", F.col("src") != "h0")
    files = roots.sparkSession.createDataFrame([("h1", 500_000)], "file string, prevalence long")
    found = cuts.direct_cuts(materialize(graph, "graph"), roots, files, "top", 1_000_000)
    assert not [line for line in broadcast_joins(found) if "_r#" in line]
    assert list(map(tuple, found.collect())) == [("h1", "top", 50.0, 2)]


def test_many_roots_above_a_target_are_counted_without_a_broadcast(many):
    edges, roots = many
    found = closure.root_count(edges, roots, roots.sparkSession.createDataFrame([("h1",)], "node string"))
    assert not [line for line in broadcast_joins(found) if "_root#" in line]
    assert list(map(tuple, found.collect())) == [("h1", 500_000)]
    floors = cuts.floors(edges, roots, "h1").first()
    assert (floors["original"], floors["remaining"], floors["direct_floor"], floors["root_direct"]) == (500_000, 500_000, 0, 500_000)


def test_a_lower_limit_on_broadcasts_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    materialize(session.range(3), "three")
    assert session.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert session.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
