"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target over its size is every document's expected number of
copies.  The integral part is certain; the fractional parts are rounded by the
pivotal method, on words instead of counts: two documents exchange words until
one of them is integral, so that a source's total is kept exactly and at the end
one document per source is rounded by itself.  Documents meet first within
buckets of bounded size, then the buckets' residuals within a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, releasing
from .textkernel import chunks, words

BUCKET_ROWS = 4096
FAN_IN = 64
MAX_COPIES = 3
#: Rows alike in id, source and size are numbered in runs of so many.
REPEATS = 65_536


def word_sizes(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns with ``size``: the number of words ``[^\\x20\\x09-\\x0D]+``."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", size bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.zeros(b.num_rows, np.int64)
            for c in chunks(b.column(len(keep))):
                sizes[c.first : c.first + c.n] = words(c).count
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(sizes)], names=[*keep, "size"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(releasing(count), schema)


def water_fill(sizes: list[int], weights: list[float], ceiling: float = MAX_COPIES) -> list[float]:
    """Targets by weight that sum to all sizes; none above ``ceiling`` times its size."""
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = float(sum(sizes))
    while open_ and rest > 0:
        weight = sum(weights[i] for i in open_)
        stopped = [i for i in open_ if rest * weights[i] / weight > ceiling * sizes[i]]
        if not stopped:
            for i in open_:
                targets[i] = rest * weights[i] / weight
            break
        for i in stopped:
            targets[i] = float(ceiling * sizes[i])
        rest -= sum(targets[i] for i in stopped)
        open_ = [i for i in open_ if i not in set(stopped)]
    return targets


def source_targets(sources: DataFrame, ceiling: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, n, target`` of a table of sources, as :func:`water_fill` would.

    Sources may be as many as hosts: they are ordered and summed on the executors.
    """
    spark = sources.sparkSession
    ordered = sources.withColumn("_none", F.col("source").isNull()).repartitionByRange("_none", "source")
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id()), "mix-sources")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("c")).orderBy("_part").collect()  # one row a partition
    offsets, at = [], 0
    for r in counts:
        offsets.append((r["_part"], at))
        at += r["c"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "_p int, _at long"))
    place = F.row_number().over(W.partitionBy("_part").orderBy("_none", "source")) + F.col("_at") - 1
    weighed = materialize(ordered.join(offsets, F.col("_part") == F.col("_p")).withColumn("weight", 1 + place % 3), "mix-weights")
    most = ceiling * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, weight, stopped = float(total), 0, -1
    share = F.lit(0.0)
    while True:  # a source that has stopped stays so, as what is left for a unit of weight only grows
        is_open = F.lit(True) if stopped < 0 else share <= most
        sums = weighed.agg(F.sum(F.when(is_open, F.col("weight"))), F.sum(F.when(~is_open, most)), F.count(F.when(~is_open, 1))).first()
        if sums[2] == stopped:
            break
        weight, rest, stopped = sums[0] or 1, float(total - (sums[1] or 0)), sums[2]
        share = F.lit(rest) * F.col("weight") / F.lit(float(weight))
    return weighed.select("source", "source_size", "n", F.when(share <= most, share).otherwise(most.cast("double")).alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round ``p`` pairwise; the words ``sum(size * p)`` stay, at most one stays fractional.

    ``u``: a uniform number per entry, used when it meets the residual before it.
    """
    p = p.copy()
    eps = 1e-12
    hold = -1
    for j in range(len(p)):
        if size[j] == 0:
            p[j] = 0.0
        if p[j] <= eps or p[j] >= 1 - eps:
            p[j] = round(p[j])
            continue
        if hold < 0:
            hold = j
            continue
        i = hold
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # words that may go from j to i
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if u[j] * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for k in (i, j):
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = round(p[k])
        hold = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def _round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    # Like sizes meet, and the residual ends among the smallest.
    pdf = pdf.sort_values(["size", "h", "part"], ascending=False, kind="stable").reset_index(drop=True)
    p = pivotal(pdf["size"].to_numpy(np.int64), pdf["p"].to_numpy(float), pdf["u"].to_numpy(float))
    return pdf.assign(p=p)


def mix(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17) -> DataFrame:
    """``id, source, size, source_size, target, copies, taken`` of every row of ``sized``.

    ``sized`` has a ``size`` per row.  Sources, in code point order with null
    last, weigh 1, 2, 3, repeating.  Every document gets the floor of its
    source's expected copies or one more, so at most ``MAX_COPIES``.  The draw
    depends on id, size, source and ``seed`` alone, so reruns agree.  Repeated rows
    are counted and numbered, so that they spread over the buckets even where one
    id, or none, is on a third of all rows.  Empty documents and
    empty sources take 0 words.  An empty table gives no rows, and other columns
    aren't read.  The driver holds nothing per document or source.
    """
    spark = sized.sparkSession
    rows = sized.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).alias("source"), F.col("size").cast("long"))
    rows = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("alike")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.sum("alike").alias("n"))
    goals = source_targets(sources)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.select(F.col("source").alias("g_source"), "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    goals = materialize(goals, "mix-goals")
    sized_by = goals.agg(F.count("*").alias("n"), F.max("buckets").alias("buckets")).first()
    goals = F.broadcast(goals) if sized_by["n"] <= 100_000 else goals
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    rows = rows.withColumn("run", F.explode(F.expr(f"sequence(0L, (alike - 1) div {REPEATS})")))
    rows = rows.withColumn("rank", F.explode(F.expr(f"sequence(run * {REPEATS}, least(alike, (run + 1) * {REPEATS}) - 1)"))).drop("run", "alike")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "source", "rank")).withColumn("whole", F.floor("rate").cast("int"))
    unit = lambda level: F.pmod(F.xxhash64(F.lit(level), "h", "part"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "rank"), F.col("buckets")))
    rows = rows.withColumn("p", F.col("rate") - F.col("whole")).withColumn("u", unit(0)).drop("rate", "buckets", "rank")
    schema = rows.schema
    done = materialize(rows.groupBy("source", "part").applyInPandas(_round_group, schema), "mix-level")
    settled = done.filter("p = 0 or p = 1")
    left = done.filter("p > 0 and p < 1")
    level, parts = 1, sized_by["buckets"] or 1
    finished = [settled]
    while parts > 1:
        left = left.withColumn("part", F.floor(F.col("part") / FAN_IN)).withColumn("u", unit(level))
        left = materialize(left.groupBy("source", "part").applyInPandas(_round_group, schema), f"mix-level{level}")
        finished.append(left.filter("p = 0 or p = 1"))
        left = left.filter("p > 0 and p < 1")
        parts = -(-parts // FAN_IN)
        level += 1
    finished.append(left.withColumn("u", unit(level)).withColumn("p", F.when(F.col("u") < F.col("p"), 1.0).otherwise(0.0)))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("int")
    doc_id = F.col("doc_id").cast(sized.schema[id_col].dataType)  # text meanwhile: pandas has no integers beside nulls
    return out.select(doc_id.alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
