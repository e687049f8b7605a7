"""Snapshot diffs and prevalence series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import keep_filename

MEGABYTE = 1024 * 1024


# Fixed value: the date in a snapshot's file name.
FILE_DATE = r"includes_(\d+-\d+-\d+_\d+)"


def parse_date(text: Column) -> Column:
    """The timestamp of an ISO date that may end in " UTC"."""
    return F.to_timestamp(F.regexp_replace(text, " UTC$", ""))


def file_date(url: Column) -> Column:
    """The timestamp in a snapshot's file name; null without one."""
    return F.to_timestamp(F.nullif(F.regexp_extract(url, FILE_DATE, 1), F.lit("")), "yyyy-MM-dd_HHmmss")


def locate(index: DataFrame, date: Column) -> DataFrame:
    """``pos, url``: the first of the index's snapshots from the hour of ``date`` or the next.

    ``index``: ``pos, url`` in the index's order.  File names carry a slightly later
    time than the analysis itself, which may fall in the next hour, or day.
    """
    hour = F.date_trunc("hour", date)
    near = index.withColumn("_hour", F.date_trunc("hour", file_date(F.col("url")))).filter((F.col("_hour") == hour) | (F.col("_hour") == hour + F.expr("interval 1 hour")))
    return near.agg(F.min_by(F.struct("pos", "url"), "pos").alias("first")).filter("first is not null").select("first.pos", "first.url")


def bucket_label(bucket: Column) -> Column:
    """C4: a bucket's heading, without a fraction of zero."""
    return F.concat(F.regexp_replace(bucket.cast("double").cast("string"), "\\.0$", ""), F.lit("%"))


def flagged(current: Column, previous: Column, zero: float, increase: float, decrease: float) -> Column:
    """Whether a change is worth reporting, sizes in bytes and percentages."""
    diff = current - previous
    return F.when(previous == 0, diff >= zero).when(current > previous, diff / previous >= increase / 100).otherwise(F.abs(diff) / previous >= decrease / 100)


def diff(now: DataFrame, before: DataFrame, keys: list[str], value: str, minimum: float, zero: float, increase: float, decrease: float, strict: bool) -> DataFrame:
    """Rows of ``now`` that one of the older snapshots flags, by the first that does.

    ``before`` has ``ord`` and ``revision`` per older snapshot.  ``strict``: only values
    above ``minimum`` count (nodes); else values equal to it count too (edges).
    """
    snapshots = before.select("ord", "revision").distinct()
    old = before.select("ord", *(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_previous"))
    pairs = now.join(F.broadcast(snapshots), F.lit(True))  # a handful of snapshots, one row each
    same = pairs["ord"] == old["ord"]
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    joined = pairs.join(old, same, "left").select(*keys, F.col(value).alias("current"), pairs["ord"], "revision", F.coalesce("_previous", F.lit(0)).alias("previous"))
    if strict:
        large = (F.col("previous") == 0) | (F.col("current") > minimum) | (F.col("previous") > minimum)
    else:
        large = (F.col("current") >= minimum) | (F.col("previous") >= minimum)
    hits = joined.filter(large & flagged(F.col("current"), F.col("previous"), zero, increase, decrease))
    first = W.partitionBy(*keys).orderBy("ord")
    return hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*keys, "revision", (F.col("current") - F.col("previous")).alias("difference"), "current")


def nearest_older(index: DataFrame, current: str, days: list[int]) -> DataFrame:
    """``days, snapshot, age``: for each number of days the newest snapshot that is at
    least so old (J9, C3); snapshots of one age are taken once, for the fewest days."""
    age = F.floor((F.lit(current).cast("timestamp").cast("double") - F.col("snapshot").cast("timestamp").cast("double")) / 86400).cast("int")
    wanted = index.sparkSession.createDataFrame([(d,) for d in days], "days int")
    aged = index.withColumn("age", age).filter("age >= 0")
    pairs = aged.join(F.broadcast(wanted), F.col("age") >= F.col("days"))  # one row per stated number
    best = pairs.groupBy("days").agg(F.max_by(F.struct("snapshot", "age"), "snapshot").alias("s")).select("days", "s.*")
    once = W.partitionBy("age").orderBy("days")
    return best.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("days", "snapshot", "age")


def latest_per_day(index: DataFrame) -> DataFrame:
    """``day, snapshot``: the latest snapshot of each calendar day."""
    return index.groupBy(F.to_date("snapshot").alias("day")).agg(F.max("snapshot").alias("snapshot"))


def header_shares(files: DataFrame, root_counts: DataFrame) -> DataFrame:
    """``day, file, pct`` of the files of snapshots that are analysed at all (F1), from counts.

    ``files``: ``day, file, prevalence``; ``root_counts``: ``day, n_roots``.
    """
    kept = files.filter(keep_filename(F.col("file"), generated=True, mojom=True, third_party=True))
    counts = root_counts.select(F.col("day").alias("_day"), "n_roots")
    return kept.join(counts, F.col("day") == F.col("_day")).select("day", "file", (F.lit(100.0) * F.col("prevalence") / F.col("n_roots")).alias("pct"))


def prevalence_buckets(prevalence: DataFrame, buckets: tuple[int, ...] = (10, 20, 30, 40, 50, 60)) -> DataFrame:
    """``day`` and a count per bucket of headers whose percentage reaches it."""
    headers = prevalence.filter(F.col("file").rlike("^.*.h$"))
    return headers.groupBy("day").agg(*(F.sum((F.col("pct") >= b).cast("long")).alias(f"at_least_{b}") for b in buckets))
