"""Tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder that the session has set.

    A session on one machine (``local[...]``) that names neither gets a temporary
    folder.  On a cluster that would be a different disk for every executor, so
    there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessaline-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def _own_folder(spark: SparkSession):
    """The application's own folder as a path of the JVM, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tessaline-{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Tables of more bytes on disk are not sent through the driver.  Names in order take less than a byte a row there
#: (9 million roots: 4 MB), but a hundred in the driver.
BROADCAST_BYTES = 256 << 10


def bound_broadcasts(spark: SparkSession) -> None:
    """Let joins broadcast a table by its bytes on disk only if these are few.

    What a shuffle has counted in full is still broadcast up to the size that the session names.
    """
    told = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)i?b?\s*", told.lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > BROADCAST_BYTES:
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", told)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))


def materialize(df: DataFrame, name: str, partition_by: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and outlives any executor.

    The files go when the application ends, or at :func:`cleanup`.  ``spark`` reads them,
    if not the session that writes.
    """
    spark = spark or df.sparkSession
    bound_broadcasts(spark)
    folder, files = _own_folder(spark)
    path = f"{folder.toString()}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    files.deleteOnExit(folder)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.is_stored = True
    return stored


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if :func:`materialize` returned it, else written."""
    return df if getattr(df, "is_stored", False) else materialize(df, name)


def cleanup(spark: SparkSession) -> None:
    """Remove every table that :func:`materialize` has written in this application.

    For long-lived sessions: call it once results read from those tables are stored.
    """
    folder, files = _own_folder(spark)
    files.delete(folder, True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row, from 1, in the order of those columns.

    Rows are dealt by ranges of the order, and each range's rows are counted from what
    the ranges before it hold, so no task has more than a range.  Rows alike in all of
    ``order`` have places next to each other, the same whenever the result is read.
    """
    columns = [F.col(c) for c in order]
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "numbered")
    place = F.shiftright("_at", 33)
    before, rows = 0, []
    for part, n in sorted(dealt.groupBy(place.alias("part")).count().collect()):  # one row a range
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _before long")
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    joined = dealt.join(F.broadcast(offsets), place == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + within + 1).drop("_at", "_part", "_before")


def part_of(table: DataFrame, df: DataFrame) -> DataFrame:
    """``df``, a projection or filter of ``table``, as cheap to read again as a stored ``table`` is."""
    df.is_stored = getattr(table, "is_stored", False)
    return df
