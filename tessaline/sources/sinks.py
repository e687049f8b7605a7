"""Sinks: byte-compatible CSV, percentages, JSON (K1-K6)."""

from __future__ import annotations

import csv
import os
import uuid
from collections.abc import Iterator
from typing import TextIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, numbered


def write_csv_stream(df: DataFrame, out: TextIO) -> None:
    """Rows in the standard library's CSV dialect (K1), one partition at a time."""
    writer = csv.writer(out)
    for row in df.toLocalIterator(prefetchPartitions=True):
        writer.writerow(row)


def csv_line(*columns: Column) -> Column:
    """Columns as one line of that dialect: quotes only where needed, nulls empty (K1)."""
    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *(field(c) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV part files whose lines end in ``\\r\\n``, written by the executors."""
    df.select(F.concat(csv_line(*(F.col(c) for c in df.columns)), F.lit("\r"))).write.text(path)


def percent(column: Column) -> Column:
    """Two decimals (K2), of the double's exact binary value, ties to even.

    A hundred times the value is the product as a double and its exact error, which
    decides where the product lies at a tie.  From 2**46 on, the platform's own
    formatting serves.
    """
    x = F.abs(column.cast("double"))
    product, whole = x * 100.0, F.floor(x * 100.0)
    split = x * 134217729.0  # 2**27 + 1: its upper half times 100 is exact
    upper = split - (split - x)
    error = (upper * 100.0 - product) + (x - upper) * 100.0
    over = (product - whole.cast("double")) - 0.5
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    hundredths = whole + F.when(up, 1).otherwise(0)
    sign = F.when(column.cast("double").cast("string").startswith("-"), "-").otherwise("")  # of a negative zero too
    shown = F.concat(sign, (F.floor(hundredths / 100)).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return F.when(F.isnan(column) | (x >= float(1 << 46)), F.format_string("%.2f", column)).otherwise(shown)


def thousands(column: Column) -> Column:
    """Thousands separators (K3)."""
    return F.format_number(column, 0)


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row (K4)."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def prepend_edges(new: DataFrame, old: DataFrame) -> DataFrame:
    """``pos, line`` of an edge list with the new edges before the old, each in order of its ``pos`` (K6)."""
    rows = [d.select(F.lit(i).alias("_prio"), F.col("pos").alias("_pos"), csv_line(F.col("src"), F.col("dst")).alias("line")) for i, d in enumerate((new, old))]
    return numbered(rows[0].unionByName(rows[1]), ["_prio", "_pos", "line"], "pos").select("pos", "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of ``pos, line`` as text files whose names, put in order, give the lines in order."""
    lines.repartitionByRange("pos").sortWithinPartitions("pos").select("line").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, line`` of what :func:`write_lines` wrote: numbered by file name and place in the file."""
    read = spark.read.text(path).select(F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    return numbered(read, ["_file", "_block", "_row"], "pos").select("pos", "line")


def save_sources(texts: DataFrame, root: str, dry_run: bool = True) -> DataFrame:
    """``file`` of the ``file, text`` rows, which are written below ``root`` unless ``dry_run`` (K5).

    Tasks write every text beside its file, under a name of this run; only once all are
    there do tasks put them in the files' place.  So a run that fails while it writes
    leaves the files as they were, and one whose second half is repeated, after a lost
    executor, ends the same.  ``root`` is a folder that all executors share.
    """
    if dry_run:
        return texts.select("file")
    stamp = f".{uuid.uuid4().hex}.new"

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"]):
                path = os.path.join(root, file)
                if not os.path.isfile(path):
                    raise FileNotFoundError(path)
                with open(path + stamp, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield pdf[["file"]]

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file in pdf["file"]:
                path = os.path.join(root, file)
                if os.path.exists(path + stamp):  # else an earlier attempt has put it
                    os.replace(path + stamp, path)
            yield pdf

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file in pdf["file"]:
                if os.path.exists(os.path.join(root, file) + stamp):
                    os.remove(os.path.join(root, file) + stamp)
            yield pdf

    kind = "file string"
    try:
        staged = materialize(texts.select("file", "text").mapInPandas(stage, kind), "staged-sources")
    except Exception:
        texts.select("file").mapInPandas(drop, kind).write.format("noop").mode("overwrite").save()
        raise
    return materialize(staged.mapInPandas(put, kind), "saved-sources")
