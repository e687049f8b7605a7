"""Quality rules per document, and host verdicts from shrunken failure rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing
from .textkernel import IS_SPACE, chunks, grams, prefix_sums, range_hash, row_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A host's prior, fitted to the other hosts, counts as that many documents of it at most.
MAX_STRENGTH = 100.0
#: A host is rejected when its shrunken failure rate is above all of: this rate, so many
#: times the other hosts' mean, and so many standard deviations of the prior above it.
MIN_HOST_FAILURE, MEAN_FACTOR, DEVIATIONS = 0.2, 2.0, 3.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _totals(member: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(member) + 1, np.int64)
    np.cumsum(member, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _chunk_features(c) -> list[np.ndarray]:
    data, w = c.data, words(c)
    space = IS_SPACE[data]
    word_chars = _totals(~space & ((data & 0xC0) != 0x80), c.offsets)
    symbols = _totals(_SYMBOL[data], c.offsets)

    # Lines: cut at \n and at row borders; only lines with a word count.
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([c.offsets[:-1][c.offsets[:-1] < len(data)], cut + 1]))
    start = start[start < len(data)]
    end = np.empty_like(start)
    if len(start):
        end[:-1] = start[1:]
        end[-1] = len(data)
        end -= (data[end - 1] == 10) & (end > start)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=filled[1:])
    has_word = filled[end] > filled[start]
    start, end = start[has_word], end[has_word]
    line_row = row_of(c.offsets, start)
    h = range_hash(data, prefix_sums(data), start, end)
    order = np.lexsort((h, line_row))
    again = (h[order][1:] == h[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    dup_lines = np.bincount(line_row[order][1:][again], minlength=c.n)

    # Words in windows that occur twice or more in their row.
    g, at = grams(w, WINDOW)
    order = np.lexsort((g, w.row[at]))
    gs, rs = g[order], w.row[at][order]
    same = (gs[1:] == gs[:-1]) & (rs[1:] == rs[:-1])
    twice = np.zeros(len(g), bool)
    twice[:-1] |= same
    twice[1:] |= same
    first = at[order][twice]
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    repeat_words = np.bincount(w.row[covered], minlength=c.n)
    return [w.count, word_chars, symbols, dup_lines, repeat_words]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host`` with the counts of :data:`COUNTS` and ``base_failed``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has counts of 0 and
    fails; a null host is a host.  Other columns aren't read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((len(COUNTS), b.num_rows), np.int64)
            for c in chunks(b.column(2)):
                out[:, c.first : c.first + c.n] = _chunk_features(c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, out)], names=["doc_id", "host", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long"), F.col(host_col).cast("string"), F.col(text_col)).mapInArrow(
        releasing(count), "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """``host, host_docs, host_failed, host_rate, host_limit, host_kept`` from rows of :func:`features`.

    Each host's beta prior is fitted to the other hosts by moments, weighted by
    documents: with mean ``m`` and variance ``v`` of their rates, its strength ``s``
    is ``m (1 - m) / v - 1``, held between 1 and ``MAX_STRENGTH``.  The host's rate is
    shrunk to ``(failed + m s) / (docs + s)``, so that a host of few documents is
    judged like the others, and the host is kept unless that is above the limit
    that the prior sets.  A host is left out of its own prior, so that one large bad
    host doesn't hide itself; a single host has none and is kept.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    squares = F.col("host_failed") * F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(squares).alias("q")).first()  # one row
    n, f, q = (total["n"] or 0, total["f"] or 0, total["q"] or 0.0)
    docs = F.nullif(F.lit(n) - F.col("host_docs"), F.lit(0))
    m = (F.lit(f) - F.col("host_failed")) / docs
    v = (F.lit(q) - squares) / docs - F.col("_m") * F.col("_m")
    s = F.when(F.col("_v") > 0, F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(1.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1))).otherwise(F.lit(MAX_STRENGTH))
    rate = (F.col("host_failed") + F.col("_m") * F.col("_s")) / (F.col("host_docs") + F.col("_s"))
    deviation = F.sqrt(F.col("_m") * (1 - F.col("_m")) / (F.col("_s") + 1))
    limit = F.greatest(F.lit(MIN_HOST_FAILURE), MEAN_FACTOR * F.col("_m"), F.col("_m") + DEVIATIONS * deviation)
    fitted = hosts.withColumn("_m", m).withColumn("_v", v).withColumn("_s", s)
    fitted = fitted.withColumn("host_rate", F.coalesce(rate, F.col("host_failed") / F.col("host_docs"))).withColumn("host_limit", F.when(F.col("_m").isNotNull(), limit))
    return fitted.withColumn("host_kept", F.coalesce(F.col("host_rate") <= F.col("host_limit"), F.lit(True))).drop("_m", "_v", "_s")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows of :func:`features` with their host's figures and ``kept``.

    ``kept`` is false where ``base_failed``, else the host's verdict.  One row per
    row of ``docs``, repeated rows included; rows without a host share one verdict, and
    an empty table gives no rows.
    """
    rows = materialize(features(docs, id_col, text_col, host_col), "quality-rows")
    verdicts = materialize(host_verdicts(rows), "quality-hosts").withColumnRenamed("host", "_host")
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
