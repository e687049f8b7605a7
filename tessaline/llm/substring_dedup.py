"""Substring dedup by sliding sentence spans.

A text is cut into sentences; every run of several consecutive sentences with
enough words is hashed (letters A-Z count as a-z, white space doesn't count), hashes
join globally, and sentences covered by any repeated run other than its first
occurrence are removed.

Hashes are counted in one pass.  A second pass makes the runs again and keeps those
whose hash repeats, with their places; of those few the first place is found and
the others are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_MAX_BYTES, hash_filter, in_filter, materialize, releasing
from .textkernel import COEF, IS_SPACE, LOWER, chunks, mix64, prefix_sums, range_hash, row_of, runs

#: A run has at least so many sentences and so many words.
MIN_SENTENCES = 3
MIN_WORDS = 30
#: A sentence ends at a line end, after a word that ends in one of ENDERS (closing
#: quotes and brackets may follow), and at a lone BAR, which parts the items of menus.
ENDERS = ".!?"
CLOSERS = "\"')]"
BAR = "|"
#: Text that goes on for more words without an end is cut after words whose hash has
#: CUT_MASK's bits unset, so that its pieces are the same wherever it stands.
LONG_SENTENCE = 40
CUT_MASK = 3


def longest_sentence(passage: int) -> int:
    """The words that a sentence may have if nearly every passage of ``passage`` words is to hold a run.

    A passage can begin and end within a sentence; what both leave must be long enough
    for a run.  Pieces of cut sentences have lengths by hash, so a few passages still don't.
    """
    if passage <= MIN_WORDS:
        raise ValueError(f"a run has {MIN_WORDS} words at least, so a passage needs more than {passage}")
    return min(LONG_SENTENCE, max(1, (passage - MIN_WORDS) // 2))

_ENDER, _CLOSER = np.zeros(256, bool), np.zeros(256, bool)
_ENDER[[ord(c) for c in ENDERS]] = True
_CLOSER[[ord(c) for c in CLOSERS]] = True


def _sentences(c, longest):
    """Word ranges, rows and hashes, and for each sentence its first word."""
    data = LOWER[c.data]
    start, end = runs(~IS_SPACE[data], c.offsets)
    row = row_of(c.offsets, start)
    h = range_hash(data, prefix_sums(data), start, end)
    if not len(start):
        return start, end, row, h, np.zeros(0, np.int64)
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    last = end - 1
    while (closing := _CLOSER[data[last]] & (last > start)).any():
        last = last - closing
    ends = _ENDER[data[last]] | ((end - start == 1) & (data[start] == ord(BAR)))
    ends[:-1] |= (lines[start[1:]] > lines[end[:-1]]) | (row[1:] != row[:-1])
    ends[-1] = True
    sentence = np.cumsum(ends) - ends
    length = np.bincount(sentence)
    ends |= (length[sentence] > longest) & ((h & np.uint64(CUT_MASK)) == 0)
    first = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    return start, end, row, h, first


def _spans(c, longest=LONG_SENTENCE):
    """For each sentence that starts a run: row, number in its row, sentences, two hashes."""
    start, end, row, h, first = _sentences(c, longest)
    n = len(first)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    bounds = np.append(first, len(h))
    own_row = row[first]
    # The run ends with the first sentence that makes it long enough.
    last = np.searchsorted(bounds, first + MIN_WORDS, "left") - 1
    last = np.maximum(last, np.arange(n) + MIN_SENTENCES - 1)
    ok = last < n
    last = np.minimum(last, n - 1)
    ok &= own_row[last] == own_row
    at = np.flatnonzero(ok)
    last = last[at]
    begin, stop = first[at], bounds[last + 1]
    # Polynomial hash of a run of words, from prefix sums over the words' hashes.
    hashes = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        steps = np.full(len(h) + 1, base, np.uint64)
        steps[0] = 1
        power = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = pow(base, -1, 1 << 64)
        inverse = np.cumprod(steps, dtype=np.uint64)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h * COEF[len(hashes)]) * power[:-1], out=sums[1:], dtype=np.uint64)
        hashes.append(mix64((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64)).view(np.int64))
    number = np.arange(n) - np.searchsorted(own_row, own_row, "left")
    return own_row[at], number[at], last - at + 1, hashes[0], hashes[1]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, text``: written once, so that row numbers stay what they are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "span-rows")


def spans(rows: DataFrame, mask=None, longest: int = LONG_SENTENCE) -> DataFrame:
    """``h1, h2, doc_id, row, at, n``: every run's 128-bit hash, place and length.

    ``rows``: ``row, doc_id, text``.  With ``mask``, runs whose hash it can't hold
    are left out.  Sentences of more than ``longest`` words are cut.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(2)):
                rows, at, n, h1, h2 = _spans(c, longest)
                if mask is not None:
                    kept = in_filter(mask.value, h1)
                    rows, at, n, h1, h2 = rows[kept], at[kept], n[kept], h1[kept], h2[kept]
                own = b.slice(c.first, c.n).select(["doc_id", "row"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), *own.columns, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h1", "h2", "doc_id", "row", "at", "n"])

    return rows.select("row", "doc_id", "text").mapInArrow(releasing(make), "h1 long, h2 long, doc_id long, row long, at int, n int")


def _repeated(rows: DataFrame, longest: int) -> DataFrame:
    """``h1, h2`` of the runs that occur more than once; counted per task before the shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(0)):
                _, _, _, h1, h2 = _spans(c, longest)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2)], names=["h1", "h2"])

    found = rows.select("text").mapInArrow(releasing(make), "h1 long, h2 long")
    return found.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed, removed_words`` for every row.

    ``text`` lacks the removed sentences; the others keep their bytes and the white
    space after them.  A run's first occurrence is the one with the smallest
    ``(doc_id, place of the row in the input, sentence)``, rows without an id last;
    it stays, whatever else is cut.  Rows are told apart by their place, so rows
    that repeat an id, or have none, are cut each by its own runs, and of exact
    repeats the first stays.  Repeats within a row count too.  A text with too few
    sentences or words for a run is left alone, as are null and empty texts.  Texts
    of any length are cut whole.  An empty table gives no rows, and other columns
    aren't read.

    Sentences of more than LONG_SENTENCE words are cut in pieces; with ``passage``, so
    are those that could keep a repeated passage of more words from holding a run,
    wherever in a sentence it begins and ends (:func:`longest_sentence`).
    """
    longest = LONG_SENTENCE if passage is None else longest_sentence(passage)
    rows = _numbered(docs, id_col, text_col)
    repeated = materialize(_repeated(rows, longest), "span-repeats")
    if repeated.count() <= FILTER_MAX_BYTES * 2:  # four bits each at least
        found = spans(rows, hash_filter(repeated.select("h1")), longest)
    else:
        listed = repeated.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
        found = spans(rows, longest=longest).join(listed, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    # What the filter lets through besides occurs once.  Written, the first places are a
    # plain side of a join, whose other side can be dealt anew where one run is very common.
    found = materialize(found, "span-places")
    firsts = found.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min(place).alias("_first"), F.count("*").alias("_c"))
    firsts = materialize(firsts.filter("_c > 1").drop("_c"), "span-firsts")
    later = found.join(firsts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(place != F.col("_first"))
    cut = later.groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("at", "n")).alias("cut"))
    cut = materialize(cut, "span-cuts")
    joined = rows.join(cut, F.col("row") == F.col("_row"), "left").select("doc_id", "text", "cut")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            cuts = b.column(2)
            n_sentences, n_removed, removed_words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for c in chunks(b.column(1)):
                start, _, row, _, first = _sentences(c, longest)
                bounds = np.append(first, len(start))
                n_sentences[c.first : c.first + c.n] = np.bincount(row[first], minlength=c.n)
                begin = np.searchsorted(row[first], np.arange(c.n + 1))
                for i in range(c.n):
                    got = cuts[c.first + i].as_py()
                    if not got:
                        continue
                    lo, hi = begin[i], begin[i + 1]
                    gone = np.zeros(hi - lo, bool)
                    for s in got:
                        gone[s["at"] : s["at"] + s["n"]] = True
                    n_removed[c.first + i] = gone.sum()
                    removed_words[c.first + i] = int((bounds[lo + 1 : hi + 1] - bounds[lo:hi])[gone].sum())
                    edges = np.append(start[first[lo:hi]], c.offsets[i + 1])
                    edges[0] = c.offsets[i]
                    raw = c.data
                    texts[c.first + i] = b"".join(raw[edges[j] : edges[j + 1]].tobytes() for j in np.flatnonzero(~gone)).decode()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(n_sentences), pa.array(n_removed), pa.array(removed_words)],
                names=["doc_id", "text", "n_sentences", "n_removed", "removed_words"],
            )

    return joined.mapInArrow(releasing(remove), "doc_id long, text string, n_sentences long, n_removed long, removed_words long")
