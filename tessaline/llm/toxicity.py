"""Toxicity from the nearest labelled examples by exact cosine of weighted TF-IDF vectors.

Terms are lower-case letter runs, all those of the sampled examples: none is left
out.  A term weighs its TF-IDF times the chi-square of its occurrence against the
label, so that neighbours are alike in what tells the labels apart; terms that tell
nothing keep a small weight, so that nearly every text has neighbours.

The index is inverted with block maxima: like examples share a block, and every term
knows its largest weight in each block.  A batch of texts first visits each text's
most promising blocks, which gives a k-th best cosine to beat, and then the blocks
whose bound reaches that.  Distance-weighted votes of the k nearest give the score,
and those neighbours are its evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, broadcast_checked, materialize, releasing
from .textkernel import Chunk, chunks, prefix_sums, range_hash, row_of, runs

#: The classifier is fitted to at most so many labelled rows, drawn by hash, that bring at
#: most so many (row, word) pairs to the driver and make an index of at most so many bytes.
SAMPLE_ROWS = 4_096
SAMPLE_TERMS = 4_000_000
INDEX_BYTES = BROADCAST_LIMIT * 15 // 16
#: Bytes of the index for a different word, for a (row, word) pair and for a row.
TERM_BYTES, PAIR_BYTES, ROW_BYTES = 20, 12, 16
#: A term that tells nothing about the label weighs so much besides its chi-square.
LEAST_WEIGHT = 0.2
#: Bits of a term's hash by which unknown terms are told.
FILTER_BITS = 22
BLOCK = 64
#: Blocks that a text visits before its k-th best cosine limits the others.
FIRST_BLOCKS = 2
#: Examples that lead the blocks: each example goes with the nearest of them.
LEADERS = 64
#: A term in more than one of so many examples has a column of its own, others a list;
#: columns take at most so many bytes, those of the most frequent terms.
COMMON = 32
COLUMN_BYTES = 128 << 20
NEIGHBOURS = 15
PRIOR_VOTES = 1.0
NEAR = 0.05
#: Cosines are compared and told to so many decimals, which hides the order of sums.
DECIMALS = 9

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _terms(c) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term of a chunk of lower-case texts."""
    start, end = runs(_LETTER[c.data], c.offsets)
    return row_of(c.offsets, start), range_hash(c.data, prefix_sums(c.data), start, end)


def _lowered(texts: pa.Array) -> Iterator[Chunk]:
    """Row chunks of the lower-case texts; only a part of the batch is held twice."""
    for at in range(0, len(texts), 512):
        for c in chunks(pc.utf8_lower(texts.slice(at, 512))):
            c.first += at
            yield c


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and which range each is from."""
    n = (end - start).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n - start)[of], of


class Model:
    """Vocabulary, examples and the block-max index.

    ``example, term, tf`` list what words each example has, ``term`` as a number in
    ``terms``, which are sorted hashes; ``weight`` is every term's own.
    """

    def __init__(self, terms: np.ndarray, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, example: np.ndarray, term: np.ndarray, tf: np.ndarray, base_rate: float, empty_rate: float):
        self.terms, self.weight = terms, weight
        self.base_rate, self.empty_rate = base_rate, empty_rate
        value = (1 + np.log(tf)) * weight[term]
        value /= np.maximum(np.sqrt(np.bincount(example, value * value, minlength=len(ids))), 1e-300)[example]
        order = self._order(len(ids), len(terms), example, term, value)
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        self.ids, self.labels = ids[order], labels[order]
        by_term = np.lexsort((number[example], term))
        self.post_example, self.post_value = number[example][by_term].astype(np.int32), value[by_term]
        self.post_start = np.searchsorted(term[by_term], np.arange(len(terms) + 1)).astype(np.int32)
        self.n_bytes = sum(a.nbytes for a in vars(self).values() if isinstance(a, np.ndarray))

    @staticmethod
    def _order(n: int, n_terms: int, example: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Examples by their nearest leader, then by their main term, so that blocks are alike."""
        by_term = np.lexsort((example, term))
        start = np.searchsorted(term[by_term], np.arange(n_terms + 1))
        by_example = np.lexsort((term, example))
        own = np.searchsorted(example[by_example], np.arange(n + 1))
        best, leader = np.full(n, -1.0), np.zeros(n, np.int64)
        for k, x in enumerate(np.unique(np.linspace(0, max(0, n - 1), min(n, LEADERS)).astype(np.int64))):
            at = by_example[own[x] : own[x + 1]]
            posts, of = _ranges(start[term[at]], start[term[at] + 1])
            cosine = np.bincount(example[by_term][posts], value[at][of] * value[by_term][posts], minlength=n)
            leader[cosine > best] = k
            best = np.maximum(best, cosine)
        main = np.zeros(n, np.int64)
        by_value = np.lexsort((term, value))
        main[example[by_value]] = term[by_value]
        return np.lexsort((np.arange(n), main, leader))

    def prepare(self) -> Model:
        """Builds what is derived from the postings: filter, block maxima and common terms' columns."""
        if hasattr(self, "filter"):
            return self
        n, n_terms = len(self.ids), len(self.terms)
        self.blocks = -(-n // BLOCK)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.terms >> np.uint64(64 - FILTER_BITS)] = True
        term = np.repeat(np.arange(n_terms), np.diff(self.post_start))
        frequency = np.diff(self.post_start)
        common = np.flatnonzero(frequency > max(1, n // COMMON))
        room = COLUMN_BYTES // max(1, self.blocks * BLOCK * 8)
        common = np.sort(common[np.lexsort((common, -frequency[common]))[:room]])
        self.column = np.full(n_terms + 1, -1, np.int64)
        self.column[common] = np.arange(len(common))
        at = np.flatnonzero(self.column[term] >= 0)
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        self.dense[self.column[term[at]], self.post_example[at]] = self.post_value[at]
        self.dense_max = self.dense.reshape(len(common), self.blocks, BLOCK).max(axis=2, initial=0.0)
        # Entries of the other terms: a term's largest weight in one block.
        block = self.post_example // BLOCK
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        begins = np.flatnonzero(first)
        self.entry_block = block[begins]
        self.entry_max = np.maximum.reduceat(self.post_value, begins) if len(begins) else np.zeros(0)
        self.entry_start = np.searchsorted(begins, self.post_start)
        self.entry_post = np.append(begins, len(term))
        return self

    def counts(self, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term number and frequency, ordered by row, of a chunk's known terms."""
        rows, hashes = _terms(c)
        if not len(self.terms):
            rows, hashes = rows[:0], hashes[:0]
        maybe = self.filter[hashes >> np.uint64(64 - FILTER_BITS)]
        rows, hashes = rows[maybe], hashes[maybe]
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == hashes if len(at) else np.zeros(0, bool)
        key, tf = np.unique(rows[known] * max(1, len(self.terms)) + at[known], return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), tf

    def nearest(self, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_rows: int, k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """For each row the k largest cosines as (cosine, example); ties to the smaller example.

        Exact: a block is left out only where its bound is below the k-th cosine of
        the blocks that were visited.
        """
        q = (1 + np.log(tf)) * self.weight[terms]
        q /= np.maximum(np.sqrt(np.bincount(rows, q * q, minlength=n_rows)), 1e-300)[rows]
        column = self.column[terms]
        common = column >= 0
        dense_q = np.zeros((n_rows, len(self.dense)))
        dense_q[rows[common], column[common]] = q[common]
        rare_row, rare_term, rare_q = rows[~common], terms[~common], q[~common]
        # Bounds of all blocks.
        entries, of = _ranges(self.entry_start[rare_term], self.entry_start[rare_term + 1])
        entry_row, entry_block, entry_q = rare_row[of], self.entry_block[entries], rare_q[of]
        bounds = np.bincount(entry_row * self.blocks + entry_block, entry_q * self.entry_max[entries], minlength=n_rows * self.blocks).astype(float)
        bounds = bounds.reshape(n_rows, self.blocks) + dense_q @ self.dense_max
        width = self.blocks * BLOCK
        cosines = np.zeros((n_rows, self.blocks, BLOCK))
        seen = np.zeros((n_rows, self.blocks), bool)

        def visit(wanted: np.ndarray) -> None:
            # Of the lists only the parts in wanted blocks are read.
            read = wanted[entry_row, entry_block]
            at = entries[read]
            posts, of = _ranges(self.entry_post[at], self.entry_post[at + 1])
            place = entry_row[read][of] * width + self.post_example[posts]
            cosines.reshape(-1)[:] += np.bincount(place, entry_q[read][of] * self.post_value[posts], minlength=n_rows * width)
            for block in np.flatnonzero(wanted.any(axis=0)):
                at = np.flatnonzero(wanted[:, block])
                cosines[at, block] += dense_q[at] @ self.dense[:, block * BLOCK : (block + 1) * BLOCK]
            seen[wanted] = True

        first = np.zeros_like(seen)
        promising = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        np.put_along_axis(first, promising, True, axis=1)
        visit(first)
        visited = np.take_along_axis(cosines, promising[:, :, None], axis=1).reshape(n_rows, -1)
        kth = np.partition(visited, -k, axis=1)[:, -k] if visited.shape[1] >= k else np.zeros(n_rows)
        visit((bounds + 1e-9 >= kth[:, None]) & (bounds > 0) & ~seen)
        flat = np.round(cosines.reshape(n_rows, -1), DECIMALS)
        out = []
        for row in flat:
            least = np.partition(row, -k)[-k] if len(row) > k else 0.0
            at = np.flatnonzero((row >= least) & (row > 0))
            at = at[np.lexsort((at, -row[at]))[:k]]
            out.append(list(zip(row[at].tolist(), at.tolist())))
        return out

    def score(self, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_rows: int) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and evidence of each of a batch's texts."""
        out = []
        for near in self.nearest(rows, terms, tf, n_rows) if len(rows) else [[]] * n_rows:
            votes, toxic = PRIOR_VOTES, PRIOR_VOTES * self.base_rate
            for cosine, i in near:
                w = 1 / (NEAR + max(0.0, 1 - cosine))
                votes += w
                toxic += w * float(self.labels[i])
            out.append((toxic / votes if near else self.empty_rate, near))
        return out

    def score_chunk(self, c, known: dict) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and evidence of a chunk's texts; ``known`` spares texts of the same words."""
        rows, terms, tf = self.counts(c)
        at = np.searchsorted(rows, np.arange(c.n + 1))
        keys = [xxhash.xxh3_128_digest(terms[at[i] : at[i + 1]].tobytes() + tf[at[i] : at[i + 1]].tobytes()) for i in range(c.n)]
        if len(known) >= 1 << 14:
            known.clear()
        new = {}
        for i, key in enumerate(keys):
            if key not in known:
                new.setdefault(key, i)
        place = np.full(c.n, -1)
        place[list(new.values())] = np.arange(len(new))
        asked = place[rows] >= 0
        known |= zip(new, self.score(place[rows[asked]], terms[asked], tf[asked], len(new)))
        return [known[key] for key in keys]


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def _fitting(found: pa.Table, drawn: list[int]) -> list[int]:
    """Places of the rows, in the order drawn, whose index stays within ``INDEX_BYTES``.

    Words are told apart by 26 bits of their hashes, which counts up to 3 % too few of
    them; ``INDEX_BYTES`` leaves more room than that.
    """
    place = {i: at for at, i in enumerate(found.column("id").to_pylist())}
    room, seen, kept = INDEX_BYTES, np.zeros(1 << 26, bool), []
    for i in drawn:
        words = found.column("terms")[place[i]].values.to_numpy().view(np.uint64) >> np.uint64(38)
        need = ROW_BYTES + PAIR_BYTES * len(words) + TERM_BYTES * (len(words) - int(seen[words].sum()))
        if need <= room:
            room -= need
            seen[words] = True
            kept.append(place[i])
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit to at most ``sample_rows`` labelled rows that aren't held out.

    Labelled ids are drawn by hash; a row that would bring the (row, word) pairs above
    ``SAMPLE_TERMS``, or the index above ``INDEX_BYTES``, is left out, and later ones that
    fit are taken.  A row with several labels counts as toxic if
    one says so, an id with several texts counts with the one of the least hash, and
    null labels are no labels.  Without labels of both kinds every score is their rate,
    0.5 without any.  Only the sample comes to the driver, as word hashes.
    """
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("_id", "_toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _lowered(b.column(2)):
                r, h = _terms(c)
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                begin = np.flatnonzero(new)
                tf = np.diff(np.append(begin, len(h)))
                at = np.searchsorted(r[begin], np.arange(c.n + 1))
                part = b.slice(c.first, c.n)
                words = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h[begin].view(np.int64)))
                times = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words, times], names=["id", "toxic", "terms", "tf"])

    counted = materialize(rows.mapInArrow(releasing(count), "id long, toxic int, terms array<long>, tf array<int>"), "toxic-sample")
    # In the order in which they were drawn, as far as their words go.
    sizes = counted.select("id", F.size("terms").alias("n")).orderBy(F.xxhash64("id"), "id").collect()  # sample_rows rows
    total, drawn = 0, []
    for r in sizes:
        if total + r["n"] <= SAMPLE_TERMS:
            total += r["n"]
            drawn.append((r["id"],))
    wanted = F.broadcast(spark.createDataFrame(drawn, "_wanted long"))
    found = counted.join(wanted, F.col("id") == F.col("_wanted"), "left_semi").toArrow()  # sample_rows rows of SAMPLE_TERMS pairs
    found = found.take(pa.array(_fitting(found, [i for (i,) in drawn]), pa.int64()))
    ids, toxic = found.column("id").to_numpy(), found.column("toxic").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    lengths = pc.list_value_length(found.column("terms")).to_numpy().astype(np.int64)
    hashes = pc.list_flatten(found.column("terms")).to_numpy().view(np.uint64)
    tf = pc.list_flatten(found.column("tf")).to_numpy().astype(np.int64)
    n, n_toxic = len(ids), int(toxic.sum())
    p = n_toxic / n if n else 0.5
    if not 0 < n_toxic < n:
        none = np.zeros(0, np.int64)
        return Model(none.astype(np.uint64), np.zeros(0), none, none, none, none, none, p, p)
    empty = lengths == 0
    empty_rate = (float(toxic[empty].sum()) + p) / (int(empty.sum()) + 1)
    number = np.full(n, -1)
    kept = order[~empty[order]]  # by id, so that the index doesn't depend on the order of arrival
    number[kept] = np.arange(len(kept))
    example = np.repeat(number, lengths)
    terms, term = np.unique(hashes, return_inverse=True)
    seen = np.bincount(term, minlength=len(terms))
    marked = np.bincount(term, np.repeat(toxic, lengths), minlength=len(terms))
    chi2 = (marked - seen * p) ** 2 / (seen * p * (1 - p))
    weight = (np.log((1 + n) / (1 + seen)) + 1) * (LEAST_WEIGHT + chi2)
    return Model(terms, weight, ids[kept], toxic[kept], example, term, tf, p, empty_rate)


def _shared(spark, model: Model):
    return broadcast_checked(spark, model, model.n_bytes, "the examples' index")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, evidence`` of every row of ``docs``, from its text alone.

    ``evidence`` lists the nearest examples (id, label, cosine).  A text without a
    word of the examples, empty and null ones too, gets the toxic rate of such
    examples and no evidence.  Texts of any length count whole, repeated rows score
    alike, an empty table gives no rows, and other columns aren't read.
    """
    shared = _shared(docs.sparkSession, model)
    kind = "array<struct<example_id:long,label:int,cosine:double>>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value.prepare(), {}
        near_type = pa.list_(pa.struct([("example_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for b in batches:
            for c in _lowered(b.column(1)):
                scored = model.score_chunk(c, known)
                nears = [[{"example_id": int(model.ids[j]), "label": int(model.labels[j]), "cosine": x} for x, j in near] for _, near in scored]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array([s for s, _ in scored], pa.float64()), pa.array(nears, near_type)], names=["doc_id", "score", "evidence"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(releasing(make), f"doc_id long, score double, evidence {kind}")
    return scored.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def reliability(scored: DataFrame, labels: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, n, mean_score, toxic_rate`` of held-out labelled rows, by tenths of the score.

    Scores are calibrated as far as ``mean_score`` and ``toxic_rate`` agree.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    rows = scored.filter(held_out()).join(known, F.col("doc_id") == F.col("_id"))
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("toxic").alias("toxic_rate")).orderBy("bin")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; the others, columns and their order stay.

    Fitted to the rows of ``docs`` that have labels.  Null and empty texts are judged as
    in :func:`score`, repeated rows alike, and an empty table stays empty.
    """
    shared = _shared(docs.sparkSession, fit(docs, labels))
    at_text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value.prepare(), {}
        for b in batches:
            for c in _lowered(b.column(at_text)):
                passed = [s < 0.5 for s, _ in model.score_chunk(c, known)]
                yield b.slice(c.first, c.n).filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(releasing(keep), docs.schema)
