"""Exact n-gram Jaccard join by set relations, and its connected components.

Sets are the distinct ``k``-word shingles of a text.  Texts with equal sets are
one node.  Candidates come from prefix lists under a global order of shingles
(rare first, by a count sketch of bounded size):

* index-level skipping: lists are cut in blocks by the size of a set and by the
  position of the list's shingle in it.  A member names only the blocks in which a
  set can leave enough later shingles for a link; the others are never met;
* answer-level skipping: each list's pivot, the set with the fewest rarer
  shingles, is compared with the list's members first.  Members it links with share
  its component, so their answers follow from the pivot's and their mutual pairs
  are never made.  For two members in different components the pivot's overlaps with
  both bound their own: what they share is in the pivot or outside it.  Only pairs
  that this bound leaves open are compared afterwards, which loses no link between
  components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_checked, hash_filter, in_filter, materialize, releasing
from .components import connected_components
from .textkernel import chunks, shingle_sets, words

SKETCH_BITS = 18
#: A list of more entries by the sketch is dealt in parts of about so many.
HOT_COUNT = 20_000
#: A component's members are dealt in so many parts when they get their smallest id.
DEALS = 32
#: Linked sets share so many shingles of prefixes that are that much longer (or all, if they need fewer).
SHARED = 4
#: Pairs of one set are compared in groups of about so many.
VERIFY_ROWS = 64


def min_overlap(a: int | np.ndarray, b: int | np.ndarray, percent: int):
    """Smallest ``o`` with ``100 o >= percent (a + b - o)``."""
    return -((-percent * (a + b)) // (100 + percent))


def _sets(batches: Iterator[pa.RecordBatch], column: int, k: int):
    for b in batches:
        for c in chunks(b.column(column)):
            hashes, offsets = shingle_sets(words(c, lower=True), c.n, k)
            yield b.slice(c.first, c.n), hashes, offsets


def shingle_sketch(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """Document counts of shingles by their top ``SKETCH_BITS`` bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, hashes, _ in _sets(batches, 0, k):
            total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["cell", "n"])

    cells = docs.select(text_col).mapInArrow(releasing(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for part in cells.toArrow().to_batches():  # at most 2**SKETCH_BITS rows
        total[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return total


def _nodes(docs: DataFrame, sketch, k: int, percent: int, text_col: str, seed: int) -> DataFrame:
    """``doc_id, text_hash, node, n, prefix, salts``; prefixes only where a task first meets a set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        met: set[int] = set()
        for part, hashes, offsets in _sets(batches, 1, k):
            nodes, checks, prefixes, salts = [], [], [], []
            cell = (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            ordered = hashes[np.lexsort((hashes, counts[cell], row))]
            for i in range(part.num_rows):
                own = hashes[offsets[i] : offsets[i + 1]]
                n = len(own)
                if not n:
                    nodes.append(None)
                    checks.append(None)
                    prefixes.append(None)
                    salts.append(None)
                    continue
                node = xxhash.xxh3_64_intdigest(own.tobytes(), seed=seed) - (1 << 63)
                nodes.append(node)
                checks.append(xxhash.xxh3_64_intdigest(own.tobytes(), seed=seed + 1) - (1 << 63))
                if node in met:
                    prefixes.append(None)
                    salts.append(None)
                    continue
                if len(met) < 1 << 20:
                    met.add(node)
                least = -(-percent * n // 100)
                head = ordered[offsets[i] : offsets[i] + n - least + min(SHARED, least)]
                prefixes.append(head.view(np.int64))
                parts = counts[(head >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // HOT_COUNT
                salts.append(np.where(parts > 0, 1 + node % (parts + 1), 0).astype(np.int32) if parts.any() else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(np.diff(offsets)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32()))],
                names=["doc_id", "text_hash", "node", "proof", "n", "prefix", "salts"],
            )

    return docs.select("doc_id", text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(releasing(make), "doc_id long, text_hash long, node long, proof long, n long, prefix array<long>, salts array<int>")


def _may_link(a_n: Column, a_pos: Column, b_n: Column, b_pos: Column, percent: int) -> Column:
    """Whether sets whose first common shingle is at these positions can still link."""
    needed = F.ceil((F.lit(percent) * (a_n + b_n)) / F.lit(float(100 + percent)) - F.lit(1e-9))
    return 1 + F.least(a_n - a_pos - 1, b_n - b_pos - 1) >= needed


def _needed(n: Column, percent: int) -> Column:
    """Least overlap of a set of ``n`` with any set it links with."""
    return F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9))


def _class_width(percent: int) -> float:
    return math.log(100 / percent) * (1 + 1e-6)  # the rounding of logarithms is well below that


def _size_class(n: Column, percent: int) -> Column:
    """A number of the set size in which linked sets differ by 1 at most."""
    return n.cast("long") if percent >= 100 else F.floor(F.log(n.cast("double")) / F.lit(_class_width(percent)))


def _position_class(pos: Column) -> Column:
    """Positions 0, 1-2, 3-6, 7-14 and so on are a class each."""
    return F.floor(F.log2(pos.cast("double") + 1.5)).cast("int")  # whole powers of two stay clear of rounding


def _open_blocks(n: Column, pos: Column, size: Column, percent: int) -> Column:
    """The ``(size, position)`` blocks of a list in which a set may link with one of ``n``
    shingles that has the list's shingle at ``pos``; sets of smaller size classes look
    for the larger."""
    blocks = []
    for step in (0, 1) if percent < 100 else (0,):
        least, most = (F.exp((size + step + more) * F.lit(_class_width(percent))) + slack if percent < 100 else n.cast("double") for more, slack in ((0, -1), (1, 1)))
        # Of sizes a and b, a link leaves at most (100 a - percent b) / (100 + percent) shingles of a before the first common one.
        own = (100 * n - percent * least) / F.lit(100.0 + percent) + 1
        other = (100 * most - percent * n) / F.lit(100.0 + percent) + 1
        classes = F.sequence(F.lit(0), _position_class(F.greatest(other, F.lit(0.0))))
        found = F.transform(classes, lambda p: F.struct((size + step).alias("size"), p.alias("place")))  # noqa: B023 (called at once)
        blocks.append(F.when((pos <= own) & (other >= 0), found).otherwise(F.slice(found, 1, 0)))
    return F.concat(*blocks)


def _sharing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose prefixes share as many shingles as linked sets must.

    The first ``SHARED`` common shingles of linked sets all lie in both prefixes;
    pairs that meet in one shingle by chance end here, before their sets are read.
    """
    heads = nodes.filter("prefix is not null").select("node", "n", "prefix").dropDuplicates(["node"])
    a, b = (heads.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("prefix").alias(f"{s}_prefix")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("_common", F.size(F.array_intersect("a_prefix", "b_prefix")))
    needed = F.least(F.lit(SHARED), _needed(F.col("a_n"), percent), _needed(F.col("b_n"), percent))
    # Of the prefix that ends first, all that isn't common is in one set only.
    beyond = F.greatest(F.col("a_n") - F.size("a_prefix"), F.col("b_n") - F.size("b_prefix"))
    whole = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / F.lit(float(100 + percent)) - F.lit(1e-9))
    return both.filter((F.col("_common") >= needed) & (F.col("_common") + beyond >= whole)).select("a", "b")


def _candidate_sets(docs: DataFrame, candidates: DataFrame, k: int, text_col: str, seed: int) -> DataFrame:
    """``node, set`` for the candidates, read in one pass that skips other texts.

    What the filter lets through besides is dropped by the join that follows.
    """
    shared = hash_filter(candidates.select("node"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        met: set[int] = set()
        for part, hashes, offsets in _sets(batches, 0, k):
            nodes, sets = [], []
            own_sets = [hashes[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.num_rows)]
            numbers = np.array([xxhash.xxh3_64_intdigest(own, seed=seed) - (1 << 63) for own in own_sets], np.int64)
            for i in np.flatnonzero(in_filter(mask, numbers)).tolist():
                node = int(numbers[i])
                if node in met:
                    continue
                if len(met) < 1 << 20:
                    met.add(node)
                nodes.append(node)
                sets.append(own_sets[i])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    return docs.select(text_col).mapInArrow(releasing(make), "node long, set binary").dropDuplicates(["node"])


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, text_col: str, seed: int) -> DataFrame:
    """``a, b, common, linked`` of the pairs: how many shingles they share, and whether
    they link; exact on the whole sets.

    Pairs of one ``a`` go to groups of about ``VERIFY_ROWS``, each with ``a``'s set.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("_n"))
    dealt = pairs.join(sizes, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / VERIFY_ROWS)).cast("int")).drop("_n")
    heads = dealt.select(F.col("a").alias("node"), "a", "slot", F.lit(True).alias("head")).distinct()
    asked = materialize(heads.unionByName(dealt.select(F.col("b").alias("node"), "a", "slot", F.lit(False).alias("head"))), "jaccard-asked")
    sets = _candidate_sets(docs, asked.select("node").distinct(), k, text_col, seed)

    def overlap(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        is_head = pdf["head"].to_numpy(bool)
        head = np.frombuffer(pdf.loc[is_head, "set"].iloc[0], np.uint64)
        kept = []
        for b, raw in zip(pdf.loc[~is_head, "node"], pdf.loc[~is_head, "set"]):
            other = np.frombuffer(raw, np.uint64)
            at = np.searchsorted(head, other)
            at[at == len(head)] = 0
            common = int((head[at] == other).sum())
            kept.append((int(key[0]), int(b), common, 100 * common >= percent * (len(head) + len(other) - common)))
        return pd.DataFrame(kept, columns=["a", "b", "common", "linked"])

    return asked.join(sets, "node").groupBy("a", "slot").applyInPandas(overlap, "a long, b long, common long, linked boolean")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, node, component_id, component, text_hash`` for every row of ``docs``.

    Texts are split into words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; two link
    when ``100 * intersection >= percent * union`` of their shingle sets.  A text of
    1 to ``k-1`` words has its whole sequence as its one shingle; a null text or one
    without words has no set, links with nothing and is its own component.
    ``component_id`` is the smallest id reachable by links.  Repeated rows share
    their set and so their component; null ids are left out of the minimum, and a
    component without ids has a null id.  ``component`` tells components apart where
    ids repeat or are missing (null without words).  An empty table gives no rows, and other
    columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = shingle_sketch(docs, k)
    sketch = broadcast_checked(spark, counts, counts.nbytes, "the shingle sketch")
    seed = 0
    while True:  # node numbers are 64-bit hashes of sets; another seed if two sets share one
        nodes = materialize(_nodes(docs, sketch, k, percent, "text", seed), "jaccard-nodes")
        if nodes.groupBy("node").agg((F.min("proof") != F.max("proof")).alias("shared")).filter("shared").isEmpty():
            break
        seed += 2

    entries = nodes.filter("prefix is not null").select("node", "n", "salts", F.posexplode("prefix").alias("pos", "token"))
    entries = entries.filter(F.col("pos") < F.col("n") - _needed(F.col("n"), percent) + 1).select("token", "node", "n", F.col("pos").cast("long").alias("pos"), F.coalesce(F.get("salts", F.col("pos")), F.lit(0)).alias("salt"))
    by_list = W.partitionBy("token", "salt")
    listed = (
        entries.withColumn("pivot", F.min(F.struct("pos", "node", "n")).over(by_list))
        .withColumn("_alone", (F.min("node").over(by_list) == F.max("node").over(by_list)) & (F.col("salt") == 0))
        .filter("not _alone")
        .drop("_alone")
    )
    listed = materialize(listed, "jaccard-lists")
    # A dealt list's pivots are compared with one another in a second level.
    heads = listed.filter("salt > 0").groupBy("token", "salt").agg(F.min("pivot").alias("h")).select("token", "h.pos", "h.node", "h.n")
    heads = heads.withColumn("pivot", F.min(F.struct("pos", "node", "n")).over(W.partitionBy("token")))
    to_pivot = listed.select("node", "n", "pos", "pivot").unionByName(heads.select("node", "n", "pos", "pivot"))
    pairs = (
        to_pivot.filter(F.col("node") != F.col("pivot.node"))
        .filter(_may_link(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos"), percent))
        .select(F.least("node", "pivot.node").alias("lo"), F.greatest("node", "pivot.node").alias("hi"), F.col("pivot.node").alias("a"), F.col("node").alias("b"))
        .groupBy("lo", "hi")
        .agg(F.min("a").alias("a"))
        .select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
    )
    pairs = materialize(pairs, "jaccard-pairs")
    close = materialize(_sharing(pairs, nodes, percent), "jaccard-close")
    answers = materialize(_verify(close, docs, k, percent, "text", seed), "jaccard-links")
    links = answers.filter("linked").select("a", "b")
    labels = connected_components(links)

    # Pairs of list members in different components; members of one need no answer.
    member = listed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = member.groupBy("token").agg((F.min("component") != F.max("component")).alias("mixed")).filter("mixed").select("token")
    member = member.join(mixed, "token", "left_semi").select("token", "node", "n", "pos", "component", F.col("pivot.node").alias("pivot"))
    # What each has in common with its list's pivot, where that was computed.
    known = answers.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi"), F.col("common").alias("shared"))
    member = member.join(known, (F.least("node", "pivot") == F.col("_lo")) & (F.greatest("node", "pivot") == F.col("_hi")), "left").drop("_lo", "_hi")
    member = member.withColumn("shared", F.when(F.col("node") == F.col("pivot"), F.col("n")).otherwise(F.col("shared")))
    member = member.withColumn("size", _size_class(F.col("n"), percent)).withColumn("place", _position_class(F.col("pos")))
    member = materialize(member, "jaccard-rest")
    x, y = (member.select(*(F.col(c).alias(f"{side}_{c}") for c in member.columns)) for side in "xy")
    x = x.withColumn("block", F.explode(_open_blocks(F.col("x_n"), F.col("x_pos"), F.col("x_size"), percent)))
    once = (F.col("x_size") < F.col("y_size")) | (F.col("x_node") < F.col("y_node"))
    # Common shingles are among those that both share with the pivot, or outside it for both.
    most = F.least("x_shared", "y_shared") + F.least(F.col("x_n") - F.col("x_shared"), F.col("y_n") - F.col("y_shared"))
    needed = F.ceil(percent * (F.col("x_n") + F.col("y_n")) / F.lit(float(100 + percent)) - F.lit(1e-9))
    open_ = F.coalesce((F.col("x_pivot") != F.col("y_pivot")) | (most >= needed), F.lit(True))
    met = (F.col("x_token") == F.col("y_token")) & (F.col("block.size") == F.col("y_size")) & (F.col("block.place") == F.col("y_place"))
    rest = (
        x.join(y, met & once & (F.col("x_component") != F.col("y_component")) & open_ & _may_link(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos"), percent))
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
        .distinct()
    )
    seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(_sharing(rest.join(seen, ["a", "b"], "left_anti"), nodes, percent), "jaccard-rest-pairs")
    if not rest.isEmpty():
        more = materialize(_verify(rest, docs, k, percent, "text", seed).filter("linked").select("a", "b"), "jaccard-rest-links")
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))

    classes = nodes.groupBy("node").agg(F.min("doc_id").alias("first_id")).filter("node is not null")
    # Large components are dealt in parts: each part that exists gets the component's answer.
    classes = materialize(classes.join(labels, "node", "left").withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(DEALS)).cast("int")), "jaccard-members")
    linked = classes.filter("component is not null")
    least = linked.groupBy("component", "deal").agg(F.min("first_id").alias("first_id"))
    least = least.groupBy("component").agg(F.min("first_id").alias("component_id"), F.collect_list("deal").alias("deals")).select("component", "component_id", F.explode("deals").alias("deal"))
    alone = classes.filter("component is null").select("node", F.col("first_id").alias("component_id"), F.col("node").alias("component"))
    classes = linked.join(least, ["component", "deal"]).select("node", "component_id", "component").unionByName(alone)
    classes = materialize(classes.withColumnRenamed("node", "_node"), "jaccard-classes")
    out = nodes.select("doc_id", F.col("n").alias("n_shingles"), "node", "text_hash").join(classes, F.col("node") == F.col("_node"), "left").drop("_node")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "node", "component_id", "component", "text_hash")
