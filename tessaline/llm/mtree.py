"""Exact top-k inner product by best-first search in stored M-trees.

Integer vectors get one more component that makes all lengths of a tree equal, so
that a larger inner product is a smaller Euclidean distance.  Rows are dealt to the
nearest of some routing vectors, and every ``TREE_ROWS`` of them become one paged
M-tree: nodes carry a routing vector, covering radius and the distance to their
parent's routing vector, pages the distances of their members to the page's.  Trees
are built once and stored, with their roots' vectors and radii in columns.

A query is routed by the roots' bounds: it searches the tree with the best bound
first, and then only the trees whose bound reaches its k-th score.  Rows aren't
copied for that; a stored tree goes to its queries, once for every
``QUERY_ROWS`` of them.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_checked, materialize, releasing

PAGE = 64
FAN_OUT = 16
TREE_ROWS = 8_192
QUERY_ROWS = 65_536
#: So many rows, drawn by hash, are the routing vectors by which rows are dealt to trees.
ROUTES = 64
#: Roots that one broadcast holds; with more trees, queries are routed in several rounds.
ROOT_BYTES = 32 << 20
SCALE = 256


#: Squared lengths of scaled vectors, and so their scores, go up to this.
LONGEST2 = 2.0**61


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: components x as ``floor(256 x)``; vectors null or with null or
    non-finite components take no part, nor do rows without an id.  A vector whose squared
    length exceeds ``LONGEST2`` is an error: its scores wouldn't fit 64 bits."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("_x")).filter(F.col("vec_id").isNotNull() & F.col("_x").isNotNull())
    length2 = F.aggregate("_x", F.lit(0.0), lambda total, x: total + x * SCALE * x * SCALE)
    too_long = F.raise_error(F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" is too long for scores of 64 bits")))
    kept = rows.filter(~bad).withColumn("_x", F.when(length2 > LONGEST2, too_long).otherwise(F.col("_x")))
    return kept.select("vec_id", F.transform("_x", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _slice(first: int, last: int, wanted: np.ndarray):
    """The wanted numbers from ``first`` to ``last``; a slice if they are all."""
    n = np.count_nonzero(wanted)
    return slice(first, last) if n == last - first else first + np.flatnonzero(wanted)


class MTree:
    """A bulk-built M-tree over rows of integer vectors of one length.

    ``rows`` tells rows apart, ``ids`` are what a result names; a query leaves out
    its own row.  ``members`` and ``routed`` count distances computed to members and
    to routing vectors.
    """

    _stored = ("ids", "rows", "x", "y", "top2", "centre", "radius", "parent_distance", "child", "span", "member_distance")

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.x = x
        length2 = (x * x).sum(axis=1)
        self.top2 = np.int64(length2.max(initial=0))
        # The completed vectors, in floats: bounds allow for rounding, scores are integers.
        self.y = np.concatenate([x, np.sqrt((self.top2 - length2).astype(float))[:, None]], axis=1).astype(float)
        self.centre, self.radius, self.parent_distance, self.child, self.span, distances = [], [], [], [], [], []
        order, pending = [], []
        if len(ids):
            self._node(np.arange(len(ids)), None)
            pending.append((0, np.arange(len(ids))))
        while pending:  # children of a node get consecutive numbers
            node, own = pending.pop()
            distance = self._distances(own, self.centre[node])
            if len(own) <= PAGE or distance.max() == 0:
                begin = sum(map(len, order))
                self.span[node] = (begin, begin + len(own))
                order.append(own)
                distances.append(distance)
                continue
            parts = self._split(own)
            self.child[node] = (len(self.centre), len(self.centre) + len(parts))
            for part in parts:
                pending.append((len(self.centre), part))
                self._node(part, self.centre[node])
        flat = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.rows, self.x, self.y = ids[flat], rows[flat], self.x[flat], self.y[flat]
        self.member_distance = np.concatenate(distances) if distances else np.zeros(0)
        self.centre, self.radius, self.parent_distance = (np.array(a, float) for a in (self.centre, self.radius, self.parent_distance))
        self.child, self.span = (np.array(a, np.int64).reshape(-1, 2) for a in (self.child, self.span))
        self._ready()

    def _ready(self) -> None:
        # Inner products of small integers are exact in floats, which multiply faster.
        self.exact = np.ascontiguousarray(self.y[:, :-1])
        self.centre2 = (self.centre * self.centre).sum(axis=1)
        self.inner = np.ascontiguousarray(self.centre[:, :-1])
        self.largest = int(np.abs(self.x).max(initial=0))
        self.members = self.routed = 0

    def _distances(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        d = self.y[rows] - centre
        return np.sqrt((d * d).sum(axis=1))

    def _node(self, own: np.ndarray, parent: np.ndarray | None) -> None:
        mean = self.y[own].mean(axis=0)
        centre = self.y[own[self._distances(own, mean).argmin()]]
        self.centre.append(centre)
        self.radius.append(float(self._distances(own, centre).max()))
        self.parent_distance.append(0.0 if parent is None else float(np.sqrt(((centre - parent) ** 2).sum())))
        self.child.append((0, 0))
        self.span.append((0, 0))

    def _split(self, own: np.ndarray) -> list[np.ndarray]:
        """Rows by the nearest of up to ``FAN_OUT`` of them, which about half fills the pages;
        rows that can't be parted so are halved."""
        fan = min(FAN_OUT, -(-2 * len(own) // PAGE))
        drawn = self.y[own[np.linspace(0, len(own) - 1, fan).astype(np.int64)]]
        which = ((drawn * drawn).sum(axis=1) - 2.0 * (self.y[own] @ drawn.T)).argmin(axis=1)
        parts = [own[which == i] for i in np.unique(which)]
        return parts if len(parts) > 1 else [own[: len(own) // 2], own[len(own) // 2 :]]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self._stored if name != "y"})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> MTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as stored:
            for name in stored.files:
                setattr(tree, name, stored[name])
        length2 = (tree.x * tree.x).sum(axis=1)
        tree.y = np.concatenate([tree.x, np.sqrt((tree.top2 - length2).astype(float))[:, None]], axis=1).astype(float)
        tree._ready()
        return tree

    def search(self, q: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) for ``q`` without the row ``own``; ties to the smaller id.

        Scores below ``floor`` aren't wanted.
        """
        if not len(self.ids):
            return []
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        q2 = int((q * q).sum())
        exact = q.astype(float)
        offset = float(q2 + int(self.top2))  # distance**2 = offset - 2 * score
        small = self.largest * int(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**50
        slack = 1e-6 * (1.0 + offset**0.5)

        def reach() -> float:
            least = best[0][0] if len(best) == k else floor
            return max(0.0, offset - 2.0 * least) ** 0.5 + slack

        d = float(np.sqrt(((np.append(exact, 0.0) - self.centre[0]) ** 2).sum()))
        self.routed += 1
        queue = [(max(0.0, d - self.radius[0]), 0, d)]
        limit = reach()
        while queue:
            bound, node, d = heapq.heappop(queue)
            if bound > limit:
                break
            first, last = self.child[node]
            if last:
                # The stored parent distances may spare the distances to children.
                at = _slice(first, last, np.abs(self.parent_distance[first:last] - d) <= self.radius[first:last] + limit)
                dc = np.sqrt(np.maximum(0.0, self.centre2[at] + q2 - 2.0 * (self.inner[at] @ exact)))
                self.routed += len(dc)
                low = np.maximum(dc - self.radius[at], bound)
                for i, far, node in zip(low.tolist(), dc.tolist(), at.tolist() if isinstance(at, np.ndarray) else range(first, last)):
                    if i <= limit:
                        heapq.heappush(queue, (i, node, far))
                continue
            first, last = self.span[node]
            at = _slice(first, last, np.abs(self.member_distance[first:last] - d) <= limit)
            scores = self.exact[at] @ exact if small else self.x[at] @ q
            self.members += len(scores)
            least = best[0][0] if len(best) == k else floor
            if not len(scores) or scores.max() < least:
                continue
            if len(scores) > k + 1:  # of a page at most k and the query's own row can count, and what ties with them
                least = max(least, np.partition(scores, -k - 1)[-k - 1])
            hopeful = np.flatnonzero(scores >= least)
            for score, i, row in zip(scores[hopeful].tolist(), self.ids[at][hopeful].tolist(), self.rows[at][hopeful].tolist()):
                score = int(score)
                if row == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            limit = reach()
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def build_trees(rows: DataFrame) -> DataFrame:
    """``tree, dims, top2, centre, radius, stored`` of M-trees over ``row, vec_id, v, dims``.

    Every row is in one tree, with others of its length.
    """
    spark = rows.sparkSession
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(ROUTES).select("dims", "v").collect()  # ROUTES rows
    routes = {}
    for r in drawn:
        routes.setdefault(r["dims"], []).append(r["v"])
    routes = {dims: np.array(v, float).reshape(len(v), dims) for dims, v in routes.items()}
    shared = broadcast_checked(spark, routes, sum(v.nbytes for v in routes.values()), "the routing vectors")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            where = np.zeros(len(pdf), np.int32)
            for dims, at in pdf.groupby("dims").indices.items():
                centres = shared.value.get(dims)
                if centres is None or not dims:
                    continue
                x = np.stack(pdf["v"].to_numpy()[at]).astype(float)
                where[at] = ((centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)).argmin(axis=1)
            yield pdf.assign(route=where)

    dealt = materialize(rows.mapInPandas(route, "row long, vec_id long, v array<long>, dims int, route int"), "mtree-dealt")
    counts = dealt.groupBy("dims", "route").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / TREE_ROWS)).select(F.col("dims").alias("_d"), F.col("route").alias("_r"), "parts")
    dealt = dealt.join(F.broadcast(counts), (F.col("dims") == F.col("_d")) & (F.col("route") == F.col("_r")))  # ROUTES rows for each length
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("_d", "_r", "parts")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        tree = MTree(pdf["vec_id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64), x)
        first = pdf.iloc[0]
        return pd.DataFrame([(first["dims"], first["route"], first["part"], int(tree.top2), tree.centre[0], float(tree.radius[0]), tree.to_bytes())], columns=["dims", "route", "part", "top2", "centre", "radius", "stored"])

    built = dealt.groupBy("dims", "route", "part").applyInPandas(build, "dims int, route int, part long, top2 long, centre array<double>, radius double, stored binary")
    return materialize(built.select(F.monotonically_increasing_id().alias("tree"), "dims", "top2", "centre", "radius", "stored"), "mtree-trees")


def _routed(queries: DataFrame, trees: DataFrame, best_only: bool) -> DataFrame:
    """``row, tree, bound`` of the trees that may hold scores of at least a query's ``floor``;
    of those only the one with the best bound where ``best_only``."""
    spark = trees.sparkSession
    found, roots, size = None, [], 0

    def round_of(roots: list) -> DataFrame:
        by_dims = {}
        for r in roots:
            by_dims.setdefault(r["dims"], []).append(r)
        packed = {
            d: (np.array([r["tree"] for r in rs], np.int64), np.array([r["centre"] for r in rs], float), np.array([r["radius"] for r in rs]), np.array([r["top2"] for r in rs], float))
            for d, rs in by_dims.items()
        }
        shared = broadcast_checked(spark, packed, sum(a.nbytes for p in packed.values() for a in p), "the trees' roots")

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row, v, dims, floor in zip(pdf["row"], pdf["v"], pdf["dims"], pdf["floor"]):
                    if dims not in shared.value:
                        continue
                    tree, centre, radius, top2 = shared.value[dims]
                    q = np.append(np.asarray(v, float), 0.0)
                    away = q - centre
                    low = np.maximum(0.0, np.sqrt(np.einsum("ij,ij->i", away, away)) - radius)
                    offset = float(q @ q) + top2
                    score = (offset - low * low) / 2 + 1e-6 * (1.0 + offset)
                    at = [int(score.argmax())] if best_only else np.flatnonzero(score >= floor)
                    out += [(row, int(tree[i]), float(score[i])) for i in at]
                yield pd.DataFrame(out, columns=["row", "tree", "bound"])

        return queries.select("row", "v", "dims", F.col("floor").cast("double")).mapInPandas(bound, "row long, tree long, bound double")

    for r in trees.select("tree", "dims", "top2", "centre", "radius").toLocalIterator():  # one broadcast's roots at a time
        roots.append(r)
        size += 8 * (len(r["centre"]) + 3)
        if size >= ROOT_BYTES:
            part, roots, size = round_of(roots), [], 0
            found = part if found is None else found.unionByName(part)
    if roots or found is None:
        part = round_of(roots)
        found = part if found is None else found.unionByName(part)
    if best_only:
        found = found.groupBy("row").agg(F.max_by(F.struct("tree", "bound"), F.struct("bound", -F.col("tree"))).alias("b")).select("row", "b.tree", "b.bound")
    return found


def _search(asked: DataFrame, queries: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """``row, vec_id, score``: the k best of each asked tree for each query that asks it."""
    asked = asked.select("tree", F.col("row").alias("_row")).join(queries.select("row", "v", "floor"), F.col("row") == F.col("_row"))
    blocks = asked.groupBy("tree").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks")).select(F.col("tree").alias("_tree"), "blocks")
    stored = trees.join(blocks, F.col("tree") == F.col("_tree")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    stored = stored.select("tree", "block", F.lit(None).cast("long").alias("row"), F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast("double").alias("floor"), "stored")
    asked = asked.join(blocks, F.col("tree") == F.col("_tree")).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    asked = asked.select("tree", "block", "row", "v", F.col("floor").cast("double").alias("floor"), F.lit(None).cast("binary").alias("stored"))
    # A tree comes before its queries, which then stream past it.
    dealt = stored.unionByName(asked).repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("row").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            out = []
            for row, v, floor, raw in zip(*(b.column(name).to_pylist() for name in ("row", "v", "floor")), b.column("stored")):
                if row is None:
                    tree = MTree.from_bytes(raw.as_py())
                    continue
                out += [(row, i, s) for s, i in tree.search(np.array(v, np.int64), row, k, -np.inf if floor is None else floor)]
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["row", "vec_id", "score"])

    return dealt.mapInArrow(releasing(search), "row long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k largest integer inner products.

    ``vectors`` is :func:`quantized`; ``is_query`` a condition on ``vec_id``.  All rows
    but the query's own are candidates, ties go to the smaller id, and a query with
    fewer candidates returns all.  Vectors of another length than the query's take no
    part in its search; vectors without components score 0.  Rows that repeat an id,
    or a whole row, are rows of their own, as queries and as candidates.  An empty
    table gives no rows.
    """
    rows = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dims")), "mtree-rows")
    trees = build_trees(rows)
    queries = rows.filter(is_query).select("row", F.col("vec_id").alias("query_id"), "v", "dims", F.lit(None).cast("long").alias("floor"))
    near = materialize(_routed(queries, trees, best_only=True), "mtree-near")
    first = materialize(_search(near, queries, trees, k), "mtree-first")
    scores = first.groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = queries.drop("floor").join(scores, F.col("row") == F.col("_row"), "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least"))).drop("_row", "n", "least")
    known = materialize(known, "mtree-known")
    every = known.withColumn("floor", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))))
    asked = _routed(every, trees, best_only=False).join(near.select(F.col("row").alias("_row"), F.col("tree").alias("_tree")), (F.col("row") == F.col("_row")) & (F.col("tree") == F.col("_tree")), "left_anti")
    more = _search(materialize(asked, "mtree-asked"), known, trees, k)
    found = first.unionByName(more).join(known.select(F.col("row").alias("_row"), "query_id"), F.col("row") == F.col("_row"))
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
