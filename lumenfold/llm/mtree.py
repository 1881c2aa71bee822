"""Exact top-k by inner product: best-first search in M-trees.

Vectors are dealt into blocks of bounded size and each block becomes an M-tree: pages of entries, each with an object, its distance to the
page's own routing object and, in inner pages, the radius that covers everything below.  An extra coordinate gives all vectors of a block the same length, so the largest inner
products are the smallest distances.  A search opens the page of the least bound next, until that bound is
beyond the k-th distance, and skips entries whose stored distance to the routing object already rules them out.

Queries are searched in groups, each group in each block by a task of its own; only k rows for each query and block leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, small_batches, written

#: Vectors in a block, entries in a leaf page and in an inner page, queries searched together.
BLOCK, LEAF, FANOUT, QUERIES = 16_384, 256, 8, 1_024
PAGES = T.StructType(
    [
        T.StructField("dim", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("leaf", T.BooleanType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("vectors", T.BinaryType()),
        T.StructField("extra", T.BinaryType()),
        T.StructField("to_parent", T.BinaryType()),
        T.StructField("radius", T.BinaryType()),
        T.StructField("child", T.BinaryType()),
        T.StructField("length2", T.DoubleType()),
    ]
)
#: Distances are sums of rounded numbers; a bound must be beaten by more than this share.
SLACK = 1e-9


class Tree:
    """An M-tree over integer vectors, as a list of pages; page 0 is the root."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.length2 = float(squares.max(initial=0))
        extra = np.sqrt(np.maximum(self.length2 - squares, 0))
        self._all = np.hstack((vectors, extra[:, None]))
        self.ids, self.vectors, self.extra, self.pages = ids, vectors, extra, []
        self._rng = np.random.default_rng(len(ids))
        self._grow(np.arange(len(ids)), None)

    def _distance(self, rows: np.ndarray, to: int | None) -> np.ndarray:
        if to is None:
            return np.zeros(len(rows))
        gap = self._all[rows] - self._all[to]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _grow(self, rows: np.ndarray, parent: int | None) -> int:
        number = len(self.pages)
        self.pages.append(None)
        if len(rows) <= LEAF:
            self.pages[number] = (True, rows, self._distance(rows, parent), np.zeros(0), np.zeros(0, np.int32))
            return number
        seeds = self._rng.choice(rows, FANOUT, replace=False)
        a, b = self._all[rows], self._all[seeds]
        near = np.argmin(np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T, axis=1)
        if np.bincount(near, minlength=FANOUT).max() > 0.9 * len(rows):  # mostly equal objects: any split is as good
            near = np.arange(len(rows)) * FANOUT // len(rows)
            seeds = rows[np.searchsorted(near, np.arange(FANOUT))]
        entries = []
        for k in range(FANOUT):
            own = rows[near == k]
            if len(own):
                entries.append((int(seeds[k]), float(self._distance(own, int(seeds[k])).max()), self._grow(own, int(seeds[k]))))
        objects = np.array([x[0] for x in entries])
        self.pages[number] = (False, objects, self._distance(objects, parent), np.array([x[1] for x in entries]), np.array([x[2] for x in entries], dtype=np.int32))
        return number

    def rows(self, dim: int, block: int) -> pa.RecordBatch:
        out = []
        for number, (leaf, at, to_parent, radius, child) in enumerate(self.pages):
            out.append((dim, block, number, leaf, self.ids[at].astype("<i8").tobytes(), self.vectors[at].astype("<f8").tobytes(), self.extra[at].tobytes(), to_parent.tobytes(), radius.tobytes(), child.tobytes(), self.length2))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 6, pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=PAGES.names)


class Pages:
    """A tree as read from its page rows."""

    def __init__(self, dim: int, rows: pd.DataFrame):
        self.length2 = float(rows["length2"].iloc[0])
        # every partial sum of a product is at most the greatest squared length: exact in single precision up to 2**24
        self._kind = np.float32 if self.length2 < 1 << 24 else np.float64
        self._pages = {}
        self.computed = 0  # inner products so far
        for x in rows.itertuples(index=False):
            get = lambda data, kind: np.frombuffer(data, dtype=kind)
            self._pages[x.page] = (x.leaf, get(x.ids, "<i8"), get(x.vectors, "<f8").reshape(-1, dim).astype(self._kind), get(x.to_parent, "<f8"), get(x.radius, "<f8"), get(x.child, "<i4"))

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k largest inner products, ties to the smaller id, without the query's own id."""
        base = float(query @ query) + self.length2
        kind = self._kind if float(query @ query) < 1 << 24 else np.float64
        query = query.astype(kind)
        ids, best = np.zeros(0, np.int64), np.zeros(0)
        limit = np.inf
        queue = [(0.0, 0, None)]  # bound, page, distance to its routing object
        while queue:
            bound, number, to_routing = heapq.heappop(queue)
            if bound > limit:
                break
            leaf, names, vectors, to_parent, radius, child = self._pages[number]
            reach = limit if leaf else limit + radius
            if to_routing is not None:
                open_ = np.abs(to_routing - to_parent) <= reach
                if not open_.all():
                    if leaf:
                        names, vectors = names[open_], vectors[open_]
                    else:
                        vectors, radius, child = vectors[open_], radius[open_], child[open_]
            if not len(vectors):
                continue
            self.computed += len(vectors)
            products = (vectors if vectors.dtype == kind else vectors.astype(kind)) @ query
            if leaf:
                if own is not None:
                    other = names != own
                    names, products = names[other], products[other]
                if len(best) >= k:
                    better = products >= best[-1]
                    names, products = names[better], products[better]
                if not len(names):
                    continue
                ids, best = np.concatenate((ids, names)), np.concatenate((best, products))
                order = np.lexsort((ids, -best))[:k]
                ids, best = ids[order], best[order]
                if len(best) >= k:
                    limit = np.sqrt(max(base - 2 * float(best[-1]), 0.0)) * (1 + SLACK) + 1e-6
            else:
                away = np.sqrt(np.maximum(base - 2 * products.astype(float), 0))
                for d, r, page in zip(away.tolist(), radius.tolist(), child.tolist(), strict=True):
                    low = max(d - r, 0.0) * (1 - SLACK) - 1e-6
                    if low <= limit:
                        heapq.heappush(queue, (low, page, d))
        return ids, best


def quantised(column: str | Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector or any component is null or not finite."""
    v = F.col(column) if isinstance(column, str) else column
    wide = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(wide, lambda x: F.floor(x * scale).cast("double")))


def build(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """The pages of the M-trees of all vectors (arrays of whole numbers; null vectors and ids are left out), as a written table.

    Only vectors of one dimension share a tree.  Blocks hold ``BLOCK`` vectors on average, by a hash of the id.
    """
    small_batches(vectors.sparkSession, 10_000)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v"))
    blocks = rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"key": None, "ids": [], "vectors": []}

        def grown() -> pa.RecordBatch:
            return Tree(np.array(held["ids"], dtype=np.int64), np.array(held["vectors"], dtype=float)).rows(*held["key"])

        for batch in batches:
            for dim, block, name, vector in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (dim, block) != held["key"]:
                    if held["ids"]:
                        yield grown()
                    held.update(key=(dim, block), ids=[], vectors=[])
                held["ids"].append(name)
                held["vectors"].append(vector)
        if held["ids"]:
            yield grown()

    return written(dealt.select("dim", "block", "id", "v").repartition("dim", "block").sortWithinPartitions("dim", "block", "id").mapInArrow(run, PAGES), "mtree")


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def search(pages: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of every query with rows of other ids, ties to the smaller id.

    Queries with a null id or vector have no rows, and neither have those of a dimension that no tree has.  Queries that repeat an
    id must have the same vector.  Fewer rows than k give all.
    """
    asked = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).alias("q")).where("qid is not null and q is not null").dropDuplicates(["qid"]).withColumn("dim", F.size("q"))
    asked = checkpointed(asked)
    groups = max(1, -(-asked.count() // QUERIES))
    trees = pages.select(*[F.col(c).alias(c) for c in ("dim", "block")]).distinct()
    to = asked.withColumn("group", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int")).join(trees, "dim")
    of = pages.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).drop("extra")
    keys = ["dim", "block", "group"]

    def find(tree: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(some):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        read, out = Pages(int(tree["dim"].iloc[0]), tree), []
        for qid, query in zip(some["qid"].tolist(), some["q"], strict=True):
            ids, best = read.search(qid, np.asarray(query, dtype=float), k)
            out.append(pd.DataFrame({"query_id": np.full(len(ids), qid, dtype=np.int64), "vec_id": ids, "score": best.astype(np.int64)}))
        return pd.concat(out)

    found = of.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInPandas(find, FOUND)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
