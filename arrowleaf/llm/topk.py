"""Exact top-k by integer inner product: norm-sorted blocks and SVD-rotated partial sums.

Vectors x become floor(scale * x).  Candidates are range-partitioned and sorted by descending length
and read in blocks.  All are rotated by the singular vectors of the whole set (from its 64 x 64 Gram
matrix), so that the first coordinates carry most of a product; the rest is bounded by the
Cauchy-Schwarz product of the residual lengths.  A block is skipped for queries whose k-th score
exceeds |q| max|x|, and a pair is dropped when its partial sum plus that bound stays below the k-th
score.  What is left is computed exactly from the integers.  First scores from the block of longest
vectors give each query a threshold from the start.

Queries go in groups of at most ``group`` (a proven broadcast bound), each against all rows.

Defined cases: null vectors, null or non-finite components, null ids and vectors of another length
than the most common take no part; ties go to the smaller id; a query's own id is never a candidate;
repeated rows are candidates each, and as a query an
id of several rows takes its smallest vector; fewer candidates than k give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<int>, norm) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("long")).alias("v"))
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    good = good.where(F.size("v") == (size["d"] if size else 0))
    return good.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(n, -1)


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, by falling singular value."""

    def run(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), b.num_rows)
            g += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(dim * dim), pa.int32()), "g": pa.array(g.ravel())})

    got = vectors.select("v").mapInArrow(run, "cell int, g double").groupBy("cell").agg(F.sum("g").alias("g")).orderBy("cell").toPandas()
    return np.linalg.eigh(got["g"].to_numpy().reshape(dim, dim))[1][:, ::-1].copy()


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: higher score first, then smaller id."""
    order = np.lexsort((ids, -score, q))
    first = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


class Search:
    """A group of queries with their running k best."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, dims: int):
        self.ids, self.x, self.k, self.dims = ids, x, k, dims
        self.rotation = rotation
        y = x @ rotation
        self.head, self.tail = y[:, :dims], np.linalg.norm(y[:, dims:], axis=1)
        self.norm = np.linalg.norm(x, axis=1)
        self.least = np.full(len(ids), -np.inf)  # a score that k candidates reach
        self.found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]

    def feed(self, ids: np.ndarray, x: np.ndarray, step: int = 1024) -> None:
        y = x @ self.rotation
        head, tail, longest = y[:, : self.dims], np.linalg.norm(y[:, self.dims :], axis=1), np.linalg.norm(x, axis=1).max()
        live = np.flatnonzero(self.norm * longest + 1e-6 >= self.least)
        got: list[tuple] = []
        for at in range(0, len(live), step):
            q = live[at : at + step]
            bound = self.head[q] @ head.T
            bound += np.outer(self.tail[q], tail)
            bound += 1e-6
            r, c = np.nonzero(bound >= self.least[q][:, None])
            if len(r) > 0.05 * len(q) * len(ids):
                exact = self.x[q] @ x.T
                r, c = np.nonzero(exact >= self.least[q][:, None])
                s = exact[r, c]
            else:
                s = np.einsum("ij,ij->i", self.x[q[r]], x[c])
            keep = (s >= self.least[q[r]]) & (self.ids[q[r]] != ids[c])
            got.append((q[r[keep]], s[keep], ids[c[keep]]))
        if got:
            q, s, i = (np.concatenate([a, *b]) for a, b in zip(self.found, zip(*got, strict=True), strict=True))
            best = _best(q, s, i, self.k)
            self.found = [q[best], s[best], i[best]]
            n = np.bincount(self.found[0], minlength=len(self.ids))
            last = np.full(len(self.ids), np.inf)
            np.minimum.at(last, self.found[0], self.found[1])
            self.least = np.where(n >= self.k, np.maximum(self.least, last), self.least)


def search(rows: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, dims: int = 48, group: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that ``queries`` selects."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = integer_vectors(rows, id_col, vec_col, scale)
    v = materialise(v.repartitionByRange(parts, F.col("norm").desc(), F.xxhash64("vec_id")).sortWithinPartitions(F.col("norm").desc()), "vectors")
    empty = "query_id long, rank int, vec_id long, score long"
    lead = v.orderBy(F.col("norm").desc(), "vec_id").limit(2048).toArrow()
    if not lead.num_rows:
        return spark.createDataFrame([], empty)
    dim = len(lead.column("v")[0])
    rotation = _rotation(v, dim)
    dims = min(dims, dim)
    asked = v.where(queries(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(1, -(-asked.count() // group))
    asked = materialise(asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups))), "queries")
    flat = lambda t: (t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks(), t.num_rows))
    result = None
    for g in range(groups):
        ids, x = flat(asked.where(F.col("g") == g).orderBy("vec_id").toArrow())
        if not len(ids):
            continue
        start = Search(ids, x, rotation, k, dims)
        start.feed(*flat(lead))
        shared = spark.sparkContext.broadcast((ids, x, rotation, start.least))

        def run(batches, shared=shared):
            ids, x, rotation, least = shared.value
            s = Search(ids, x, rotation, k, dims)
            s.least = least.copy()
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    c = b.slice(at, 2048)
                    s.feed(c.column(0).to_numpy(), _matrix(c.column(1), c.num_rows))
            q, score, other = s.found
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[q], pa.int64()), "score": pa.array(score.astype(np.int64)), "vec_id": pa.array(other, pa.int64())})

        part = v.select("vec_id", "v").mapInArrow(run, "query_id long, score long, vec_id long")
        result = part if result is None else result.unionByName(part)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    # every task gives a query at most k rows, so a group holds k rows a task
    top = result.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "e"))
    return top.select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
