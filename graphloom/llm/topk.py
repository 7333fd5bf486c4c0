"""Operator 5, exact top-k search by no-random-access aggregation.

Every dimension of a shard of vectors is a list sorted by value, and nothing but these lists is kept of the shard. A query
reads a list from the top where its weight is positive and from the bottom where it is negative, so each list comes in the
order of its share of the score; lists of weight 0 are not read. What a list has not shown of an item lies between the list's
last value and the value at which reading stands: that gives each item's lower and upper bound. The threshold is the k-th
best lower bound so far, over earlier shards too. The lists are read in growing prefixes, for many queries together. Where an item that no list has shown cannot
qualify for a query, only those whose upper bound reaches the threshold are left to it, and when queries are left with none, reading stops.
The final scores of what is left are resolved by reading on; no list is ever asked for an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, written

K = 10
#: Queries are the rows whose id is divisible by this.
EVERY = 20
#: Vectors of a shard; queries of a block, which is broadcast: at most BLOCK_BYTES of vectors, whatever the table.
SHARD, BLOCK, BLOCK_BYTES = 4096, 16_384, 32 << 20
#: Queries that are compared with a shard at once.
TOGETHER = 1024
#: Shares of the lists after which bounds are compared.
ROUNDS = (0.05, 0.2, 0.5)
#: More than what single precision loses in a product, relative to the norms.
SLACK = 1e-5


class Lists:
    """The sorted lists of a shard: of each dimension the values, ascending, and the items that have them. `read` is how many
    entries from either end of each list have been read."""

    def __init__(self, order: np.ndarray, values: np.ndarray):
        self.order, self.values = order, values
        self.d, self.n = order.shape
        # no item's norm is beyond that of the lists' ends
        self.norm = float(np.linalg.norm(np.abs(values[:, [0, -1]]).max(1)))
        self.read = 0

    @classmethod
    def of(cls, x: np.ndarray) -> Lists:
        order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        return cls(np.ascontiguousarray(order.T), np.ascontiguousarray(np.take_along_axis(x, order, axis=0).T))

    def _shown(self, rows: slice, rest: np.ndarray) -> np.ndarray:
        """(item, dimension) values that these rows of the lists show, and `rest` of a dimension where they show none."""
        out = np.repeat(rest[None, :], self.n, axis=0)
        out[self.order[:, rows], np.arange(self.d)[:, None]] = self.values[:, rows]
        return out

    def search(self, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, exact score), which include each query's k best items of the shard as far as their score is at least
        the query's `least`, ties with the k-th included."""
        n, k = self.n, min(k, self.n)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        slack = SLACK * np.linalg.norm(q, axis=1) * self.norm
        least = least - slack
        todo, found = np.arange(len(q)), []
        for share in ROUNDS:
            stop = int(share * n)
            if not 0 < stop < n:
                continue
            self.read = stop
            # the values at which reading stands: an item that no list has shown is not above what they add up to
            above, below = self.values[:, n - stop - 1], self.values[:, stop]
            ready = plus[todo] @ above + minus[todo] @ below < least[todo]
            mine, todo = todo[ready], todo[~ready]
            if len(mine):
                p, m = plus[mine], minus[mine]
                top, bottom = slice(n - stop, n), slice(0, stop)
                upper = p @ self._shown(top, above).T + m @ self._shown(bottom, below).T
                own, item = np.nonzero(upper >= least[mine, None])
                if len(own):
                    low, high = self.values[:, 0], self.values[:, -1]
                    lower = p @ self._shown(top, low).T + m @ self._shown(bottom, high).T
                    kth = np.maximum(least[mine], np.partition(lower, n - k, axis=1)[:, n - k] - slack[mine])
                    good = upper[own, item] >= kth[own]
                    found.append((mine[own[good]], item[good]))
            if not len(todo):
                break
        if not len(todo) and not any(len(own) for own, _ in found):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0)
        # what is left is resolved by reading on, to the end
        self.read = n
        x = self._shown(slice(0, n), np.zeros(self.d, np.float32))
        own, item = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        many = np.bincount(own, minlength=len(q)) > n // 16
        todo = np.union1d(todo, np.flatnonzero(many))
        found = [(own[~many[own]], item[~many[own]])]
        if len(todo):
            score = q[todo] @ x.T
            kth = np.maximum(least[todo], np.partition(score, n - k, axis=1)[:, n - k] - 2 * slack[todo])
            own, item = np.nonzero(score >= kth[:, None])
            found.append((todo[own], item))
        own, item = (np.concatenate(c) for c in zip(*found))
        exact = [np.einsum("ij,ij->i", q[own[a : a + 32768]].astype(np.float64), x[item[a : a + 32768]].astype(np.float64)) for a in range(0, len(own), 32768)]
        return own, item, np.concatenate(exact) if exact else np.zeros(0)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (d, ids, items, values): the lists of SHARD vectors of one length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def made(d: int, size: int) -> pa.RecordBatch:
        ids, x = (np.concatenate(c) for c in zip(*held[d]))
        held[d] = [(ids[size:], x[size:])]
        lists = Lists.of(x[:size])
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in (ids[:size], lists.order, lists.values)]], names=["d", "ids", "items", "values"])

    for b in batches:
        v = b.column("v")
        lengths = np.diff(v.offsets.to_numpy())
        for d in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == d)
            x = v.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)
            held.setdefault(d, []).append((b.column("id").to_numpy()[mine], x))
            while sum(len(i) for i, _ in held[d]) >= SHARD:
                yield made(d, SHARD)
    for d, parts in held.items():
        if sum(len(i) for i, _ in parts):
            yield made(d, SHARD)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """For each vector whose id is divisible by `every` its k best others by inner product, among all vectors of its length:
    query_id, rank (from 1), neighbor_id, score (rounded to 6 digits).

    Exact: scores are resolved in double precision. Ties go to the lesser id. Rows with a null id or an empty or null vector, or with a null, a NaN or an
    infinite value in the vector, are left out, as query and as neighbor. Vectors of several lengths are searched length by
    length. Repeated ids count once (the least vector of an id). A vector has fewer than k neighbors if there are fewer
    others; an empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v"))
    v = v.filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf'))")
    v = written(spark, v.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    shards = written(spark, arrow(v, _shards, "d int, ids binary, items binary, values binary"), "shards")
    # some vectors give each query a first threshold; which ones does not change the result
    few = v.limit(SHARD).collect()
    found = None
    for block in _blocks(v.filter(F.pmod("id", F.lit(every)) == 0)):
        shared = spark.sparkContext.broadcast([(d, ids, q, _first(q, ids, few, k)) for d, ids, q in block])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in shared.value]
            least = [first.copy() for *_, first in shared.value]
            for b in batches:
                for d, ids, items, values in zip(*(b.column(c).to_pylist() for c in ("d", "ids", "items", "values"))):
                    ids = np.frombuffer(ids, np.int64)
                    lists = Lists(np.frombuffer(items, np.int32).reshape(d, -1), np.frombuffer(values, np.float32).reshape(d, -1))
                    for part, (size, own, q, _) in enumerate(shared.value):
                        for a in range(0, len(q), TOGETHER) if size == d else ():
                            # k + 1: the query may be among them
                            i, item, score = lists.search(q[a : a + TOGETHER], least[part][a : a + TOGETHER], k + 1)
                            i += a
                            other = ids[item] != own[i]
                            best[part] = _best(*(np.concatenate(c) for c in zip(best[part], (i[other], ids[item[other]], score[other]))), k)
                            full, which = _full(best[part][0], k)
                            least[part][full] = np.maximum(least[part][full], best[part][2][which])
            for (_, own, _, _), (i, names, score) in zip(shared.value, best):
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(names), pa.array(score)], names=["query_id", "neighbor_id", "score"])

        part = written(spark, arrow(shards.repartition(spark.sparkContext.defaultParallelism).select("d", "ids", "items", "values"), search, "query_id bigint, neighbor_id bigint, score double"), "nearest")
        shared.unpersist()
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, neighbor_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.round("score", 6).alias("score"))


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Blocks of (length, ids, matrix) of queries, one at a time on the driver: BLOCK of them or BLOCK_BYTES at most."""
    held: dict[int, list] = {}
    rows = size = 0

    def made():
        return [(d, np.array([i for i, _ in x], np.int64), np.array([y for _, y in x], np.float32)) for d, x in sorted(held.items())]

    for i, x in queries.toLocalIterator():
        held.setdefault(len(x), []).append((i, x))
        rows, size = rows + 1, size + 4 * len(x)
        if rows >= BLOCK or size >= BLOCK_BYTES:
            yield made()
            held, rows, size = {}, 0, 0
    if rows:
        yield made()


def _best(query: np.ndarray, names: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, best first, of equal ones the lesser ids."""
    order = np.lexsort((names, -score, query))
    query, names, score = query[order], names[order], score[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], names[top], score[top]


def _full(query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The queries that have k items, and where the k-th stands."""
    last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.zeros(0, np.int64)
    last = last[last - np.searchsorted(query, query[last]) + 1 == k]
    return query[last], last


def _first(q: np.ndarray, ids: np.ndarray, few: list, k: int) -> np.ndarray:
    """Of each query the k-th best score among a few vectors other than itself: no item below it is among the k best."""
    mine = [(r[0], r[1]) for r in few if len(r[1]) == q.shape[1]]
    out = np.full(len(q), -np.inf)
    if len(mine) > k:
        x, names = np.array([v for _, v in mine], np.float32), np.array([i for i, _ in mine])
        for a in range(0, len(q), 1024):
            s = q[a : a + 1024] @ x.T
            s[ids[a : a + 1024, None] == names[None, :]] = -np.inf
            norm = np.linalg.norm(q[a : a + 1024], axis=1) * np.linalg.norm(x, axis=1).max()
            out[a : a + 1024] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - SLACK * norm
    return out


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(score, 6) AS score FROM r WHERE rank <= {K}
"""
