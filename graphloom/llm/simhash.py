"""Operator 6, SimHash near-dedup over an LSH forest.

Each document's set of words makes a fingerprint of 256 bits. Every trie of the forest orders the fingerprints by a
random permutation of their bits. A pair at distance h shares the first d bits of one trie with probability
p = C(256 - h, d) / C(256, d), so `tries` tries climbed to depth d find it with 1 - (1 - p) ** tries. The depth grows with
the logarithm of the number of points, so that nodes keep their size, and the number of tries with it. Sparse
regions of a trie are climbed to shorter prefixes than that for nothing; dense regions only to the depth at which pairs
at the largest distance reach the target recall. A node that is denser still is searched by a forest of its own, of
other bits. Pairs that share a prefix are verified by their full fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import arrow, once_per_id, partitions, runs, shared_dir, slices, starts, texts, written
from .words import buffer, mix, words

BITS = 256
#: Largest number of differing bits of near copies (20 %: an angle of 36 degrees between the word sets).
DISTANCE = 51
#: Recall of pairs at that very distance; nearer pairs, which near copies are for the most part, have more.
RECALL = 0.9
#: A trie is never read at shorter prefixes than this, and nodes of at most SMALL points are not descended further.
SHORTEST, SMALL = 8, 64
#: Points that a node at the final depth holds on average at most, and least depth.
NODE, DEPTH = 256, 12
#: Points that one shortest prefix of a trie, which is searched in one piece, holds on average at most.
PIECE = 1 << 16
#: Points of a node that are compared at once, in a square.
SQUARE = 512
#: Unlike points of a node beyond which it gets a forest of its own, and that forest's recall.
DENSE, AGAIN = 4096, 0.98

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0].copy()


def forest(points: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """Depth to which dense regions are climbed, and the tries that then reach the recall."""
    depth = min(64, max(DEPTH, math.ceil(math.log2(max(points, 1) / NODE))))
    p = math.prod((BITS - distance - i) / (BITS - i) for i in range(depth))
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - p))


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(documents, 32) bytes and the number of distinct words. A text without words gets 32 bytes from its raw bytes, so
    that only an equal text matches it."""
    h, _, _, at = words(text)
    n = len(at) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    key = np.unique((owner << np.uint64(44)) | (h >> np.uint64(20)))
    owner = (key >> np.uint64(44)).astype(np.int64)
    word = mix(key & np.uint64((1 << 44) - 1))
    count = np.bincount(owner, minlength=n)
    out = np.zeros((n, BITS // 8), np.uint8)
    if len(key):
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        first = first[count > 0]
        # at most 255 features a run, so that each bit is counted in a byte of its own
        place = np.arange(len(key)) - np.repeat(first, count[count > 0])
        cut = np.flatnonzero(place % 255 == 0)
        lanes = np.empty((len(key), 4), np.uint64)
        for i in range(4):
            lanes[:, i] = mix(word + np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        part = np.add.reduceat(_SPREAD[lanes.view(np.uint8)], cut, axis=0).view(np.uint8)
        has = np.flatnonzero(count)
        ones = np.add.reduceat(part, np.searchsorted(cut, first), axis=0, dtype=np.int64)
        out[has] = np.packbits(ones * 2 > count[has][:, None], axis=1)
    b, offsets = buffer(text)
    for i in np.flatnonzero(count == 0):
        raw = b[offsets[i] : offsets[i + 1]]
        if len(raw):
            p = np.uint64((len(raw) * 0x9E3779B97F4A7C15) & (2**64 - 1)) + np.sum(mix(raw.astype(np.uint64) + (np.arange(len(raw), dtype=np.uint64) << np.uint64(8))), dtype=np.uint64)
            out[i] = mix(p + np.arange(4, dtype=np.uint64)).view(np.uint8)
    return out, count


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        fp, _ = fingerprints(piece.column("text"))
        v = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *[pa.array(v[:, i]) for i in range(4)]], names=["doc_id", "f0", "f1", "f2", "f3"])


def shortest(points: int, depth: int) -> int:
    """Bits of the shortest prefix at which a trie is read: so many that a piece of it holds PIECE points on average."""
    return min(depth, max(SHORTEST, math.ceil(math.log2(max(points, 1) / PIECE))))


def _tries(first: int, tries: int, seed: int):
    """Permutations of bit positions; each trie needs only the 64 bits that its key shows."""
    return [np.random.RandomState(seed + t).permutation(BITS)[:64] for t in range(first, tries)]


def keys(bits: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first 64 bits of points (a row of bits each) in a trie's order, as a number."""
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8")[:, 0].astype(np.uint64)


def near_pairs(a: np.ndarray, key: np.ndarray, segment: np.ndarray, depth: int, distance: int, top: int = SHORTEST, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of verified pairs among points sorted by (segment, key); the points of a segment share `top` bits of the key.
    Within a node, pairs whose ends others already
    join are left out: the components of the pairs are those of all pairs within the distance."""
    n = len(key)
    bound = np.zeros(n + 1, bool)
    bound[segment] = True
    bound[n] = True
    for d in range(top, depth):
        at = np.flatnonzero(bound)
        size = np.repeat(np.diff(at), np.diff(at))
        prefix = key >> np.uint64(63 - d)
        bound[1:n] |= (size[1:] > SMALL) & (prefix[1:] != prefix[:-1])
    at = np.flatnonzero(bound)
    sizes = np.diff(at)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    # points of small nodes, one lane after the other, so that each step runs through memory once
    some = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    node = np.repeat(np.arange(len(sizes)), sizes)[some]
    lanes = [np.ascontiguousarray(a[some, i]) for i in range(a.shape[1])]
    for k in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        if len(some) <= k:
            break
        # half of the bits tell nearly all pairs apart; of two random points they differ in a quarter of all
        half = np.bitwise_count(lanes[0][:-k] ^ lanes[0][k:]) + np.bitwise_count(lanes[1][:-k] ^ lanes[1][k:])
        near = np.flatnonzero((half <= distance) & (node[:-k] == node[k:]))
        x, y = some[near], some[near + k]
        good = np.bitwise_count(a[x] ^ a[y]).sum(1, dtype=np.int32) <= distance
        left.append(x[good])
        right.append(y[good])
    for i in np.flatnonzero(sizes > SMALL):
        if sizes[i] <= SQUARE:
            p = a[at[i] : at[i + 1]]
            half = np.bitwise_count(p[:, None, 0] ^ p[None, :, 0]) + np.bitwise_count(p[:, None, 1] ^ p[None, :, 1])
            x, y = np.nonzero(half <= distance)
            # where most are alike, and pairs many, one member after the other is cheaper
            if len(x) <= 16 * len(p):
                x, y = x[x < y], y[x < y]
                good = np.bitwise_count(p[x] ^ p[y]).sum(1, dtype=np.int32) <= distance
                left.append(at[i] + x[good])
                right.append(at[i] + y[good])
                continue
        rest = np.arange(at[i], at[i + 1])
        joined = 0
        while len(rest) > 1:
            joined += 1
            if joined > SMALL and len(rest) > DENSE:
                # many points that are unlike each other
                l, r = _own_forest(a[rest], distance, seed)
                left.append(rest[l])
                right.append(rest[r])
                break
            # a component at a time: what is near to a member joins, and is then looked around itself
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(a[rest] ^ a[x]).sum(1, dtype=np.int32) <= distance
                if near.any():
                    found = rest[near]
                    left.append(np.full(len(found), x))
                    right.append(found)
                    queue.extend(found.tolist())
                    rest = rest[~near]
    z = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (z, z)


def _own_forest(a: np.ndarray, distance: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as of near_pairs(), by tries over all bits of these points alone: no more of them than their number asks for."""
    depth, tries = forest(len(a), distance, AGAIN)
    bits = np.unpackbits(a.view(np.uint8), axis=1)
    left, right = [], []
    for t in range(tries):
        key = keys(bits, np.random.RandomState(7919 * seed + t).permutation(BITS)[:64])
        order = np.argsort(key, kind="stable")
        l, r = near_pairs(a[order], key[order], np.zeros(1, np.int64), depth, distance, 0, 7919 * seed + t + 1)
        left.append(order[l])
        right.append(order[r])
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL, seed: int = 20) -> DataFrame:
    """A row for each distinct doc_id: doc_id, group_id (the least doc_id of its group of near copies), keep (is it that
    one), copies (rows that carry this doc_id).

    A group is a connected component of the pairs found. Null and empty texts resemble nothing and are groups of their own; a
    text without words matches only equal texts. A row with a null doc_id is left out. Repeated rows count as one
    document; if rows of one doc_id differ, the group of any of them is its group. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    prints = written(spark, arrow(texts(docs, "doc_id", "text").filter("doc_id is not null"), _prints, "doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint"), "prints")
    blank = "(f0 = 0 and f1 = 0 and f2 = 0 and f3 = 0)"
    # equal fingerprints need no search: one of them goes into the forest, the others hang on it
    points = written(spark, prints.filter(f"not {blank}").groupBy("f0", "f1", "f2", "f3").agg(F.min("doc_id").alias("doc_id")), "points")
    equal = prints.filter(f"not {blank}").join(points.withColumnRenamed("doc_id", "head"), ["f0", "f1", "f2", "f3"]).filter("doc_id != head").select(F.col("head").alias("src"), F.col("doc_id").alias("dst"))
    count = points.count()
    depth, tries = forest(count, distance, recall)
    top = shortest(count, depth)
    orders = _tries(0, tries, seed)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                piece = b.slice(i, 4096)
                f = [piece.column(k) for k in ("f0", "f1", "f2", "f3")]
                bits = np.unpackbits(np.column_stack([c.to_numpy() for c in f]).view(np.uint8), axis=1)
                for t, order in enumerate(orders):
                    key = keys(bits, order)
                    # sorted as signed numbers in Spark
                    signed = (key ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int16)), pa.array(signed), piece.column("doc_id"), *f], names=["trie", "key", "doc_id", "f0", "f1", "f2", "f3"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _nodes(batches, top):
            key = table.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            trie = table.column("trie").to_numpy()
            ids = table.column("doc_id").to_numpy()
            a = np.column_stack([table.column(k).to_numpy() for k in ("f0", "f1", "f2", "f3")]).view(np.uint64)
            l, r = near_pairs(a, key, starts(trie, key >> np.uint64(64 - top))[:-1], depth, distance, top)
            l, r = forest_edges(ids[l], ids[r])
            yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(r)], names=["src", "dst"])

    grown = arrow(points, grow, "trie smallint, key bigint, doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    node = F.shiftright("key", 64 - top)
    sorted_ = grown.repartition(partitions(spark), "trie", node).sortWithinPartitions("trie", "key", "doc_id")
    pairs = arrow(sorted_, search, "src bigint, dst bigint")
    edges = written(spark, pairs.union(equal), "pairs")
    groups = connected_components(edges)
    ids = prints.groupBy("doc_id").agg(F.count("*").alias("copies"))
    out = ids.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    group = F.coalesce("component", "doc_id")
    return out.select("doc_id", group.alias("group_id"), (group == F.col("doc_id")).alias("keep"), "copies")


def _nodes(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.Table]:
    """runs() by trie and shortest prefix: rows that come with a key get a column for its first bits."""

    def prefixed():
        for b in batches:
            yield b.append_column("top", pa.array(b.column("key").to_numpy() >> (64 - top)))

    return runs(prefixed(), ["trie", "top"])


def forest_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the least member of each component of the pairs: as few edges as join the same documents."""
    if not len(a):
        return a, b
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[rest]], ids[rest]


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, all columns as they were: rows with a null doc_id stay, repeated rows of a
    kept doc_id become one."""
    decided = written(docs.sparkSession, near_duplicates(docs).filter("keep"), "kept")
    return once_per_id(docs.filter("doc_id is not null"), decided).unionByName(docs.filter("doc_id is null"))
