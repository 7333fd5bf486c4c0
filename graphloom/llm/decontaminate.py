"""Operator 10, benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its shingles of WORDS words (an item of fewer words is one shingle, all of it), ordered by rarity over all documents, the rarest first. A
window that holds at least t of an item's n shingles holds one of its n - t + 1 rarest, so only those are joined with
the documents' shingles. A match bounds the windows around it by position; a document with fewer than t shingles is
left out by length. What is left is verified: the exact containment of the item in each window of the item's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, fresh, slices, texts, written
from .words import of_text, shingles, words

WORDS = 5
#: Share of an item's shingles that a window must hold for the document to be contaminated.
CONTAINMENT = 0.5
#: Shingles of the items that one pass over the documents handles; a larger benchmark takes several passes.
BLOCK = 2_000_000


def item_sets(benchmark: DataFrame, k: int = WORDS) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Blocks of (item_id, words, distinct shingles): of k words, or of all words of a shorter item."""
    block, size = [], 0
    for row in texts(benchmark, "item_id", "text").filter("item_id is not null and text is not null").distinct().toLocalIterator():
        h = of_text(row[1])
        if len(h):
            block.append((row[0], len(h), np.unique(shingles(h, min(k, len(h))))))
            size += len(block[-1][2])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


class Filter:
    """Membership of 64-bit hashes in a fixed set: a table by the low bits first, then a binary search for the few."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.mask = np.uint64((1 << max(16, int(math.log2(len(self.values) + 1)) + 5)) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[self.values & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of members, and their indices in values."""
        at = np.flatnonzero(self.table[h & self.mask])
        where = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        good = self.values[where] == h[at]
        return at[good], where[good]


def _shingled(piece: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a batch, the document of each, and the offsets of the documents in words; none crosses documents."""
    h, _, _, at = words(piece.column("text"))
    s = shingles(h, k)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(s)]
    return s, owner, at


def _short(block: list[tuple[int, int, np.ndarray]], k: int) -> dict[int, dict[int, list[int]]]:
    """Items of fewer than k words: {words: {shingle: item_ids}}."""
    out: dict[int, dict[int, list[int]]] = {}
    for item, size, members in block:
        if size < k:
            out.setdefault(size, {}).setdefault(int(members[0]), []).append(item)
    return out


def _short_leaks(piece: pa.RecordBatch, short: dict[int, dict[int, list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(document, item_id, start) of the first place of each short item in each document of the batch."""
    for size, items in short.items():
        s, owner, at = _shingled(piece, size)
        pos, _ = Filter(np.array(list(items), np.uint64)).find(s)
        pos = pos[pos + size <= at[owner[pos] + 1]]
        _, first = np.unique(np.column_stack([owner[pos].astype(np.uint64), s[pos]]), axis=0, return_index=True)
        for p in pos[first].tolist():
            for item in items[int(s[p])]:
                yield int(owner[p]), item, p - int(at[owner[p]])


def containment(s: np.ndarray, members: np.ndarray, length: int) -> tuple[int, int]:
    """The most distinct members (sorted hashes) that `length` successive shingles of s hold, and where those begin."""
    where = np.minimum(np.searchsorted(members, s), len(members) - 1)
    hit = np.flatnonzero(members[where] == s)
    ids = where[hit].tolist()
    best, start, low, held = 0, 0, 0, {}
    for i, (p, x) in enumerate(zip(hit.tolist(), ids)):
        held[x] = held.get(x, 0) + 1
        while p - hit[low] >= length:
            y = ids[low]
            held[y] -= 1
            if not held[y]:
                del held[y]
            low += 1
        if len(held) > best:
            best, start = len(held), int(hit[low])
    return best, start


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, k: int = WORDS) -> DataFrame:
    """(doc_id, item_id, containment, start_word) for each document and item of which a window of the item's number of
    words holds at least `share` of the item's distinct shingles; start_word is the first such best window's.

    Case, punctuation and white space do not count. An item of fewer than k words is contained where all its words stand in a
    row. Items without words, null texts and null ids are left out; a text with fewer words than an item is one window. Repeated rows of docs or benchmark give one row; where texts of one
    doc_id or item_id differ, the best. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, containment double, start_word bigint"
    source = texts(docs.filter("doc_id is not null and text is not null"), "doc_id", "text")
    found = None
    for block in item_sets(benchmark, k):
        short = spark.sparkContext.broadcast(_short(block, k))
        block = [x for x in block if x[1] >= k]
        # an empty block has a filter that no shingle passes but by chance, and no items behind it
        every = Filter(np.concatenate([np.zeros(1, np.uint64), *(x[2] for x in block)]))
        shared = spark.sparkContext.broadcast(every)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            total = np.zeros(len(known.values), np.int64)
            for piece in slices(batches, "text"):
                s, owner, at = _shingled(piece, k)
                pos, which = known.find(s)
                pos_ok = pos + k <= at[owner[pos] + 1]
                pair = np.unique(owner[pos[pos_ok]].astype(np.int64) * len(total) + which[pos_ok])
                np.add.at(total, pair % len(total), 1)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "documents"])

        rarity = np.zeros(len(every.values), np.int64)
        for r in arrow(source, count, "shingle bigint, documents bigint").groupBy("shingle").agg(F.sum("documents")).collect():
            rarity[r[0]] = r[1]
        prefix, owner_of, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for i, (item, size, members) in enumerate(block):
            where = np.searchsorted(every.values, members)
            rare = members[np.lexsort((members, rarity[where]))]
            need = max(1, math.ceil(share * len(members) - 1e-9))
            head = rare[: len(members) - need + 1]
            prefix.append(head)
            owner_of.append(np.full(len(head), i))
            sets.append((item, size, members, need))
        hashes, owners = np.concatenate(prefix), np.concatenate(owner_of)
        order = np.argsort(hashes, kind="stable")
        heads = spark.sparkContext.broadcast((Filter(np.append(hashes, np.uint64(0))), hashes[order], owners[order], sets))

        def verify(batches: Iterator[pa.RecordBatch], heads=heads, short=short) -> Iterator[pa.RecordBatch]:
            known, hashes, owners, sets = heads.value
            for piece in slices(batches, "text"):
                s, owner, at = _shingled(piece, k)
                pos, which = known.find(s)
                out = [(piece.column("doc_id")[d].as_py(), item, 1.0, start) for d, item, start in _short_leaks(piece, short.value)]
                ranges: dict[tuple[int, int], list[list[int]]] = {}
                for p, w in zip(pos.tolist(), which.tolist()):
                    d = int(owner[p])
                    first, last = int(at[d]), int(at[d + 1]) - k
                    if p > last:
                        continue
                    h = known.values[w]
                    for j in range(np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")):
                        i = int(owners[j])
                        _, size, _, need = sets[i]
                        if last - first + 1 < need:
                            continue
                        low, high = max(first, p - (size - k)), min(last, p + (size - k))
                        spans = ranges.setdefault((d, i), [])
                        if spans and low <= spans[-1][1] + 1:
                            spans[-1][1] = max(spans[-1][1], high)
                        else:
                            spans.append([low, high])
                for (d, i), spans in ranges.items():
                    item, size, members, need = sets[i]
                    best, start = 0, 0
                    for low, high in spans:
                        n, place = containment(s[low : high + 1], members, size - k + 1)
                        if n > best:
                            best, start = n, low + place
                    if best >= need:
                        out.append((piece.column("doc_id")[d].as_py(), item, best / len(members), start - int(at[d])))
                if out:
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64())], names=["doc_id", "item_id", "containment", "start_word"])

        part = arrow(source, verify, schema)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", (-F.col("start_word")).alias("start"))).alias("best"))
    return best.select("doc_id", "item_id", F.round("best.containment", 6).alias("containment"), (-F.col("best.start")).alias("start_word"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = "regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark WHERE text IS NOT NULL),
ks AS (SELECT DISTINCT least({WORDS}, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS p, w FROM d, ks WHERE len(w) >= k),
dsh AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS s FROM ds),
bs AS (SELECT item_id, len(w) AS size, least({WORDS}, len(w)) AS k, unnest(range(0, greatest(len(w) - {WORDS}, 0) + 1)) AS p, w FROM b WHERE len(w) > 0),
bsh AS (SELECT DISTINCT item_id, size, k, array_to_string(w[p + 1 : p + k], ' ') AS s FROM bs),
n AS (SELECT item_id, count(*) AS n FROM bsh GROUP BY 1),
hits AS (SELECT doc_id, item_id, size, k, p, s FROM dsh JOIN bsh USING (s, k)),
windows AS (
  SELECT a.doc_id, a.item_id, a.p, count(DISTINCT z.s) AS held
  FROM hits a JOIN hits z ON a.doc_id = z.doc_id AND a.item_id = z.item_id AND z.p BETWEEN a.p AND a.p + a.size - a.k
  GROUP BY 1, 2, 3
)
SELECT doc_id, item_id, round(max(held / n), 6) AS containment, arg_max(p, (held, -p)) AS start_word
FROM windows JOIN n USING (item_id) GROUP BY 1, 2 HAVING max(held) >= max(ceil({CONTAINMENT} * n))
"""


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents, all columns as they were; rows with a null doc_id stay."""
    (leak,) = fresh(docs, "_leak")
    leaks = written(docs.sparkSession, find_leaks(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"] == F.col(leak), "left_anti")
