"""Operator 9, hierarchical multi-length packing.

Documents go to the smallest context size that holds them; texts beyond the largest are cut into full windows and a rest.
From the longest tier down, each is packed by best fit, longest piece first, and the gaps of its windows are filled with
the longest pieces of shorter tiers that fit. The windows of a tier are dealt to steps so that steps carry about as many tokens.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .tokens import VOCABULARY, token_counts

TIERS = (512, 2048, 8192, 32768)
#: Tokens that one shard packs, in expectation: bounds a task's memory and fixes the number of shards by the data alone.
SHARD = 48_000_000
#: Capacity of a step: of each tier so many windows that they hold this many tokens.
STEP = 1 << 18
SCHEMA = "doc_id bigint, piece bigint, start bigint, tokens bigint, tier bigint, window_id bigint, offset bigint, step_id bigint"


def cut(lengths: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, tokens) of the pieces of at most `largest` tokens."""
    n = -(-lengths // largest)
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * largest
    return doc, start, np.minimum(lengths[doc] - start, largest)


class Unused:
    """Pieces sorted by length; gives the longest one left of at most some length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.tolist()
        self.below = list(range(len(self.lengths)))

    def _find(self, i: int) -> int:
        while i >= 0 and self.below[i] != i:
            if self.below[i] >= 0:
                self.below[i] = self.below[self.below[i]] if self.below[self.below[i]] >= 0 else -1
            i = self.below[i]
        return i

    def take(self, most: int) -> int:
        i = self._find(bisect_left(self.lengths, most + 1) - 1)
        if i >= 0:
            self.below[i] = i - 1
        return i


def pack(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tier, window, offset) of each piece, windows numbered from 0 over all tiers; equal lengths go by their order."""
    n = len(lengths)
    tier = np.searchsorted(np.array(tiers), lengths)
    order = np.lexsort((-np.arange(n), lengths))  # ascending; of equal lengths the first is last, and so is taken first
    unused = Unused(lengths[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    window, offset, at_tier = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = 0
    for t in range(len(tiers) - 1, -1, -1):
        size = tiers[t]
        free: list[tuple[int, int]] = []
        mine = order[(tier[order] == t)][::-1]
        first = count
        for i in mine.tolist():
            if window[i] >= 0:
                continue
            need = int(lengths[i])
            unused.below[rank[i]] = rank[i] - 1
            k = bisect_left(free, (need, -1))
            left, w = free.pop(k) if k < len(free) else (size, count)
            if w == count:
                count += 1
            window[i], offset[i], at_tier[i] = w, size - left, t
            insort(free, (left - need, w))
        # gaps: the largest first
        for left, w in reversed(free):
            while left > 0:
                j = unused.take(left)
                if j < 0:
                    break
                i = order[j]
                window[i], offset[i], at_tier[i] = w, size - left, t
                left -= int(lengths[i])
        assert count >= first
    return at_tier, window, offset


def steps(window: np.ndarray, at_tier: np.ndarray, lengths: np.ndarray, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> np.ndarray:
    """The step of each piece's window: per tier the windows, fullest first, are dealt to the steps there and back."""
    if not len(window):
        return window
    used = np.bincount(window, weights=lengths).astype(np.int64)
    tier_of = np.zeros(len(used), np.int64)
    tier_of[window] = at_tier
    out, count = np.zeros(len(used), np.int64), 0
    for t, size in enumerate(tiers):
        mine = np.flatnonzero(tier_of == t)
        if not len(mine):
            continue
        n = -(-len(mine) // max(1, step // size))
        mine = mine[np.lexsort((mine, -used[mine]))]
        lap, at = np.arange(len(mine)) // n, np.arange(len(mine)) % n
        out[mine] = count + np.where(lap % 2 == 0, at, n - 1 - at)
        count += n
    return out[window]


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = TIERS, path: str = VOCABULARY, shard: int = SHARD, step: int = STEP, end: int = 1) -> DataFrame:
    """A row for each piece of a document: doc_id, piece, start (its first token in the document), tokens, tier (size of the
    window it lies in), window_id, offset in the window, step_id.

    Each document counts `end` token more than its text, its end mark. Every token of every text is in just one row.
    Documents without tokens (null or empty text) and rows with a null doc_id, which could not be found again, have no row.
    Repeated rows are packed each. Equal lengths: by doc_id. An empty table gives an empty table. Other columns are not
    read. Shards are by a hash of doc_id and packed apart; their number follows from the tokens, so the result does not
    depend on the cluster.
    """
    spark = docs.sparkSession
    counts = written(spark, token_counts(docs.filter("doc_id is not null"), path).filter("tokens > 0"), "counts")
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / shard))

    def place(key, table):
        ids, n = table.column("doc_id").to_numpy(), table.column("tokens").to_numpy() + end
        order = np.lexsort((n, ids))
        ids, n = ids[order], n[order]
        doc, start, length = cut(n, tiers[-1])
        at_tier, window, offset = pack(length, tiers)
        base = key[0].as_py() << 32
        cols = [ids[doc], start // tiers[-1], start, length, np.array(tiers)[at_tier], base + window, offset, base + steps(window, at_tier, length, tiers, step)]
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=[c.split()[0] for c in SCHEMA.split(", ")])

    parts = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return parts.groupBy("shard").applyInArrow(place, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
