"""Operator 8, edit-aware token counts.

A document's pre-tokens are the leaves of a segment tree whose nodes hold the tokens of the leaves below. An edit changes a
stretch of the text: pre-tokens are matched anew from the one before the first that it touches until a boundary of the new text falls on one of the
old text behind the edit, from where on both agree. Only that stretch is encoded; its sum replaces that of the old leaves
and the sums on the paths to the root are updated. Leaves are kept in a table, so that later edits, batch after batch, read
no document that they do not change and encode nothing but what they touch.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, fresh, slices, texts
from .tokens import PATTERN, VOCABULARY, encoding

Edit = tuple[int, int, str]
SCHEMA = "doc_id bigint, pretokens bigint, tokens bigint, edits bigint, tokens_after bigint, chars_reencoded bigint"


@functools.lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


@functools.lru_cache(4)
def _lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    e = encoding(path)
    n = np.zeros(e.max_token_value + 1, np.int64)
    for b in e.token_byte_values():
        n[e.encode_single_token(b)] = len(b)
    return n


class TokenTree:
    """Pre-token boundaries of a text and a segment tree of their token counts; `leaves`, if given, are those that leaves()
    has given before, and nothing is encoded."""

    def __init__(self, text: str, path: str = VOCABULARY, leaves: bytes | None = None):
        self.text, self.path = text, path
        self.reencoded, self.total = 0, 0
        #: Stretches of leaves that apply() has replaced: first, last, lengths and tokens of the new ones.
        self._spliced: list[tuple[int, int, list[int], list[int]]] = []
        if leaves is not None:
            held = np.frombuffer(zstandard.ZstdDecompressor().decompress(leaves), np.uint32).astype(np.int64)
            self._build(np.cumsum(held[: len(held) // 2]), held[len(held) // 2 :])
            return
        e = encoding(path)
        ends = np.cumsum(np.fromiter(map(len, _pattern().findall(text)), np.int64)) if text else np.zeros(0, np.int64)
        counts = np.zeros(len(ends), np.int64)
        if len(ends):
            at = ends
            if not text.isascii():
                b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                at = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))[ends]
            ids = np.fromiter(e.encode_ordinary(text), np.int64)
            upto = np.searchsorted(np.cumsum(_lengths(path)[ids]), at, side="right")
            counts = np.diff(upto, prepend=0)
        self._build(ends, counts)

    def _build(self, ends: np.ndarray, counts: np.ndarray) -> None:
        self._ends = ends
        self.size = 1 << max(0, (len(ends) - 1)).bit_length()
        self.tree = np.zeros(2 * self.size, np.int64)
        self.tree[self.size : self.size + len(ends)] = counts
        level = self.size
        while level > 1:
            self.tree[level // 2 : level] = self.tree[level : 2 * level : 2] + self.tree[level + 1 : 2 * level : 2]
            level //= 2
        self.total = int(self.tree[1])

    @property
    def ends(self) -> np.ndarray:
        """Where the pre-tokens end, in characters."""
        self._settle()
        return self._ends

    @property
    def tokens(self) -> int:
        return self.total

    def _settle(self) -> None:
        """Puts the new leaves of the edits so far in the place of the old ones; nothing is encoded for that."""
        if not self._spliced:
            return
        lengths, counts = np.diff(self._ends, prepend=0), self.tree[self.size : self.size + len(self._ends)].copy()
        parts, at = [], 0
        for first, last, new, tokens in self._spliced:
            parts += [(lengths[at:first], counts[at:first]), (np.array(new, np.int64), np.array(tokens, np.int64))]
            at = last
        parts.append((lengths[at:], counts[at:]))
        self._spliced = []
        self._build(np.cumsum(np.concatenate([p[0] for p in parts])), np.concatenate([p[1] for p in parts]))

    def leaves(self) -> bytes:
        """Lengths and token counts of all pre-tokens, to make the tree of again."""
        self._settle()
        held = np.concatenate([np.diff(self.ends, prepend=0), self.tree[self.size : self.size + len(self.ends)]]).astype(np.uint32)
        return zstandard.ZstdCompressor(level=3).compress(held.tobytes())

    def count(self, first: int, last: int) -> int:
        """Tokens of the leaves from first up to, not including, last."""
        self._settle()
        total, a, b = 0, first + self.size, last + self.size
        while a < b:
            if a & 1:
                total += int(self.tree[a])
                a += 1
            if b & 1:
                b -= 1
                total += int(self.tree[b])
            a, b = a // 2, b // 2
        return total

    def _set(self, first: int, last: int, tokens: int) -> None:
        """The leaves from first to last now have so many tokens between them, held by the first."""
        self.tree[self.size + first] = tokens
        self.tree[self.size + first + 1 : self.size + last] = 0
        a, b = (self.size + first) // 2, (self.size + max(first, last - 1)) // 2
        while a:
            self.tree[a : b + 1] = self.tree[2 * a : 2 * b + 1 : 2] + self.tree[2 * a + 1 : 2 * b + 2 : 2]
            a, b = a // 2, b // 2

    def apply(self, edits: list[Edit]) -> str:
        """Applies edits (start, end, replacement), which are places in the text as it was built; returns the new text.
        Edits that begin before the end of an earlier one, or beyond the text, are left out; an edit that ends beyond it
        ends with it. Afterwards the tree is that of the new text, and may be edited again."""
        self._settle()
        good: list[Edit] = []
        for s, e, r in sorted(edits, key=lambda x: (x[0], x[1])):
            e = min(e, len(self.text))
            if 0 <= s <= e and (not good or s >= good[-1][1]) and (s < e or r):
                good.append((s, e, r))
        if not good:
            return self.text
        parts, at = [], 0
        for s, e, r in good:
            parts += [self.text[at:s], r]
            at = e
        new = "".join(parts) + self.text[at:]
        encode, match = encoding(self.path).encode_ordinary, _pattern().match
        ends = self.ends.tolist()
        n, i, delta = len(ends), 0, 0
        while i < len(good):
            first = self._before(ends, good[i][0])
            at = self._start(ends, first) + delta
            begin, stop, sizes, counts = at, None, [], []
            until = good[i][1] + delta + len(good[i][2]) - (good[i][1] - good[i][0])
            delta += len(good[i][2]) - (good[i][1] - good[i][0])
            i += 1
            while True:
                while i < len(good) and at >= self._start(ends, self._before(ends, good[i][0])) + delta:
                    until = good[i][0] + delta + len(good[i][2])
                    delta += len(good[i][2]) - (good[i][1] - good[i][0])
                    i += 1
                if at >= until:
                    old = at - delta
                    k = bisect_left(ends, old)
                    if old == 0 or (k < n and ends[k] == old):
                        stop = k + 1 if old else 0
                        break
                    if at >= len(new):
                        stop = n
                        break
                m = match(new, at)
                counts.append(len(encode(m.group())))
                sizes.append(m.end() - at)
                at = m.end()
            last = max(stop, first)
            self.reencoded += at - begin
            self._spliced.append((first, last, sizes, counts))
            if n and last > first:
                self._set(first, last, sum(counts))
                self.total = int(self.tree[1]) + sum(sum(c) for f, k, _, c in self._spliced if k == f)
            else:
                self.total += sum(counts)
        self.text = new
        return new

    def _before(self, ends: list[int], start: int) -> int:
        """The first leaf that a change at start can alter: the one before the leaf that holds it, whose end the character
        there decides, and, as a run of white space is cut by what follows it, those back to the start of such a run."""
        k = max(0, bisect_right(ends, start) - 1)
        while k and self.text[ends[k - 1] - 1].isspace():
            k -= 1
        return k

    @staticmethod
    def _start(ends: list[int], leaf: int) -> int:
        return ends[leaf - 1] if leaf else 0


#: The part of a mail address from its sign on, and the others by what they begin with: a run of digits, or of hexadecimal ones.
HOST = re.compile(r"@[\w-]+\.[\w.-]+")
LOCAL = re.compile(r"[\w.+-]+\Z")
DIGITS = re.compile(r"(?<!\w)(?:(?P<ip>\d{1,3}(?:\.\d{1,3}){3})|(?P<key>[0-9A-Fa-f]{32,})|(?P<number>\d{9,}))(?!\w)")
RUN = re.compile(r"[\d.]{7}|[0-9A-Fa-f]{32}")


def redactions(text: str) -> list[Edit]:
    """Mail addresses, IP addresses, hexadecimal keys and long numbers, each to be replaced by its kind; of those that overlap the first."""
    found, behind = [], 0
    for m in HOST.finditer(text):
        begin = m.start()
        while begin > behind and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
            begin -= 1
        if begin < m.start():
            found.append((begin, m.end(), "<mail>"))
        behind = m.end()
    if RUN.search(text):
        found += [(m.start(), m.end(), f"<{m.lastgroup}>") for m in DIGITS.finditer(text)]
    good, at = [], 0
    for start, end, kind in sorted(found):
        if start >= at:
            good.append((start, end, kind))
            at = end
    return good


def edited_counts(docs: DataFrame, edits: DataFrame | None = None, rule: Callable[[str], list[Edit]] = redactions, path: str = VOCABULARY) -> DataFrame:
    """A row for each row of docs: doc_id, pretokens, tokens, edits (as asked for), tokens_after, chars_reencoded.

    edits has the columns doc_id, start, end, replacement (characters of the text as it is); without it, rule(text) gives
    a document's edits. A null text is an empty one, with no tokens; rows with a null doc_id are counted but have no edits of the
    table. Repeated rows give repeated rows, each with all edits of their doc_id. A null in an edit leaves it out, edits that
    overlap an earlier one (by start, end) too. An empty table gives an empty table. Other columns are not read.
    """
    source, asked = texts(docs, "doc_id", "text"), edits is not None
    if edits is not None:
        e = edits.filter("doc_id is not null and start is not null and end is not null and replacement is not null").distinct()
        (of,) = fresh(source, "_of")
        e = e.groupBy(F.col("doc_id").alias(of)).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "replacement"))).alias("asked"))
        source = source.join(e, source["doc_id"] == F.col(of), "left").select("doc_id", "asked", "text")
    source = source.withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            given = piece.column("asked").to_pylist() if asked else None
            out = []
            for i, text in enumerate(piece.column("text").to_pylist()):
                text = text or ""
                tree = TokenTree(text, path)
                before, pieces = tree.tokens, len(tree.ends)
                todo = [(x["start"], x["end"], x["replacement"]) for x in given[i] or []] if given is not None else rule(text)
                if todo:
                    tree.apply(todo)
                out.append((pieces, before, len(todo), tree.tokens, tree.reencoded))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*out)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return arrow(source, count, SCHEMA)


TREES = "doc_id bigint, text string, leaves binary, tokens bigint, chars_reencoded bigint"


def token_trees(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, leaves, tokens, chars_reencoded) of each row of docs, encoded once; to be written and given to edit_trees()."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            trees = [TokenTree(t or "", path) for t in piece.column("text").to_pylist()]
            yield _rows(piece.column("doc_id"), trees)

    return arrow(texts(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")), build, TREES)


def _rows(ids: pa.Array, trees: list[TokenTree]) -> pa.RecordBatch:
    columns = [pa.array([t.text for t in trees], pa.string()), pa.array([t.leaves() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.reencoded for t in trees], pa.int64())]
    return pa.RecordBatch.from_arrays([ids, *columns], names=[x.split()[0] for x in TREES.split(", ")])


def edit_trees(trees: DataFrame, edits: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The trees after a batch of edits (doc_id, start, end, replacement, as for edited_counts()); chars_reencoded is what this
    batch has encoded. Documents without edits pass through as they are, with 0, and never reach Python. Batches may follow each other."""
    e = edits.filter("doc_id is not null and start is not null and end is not null and replacement is not null").distinct()
    e = e.groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "replacement"))).alias("asked"))

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            done = []
            for text, leaves, asked in zip(*(piece.column(c).to_pylist() for c in ("text", "leaves", "asked"))):
                done.append(TokenTree(text, path, leaves))
                done[-1].apply([(x["start"], x["end"], x["replacement"]) for x in asked])
            yield _rows(piece.column("doc_id"), done)

    edited = arrow(trees.join(e, trees["doc_id"] == e["of"]).select("doc_id", "leaves", "asked", "text"), change, TREES)
    return edited.union(trees.join(e, trees["doc_id"] == e["of"], "left_anti").select("doc_id", "text", "leaves", "tokens", F.lit(0).cast("bigint").alias("chars_reencoded")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after personal data and keys are masked."""
    return edited_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
