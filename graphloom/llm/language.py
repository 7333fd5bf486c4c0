"""Operator 1, language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, each permuted by its place,
by elementwise product; a document's vector bundles (adds) those of all its trigrams; a language's prototype bundles the
unit vectors of the labelled documents in its sample. A document gets the language with the largest cosine. A text of n
trigrams, of which two are equal with probability c in its language, has an expected cosine of sqrt(n c / (n c + 1 - c))
with its language's prototype, and with others one about 0 that deviates by 1 / sqrt(DIMENSIONS): so the floor under which it is
in no known language grows with its length, by one rule for all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, batch, slices, texts
from .words import buffer, mix

DIMENSIONS = 1024
#: Labelled documents a language whose whole texts make its prototype, in expectation (the documented bound).
SAMPLE = 400
#: Share of the cosine expected of a text of its length below which a document is in no known language, and deviations of
#: a chance cosine by which it must fall short.
FLOOR, DEVIATIONS = 0.3, 3.0
#: Counts (documents by distinct trigrams) and vectors (trigrams by dimensions) that are held at once.
HELD = 1 << 22
SCHEMA = [("doc_id", pa.int64()), ("lang", pa.string()), ("language", pa.string()), ("cosine", pa.float64()), ("margin", pa.float64()), ("trigrams", pa.int64()), ("keep", pa.bool_())]

_PERM = np.random.RandomState(11).permutation(DIMENSIONS)
_LETTER = np.zeros(0x110000 >> 8, object)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether each code point (uint32) is a letter; a table per 256 code points is made when first met."""
    out = np.empty(len(codes), bool)
    block = codes >> 8
    low = block == 0
    blocks = [0] if low.all() else np.unique(block)
    for k in blocks:
        if not isinstance(_LETTER[k], np.ndarray):
            _LETTER[k] = np.array([chr(c).isalpha() for c in range(k << 8, (k + 1) << 8)])
        at = block == k if len(blocks) > 1 else slice(None)
        out[at] = _LETTER[k][codes[at] & 255]
    return out


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and the place of each value among them; by a table where the range is small."""
    top = int(x.max()) + 1 if len(x) else 0
    if top > 1 << 22:
        values, rank = np.unique(x, return_inverse=True)
        return values.astype(np.int64), rank
    there = np.zeros(top, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code point; 0 stands for the space between words."""
    lanes = np.arange(DIMENSIONS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mix(mix(codes.astype(np.uint64)[:, None] + np.uint64(0x51ED27)) + lanes[None, :])
    return np.unpackbits(h.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def bundle(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the bundled vector (float32) and the number of trigrams. A null or a text without letters has none."""
    text = pc.utf8_lower(pc.fill_null(text, ""))
    b, offsets = buffer(text)
    n = len(text)
    codes = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[offsets]
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    c = np.where(_is_letter(codes), codes, 0) if len(codes) else codes
    # a space before each document, so that its first letters and the last of the one before it are parted
    c, doc = np.insert(c, at[:-1], 0), np.insert(doc, at[:-1], np.arange(n, dtype=np.int32))
    c, doc = np.append(c, 0), np.append(doc, n)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])
    c, doc = c[keep], doc[keep]
    if len(c) < 3:
        return np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, np.int64)
    alphabet, rank = _ranks(c)
    r = len(alphabet)
    gram = (rank[:-2] * r + rank[1:-1]) * r + rank[2:]
    owner = doc[:-2]
    # the trigram that ends with the space after a document's last letter counts; one around a lone space does not
    good = ((owner == doc[2:]) | ((c[2:] == 0) & (owner == doc[1:-1]))) & (c[1:-1] != 0)
    gram, owner = gram[good], owner[good]
    grams, where = _ranks(gram)
    letters = letter_vectors(alphabet)
    once = letters[:, _PERM]
    twice = once[:, _PERM]
    out = np.zeros((n, DIMENSIONS), np.float32)
    step = max(1, HELD // max(n, DIMENSIONS))
    owner = owner.astype(np.int64)
    for low in range(0, len(grams), step):
        g = grams[low : low + step]
        mine = slice(None) if len(g) == len(grams) else (where >= low) & (where < low + step)
        v = (twice[g // (r * r)] * once[g // r % r] * letters[g % r]).astype(np.float32)
        counts = np.bincount(owner[mine] * len(g) + where[mine] - low, minlength=n * len(g)).reshape(n, -1).astype(np.float32)
        out += counts @ v
    return out, np.bincount(owner, minlength=n)


def floors(n: np.ndarray, repeat: float) -> np.ndarray:
    """The cosine that a text of n trigrams must reach, where two trigrams of a language are equal with probability `repeat`."""
    expected = np.sqrt(n * repeat / np.maximum(n * repeat + 1 - repeat, 1e-9))
    return FLOOR * expected - DEVIATIONS / np.sqrt(DIMENSIONS) * (1 - expected)


def prototypes(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """Languages in order, their unit prototypes and the probability that two trigrams of a document are equal, from about `sample` labelled documents each (all, where there are
    fewer), picked by a hash of doc_id. Every label has one, however rare. Only one sum of DIMENSIONS + 2 numbers a language reaches the driver."""
    counts = {r[0]: r[1] for r in docs.filter("lang is not null").groupBy("lang").count().collect()}
    rates = {k: min(1.0, sample / v) for k, v in counts.items()}
    if not rates:
        return [], np.zeros((0, DIMENSIONS), np.float32), 0.0
    spark = docs.sparkSession
    few = spark.createDataFrame([(k, float(r)) for k, r in rates.items()], "_label string, _rate double")
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1_000_000)) / F.lit(1e6)
    picked = texts(docs, "doc_id", "lang", "text").join(F.broadcast(few), F.col("lang") == F.col("_label")).filter(share < F.col("_rate")).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for piece in slices(batches, "text"):
            v, n = bundle(piece.column("text"))
            size = np.linalg.norm(v, axis=1, keepdims=True)
            # the longer a text, the less chance is in its direction: bundled by the root of its length
            v = np.concatenate([v / np.maximum(size, 1e-9) * np.sqrt(n)[:, None], size**2 / DIMENSIONS - n[:, None], (n * (n - 1.0))[:, None]], axis=1)
            names = np.array(piece.column("lang").to_pylist())
            for k in np.unique(names):
                total[k] = total.get(k, 0) + v[names == k].sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = arrow(picked, sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    made = {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in rows}
    names = sorted(k for k, v in made.items() if np.linalg.norm(v[:DIMENSIONS]) > 0)
    # sums in another order differ in the last digits; rounding makes the prototypes the same in every run
    p = np.array([np.round(made[k][:DIMENSIONS] / np.linalg.norm(made[k][:DIMENSIONS]), 7) for k in names], np.float32).reshape(len(names), DIMENSIONS)
    equal, pairs = sum(made[k][-2] for k in names), sum(made[k][-1] for k in names)
    return names, p, round(min(max(equal / pairs, 0.0), 1.0), 7) if names and pairs else 0.0


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row for each row of docs: doc_id, lang (as declared), language, cosine and margin (over the second language),
    trigrams, keep.

    keep is false only for texts without letters and texts whose largest cosine is under the floor for their length, which
    is under 0 for a few words; a declared language that differs is no reason to reject. A null or empty text: language null, cosine 0, keep false. Repeated rows
    give repeated rows, a null doc_id or lang is carried along. Equal cosines: the first language by name. Without any
    labelled row, language is null and every text with letters is kept. An empty table gives an empty table.
    """
    names, protos, repeat = prototypes(docs, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            v, n = bundle(piece.column("text"))
            rows = len(n)
            if names:
                cos = (v @ protos.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                best = cos.argmax(1)
                top = cos[np.arange(rows), best].astype(np.float64)
                rest = cos.copy()
                rest[np.arange(rows), best] = -1
                margin = np.where(len(names) > 1, top - rest.max(1), top)
                language = [names[k] if m else None for k, m in zip(best, n)]
                keep = (n > 0) & (top >= floors(n, repeat))
            else:
                top, margin, language, keep = np.zeros(rows), np.zeros(rows), [None] * rows, n > 0
            some = n > 0
            yield batch(SCHEMA, piece.column("doc_id"), piece.column("lang"), language, np.round(np.where(some, top, 0), 4), np.round(np.where(some, margin, 0), 4), n.astype(np.int64), keep)

    return arrow(texts(docs, "doc_id", "lang", "text"), score, "doc_id bigint, lang string, language string, cosine double, margin double, trigrams bigint, keep boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the rows that identify() rejects, all columns as they were. Null and empty
    texts go, repeated rows and rows with a null doc_id or lang are judged by their text like others."""
    names, protos, repeat = prototypes(docs)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        out = []
        for piece in slices([pa.RecordBatch.from_arrays([text], names=["text"])], "text"):
            v, n = bundle(piece.column("text"))
            top = ((v @ protos.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]).max(1) if names else np.ones(len(n))
            out.append((n > 0) & (top >= floors(n, repeat)))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(known(F.col("text")))
