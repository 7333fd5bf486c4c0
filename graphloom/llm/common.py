"""Helpers that the operators share: the shared folder, column names that cannot clash, streams of sorted Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that written() has made in this process and release() has not deleted.
_WRITTEN: list[str] = []
#: Whether Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; only where that is unset (tests, one
    machine) a folder of our own, which then is made the session's checkpoint folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if not at and known.isDefined():
        at = known.get()
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="graphloom-")
    if not known.isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage and survives the loss of executors. The shuffle files
    that it was made from go as soon as it is there, and not when the driver happens to collect its garbage."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(_CLEANUP, before)
    _WRITTEN.append(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, since: int, *names: str) -> None:
    """Deletes the tables of these names written since there were `since` tables: what was made of them must be written."""
    gone = [at for at in _WRITTEN[since:] if at.rpartition("/")[2].rpartition("-")[0] in names]
    for at in gone:
        _delete(spark, at)
        _WRITTEN.remove(at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables written since there were `since` of them, but for the last `keep`. Only for a caller that has
    written, as one of those kept, all that it wants of them."""
    for at in _WRITTEN[since : len(_WRITTEN) - keep]:
        _delete(spark, at)
    del _WRITTEN[since : len(_WRITTEN) - keep]


def tables() -> int:
    """How many tables written() has made that are still there."""
    return len(_WRITTEN)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, text last; other columns of df never reach Python."""
    return spread(df.select(*[F.col(f"`{c}`") for c in columns]))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as tasks run at once. Only a table that is read in fewer pieces than that is moved, and
    none whose partitions are not known before it is computed."""
    plan = df._jdf.queryExecution().sparkPlan()
    for line in plan.toString().splitlines():
        if not re.match(r"[\s:|+*()\d-]*(?:Project|Filter|FileScan|Batched: |Location|PartitionFilters|PushedFilters|ReadSchema)", line):
            return df
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df._jdf.queryExecution().toRdd().getNumPartitions() < most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about `most` bytes of the column; a longer text is a batch of its own, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], most: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream that is sorted by keys: rows of a group are never split, and small groups
    come many at a time, so that work on them can be vectorised."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            last = int(cuts[-1])
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
            rows = table.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys start in sorted columns, with the length at the end."""
    n = len(columns[0])
    change = np.ones(n, bool)
    if n:
        change[1:] = False
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def batch(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for (_, t), c in zip(schema, columns)], names=[n for n, _ in schema])


def single(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with one row for each key that is not null, of several the one with the least hash. Where no key is repeated,
    nothing but the keys is shuffled."""
    ids = docs.filter(F.col(f"`{key}`").isNotNull()).groupBy(key).agg(F.count("*").alias("copies"))
    if ids.filter("copies > 1").isEmpty():
        return docs.filter(F.col(f"`{key}`").isNotNull())
    return once_per_id(docs, ids, key)


def once_per_id(docs: DataFrame, decided: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in `decided` (key, copies), one per key, of several the one with the least hash: only
    keys that several rows carry, if there are any, are shuffled for that, and combined before."""
    (k, n) = fresh(docs, "_keep_id", "_copies")
    d = decided.select(F.col(key).alias(k), F.col("copies").alias(n))
    kept = docs.join(d, F.col(f"`{key}`") == F.col(k), "inner")
    if not decided.filter("copies > 1").limit(1).count():
        return kept.select(docs.columns)
    one = kept.filter(F.col(n) == 1).select(docs.columns)
    # rows of one key may differ: the one with the least hash stays, whatever their order
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = kept.filter(F.col(n) > 1).groupBy(F.col(k).alias(k)).agg(F.min_by(row, hashed).alias(n)).select(f"{n}.*")
    return one.union(several)
