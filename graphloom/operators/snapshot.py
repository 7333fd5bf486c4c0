"""Change tracking: snapshot diff, incremental upsert, freshness, symbol diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, mtime): added, deleted, modified (another time, earlier or later) or
    unchanged. One full outer join."""
    o = old.select("path", F.col("mtime").alias("was"), F.lit(True).alias("had"))
    n = new.select("path", F.col("mtime").alias("now"), F.lit(True).alias("has"))
    status = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("modified")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def summary(diff: DataFrame) -> DataFrame:
    """One row of counts."""
    kinds = ("added", "modified", "deleted", "unchanged")
    return diff.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])


def remove_files(table: DataFrame, paths: DataFrame) -> DataFrame:
    """C4: rows of a table keyed by path without those of the files named; symbols go with their file."""
    return table.join(paths.select("path").distinct(), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """A parse table with deleted files gone and added and modified ones taken from `new`, which needs to hold only those."""
    touched = diff.filter("status != 'unchanged'")
    return remove_files(old, touched).unionByName(new.join(diff.filter("status in ('added', 'modified')").select("path"), "path", "left_semi"))


def freshness(old: DataFrame | None, new: DataFrame, age: float = 0.0) -> DataFrame:
    """(indexed, age_s, stale, files_changed); without an old snapshot nothing counts as stale."""
    if old is None:
        return new.sparkSession.createDataFrame([(False, float(age), False, 0)], "indexed boolean, age_s double, stale boolean, files_changed bigint")
    changed = snapshot_diff(old, new).agg(F.count_if(F.col("status") != "unchanged").alias("files_changed"))
    return changed.select(F.lit(True).alias("indexed"), F.lit(float(age)).alias("age_s"), (F.col("files_changed") > 0).alias("stale"), "files_changed")


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, added, removed): new and deleted files, and changed ones with the name:type prints (path, print)
    that came and went, sorted; of any language."""
    files = snapshot_diff(old.select("path").distinct().withColumn("mtime", F.lit(0.0)), new.select("path").distinct().withColumn("mtime", F.lit(0.0)))
    came = new.select("path", "print").distinct().join(old.select("path", "print"), ["path", "print"], "left_anti").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("print")), " ").alias("added"))
    went = old.select("path", "print").distinct().join(new.select("path", "print"), ["path", "print"], "left_anti").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("print")), " ").alias("removed"))
    joined = files.join(came, "path", "left").join(went, "path", "left")
    kind = F.when(F.col("status") == "added", "new").when(F.col("status") == "deleted", "deleted").when(F.col("added").isNotNull() | F.col("removed").isNotNull(), "changed")
    shown = [F.when(kind == "changed", F.coalesce(c, F.lit("-"))).otherwise("-").alias(c) for c in ("added", "removed")]
    return joined.select("path", kind.alias("status"), *shown).filter("status is not null")


def index_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, delta) of two stats tables (key, value)."""
    b, a = before.withColumnRenamed("value", "was"), after.withColumnRenamed("value", "now")
    return b.join(a, "key", "full_outer").select("key", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).cast("bigint").alias("delta"))
