"""Graphs, snapshots and usage logs as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..model import PropertyGraph


def save(df: DataFrame, path: str) -> None:
    """Writes beside the place and then takes it, so that a reader finds the old table or the new one, whole."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, new, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".new", ".old"))
    fs = to.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(to):
        fs.rename(to, old)
    fs.rename(new, to)
    fs.delete(old, True)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def save_graph(g: PropertyGraph, path: str) -> None:
    save(g.nodes, path + "/nodes")
    save(g.edges, path + "/edges")


def load_graph(spark: SparkSession, path: str) -> PropertyGraph | None:
    nodes, edges = load(spark, path + "/nodes"), load(spark, path + "/edges")
    return None if nodes is None or edges is None else PropertyGraph(nodes, edges)


def track_usage(spark: SparkSession, path: str, call_type: str, response_tokens: int) -> None:
    """Appends one call to the log."""
    spark.createDataFrame([(call_type, response_tokens)], "call_type string, response_tokens int").coalesce(1).write.mode("append").parquet(path)
