"""From target strings to nodes (Q9 to Q12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph


def resolve(g: PropertyGraph, target: str) -> DataFrame:
    """Q9: nodes whose id is the target, or else that without leading dots and slashes, or else with slashes turned; or
    else all symbols of that name. The first way that finds something counts; one pass over the nodes."""
    ways = list(dict.fromkeys([target, target.lstrip("./"), target.replace("\\", "/")]))
    rank = F.coalesce(*[F.when(F.col("id") == w, F.lit(i)) for i, w in enumerate(ways)], F.when((F.col("ntype") == "symbol") & (F.col("name") == target), F.lit(len(ways))))
    hits = g.nodes.withColumn("rank", rank).filter("rank is not null")
    best = hits.agg(F.min("rank").alias("best"))
    return hits.join(F.broadcast(best), F.col("rank") == F.col("best")).drop("rank", "best").orderBy("seq")


def resolve_dotted(g: PropertyGraph, target: str) -> DataFrame:
    """Q10: for Parent.child the first symbol child in a file that also has a symbol Parent, or else in a path that holds
    the parent's name. Empty if there is no dot."""
    parent, dot, child = target.partition(".")
    if not (dot and parent and child):
        return g.nodes.limit(0)
    children = g.symbols.filter(F.col("name") == child)
    parents = g.symbols.filter(F.col("name") == parent).select("path").distinct().withColumn("beside", F.lit(0))
    ranked = children.join(parents, "path", "left").withColumn("rank", F.when(F.col("beside") == 0, 0).when(F.col("path").contains(parent), 1))
    return ranked.filter("rank is not null").orderBy("rank", "seq").limit(1).select(g.nodes.columns)


def resolve_one(g: PropertyGraph, target: str) -> DataFrame:
    """Q11: the node of that id, or else the first symbol of that name."""
    rank = F.when(F.col("id") == target, 0).when((F.col("ntype") == "symbol") & (F.col("name") == target), 1)
    return g.nodes.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "seq").limit(1).drop("rank")


def find(g: PropertyGraph, target: str) -> DataFrame:
    """What a context query takes: dotted first, then Q9."""
    dotted = resolve_dotted(g, target)
    return resolve(g, target) if dotted.isEmpty() else dotted


def candidates(matches: DataFrame) -> DataFrame:
    """Q12: the table that an ambiguous target is answered with."""
    return matches.select("name", F.col("stype").alias("type"), F.col("path").alias("file"), "line")
