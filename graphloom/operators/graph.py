"""Traversals and counts of a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DERIVED, FILE_DEPS, PropertyGraph
from .components import checkpoint_dir


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(g: PropertyGraph) -> DataFrame:
    """(id, degree) of every node, over all edge types, in and out; a self-loop counts twice."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return g.nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def in_out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree); one pass over the edges for both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(counts, "id", "left").fillna(0, ["in_degree", "out_degree"])


def file_graph(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """The file nodes and the dependency edges between files."""
    files = g.files.select("id")
    edges = g.of_types(*FILE_DEPS).select("src", "dst", "etype")
    # never broadcast: files may be as many as edges, whatever the size of the compressed table that they are read from
    known = files.hint("merge")
    inside = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return files, inside


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 0, held: bool = False) -> DataFrame:
    """(id, hop) of what seeds (id) reach along edges (src, dst) in at most depth hops; 0 is no limit. Breadth first, a join
    of the frontier a round; each round is checkpointed, so neither its lineage nor a lost executor repeats earlier ones, and
    so are the edges, which otherwise were derived anew for each, unless they are `held` in a table already."""
    checkpoint_dir(edges.sparkSession)
    edges = edges.select("src", "dst") if held else edges.select("src", "dst").checkpoint()
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0)).checkpoint()
    frontier, hop = seen, 0
    while not depth or hop < depth:
        hop += 1
        step = frontier.select(F.col("id").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def khop(g: PropertyGraph, seeds: DataFrame, depth: int = 2, held: bool = False) -> DataFrame:
    """G1: (id, hop) within depth hops over all edge types in either direction."""
    return reach(both_ways(g.edges), seeds, depth, held) if depth else seeds.select("id", F.lit(0).alias("hop"))


def induced(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The nodes named and all edges between them."""
    keep = ids.select("id").distinct()
    edges = g.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(g.nodes.join(keep, "id", "left_semi"), edges.select("src", "dst", "etype", "evidence"))


def impact(g: PropertyGraph, seeds: DataFrame, depth: int = 0) -> DataFrame:
    """(id, ntype, hops) of all that depends on the seeds, which are left out themselves. A seed without dependency
    edges affects nothing."""
    back = g.of_types(*DERIVED).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(back, seeds, depth).filter("hop > 0")
    return found.join(g.nodes.select("id", "ntype"), "id").select("id", "ntype", F.col("hop").alias("hops"))


def shortest_path(g: PropertyGraph, source: str, dest: str) -> tuple[list[str], list[tuple]] | None:
    """Node ids and (src, dst, etype, evidence) of each hop of a shortest dependency path; of several, the one whose
    nodes have the least predecessors. None if there is none."""
    checkpoint_dir(g.spark)
    edges = g.of_types(*DERIVED).select("src", "dst", "etype", "evidence").checkpoint()
    known = {r[0] for r in g.nodes.filter(F.col("id").isin(source, dest)).select("id").collect()}
    if not {source, dest} <= known:
        return None
    seen = g.spark.createDataFrame([(source, None, 0)], "id string, parent string, hop int").checkpoint()
    frontier, hop = seen, 0
    while source != dest:
        hop += 1
        step = frontier.select(F.col("id").alias("src")).join(edges.select("src", "dst"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        if frontier.isEmpty():
            return None
        seen = seen.union(frontier)
        if not frontier.filter(F.col("id") == dest).isEmpty():
            break
    # back along the parents: one chain of joins, each of one row, in one job
    back = seen.filter(F.col("id") == dest).select(F.col("id").alias(f"n{hop}"), F.col("parent").alias(f"n{hop - 1}"))
    for h in range(hop - 1, 0, -1):
        step = seen.filter(F.col("hop") == h).select(F.col("id").alias(f"n{h}"), F.col("parent").alias(f"n{h - 1}"))
        back = back.join(step, f"n{h}")
    path = list(back.select(*[f"n{h}" for h in range(hop + 1)]).first()) if hop else [dest]
    hops = list(zip(path, path[1:]))
    found = {(r.src, r.dst): r for r in edges.filter(F.struct("src", "dst").isin([F.struct(F.lit(a), F.lit(b)) for a, b in hops])).collect()} if hops else {}
    return path, [(a, b, found[a, b].etype, found[a, b].evidence) for a, b in hops]


def stats(g: PropertyGraph) -> DataFrame:
    """(key, value) counts of files, symbols, edges, edges by type and distinct subprojects."""
    nodes = g.nodes.agg(F.count_if(F.col("ntype") == "file").alias("files"), F.count_if(F.col("ntype") == "symbol").alias("symbols"), F.count_distinct(F.when((F.col("ntype") == "file") & (F.col("subproject") != ""), F.col("subproject"))).alias("subprojects"))
    flat = nodes.select(F.explode(F.create_map(*[x for c in nodes.columns for x in (F.lit(c), F.col(c))])).alias("key", "value"))
    kinds = g.edges.groupBy("etype").count()
    return flat.union(kinds.select(F.concat(F.lit("edges_"), "etype"), "count")).union(kinds.agg(F.lit("edges"), F.coalesce(F.sum("count"), F.lit(0))))


BARRELS = ("__init__.py", "index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "mod.rs", "lib.rs")


def top_connected(g: PropertyGraph, barrels: tuple[str, ...] = BARRELS) -> DataFrame:
    """(id, degree) of the best connected file that is no barrel; of several the first in order."""
    base = F.element_at(F.split("path", "/"), -1)
    files = g.files.filter(~base.isin(*barrels)).join(degrees(g), "id")
    return files.orderBy(F.desc("degree"), "seq").limit(1).select("id", "degree")
