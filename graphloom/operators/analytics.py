"""PageRank, betweenness, communities, elementary cycles and the centrality table."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from .components import checkpoint_dir, connected_components
from .graph import both_ways, file_graph, in_out_degrees

#: Nodes and edges up to which all rounds of PageRank run in one task; beyond, a round is a join.
PACKED = 1_000_000
#: Undirected edges up to which betweenness sends the whole adjacency to every task; beyond, it runs as joins.
ADJACENCY = 2_000_000


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, every: int = 5, packed: int = PACKED) -> DataFrame:
    """(id, rank) by power iteration from 1/N, dangling rank spread evenly; stops when the sum of changes is under the
    tolerance (not scaled by N) or after the rounds. tolerance None: always all rounds.

    The edges are checkpointed once and counted. A graph of at most `packed` nodes and edges is one task's work. Of a larger
    one a round is one join and one aggregation, and one row of sums
    reaches the driver. Lineage is cut every few rounds."""
    checkpoint_dir(nodes.sparkSession)
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    edges = edges.select("src", "dst").distinct().checkpoint()
    if n + edges.count() <= packed:
        return _packed_pagerank(nodes, edges, n, alpha, rounds, tolerance)
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = edges.join(out, "src").select("src", "dst", "out").checkpoint()
    base = nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling")).checkpoint()
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    lost = ranks.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for i in range(rounds):
        share = ranks.select(F.col("id").alias("src"), "rank").join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = ranks.join(share, "id", "left").select("id", "dangling", F.col("rank").alias("old"), (F.lit((1 - alpha + alpha * lost) / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = new.checkpoint() if tolerance is not None or (i + 1) % every == 0 else new.cache()
        row = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        lost, ranks = row[1], new.drop("old")
        if tolerance is not None and row[0] < tolerance:
            break
    return ranks.select("id", "rank")


def _packed_pagerank(nodes: DataFrame, edges: DataFrame, n: int, alpha: float, rounds: int, tolerance: float | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        known = pc.is_null(table.column("dst"))
        ids = table.filter(known).column("src").combine_chunks()
        links = table.filter(pc.invert(known))
        src, dst = (pc.index_in(links.column(c), value_set=ids).to_numpy() for c in ("src", "dst"))
        out = np.bincount(src, minlength=n)
        rank, ends = np.full(n, 1.0 / n), out == 0
        for _ in range(rounds):
            new = (1 - alpha + alpha * rank[ends].sum()) / n + alpha * np.bincount(dst, rank[src] / out[src], n)
            moved, rank = np.abs(new - rank).sum(), new
            if tolerance is not None and moved < tolerance:
                break
        yield pa.RecordBatch.from_arrays([ids, pa.array(rank)], names=["id", "rank"])

    rows = nodes.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")).union(edges)
    return rows.coalesce(1).mapInArrow(run, "id string, rank double")


def undirected(edges: DataFrame) -> DataFrame:
    """Each undirected pair once, without self-loops."""
    return edges.filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def twins(pairs: DataFrame) -> DataFrame:
    """(id, head, size) of every node of the pairs: nodes with the same neighbours form a class, which its least node heads.
    Neighbours are compared by their number and two sums of hashes, so that no task holds those of a node."""
    h = [F.sum(F.xxhash64(*seed, "dst").cast("decimal(38,0)")).alias(c) for c, seed in (("h", ()), ("g", (F.lit(1),)))]
    prints = both_ways(pairs).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), *h)
    heads = prints.groupBy("n", "h", "g").agg(F.min("id").alias("head"), F.count("*").alias("size"))
    return prints.join(heads, ["n", "h", "g"]).select("id", "head", "size", "n")


def betweenness(nodes: DataFrame, edges: DataFrame, limit: int = ADJACENCY) -> DataFrame:
    """(id, betweenness) on the undirected projection, over unordered pairs, scaled by 2 / ((n - 1)(n - 2)), 6 digits.

    Nodes with the same neighbours have the same betweenness: the search runs over their classes, weighted by their sizes."""
    checkpoint_dir(nodes.sparkSession)
    pairs = undirected(edges).checkpoint()
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    classes = twins(pairs).checkpoint()
    head = classes.filter("id = head").select("head", "size", F.col("n").alias("links"))
    # the edges of a head stand for those of its class
    ends = both_ways(pairs).join(head.select(F.col("head").alias("src")), "src", "left_semi").join(classes.select(F.col("id").alias("dst"), F.col("head").alias("to")), "dst")
    near = ends.select("src", F.col("to").alias("dst")).distinct().checkpoint()
    sums = _packed_brandes(head, near) if near.count() <= 2 * limit else _joined_brandes(head, near)
    every = classes.join(sums.withColumnRenamed("id", "head"), "head").select("id", "sum")
    return nodes.select("id").join(every, "id", "left").select("id", F.round(F.coalesce("sum", F.lit(0.0)) * scale, 6).alias("betweenness"))


def _packed_brandes(heads: DataFrame, near: DataFrame) -> DataFrame:
    """Sources (head, size, links) spread over tasks, each with the (size-checked) adjacency of classes; partial sums are added up.

    Other nodes of the source's class are two steps away, behind all its neighbours, and lie on no shortest path."""
    spark = heads.sparkSession
    around: dict[str, list[str]] = {}
    for a, b in near.orderBy("src", "dst").toLocalIterator():
        around.setdefault(a, []).append(b)
    shared = spark.sparkContext.broadcast((around, {r["head"]: r["size"] for r in heads.select("head", "size").toLocalIterator()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (near, size), total = shared.value, {}
        for b in batches:
            for s, own, links in zip(*(b.column(c).to_pylist() for c in ("head", "size", "links"))):
                dist, paths, order, before = {s: 0}, {s: 1.0}, [s], {}
                for v in order:
                    through = paths[v] * (size[v] if v != s else 1)
                    for w in near.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            paths[w] = 0.0
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += through
                            before.setdefault(w, []).append(v)
                owed = dict.fromkeys(order, 0.0)
                for w in near.get(s, ()):
                    owed[w] = (own - 1) / links
                for w in reversed(order[1:]):
                    for v in before[w]:
                        owed[v] += paths[v] / paths[w] * size[w] * (1 + owed[w])
                    total[w] = total.get(w, 0.0) + own * owed[w]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.float64())], names=["id", "part"])

    spread = heads.repartition(max(spark.sparkContext.defaultParallelism, 1), "head")
    return spread.mapInArrow(run, "id string, part double").groupBy("id").agg(F.sum("part").alias("sum"))


def _joined_brandes(heads: DataFrame, near: DataFrame) -> DataFrame:
    """The same level by level for all sources at once, as joins: memory of a task does not bound the graph."""
    near = near.join(heads.select(F.col("head").alias("src"), F.col("size").alias("many")), "src").checkpoint()
    level = heads.select(F.col("head").alias("s"), F.col("head").alias("id"), F.col("size").alias("own"), ((F.col("size") - 1) / F.col("links")).alias("behind"), F.lit(1.0).alias("paths"), F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("d")).checkpoint()
    sizes = heads.select(F.col("head").alias("id"), "size")
    seen, levels, d = level, [level], 0
    while True:
        d += 1
        step = level.join(near, level["id"] == near["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.first("own").alias("own"), F.first("behind").alias("behind"), F.sum(F.col("paths") * F.col("size")).alias("paths"))
        step = step.join(seen.select("s", "id"), ["s", "id"], "left_anti").join(sizes, "id")
        level = step.select("s", "id", "own", "behind", "paths", "size", F.lit(d).alias("d")).checkpoint()
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level)
    owed = None
    done = []
    for level in reversed(levels):
        start = F.when(F.col("d") == 1, F.col("behind")).otherwise(0.0)
        if owed is None:
            now = level.withColumn("owed", start)
        else:
            below = owed.select(F.col("s").alias("ws"), F.col("id").alias("w"), F.col("paths").alias("w_paths"), F.col("size").alias("w_size"), F.col("owed").alias("w_owed"))
            got = level.select("s", "id", "paths").join(near, F.col("id") == F.col("src")).join(below, (F.col("s") == F.col("ws")) & (F.col("dst") == F.col("w"))).groupBy("s", "id").agg(F.sum(F.col("paths") / F.col("w_paths") * F.col("w_size") * (1 + F.col("w_owed"))).alias("got"))
            now = level.join(got, ["s", "id"], "left").withColumn("owed", start + F.coalesce("got", F.lit(0.0))).drop("got")
        owed = now.checkpoint()
        done.append(owed.filter("s != id").select("id", (F.col("owed") * F.col("own")).alias("owed")))
    every = done[0]
    for x in done[1:]:
        every = every.union(x)
    return every.groupBy("id").agg(F.sum("owed").alias("sum"))


def centrality(g: PropertyGraph, top: int = 0, sort_by: str = "pagerank", rounds: int = 100, tolerance: float | None = 1e-6, communities: DataFrame | None = None) -> DataFrame:
    """Path, pagerank, betweenness, in_degree, out_degree, community of every file, best first; ties by path."""
    files, edges = file_graph(g)
    sort_by = sort_by if sort_by in ("pagerank", "betweenness", "in_degree", "out_degree") else "pagerank"
    table = pagerank(files, edges, rounds=rounds, tolerance=tolerance).select("id", F.round("rank", 6).alias("pagerank"))
    table = table.join(betweenness(files, edges), "id").join(in_out_degrees(files, edges), "id")
    if communities is not None:
        table = table.join(communities.select(F.col("path").alias("id"), F.col("cid").alias("community")), "id", "left")
    else:
        table = table.withColumn("community", F.lit(-1))
    table = table.select(F.col("id").alias("path"), "pagerank", "betweenness", "in_degree", "out_degree", F.coalesce("community", F.lit(-1)).alias("community")).orderBy(F.desc(sort_by), "path")
    return table.limit(top) if top > 0 else table


def cycles(nodes: DataFrame, edges: DataFrame, shortest: int = 2, longest: int = 0) -> DataFrame:
    """(length, chain) of all elementary cycles of at least `shortest` nodes, each once, from its least node; chain is
    an array. Nodes that lie on no cycle are trimmed first; longest 0 is no limit, and then the number may be exponential."""
    checkpoint_dir(nodes.sparkSession)
    e = edges.select("src", "dst").distinct().checkpoint()
    count = e.count()
    while count:
        ends = e.select(F.col("dst").alias("src")).distinct()
        e = e.join(ends, "src", "left_semi")
        begins = e.select(F.col("src").alias("dst")).distinct()
        e = e.join(begins, "dst", "left_semi").select("src", "dst").checkpoint()
        before, count = count, e.count()
        if before == count:
            break
    e = e.persist()
    paths = e.filter("src <= dst").select(F.array("src").alias("chain"), "dst") if shortest < 2 else e.filter("src < dst").select(F.array("src").alias("chain"), "dst")
    found = [paths.filter("dst = chain[0]").select(F.lit(1).alias("length"), "chain")] if shortest < 2 else []
    paths = paths.filter("dst != chain[0]").select(F.concat("chain", F.array("dst")).alias("chain")).checkpoint()
    length = 2
    while not paths.isEmpty() and (not longest or length <= longest):
        step = paths.join(e, F.element_at("chain", -1) == e["src"]).select("chain", "dst")
        if length >= shortest:
            found.append(step.filter("dst = chain[0]").select(F.lit(length).alias("length"), "chain"))
        paths = step.filter("dst > chain[0] and not array_contains(chain, dst)").select(F.concat("chain", F.array("dst")).alias("chain")).checkpoint()
        length += 1
    if not found:
        return e.select(F.lit(0).alias("length"), F.array("src").alias("chain")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, cid) by Louvain on the undirected, unweighted file graph, a connected component a task; isolated files are
    communities of their own. Nodes are visited in order and ties go to the least community, so a run repeats; communities are numbered by
    their least node."""
    pairs = undirected(edges)
    parts = connected_components(pairs)
    total = pairs.count()

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        src, dst = (table.column(c).combine_chunks() for c in ("src", "dst"))
        ids = pc.unique(pa.chunked_array([src, dst]))
        ids = ids.take(pc.sort_indices(ids))
        a, b = (pc.index_in(x, value_set=ids).to_numpy() for x in (src, dst))
        # nodes are numbers in order of their names, a community is named after one of them
        row, col = np.concatenate([a, b]).astype(np.int64), np.concatenate([b, a]).astype(np.int64)
        weight, member, names = np.ones(len(row)), np.arange(len(ids)), np.arange(len(ids))
        while True:
            order = np.lexsort((col, row))
            label, moved = _local_moves(np.searchsorted(row[order], np.arange(len(names) + 1)), col[order], weight[order], total)
            if not moved:
                break
            kept, at = np.unique(label, return_inverse=True)
            member, names = at[member], names[kept]
            both, back = np.unique(at[row] * len(kept) + at[col], return_inverse=True)
            row, col, weight = both // len(kept), both % len(kept), np.bincount(back, weight)
        # members are numbered in order, so the first of a community is its least
        _, first, of = np.unique(member, return_index=True, return_inverse=True)
        return pa.table({"path": ids, "head": ids.take(pa.array(first[of]))})

    placed = pairs.join(parts.withColumnRenamed("node", "src"), "src").select("component", "src", "dst").groupBy("component").applyInArrow(solve, "path string, head string")
    every = nodes.select(F.col("id").alias("path")).join(placed, "path", "left").select("path", F.coalesce("head", "path").alias("head"))
    heads = every.select("head").distinct().orderBy("head")
    numbered = heads.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("head string, cid bigint")
    return every.join(numbered, "head").select("path", F.col("cid").cast("int").alias("cid"))


def _local_moves(at: np.ndarray, col: np.ndarray, weight: np.ndarray, total: float) -> tuple[np.ndarray, bool]:
    """The community of each node, and whether any has moved. Neighbours of node v are those from at[v] to at[v + 1]."""
    n = len(at) - 1
    degree = np.bincount(np.repeat(np.arange(n), np.diff(at)), weight, n)
    label, strength, sums = array("q", range(n)), array("d", degree.tobytes()), array("d", degree.tobytes())
    moved, again = False, True
    while again:
        again = False
        for v in range(n):
            own, low, high = label[v], at[v], at[v + 1]
            sums[own] -= strength[v]
            links: dict[int, float] = {}
            for u, x in zip(col[low:high].tolist(), weight[low:high].tolist()):
                if u != v:
                    links[label[u]] = links.get(label[u], 0.0) + x
            best, gain = own, links.get(own, 0.0) - strength[v] * sums[own] / (2 * total)
            for c in sorted(links):
                g = links[c] - strength[v] * sums[c] / (2 * total)
                if g > gain + 1e-7:
                    best, gain = c, g
            sums[best] += strength[v]
            if best != own:
                label[v], moved, again = best, True, True
    return np.frombuffer(label, np.int64), moved
