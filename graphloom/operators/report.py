"""Coverage, cost, audit, usage and visualization tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import LARGEST, PropertyGraph, tokens
from .graph import in_out_degrees

TEST_MARKS = ("test_", "_test.", "/test/", "/tests/", "/spec/", "_spec.")
AUDITED = ("python", "typescript", "javascript", "go", "rust", "java", "csharp", "kotlin", "scala", "php", "swift")
WEIGHTS = {"ast": 1.0, "treesitter": 0.8, "regex": 0.5, "convention": 0.3}
PALETTE = ("#88C0D0", "#A3BE8C", "#EBCB8B", "#D08770", "#B48EAD", "#5E81AC", "#BF616A", "#8FBCBB", "#81A1C1", "#E5E9F0")
NO_COMMUNITY = "#4C566A"
LINKED = ("imports", "uses", "extends", "calls", "tested_by")


def coverage(listing: DataFrame, known: Column, largest: int = LARGEST) -> DataFrame:
    """The listing with its bucket: symlink, no_parser, too_large (strictly larger) or indexed."""
    link = F.col("kind") == "symlink" if "kind" in listing.columns else F.lit(False)
    return listing.withColumn("bucket", F.when(link, "symlink").when(~known, "no_parser").when(F.col("size") > largest, "too_large").otherwise("indexed"))


def coverage_buckets(covered: DataFrame, by: str | None = None) -> DataFrame:
    return covered.groupBy(*([by] if by else []), "bucket").agg(F.count("*").alias("files"))


def coverage_percent(covered: DataFrame) -> DataFrame:
    """R2: (indexed, total, percent); 100 for no files."""
    counts = covered.agg(F.count_if(F.col("bucket") == "indexed").alias("indexed"), F.count("*").alias("total"))
    return counts.select("indexed", "total", F.when(F.col("total") == 0, 100.0).otherwise(F.bround(F.col("indexed") * 100.0 / F.col("total"), 1)).alias("percent"))


def coverage_examples(covered: DataFrame, n: int = 5) -> DataFrame:
    """R2: the first n paths of each bucket but indexed."""
    w = Window.partitionBy("bucket").orderBy("path")
    return covered.filter("bucket != 'indexed'").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n).select("bucket", "n", "path")


def savings(files: DataFrame, imports: DataFrame, context: DataFrame) -> DataFrame:
    """Per focus file what reading it and its imports costs against the context answer plus the file.

    files (path, chars), imports (src, dst), context (path, context_tokens). Columns: path, manual_tokens, query_tokens,
    saved_tokens, saved_pct, hidden_callers (files that import it, which reading by hand would miss)."""
    cost = files.select("path", tokens(F.col("chars")).alias("own"))
    read = imports.join(cost.select(F.col("path").alias("dst"), F.col("own").alias("other")), "dst").groupBy(F.col("src").alias("path")).agg(F.sum("other").alias("others"))
    callers = imports.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("hidden_callers"))
    joined = cost.join(context, "path").join(read, "path", "left").join(callers, "path", "left").fillna(0, ["others", "hidden_callers"])
    manual, query = F.col("own") + F.col("others"), F.col("context_tokens") + F.col("own")
    return joined.select("path", manual.alias("manual_tokens"), query.alias("query_tokens"), (manual - query).alias("saved_tokens"), F.bround((manual - query) * 100.0 / manual, 1).alias("saved_pct"), "hidden_callers")


def grep_cost(files: DataFrame, pattern: str) -> DataFrame:
    """What a text search for the pattern costs: (files, lines, output_tokens, read_tokens); files (path, content). The
    pattern is matched line by line."""
    lines = files.select("path", F.length("content").alias("chars"), F.explode(F.split("content", "\n")).alias("line")).filter(F.col("line").rlike(pattern))
    hits = lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.length("line") + F.length("path") + 2).alias("shown"), F.max("chars").alias("chars"))
    return hits.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), tokens(F.coalesce(F.sum("shown"), F.lit(0))).alias("output_tokens"), F.coalesce(F.sum(tokens(F.col("chars"))), F.lit(0)).alias("read_tokens"))


def audit_sample(files: DataFrame, imports: DataFrame, n: int = 5, least: int = 500) -> DataFrame:
    """(path, imports, tokens) of n files spread evenly over the importers, those with most imports first: every s-th,
    s = max(1, total / 2n), of at least `least` tokens; if none is that large, the first n. files (path, language, chars)."""
    mark = F.lit(False)
    for m in TEST_MARKS:
        mark = mark | F.col("path").contains(m)
    out = imports.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("imports"))
    ranked = files.filter(~mark & F.lower("language").isin(*AUDITED)).join(out, "path").select("path", "imports", tokens(F.col("chars")).alias("tokens")).orderBy(F.desc("imports"), "path")
    total = ranked.count()
    step = max(1, total // (2 * n))
    # numbering a global order needs one more pass over the partitions' sizes, not one task for all rows
    numbered = ranked.rdd.zipWithIndex().filter(lambda x: x[1] % step == 0).map(lambda x: (*x[0], x[1])).toDF("path string, imports bigint, tokens bigint, n bigint")
    picked = numbered.filter(F.col("tokens") >= least).orderBy("n").limit(n).select("path", "imports", "tokens")
    return ranked.limit(n) if picked.isEmpty() else picked


def tax_verdict(baseline: Column) -> Column:
    """R8."""
    return F.when(baseline <= 1500, "healthy").when(baseline <= 2000, "warn").otherwise("over")


def usage(log: DataFrame) -> DataFrame:
    """Per call type calls, tokens and answers of under 200 tokens."""
    return log.groupBy("call_type").agg(F.count("*").alias("calls"), F.sum("response_tokens").alias("tokens"), F.count_if(F.col("response_tokens") < 200).alias("small"))


def viz_nodes(g: PropertyGraph, ranks: DataFrame, communities: DataFrame | None = None, most: int = 8) -> DataFrame:
    """Files with label, colour, radius by scaled PageRank, degrees over all edge types and the first `most` symbols
    they lead to."""
    span = ranks.agg(F.min("pagerank").alias("low"), F.max("pagerank").alias("high"))
    wide = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    files = g.files.join(ranks, "id", "left").fillna(0.0, ["pagerank"]).crossJoin(F.broadcast(span)).withColumn("radius", F.round(6 + 22 * (F.col("pagerank") - F.col("low")) / wide, 2)).drop("low", "high")
    if communities is not None:
        files = files.join(communities.select(F.col("path").alias("id"), F.col("cid").alias("community")), "id", "left").fillna(-1, ["community"])
    else:
        files = files.withColumn("community", F.lit(-1))
    color = F.when(F.col("community") < 0, F.lit(NO_COMMUNITY)).otherwise(F.get(F.array(*map(F.lit, PALETTE)), F.col("community") % len(PALETTE)))
    # only what a file leads to is gathered
    led = g.edges.select(F.col("src").alias("id"), F.col("dst")).join(g.files.select("id").hint("merge"), "id", "left_semi").join(g.symbols.select(F.col("id").alias("dst"), "name", "stype", "seq"), "dst").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "name", "stype"))), 1, most).alias("e"))
    joined = files.join(in_out_degrees(g.nodes, g.edges), "id").join(led, "id", "left")
    exports = F.coalesce(F.array_join(F.transform("e", lambda x: F.concat(x["name"], F.lit(":"), x["stype"])), " "), F.lit(""))
    return joined.select("id", F.element_at(F.split("id", "/"), -1).alias("label"), "language", "subproject", "community", color.alias("color"), "radius", "pagerank", "in_degree", "out_degree", exports.alias("exports"))


def viz_links(g: PropertyGraph) -> DataFrame:
    """(source, target, etype, evidence, weight) between files."""
    files = g.files.select("id")
    inside = g.of_types(*LINKED).join(files.withColumnRenamed("id", "src"), "src", "left_semi").join(files.withColumnRenamed("id", "dst"), "dst", "left_semi")
    weight = F.coalesce(*[F.when(F.col("evidence") == k, F.lit(v)) for k, v in WEIGHTS.items()], F.lit(0.4))
    return inside.select(F.col("src").alias("source"), F.col("dst").alias("target"), "etype", F.coalesce("evidence", F.lit("")).alias("evidence"), weight.alias("weight"))
