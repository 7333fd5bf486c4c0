"""From extracted facts to edges (E1 to E14), as joins.

listing (path, language, subproject, mtime, file_seq), extracted: a row a file as in model.EXTRACTED. Every "first match" is
a join and an aggregation by an explicit order; nothing relies on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import source_candidates, test_candidates, ts_candidates
from ..model import STRUCTURAL, PropertyGraph, is_test, one_edge_per_pair


def symbols_of(extracted: DataFrame, listing: DataFrame) -> DataFrame:
    """A row per symbol id; of several definitions of a name in a file the last in walk order stays, with the calls of all."""
    flat = extracted.select("path", F.posexplode("symbols").alias("sym_seq", "s"))
    last = flat.groupBy("path", F.col("s.name").alias("name")).agg(F.max_by("s", "sym_seq").alias("s"), F.min("sym_seq").alias("sym_seq"))
    calls = extracted.select("path", F.posexplode("calls").alias("n", "c")).groupBy("path", F.col("c.caller").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c.callee"))), lambda x: x["callee"]).alias("raw_calls"))
    out = last.join(calls, ["path", "name"], "left").join(listing.select("path", "file_seq", "language", "subproject"), "path")
    return out.select(F.concat("name", F.lit("@"), "path").alias("id"), "name", "s.stype", "path", "s.line", "s.signature", "s.extends_name", F.coalesce("raw_calls", F.array().cast("array<string>")).alias("raw_calls"), "s.intent", "s.decorators", "s.literals", "sym_seq", "file_seq", "language", "subproject")


def python_candidates(spec: Column, level: Column, path: Column) -> Column:
    """Where a module may lie: beside or above the file for relative imports, else under the root."""
    parts = F.split(spec, r"\.")
    folder = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    base = F.when(level > 0, F.slice(folder, 1, F.greatest(F.size(folder) - level + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    at = F.array_join(F.concat(base, parts), "/")
    return F.array(F.concat(at, F.lit(".py")), F.concat(at, F.lit("/__init__.py")))


def resolved_imports(extracted: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, target, names): each import with the first of its candidate paths that is listed."""
    flat = extracted.select("path", F.posexplode("imports").alias("n", "i")).select("path", "n", "i.*")
    found = F.when(F.col("kind") == "python", python_candidates(F.col("spec"), F.col("level"), F.col("path"))).when(F.col("kind") == "ts", ts_candidates("path", "spec")).otherwise(F.array("spec"))
    tried = flat.select("path", "n", "names", F.posexplode(found).alias("rank", "target"))
    # what is listed has as many rows as there are files, which the optimizer can't know of what Python returns: never broadcast
    known = listing.select(F.col("path").alias("target")).hint("merge")
    return tried.join(known, "target").groupBy("path", "n").agg(F.min_by(F.struct("target", "names"), "rank").alias("m")).select("path", "n", "m.target", "m.names")


def evidence(language: Column) -> Column:
    return F.when(language == "python", "ast").when(language.isin(*STRUCTURAL), "treesitter").otherwise("regex")


def derive_edges(listing: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """All edges, one per ordered pair. A file that imports a name from itself gets no edge for that."""
    langs = listing.select("path", "language")
    defines = symbols.select(F.col("path").alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("etype"), F.lit(None).cast("string").alias("evidence"))
    linked = imports.filter("path != target").join(langs, "path")
    imported = linked.select(F.col("path").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("etype"), evidence(F.col("language")).alias("evidence")).distinct()
    ids = symbols.select("id")
    used = linked.select("path", "language", F.explode("names").alias("name"), "target").select(F.col("path").alias("src"), F.concat("name", F.lit("@"), "target").alias("id"), evidence(F.col("language")).alias("evidence")).distinct()
    uses = used.join(ids, "id").select("src", F.col("id").alias("dst"), F.lit("uses").alias("etype"), "evidence")
    places = symbols.select(F.col("id").alias("dst"), "name", F.col("path").alias("at"), F.col("file_seq").alias("fs"), F.col("sym_seq").alias("ss"))
    # The parent in the same file, or else the first anywhere
    children = symbols.filter("extends_name is not null and extends_name != ''").select(F.col("id").alias("src"), F.col("path").alias("own"), "language", F.col("extends_name").alias("name"))
    extends = children.join(places, "name").groupBy("src", "language").agg(F.min(F.struct((F.col("at") != F.col("own")).alias("far"), "fs", "ss", "dst")).alias("m"))
    extends = extends.select("src", "m.dst", F.lit("extends").alias("etype"), evidence(F.col("language")).alias("evidence"))
    # The callee in the same file, or else the first of that name that the caller's file uses; the use must be the
    # edge that then stands between the two
    called = symbols.select(F.col("id").alias("src"), F.col("path").alias("own"), "language", F.explode(F.array_distinct("raw_calls")).alias("name"))
    local = called.select("src", "own", "language", "name", F.concat("name", F.lit("@"), "own").alias("dst"))
    here = local.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    there = called.join(here.select("src", "name"), ["src", "name"], "left_anti")
    through = uses.select(F.col("src").alias("own"), "dst").join(places, "dst").select("own", "name", "dst", "fs", "ss")
    there = there.join(through, ["own", "name"]).groupBy("src", "language", "name").agg(F.min(F.struct("fs", "ss", "dst")).alias("m")).select("src", "m.dst", "language")
    calls = here.select("src", "dst", "language").union(there).select("src", "dst", F.lit("calls").alias("etype"), evidence(F.col("language")).alias("evidence"))
    return one_edge_per_pair(defines.unionByName(imported).unionByName(uses).unionByName(extends).unionByName(calls).unionByName(test_edges(listing.select("path"))))


def test_edges(files: DataFrame) -> DataFrame:
    """Each source file's first listed test candidate and each test file's first listed source candidate make a
    tested_by edge and its reverse, tests."""
    known = files.select(F.col("path").alias("hit"))

    def first(side: DataFrame, names: Column) -> DataFrame:
        tried = side.select("path", F.posexplode(names).alias("rank", "hit"))
        return tried.join(known, "hit").groupBy("path").agg(F.min_by("hit", "rank").alias("hit"))

    of_tests = first(files.filter(is_test(F.col("path"))), source_candidates("path")).select(F.col("hit").alias("src"), F.col("path").alias("dst"))
    of_sources = first(files.filter(~is_test(F.col("path"))), test_candidates("path")).select(F.col("path").alias("src"), F.col("hit").alias("dst"))
    pairs = of_tests.union(of_sources).filter("src != dst").distinct()
    made = pairs.select("src", "dst", F.lit("tested_by").alias("etype")).union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("tests").alias("etype")))
    return made.withColumn("evidence", F.lit("convention"))


def link(listing: DataFrame, extracted: DataFrame) -> PropertyGraph:
    """A graph from a listing and its extracted facts; edges are always derived anew, nothing is parsed again."""
    symbols = symbols_of(extracted, listing)
    edges = derive_edges(listing, symbols, resolved_imports(extracted, listing))
    order = F.lpad(F.col("file_seq").cast("string"), 12, "0")
    files = listing.select(F.col("path").alias("id"), F.lit("file").alias("ntype"), F.col("path").alias("name"), "path", "language", "subproject", order.alias("seq"))
    syms = symbols.withColumn("ntype", F.lit("symbol")).withColumn("seq", F.concat(order, F.lit("#"), F.lpad(F.col("sym_seq").cast("string"), 9, "0"))).drop("file_seq", "sym_seq")
    return PropertyGraph(files.unionByName(syms, allowMissingColumns=True), edges)


def literals_of(symbols: DataFrame) -> DataFrame:
    """(id, value, line, seq) of all literals of symbols."""
    return symbols.filter("literals is not null").select("id", "seq", F.explode("literals").alias("l")).select("id", "l.value", "l.line", "seq")


def codebase_fit(files: DataFrame) -> DataFrame:
    """Files, est_tokens (500 a file) and the verdict on the size."""
    n = F.col("files")
    return files.agg(F.count("*").alias("files")).select("files", (n * 500).alias("est_tokens"), F.when((n < 40) | (n * 500 < 60_000), "small").when(n < 150, "medium").otherwise("large").alias("verdict"))
