"""Ranked name search, literal search and suggestions (Q1 to Q8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from .graph import degrees

SIGNATURE, INTENT = 80, 80


def score(hay: Column, needle: str) -> Column:
    """Q1: 3 equal, 2 begins with it, 1 holds it, 0 none of these; the case is the caller's."""
    return F.when(hay == needle, 3).when(hay.startswith(needle), 2).when(hay.contains(needle), 1).otherwise(0)


def _best(nodes: DataFrame, g: PropertyGraph, limit: int) -> DataFrame:
    """The first `limit` by score, then degree, then order. Degrees are counted for the hits alone."""
    hits = nodes.filter("score > 0")
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    ranked = hits.join(ends, "id", "left").fillna(0, ["degree"])
    return ranked.orderBy(F.desc("score"), F.desc("degree"), "seq").limit(limit)


def _of_subproject(nodes: DataFrame, g: PropertyGraph, subproject: str | None) -> DataFrame:
    """Symbols belong to the subproject of their file."""
    if not subproject:
        return nodes
    files = g.files.filter(F.col("subproject") == subproject).select(F.col("id").alias("path")).distinct()
    return nodes.join(files, "path", "left_semi")


def search_files(g: PropertyGraph, query: str, limit: int = 20, subproject: str | None = None) -> DataFrame:
    """Q2, Q4: path, language, exports, imported_by, score, degree of the best files; counts are joined after the limit."""
    needle = query.strip().lower()
    files = _of_subproject(g.files.withColumn("path", F.col("id")), g, subproject)
    hits = _best(files.withColumn("score", score(F.lower("id"), needle) if needle else F.lit(0)), g, limit).select("id", "language", "score", "degree", "seq")
    exports = g.of_types("defines").join(hits.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("exports"))
    importers = g.of_types("imports").join(hits.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("imported_by"))
    out = hits.join(exports, "id", "left").join(importers, "id", "left").fillna(0, ["exports", "imported_by"])
    # joins keep no order; these are `limit` rows
    out = out.orderBy(F.desc("score"), F.desc("degree"), "seq")
    return out.select(F.col("id").alias("path"), "language", "exports", "imported_by", "score", "degree")


def decorated_score(needle: str) -> Column:
    """Q3: (score, via): the name, then each decorator and its arguments in order; a later one only if it scores more."""
    own = F.struct(score(F.lower("name"), needle).alias("score"), F.lit("").alias("via"))
    parts = F.flatten(
        F.transform(
            F.coalesce("decorators", F.array().cast("array<struct<name:string,args:array<string>>>")),
            lambda d: F.concat(
                F.array(F.struct(score(F.lower(d["name"]), needle).alias("score"), F.concat(F.lit("@"), d["name"]).alias("via"))),
                F.transform(F.coalesce(d["args"], F.array().cast("array<string>")), lambda a: F.struct(score(F.lower(a), needle).alias("score"), F.concat(F.lit("@"), d["name"], F.lit("("), a, F.lit(")")).alias("via"))),
            ),
        )
    )
    return F.aggregate(parts, own, lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best))


def short(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))


def search_symbols(g: PropertyGraph, query: str, limit: int = 20, subproject: str | None = None) -> DataFrame:
    """Q2, Q3, Q5: name, type, file, signature, callers, intent, via, score, degree of the best symbols."""
    needle = query.strip().lower()
    symbols = _of_subproject(g.symbols, g, subproject)
    if not needle:
        symbols = symbols.withColumn("hit", F.struct(F.lit(0).alias("score"), F.lit("").alias("via")))
    elif "decorators" in symbols.columns:
        symbols = symbols.withColumn("hit", decorated_score(needle))
    else:
        symbols = symbols.withColumn("hit", F.struct(score(F.lower("name"), needle).alias("score"), F.lit("").alias("via")))
    hits = _best(symbols.withColumn("score", F.col("hit.score")), g, limit)
    callers = g.of_types("uses", "calls").join(hits.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    out = hits.join(callers, "id", "left").fillna(0, ["callers"]).orderBy(F.desc("score"), F.desc("degree"), "seq")
    return out.select("name", F.col("stype").alias("type"), F.col("path").alias("file"), short(F.col("signature"), SIGNATURE).alias("signature"), "callers", F.substring(F.coalesce("intent", F.lit("")), 1, INTENT).alias("intent"), F.col("hit.via").alias("via"), "score", "degree")


def literal_index(literals: DataFrame) -> DataFrame:
    """(key, value, id, line, seq): postings by lower-case value."""
    return literals.withColumn("key", F.lower("value"))


def is_literal_query(query: str) -> bool:
    q = query.strip()
    return len(q) > 2 and q[0] == q[-1] == '"'


def search_literals(index: DataFrame, symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Q6: value, symbol, file, line of literals that hold the quoted text, in order; those of unknown symbols are skipped."""
    needle = query.strip()[1:-1].lower()
    hits = index.filter(F.col("key").contains(needle)).join(symbols.select("id", F.col("name").alias("symbol"), F.col("path").alias("file")), "id")
    return hits.orderBy("seq", "line", "value").limit(limit).select("value", "symbol", "file", "line")


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def did_you_mean(g: PropertyGraph, target: str, limit: int = 3) -> DataFrame:
    """Q7: (label, score, degree) of the nodes nearest to a name that is not known; case and signs do not count."""
    needle = "".join(c for c in target.lower() if c.isalnum())
    name = F.when(F.col("ntype") == "file", F.col("id")).otherwise(F.col("name"))
    label = F.when(F.col("ntype") == "file", F.concat(F.lit("file: "), "id")).otherwise(F.concat(F.lit("symbol: "), "name", F.lit(" ("), "path", F.lit(")")))
    nodes = g.nodes.withColumn("score", score(normalized(name), needle) if needle else F.lit(0)).withColumn("label", label)
    return _best(nodes, g, limit).select("label", "score", "degree")


def subprojects(g: PropertyGraph) -> DataFrame:
    """Q8."""
    return g.files.filter("subproject != ''").select("subproject").distinct()


def all_degrees(g: PropertyGraph) -> DataFrame:
    return degrees(g)
