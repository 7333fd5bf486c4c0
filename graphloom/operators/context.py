"""The context of a target (Q13 to Q15) and the dump of a whole graph (Q18) as tagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph, is_test
from .components import checkpoint_dir
from .graph import induced, khop

#: Sections in order, and their columns.
SECTIONS = {
    "neighbors": ["path", "language"], "exports": ["name", "type", "line", "signature", "intent"], "decorators": ["symbol", "decorator", "args"], "neighbor_symbols": ["name", "type", "file", "signature"],
    "imports": ["from", "to"], "imported_by": ["from", "to"], "tested_by": ["source", "test"], "extends": ["child", "parent"], "callers": ["file", "symbol"], "calls": ["caller", "callee"], "called_by": ["caller", "callee"],
}


def _rows(section: str, df: DataFrame, order, *columns) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(order).cast("string").alias("ord"), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in columns]).alias("cells"))


def neighbor_symbols(sub: PropertyGraph, focus: str, exclude_tests: bool = True, most: int = 30) -> DataFrame:
    """Q14: (id, name, stype, path, signature, seq, refs, total) of the subgraph's symbols outside the focus file; if
    there are more than `most` (0: no cap), those that most edges touch, then by order."""
    out = sub.symbols.filter(F.col("path") != focus)
    if exclude_tests:
        out = out.filter(~is_test(F.col("path")))
    ends = sub.of_types("imports", "defines", "extends", "tested_by", "uses", "calls").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("refs"))
    out = out.join(ends, "id", "left").fillna(0, ["refs"])
    # one number for all rows: an aggregate, combined before it is sent, and a join with its single row
    out = out.crossJoin(F.broadcast(out.agg(F.count("*").alias("total")))) if most else out.withColumn("total", F.lit(0))
    return out.orderBy(F.desc("refs"), "seq").limit(most) if most else out


def context_sections(g: PropertyGraph, target: DataFrame, depth: int = 2, exclude_tests: bool = True, most: int = 30, include_intent: bool = True) -> DataFrame:
    """Q13, Q15: (section, ord, cells) of all sections of one resolved target node, in one result, so that a caller pays one
    job. The focus is the target's file, while the search starts at the target itself."""
    row = target.select("id", "path", "ntype").first()
    focus = row["id"] if row["ntype"] == "file" else row["path"]
    # the edges are derived once, for all hops and for those among the nodes found
    checkpoint_dir(g.spark)
    whole = PropertyGraph(g.nodes, g.edges.select("src", "dst", "etype", "evidence").checkpoint())
    sub = induced(whole, khop(whole, target.select("id"), depth, held=True)).cache()
    exports = sub.symbols.filter(F.col("path") == focus)
    ids = exports.select("id")
    name = lambda c: F.substring_index(c, "@", 1)
    edges = sub.edges
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    outof = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    parts = [
        _rows("neighbors", sub.files.filter(F.col("id") != focus), "seq", "id", "language"),
        _rows("exports", exports, "seq", "name", "stype", "line", "signature", *(["intent"] if include_intent else [])),
        _rows("neighbor_symbols", neighbor_symbols(sub, focus, exclude_tests, most), "seq", "name", "stype", "path", "signature"),
        _rows("imports", edges.filter((F.col("etype") == "imports") & (F.col("src") == focus)), "dst", "src", "dst"),
        _rows("imported_by", edges.filter((F.col("etype") == "imports") & (F.col("dst") == focus)), "src", "src", "dst"),
        _rows("tested_by", edges.filter((F.col("etype") == "tested_by") & (F.col("src") == focus)), "dst", "src", "dst"),
        _rows("extends", into.filter("etype = 'extends'").union(outof.filter("etype = 'extends'").select(into.columns)).distinct(), "src", name(F.col("src")), name(F.col("dst"))),
        _rows("callers", into.filter((F.col("etype") == "uses") & (F.col("src") != focus)), "src", F.col("src"), name(F.col("dst"))),
        _rows("calls", outof.filter("etype = 'calls'"), "src", name(F.col("src")), name(F.col("dst"))),
        _rows("called_by", into.filter("etype = 'calls'").join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "src", name(F.col("src")), name(F.col("dst"))),
    ]
    if include_intent and "decorators" in g.nodes.columns:
        parts.append(_rows("decorators", exports.select("seq", "name", F.posexplode("decorators").alias("p", "d")).select(F.concat("seq", F.lpad(F.col("p").cast("string"), 3, "0")).alias("o"), "name", F.col("d.name").alias("decorator"), F.col("d.args_repr").alias("args")), "o", "name", "decorator", "args"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dump(g: PropertyGraph) -> DataFrame:
    """Q18: (section, ord, cells) of the whole graph, to be read in order of both."""
    parts = [_rows("files", g.files, "id", "id", "language", "subproject"), _rows("symbols", g.symbols, "id", "name", "stype", "path", "line", "signature")]
    for kind in ("imports", "extends", "uses", "calls", "tested_by"):
        parts.append(_rows(kind, g.of_types(kind).withColumn("o", F.concat_ws(" ", "src", "dst")), "o", "src", "dst"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
