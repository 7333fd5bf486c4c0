"""Jobs that index a source tree: in full, and again for what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.extract import extract_files
from ..model import PropertyGraph
from ..operators import link, snapshot
from ..sources import store, tree


def scan(spark: SparkSession, root: str, subprojects: dict[str, str] | None = None) -> DataFrame:
    return tree.source_files(tree.classify(tree.list_tree(spark, root), subprojects, tree.load_ignore(spark, root)))


def build(spark: SparkSession, root: str, subprojects: dict[str, str] | None = None, out: str | None = None) -> PropertyGraph:
    """Scan, extract, link; with out, the parse tables, the graph and the snapshot are saved there."""
    files = scan(spark, root, subprojects)
    parsed = extract_files(tree.with_content(files, root))
    if out:
        store.save(files, out + "/listing")
        store.save(parsed, out + "/parsed")
        files, parsed = store.load(spark, out + "/listing"), store.load(spark, out + "/parsed")
    g = link.link(files, parsed)
    if out:
        store.save_graph(g, out)
        g = store.load_graph(spark, out)
    return g


def refresh(spark: SparkSession, root: str, out: str, subprojects: dict[str, str] | None = None) -> tuple[PropertyGraph, dict[str, int]]:
    """Parses only added and modified files, drops deleted ones, and derives all edges anew if anything changed. Imports
    are resolved anew too, so that files that did not change find files that were added."""
    old = store.load(spark, out + "/listing")
    if old is None:
        g = build(spark, root, subprojects, out)
        n = g.files.count()
        return g, {"added": n, "modified": 0, "deleted": 0, "unchanged": 0}
    new = scan(spark, root, subprojects).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else scan(spark, root, subprojects)
    diff = snapshot.snapshot_diff(old, new).cache()
    counts = snapshot.summary(diff).first().asDict()
    if counts["added"] or counts["modified"] or counts["deleted"]:
        touched = new.join(diff.filter("status in ('added', 'modified')").select("path"), "path", "left_semi")
        parsed = snapshot.upsert(store.load(spark, out + "/parsed"), extract_files(tree.with_content(touched, root)), diff)
        store.save(parsed, out + "/parsed")
        store.save(new, out + "/listing")
        g = link.link(store.load(spark, out + "/listing"), store.load(spark, out + "/parsed"))
        store.save_graph(g, out)
    return store.load_graph(spark, out), counts
