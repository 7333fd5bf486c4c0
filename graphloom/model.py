"""Schemas, vocabularies and the PropertyGraph that every operator takes.

A graph is two DataFrames. Nodes: id, ntype (file or symbol), name, path, language, subproject, stype, line, signature,
intent, seq (the total order that breaks every tie). Edges: src, dst, etype, evidence, one per ordered pair. Columns that a
graph lacks are filled with their neutral value, so any node and edge tables can be wrapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED_DIRS = frozenset(
    ".git .github .venv venv env node_modules __pycache__ .tox .pytest_cache .ruff_cache dist build out target .next .nuxt coverage htmlcov .knowledge test-results".split()
)
_BY_LANGUAGE = {
    "python": "py", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "go": "go", "rust": "rs", "java": "java", "csharp": "cs", "kotlin": "kt kts",
    "scala": "scala", "php": "php", "swift": "swift", "markdown": "md mdx", "data": "yaml yml json",
}
EXTENSIONS = {"." + e: lang for lang, all_ in _BY_LANGUAGE.items() for e in all_.split()}
NAMED = {"pyproject.toml": "pyproject", "package.json": "packagejson"}
LARGEST = 200_000
STRUCTURAL = ("go", "rust", "java", "csharp", "kotlin", "scala", "php", "swift")
TEST_PREFIXES, TEST_SUFFIXES = ("test_", "tests_"), ("_test", ".test", ".spec")
DERIVED = ("imports", "uses", "calls", "extends", "tested_by", "tests")
FILE_DEPS = ("imports", "uses", "tested_by")
#: Order in which edges of a pair overwrite each other: the last one stays.
PRIORITY = {"defines": 0, "imports": 1, "uses": 1, "extends": 2, "calls": 3, "tested_by": 4, "tests": 4}
DEFAULTS = {"ntype": "file", "name": "", "path": "", "language": "", "subproject": "", "stype": "", "line": 0, "signature": "", "intent": ""}

DECORATORS = "array<struct<name:string,args:array<string>,args_repr:string>>"
LITERALS = "array<struct<value:string,line:int>>"
EXTRACTED = (
    "path string, imports array<struct<spec:string,level:int,kind:string,names:array<string>>>, "
    "symbols array<struct<name:string,stype:string,line:int,signature:string,extends_name:string,intent:string,decorators:"
    + DECORATORS
    + ",literals:"
    + LITERALS
    + ">>, calls array<struct<caller:string,callee:string>>"
)


class PropertyGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        have = set(nodes.columns)
        for c, v in DEFAULTS.items():
            if c not in have:
                nodes = nodes.withColumn(c, F.col("id") if c in ("name", "path") else F.lit(v))
        if "seq" not in have:
            nodes = nodes.withColumn("seq", F.col("id"))
        if "evidence" not in edges.columns:
            edges = edges.withColumn("evidence", F.lit(None).cast("string"))
        self.nodes, self.edges = nodes, edges

    @property
    def spark(self):
        return self.nodes.sparkSession

    @property
    def files(self) -> DataFrame:
        return self.nodes.filter("ntype = 'file'")

    @property
    def symbols(self) -> DataFrame:
        return self.nodes.filter("ntype = 'symbol'")

    def of_types(self, *types: str) -> DataFrame:
        return self.edges.filter(F.col("etype").isin(*types))

    def cache(self) -> PropertyGraph:
        self.nodes.cache()
        self.edges.cache()
        return self


def one_edge_per_pair(candidates: DataFrame) -> DataFrame:
    """Of all candidate edges of an ordered pair the one that is derived last; within a priority, tested types by
    name and evidence, so that the choice is the same in every run. One aggregation, combined on the map side."""
    rank: Column = F.coalesce(*[F.when(F.col("etype") == k, F.lit(v)) for k, v in PRIORITY.items()], F.lit(1))
    best = F.max(F.struct(rank.alias("rank"), "etype", "evidence")).alias("best")
    return candidates.groupBy("src", "dst").agg(best).select("src", "dst", "best.etype", "best.evidence")


def is_test(path: Column) -> Column:
    """A stem with a test prefix or suffix, or a __tests__ directory."""
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    hit = F.array_contains(F.split(path, "/"), "__tests__")
    for p in TEST_PREFIXES:
        hit = hit | stem.startswith(p)
    for s in TEST_SUFFIXES:
        hit = hit | stem.endswith(s)
    return hit


def tokens(chars: Column) -> Column:
    """Characters over four, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(chars / 4).cast("bigint"))
