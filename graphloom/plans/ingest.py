"""Queries of the ingestion half (S, X and E1, E2 of the survey): a source file for each part, and the SQL that says what is in it.

A template's {k}, {s} and {n} stand for a part's key, size and name, in the text that is read and in the rows that are expected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import extract_files, spread
from ..operators import link
from ..sources import tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_FILL = {"{k}": "p_partkey", "{s}": "p_size", "{n}": "p_name"}


def _filled(template: str) -> Column:
    out = F.lit(template)
    for mark, column in _FILL.items():
        out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
    return out


def _sql(template) -> str:
    if not isinstance(template, str):
        return str(template)
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for mark, column in _FILL.items():
        if mark in template:
            out = f"replace({out}, '{mark}', CAST({column} AS VARCHAR))"
    return out


def _expected(columns: str, rows: list[tuple]) -> str:
    names = columns.split()
    return " UNION ALL ".join("SELECT " + ", ".join(f"{_sql(v)} AS {c}" for c, v in zip(names, row)) + " FROM part" for row in rows)


def _texts(spark: SparkSession, sf: str, language: str, path: str, text: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_name"))
    return part.select(_filled(path).alias("path"), F.lit(language).alias("language"), _filled(text).alias("content"))


def _files(spark: SparkSession, sf: str, language: str, path: str, text: str) -> DataFrame:
    return extract_files(_texts(spark, sf, language, path, text))


def _add(name: str, language: str, path: str, text: str, read: Callable[[DataFrame], DataFrame], columns: str, rows: list[tuple]) -> None:
    QUERIES[name] = lambda spark, sf: read(_files(spark, sf, language, path, text))
    ORACLE_SQL[name] = _expected("path " + columns, [(path, *r) for r in rows])


def _symbols(df: DataFrame) -> DataFrame:
    return df.select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.stype", "s.line", "s.signature", F.col("s.extends_name").alias("parent"), "s.intent")


def _decorators(df: DataFrame) -> DataFrame:
    return df.select("path", F.explode("symbols").alias("s")).select("path", "s.name", F.posexplode("s.decorators").alias("n", "d")).select("path", "name", "n", F.col("d.name").alias("decorator"), F.array_join("d.args", "|").alias("args"))


def _literals(df: DataFrame) -> DataFrame:
    return df.select("path", F.explode("symbols").alias("s")).select("path", "s.name", F.explode("s.literals").alias("l")).select("path", "name", "l.value", "l.line")


def _calls(df: DataFrame) -> DataFrame:
    return df.select("path", F.explode("calls").alias("c")).select("path", "c.caller", "c.callee")


def _imports(df: DataFrame) -> DataFrame:
    return df.select("path", F.explode("imports").alias("i")).select("path", "i.spec", "i.level", F.array_join("i.names", "|").alias("names"))


_SYMBOLS = "name stype line signature parent intent"

# X1 to X7

_PYTHON = """import os, pkg.base{k}
from .util{k} import helper{k}, other as o
from ..far import *

@app.route("/r{k}", {s}, x, y="z")
@cached
class Shop{k}(Base{s}, Mixin):
    '''About {n}.'''

    async def sell(self, item: int = {s}) -> str:
        '''Sells {n}'''
        helper{k}("please pay {s} coins now")
        return self.price{k}(item)

    def price{k}(self, *a, **kw):
        sell(1)
        return "short"

def free(x, /, y=None):
    return Shop{k}("[bold]a text of more words: {n}[/bold]")
"""
_PY = ("python", "pkg{s}/f{k}.py", _PYTHON)
_add("python_symbols", *_PY, _symbols, _SYMBOLS, [
    ("Shop{k}", "class", 7, "Shop{k}(Base{s}, Mixin)", "Base{s}", "About {n}."), ("sell", "function", 10, "sell(self, item: int={s}) -> str", "", "Sells {n}"),
    ("price{k}", "function", 15, "price{k}(self, *a, **kw)", "", ""), ("free", "function", 19, "free(x, /, y=None)", "", ""),
])
_add("python_imports", *_PY, _imports, "spec level names", [("os", 0, ""), ("pkg.base{k}", 0, ""), ("util{k}", 1, "helper{k}|other"), ("far", 2, "")])
_add("python_calls", *_PY, _calls, "caller callee", [("sell", "helper{k}"), ("sell", "price{k}"), ("price{k}", "sell"), ("free", "Shop{k}")])
_add("python_decorators", *_PY, _decorators, "name n decorator args", [("Shop{k}", 0, "cached", ""), ("Shop{k}", 1, "app.route", "/r{k}|{s}|z")])
_add("python_literals", *_PY, _literals, "name value line", [
    ("Shop{k}", "please pay {s} coins now", 12), ("Shop{k}", "Sells {n}", 11), ("sell", "please pay {s} coins now", 12), ("free", "a text of more words: {n}", 20),
])

# X8 to X14

_TYPESCRIPT = """import { load{k} as l, save } from "./store{k}";
import def from '../lib/x';
const fs = require("fs{s}");
export { a } from "./a{s}";

// Keeps {n}
export abstract class Cart{k} extends Base{s} {
  run() { save(); }
}

/**
 * Pays {n}
 * @param x
 */
export async function pay{k}(x: number, y?: string): Promise<void> {
  save(x); Cart{k}();
}
@Comp("c{k}", 'd')
@Bare
class View{k} {}
const tot = async (a) => { pay{k}(a) }
interface Item{k} { id: number }
export type Kind{k} = "a" | "b";
"""
_TS = ("typescript", "web{s}/f{k}.ts", _TYPESCRIPT)
_add("typescript_symbols", *_TS, _symbols, _SYMBOLS, [
    ("Cart{k}", "class", 7, "Cart{k}(Base{s})", "Base{s}", "Keeps {n}"), ("pay{k}", "function", 15, "pay{k}(x: number, y?: string) -> Promise<void>", "", "Pays {n}"),
    ("View{k}", "class", 20, "View{k}", "", ""), ("tot", "function", 21, "tot = async (a)", "", ""), ("Item{k}", "interface", 22, "Item{k}", "", ""), ("Kind{k}", "type", 23, "Kind{k}", "", ""),
])
_add("typescript_imports", *_TS, _imports, "spec level names", [("./store{k}", 0, ""), ("../lib/x", 0, ""), ("./a{s}", 0, ""), ("fs{s}", 0, ""), ("./store{k}", 0, "load{k}|save")])
_add("typescript_calls", *_TS, _calls, "caller callee", [("pay{k}", "save"), ("pay{k}", "Cart{k}"), ("tot", "pay{k}")])
_add("typescript_decorators", *_TS, _decorators, "name n decorator args", [("View{k}", 0, "Comp", "c{k}|d"), ("View{k}", 1, "Bare", "")])

# One text a language, with members on the line of their brace

_add("go_symbols", "go", "go{s}/f{k}.go", """package p

import "fmt"

// Area of {n}
func (s *Shape{k}) Area(a, b int) (int, error) { return help{k}(a) }
func help{k}(a int) int { return a }
type Shape{k}[T any] struct { x T }
type Sized interface { Size() }
""", _symbols, _SYMBOLS, [("Area", "function", 6, "Area(a, b int) -> (int, error)", "", "Area of {n}"), ("help{k}", "function", 7, "help{k}(a int) -> int", "", ""), ("Shape{k}", "class", 8, "Shape{k}", "", ""), ("Sized", "interface", 9, "Sized", "", "")])  # fmt: skip
_RUST = ("rust", "rs{s}/f{k}.rs", """use std::io;

/// Adds {n}
#[inline("a{k}")]
pub fn add{k}<T>(a: i32) -> i32 { sub(a) }
fn sub(a: i32) -> i32 { a }
pub struct Set{k};
trait Size { fn size(&self) -> u8; }
impl Size for Set{k} { fn size(&self) -> u8 { {s} } }
enum Kind { A }
""")  # fmt: skip
_add("rust_symbols", *_RUST, _symbols, _SYMBOLS, [
    ("add{k}", "function", 5, "add{k}(a: i32) -> i32", "", "Adds {n}"), ("sub", "function", 6, "sub(a: i32) -> i32", "", ""), ("Set{k}", "class", 7, "Set{k}", "", ""), ("Size", "interface", 8, "Size", "", ""),
    ("size", "function", 8, "size(&self) -> u8", "", ""), ("Set{k}", "class", 9, "Set{k}(Size)", "Size", ""), ("size", "function", 9, "size(&self) -> u8", "", ""), ("Kind", "class", 10, "Kind", "", ""),
])
_add("rust_attributes", *_RUST, _decorators, "name n decorator args", [("add{k}", 0, "inline", "a{k}")])
_JAVA = ("java", "java{s}/F{k}.java", """import java.util.List;

/** Pays {n} */
@Entity("t{k}")
public class Pay{k}<T> extends Base{s} {
  public Pay{k}(int x) { go(x); }
  public <U> U gen(U a) { return a; }
  @Test static List<String> go(int x) throws E { return gen(x); } int[] two() { return null; }
}
interface Sized { void size(); }
""")  # fmt: skip
_add("java_symbols", *_JAVA, _symbols, _SYMBOLS, [
    ("Pay{k}", "class", 5, "Pay{k}(Base{s})", "Base{s}", "Pays {n}"), ("gen", "function", 7, "gen(U a) -> U", "", ""), ("go", "function", 8, "go(int x) -> List<String>", "", ""), ("two", "function", 8, "two() -> int[]", "", ""),
    ("Sized", "interface", 10, "Sized", "", ""), ("size", "function", 10, "size() -> void", "", ""),
])
_add("java_annotations", *_JAVA, _decorators, "name n decorator args", [("Pay{k}", 0, "Entity", "t{k}")])
_add("java_calls", *_JAVA, _calls, "caller callee", [("go", "gen")])
for _language, _end, _text, _rows in (
    ("csharp", "cs", "using System;\n\n/// Pays {n}\npublic class Pay{k} : Base{s} {\n  public Pay{k}(int x) : base(x) { }\n  int Sum(int a) => a;\n  public async Task<int> Run<T>(T a) { return {s}; }\n}\npublic record Point{k}(int X);\ninterface ISized { void Size(); }\nstruct Small {}\n",
     [("Pay{k}", "class", 4, "Pays {n}"), ("Sum", "function", 6, ""), ("Run", "function", 7, ""), ("Point{k}", "class", 9, ""), ("ISized", "interface", 10, ""), ("Size", "function", 10, ""), ("Small", "class", 11, "")]),
    ("kotlin", "kt", "import a.b.C\n\n// Keeps {n}\nclass Box{k}(val x: Int) : Base() { fun one(): Int = {s} }\n\ninterface Sized { fun size() }\nfun <T> top{k}(x: T) {}\n",
     [("Box{k}", "class", 4, "Keeps {n}"), ("one", "function", 4, "Keeps {n}"), ("Sized", "class", 6, ""), ("size", "function", 6, ""), ("top{k}", "function", 7, "")]),
    ("scala", "scala", "import a.b\n\n// Keeps {n}\nclass Box{k}(x: Int) extends Base { def one: Int = {s}; def two(a: Int): Int = a }\n\ntrait Sized { def size(): Unit }\nobject Main{k}\n",
     [("Box{k}", "class", 4, "Keeps {n}"), ("one", "function", 4, "Keeps {n}"), ("two", "function", 4, "Keeps {n}"), ("Sized", "interface", 6, ""), ("size", "function", 6, ""), ("Main{k}", "class", 7, "")]),
    ("php", "php", "<?php\nuse A\\B;\n/** Keeps {n} */\nclass Box{k} extends Base { public function one($a) { return $a; } private static function two() {} }\n\ninterface Sized { public function size(); }\nfunction top{k}() {}\n",
     [("Box{k}", "class", 4, "Keeps {n}"), ("one", "function", 4, "Keeps {n}"), ("two", "function", 4, "Keeps {n}"), ("Sized", "interface", 6, ""), ("size", "function", 6, ""), ("top{k}", "function", 7, "")]),
    ("swift", "swift", "import UIKit\n\n/// Keeps {n}\nclass Box{k}: Base { func one() -> Int { {s} } }\n\nstruct Small { func two() throws -> Int { 2 } }\nprotocol Sized { func size() }\nenum Kind{k} {}\nactor Runner {}\n",
     [("Box{k}", "class", 4, "Keeps {n}"), ("one", "function", 4, "Keeps {n}"), ("Small", "class", 6, ""), ("two", "function", 6, ""), ("Sized", "interface", 7, ""), ("size", "function", 7, ""), ("Kind{k}", "class", 8, ""), ("Runner", "class", 9, "")]),
):
    _add(f"{_language}_symbols", _language, "src{s}/F{k}." + _end, _text, _symbols, _SYMBOLS, [(name, kind, line, name, "", intent) for name, kind, line, intent in _rows])

# X24 to X28

_add("openapi_endpoints", "data", "api{s}/f{k}.json", '{"openapi": "3.0.0", "paths": {"/items/{k}": {"get": {"operationId": "get{k}", "summary": "Reads {n}"}, "post": {"description": "Writes {n}\\nand more"}}, "/empty": {"delete": {"summary": ""}}}}', _symbols, _SYMBOLS, [
    ("GET /items/{k}", "endpoint", 0, "get{k}", "", "Reads {n}"), ("POST /items/{k}", "endpoint", 0, "POST /items/{k}", "", "Writes {n}"), ("DELETE /empty", "endpoint", 0, "DELETE /empty", "", ""),
])
_add("markdown_headings", "markdown", "docs{s}/f{k}.md", "# Part {k}\n\ntext\n## About {n}  \n### Deeper\n#No heading\n", _symbols, _SYMBOLS, [("Part {k}", "h1", 1, "Part {k}", "", ""), ("About {n}", "h2", 4, "About {n}", "", "")])
_add("json_schema_parts", "data", "schema{s}/f{k}.json", '{"$schema": "x", "definitions": {"Part{k}": {"type": "string", "description": "A {n}"}}, "$defs": {"Size{s}": {"title": "Size"}}, "properties": {"key": {"type": "integer"}, "odd": true}}', _symbols, _SYMBOLS, [
    ("Part{k}", "schema", 0, "Part{k}: string", "", "A {n}"), ("Size{s}", "schema", 0, "Size{s}: object", "", "Size"), ("key", "schema", 0, "key: integer", "", ""),
])
_add("pyproject_package", "pyproject", "p{k}/pyproject.toml", '[project]\nname = "part{k}"\nversion = "{s}.0"\ndescription = "A {n}"\n[project.scripts]\nrun{k} = "part{k}.cli:main"\n', _symbols, _SYMBOLS, [
    ("part{k}", "package", 0, "part{k} v{s}.0", "", "A {n}"), ("run{k}", "script", 0, "part{k}.cli:main", "", ""),
])
_add("package_json", "packagejson", "p{k}/package.json", '{"name": "part{k}", "version": "{s}.1.0", "description": "A {n}", "scripts": {"build": "make {k}"}}', _symbols, _SYMBOLS, [
    ("part{k}", "package", 0, "part{k}@{s}.1.0", "", "A {n}"), ("build", "script", 0, "make {k}", "", ""),
])

# S1 to S5, S10 over a listing of parts


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each part: its folder by its size, its ending by its key; every eleventh is a link, every thirteenth too large."""
    k, size = F.col("p_partkey"), F.col("p_size")
    ends = F.element_at(F.array(*map(F.lit, _ENDS)), (k % len(_ENDS) + 1).cast("int"))
    folder = F.when(size % 7 == 0, F.lit("web/node_modules")).when(size % 7 == 1, F.lit("gen")).when(size % 7 < 4, F.lit("app/src")).otherwise(F.lit("lib"))
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select(F.concat(folder, F.lit("/f"), k.cast("string"), ends).alias("path"), F.when(k % 11 == 0, "symlink").otherwise("file").alias("kind"), F.when(k % 13 == 0, 200_001).otherwise(100).cast("bigint").alias("size"), F.lit(0.0).alias("mtime"))


_ENDS = (".py", ".ts", ".jsx", ".go", ".rs", ".kts", ".yml", ".txt", "", ".pb.py", ".mdx")
_IGNORE = ["gen/", "*.pb.py"]
_LANGUAGES = {".py": "python", ".ts": "typescript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".kts": "kotlin", ".yml": "data", ".pb.py": "python", ".mdx": "markdown"}
_LISTED = f"""l AS (SELECT p_partkey AS k, p_size % 7 AS f, [{", ".join(f"'{e}'" for e in _ENDS)}][p_partkey % {len(_ENDS)} + 1] AS e FROM part),
t AS (SELECT k, (CASE WHEN f = 0 THEN 'web/node_modules' WHEN f = 1 THEN 'gen' WHEN f < 4 THEN 'app/src' ELSE 'lib' END) || '/f' || k || e AS path,
  CASE e {" ".join(f"WHEN '{e}' THEN '{x}'" for e, x in _LANGUAGES.items())} ELSE 'other' END AS language, CASE WHEN f IN (2, 3) THEN 'app' WHEN f = 0 THEN 'web' ELSE '' END AS subproject,
  CASE WHEN k % 11 = 0 THEN 'not_a_file' WHEN f = 0 THEN 'skipped_dir' WHEN e IN ('.txt', '') THEN 'unknown' WHEN k % 13 = 0 THEN 'too_large' WHEN f = 1 OR e = '.pb.py' THEN 'ignored' END AS skipped FROM l)"""


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return tree.classify(_listing(spark, sf), {"app": "app", "web": "web/"}, _IGNORE)


QUERIES["tree_classify"] = lambda spark, sf: _classified(spark, sf).select("path", "language", "subproject", "skipped")
ORACLE_SQL["tree_classify"] = f"WITH {_LISTED} SELECT path, language, subproject, skipped FROM t"
QUERIES["tree_source_files"] = lambda spark, sf: tree.source_files(_classified(spark, sf)).select("path", "file_seq")
ORACLE_SQL["tree_source_files"] = f"WITH {_LISTED} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS file_seq FROM t WHERE skipped IS NULL"
QUERIES["tree_skip_stats"] = lambda spark, sf: tree.skip_stats(_classified(spark, sf)).select("skipped", "files", F.array_join("dirs", "|").alias("dirs"))
ORACLE_SQL["tree_skip_stats"] = f"WITH {_LISTED} SELECT skipped, count(*) AS files, CASE WHEN count(*) FILTER (WHERE contains(path, 'node_modules')) > 0 THEN 'node_modules' ELSE '' END AS dirs FROM t WHERE skipped IS NOT NULL GROUP BY 1"
QUERIES["tree_languages"] = lambda spark, sf: tree.languages(_classified(spark, sf))
ORACLE_SQL["tree_languages"] = f"WITH {_LISTED} SELECT language, count(*) AS files FROM t WHERE skipped IS NULL GROUP BY 1"

# Imports of one text are resolved against the files of all parts


def _resolved(language: str, path: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        texts = _texts(spark, sf, language, path, text)
        # the listing is that of the texts: no file is parsed for its path
        return link.resolved_imports(extract_files(texts), texts.select("path").distinct()).select("path", "target", F.array_join("names", "|").alias("names"))

    return run


QUERIES["python_resolved"] = _resolved("python", "m{k}/__init__.py", "import m{s}\nfrom ..m{s} import a, b\nfrom m{k} import me\nimport nowhere\nfrom . import x\n")
ORACLE_SQL["python_resolved"] = """WITH p AS (SELECT 'm' || p_partkey || '/__init__.py' AS path, 'm' || p_size || '/__init__.py' AS other, p_size IN (SELECT p_partkey FROM part) AS there FROM part)
SELECT path, other AS target, '' AS names FROM p WHERE there UNION ALL SELECT path, other, 'a|b' FROM p WHERE there UNION ALL SELECT path, path, 'me' FROM p"""
QUERIES["typescript_resolved"] = _resolved("typescript", "d{k}/index.ts", 'import { a } from "../d{s}";\nimport x from "../d{s}/index";\nimport y from "./index.ts";\nimport z from "d{s}";\nimport w from "../../d{s}";\n')
ORACLE_SQL["typescript_resolved"] = """WITH p AS (SELECT 'd' || p_partkey || '/index.ts' AS path, 'd' || p_size || '/index.ts' AS other, p_size IN (SELECT p_partkey FROM part) AS there FROM part)
SELECT path, other AS target, '' AS names FROM p WHERE there UNION ALL SELECT path, other, '' FROM p WHERE there UNION ALL SELECT path, other, 'a' FROM p WHERE there UNION ALL SELECT path, path, '' FROM p"""
