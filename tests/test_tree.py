"""From a source tree on disk to a graph, and the refresh of what changed."""

import ast
import os

import pytest

from graphloom.functions.extract import _walk, extract, extract_files, spread
from graphloom.plans import index, queries
from graphloom.sources import toon, tree


def write(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


PROJECT = {
    "src/processor.py": "class PaymentProcessor:\n    def process(self, amount):\n        return amount\n\ndef process(x):\n    return x\n",
    "src/handler.py": "from src.processor import PaymentProcessor\n\ndef process(request):\n    return PaymentProcessor()\n",
    "src/views.py": "from src.handler import process as run\n\nresult = run(1)\n",
    "settings.yaml": "a: 1\n",
    "node_modules/x.js": "function x() {}\n",
}


def test_project(spark, tmp_path):
    write(tmp_path, PROJECT)
    g = index.build(spark, str(tmp_path), {"app": "src"})
    assert {(r["path"], r["subproject"]) for r in g.files.collect()} == {("settings.yaml", ""), *((p, "app") for p in PROJECT if p.startswith("src/"))}
    symbols = {r["id"]: r for r in g.symbols.collect()}
    assert set(symbols) == {"PaymentProcessor@src/processor.py", "process@src/processor.py", "process@src/handler.py"}
    assert (symbols["process@src/processor.py"]["line"], symbols["process@src/processor.py"]["signature"]) == (2, "process(self, amount)")
    edges = {(r["src"], r["dst"], r["etype"]) for r in g.edges.collect()}
    assert {e for e in edges if e[2] != "defines"} == {
        ("src/handler.py", "src/processor.py", "imports"), ("src/views.py", "src/handler.py", "imports"), ("src/handler.py", "PaymentProcessor@src/processor.py", "uses"),
        ("src/views.py", "process@src/handler.py", "uses"), ("process@src/handler.py", "PaymentProcessor@src/processor.py", "calls"),
    }
    assert len(edges) == 8


def test_a_test_that_imports_its_source(spark, tmp_path):
    write(tmp_path, {"pkg/m.py": "def f():\n    pass\n", "pkg/test_m.py": "from pkg.m import f\n"})
    edges = {(r["src"], r["dst"]): (r["etype"], r["evidence"]) for r in index.build(spark, str(tmp_path)).edges.filter("etype != 'defines'").collect()}
    assert edges["pkg/test_m.py", "pkg/m.py"] == ("tests", "convention") and edges["pkg/m.py", "pkg/test_m.py"] == ("tested_by", "convention")


def test_refresh(spark, tmp_path):
    root, out = tmp_path / "tree", f"file://{tmp_path}/index"
    write(root, {"pkg/a.py": "def alpha():\n    pass\n", "pkg/b.py": "from pkg.a import alpha\n\ndef beta():\n    alpha()\n"})
    assert index.refresh(spark, str(root), out)[1]["added"] == 2
    assert index.refresh(spark, str(root), out)[1] == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 2}
    write(root, {"pkg/a.py": "def renamed():\n    pass\n"})
    os.utime(root / "pkg/a.py", (2e9, 2e9))
    g, counts = index.refresh(spark, str(root), out)
    assert counts["modified"] == 1
    assert {(r["src"], r["dst"]) for r in g.edges.filter("etype != 'defines'").collect()} == {("pkg/b.py", "pkg/a.py")}
    os.remove(root / "pkg/a.py")
    g, counts = index.refresh(spark, str(root), out)
    assert counts["deleted"] == 1 and [r["id"] for r in g.files.collect()] == ["pkg/b.py"]


def test_rules(spark, tmp_path):
    write(tmp_path, {"a/x.py": "", "gen/y.py": "", "generated.py": "", "a/z.pb.py": "", "vendor/v.py": "", "vendor/d/w.py": "", "big.py": "#" * 200_001, "b.unknown": "", ".graphignore": "# made\n\ngen/\n*.pb.py\nvendor/**\n"})
    os.symlink(tmp_path / "a/x.py", tmp_path / "a/link.py")
    listed = tree.classify(tree.list_tree(spark, str(tmp_path)), ignore=tree.load_ignore(spark, str(tmp_path)))
    why = {r["path"]: r["skipped"] for r in listed.collect()}
    assert why["a/x.py"] is None and why["vendor/d/w.py"] is None
    assert why["gen/y.py"] == why["generated.py"] == why["a/z.pb.py"] == why["vendor/v.py"] == "ignored"
    assert why["big.py"] == "too_large" and why["b.unknown"] == "unknown" and why["a/link.py"] == "not_a_file"


def names(text, language, path="f"):
    return [(s["name"], s["stype"]) for s in extract(text, path, language)["symbols"]]


def test_extractors():
    assert ("area", "function") in names("package p\nfunc (s Shape) area() int { return 1 }\ntype Shape struct {}\ntype I interface {}\n", "go")
    assert {("Shape", "class"), ("I", "interface")} <= set(names("package p\ntype Shape struct {}\ntype I interface {}\n", "go"))
    assert {("S", "class"), ("T", "interface"), ("f", "function")} <= set(names("struct S {}\ntrait T {}\nfn f() {}\n", "rust"))
    assert {("A", "class"), ("go", "function")} <= set(names("public class A extends B {\n  public void go() { run(); }\n}\n", "java"))
    assert {("A", "class"), ("f", "function"), ("I", "interface"), ("g", "function")} <= set(names("export class A extends B {}\nexport function f(x: number): string {}\ninterface I {}\nconst g = (a) => 1\n", "typescript"))
    assert names("# One\n\n## Two\n### Three\n", "markdown") == [("One", "h1"), ("Two", "h2")]
    assert names("def broken(:\n", "python") == [] and names(None, "python") == []
    assert [s["stype"] for s in extract('{"name": "x", "version": "1", "scripts": {"t": "run"}}', "package.json", "packagejson")["symbols"]] == ["package", "script"]


def test_declarations_that_hide_others():
    """A constructor is no function that takes its class's place; members on the line of their brace are found."""
    java = extract("class Pay extends Base { Pay(int x) { super(x); } Pay copy() { return new Pay(1); } }", "f", "java")["symbols"]
    assert [(s["name"], s["stype"], s["extends_name"]) for s in java] == [("Pay", "class", "Base"), ("copy", "function", "")]
    assert names("public record P(int X) { public P(string s) : this(1) { } int? Sum<T>(T a) => 1; }", "csharp") == [("P", "class"), ("Sum", "function")]
    assert names("object One { fun a() {} }\nenum class E { A }\n", "kotlin") == [("One", "class"), ("a", "function"), ("E", "class")]
    assert names("a { return pay(1); }\nint b = new X(2);\n", "java") == []


def test_text_cells():
    assert [toon.cell(x) for x in (None, "a\nb", "a\r\nb", "a,b", 3)] == ["", "a b", "a b", '"a,b"', "3"]
    doc = toon.Document().pair("k", "v").table("none", ["a"], []).table("t", ["a", "b"], [(1, "x,y")])
    assert doc.text() == 'k: v\nt[1]{a,b}:\n  1,"x,y"'


def test_files_are_read_by_all_tasks(spark):
    """A small table makes many files: they are spread over the tasks, whose batches hold few of them."""
    at = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{at}/part.parquet")
    assert part.rdd.getNumPartitions() == 1 and spread(part.select("p_partkey")).rdd.getNumPartitions() >= 8
    for name in ("python_symbols", "typescript_calls", "rust_attributes"):
        assert "Exchange" in queries.QUERIES[name](spark, at)._jdf.queryExecution().executedPlan().toString()
    rows = [(f"f{i}.py", "python", f"def f{i}(): pass\n" if i % 3 else None) for i in range(1200)]
    got = {r["path"]: [s["name"] for s in r["symbols"]] for r in extract_files(spark.createDataFrame(rows, "path string, language string, content string").coalesce(1)).collect()}
    assert got == {f"f{i}.py": [f"f{i}"] if i % 3 else [] for i in range(1200)}


@pytest.mark.parametrize("name", ["python_resolved", "typescript_resolved"])
def test_imports_are_resolved_in_one_pass(spark, name):
    """No file is parsed again for the listing of paths, and the listing, which grows as the files do, is not sent to the driver."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan


def test_strings_of_decorators_are_no_literals():
    text = '@app.route("/a/long/route")\nclass A:\n    @mark("another long one")\n    def f(self, x="a long default"):\n        return "a long result"\n'
    found = {s["name"]: [x["value"] for x in s["literals"]] for s in extract(text, "f.py", "python")["symbols"]}
    assert found == {"A": ["a long default", "a long result"], "f": ["a long default", "a long result"]}


def test_walk():
    node = ast.parse('@d(1)\nclass A(B):\n    x: int = -1 + 2 if a < b and c else [i for i in y]\n    async def f(self, *a, k=f"{x}"): del a[0]; x += 1\n')
    skipped = ast.expr_context, ast.operator, ast.cmpop, ast.unaryop, ast.boolop
    assert _walk(node) == [n for n in ast.walk(node) if not isinstance(n, skipped)]
