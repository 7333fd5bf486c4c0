"""Path expressions: stems, and the ordered candidate names by which tests, sources and imports are paired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import TEST_PREFIXES, TEST_SUFFIXES

SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """With its dot; empty for names that only begin with one."""
    return F.regexp_extract(base(path), r"^.+?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    """The directory, '.' at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def test_candidates(path: str) -> Column:
    """Where the test of a source file may lie, in order. At the root, names beside it begin with './' and so never
    match: such files are paired only through tests/ and test/."""
    p = F.col(path)
    up, name, end = parent(p), stem(p), suffix(p)
    out = [F.concat(up, F.lit("/" + pre), name, end) for pre in TEST_PREFIXES]
    for folder in ("tests", "test"):
        for pre in TEST_PREFIXES:
            out.append(F.concat(F.lit(f"{folder}/{pre}"), name, end))
            out.append(F.when(up != ".", F.concat(up, F.lit(f"/{folder}/{pre}"), name, end)))
    out += [F.concat(up, F.lit("/"), name, F.lit(post), end) for post in TEST_SUFFIXES]
    out.append(F.concat(up, F.lit("/__tests__/"), name, end))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def source_candidates(path: str) -> Column:
    """Where the source of a test file may lie, in order: its bare name beside it, then one directory above a test folder."""
    p = F.col(path)
    up, name, end = parent(p), stem(p), suffix(p)
    above = F.when(base(up).isin("tests", "test", "__tests__"), parent(up))
    out = []
    for hit, bare in [(name.startswith(x), F.substring(name, len(x) + 1, 10_000)) for x in TEST_PREFIXES] + [(name.endswith(x), F.expr(f"left({_stem_sql(path)}, length({_stem_sql(path)}) - {len(x)})")) for x in TEST_SUFFIXES]:
        out.append(F.when(hit, F.concat(up, F.lit("/"), bare, end)))
        out.append(F.when(hit & above.isNotNull(), F.concat(above, F.lit("/"), bare, end)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _stem_sql(path: str) -> str:
    return rf"regexp_replace(element_at(split({path}, '/'), -1), '(?<=.)\\.[^.]*$', '')"


def joined(path: str, spec: str) -> Column:
    """spec seen from the directory of path, with . and .. taken away; null if it leads above the root."""
    parts = F.concat(F.slice(F.split(F.col(path), "/"), 1, F.size(F.split(F.col(path), "/")) - 1), F.split(F.col(spec), "/"))
    empty = F.array().cast("array<string>")
    walk = F.aggregate(
        parts,
        empty,
        lambda at, x: F.when(x.isin("", "."), at).when((x == "..") & (F.size(at) > 0), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(x))),
        lambda at: F.when(~F.array_contains(at, ".."), F.array_join(at, "/")),
    )
    return walk


def ts_candidates(path: str, spec: str) -> Column:
    """Of a specifier that begins with a dot the exact file, then with each extension, then an index file; others none."""
    tries = [""] + ["." + e for e in SCRIPTS] + ["/index." + e for e in SCRIPTS]
    # the path is joined once, for all endings
    found = F.transform(F.array(joined(path, spec)), lambda at: F.when(at.isNotNull(), F.transform(F.array(*map(F.lit, tries)), lambda end: F.concat(at, end))))
    return F.when(F.col(spec).startswith("."), F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
